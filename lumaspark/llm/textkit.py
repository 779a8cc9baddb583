"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; those bytes never occur inside a multi-byte
UTF-8 sequence, so splitting bytes equals splitting code points. Hashes are 64 bits wide and computed with wrapping
arithmetic: a polynomial prefix sum over the whole buffer gives the hash of any word in constant time.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1_500

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for letter runs: every ASCII byte but letters and digits. Bytes of other characters count as letters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same kernel, giving memory back to the system at its end: worker processes live on and would hold what one task needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python by at most BATCH_ROWS rows: a batch stands in memory of the JVM and of the worker, several times. This
    setting of the session stays, as results are computed later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """Hashes of spans of a sequence of symbols: equal symbols give equal hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        """``values``: a random number for each symbol that ``data`` can hold."""
        self.data, self._values = data, values
        self._prefix: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(len(self.data) + 1)
        if self._prefix is None:
            values = self._values[self.data]
            self._prefix = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * up[: len(values)], out=self._prefix[1:])
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Words(Spans):
    """The words of a few texts, A-Z lower-cased if asked. ``start``/``end``: byte places; ``first[i]:first[i+1]``: the words of
    text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE, values: np.ndarray | None = None):
        super().__init__(data, (_BYTE_LOWER if lower else _BYTE) if values is None else values)
        self.offsets = offsets
        n = len(data)
        solid = ~space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


_CODES: dict[str, np.ndarray] = {}
NEITHER, LETTER, MARK = 0, 1, 2
#: Beyond the code points below the first number, none is a letter or mark but the variation selectors of the second range.
_LAST, _SELECTORS = 0x32400, (0xE0100, 0xE01F0)


def code_tables() -> dict[str, np.ndarray]:
    """For each code point: kind (LETTER, MARK or NEITHER), its lower-case form where that is one code point, a random number."""
    if not _CODES:
        kind, lower = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
        kind[_SELECTORS[0] : _SELECTORS[1]] = MARK
        for code in range(_LAST):
            category = unicodedata.category(chr(code))
            if category[0] in "LM":
                kind[code] = LETTER if category[0] == "L" else MARK
                small = chr(code).lower()
                if len(small) == 1:
                    lower[code] = ord(small)
        _CODES.update(kind=kind, lower=lower, value=mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return _CODES


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in UTF-8, and the offsets in them."""
    try:
        text = data.tobytes().decode("utf-8")
        offsets = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, offsets = "".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), offsets


class LetterWords(Words):
    """Runs of letters and marks with at least one letter, lower-cased; places count code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        tables = code_tables()
        codes, places = code_points(data, offsets)
        super().__init__(tables["lower"][codes], places, space=tables["kind"] == NEITHER, values=tables["value"])
        if (tables["kind"][codes] == MARK).any():
            letters = np.concatenate(([0], np.cumsum(tables["kind"][codes] == LETTER)))
            some = letters[self.end] > letters[self.start]
            self.start, self.end = self.start[some], self.end[some]
            self.first = np.searchsorted(self.start, places)

    def strings(self, which: np.ndarray) -> list[str]:
        """Some words by number."""
        text = self.data.astype("<u4", copy=False).tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of a string column, by about ``limit`` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if not rows:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=column.offset + rows + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SALTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and ``first`` (see Words) into them; a shorter text is one shingle."""
    h = words.hashes()
    count = np.diff(words.first)
    n = len(h)
    if n >= size:
        rolled = np.zeros(n - size + 1, dtype=np.uint64)
        for i in range(size):
            rolled += mix(h[i : n - size + 1 + i] ^ _SALTS[i])
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    out_count = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(out_count)))
    text = np.repeat(np.arange(len(count)), out_count)
    at = words.first[text] + (np.arange(first[-1]) - first[text])
    out = np.zeros(first[-1], dtype=np.uint64)
    whole = count[text] >= size
    out[whole] = rolled[at[whole]]
    for t in np.flatnonzero((count > 0) & (count < size)):
        part = h[words.first[t] : words.first[t + 1]]
        out[first[t]] = mix(np.sum(mix(part ^ _SALTS[: len(part)])) + _SALTS[40 + len(part)].reshape(1))[0]
    return out, first


def distinct_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes, but each text's hashes are sorted and distinct."""
    raw, first = shingle_hashes(words, size)
    parts = [np.unique(raw[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(parts) if parts else raw, np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
