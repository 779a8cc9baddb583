"""Byte-level BPE: exact merging, a transducer lexicon for frequent words, and decoding.

Texts are encoded by pieces (see there). Frequent pieces are looked up in a minimal acyclic automaton whose arc outputs
add up to the piece's place in a table of id lists; all others are split by the pattern and merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequent import most_frequent
from .pieces import PieceEncoder
from .scratch import Scratch
from .textkit import chunks, small_batches, trimmed

#: Bytes of text that are encoded together.
CHUNK = 3 << 19
#: Marks at a word's end that the pattern takes as one run.
TAIL = ".,;:!?%*#&$|\"()-_=+/@"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary in the JSON form of the public tokenizers library."""

    def __init__(self, spec: str):
        import regex

        model = json.loads(spec)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = model["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.table = MergeTable(self)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.stops = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pattern match: the pair of lowest rank is merged, leftmost first, until none is left.

        Pairs wait in a heap over a linked list, so a match of n bytes takes O(n log n) steps."""
        parts = [self.single[b] for b in word]
        n = len(parts)
        if n < 2:
            return parts
        merges = self.merges
        if n <= 24:
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = merges.get((parts[i], parts[i + 1]))
                    if found and (best is None or found[0] < best[0]):
                        best, at = found, i
                if best is None:
                    break
                parts[at : at + 2] = [best[1]]
            return parts
        from heapq import heapify, heappop, heappush

        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f[0], i, parts[i], parts[i + 1], f[1]) for i in range(n - 1) if (f := merges.get((parts[i], parts[i + 1])))]
        heapify(heap)
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (f := merges.get((parts[a], parts[b]))):
                    heappush(heap, (f[0], a, parts[a], parts[b], f[1]))
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.merge(m.encode())]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens become those tokens."""
        if not self.special:
            return self.plain(text)
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: Iterator[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


class MergeTable:
    """The merges as sorted arrays, to merge many words together."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, bpe: ByteBpe):
        pairs = np.array([a << 32 | b for a, b in bpe.merges], dtype=np.int64).reshape(-1)
        found = np.array(list(bpe.merges.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], found[order, 0].astype(np.int32)
        self.merged = np.zeros(int(found[:, 0].max(initial=-1)) + 1, dtype=np.int64)
        self.merged[found[:, 0]] = found[:, 1]
        self.single = np.array(bpe.single, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        if not len(self.pairs):
            return np.full(key.shape, self.NONE, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words that are one pattern match each. Words of one length make a matrix; every step merges each
        row's leftmost pair of lowest rank, so rows stay equally long until they are done."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            if length:
                raw = np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8).reshape(len(rows), length)
                self._merge_equal(self.single[raw], rows, out)
        return out

    def _merge_equal(self, ids: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        def done(block: np.ndarray, places: np.ndarray) -> None:
            data, size = block.astype("<u4").tobytes(), 4 * block.shape[1]
            for k, place in enumerate(places.tolist()):
                out[place] = data[k * size : (k + 1) * size]

        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(ids):
            at = ranks.argmin(axis=1)
            line = np.arange(len(ids))
            best = ranks[line, at]
            over = best == self.NONE
            if over.any():
                done(ids[over], rows[over])
                live = ~over
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
                line = np.arange(len(ids))
            width = ids.shape[1]
            ids[line, at] = self.merged[best]
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(line), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(line), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
        done(ids, rows)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer over ``words`` and its id lists, as one block of bytes.

    Sorted words are added one at a time and finished states with equal futures are merged, so suffixes are shared.
    The output of an arc is the number of words that sort between the state's own and those below the arc; the
    outputs along a word, plus one for each shorter word passed, give its place in sorted order."""
    order = sorted(words)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path = [(0, 0)]

    def finish(depth: int) -> None:
        while len(path) > depth + 1:
            state, label = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            known = register.setdefault(key, state)
            if known != state:
                arcs[path[-1][0]][label] = known
                arcs[state] = {}
                free.append(state)

    last = b""
    for word in order:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        finish(common)
        for byte in word[common:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1][0]][byte] = state
            path.append((state, byte))
        final[path[-1][0]] = True
        last = word
    finish(0)
    count: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [t for t in arcs[state].values() if t not in count]
        if todo:
            stack += todo
        else:
            count[state] = int(final[state]) + sum(count[t] for t in arcs[state].values())
            stack.pop()
    number = {state: i for i, state in enumerate(sorted(count))}
    keys, targets, outputs = [], [], []
    for state in sorted(count):
        skipped = int(final[state])
        for label, target in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | label)
            targets.append(number[target])
            outputs.append(skipped)
            skipped += count[target]
    flat = [i for w in order for i in words[w]]
    first = np.concatenate(([0], np.cumsum([len(words[w]) for w in order]))).astype("<i8") if order else np.zeros(1, "<i8")
    ends = np.zeros(len(number), dtype="u1")
    for state, i in number.items():
        ends[i] = final[state]
    blocks = [np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(outputs, "<i8"), first, np.array(flat, "<u4"), ends]
    return struct.pack("<6q", *(len(b) for b in blocks)) + b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed file that goes with the process."""

    def __init__(self, block: bytes):
        self._file = tempfile.TemporaryFile()
        self._file.write(block)
        self._file.flush()
        view = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = struct.unpack_from("<6q", view)
        at, parts = 48, []
        for size, kind in zip(sizes, ("<i8", "<i8", "<i8", "<i8", "<u4", "u1"), strict=True):
            parts.append(np.frombuffer(view, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.keys, self.targets, self.outputs, self.first, self.flat, self.final = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 if it is not in the lexicon; all words take each step together."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        live = np.flatnonzero(length > 0)
        state = np.zeros(len(live), dtype=np.int64)
        total = np.zeros(len(live), dtype=np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[start[live] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.targets[arc], total[ok] + self.outputs[arc]
            step += 1
            over = length[live] == step
            hit = over & (self.final[state] == 1)
            out[live[hit]] = total[hit]
            live, state, total = live[~over], state[~over], total[~over]
        return out

    def ids(self, place: int) -> bytes:
        return self.flat[self.first[place] : self.first[place + 1]].tobytes()


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def lexicon_encoder(bpe: ByteBpe, lexicon: Lexicon) -> PieceEncoder:
    tails: dict[str, bytes] = {"": b""}

    def encode_new(pieces: list[str]) -> list[bytes]:
        places = lexicon.places([p.encode() for p in pieces]).tolist()
        out, unseen, words, ends = [b""] * len(pieces), [], [], []
        for k, (piece, at) in enumerate(zip(pieces, places, strict=True)):
            if at >= 0:
                out[k] = lexicon.ids(at)
                continue
            core = piece.rstrip(TAIL)
            if (core[1:] if core[:1] == " " else core).isalpha():
                end = piece[len(core) :]
                if end not in tails:
                    tails[end] = packed(bpe.merge(end.encode()))
                unseen.append(k)
                words.append(core.encode())
                ends.append(tails[end])
            else:
                out[k] = packed(bpe.plain(piece))
        if len(tails) > 100_000:
            tails.clear()
            tails[""] = b""
        for k, ids, end in zip(unseen, bpe.table.merge(words), ends, strict=True):
            out[k] = ids + end
        return out

    return PieceEncoder(list(bpe.special), encode_new, lambda text: packed(bpe.encode(text)))


def frequent_words(docs: DataFrame, text_col: str, limit: int, most_bytes: int = 48) -> list[str]:
    """The most frequent words between spaces and line ends over all rows; at most ``limit`` rows reach the driver. Words keep
    commas and such, as pieces do."""
    words = docs.select(F.explode(F.split(docs[text_col].cast("string"), "[ \n]")).alias("w")).where(F.octet_length("w").between(1, most_bytes))
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "words")
    found = sorted(most_frequent(counted, limit).select("w").toArrow()["w"].to_pylist())
    scratch.drop(counted)
    return found


def build_lexicon(bpe: ByteBpe, words: list[str]) -> bytes:
    return compile_lexicon({(" " + w).encode(): bpe.plain(" " + w) for w in words})


_LOADED: dict[tuple[str, bytes], tuple[ByteBpe, PieceEncoder]] = {}


def _loaded(spec: str, lexicon: bytes) -> tuple[ByteBpe, PieceEncoder]:
    """Vocabulary and mapped lexicon, once a worker process, for the last pair asked for."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), hashlib.sha256(lexicon).digest())
    if key not in _LOADED:
        _LOADED.clear()
        bpe = ByteBpe(spec)
        _LOADED[key] = bpe, lexicon_encoder(bpe, Lexicon(lexicon))
    return _LOADED[key]


def _encode_decode(spec, lexicon, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _loaded(spec.value, lexicon.value)
        encoder.known = {}
        for batch in batches:
            text = batch.column("text")
            for at, to, _, _ in chunks(text, CHUNK):
                ids, first = encoder.encode(text.slice(at, to - at))
                places = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                decoded = [bpe.decode(ids[a:b].tolist()) for a, b in places]
                made = {"n_tokens": pa.array(np.diff(first).astype(np.int64))}
                if "ids" in columns:
                    made["ids"] = pa.array([ids[a:b].astype("<i4") for a, b in places], pa.list_(pa.int32()))
                    made["decoded"] = pa.array(decoded, pa.string())
                if "ids_sha256" in columns:
                    made["ids_sha256"] = pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in places], pa.string())
                    made["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), *made.values()], names=["id", *made])

    return run


def encode_decode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536, digests: bool = False
) -> DataFrame:
    """Encode and decode every whole text. ``(doc_id, n_tokens, ids, decoded)``, or with ``digests``
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the ids as little-endian unsigned 32-bit integers and of the
    decoded UTF-8 text.

    ``vocabulary`` is the path of a byte-level BPE vocabulary on the driver; executors get it by broadcast (a file of
    fixed size), as they get the lexicon of the ``lexicon_words`` most frequent words of *all* rows (a few MB
    at most, whatever the input). Null and empty texts have no ids and decode to an empty text. Very long texts are held
    one at a time. Repeated rows give repeated results, null ids stay null, other columns are ignored, an empty table
    gives an empty table.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    lexicon = build_lexicon(ByteBpe(spec), frequent_words(docs, text_col, lexicon_words))
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(trimmed(_encode_decode(context.broadcast(spec), context.broadcast(lexicon), columns)), "id long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    return out.withColumnRenamed("id", id_col)
