"""Encoding of texts by pieces.

The splitting pattern of byte-level BPE starts a new token at every line end between two non-spaces, after it, and at every space that a
non-space follows. So texts fall into pieces that are encoded one by one, and a piece that occurs often is encoded once.

Plain texts, whose only white space are single spaces and line ends between other characters, are split and numbered as whole
columns; others go piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r" (?=\S)")
LINE = re.compile(r"(?<=\S)\n(?=\S)")
MEMO = 60_000
#: Texts that are not plain: two white spaces in a row, white space at an end, or any other than space and line end.
_ODD = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class PieceEncoder:
    """``encode_new`` encodes pieces, ``encode_text`` whole texts that hold a special token's string; both give ids as
    little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, special: list[str], encode_new: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], memo: int = MEMO):
        self.special, self.encode_new, self.encode_text, self.limit = special, encode_new, encode_text, memo
        self.known: dict[str, bytes] = {}

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        new = list(dict.fromkeys(p for p in pieces if p not in self.known))
        if new:
            self.known.update(zip(new, self.encode_new(new), strict=True))
        return list(map(self.known.__getitem__, pieces))

    def odd(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode_text(text)
        pieces = []
        for n, line in enumerate(LINE.split(text)):
            head, *rest = CUT.split(line)
            pieces += ["\n"] * (n > 0) + [head, *(" " + p for p in rest)]
        return b"".join(self._lookup(pieces))

    def encode_pieces(self, words: pa.Array, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words, with a space before them unless they are heads."""
        found = self._lookup([w if h else " " + w for w, h in zip(words.to_pylist(), head.tolist(), strict=True)])
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text) of plain texts."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        number = words.indices.to_numpy()
        line_end = pc.equal(words.dictionary, "\n").to_numpy(zero_copy_only=False)[number]
        head = line_end.copy()
        head[offsets[:-1]] = True
        head[1:] |= line_end[:-1]
        code = number.astype(np.int64) * 2 + head
        used = np.zeros(2 * len(words.dictionary), dtype=bool)
        used[code] = True
        codes = np.flatnonzero(used)
        place = np.cumsum(used) - 1
        flat, size = self.encode_pieces(words.dictionary.take(pa.array(codes >> 1)), (codes & 1).astype(bool))
        start = np.cumsum(size) - size
        which = place[code]
        sizes = size[which]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(start[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each and the end); nulls are empty texts."""
        texts = texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.plain(texts) if len(texts) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        ids, first = self.plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        parts, rank = [], np.cumsum(~odd) - 1
        for i, is_odd in enumerate(odd.tolist()):
            parts.append(np.frombuffer(self.odd(texts[i].as_py()), "<u4") if is_odd else ids[first[rank[i]] : first[rank[i] + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
