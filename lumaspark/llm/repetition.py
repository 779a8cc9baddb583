"""Repetition inside texts, by suffix arrays over words.

All suffixes of a text are sorted by prefix doubling. The longest common prefix of neighbours in that order tells, for
every place, the longest substring that starts there and occurs again; those of at least a given length are
the longest-common-prefix intervals' maximal repeats, and the union of their spans is the repeated part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import Words, chunks, trimmed

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SPACES = " \t\n\x0b\x0c\r"


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word place the length of the longest substring that starts there and also elsewhere in the same text.

    ``words`` are word numbers, ``first[i]:first[i+1]`` the places of text i. Ranks of places whose prefix is already
    unique are not sorted again, so ordinary prose takes three or four short rounds and only repeated passages go on."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][text]
    _, inverse = np.unique(words, return_inverse=True)
    key = text * (int(inverse.max()) + 1) + inverse.reshape(-1)
    order = np.argsort(key, kind="stable")
    rank, tied = _ranks(order, key[order], np.arange(n))
    levels, length = [rank], 1
    while len(tied):
        ahead = tied + length
        inside = ahead < stop[tied]
        second = np.zeros(len(tied), dtype=np.int64)
        second[inside] = rank[ahead[inside]] + 1
        pair = rank[tied] * (n + 1) + second
        sub = np.argsort(pair, kind="stable")
        ordered = tied[sub]
        base = rank[ordered]
        group = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        inner = np.arange(len(ordered)) - np.repeat(group, np.diff(np.r_[group, len(ordered)]))
        new = rank.copy()
        values, tied = _ranks(ordered, pair[sub], base + inner, out=new)
        rank = values
        levels.append(rank)
        length *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        ok = (a < stop[left]) & (b < stop[right]) & (text[left] == text[right])
        same = np.zeros(n - 1, dtype=bool)
        same[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        common += np.where(same, 1 << level, 0)
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _ranks(places: np.ndarray, keys: np.ndarray, slots: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gives ``places``, ordered by ``keys``, the slot of the first place of equal key; also the places that are tied."""
    start = np.r_[True, keys[1:] != keys[:-1]]
    head = np.flatnonzero(start)
    size = np.diff(np.r_[head, len(keys)])
    rank = np.empty(len(places), dtype=np.int64) if out is None else out
    rank[places] = np.repeat(slots[head], size)
    return rank, places[np.repeat(size > 1, size)]


def covered(length: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Words of each text that lie in the union of the repeats of at least ``least`` words."""
    n = len(length)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(length >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return inside[first[1:]] - inside[first[:-1]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _duplicate_lines(text: str | None) -> int:
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(_SPACES):
            if line in seen:
                again += 1
            seen.add(line)
    return again


def _measure(least: int, max_covered: float, max_longest: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for at, to, data, offsets in chunks(text):
                words = Words(data, offsets, lower=False)
                first = words.first
                count = np.diff(first)
                length = longest_repeats(words.hashes(), first)
                repeat = covered(length, first, 5)
                cover = covered(length, first, least)
                longest = np.zeros(len(count), dtype=np.int64)
                some = np.flatnonzero(count)
                if len(some):
                    longest[some] = np.maximum.reduceat(length, first[some])
                failed = (count < min_words) | (100 * repeat > 20 * count)
                kept = ~failed & (cover <= max_covered * count) & (longest <= max_longest)
                made = {
                    "n_words": count,
                    "word_chars": _per_text(_WORD[data] & _LEAD[data], offsets),
                    "n_symbols": _per_text(_SYMBOL[data], offsets),
                    "n_dup_lines": np.array([_duplicate_lines(t) for t in text.slice(at, to - at).to_pylist()], dtype=np.int64),
                    "n_repeat_words": repeat,
                    "base_failed": failed,
                    "kept": kept,
                    "covered_words": cover,
                    "longest_repeat": longest,
                }
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), *map(pa.array, made.values())], names=["id", *made])

    return run


def repetition_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8, max_covered: float = 0.2, max_longest: int = 50, min_words: int = 10
) -> DataFrame:
    """Counts of every whole text and the verdict ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over a fifth of the words in 5-word windows that occur twice.
    ``kept``: the base holds, repeats of ``least`` words or more cover at most ``max_covered`` of the words
    (``covered_words``), and no repeat has more than ``max_longest`` words (``longest_repeat``).

    Null and empty texts have no words and fail. Words are compared by 64-bit hashes, case counts. Each text is handled
    alone, without a shuffle, a very long one in a chunk of its own. Null ids stay null, repeated rows give repeated
    results, other columns are ignored, an empty table gives an empty table."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    schema = (
        "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
        "covered_words long, longest_repeat long"
    )
    return rows.mapInArrow(trimmed(_measure(least, max_covered, max_longest, min_words)), schema).withColumnRenamed("id", id_col)
