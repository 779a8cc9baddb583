"""Token ids as Parquet files that allow selective reads.

Files hold documents in ascending id order, one row each: ``doc_id``, ``n_tokens``, the place of its first token within
the file's part, the part's number and the ids as a list column. Ids are dictionary-encoded, the numbers beside them
delta-encoded, row groups and pages are small, and every column has a page index, so a filter on ``doc_id`` reads
few pages and a query of the numbers reads no ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TAIL, byte_alphabet
from .pieces import PieceEncoder
from .scratch import Scratch
from .textkit import chunks, small_batches, trimmed

SCHEMA = "doc_id long, n_tokens long, part long, part_start long, tokens array<int>"

#: Bytes of text that are encoded together.
CHUNK = 4 << 20
#: Words and runs of marks whose ids a worker process remembers, and the most bytes of one; when there are more, the half most used stays.
MEMO, MEMO_BYTES = 500_000, 40
#: Writer settings: version 2 pages give delta encoding where no dictionary is used.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#part_start": "false",
}


#: Letters that every version of Unicode counts as such, and a word of them with or without marks at its end. Such a word is one
#: match of the splitting pattern, and so are the marks.
_LETTER = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2b8}\x{400}-\x{481}\x{48a}-\x{52f}]"
_CORE = rf"^ ?{_LETTER}+"
_SIMPLE = rf"^ ?{_LETTER}+[{re.escape(TAIL)}]*$"


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


class LibraryEncoder(PieceEncoder):
    """Encodes with the public tokenizers library, without its own threads.

    Each distinct word of letters in a chunk goes to the library's BPE model once, in the vocabulary's alphabet, without the marks
    at its end; so does each distinct run of marks. Those that chunks before had are remembered as columns of strings and ids.
    Everything else goes through the library's whole pipeline."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        super().__init__(special, self._whole, lambda text: self._whole([text])[0])
        alphabet = {byte: char for char, byte in byte_alphabet().items()}
        self.alphabet = np.array([ord(alphabet[b]) for b in range(256)], dtype="<u4")
        self.model = self.whole.model
        self.met, self.met_ids = pa.array([], pa.large_string()), np.zeros(0, dtype="<u4")
        self.met_sizes, self.met_uses = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _matches(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of strings that are one match each and hold no line end."""
        raw = np.frombuffer("\n".join(matches.to_pylist()).encode(), dtype=np.uint8)
        text = np.where(raw == 10, np.uint32(10), self.alphabet[raw]).astype("<u4").tobytes().decode("utf-32-le")
        tokenize, ids, sizes = self.model.tokenize, [], []
        for match in text.split("\n"):
            found = [t.id for t in tokenize(match)] if match else []
            ids += found
            sizes.append(len(found))
        return np.array(ids, dtype="<u4"), np.array(sizes, dtype=np.int64)

    def _remember(self, matches: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(matches), MEMO_BYTES).to_numpy(zero_copy_only=False)
        self.met = pa.concat_arrays([self.met, matches.filter(pa.array(short))])
        self.met_ids = np.concatenate((self.met_ids, ids[np.repeat(short, sizes)]))
        self.met_sizes = np.concatenate((self.met_sizes, sizes[short]))
        self.met_uses = np.concatenate((self.met_uses, np.zeros(short.sum(), dtype=np.int64)))
        if len(self.met) > MEMO:
            stays = np.zeros(len(self.met), dtype=bool)
            stays[np.argsort(self.met_uses, kind="stable")[-(MEMO // 2) :]] = True
            self.met, self.met_ids = self.met.filter(pa.array(stays)), self.met_ids[np.repeat(stays, self.met_sizes)]
            self.met_sizes, self.met_uses = self.met_sizes[stays], self.met_uses[stays] // 2

    def _lists(self, matches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each, number of ids of each) of distinct matches; only those not remembered go to the model."""
        found = pc.index_in(self.met, value_set=matches).fill_null(-1).to_numpy()  # this way round the hash table is the small one
        place = np.full(len(matches), -1, dtype=np.int64)
        at = np.flatnonzero(found >= 0)
        place[found[at]] = at
        new = place < 0
        old = place[~new]
        self.met_uses[old] += 1
        start, size = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
        start[~new], size[~new] = (np.cumsum(self.met_sizes) - self.met_sizes)[old], self.met_sizes[old]
        pool = self.met_ids
        if new.any():
            unseen = matches.filter(pa.array(new))
            ids, sizes = self._matches(unseen)
            start[new], size[new] = np.cumsum(sizes) - sizes + len(pool), sizes
            pool = np.concatenate((pool, ids))
            self._remember(unseen, ids, sizes)
        return pool, start, size

    def _simple(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cores = pc.utf8_rtrim(pieces, characters=TAIL).dictionary_encode()
        tails = pc.replace_substring_regex(pieces, _CORE, "").dictionary_encode()
        pool, start, size = self._lists(pa.concat_arrays([cores.dictionary, tails.dictionary]))
        which = np.stack((cores.indices.to_numpy(), tails.indices.to_numpy() + len(cores.dictionary)), axis=1)
        start, size = start[which].reshape(-1), size[which]
        flat = size.reshape(-1)
        ends = np.cumsum(flat)
        return pool[np.repeat(start - (ends - flat), flat) + np.arange(ends[-1])], size.sum(axis=1)

    def encode_pieces(self, words: pa.Array, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.if_else(pa.array(head), words, pc.binary_join_element_wise(_text(""), words, _text(" ")))
        simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
        if simple.all() and len(simple):
            return self._simple(pieces)
        size = np.zeros(len(simple), dtype=np.int64)
        rest = [np.frombuffer(b, "<u4") for b in self._whole(pieces.filter(pa.array(~simple)).to_pylist())]
        size[~simple] = [len(r) for r in rest]
        ids = np.zeros(0, "<u4")
        if simple.any():
            ids, size[simple] = self._simple(pieces.filter(pa.array(simple)))
        flat = np.empty(size.sum(), dtype="<u4")
        of_simple = np.repeat(simple, size)
        flat[of_simple] = ids
        flat[~of_simple] = np.concatenate([np.zeros(0, "<u4"), *rest])
        return flat, size


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(spec: str) -> LibraryEncoder:
    """One encoder a worker process, for the last vocabulary asked for."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = LibraryEncoder(spec)
    return _ENCODERS[spec]


def _encode(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(spec.value)
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column("text")
            for at, to, _, _ in chunks(text, CHUNK):
                ids, first = encoder.encode(text.slice(at, to - at))
                sizes = np.diff(first) + 1
                ends = np.concatenate(([0], np.cumsum(sizes)))
                whole = np.full(ends[-1], end_id, dtype="<i4")
                own = np.ones(ends[-1], dtype=bool)
                own[ends[1:] - 1] = False
                whole[own] = ids
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(sizes), pa.array(np.full(to - at, part)), pa.array(total + ends[:-1]), tokens],
                    names=["doc_id", "n_tokens", "part", "part_start", "tokens"],
                )
                total += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every whole text, append ``end_id``, and write files in ascending id order (null ids first).

    Null and empty texts have the end id only. Rows that share an id stand together, in the order of their texts. Other columns are ignored. An
    empty table gives files without rows. Rows are dealt by ranges of the id, so no task gets more than its share
    unless one id has very many rows.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(trimmed(_encode(spec, end_id)), SCHEMA).write.options(**LAYOUT).parquet(path)


def _with_starts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``start``: what stands before a row's part, from one row per part, and its place in the part. The table of parts has
    as many rows as there are files, so it is broadcast (16 bytes a file) and no ids are shuffled."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("part_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before. Starts of parts are summed from the
    number columns alone."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return _with_starts(rows, totals).select("doc_id", "start", "n_tokens", "tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, values = tokens.offsets.to_numpy(), memoryview(tokens.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        made = [pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "part_start")), *made], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what the files hold: counts and sums are taken from the ids read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    read = rows.select("doc_id", "part", "part_start", "tokens").mapInArrow(trimmed(_digest), "doc_id long, part long, part_start long, n_tokens long, ids_crc32 long")
    return _with_starts(read, totals).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to the shared folder and return the digests of the files."""
    spark = docs.sparkSession
    path = Scratch(spark).path("tokens")
    write_token_files(docs, path, vocabulary)
    return token_file_digests(spark, path)
