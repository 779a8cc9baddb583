"""Near-duplicate classes by HyperMinHash.

Every text has one register per bucket: the smallest hash of its shingles under the bucket's own hash function, kept
as a leading-zero count and mantissa bits. Bands of registers propose pairs, the collision-corrected Jaccard
estimate of all registers drops hopeless ones, and full shingle sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import Scratch
from .textkit import Words, chunks, distinct_shingles, mix, small_batches, trimmed
from .uneven import join_uneven

MANTISSA_BITS = 10
BUCKETS = 128
#: Registers of a band: together one 64-bit word.
BAND_ROWS = 4
#: Smallest 32-bit hashes kept of a text for the second comparison: whole sets up to this size.
SMALLEST = 1024
#: Ids of texts to read again (8 bytes each) up to which they are broadcast to the scan; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles of a text whose 32-bit hashes may collide with another of its own: with more than two the comparison could err, which one
#: text in 10^13 has.
SLACK = 2
#: Sides of a row where two blocks of a bucket meet; WHOLE where a bucket or block meets itself.
WHOLE, LEFT, RIGHT = 0, 1, 2

_seed = mix(np.arange(1, 2 * 1024 + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def registers(hashes: np.ndarray, first: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """``uint16[texts, buckets]`` for texts that each have at least one hash in ``hashes[first[i]:first[i+1]]``."""
    low = np.empty((buckets, len(first) - 1), dtype=np.uint64)
    for i in range(buckets):
        low[i] = np.minimum.reduceat((hashes ^ _seed[2 * i]) * (_seed[2 * i + 1] | np.uint64(1)), first[:-1])
    fraction, exponent = np.frexp(low.astype(np.float64) + 1.0)
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = ((fraction - 0.5) * 2 * (1 << MANTISSA_BITS)).astype(np.int64)
    return ((zeros << MANTISSA_BITS) | mantissa).astype(np.uint16).T.copy()


def chance_match(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of disjoint sets of sizes n and m agrees by accident: over all cells of equal
    leading zeros and mantissa, the product of both sets' probabilities that their minimum falls there."""
    n, m = np.asarray(n, dtype=np.float64)[:, None], np.asarray(m, dtype=np.float64)[:, None]
    low = 0.5 ** np.arange(1, 64)[None, :]
    width = low / (1 << MANTISSA_BITS)
    s = n + m
    return np.minimum(0.99, (width * n * m / s * (np.exp(-s * low) - np.exp(-s * 2 * low))).sum(axis=1))


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    same = (left == right).mean(axis=1)
    chance = chance_match(n, m)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _signatures(shingle: int, buckets: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                hashes, first = distinct_shingles(Words(data, offsets), shingle)
                size = np.diff(first)
                some = np.flatnonzero(size)
                prints = np.zeros((2, to - at), dtype=np.uint64)
                regs: list[bytes | None] = [None] * (to - at)
                bands: list[np.ndarray | None] = [None] * (to - at)
                if len(some):
                    starts = first[some]
                    for k in range(2):
                        prints[k, some] = np.add.reduceat(mix(hashes ^ _seed[2000 + k]), starts) + size[some].astype(np.uint64)
                    table = registers(hashes, np.append(starts, first[-1]), buckets)
                    cut = table[:, : buckets // rows * rows].astype(np.uint64).reshape(len(some), -1, rows)
                    keys = np.broadcast_to(_seed[: cut.shape[1]], cut.shape[:2]).copy()
                    for r in range(rows):
                        keys = mix(keys + cut[:, :, r] + np.uint64(1))
                    for row, i in enumerate(some):
                        regs[i], bands[i] = table[row].tobytes(), keys[row].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(to - at)),
                        batch.column("id").slice(at, to - at),
                        batch.column("copy").slice(at, to - at),
                        pa.array(size, pa.int64()),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.array(regs, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["row", "id", "copy", "n", "f1", "f2", "regs", "bands"],
                )
                number += to - at

    return run


def _likely(buckets: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(rows, buckets) for c in ("ra", "rb")]
            sizes = [batch.column(c).to_numpy() for c in ("na", "nb")]
            near = estimate(*both, *sizes) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return run


def _smallest(shingle: int):
    """The SMALLEST lowest 32-bit hashes of each text's set, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("text")):
                hashes, first = distinct_shingles(Words(data, offsets), shingle)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                kept = [np.unique(short[a:b])[:SMALLEST].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(kept, pa.binary())], names=["id", "low"])

    return run


def _close(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two texts can be linked, by their smallest hashes: up to SLACK collisions if both sets are whole, else by the share of
    common ones among the smallest of the union, 4.5 standard deviations below the threshold at least. Whole texts decide later."""
    both = np.sort(np.concatenate((x, y)))
    twice = both[1:] == both[:-1]
    if len(x) < SMALLEST and len(y) < SMALLEST:
        shared = int(np.count_nonzero(twice))
        return 100 * (shared + SLACK) >= percent * (len(both) - shared - SLACK)
    distinct = np.r_[True, ~twice]
    common = np.r_[twice, False][distinct][:SMALLEST]
    return bool(common.mean() >= percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / len(common)) ** 0.5)


class _Bucket:
    """Members of one bucket, and the likely pairs between its components."""

    def __init__(self, table: pa.Table, buckets: int):
        self.ids, self.comp, self.sizes = (table.column(c).to_numpy() for c in ("id", "comp", "n"))
        self.regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, buckets)
        self.words = self.regs.view(np.uint64)
        self.low = [np.frombuffer(b, dtype=np.uint32) for b in table.column("low").to_pylist()]
        self.side = table.column("side").to_numpy()
        self.band = table.column("band")[0].as_py()

    def first_here(self, i: int, other: np.ndarray) -> np.ndarray:
        """Of ``other`` those whose first band in common with i is this bucket's; each pair has one such bucket."""
        same = self.words[other, : self.band + 1] == self.words[i, : self.band + 1]
        return other[same.sum(axis=1) == 1]

    def pairs(self, least: float, percent: int) -> Iterator[tuple[int, int]]:
        """Members of the largest component meet only others. Of two blocks, members of one meet those of the other."""
        names, which, count = np.unique(self.comp, return_inverse=True, return_counts=True)
        main = count.argmax()
        blocks = self.side.any()
        for i in np.flatnonzero(self.side == LEFT if blocks else which != main):
            other = np.flatnonzero((self.side == RIGHT) & (which != which[i]) if blocks else (which == main) | (which > which[i]))
            other = other[100 * np.minimum(self.sizes[i], self.sizes[other]) >= percent * np.maximum(self.sizes[i], self.sizes[other])]
            other = self.first_here(i, other)
            other = other[(self.regs[other] == self.regs[i]).mean(axis=1) >= least]
            if len(other):
                near = estimate(self.regs[other], self.regs[i][None], self.sizes[other], np.full(len(other), self.sizes[i])) >= least
                for j in other[near]:
                    if _close(self.low[i], self.low[j], percent):
                        yield int(min(self.ids[i], self.ids[j])), int(max(self.ids[i], self.ids[j]))


def _cross(buckets: int, least: float, percent: int):
    """Over rows sorted by ``key``: pairs across components within each key. A key's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = rest.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            yield from done(rest.slice(0, last))
            rest = rest.slice(last)
        if rest is not None:
            yield from done(rest)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        key = table.column("key").to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = list(_Bucket(table.slice(a, b - a), buckets).pairs(least, percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _block_pairs(large: DataFrame, block: int) -> DataFrame:
    """``(key, band, id, comp, side)``: the members of each bucket once for every two blocks that meet, under a key of these two.

    Blocks hold about ``block`` members, either of the bucket's largest component or outside it; the former do not meet
    each other."""
    counts = large.groupBy("key", "comp").agg(F.count("*").alias("n"))
    shape = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    shape = shape.select("key", "main", F.ceil((F.col("all") - F.col("most")) / block).alias("rest"), F.ceil(F.col("most") / block).alias("same"))
    outside, dealt = F.col("comp") != F.col("main"), F.xxhash64("id")
    own = F.when(outside, F.pmod(dealt, "rest")).otherwise(F.col("rest") + F.pmod(dealt, "same"))
    others = F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("rest") + F.col("same") - 1).otherwise(F.col("rest") - 1))
    rows = large.join(shape, "key").select("key", "band", "id", "comp", own.alias("own"), F.explode(others).alias("other"))
    side = F.when(F.col("own") == F.col("other"), WHOLE).when(F.col("own") < F.col("other"), LEFT).otherwise(RIGHT)
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "band", "id", "comp", side.alias("side"))


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = batch.column("tb")
            for at, to, data, offsets in chunks(batch.column("ta"), 1 << 20):
                one, one_at = distinct_shingles(Words(data, offsets), shingle)
                linked = []
                for sub_at, sub_to, data2, offsets2 in chunks(right.slice(at, to - at)):
                    two, two_at = distinct_shingles(Words(data2, offsets2), shingle)
                    for i in range(sub_at, sub_to):
                        x, y = one[one_at[i] : one_at[i + 1]], two[two_at[i - sub_at] : two_at[i - sub_at + 1]]
                        both = np.sort(np.concatenate((x, y)))
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        linked.append(shared > 0 and 100 * shared >= percent * (len(both) - shared))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 75,
    buckets: int = BUCKETS,
    group_limit: int = 4096,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of distinct ``shingle``-word
    shingles (words as in textkit, A-Z lower-cased; fewer words: the whole sequence is one shingle). ``component_id`` is
    the smallest id reachable over links; ``kept`` marks that document. With the defaults a pair at the threshold shares
    no band with probability 6e-6; the estimate drops pairs 4.5 standard deviations below it (3e-6); links are always
    confirmed on whole sets.

    How groups of any size stay cheap: documents with equal sets collapse to one representative by set fingerprint.
    In every band bucket each member is first compared with the bucket's smallest id only (a star, linear in
    the members) and components are formed. What is left to compare are members of *different* components in one
    bucket. Buckets of up to ``group_limit`` members are compared in one task: a pair counts in the bucket of its first
    common band only, members of the bucket's largest component meet only others, and pairs must be close by all their
    registers and then by their smallest hashes, which are whole sets for most texts. Larger buckets are dealt by their
    ids' hashes to blocks of about half ``group_limit`` members, and every two blocks that can hold members of different
    components meet in a task of their own, so the same pairs are compared whatever the limit; the work in such
    a bucket grows with the product of its members and those outside its largest component. Nothing is capped or
    dropped.

    Null and empty texts and texts of white space have no shingles, 0 as n_shingles, and form components of their own.
    A null id gives a null component and ``kept`` true. Repeated ids: each row is handled by its own text under a number of its
    own, and gets the smallest id of its component; repeated rows are copies. Very long texts are read whole, a few at a
    time. Further columns of ``docs``, whatever their names, are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    schema = "row long, id long, copy long, n long, f1 long, f2 long, regs binary, bands array<long>"
    sig = scratch.keep(texts.mapInArrow(trimmed(_signatures(shingle, buckets, BAND_ROWS)), schema), "signatures")
    some = sig.where("n > 0 and id is not null")
    classes = some.groupBy("f1", "f2", "n").agg(F.min("row").alias("rep"), F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    owners = sig.select("row", "id", "copy", "regs", "bands").join(classes.select(F.col("rep").alias("row"), "n"), "row")
    owners = scratch.keep(owners, "representatives")
    reps = owners.select(F.col("row").alias("id"), "n", "regs", "bands")
    least = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / buckets) ** 0.5

    def texts_of(rows: DataFrame) -> DataFrame:
        """``(id, text)`` of representatives by number; rows that repeat an id and text are read once."""
        wanted = rows.distinct().join(owners.select("row", F.col("id").alias("_id"), "copy"), F.col("id") == F.col("row")).select("row", F.col("_id").alias("id"), "copy")
        wanted = scratch.keep(wanted, "wanted")
        found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["id", "copy"])
        return found.select(F.col("row").alias("id"), "text").dropDuplicates(["id"])

    def confirmed(likely: DataFrame, name: str) -> DataFrame:
        found = texts_of(likely.select(F.col("a").alias("id")).union(likely.select("b")))
        full = likely.join(found.toDF("a", "ta"), "a").join(found.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return scratch.keep(full.mapInArrow(trimmed(_confirm(shingle, percent)), "a long, b long"), f"{name}-links")

    regs = reps.select("id", "n", "regs")
    bands = reps.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = scratch.keep(bands.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.keep(bands.join(crowded, "key").select("key", "band", "id", "center", "size"), "members")
    star = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    star = scratch.keep(star.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(trimmed(_likely(buckets, least)), "a long, b long"), "star-likely")
    links = confirmed(star, "star")
    labels = connected_components(links, scratch)

    named = members.select("key", "band", "id", "size").join(labels, "id", "left").select("key", "band", "id", "size", F.coalesce("comp", "id").alias("comp"))
    named = scratch.keep(named, "named")
    mixed = scratch.keep(named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"), "mixed")
    open_ = scratch.keep(named.join(mixed, "key"), "open")
    scratch.drop(named, mixed)
    met = open_.where(F.col("size") <= group_limit).select("key", "band", "id", "comp", F.lit(WHOLE).alias("side"))
    large = open_.where(F.col("size") > group_limit)
    if not large.isEmpty():
        met = met.union(_block_pairs(large, max(1, group_limit // 2)))
    low = texts_of(open_.select("id")).mapInArrow(trimmed(_smallest(shingle)), "id long, low binary")
    met = met.join(regs, "id").join(low, "id").select("key", "band", "id", "comp", "side", "n", "regs", "low")
    pairs = met.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_cross(buckets, least, percent)), "a long, b long")
    crossed = confirmed(scratch.keep(pairs.distinct(), "cross-likely"), "cross")
    if not crossed.isEmpty():
        labels = connected_components(links.union(crossed), scratch)
    merged = classes.join(labels.toDF("rep", "comp"), "rep", "left").select("f1", "f2", "low", "copies", F.coalesce("comp", "rep").alias("comp"))
    merged = scratch.keep(merged, "merged")
    lowest = merged.groupBy("comp").agg(F.min("low").alias("lowest"), F.count("*").alias("weight")).where("weight > 1")
    merged = join_uneven(merged, lowest, ["comp"], "lowest", F.xxhash64("f1", "f2"))
    merged = merged.select("f1", "f2", "copies", F.coalesce("lowest", "low").alias("component"), (F.col("lowest") != F.col("low")).alias("moved"))
    shared = scratch.keep(merged.where("copies > 1 or moved").select("f1", "f2", "component", F.col("copies").alias("weight")), "shared")
    out = join_uneven(sig.select("row", "id", "n", F.when(F.col("n") > 0, F.col("f1")).otherwise(F.col("row")).alias("f1"), "f2"), shared, ["f1", "f2"], "component", F.col("row"))
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
