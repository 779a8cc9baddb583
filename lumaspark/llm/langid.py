"""Language identification, word first with backoff.

A word seen in training scores by its smoothed log frequency in each language. An unseen word is scored by its
character n-grams: at every place the longest n-gram that was seen is taken, and the mean over the places counts. (A penalty for
shorter n-grams would shift all languages alike.) All words and n-grams of all training rows are kept, as tables.

A fixed number of the most frequent words and n-grams is broadcast. Frequent words are scored within the scan of the texts; only the
others leave it: each distinct one is looked up, or covered by n-grams, once, and their scores are summed by text. Likewise only the
places of unseen words without a frequent n-gram of full length are looked up in the table of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequent import most_frequent
from .scratch import Scratch
from .textkit import LetterWords, Spans, chunks, code_tables, give_back, mix, small_batches, trimmed

UNKNOWN = "und"
LONGEST = 5
#: Words, and n-grams, that are broadcast with their scores at most, and scores in all; how many there are changes no result.
BROADCAST_KEYS, BROADCAST_SCORES = 1 << 17, 1 << 22
#: Rows that go are joined by broadcast up to so many, beyond that the join shuffles; the number changes no result.
BROADCAST_ROWS = 250_000
#: Bytes of text, and code points of words, that are handled together.
CHUNK, SPELLED = 1 << 20, 100_000
#: Places to which summed log frequencies are rounded, so that the order of a sum changes no result.
PLACES = 6


def split_remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


@dataclass
class LanguageModel:
    """Log frequencies by language, in the order of ``languages``: tables ``(key, n, scores)`` of all words and of all n-grams, and
    the most frequent of each as sorted hashes with their scores."""

    languages: list[str]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    known_words: tuple[np.ndarray, np.ndarray] | None = None
    known_grams: tuple[np.ndarray, np.ndarray] | None = None


def _count_words(languages: list[str]):
    place = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for at, to, data, offsets in chunks(batch.column("text"), CHUNK):
                words = LetterWords(data, offsets)
                lang = np.repeat(code[at:to], np.diff(words.first))
                _, where, n = np.unique(mix(words.hashes() + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.strings(where), pa.string()), pa.array(lang[where]), pa.array(n)], names=["key", "lang", "n"])

    return run


def _spelled(words: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(from word, to word, all of them between ^ and $, first place of each and the end), by about SPELLED code points."""
    sizes = np.cumsum([0, *(len(w) + 2 for w in words)])
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SPELLED, side="right")) - 1)
        yield at, to, "".join([f"^{w}$" for w in words[at:to]]), sizes[at : to + 1] - sizes[at]
        at = to


def _count_grams(languages: int):
    """Counts of the n-grams of each batch's words, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [batch.column(f"c{i}").to_numpy() for i in range(languages)]
            for at, to, text, first in _spelled(batch.column("key").to_pylist()):
                spans = Spans(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), code_tables()["value"])
                word = np.repeat(np.arange(to - at), np.diff(first))
                left = first[1:][word] - np.arange(first[-1])
                start = np.concatenate([np.flatnonzero(left >= k) for k in range(1, LONGEST + 1)])
                end = start + np.repeat(np.arange(1, LONGEST + 1), [int((left >= k).sum()) for k in range(1, LONGEST + 1)])
                _, where, which = np.unique(spans.span_hash(start, end), return_index=True, return_inverse=True)
                names = [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
                own, which = word[start] + at, which.reshape(-1)
                sums = [pa.array(np.bincount(which, weights=c[own], minlength=len(where)).astype(np.int64)) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *sums], names=["key", *(f"c{i}" for i in range(languages))])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", broadcast_keys: int = BROADCAST_KEYS) -> LanguageModel:
    """Learn from every row of ``docs`` with text and language. Words are runs of letters and marks with a letter, lower-cased.

    Every word and n-gram is kept with its count in every language; two rows of sums reach the driver, and at most
    ``broadcast_keys`` words and n-grams with their scores. Rows with a null text or language teach nothing; without any row that holds
    a word there are no languages. Very long texts and words are handled whole; repeated rows count again."""
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([])
    columns = [f"c{i}" for i in range(len(languages))]
    numbers = ", ".join(f"{c} long" for c in columns)
    counted = rows.where("text is not null").mapInArrow(trimmed(_count_words(languages)), "key string, lang long, n long")
    of = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(columns)]
    words = scratch.keep(counted.groupBy("key").agg(*of), "words")
    grams = words.repartition(F.xxhash64("key")).mapInArrow(trimmed(_count_grams(len(languages))), f"key string, {numbers}")
    grams = scratch.keep(grams.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]), "grams")

    def scored(table: DataFrame) -> tuple[DataFrame, list[int]]:
        sums = table.agg(F.count("*").alias("keys"), *[F.sum(c).alias(c) for c in columns]).first()
        some = [i for i, c in enumerate(columns) if sums[c]]
        scores = [F.log(F.col(columns[i]) + 0.5) - F.log(F.lit(sums[columns[i]] + 0.5 * sums["keys"])) for i in some]
        every = sum((F.col(c) for c in columns), F.lit(0))
        return table.select("key", every.alias("n"), F.array(*scores).alias("scores") if some else F.array().cast("array<double>").alias("scores")), some

    (words, some), (grams, _) = scored(words), scored(grams)
    if not some:
        return LanguageModel([])
    most = min(broadcast_keys, BROADCAST_SCORES // len(some))
    full = (F.char_length("key") == LONGEST) | (F.startswith("key", F.lit("^")) & (F.char_length("key") > 1))
    known = [_lookup(most_frequent(table, most), len(some)) for table in (words, grams.where(full))]
    return LanguageModel([languages[i] for i in some], words, grams, *known)


def _lookup(rows: DataFrame, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of keys and the scores that go with them."""
    found = rows.select("key", "scores").toArrow()
    keys = found["key"].to_pylist()
    sizes = np.cumsum([0, *map(len, keys)])
    spans = Spans(np.frombuffer("".join(keys).encode("utf-32-le"), dtype="<u4"), code_tables()["value"])
    hashes = spans.span_hash(sizes[:-1], sizes[1:])
    order = np.argsort(hashes)
    scores = found["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, languages)[order]
    del found, keys, spans
    give_back()
    return hashes[order], scores


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted hash, and whether it is there."""
    place = np.minimum(np.searchsorted(hashes, wanted), max(0, len(hashes) - 1))
    return place, hashes[place] == wanted if len(hashes) else np.zeros(len(wanted), dtype=bool)


def _sums(owner: np.ndarray, scores: np.ndarray, owners: int) -> np.ndarray:
    """Sums of score rows by owner."""
    return np.stack([np.bincount(owner, weights=scores[:, i], minlength=owners) for i in range(scores.shape[1])], axis=1).astype(np.float64)


def _lists(sums: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.reshape(-1)))


def _known_words(known):
    """Per text: number of words, sums of the scores of broadcast words, and the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scores = known.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_lang_text"]
            for at, to, data, offsets in chunks(batch.column("_lang_text"), CHUNK):
                words = LetterWords(data, offsets)
                own = words.hashes()
                place, hit = _find(hashes, own)
                count = np.diff(words.first)
                text = np.repeat(np.arange(to - at), count)
                sums = _sums(text[hit], scores[place[hit]], to - at)
                other = np.flatnonzero(~hit)
                other = other[np.lexsort((own[other], text[other]))]
                new = np.ones(len(other), dtype=bool)
                new[1:] = (own[other][1:] != own[other][:-1]) | (text[other][1:] != text[other][:-1])
                begin = np.flatnonzero(new)
                kept, times = other[begin], np.diff(np.append(begin, len(other)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(text[kept], minlength=to - at))))
                parts = [pa.array(own[kept].view(np.int64)), pa.array(words.strings(kept), pa.string()), pa.array(times.astype(np.int64))]
                made = [
                    pa.array(row + np.arange(to - at)),
                    pa.array(count.astype(np.int64)),
                    _lists(sums),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["h", "w", "n"])),
                ]
                row += to - at
                names = [*(batch.schema.names[i] for i in rest), "_lang_row", "_lang_n", "_lang_sums", "_lang_rest"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in rest), *made], names=names)

    return run


def _cover(known):
    """Per word: number of places whose whole context (the LONGEST characters that end there, or as many as there are) is a broadcast
    n-gram, sums of their scores, and the contexts at all other places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, scores = known.value
        for batch in batches:
            for at, to, text, first in _spelled(batch.column("w").to_pylist()):
                spans = Spans(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), code_tables()["value"])
                word = np.repeat(np.arange(to - at), np.diff(first))
                place = np.arange(first[-1])
                use = place > first[word]
                word, end = word[use], place[use] + 1
                begin = np.maximum(first[word], end - LONGEST)
                found, hit = _find(hashes, spans.span_hash(begin, end))
                sums = _sums(word[hit], scores[found[hit]], to - at)
                rest = [text[a:b] for a, b in zip(begin[~hit].tolist(), end[~hit].tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum(np.bincount(word[~hit], minlength=to - at))))
                made = [pa.array(np.bincount(word[hit], minlength=to - at).astype(np.int64)), _lists(sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest, pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(at, to - at), *made], names=["h", "places", "sums", "rest"])

    return run


def _longest(contexts: DataFrame, grams: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, scores)``: for each distinct ``key`` the scores of the longest of its endings that is in ``grams``.

    Keys not found are cut by one character and made distinct again, and so on; then what was found is handed back. Both sides
    of every join going down have distinct keys, so none is hot; going up a key serves at most as many as there are characters."""
    levels, keys = [], contexts.select("key").distinct()
    while True:
        found = scratch.keep(keys.join(grams.select("key", "scores"), "key", "left"), "level")
        levels.append(found)
        missing = found.where("scores is null and char_length(key) > 1")
        if missing.isEmpty():
            break
        keys = missing.select(F.expr("substring(key, 2)").alias("key")).distinct()
    best = levels.pop()
    for found in reversed(levels):
        cut = found.where("scores is null").select("key", F.expr("substring(key, 2)").alias("short"))
        best = found.where("scores is not null").union(cut.join(best.toDF("short", "scores"), "short").select("key", "scores"))
    return best


def _summed(docs: DataFrame, model: LanguageModel, text_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written rows of ``keep`` columns with a number, the number of words and the sums of broadcast words' scores; and by number
    the sums of the other words' scores, where there are any."""
    spark, size = docs.sparkSession, len(model.languages)
    scratch = Scratch(spark)
    small_batches(spark)
    known, grams = spark.sparkContext.broadcast(model.known_words), spark.sparkContext.broadcast(model.known_grams)
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_lang_text"))
    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema += ["_lang_row long", "_lang_n long", "_lang_sums array<double>", "_lang_rest array<struct<h:long,w:string,n:long>>"]
    partial = scratch.keep(rows.mapInArrow(trimmed(_known_words(known)), ", ".join(schema)), "partial")
    rest = partial.select("_lang_row", F.inline("_lang_rest"))
    met = rest.select("h", "w").distinct()
    met = scratch.keep(met.join(model.words.select(F.col("key").alias("w"), "scores"), "w", "left").select("h", "w", "scores"), "met")
    cover = met.where("scores is null").select("h", "w").mapInArrow(trimmed(_cover(grams)), "h long, places long, sums array<double>, rest array<string>")
    cover = scratch.keep(cover, "cover")
    contexts = cover.select("h", F.explode("rest").alias("key"))
    places = contexts.join(_longest(contexts, model.grams, scratch), "key").where("scores is not null")
    places = places.groupBy("h").agg(F.count("*").alias("n"), *[F.sum(F.col("scores")[i]).alias(f"s{i}") for i in range(size)])
    unseen = cover.select("h", "places", "sums").join(places, "h", "left")
    covered = F.col("places") + F.coalesce("n", F.lit(0))
    mean = F.array(*[(F.col("sums")[i] + F.coalesce(f"s{i}", F.lit(0.0))) / F.greatest(F.lit(1), covered) for i in range(size)])
    scored = scratch.keep(met.where("scores is not null").select("h", "scores").union(unseen.select("h", mean.alias("scores"))), "scored")
    sums = rest.select("_lang_row", "h", "n").join(scored, "h").groupBy("_lang_row")
    sums = sums.agg(F.array(*[F.sum(F.col("n") * F.col("scores")[i]) for i in range(size)]).alias("_lang_more"))
    return partial.drop("_lang_rest"), sums


def _judged(partial: DataFrame, sums: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of rows and sums as ``_summed`` gives them."""
    size = len(model.languages)
    out = partial.join(sums, "_lang_row", "left")
    more = lambda i: F.coalesce(F.col("_lang_more")[i], F.lit(0.0))
    totals = F.array(*[F.round((F.col("_lang_sums")[i] + more(i)) / F.sqrt(F.greatest(F.lit(1), "_lang_n")), PLACES) for i in range(size)])
    out = out.withColumn("_lang_totals", totals).withColumn("_lang_most", F.array_max("_lang_totals"))
    some = F.col("_lang_n") > 0
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("_lang_totals", F.col("_lang_most")).cast("int"))
    odds = F.aggregate("_lang_totals", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_lang_most")))
    return out.select(*keep, F.when(some, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(some, 1 / odds).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every whole text: the language with the largest sum of its words'
    scores, and the softmax of the sums, tempered by the square root of the number of words. Ties go to the language first
    in alphabetical order.

    Null texts, texts without a letter, and every text under a model without languages give ``und`` and 0. Repeated rows
    give repeated results; very long texts are held one at a time; an empty table gives an empty table. ``keep`` names
    must differ from the two new ones; other columns are ignored, whatever their names."""
    if not model.languages:
        return docs.select(*[docs[c] for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _judged(*_summed(docs, model, text_col, keep), model, keep)


def retain(docs: DataFrame, model: LanguageModel, condition: Column, text_col: str = "text", keep: list[str] = ("doc_id",), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keep`` columns of the rows for which ``condition`` on ``lang_pred`` and ``score`` of ``identify`` is true.

    Rows are judged by number, without their other columns. Those that go are counted: up to ``broadcast_rows`` of them are broadcast,
    so whole texts are neither shuffled nor sorted; beyond that the join shuffles. Edge cases are those of ``identify``."""
    if not model.languages:
        return identify(docs, model, text_col, keep).where(condition).select(*keep)
    partial, sums = _summed(docs, model, text_col, keep)
    judged = _judged(partial.select("_lang_row", "_lang_n", "_lang_sums"), sums, model, ["_lang_row"])
    gone = Scratch(docs.sparkSession).keep(judged.where(~F.coalesce(condition, F.lit(False))).select("_lang_row"), "gone")
    return partial.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "_lang_row", "left_anti").select(*keep)
