"""Benchmark decontamination by templates, with built-in functions only.

Texts are reduced to templates: names, numbers and the units after numbers become typed placeholders, everything but
letters and digits is dropped, case is folded. Windows of template words are hashed and joined with those of the
benchmark; a re-parameterised question has the same windows as the original. For windows with placeholders the values
behind them must then correspond: one value of the item to one value of the document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

NAME, NUMBER, UNIT = "\u0002", "\u0003", "\u0004"
#: Stands before a capitalised word that may be a name or the start of a sentence; the rest of its run, if it is a name.
START, REST = "\u0005", "\u0006"

# Units of measure that are replaced after a number.
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|yd|l|ml|s|sec|seconds|min|minutes|h|hr|hours|days|weeks|months|years|mph|kmh|hz|khz|mhz|ghz|"
    "w|kw|v|a|j|kj|n|pa|k|c|f|percent|degrees|dollars|euros|cents|pounds|meters|metres|miles|grams|liters|litres"
)
# Possessive throughout: a repeated group that could give back would take a stack frame for each name or number of a run.
_NAME_RUN = r"(\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+)"
_NAMES = rf" (?<=[\p{{L}}\p{{N}}],? ){_NAME_RUN}"
_DIGITS = r"\p{N}++(?:[.,:/-]\p{N}++)*+"
#: Only from a run's start: a run without a unit behind it has none from any later place either.
_MEASURES = rf"(?<!\p{{N}})(?<!\p{{N}}[.,:/-])({_DIGITS}) ?({UNITS})\b"
_STARTS = rf"(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}}++)"
_DROP = rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}{START}{REST}]++"

#: Benchmark windows (8 bytes of hash, two numbers) and their placeholder values up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 250_000


def _named(text: Column) -> Column:
    return F.regexp_replace(text, _NAMES, f" {NAME}")


def templates(rows: DataFrame, text: str = "text", marked: str = "marked") -> DataFrame:
    """``rows`` with the template of a text as an array of words; empty for null and for texts without letters and digits.
    START stands before capitalised words that are no placeholders, REST for a name's rest behind such a word.

    Every step is a column of its own, so none is computed twice."""
    numbers = F.when(F.col("_t").rlike(r"\p{N}"), F.regexp_replace(F.regexp_replace("_t", _MEASURES, f" {NUMBER} {UNIT} "), _DIGITS, f" {NUMBER} ")).otherwise(F.col("_t"))
    spread = F.when(F.col("_t").contains(NAME), F.replace("_t", F.lit(NAME), F.lit(f" {NAME} "))).otherwise(F.col("_t"))
    out = rows.withColumn("_t", _named(F.col(text)))
    out = out.withColumn("_t", F.regexp_replace("_t", _STARTS, f"{START}$1"))
    out = out.withColumn("_t", numbers).withColumn("_t", spread)
    out = out.withColumn("_t", F.trim(F.lower(F.regexp_replace("_t", _DROP, " "))))
    out = out.withColumn("_t", F.when(F.col("_t").contains(START) & F.col("_t").contains(NAME), F.regexp_replace("_t", f"({START}[^ ]++) {NAME}", f"$1 {REST}")).otherwise(F.col("_t")))
    none = F.array().cast("array<string>")
    return out.withColumn(marked, F.when(F.coalesce(F.col("_t"), F.lit("")) == "", none).otherwise(F.split("_t", " "))).drop("_t")


def _as_written(x: Column) -> Column:
    """A marked word where capitalised words with START are words as others."""
    return F.when(x == REST, F.lit(NAME)).otherwise(F.ltrim(x, F.lit(START)))


def _as_name(x: Column) -> Column:
    """The same where they are names; then REST goes."""
    return F.when(x.startswith(START), F.lit(NAME)).otherwise(x)


def values(text: Column) -> Column:
    """The values behind placeholders, in order, by type: struct of arrays ``names, numbers, units``."""
    named = _named(text)
    return F.struct(
        F.regexp_extract_all(text, F.lit(_NAMES), F.lit(1)).alias("names"),
        F.regexp_extract_all(named, F.lit(f"({_DIGITS})"), F.lit(1)).alias("numbers"),
        F.regexp_extract_all(named, F.lit(_MEASURES), F.lit(2)).alias("units"),
    )


def _plain(text: str) -> Column:
    """Words of a text as written, without placeholders, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def _hash(words: Column) -> Column:
    """Hash of an array of words: that of the words' own hashes in order."""
    return F.xxhash64(F.transform(words, lambda x: F.xxhash64(x)))


def _windows(hashes: Column, size: int, starts: Column | None = None, tag: int | None = None) -> Column:
    """(size, doc_place, hash, own) of each window of ``size`` words, given the hash of each word; with ``starts`` only those over a
    word that is marked there. ``own``: places count the template's own words.

    Words are taken by index, so a text of n words takes n steps. Windows of mostly placeholders need no check here: the
    benchmark's side has none."""
    last = F.size(hashes) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if starts is not None:
        places = F.filter(places, lambda i: reduce(or_, [F.get(starts, i + k) for k in range(size)]))

    def window(i: Column) -> Column:
        whole = F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
        return F.struct(F.lit(size if tag is None else tag).alias("size"), (i + 1).alias("doc_place"), whole.alias("hash"), F.lit(starts is None and tag is None).alias("own"))

    return F.transform(places, window)


def _slots(words: Column, found: Column) -> Column:
    """(place, value) of every placeholder of a text, the value with its type before it; places count from 1."""

    def of_kind(mark: str, kind: str) -> Column:
        size = F.size(words)
        places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        own = F.filter(places, lambda i: F.element_at(words, i) == mark)
        return F.transform(own, lambda i, k: F.struct(i.alias("place"), F.concat(F.lit(mark), F.coalesce(F.get(found[kind], k), F.lit(""))).alias("value")))

    return F.concat(of_kind(NAME, "names"), of_kind(NUMBER, "numbers"), of_kind(UNIT, "units"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 6,
    least: float = 0.5,
    consistent: float = 0.5,
    least_words: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, n_slots, n_consistent)`` for each document that holds a benchmark item.

    An item is held if at least the share ``least`` of its distinct windows of ``window`` template words occur in the
    document (items with fewer words are one window), and the placeholders in matched windows correspond:
    taking for each item value the document value that it meets most often, those meetings make at least the share
    ``consistent`` of all (half, as a document may hold an item twice with different values). ``n_matched`` counts
    distinct item windows; ``n_slots`` and ``n_consistent`` count meetings, 0 where there are no placeholders.

    An item's first word counts as written and also as a name, as it may follow other words in a document. So do
    capitalised words at the start of sentences, lines, quotes and brackets, on both sides: a window matches as written
    or with all of them as names; such names are not compared as placeholders. Windows of mostly placeholders do not
    count; an item that has no others is looked for as written, by windows of its own words. Items of fewer than
    ``least_words`` words are no evidence and match nothing, nor do null, empty and word-free texts and items. Very long
    texts, runs of names or numbers and lines without an end are handled whole, in steps that grow with their length.
    Null ids are not reported; rows that share an id count as one document or item, repeated rows change nothing; ties for
    a value's most frequent meeting count the same; other columns are ignored, whatever their names; an empty table
    on either side gives an empty table.

    Only hashes that occur in the benchmark leave a task. The benchmark's windows are counted with their placeholder values
    first and broadcast only up to BROADCAST_ROWS, beyond that the join shuffles. Placeholders are compared in a second pass
    over the matched documents, place by place, which is planned only if the benchmark has any.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marks = NAME + NUMBER + UNIT + START + REST

    def given(table: DataFrame, key: str, column: str, name: str) -> DataFrame:
        plain = F.translate(table[column].cast("string"), marks, " " * len(marks))
        return table.select(table[key].cast("long").alias(name), plain.alias("text")).where(F.col(name).isNotNull())

    text = given(docs, id_col, text_col, "doc_id").withColumn("copy", F.xxhash64("text"))
    items = given(benchmark, item_col, item_text_col, "item_id")
    none = F.lit(None).cast("array<struct<at:int,value:string>>").alias("slots")
    words = templates(items).withColumn("words", F.transform("marked", _as_written)).select("item_id", "text", "words", "marked", values(F.col("text")).alias("found"))
    words = words.where(F.size("words") >= max(1, least_words)).withColumn("size", F.least(F.size("words"), F.lit(window)))
    own = words.withColumn("every", _slots(F.col("words"), F.col("found")))
    own = own.select("item_id", "words", "every", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("place"))
    cut = F.expr("slice(words, place, size)")
    solid = F.size(F.filter(cut, lambda x: ~x.isin(NAME, NUMBER, UNIT))) * 2 >= F.col("size")
    inside = F.filter("every", lambda s: (s["place"] >= F.col("place")) & (s["place"] < F.col("place") + F.col("size")))
    slots = F.transform(inside, lambda s: F.struct((s["place"] - F.col("place")).alias("at"), s["value"].alias("value")))
    own = own.where(solid).select("item_id", "size", "place", _hash(cut).alias("hash"), slots.alias("slots"), cut.alias("cut"))
    as_name = F.concat(F.array(F.lit(NAME)), F.expr("slice(cut, 2, size)"))
    first = own.where("place = 1 and size > 1 and element_at(cut, 1) <> '" + NAME + "'").select("item_id", "size", "place", _hash(as_name).alias("hash"), none)
    literal = words.join(own.select("item_id").distinct(), "item_id", "left_anti").select("item_id", _plain("text").alias("plain"))
    literal = literal.where(F.size("plain") >= max(1, least_words)).withColumn("size", F.least(F.size("plain"), F.lit(window)))
    literal = literal.select("item_id", "plain", "size", F.explode(F.sequence(F.lit(1), F.size("plain") - F.col("size") + 1)).alias("place"))
    literal = literal.select("item_id", (-F.col("size")).alias("size"), "place", _hash(F.expr("slice(plain, place, size)")).alias("hash"), none)
    literal = scratch.keep(literal, "literal-windows")
    named = words.join(literal.select("item_id").distinct(), "item_id", "left_anti").where(F.exists("marked", lambda x: x.startswith(START)))
    places = F.filter(F.transform("marked", lambda x, i: F.when(x != REST, i + 1)), lambda i: i.isNotNull())
    named = named.select("item_id", places.alias("kept"), F.filter("marked", lambda x: x != REST).alias("marked"))
    named = named.withColumn("named", F.transform("marked", _as_name)).withColumn("size", F.least(F.size("named"), F.lit(window)))
    named = named.select("*", F.explode(F.sequence(F.lit(1), F.size("named") - F.col("size") + 1)).alias("at"))
    named = named.where(F.exists(F.expr("slice(marked, at, size)"), lambda x: x.startswith(START))).select("item_id", "size", F.get("kept", F.col("at") - 1).alias("place"), F.expr("slice(named, at, size)").alias("cut"))
    named = named.where(solid).select("item_id", "size", "place", _hash(F.col("cut")).alias("hash"), none)
    items_kept = scratch.keep(own.drop("cut").unionByName(first).unionByName(named).unionByName(literal).dropDuplicates(["item_id", "size", "place", "hash"]), "item-windows")
    weight = F.sum(1 + F.greatest(F.lit(0), F.coalesce(F.size("slots"), F.lit(0))))
    shape = items_kept.agg(weight.alias("weight"), F.collect_set("size").alias("sizes"), F.max(F.coalesce(F.size("slots"), F.lit(0))).alias("slots")).first()
    totals = own.select("item_id", "hash").union(literal.select("item_id", "hash")).groupBy("item_id").agg(F.countDistinct("hash").alias("n_windows"))

    sizes = sorted(shape["sizes"] or [window])
    exact = [-size for size in sizes if size < 0]
    canon = templates(text).withColumns({"plain": _plain("text")} if exact else {})
    kept = F.when(F.exists("marked", lambda x: x == REST), F.filter("marked", lambda x: x != REST)).otherwise(F.col("marked"))
    canon = canon.withColumn("named", kept)
    hashed = {"words": F.transform("marked", lambda x: F.xxhash64(_as_written(x))), "names": F.transform("named", lambda x: F.xxhash64(_as_name(x)))}
    hashed["over"] = F.transform("named", lambda x: x.startswith(START))
    if exact:
        hashed["plain"] = F.transform("plain", lambda x: F.xxhash64(x))
    canon = canon.select("doc_id", "copy", *[c.alias(n) for n, c in hashed.items()])
    places = [_windows(F.col("plain"), size, tag=-size) for size in exact]
    places += [w for size in sizes if size > 0 for w in (_windows(F.col("words"), size), _windows(F.col("names"), size, F.col("over")))]
    spread = canon.select("doc_id", "copy", F.explode(F.concat(*places)).alias("w")).select("doc_id", "copy", "w.*")
    few = (shape["weight"] or 0) <= BROADCAST_ROWS
    hits = spread.join(F.broadcast(items_kept) if few else items_kept, ["size", "hash"]).select("doc_id", "copy", "doc_place", "own", "item_id", "place", "slots")
    hits = scratch.keep(hits, "hits")
    matched = hits.join(totals, "item_id")
    found = matched.groupBy("doc_id", "item_id", "n_windows").agg(F.countDistinct("place").alias("n_matched")).where(F.col("n_matched") >= least * F.col("n_windows"))
    if (shape["slots"] or 0) <= 0:
        return found.select("doc_id", "item_id", "n_windows", "n_matched", F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_consistent"))
    pairs = scratch.keep(found, "pairs")
    wanted = hits.where(F.col("own") & (F.size("slots") > 0)).join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"])
    wanted = wanted.dropDuplicates(["doc_id", "copy", "doc_place", "item_id", "place"])
    wanted = wanted.select("doc_id", "copy", "item_id", "doc_place", F.explode("slots").alias("s")).select("doc_id", "copy", "item_id", (F.col("doc_place") + F.col("s.at")).alias("place"), F.col("s.value").alias("item"))
    again = text.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "copy"])
    again = templates(again).withColumn("words", F.transform("marked", _as_written)).withColumn("found", values(F.col("text")))
    again = again.select("doc_id", "copy", F.explode(_slots(F.col("words"), F.col("found"))).alias("s")).select("doc_id", "copy", "s.place", F.col("s.value").alias("doc"))
    met = wanted.join(again, ["doc_id", "copy", "place"])
    counts = met.groupBy("doc_id", "item_id", "item", "doc").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id", "item_id", "item").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    compared = best.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_slots"), F.sum("most").alias("n_consistent"))
    out = pairs.join(compared, ["doc_id", "item_id"], "left").na.fill(0, ["n_slots", "n_consistent"])
    return out.where(F.col("n_consistent") >= consistent * F.col("n_slots")).select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_consistent")
