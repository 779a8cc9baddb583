"""The corpus pipeline: toxicity, language, near-duplicates, benchmark passages, token ids.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. As a stage's result has been
written when the next is called, each stage first deletes the tables that the one before made on its way.

In every stage other columns are ignored, an empty table gives an empty one, and very long texts are taken whole. Null and empty texts
pass toxicity by the model's intercept alone, hold no language and so go in the second stage. Repeated rows get the same decision, but
one of them stays in the third stage; of a group's rows that tie for the smallest id the first written stays. Null ids are kept as
such; they teach nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.llm import bpe, decontam, langid, minhash, queries, scratch, toxicity
from lumaspark.llm.scratch import Scratch

#: Least score of a predicted language.
LANGUAGE_SCORE = 0.5


_left: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.delete(spark, [root for root in _left if root in scratch.MADE])
        before = set(scratch.MADE)
        out = work(spark, docs, sf_dir)
        _left[:] = [root for root in scratch.MADE if root not in before]
        return out

    return run


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored one half or more go; labels are learned from the training fold of the stage's own input."""
    columns = _columns(docs)
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=columns)
    return scored.where("predicted = 0").select(*columns)


@stage
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language with a score of LANGUAGE_SCORE, go."""
    columns = _columns(docs)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)
    return langid.retain(docs, queries.language_model(docs), known, keep=columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id; rows are numbered, so ids may be repeated or null."""
    columns = _columns(docs)
    rows = Scratch(spark).keep(docs.select(*columns, F.monotonically_increasing_id().alias("_row")), "numbered")
    classes = minhash.near_duplicate_classes(rows, id_col="_row").select("_row", "component_id")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row")
    kept = rows.select("_row", "doc_id").join(classes, "_row").groupBy("component_id").agg(first).select("_row")
    return rows.join(kept, "_row", "left_semi").select(*columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows are numbered, so each is judged by its own text, with a null or repeated id too."""
    columns = _columns(docs)
    rows = Scratch(spark).keep(docs.select(*columns, F.monotonically_increasing_id().alias("_row")), "numbered")
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").select(F.col("doc_id").alias("_gone")).distinct()
    return rows.join(found, F.col("_row") == F.col("_gone"), "left_anti").select(*columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_decode(docs, queries.vocabulary(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Learned models and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    kept = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = kept.keep(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
