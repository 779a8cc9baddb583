"""Joins with tables of keys, some of which very many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that more than one in so many rows share (and more than LEAST_HOT rows) are joined by broadcast: at most HOT_SHARE of them.
HOT_SHARE, LEAST_HOT = 5_000, 1_000


def join_uneven(left: DataFrame, right: DataFrame, keys: list[str], value: str, own: Column) -> DataFrame:
    """``left`` with ``value`` of ``right`` (distinct keys, ``weight``: about how many rows of ``left`` have them), or null.

    Heavy keys, HOT_SHARE at most, are joined by broadcast, and their rows are then dealt by ``own`` among the others."""
    limit = max(LEAST_HOT, (right.agg(F.sum("weight")).first()[0] or 0) // HOT_SHARE)
    heavy = right.where(F.col("weight") > limit).select(*keys, F.col(value).alias("_heavy"), F.lit(True).alias("_met"))
    out = left.join(F.broadcast(heavy), keys, "left")
    light = right.where(F.col("weight") <= limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value), F.lit(0).alias("_zero"))
    out = out.withColumn("_zero", F.when(F.col("_met"), 1).otherwise(0)).withColumn("_deal", F.when(F.col("_met"), own.cast(left.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    light = light.withColumnRenamed(f"_{keys[0]}", "_deal")
    match = ["_deal", "_zero", *[f"_{k}" for k in keys[1:]]]
    out = out.select("*", *[F.col(k).alias(f"_{k}") for k in keys[1:]]).join(light, match, "left")
    return out.withColumn(value, F.coalesce("_heavy", value)).select(*left.columns, value)
