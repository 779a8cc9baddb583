"""Relations of the shapes that the image operators work on, derived from the supplied tables.

The tables hold no pictures: an embedding's 64 numbers serve as an 8x8 block, an order with its lines as a file with items and
extents, parts as properties. Each function says what stands for what.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.operators import items, pixels

#: Columns that order the lines of an order; (l_orderkey, l_linenumber) is not unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, x, y, v)``: each embedding as an 8x8 grey block."""
    return pixels.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, x, y, r, g, b, a)``: the block, its inverse, its double modulo 256; alpha from the block's number."""
    v = F.col("v")
    return blocks(spark, sf_dir).select("image_id", "x", "y", v.alias("r"), (255 - v).alias("g"), ((2 * v) % 256).alias("b"), (F.col("image_id") % 256).alias("a"))


def coefficients(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """``(block_id, x, y, v)``: the corner of each block, centred at zero, as quantised coefficients."""
    cut = pixels.crop(blocks(spark, sf_dir), size, size)
    return cut.select(F.col("image_id").alias("block_id"), "x", "y", (F.col("v") - 128).alias("v"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, top, left)``: reference arrays of a 4x4 block: the first row, and the first column, with the corner twice."""
    side = F.collect_list(F.struct("x", "y", "v"))
    rows = blocks(spark, sf_dir).where("y = 0 or x = 0").groupBy("image_id").agg(F.sort_array(side).alias("s"))
    pick = lambda cond, key: F.transform(F.array_sort(F.transform(F.filter("s", cond), lambda r: F.struct(r[key].alias("k"), r["v"].alias("v")))), lambda r: r["v"])
    top, left = pick(lambda r: r["y"] == 0, "x"), pick(lambda r: r["x"] == 0, "y")
    return rows.select("image_id", F.concat(F.slice(top, 1, 1), top).alias("top"), F.concat(F.slice(top, 1, 1), left).alias("left"))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, item_id, extent_ord, length, offset)``: an order's lines follow one another, quantities are lengths."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("item_id"), F.col("l_quantity").cast("long").alias("length"), *LINE_ORDER)
    return items.lay_out(lines, LINE_ORDER).select("file_id", "item_id", F.col("extent_ord").cast("long").alias("extent_ord"), "length", "offset")


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(prop_idx, kind, size, aux_type)``: all parts as the property list of every file."""
    parts = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "ispe").when(F.col("p_size") % 3 == 1, "irot").otherwise("auxC")
    urn = F.when(kind == "auxC", F.concat(F.lit("urn:"), F.when(F.col("p_size") % 2 == 0, "Alpha").otherwise("depth"), F.lit(":"), F.col("p_brand")))
    return parts.select(F.col("p_partkey").alias("prop_idx"), kind.alias("kind"), F.col("p_size").cast("long").alias("size"), urn.alias("aux_type"))


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, item_id, assoc_ord, prop_idx)``: an order's lines point at the property numbered by their part; seventh lines at its
    negative, which is none."""
    lines = items.lay_out(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit(1).cast("long").alias("length"), *LINE_ORDER), LINE_ORDER)
    return lines.select("file_id", F.col("l_linenumber").cast("long").alias("item_id"), F.col("extent_ord").cast("long").alias("assoc_ord"), F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("prop_idx"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, ref_ord, ref_type, from_item_id, to_ord, to_item_id)``: a line is an edge from its part to its supplier."""
    lines = items.lay_out(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit(1).cast("long").alias("length"), "l_returnflag", *LINE_ORDER), LINE_ORDER)
    kind = F.when(F.col("l_returnflag") == "A", "auxl").when(F.col("l_returnflag") == "N", "dimg").otherwise("cdsc")
    return lines.select(
        "file_id", F.col("extent_ord").cast("long").alias("ref_ord"), kind.alias("ref_type"), (F.col("l_partkey") % 7).alias("from_item_id"), F.lit(0).cast("long").alias("to_ord"), (F.col("l_suppkey") % 7).alias("to_item_id")
    )
