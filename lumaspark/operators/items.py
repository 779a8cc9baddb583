"""Relations of a container: items, extents, properties, associations and reference edges.

All functions are joins and aggregations keyed by ``file_id`` (and ``item_id``), so a collection of files needs one partitioning by
file. "First" always means the smallest ordinal, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.functions.tables import BRANDS, PICTURE_TYPES, PRIMARIES, QUARTER_TURNS


def brand_accepted(major: Column, compatible: Column) -> Column:
    """The major brand or any compatible one is supported."""
    return F.coalesce(major.isin(*BRANDS) | F.arrays_overlap(compatible, F.array(*map(F.lit, BRANDS))), F.lit(False))


def item_properties(assoc: DataFrame, properties: DataFrame) -> DataFrame:
    """Associations with their properties by 1-based position; positions without a property are dropped. A property list without
    ``file_id`` is every file's."""
    keys = [k for k in ("file_id", "prop_idx") if k in properties.columns]
    return assoc.where("prop_idx > 0").join(properties, keys)


def first_property(joined: DataFrame, kind: str, value: str, name: str) -> DataFrame:
    """``(file_id, item_id, name)``: the first associated property of a kind."""
    return joined.where(F.col("kind") == kind).groupBy("file_id", "item_id").agg(F.min_by(value, "assoc_ord").alias(name))


def first_properties(assoc: DataFrame, properties: DataFrame, wanted: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """``(file_id, item_id, name, ...)`` of every associated item: for each name the value of the first property of a kind, or a
    default. ``wanted``: kind, value and default by name. One join and one aggregation for all of them."""
    keys = [k for k in ("file_id", "prop_idx") if k in properties.columns]
    joined = assoc.withColumn("prop_idx", F.when(F.col("prop_idx") > 0, F.col("prop_idx"))).join(properties, keys, "left")
    first = lambda kind, value, default: F.coalesce(F.min_by(value, F.when(F.col("kind") == kind, F.col("assoc_ord"))), default)
    return joined.groupBy("file_id", "item_id").agg(*[first(*how).alias(name) for name, how in wanted.items()])


def with_property(items: DataFrame, first: DataFrame, name: str, default: Column | None = None) -> DataFrame:
    """Items with a first property, or a default."""
    out = items.join(first, ["file_id", "item_id"], "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, default))


def is_alpha_urn(urn: Column) -> Column:
    return F.coalesce((urn == "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha") | urn.endswith(":auxid:1") | F.lower(urn).contains("alpha"), F.lit(False))


def alpha_items(items: DataFrame, joined: DataFrame) -> DataFrame:
    """Items that an alpha auxiliary type is associated with."""
    return items.join(joined.where((F.col("kind") == "auxC") & is_alpha_urn(F.col("aux_type"))), ["file_id", "item_id"], "left_semi")


def color_space(primaries: Column) -> Column:
    out = F.when(F.lit(False), "")
    for code, name in PRIMARIES.items():
        out = out.when(primaries == code, name)
    return out.otherwise("srgb")


def orientation_of(turns: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for angle, tag in QUARTER_TURNS.items():
        out = out.when(turns == angle, tag)
    return out


def first_edge_targets(refs: DataFrame, ref_type: str) -> DataFrame:
    """``(file_id, from_item_id, to_ord, to_item_id)`` of each item's first edge of a type."""
    edges = refs.where(F.col("ref_type") == ref_type)
    first = edges.groupBy("file_id", "from_item_id").agg(F.min("ref_ord").alias("ref_ord"))
    return edges.join(first, ["file_id", "from_item_id", "ref_ord"]).select("file_id", "from_item_id", "to_ord", "to_item_id")


def first_source(refs: DataFrame, targets: DataFrame, ref_type: str, name: str) -> DataFrame:
    """``(file_id, name)``: the item whose edge of a type first points at the file's target. ``targets`` is ``(file_id,
    item_id)``, one row a file."""
    edges = refs.where(F.col("ref_type") == ref_type).withColumnRenamed("to_item_id", "item_id").join(targets, ["file_id", "item_id"])
    return edges.groupBy("file_id").agg(F.min_by("from_item_id", F.struct("ref_ord", "to_ord")).alias(name))


def primary_items(files: DataFrame, items: DataFrame) -> DataFrame:
    """``(file_id, item_id)``: the declared primary item, else the smallest that carries a picture, else the smallest."""
    found = items.groupBy("file_id").agg(F.min(F.when(F.col("item_type").isin(*PICTURE_TYPES), F.col("item_id"))).alias("picture"), F.min("item_id").alias("any"))
    joined = files.select("file_id", "declared_primary").join(found, "file_id", "left")
    return joined.select("file_id", F.coalesce("declared_primary", "picture", "any").alias("item_id"))


def lay_out(extents: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Give extents of a file that follow one another their ordinal and offset."""
    line = Window.partitionBy("file_id").orderBy(*order)
    return extents.withColumn("extent_ord", F.row_number().over(line)).withColumn("offset", F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length))


def outside_file(extents: DataFrame, files: DataFrame) -> DataFrame:
    """Extents that reach beyond their file, with an error code."""
    joined = extents.join(files.select("file_id", F.col("length").alias("file_length")), "file_id")
    return joined.where((F.col("offset") < 0) | (F.col("offset") + F.col("length") > F.col("file_length"))).withColumn("code", F.lit("MALFORMED_INPUT"))


def item_lengths(extents: DataFrame) -> DataFrame:
    return extents.groupBy("file_id", "item_id").agg(F.sum("length").alias("total_length"), F.count("*").alias("extent_count"))


def joined_extents(extents: DataFrame, piece: Column, separator: str | None = None) -> DataFrame:
    """``(file_id, item_id, data)``: pieces of an item in extent order; bytes are concatenated, strings by ``separator``."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col("extent_ord"), piece.alias("piece")))), lambda s: s["piece"])
    whole = F.array_join(ordered, separator) if separator is not None else F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p))
    return extents.groupBy("file_id", "item_id").agg(whole.alias("data"))


def exif_payload(data: Column) -> Column:
    """An Exif item without its offset field, from where that points to; as it is if the offset lies outside."""
    skip = F.conv(F.hex(F.substr(data, F.lit(1), F.lit(4))), 16, 10).cast("long") + 4
    ok = (F.octet_length(data) >= 4) & (skip < F.octet_length(data))
    return F.when(ok, F.substr(data, (skip + 1).cast("int"), F.octet_length(data))).otherwise(data)


def distinct_items(rows: DataFrame) -> DataFrame:
    """``(file_id, item_id, primary_item_id)``: every item of a file once, with the smallest of the file.

    One shuffle by file and one sort, which spills: rows that follow one another are compared, so no table of keys is held."""
    line = Window.partitionBy("file_id").orderBy(F.col("item_id").asc_nulls_last())
    new = (F.row_number().over(line) == 1) | ~F.lag("item_id").over(line).eqNullSafe(F.col("item_id"))
    return rows.select("file_id", "item_id", F.first("item_id").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("primary_item_id"), new.alias("_new")).where("_new").drop("_new")


def item_counts(rows: DataFrame) -> DataFrame:
    """``(file_id, n_items)``: different items of each file, as the rank of its last row. One shuffle by file and one sort."""
    line = Window.partitionBy("file_id").orderBy("item_id")
    ranked = rows.select("file_id", F.dense_rank().over(line).cast("long").alias("n_items"), F.lead(F.lit(True)).over(line).isNull().alias("_last"))
    return ranked.where("_last").drop("_last")


def metadata_rollup(items: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """``(file_id, primary_item_id, item_count, width, height, color_space, orientation, is_grid, has_alpha)`` from resolved items.
    ``primary`` is ``(file_id, item_id)``, one row a file; without it, items have ``primary_item_id``.

    Items that come from ``distinct_items`` lie in the order of files, and are grouped as they come: no further shuffle or sort."""
    joined = items.where("file_id is not null") if primary is None else items.join(primary.withColumnRenamed("item_id", "primary_item_id"), "file_id")
    here = F.col("item_id") == F.col("primary_item_id")
    of_primary = lambda c: F.max(F.when(here, F.col(c))).alias(c)
    return joined.groupBy("file_id").agg(
        F.max("primary_item_id").alias("primary_item_id"),
        F.count("*").alias("item_count"),
        *[of_primary(c) for c in ("width", "height", "color_space", "orientation")],
        F.coalesce(F.bool_or(here & (F.col("item_type") == "grid")), F.lit(False)).alias("is_grid"),
        F.coalesce(F.bool_or(F.col("is_alpha") & ~here), F.lit(False)).alias("has_alpha"),
    )


def tile_payloads(tiles: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tiles ``(file_id, to_ord, to_item_id)`` with the length of their data; a tile without a location gets an error code."""
    places = lengths.select("file_id", F.col("item_id").alias("to_item_id"), "total_length")
    joined = tiles.join(places, ["file_id", "to_item_id"], "left")
    return joined.withColumn("code", F.when(F.col("total_length").isNull(), "INVALID_CONTAINER"))
