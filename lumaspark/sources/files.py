"""Files as tables: scanning, detection, parsing, and the metadata query.

One parse per file gives a row of arrays; ``tables`` inlines them into relations keyed by ``file_id`` for the joins and aggregations of
operators.items. The metadata query reads a file's tables where they are parsed. A file that fails carries an error and no rows elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.functions.checksums import read_uint
from lumaspark.functions.limits import ImageError, Limits, dimension_code, file_size_code
from lumaspark.functions.tables import PRIMARIES, QUARTER_TURNS
from lumaspark.operators import items as ops

from . import container

FILE_SCHEMA = "file_id string, length bigint, content binary"
BOX = "struct<ord:int,parent_ord:int,depth:int,box_type:string,offset:bigint,size:bigint,header_size:int>"
ITEM = "struct<item_id:bigint,protection_index:int,item_type:string,item_name:string,content_type:string>"
EXTENT = "struct<item_id:bigint,extent_ord:int,construction_method:int,base_offset:decimal(20,0),offset:decimal(20,0),length:decimal(20,0),extent_index:decimal(20,0)>"
PROPERTY = (
    "struct<prop_idx:int,kind:string,width:bigint,height:bigint,angle_ccw:int,mirror_axis:int,color_kind:string,primaries:int,transfer:int,matrix:int,"
    "full_range:boolean,icc:binary,aux_type:string,aux_subtype:binary,nal_length_size:int,vps:array<binary>,sps:array<binary>,pps:array<binary>>"
)
ASSOC = "struct<item_id:bigint,assoc_ord:int,prop_idx:int,essential:boolean>"
REF = "struct<ref_ord:int,ref_type:string,from_item_id:bigint,to_ord:int,to_item_id:bigint>"
PARSED = (
    "file_id string, length bigint, major_brand string, compatible_brands array<string>, handler string, declared_primary bigint, grid struct<rows:bigint,columns:bigint,width:bigint,height:bigint>, "
    f"grid_tiles bigint, items array<{ITEM}>, extents array<{EXTENT}>, properties array<{PROPERTY}>, assoc array<{ASSOC}>, refs array<{REF}>, error struct<code:string,message:string>"
)


def scan(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """``(file_id, length, content)`` of files below a path. Files over the size cap keep their row, with a null content that is never
    read, and every later step gives them ``LIMIT_INPUT_BYTES``."""
    return capped(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), limits)


def capped(load: Callable[[], DataFrame], limits: Limits) -> DataFrame:
    """Files with content up to the size cap, and those beyond it without: two reads of the listing, as the filter on the length keeps
    contents from being read only where they are not asked for."""
    found = load().select(F.col("path").alias("file_id"), "length", "content")
    if limits.max_file_size is None:
        return found
    large = load().where(F.col("length") > limits.max_file_size).select(F.col("path").alias("file_id"), "length", F.lit(None).cast("binary").alias("content"))
    return found.where(F.col("length") <= limits.max_file_size).unionByName(large)


def from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """The same from bytes at hand."""
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in sorted(named.items())], FILE_SCHEMA)


def detected(content: Column) -> Column:
    """Whether bytes start with a well-formed file type box of a supported brand; never fails, reads the first box only."""
    size, length = read_uint(content, 0, 4), F.octet_length(content)
    long_high, long_low = read_uint(content, 8, 4), read_uint(content, 12, 4)
    header = F.when(size == 1, 16).otherwise(8)
    whole = F.when(size == 1, F.when(long_high == 0, long_low)).when(size == 0, length).otherwise(size)
    brand = lambda at: F.decode(F.substr(content, (at + 1).cast("int"), F.lit(4)), "ISO-8859-1")
    rest = F.floor((whole - header - 8) / 4)
    places = F.when(rest > 0, F.sequence(F.lit(0).cast("long"), rest - 1)).otherwise(F.array().cast("array<bigint>"))
    compatible = F.transform(places, lambda i: brand(header + 8 + 4 * i))
    sound = (length >= 12) & (brand(F.lit(4)) == "ftyp") & (whole <= length) & (whole >= header + 8)
    return F.coalesce(F.when(sound, ops.brand_accepted(brand(header), compatible)), F.lit(False))


def detect(files: DataFrame) -> DataFrame:
    return files.select("file_id", detected(F.col("content")).alias("detected"))


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found, errors = [], [], []
        for name, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows: list[dict] = []
            error = None
            try:
                container.walk(content or b"", out=rows)
            except Exception as e:  # whatever is wrong with one file is that file's error
                error = failure(e)
            ids.append(name)
            found.append(rows)
            errors.append(error)
        yield pa.RecordBatch.from_pylist([{"file_id": i, "boxes": b, "error": e} for i, b, e in zip(ids, found, errors, strict=True)], schema=_BOX_ARROW)


_BOX_ARROW = pa.schema(
    [
        ("file_id", pa.string()),
        (
            "boxes",
            pa.list_(
                pa.struct(
                    [("ord", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()), ("box_type", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("header_size", pa.int32())]
                )
            ),
        ),
        ("error", pa.struct([("code", pa.string()), ("message", pa.string())])),
    ]
)


def scan_boxes(files: DataFrame) -> DataFrame:
    """``(file_id, error, ord, parent_ord, depth, box_type, offset, size, header_size)``: boxes up to the first bad one."""
    rows = files.select("file_id", "content").mapInArrow(_boxes, f"file_id string, boxes array<{BOX}>, error struct<code:string,message:string>")
    return rows.select("file_id", "error", F.inline_outer("boxes"))


def failure(e: Exception) -> dict:
    """The error struct of an exception; one without a code is INTERNAL_ERROR."""
    return {"code": e.code, "message": e.message} if isinstance(e, ImageError) else {"code": "INTERNAL_ERROR", "message": f"{type(e).__name__}: {e}"[:500]}


def record(name: str, length: int, content: bytes, limits: Limits) -> dict:
    out = {"file_id": name, "length": length, "error": None}
    try:
        if limits.max_file_size is not None and length > limits.max_file_size:
            raise ImageError("LIMIT_INPUT_BYTES", f"{length} bytes")
        if not container.detect(content):
            raise ImageError("UNSUPPORTED_FORMAT", "not a supported still-image container")
        found = container.parse(content, limits)
        out |= {"major_brand": found.major_brand, "compatible_brands": found.compatible_brands, "handler": found.handler, "declared_primary": found.declared_primary}
        out["items"] = list(found.items.values())
        out["extents"] = [
            {"item_id": i, "extent_ord": k, "construction_method": p["construction_method"], "base_offset": p["base_offset"], **e} for i, p in found.locations.items() for k, e in enumerate(p["extents"])
        ]
        out["properties"] = [{"prop_idx": i, **p} for i, p in enumerate(found.properties or [], 1)]
        out["assoc"] = [{"item_id": i, "assoc_ord": k, **a} for i, list_ in found.associations.items() for k, a in enumerate(list_)]
        out["refs"] = [
            {"ref_ord": k, "ref_type": r["ref_type"], "from_item_id": r["from_item_id"], "to_ord": o, "to_item_id": t} for k, r in enumerate(found.references or []) for o, t in enumerate(r["to_item_ids"])
        ]
        primary = primary_of(found)
        if primary is None:
            raise ImageError("INVALID_CONTAINER", "no primary item")
        if found.items.get(primary, {}).get("item_type") == "grid":
            rows, columns, width, height = container.grid(container.item_data(content, found, primary), limits)
            tiles = tiles_of(found, primary)
            if tiles and len(tiles) != rows * columns:
                raise ImageError("INVALID_CONTAINER", f"{rows * columns} tiles declared, {len(tiles)} referenced")
            out |= {"grid": {"rows": rows, "columns": columns, "width": width, "height": height}, "grid_tiles": len(tiles)}
    except Exception as e:  # whatever is wrong with one file is that file's error
        return {"file_id": name, "length": length, "error": failure(e)}
    return out


def chosen_primary(declared: int | None, items: dict[int, dict]) -> int | None:
    """The declared primary item, else the smallest with a picture, else the smallest."""
    if declared is not None:
        return declared
    pictures = [i for i, e in items.items() if e["item_type"] in ops.PICTURE_TYPES]
    return min(pictures or items, default=None)


def primary_of(found: container.Parsed) -> int | None:
    return chosen_primary(found.declared_primary, found.items)


def tiles_of(found: container.Parsed, item: int) -> list[int]:
    return next((r["to_item_ids"] for r in found.references or [] if r["ref_type"] == "dimg" and r["from_item_id"] == item), [])


def _per_row(files: DataFrame, schema: str, work: Callable[[str, int, bytes], dict]) -> DataFrame:
    """``work(file_id, length, content)`` for every file; a file that is too large to be read has its length, but no content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "length", "content")), strict=True):
                try:
                    row = work(name, length if content is None else len(content), content or b"")
                except Exception as e:  # whatever is wrong with one file is that file's error
                    row = {"file_id": name, "error": failure(e)}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return files.select("file_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"), "content").mapInArrow(run, schema)


def parse(files: DataFrame, limits: Limits = Limits(), fail_fast: bool = False) -> DataFrame:
    """One row per file with every table as an array, or an error. With ``fail_fast`` the first error ends the query."""
    out = _per_row(files, PARSED, lambda *file: record(*file, limits))
    if fail_fast:
        out = out.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "error.code", "error.message")).cast("boolean")).otherwise(True))
    return out


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Relations ``items, extents, properties, assoc, refs`` keyed by ``file_id``."""
    good = parsed.where("error is null")
    out = {name: good.select("file_id", F.inline(name)) for name in ("items", "extents", "properties", "assoc", "refs")}
    return out


def joined_metadata(parsed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``metadata`` by joins of the relations of parsed files, for callers who hold those. ``parsed`` is used once for every
    relation, so it should be a written table."""
    part = tables(parsed)
    head = parsed.select("file_id", "length", "major_brand", "compatible_brands", "declared_primary", "grid", "error")
    good = head.where("error is null")
    primary = ops.primary_items(good, part["items"])
    joined = ops.item_properties(part["assoc"], part["properties"])
    sizes = ops.first_property(joined.withColumn("wh", F.struct("width", "height")), "ispe", "wh", "wh")
    turns = ops.first_property(joined, "irot", "angle_ccw", "turns")
    colors = ops.first_property(joined.withColumn("space", F.when(F.col("color_kind") == "nclx", ops.color_space(F.col("primaries"))).otherwise("icc")), "colr", "space", "space")
    mirrors = ops.first_property(joined, "imir", "mirror_axis", "mirror_axis")
    alphas = ops.alpha_items(part["items"], joined).select("file_id", "item_id", F.lit(True).alias("alpha_by_property"))
    rows = part["items"]
    for found in (sizes, turns, colors, mirrors, alphas):
        rows = rows.join(found, ["file_id", "item_id"], "left")
    rows = rows.join(primary.withColumnRenamed("item_id", "primary_item_id"), "file_id").join(good.select("file_id", "grid"), "file_id")
    here = F.col("item_id") == F.col("primary_item_id")
    rows = rows.withColumns({c: F.coalesce(F.when(here, F.col(f"grid.{c}")), F.col(f"wh.{c}"), F.lit(0).cast("long")) for c in ("width", "height")})
    rows = rows.withColumn("code", F.when((F.col("width") > 0) & (F.col("height") > 0), dimension_code(F.col("width"), F.col("height"), limits)))
    auxiliary = ops.first_source(part["refs"], primary, "auxl", "alpha_edge")
    exif = ops.first_source(part["refs"], primary, "cdsc", "exif_edge")
    one = lambda c: F.max(F.when(here, F.col(c))).alias(c)
    rolled = rows.groupBy("file_id", "primary_item_id").agg(
        F.count("*").alias("item_count"), one("width"), one("height"), one("space"), one("turns"), one("mirror_axis"), F.min("code").alias("code"),
        F.min(F.when(F.col("alpha_by_property") & ~here, F.col("item_id"))).alias("alpha_property"), F.min(F.when(F.col("item_type") == "Exif", F.col("item_id"))).alias("exif_type"),
    )
    reach = part["extents"].where("construction_method = 0").join(part["items"].select("file_id", "item_id"), ["file_id", "item_id"], "left_semi")
    ends = reach.groupBy("file_id").agg(F.max(F.col("base_offset") + F.col("offset") + F.col("length")).alias("end"))
    out = head.join(rolled, "file_id", "left").join(auxiliary, "file_id", "left").join(exif, "file_id", "left").join(ends, "file_id", "left")
    late = F.when(F.col("error").isNotNull(), F.col("error.code")).when(F.col("code").isNotNull(), F.col("code")).when(F.col("end") > F.col("length"), "MALFORMED_INPUT")
    late = late.otherwise(file_size_code(F.col("length"), limits))
    out = out.withColumn("error_code", late)
    ok = F.col("error_code").isNull()
    alpha = F.coalesce("alpha_edge", "alpha_property")
    values = {
        "major_brand": F.col("major_brand"),
        "compatible_brands": F.col("compatible_brands"),
        "width": F.coalesce("width", F.lit(0).cast("long")),
        "height": F.coalesce("height", F.lit(0).cast("long")),
        "color_space": F.coalesce("space", F.lit("srgb")),
        "orientation": ops.orientation_of(F.col("turns")),
        "mirror_axis": F.col("mirror_axis"),
        "primary_item_id": F.coalesce("primary_item_id", "declared_primary"),
        "item_count": F.coalesce("item_count", F.lit(0).cast("long")),
        "is_grid": F.col("grid").isNotNull(),
        "grid_rows": F.coalesce("grid.rows", F.lit(0).cast("long")),
        "grid_columns": F.coalesce("grid.columns", F.lit(0).cast("long")),
        "has_alpha": alpha.isNotNull(),
        "alpha_item_id": alpha,
        "exif_item_id": F.coalesce("exif_edge", "exif_type"),
    }
    message = F.coalesce("error.message", "error_code")
    return out.select("file_id", *[F.when(ok, c).alias(n) for n, c in values.items()], F.when(~ok, F.struct(F.col("error_code").alias("code"), message.alias("message"))).alias("error"))


METADATA = (
    "file_id string, major_brand string, compatible_brands array<string>, width bigint, height bigint, color_space string, orientation int, mirror_axis int, primary_item_id bigint, "
    "item_count bigint, is_grid boolean, grid_rows bigint, grid_columns bigint, has_alpha boolean, alpha_item_id bigint, exif_item_id bigint, error struct<code:string,message:string>"
)


def alpha_urn(urn: str | None) -> bool:
    """The same as ``items.is_alpha_urn``, for kernels."""
    return urn is not None and (urn.endswith(":auxid:1") or "alpha" in urn.lower())


def _size_code(width: int, height: int, limits: Limits) -> str | None:
    try:
        if width * height >= 1 << 63:
            raise ImageError("LIMIT_DIMENSIONS", "product")
        limits.check_size(width, height)
    except ImageError as e:
        return e.code
    return None


def describe(name: str, length: int, content: bytes, limits: Limits = Limits()) -> dict:
    """What one file's tables say: a row of ``METADATA``. Every table is read once, so the work grows with their lengths only."""
    row = record(name, length, content, limits)
    if row["error"]:
        return {"file_id": name, "error": row["error"]}
    items = {e["item_id"]: e for e in row["items"]}
    primary, grid = chosen_primary(row["declared_primary"], items), row.get("grid")
    listed = {p["prop_idx"]: p for p in row["properties"]}
    firsts: dict[int, dict[str, dict]] = {}
    marked = []
    for a in row["assoc"]:
        prop, item = listed.get(a["prop_idx"]), a["item_id"]
        if prop is None or item not in items:
            continue
        firsts.setdefault(item, {}).setdefault(prop["kind"], prop)
        if item != primary and prop["kind"] == "auxC" and alpha_urn(prop.get("aux_type")):
            marked.append(item)
    sizes = {i: (p["ispe"]["width"], p["ispe"]["height"]) for i, p in firsts.items() if "ispe" in p}
    if grid and primary in items:
        sizes[primary] = (grid["width"], grid["height"])
    code = min((c for w, h in sizes.values() if w > 0 and h > 0 and (c := _size_code(w, h, limits))), default=None)
    ends = (e["base_offset"] + e["offset"] + e["length"] for e in row["extents"] if e["construction_method"] == 0 and e["item_id"] in items)
    if code is None and max(ends, default=0) > length:
        code = "MALFORMED_INPUT"
    if code is not None:
        return {"file_id": name, "error": {"code": code, "message": code}}
    source = lambda kind: next((r["from_item_id"] for r in row["refs"] if r["ref_type"] == kind and r["to_item_id"] == primary), None)
    alpha, exif = source("auxl"), source("cdsc")
    alpha = min(marked, default=None) if alpha is None else alpha
    exif = min((i for i, e in items.items() if e["item_type"] == "Exif"), default=None) if exif is None else exif
    own = firsts.get(primary, {})
    width, height = sizes.get(primary, (0, 0))
    color = own.get("colr")
    space = "srgb" if color is None else PRIMARIES.get(color["primaries"], "srgb") if color["color_kind"] == "nclx" else "icc"
    return {
        "file_id": name, "major_brand": row["major_brand"], "compatible_brands": row["compatible_brands"], "width": width, "height": height, "color_space": space,
        "orientation": QUARTER_TURNS.get(own["irot"]["angle_ccw"]) if "irot" in own else None, "mirror_axis": own["imir"]["mirror_axis"] if "imir" in own else None,
        "primary_item_id": primary, "item_count": len(items), "is_grid": grid is not None, "grid_rows": grid["rows"] if grid else 0, "grid_columns": grid["columns"] if grid else 0,
        "has_alpha": alpha is not None, "alpha_item_id": alpha, "exif_item_id": exif, "error": None,
    }


def metadata(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per file: brands, size, colour space, orientation, primary item, item count, grid, alpha and Exif items, or an error;
    limits on every item's size and extents beyond the file turn into errors too.

    The parse holds all tables of a file, so they are read there: one pass, no shuffle, and only the answer leaves the worker."""
    return _per_row(files, METADATA, lambda *file: describe(*file, limits))


def inspect(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The short form: width, height, number of items and whether there is alpha."""
    return metadata(files, limits).select("file_id", "width", "height", F.col("item_count").alias("image_count"), "has_alpha", "error")
