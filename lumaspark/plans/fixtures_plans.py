"""Queries over synthetic containers. Their bytes are fixed, so what they must give is typed as SQL values; only pixels, encoded files and
the long list of boxes are left to their own tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.operators import hevc
from lumaspark.sources import container, files, synthetic

from . import convert


def detect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.detect(files.from_bytes(spark, synthetic.fixtures()))


def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.metadata(files.from_bytes(spark, synthetic.fixtures()))
    return found.withColumns({"compatible_brands": F.array_join("compatible_brands", ","), "error": F.col("error.code")})


def inspect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inspect(files.from_bytes(spark, synthetic.fixtures())).withColumn("error", F.col("error.code"))


def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_boxes(files.from_bytes(spark, synthetic.fixtures())).withColumn("error", F.col("error.code"))


def nal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every decodable picture's first item with their types."""
    rows = []
    for name, data in synthetic.pictures().items():
        if not name.startswith(("bad_", "grid")):
            found = container.parse(data, convert.Limits())
            rows += [(name, i, unit.kind, unit.layer, unit.temporal, len(unit.rbsp)) for i, unit in enumerate(hevc.units(container.annex_b(data, found, 1)))]
    return spark.createDataFrame(rows, "file_id string, nal_ord int, nal_type int, layer_id int, tid_plus1 int, rbsp_length int")


def decoded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.image_pixels(convert.raw_pixels(files.from_bytes(spark, synthetic.pictures())).where("error is null"))


def _converted(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = convert.convert(files.from_bytes(spark, synthetic.pictures()), {"format": kind, "quality": 0.9})
        return found.select("file_id", "mime", "width", "height", "truncated", F.sha2("data", 256).alias("sha256"), F.col("error.code").alias("error"))

    return run


DETECT_SQL = """
select * from (values
  ('still_12mp', true), ('grid_4x4', true), ('grid_1x2', true), ('plain', true), ('alpha', true), ('rotation_0', true), ('rotation_1', true), ('rotation_2', true),
  ('rotation_3', true), ('wide_gamut', true), ('burst', true), ('brand_mif1', true), ('no_primary', true),
  ('bad_dimensions', true), ('bad_extent', true), ('bad_no_meta', true), ('bad_tile_count', true), ('bad_trailing', true),
  ('bad_huge_box', false), ('bad_other', false), ('bad_truncated', false)) as t(file_id, detected)
"""

#: What the metadata query must find: stills, grids, alpha, rotations, wide gamut, a burst, brands; the code of each broken file.
SOUND_SQL = """
select file_id, major_brand, compatible_brands, width::bigint as width, height::bigint as height, color_space, orientation::int as orientation,
       primary_item_id::bigint as primary_item_id, item_count::bigint as item_count, grid_rows > 0 as is_grid, grid_rows::bigint as grid_rows,
       grid_columns::bigint as grid_columns, alpha_item_id is not null as has_alpha, alpha_item_id::bigint as alpha_item_id, exif_item_id::bigint as exif_item_id,
       null::varchar as error
from (values
  ('still_12mp', 'heic', 'mif1,heic', 4032, 3024, 'srgb', null, 1, 1, 0, 0, null, null),
  ('grid_4x4', 'heic', 'mif1,heic', 2048, 2048, 'srgb', null, 1, 17, 4, 4, null, null),
  ('grid_1x2', 'heic', 'mif1,heic', 1000, 500, 'srgb', null, 1, 3, 1, 2, null, null),
  ('plain', 'heic', 'mif1,heic', 1920, 1080, 'srgb', null, 1, 1, 0, 0, null, null),
  ('alpha', 'heic', 'mif1,heic', 1200, 1600, 'srgb', null, 1, 2, 0, 0, 2, null),
  ('rotation_0', 'heic', 'mif1,heic', 1280, 720, 'srgb', 1, 1, 1, 0, 0, null, null),
  ('rotation_1', 'heic', 'mif1,heic', 1280, 720, 'srgb', 8, 1, 1, 0, 0, null, null),
  ('rotation_2', 'heic', 'mif1,heic', 1280, 720, 'srgb', 3, 1, 1, 0, 0, null, null),
  ('rotation_3', 'heic', 'mif1,heic', 1280, 720, 'srgb', 6, 1, 1, 0, 0, null, null),
  ('wide_gamut', 'heic', 'mif1,heic', 3840, 2160, 'display-p3', null, 1, 1, 0, 0, null, null),
  ('burst', 'msf1', 'msf1,heic', 1920, 1080, 'srgb', null, 1, 4, 0, 0, null, null),
  ('brand_mif1', 'mif1', 'heic', 800, 600, 'srgb', null, 1, 1, 0, 0, null, null),
  ('no_primary', 'heic', 'mif1,heic', 10, 20, 'srgb', null, 9, 2, 0, 0, null, 7))
  as t(file_id, major_brand, compatible_brands, width, height, color_space, orientation, primary_item_id, item_count, grid_rows, grid_columns, alpha_item_id, exif_item_id)
union all by name
select file_id, error from (values
  ('bad_dimensions', 'LIMIT_DIMENSIONS'), ('bad_extent', 'MALFORMED_INPUT'), ('bad_huge_box', 'UNSUPPORTED_FORMAT'), ('bad_no_meta', 'INVALID_CONTAINER'),
  ('bad_other', 'UNSUPPORTED_FORMAT'), ('bad_tile_count', 'INVALID_CONTAINER'), ('bad_trailing', 'MALFORMED_INPUT'), ('bad_truncated', 'UNSUPPORTED_FORMAT')) as t(file_id, error)
"""
PROBE_SQL = f"select *, null::int as mirror_axis from ({SOUND_SQL})"
INSPECT_SQL = f"select file_id, width, height, item_count as image_count, has_alpha, error from ({SOUND_SQL})"

#: Sequence parameters, picture parameters and one instantaneous-refresh slice in each picture.
NAL_SQL = """
select file_id, nal_ord::int as nal_ord, nal_type::int as nal_type, 0::int as layer_id, 1::int as tid_plus1, (case nal_ord when 0 then first when 1 then 4 else last end)::int as rbsp_length
from (values ('empty_slice', 19, 2), ('masked', 19, 514), ('plain', 20, 514), ('turned', 20, 514)) as p(file_id, first, last),
     (values (0, 33), (1, 34), (2, 19)) as n(nal_ord, nal_type)
"""


def oracle_sql() -> dict[str, str]:
    return {"detect_files": DETECT_SQL, "probe_files": PROBE_SQL, "inspect_files": INSPECT_SQL, "nal_scan": NAL_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {f.__name__: f for f in (detect_files, probe_files, inspect_files, box_scan, nal_scan, decoded_pixels)}
    return made | {f"{kind}_bytes": _converted(kind) for kind in ("jpeg", "png", "heic")}
