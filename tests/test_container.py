import struct

import pytest
from pyspark.sql import functions as F

from lumaspark.functions.limits import ImageError, Limits
from lumaspark.plans import convert
from lumaspark.sources import container, files, synthetic


@pytest.fixture(scope="module")
def rows(spark):
    named = synthetic.fixtures() | {"bad_empty": b""}
    found = files.metadata(files.from_bytes(spark, named)).collect()
    assert len(found) == len(named)
    return {r.file_id: r for r in found}


def test_sound_files(rows):
    assert all((r.error is None) != name.startswith("bad_") for name, r in rows.items())
    r = rows["still_12mp"]
    assert (r.major_brand, r.width, r.height, r.is_grid, r.has_alpha, r.item_count) == ("heic", 4032, 3024, False, False, 1)
    r = rows["grid_4x4"]
    assert (r.is_grid, r.grid_rows, r.grid_columns, r.width, r.height, r.item_count) == (True, 4, 4, 2048, 2048, 17)
    assert (rows["grid_1x2"].grid_rows, rows["grid_1x2"].grid_columns) == (1, 2)
    assert (rows["alpha"].has_alpha, rows["alpha"].alpha_item_id, rows["alpha"].primary_item_id) == (True, 2, 1)
    assert rows["wide_gamut"].color_space == "display-p3" and rows["plain"].color_space == "srgb"
    assert (rows["burst"].item_count, rows["burst"].primary_item_id) == (4, 1)
    assert [rows[f"rotation_{t}"].orientation for t in range(4)] == [1, 8, 3, 6]
    assert rows["plain"].orientation is None and rows["brand_mif1"].width == 800
    assert (rows["no_primary"].primary_item_id, rows["no_primary"].exif_item_id, rows["no_primary"].height) == (9, 7, 20)


@pytest.mark.parametrize(
    ("name", "code"),
    [
        ("bad_other", "UNSUPPORTED_FORMAT"), ("bad_truncated", "UNSUPPORTED_FORMAT"), ("bad_huge_box", "UNSUPPORTED_FORMAT"), ("bad_empty", "UNSUPPORTED_FORMAT"),
        ("bad_extent", "MALFORMED_INPUT"), ("bad_dimensions", "LIMIT_DIMENSIONS"), ("bad_no_meta", "INVALID_CONTAINER"), ("bad_trailing", "MALFORMED_INPUT"), ("bad_tile_count", "INVALID_CONTAINER"),
    ],
)
def test_broken_files(rows, name, code):
    assert rows[name].error.code == code


def test_limits(spark):
    one = files.from_bytes(spark, {"x": synthetic.single(1920, 1080)})
    assert files.metadata(one, Limits(max_pixel_count=2_000_000)).first().error.code == "LIMIT_PIXELS"
    assert files.metadata(one, Limits.none()).first().error is None
    assert files.metadata(one, Limits(max_file_size=10)).first().error.code == "LIMIT_INPUT_BYTES"


def test_detection_equals_the_kernel(spark):
    named = synthetic.fixtures() | {"": b"", "zero": b"\0\0\0\0ftypheic\0\0\0\0", "long": b"\0\0\0\1ftyp" + (24).to_bytes(8, "big") + b"heic\0\0\0\0", "short": b"\0\0\0\x0cftypheic"}
    got = {r.file_id: r.detected for r in files.detect(files.from_bytes(spark, named)).collect()}
    assert got == {k: container.detect(v) for k, v in named.items()}


def test_every_truncation_fails_cleanly():
    for data in (synthetic.fixtures()["alpha"], synthetic.tiled(1, 2, 20, 10)):
        for n in range(len(data)):
            with pytest.raises(ImageError):
                found = container.parse(data[:n], Limits())
                for item in found.items:
                    container.item_data(data[:n], found, item)


def test_boxes_and_payloads(spark):
    data = synthetic.single(4, 4, b"payload")
    found = files.scan_boxes(files.from_bytes(spark, {"a": data, "b": data[:-3]}))
    kinds = [r.box_type for r in found.where("file_id = 'a'").orderBy("ord").collect()]
    assert kinds == ["ftyp", "meta", "hdlr", "pitm", "iinf", "iprp", "ipco", "ispe", "ipma", "iloc", "mdat"]
    broken = found.where("file_id = 'b'").collect()
    assert {r.error.code for r in broken} == {"MALFORMED_INPUT"}
    parsed = container.parse(data, Limits())
    assert container.item_data(data, parsed, 1) == b"payload"


def test_fail_fast(spark):
    with pytest.raises(Exception, match="UNSUPPORTED_FORMAT"):
        files.parse(files.from_bytes(spark, {"x": b"nope"}), fail_fast=True).collect()


def test_scan_reads_files(spark, tmp_path):
    for name, data in list(synthetic.fixtures().items())[:3]:
        (tmp_path / f"{name}.heic").write_bytes(data)
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 3
    assert files.metadata(found).where("error is null").count() == 3
    capped = Limits(max_file_size=5)
    large = files.scan(spark, str(tmp_path), capped)
    assert large.where("content is null and length > 5").count() == 3
    assert {r.error.code for r in files.metadata(large, capped).collect()} == {"LIMIT_INPUT_BYTES"}
    assert {r.error.code for r in convert.convert(large, convert.Options(limits=capped)).collect()} == {"LIMIT_INPUT_BYTES"}


def test_nested_boxes_and_broken_files_are_error_rows(spark):
    """Deep nesting ends that file only, whatever is wrong with it."""
    deep = b""
    for _ in range(3_000):
        deep = struct.pack(">I4s", len(deep) + 8, b"iprp") + deep
    with pytest.raises(ImageError, match="nested"):
        container.walk(deep)
    good = next(iter(synthetic.fixtures().values()))
    table = files.from_bytes(spark, {"deep": deep, "junk": bytes(range(256)) * 9, "good": good, "cut": good[: len(good) // 2], "none": b""})
    rows = {r.file_id: r for r in files.scan_boxes(table).groupBy("file_id").agg(F.max("error").alias("error"), F.count("ord").alias("n")).collect()}
    assert rows["deep"].error.code == "INVALID_CONTAINER" and rows["deep"].n == container.MOST_DEPTH + 1 and rows["good"].error is None
    found = {r.file_id: r.error for r in files.metadata(table).collect()}
    assert found["good"] is None and all(found[k] is not None for k in ("deep", "junk", "cut", "none"))


def test_metadata_is_one_pass_and_equals_the_joins(spark):
    """The kernel's rows are those that joins of the relations give, for whole and for cut files."""
    named = synthetic.fixtures() | synthetic.pictures() | {"bad_empty": b""}
    named |= {f"{name}_cut_{n}": data[:-n] for name, data in synthetic.fixtures().items() for n in (1, 9) if len(data) > 40}
    table = files.from_bytes(spark, named)
    for limits in (Limits(), Limits(max_width=1500), Limits.none()):
        found = files.metadata(table, limits)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
        joined = files.joined_metadata(files.parse(table, limits), limits)
        assert found.columns == joined.columns
        assert sorted(found.collect(), key=lambda r: r.file_id) == sorted(joined.collect(), key=lambda r: r.file_id)


def test_dangling_rows_of_a_file(spark):
    """Associations and extents of items that do not exist count for nothing; an undeclared size is zero."""
    row = {"error": None, "items": [{"item_id": 5, "item_type": "hvc1"}], "declared_primary": 4, "properties": [{"prop_idx": 1, "kind": "ispe", "width": 10**6, "height": 1}]}
    row |= {"assoc": [{"item_id": 4, "assoc_ord": 0, "prop_idx": 1}, {"item_id": 5, "assoc_ord": 0, "prop_idx": 9}], "refs": [], "major_brand": "heic", "compatible_brands": []}
    row |= {"extents": [{"item_id": 4, "construction_method": 0, "base_offset": 0, "offset": 0, "length": 10**9}]}
    held, files.record = files.record, lambda *_: row
    try:
        got = files.describe("x", 10, b"")
    finally:
        files.record = held
    assert (got["error"], got["width"], got["height"], got["primary_item_id"], got["item_count"], got["has_alpha"]) == (None, 0, 0, 4, 1, False)
