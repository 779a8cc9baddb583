"""Plans and edge cases of the image operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumaspark.functions import checksums, enums, limits
from lumaspark.operators import blocks, items, pixels
from lumaspark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixel_operators_need_no_shuffle_and_no_python(spark):
    for name in ("px_blocks", "orient_7", "flatten_alpha", "convert_format", "grid_2x2_crop", "grid_orient_flatten", "sao_band", "dequant"):
        text = plan(catalog.queries()[name](spark, SF))
        assert not any(w in text for w in ("Exchange", "Python", "Arrow", "Cartesian")), name


def test_no_cross_joins(spark):
    for name in catalog.oracle_sql():
        assert not any(w in plan(catalog.queries()[name](spark, SF)) for w in ("CartesianProduct", "BroadcastNestedLoop", "Python")), name


def test_scans_read_needed_columns_only(spark):
    text = plan(catalog.queries()["extent_bounds"](spark, SF))
    assert "o_totalprice" in text and "o_orderpriority" not in text and "l_tax" not in text
    assert "PushedFilters: [GreaterThan(p_partkey,0)" in plan(catalog.queries()["prop_join"](spark, SF)).replace(" ,", ",")


def test_transforms_and_edge_offsets_shuffle_once(spark):
    for name in ("idct8", "idct16", "idct32", "dst4", "sao_edge_2"):
        assert plan(catalog.queries()[name](spark, SF)).count("Exchange hashpartitioning") == 1, name


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["image_id", "x", "y", "r", "g", "b"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_limit_order(spark):
    rows = spark.createDataFrame([(5000, 1), (1, 5000), (4000, 3000), (10, 10), (2**40, 2**40)], "w long, h long")
    caps = limits.Limits(max_width=4500, max_height=4500, max_pixel_count=6_000_000)
    got = [r[0] for r in rows.select(limits.dimension_code(F.col("w"), F.col("h"), caps)).collect()]
    assert got == ["LIMIT_DIMENSIONS", "LIMIT_DIMENSIONS", "LIMIT_PIXELS", None, "LIMIT_DIMENSIONS"]
    free = limits.Limits.none()
    assert [r[0] for r in rows.select(limits.dimension_code(F.col("w"), F.col("h"), free)).collect()] == [None] * 4 + ["LIMIT_DIMENSIONS"]
    assert rows.select(limits.memory_bytes(F.col("w"), F.col("h"), F.lit(4)).alias("m")).collect()[4].m is None


@pytest.mark.parametrize(("data", "want"), [(b"", 1), (b"abc", 0x024D0127), (b"\xff" * 5000, None)])
def test_adler(spark, data, want):
    import zlib

    text = data.decode("latin-1")
    got = checksums.adler32_rows(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").first().adler32
    assert got == zlib.adler32(text.encode()) and want in (None, got)


def test_framing(spark):
    import struct
    import zlib

    row = spark.createDataFrame([(bytearray(b"abc"),)], "d binary").select(
        checksums.png_chunk("tEXt", F.col("d")).alias("c"), checksums.riff_webp(F.col("d")).alias("r"), checksums.read_uint(F.col("d"), 1, 2).alias("u"), checksums.read_uint(F.col("d"), 2, 4).alias("n")
    ).first()
    assert bytes(row.c) == struct.pack(">I", 3) + b"tEXtabc" + struct.pack(">I", zlib.crc32(b"tEXtabc"))
    assert bytes(row.r) == b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8L" + struct.pack("<I", 3) + b"abc\0"
    assert row.u == 0x6263 and row.n is None


def test_pixel_edges(spark):
    px = spark.createDataFrame([(1, x, y, 10 * y + x) for y in range(3) for x in range(2)], "image_id long, x long, y long, v long")
    with pytest.raises(ValueError):
        pixels.orient(px, 9, 2, 3)
    with pytest.raises(ValueError):
        pixels.convert_format(px.withColumnRenamed("v", "c0"), "rgb10", "rgb8")
    for tag in range(1, 9):
        back = {6: 8, 8: 6}.get(tag, tag)
        w, h = pixels.oriented_size(2, 3, tag)
        again = pixels.orient(pixels.orient(px, tag, 2, 3), back, w, h)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, px.collect()))
    one = spark.createDataFrame([(1, 0, 0, 255, 0, 0, 128)], "image_id long, x long, y long, r long, g long, b long, a long")
    assert tuple(pixels.flatten_alpha(one).first())[3:] == (255, 127, 127)


def test_run_lengths(spark):
    values = [9] + [0] * 20 + [-3] + [0] * 2 + [1] + [0] * 39
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "block_id long, i long, v long")
    got = [(r.i, r.v, r.run, r.skips, r.bits) for r in blocks.run_lengths(rows).orderBy("i").collect()]
    assert got == [(21, -3, 4, 1, 2), (24, 1, 2, 0, 1)]


def test_relations_with_broken_references(spark):
    assoc = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 1, 9), (1, 1, 2, 2), (1, 2, 0, 1)], "file_id long, item_id long, assoc_ord int, prop_idx int")
    props = spark.createDataFrame([(1, 1, "ispe", 5), (1, 2, "ispe", 7)], "file_id long, prop_idx int, kind string, w long")
    joined = items.item_properties(assoc, props)
    assert joined.count() == 2
    first = items.first_property(joined, "ispe", "w", "w")
    assert {(r.item_id, r.w) for r in first.collect()} == {(1, 7), (2, 5)}
    tiles = spark.createDataFrame([(1, 9, 0, 4)], "file_id long, from_item_id long, to_ord int, to_item_id long")
    lengths = spark.createDataFrame([], "file_id long, item_id long, total_length long")
    assert items.tile_payloads(tiles, lengths).first().code == "INVALID_CONTAINER"


def test_extents_in_order_and_exif(spark):
    rows = spark.createDataFrame([(1, 1, 1, bytearray(b"cd")), (1, 1, 0, bytearray(b"ab")), (1, 2, 0, bytearray(b"\0\0\0\1xII")), (1, 3, 0, bytearray(b"\0\0\0\x09z"))], "file_id long, item_id long, extent_ord int, b binary")
    got = {r.item_id: r for r in items.joined_extents(rows, F.col("b")).withColumn("exif", items.exif_payload(F.col("data"))).collect()}
    assert bytes(got[1].data) == b"abcd" and bytes(got[2].exif) == b"II" and bytes(got[3].exif) == bytes(got[3].data)


def test_enums(spark):
    row = spark.range(1).select(enums.output_format(F.lit(" IMAGE/JPG ")).alias("a"), enums.nal_name(F.lit(33)).alias("b"), enums.nal_is_slice(F.lit(19)).alias("c"), enums.orientation(F.lit(9)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("jpeg", "SPS", True, None)
