import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.functions import tables
from lumaspark.functions.limits import ImageError, Limits
from lumaspark.operators import encode, hevc
from lumaspark.plans import convert, requests, sql
from lumaspark.sources import files, synthetic


def test_unescape_and_units():
    assert hevc.unescape(bytes([0, 0, 3, 1, 0, 0, 3, 2])) == bytes([0, 0, 1, 0, 0, 2])
    stream = b"\0\0\0\1" + bytes([0x42, 1, 9]) + b"\0\0\1" + bytes([0x44, 1]) + b"\0\0\1\x02"
    assert [(x.kind, x.temporal, x.rbsp) for x in hevc.units(stream)] == [(33, 1, b"\t"), (34, 1, b"")]
    with pytest.raises(ImageError):
        hevc.units(b"\0\0\1\x80\1")


def test_escaping_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        raw = bytes(rng.choice((0, 0, 0, 1, 2, 3, 9)) for _ in range(rng.randrange(40))) + b"\7"
        assert hevc.units(b"\0\0\1" + synthetic.unit(1, raw))[0].rbsp == raw


def test_golomb():
    bits = hevc.Bits(bytes([0b10100110]))
    assert (bits.ue(), bits.ue(), bits.se()) == (0, 1, -1)
    for value in (-70, -3, -1, 0, 1, 2, 5, 1000):
        assert hevc.Bits(synthetic.BitWriter().se(value).bytes()).se() == value
    with pytest.raises(ImageError):
        hevc.Bits(b"\0").read(9)
    assert hevc.Bits(b"\x80").more() is False and hevc.Bits(b"\xc0").more() is True


def test_parameter_sets():
    unit = hevc.units(b"\0\0\1" + synthetic.sequence_unit(40, 24, 10, True, 5))[0]
    sps = hevc.sequence_parameters(unit.rbsp, Limits())
    assert (sps.width, sps.height, sps.bit_depth, sps.ctu_size, sps.min_cb_size, sps.sao) == (40, 24, 10, 32, 8, True)
    pps = hevc.picture_parameters(hevc.units(b"\0\0\1" + synthetic.picture_unit(30))[0].rbsp)
    assert pps.init_qp == 30 and not pps.deblocking_control
    header = hevc.slice_header(hevc.units(b"\0\0\1" + synthetic.slice_unit(b"xyz", True, -3))[0], sps, pps)
    assert (header.kind, header.qp, header.sao_luma, header.first) == ("I", 27, True, True)
    with pytest.raises(ImageError) as e:
        hevc.sequence_parameters(unit.rbsp, Limits(max_width=10))
    assert e.value.code == "LIMIT_DIMENSIONS"
    for n in range(len(unit.rbsp) - 2):
        with pytest.raises(ImageError):
            hevc.sequence_parameters(unit.rbsp[:n], Limits())


def test_ranges_are_monotone():
    rows = hevc.lps_ranges()
    assert rows[0] == (128, 176, 208, 240) and rows[5] == (111, 135, 160, 185) and rows[40] == (18, 22, 26, 30)
    assert all(a[i] >= b[i] for a, b in zip(rows, rows[1:]) for i in range(4))


def encode_bins(bins, states):
    """An arithmetic encoder with exact fractions, to test the decoder."""
    from fractions import Fraction

    low, size, width = Fraction(0), 510, Fraction(1)
    for which, bin_ in bins:
        if which is None:
            half = Fraction(size) * width / 2
            low += half * bin_
            width /= 2
            continue
        context = states[which]
        small = hevc._LPS[context.state][size >> 6 & 3]
        if bin_ == context.likely:
            size -= small
            context.state += context.state < 62
        else:
            low += (size - small) * width
            size = small
            if context.state == 0:
                context.likely = bin_
            context.state = hevc.AFTER_LPS[context.state]
        while size < 256:
            size, width = size * 2, width / 2
    value = low + size * width / 2
    out = int(value * 2**4000)  # nine bits of integer part
    return (out >> 1).to_bytes((4009 + 7) // 8 + 1, "big")[-((4009 - 1 + 7) // 8) :]


def test_arithmetic_decoder_inverts_an_exact_encoder():
    rng = random.Random(2)
    bins = [(rng.choice((None, 0, 1, 2)), rng.randrange(2) if rng.random() < 0.3 else 0) for _ in range(700)]
    make = lambda: [hevc.Context(v, 30) for v in (139, 184, 111)]
    data = encode_bins(bins, make())
    decoder, states = hevc.Arithmetic(data, 0), make()
    assert [decoder.bypass() if w is None else decoder.decide(states[w]) for w, _ in bins] == [b for _, b in bins]


def test_transforms():
    block = np.zeros((4, 4), dtype=np.int64)
    block[0, 0] = 64
    assert (hevc.inverse_transform(block, 8) == 1).all()
    for size in (4, 8, 16, 32):
        m = np.array(tables.dct_matrix(size))
        assert abs(m @ m.T - np.eye(size) * 64 * 64 * size).max() < 64 * 64 * size * 0.02
    assert tables.dct_matrix(8)[1] == [89, 75, 50, 18, -18, -50, -75, -89] and tables.dct_matrix(16)[1][:4] == [90, 87, 80, 70]
    compat = tables.dct_matrix(32, True)
    assert compat[2][16:] == tables.dct_matrix(16)[1] and compat[0] == [64] * 32 and compat[1][0] == 90
    assert hevc.dequantise(np.full((8, 8), 3), 21, 8)[0, 0] == (3 * 57 + 16) >> 5


def test_prediction():
    top, left = np.array([5, 10, 20, 30, 40, 50, 60, 70, 80]), np.full(9, 10)
    assert hevc.predict(np.full(9, 7), np.full(9, 7), 4, 0).tolist() == [[7] * 4] * 4
    assert hevc.predict(np.full(9, 128), np.full(9, 128), 4, 1).tolist() == [[128] * 4] * 4
    vertical = hevc.predict(top, left, 4, 26, luma=False)
    assert vertical.tolist() == [[10, 20, 30, 40]] * 4
    assert (hevc.predict(left, top, 4, 10, luma=False) == vertical.T).all()
    for mode in range(2, 35):
        out = hevc.predict(top, top, 4, mode)
        assert out.shape == (4, 4) and 0 <= out.min() and out.max() <= 80
        assert (hevc.predict(np.full(9, 9), np.full(9, 9), 4, mode) == 9).all()
    assert (hevc.predict(top, left, 4, 34)[0] == [20, 30, 40, 50]).all()


def test_edge_offset_is_in_place():
    y = np.array([[9, 9, 9, 9, 9], [9, 5, 6, 7, 9], [9, 9, 9, 9, 9]])
    hevc.edge_offset(y, 0, (1, 1, 1, 1), 8)
    assert y[1].tolist() == [9, 6, 6, 7, 9] or y[1, 1] == 6


def test_decoding_is_bounded_and_flags_truncation():
    for name, data in synthetic.pictures().items():
        if name.startswith("bad_"):
            with pytest.raises(ImageError):
                convert.decode_picture(data, Limits())
        else:
            pixels, cut = convert.decode_picture(data, Limits())
            assert pixels.dtype == np.uint8 and pixels.shape[2] == 4
            assert cut == (name == "empty_slice") or name != "empty_slice"
    plain, _ = convert.decode_picture(synthetic.pictures()["plain"], Limits())
    turned, _ = convert.decode_picture(synthetic.pictures()["turned"], Limits())
    assert (np.rot90(plain) == turned).all() and plain.std() > 0
    assert convert.decode_picture(synthetic.pictures()["grid"], Limits())[0].shape == (27, 30, 4)
    assert len(np.unique(convert.decode_picture(synthetic.pictures()["masked"], Limits())[0][..., 3])) > 1


def test_reorient_matches_coordinates():
    px = np.arange(6).reshape(3, 2, 1)
    want = {1: [[0, 1], [2, 3], [4, 5]], 2: [[1, 0], [3, 2], [5, 4]], 3: [[5, 4], [3, 2], [1, 0]], 4: [[4, 5], [2, 3], [0, 1]]}
    want |= {5: [[0, 2, 4], [1, 3, 5]], 6: [[4, 2, 0], [5, 3, 1]], 7: [[5, 3, 1], [4, 2, 0]], 8: [[1, 3, 5], [0, 2, 4]]}
    for tag, rows in want.items():
        assert convert.reorient(px, tag)[..., 0].tolist() == rows


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for channels in (3, 4):
        px = rng.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        for compress in (False, True):
            data = encode.png(px, compress=compress)
            at, parts = 8, {}
            while at < len(data):
                size, kind = struct.unpack(">I4s", data[at : at + 8])
                body = data[at + 8 : at + 8 + size]
                assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
                parts[kind] = body
                at += 12 + size
            rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(5, -1)
            assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(5, 7, channels) == px).all()
    assert zlib.decompress(encode.stored_zlib(b"ab" * 70_000)) == b"ab" * 70_000 and zlib.decompress(encode.stored_zlib(b"")) == b""


def test_files_open_in_another_reader(spark, tmp_path):
    yy, xx = np.mgrid[0:21, 0:34]
    px = np.stack((xx * 7 % 256, yy * 11 % 256, (xx + yy) * 4 % 256), axis=2).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(encode.png(px))
    (tmp_path / "b.jpg").write_bytes(encode.jpeg(px, quality=95))
    (tmp_path / "c.jpg").write_bytes(encode.jpeg(px, quality=10))
    rows = {r.image.origin.rsplit("/", 1)[1]: r.image for r in spark.read.format("image").load(str(tmp_path)).collect()}
    assert all((i.height, i.width) == (21, 34) for i in rows.values())
    read = {n: np.frombuffer(i.data, np.uint8).reshape(21, 34, 3)[..., ::-1].astype(int) for n, i in rows.items()}
    assert (read["a.png"] == px).all()
    assert np.abs(read["b.jpg"] - px).mean() < 8 < 60 and np.abs(read["c.jpg"] - px).mean() > np.abs(read["b.jpg"] - px).mean()
    assert len(encode.jpeg(px, quality=10)) < len(encode.jpeg(px, quality=95))


def test_conversion(spark):
    table = files.from_bytes(spark, synthetic.pictures())
    for kind in ("jpeg", "png", "heic", "webp"):
        rows = {r.file_id: r for r in convert.convert(table, {"format": kind}).collect()}
        assert rows["bad_no_stream"].error is not None and rows["bad_length"].error is not None
        if kind == "webp":
            assert {r.error.code for r in rows.values()} >= {"UNSUPPORTED_FORMAT"}
        else:
            start = {"jpeg": b"\xff\xd8", "png": b"\x89PNG", "heic": synthetic.pictures()["plain"]}[kind]
            assert bytes(rows["plain"].data).startswith(start) and rows["plain"].error is None
    raw = {r.file_id: r for r in convert.raw_pixels(table, {"pixelFormat": "bgr8"}).collect()}
    assert raw["plain"].image.nChannels == 3 and len(raw["plain"].image.data) == 40 * 24 * 3
    pixels = convert.image_pixels(convert.raw_pixels(table).where("file_id = 'masked'"))
    assert pixels.count() == 256 and pixels.where("c3 is null or c0 <> c1").count() == 0
    tiles = convert.tile_pictures(table)
    assert tiles.where("file_id = 'grid' and error is null").count() == 4 and tiles.where("error is not null").count() >= 2


def test_options():
    o = convert.Options.of({"type": "image/PNG", "quality": 0.5, "autoRotate": False, "backgroundColor": [300, -1, 7.9], "limits": {"maxPixels": 5}})
    assert (o.format, o.quality, o.apply_orientation, o.background, o.limits.max_pixel_count) == ("png", 50, False, (255, 0, 7), 5)
    assert convert.Options.of({"quality": 1}).quality == 100 and convert.Options.of({"quality": 55.5}).quality == 56
    for bad in ({"format": "gif"}, {"quality": 101}, {"limits": {"x": 1}}, {"pixelFormat": "rgb10"}):
        with pytest.raises(ImageError) as e:
            convert.Options.of(bad)
        assert e.value.code == "INVALID_OPTIONS"


def test_sql_functions(spark):
    """Scalar functions equal the operators over tables; table functions equal the relations of the parse."""
    sql.register(spark)
    table = files.from_bytes(spark, synthetic.pictures() | synthetic.fixtures() | {"bad_empty": b""})
    table.createOrReplaceTempView("pics")
    assert spark.sql("select count(*) n from pics where image_detect(content)").first().n >= 15
    assert spark.sql("select b.* from pics, lateral image_boxes(content) b where file_id = 'plain' and b.box_type = 'ispe'").count() >= 1
    assert spark.sql("select image_convert(content, 'png', 90).data d from pics where file_id = 'turned'").first().d.startswith(b"\x89PNG")
    assert spark.sql("select image_convert(null, 'png', 90).error.code c").first().c is not None
    assert spark.sql("select image_convert(content, 'gif', 90).error.code c from pics where file_id = 'turned'").first().c == "INVALID_OPTIONS"
    by_id = lambda df: sorted(df.collect(), key=str)
    assert by_id(spark.sql("select file_id, p.* from (select file_id, image_probe(content) p from pics)")) == by_id(files.metadata(table))
    assert by_id(spark.sql("select file_id, p.* from (select file_id, image_inspect(content) p from pics)")) == by_id(files.inspect(table))
    raw = convert.raw_pixels(table, {"pixelFormat": "bgr8"}).where("image is not null").select("file_id", "image.data")
    assert by_id(spark.sql("select file_id, p.image.data from (select file_id, image_raw_pixels(content, 'bgr8') p from pics) where p.image is not null")) == by_id(raw)
    assert spark.sql("select image_decode_item(content, 1).image.nChannels n from pics where file_id = 'masked'").first().n == 3
    assert spark.sql("select image_decode_item(content, 99).error.code c from pics where file_id = 'masked'").first().c is not None
    parts = files.tables(files.parse(table))
    for name in ("items", "extents", "properties", "refs"):
        assert by_id(spark.sql(f"select file_id, t.* from pics, lateral image_{name}(content) t")) == by_id(parts[name]), name
    assert spark.sql("select * from image_items(null)").count() == 0


def test_requests(spark, tmp_path):
    """A request gives its result, or an error row for every file if it runs out of time or is called off; others go on."""
    table = files.from_bytes(spark, synthetic.pictures())
    made = requests.Requests(spark, timeout=120)
    good = made.send({"kind": "convert", "table": table, "options": {"format": "png"}, "path": str(tmp_path / "good")})
    assert good.result().where("error is null").count() == 5 and good.error is None and made.pending() == []

    def slow(batches):
        time.sleep(60)
        yield from batches

    stuck = table.mapInArrow(slow, files.FILE_SCHEMA)
    began = time.monotonic()
    late = made.send({"kind": "detect", "table": stuck, "path": str(tmp_path / "late")}, timeout=2)
    signal = requests.Signal()
    off = made.send({"kind": "inspect", "table": stuck, "path": str(tmp_path / "off")}, signal=signal)
    assert set(made.pending()) == {late.id, off.id}
    signal.abort()
    assert {r.error.code for r in off.rows(table).collect()} == {"OPERATION_ABORTED"} and off.rows(table).count() == len(synthetic.pictures())
    with pytest.raises(ImageError) as failed:
        late.result()
    assert failed.value.code == "TIMEOUT" and time.monotonic() - began < 50
    with pytest.raises(ImageError, match="aborted"):
        made.send({"kind": "detect", "table": table, "path": str(tmp_path / "none")}, signal=signal)
    with pytest.raises(ImageError) as unknown:
        made.send({"kind": "print", "table": table, "path": str(tmp_path / "none")})
    assert unknown.value.code == "INVALID_OPTIONS"
    broken = made.send({"kind": "detect", "table": table.select("file_id", F.raise_error(F.lit("x")).cast("binary").alias("content")), "path": str(tmp_path / "broken")})
    with pytest.raises(ImageError) as internal:
        broken.result()
    assert internal.value.code == "INTERNAL_ERROR"
    third = made.send({"kind": "probe", "table": stuck, "path": str(tmp_path / "third")})
    made.close()
    assert third.error["code"] == "OPERATION_ABORTED" and made.pending() == []
    assert requests.shared(spark) is requests.shared(spark)


def test_stream(spark, tmp_path):
    from lumaspark.streaming import watch

    (tmp_path / "in").mkdir()
    for name, data in synthetic.pictures().items():
        (tmp_path / "in" / f"{name}.heic").write_bytes(data)
    found = watch.watch(spark, str(tmp_path / "in"), 3)
    query = watch.convert_stream(found, str(tmp_path / "out"), str(tmp_path / "check"), {"format": "png"}, once=True)
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("error is null").count() == 5
