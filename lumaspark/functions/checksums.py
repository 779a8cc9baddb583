"""Checksums and byte framing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADLER = 65_521
#: Bytes of a text that are summed together.
BLOCK = 4_096
STORED = 65_535


def u16_be(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 4, "0"))


def u32_be(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def u32_le(value: Column) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def read_uint(content: Column, offset: Column | int, size: int) -> Column:
    """An unsigned big-endian number of up to 7 bytes at a byte offset; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.octet_length(content) >= at + size, F.conv(F.hex(F.substr(content, at + 1, F.lit(size))), 16, 10).cast("long"))


def png_chunk(kind: str, data: Column) -> Column:
    """Length, type, data and CRC of the latter two."""
    body = F.concat(F.lit(kind.encode()), data)
    return F.concat(u32_be(F.octet_length(data)), body, u32_be(F.crc32(body)))


def riff_webp(payload: Column) -> Column:
    """A RIFF file with one lossless chunk, padded to an even size."""
    pad = F.when(F.octet_length(payload) % 2 == 1, F.lit(b"\x00")).otherwise(F.lit(b""))
    chunk = F.concat(F.lit(b"WEBPVP8L"), u32_le(F.octet_length(payload)), payload, pad)
    return F.concat(F.lit(b"RIFF"), u32_le(F.octet_length(chunk)), chunk)


def adler32_rows(texts: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, adler32)`` of UTF-8 texts, one row for each row: both running sums in closed form, as two sums over byte positions.

    Texts are cut into blocks of BLOCK bytes, blocks into bytes, and each byte is counted plainly and weighted by its place from the
    text's end. So a text of n bytes costs n steps, a row carries no more than a block, and sums are combined before the shuffle."""
    data = texts.select(F.col(key), F.encode(F.col(value), "UTF-8").alias("b"), F.monotonically_increasing_id().alias("row")).withColumn("n", F.octet_length("b").cast("long"))
    places = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.lit(0), F.col("n") - 1) / BLOCK))
    cut = data.select(key, "row", "n", F.posexplode(F.transform(places, lambda i: F.substr("b", (i * BLOCK + 1).cast("int"), F.lit(BLOCK)))).alias("block", "b"))
    chars = F.split(F.decode("b", "ISO-8859-1"), "")
    rows = cut.select(key, "row", "n", (F.col("n") - F.col("block") * BLOCK).alias("left"), F.posexplode(chars).alias("i", "c"))
    value_ = F.ascii("c").cast("long")
    whole = rows.groupBy(key, "row", "n").agg(F.sum(value_).alias("plain"), F.sum(value_ * (F.col("left") - F.col("i"))).alias("weighted"))
    low, high = (1 + F.col("plain")) % ADLER, (F.col("n") + F.col("weighted")) % ADLER
    return whole.select(key, (high * 65_536 + low).cast("long").alias("adler32"))


def stored_blocks(size: Column) -> Column:
    """Lengths of the uncompressed blocks that hold ``size`` bytes; one empty block for none."""
    count = F.greatest(F.lit(1), F.ceil(size / STORED)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.least(F.lit(STORED).cast("long"), size - i * STORED))
