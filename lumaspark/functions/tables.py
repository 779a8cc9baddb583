"""Fixed values of formats and codecs, as plain lists and small DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# Container brands that are accepted.
BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "heis", "avic")

# Item types that carry a picture.
PICTURE_TYPES = ("hvc1", "grid")

# Fixed values: (name, channels, bit depth, bytes per channel, has alpha).
PIXEL_FORMATS = (
    ("rgb8", 3, 8, 1, False),
    ("rgba8", 4, 8, 1, True),
    ("rgb10", 3, 10, 2, False),
    ("rgba10", 4, 10, 2, True),
    ("bgr8", 3, 8, 1, False),
    ("bgra8", 4, 8, 1, True),
)

# Fixed values: (name, MIME type, file extension, keeps alpha).
OUTPUT_FORMATS = (
    ("jpeg", "image/jpeg", "jpg", False),
    ("png", "image/png", "png", True),
    ("webp", "image/webp", "webp", True),
    ("heic", "image/heic", "heic", True),
)

# EXIF orientation tags, whether width and height swap, and the counter-clockwise quarter turns that map to them.
ORIENTATIONS = tuple(range(1, 9))
TRANSPOSING = (5, 6, 7, 8)
QUARTER_TURNS = {0: 1, 1: 8, 2: 3, 3: 6}

# Colour primaries codes.
PRIMARIES = {1: "srgb", 12: "display-p3", 9: "rec2020"}

# NAL unit types by number.
NAL_TYPES = {
    0: "TRAIL_N", 1: "TRAIL_R", 16: "BLA_W_LP", 17: "BLA_W_RADL", 18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT",
    32: "VPS", 33: "SPS", 34: "PPS", 35: "AUD", 36: "EOS", 37: "EOB", 38: "FD", 39: "PREFIX_SEI", 40: "SUFFIX_SEI",
}

# Cosine magnitudes of the integer transform, by multiples of pi/64; beyond 32 they mirror with changed sign.
COSINES = (64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)

# The sine transform of 4x4 intra luma blocks.
DST4 = ((29, 55, 74, 84), (74, 74, 0, -74), (84, -29, -74, 55), (55, -84, 74, -29))

# Scale of dequantisation by qp modulo 6.
LEVEL_SCALE = (40, 45, 51, 57, 64, 72)

# Prediction angles of modes 2 to 34, and their inverses for modes 11 to 25.
ANGLES = (32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32)
INVERSE_ANGLES = (-4096, -1638, -910, -630, -482, -390, -315, -256, -315, -390, -482, -630, -910, -1638, -4096)

# Deblocking thresholds by qp.
BETA = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 42,
    44, 46, 48, 50, 52, 54, 56, 58, 60, 62, 64,
)
TC = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11,
    13, 14, 16, 18, 20, 22, 24,
)

# The luma and chroma quantisation tables of baseline JPEG, row by row.
JPEG_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
JPEG_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def zigzag(size: int = 8) -> list[int]:
    """Row-major places of a square block in zigzag order: by antidiagonals, alternately up and down."""
    cells = [(y, x) for y in range(size) for x in range(size)]
    cells.sort(key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 == 0 else c[0]))
    return [y * size + x for y, x in cells]


def cosine(step: int) -> int:
    """Integer cosine of ``step * pi / 64``."""
    step %= 128
    if step > 64:
        step = 128 - step
    return COSINES[step] if step < 32 else (0 if step == 32 else -COSINES[64 - step])


def dct_matrix(size: int, compat: bool = False) -> list[list[int]]:
    """Rows are frequencies. ``compat`` gives the 32-point matrix some decoders use: even rows repeat the 16-point
    matrix instead of mirroring it, odd rows are rounded from 90.5 times the cosine."""
    rows = [[cosine(k * (2 * n + 1) * (32 // size)) for n in range(size)] for k in range(size)]
    if compat and size == 32:
        half = dct_matrix(16)
        for k in range(32):
            for n in range(32):
                if k % 2 == 0:
                    rows[k][n] = half[k // 2][n % 16]
                else:
                    rows[k][n] = math.floor(abs(90.5 * math.cos((2 * n + 1) * k * math.pi / 64)) + 0.5) * (1 if math.cos((2 * n + 1) * k * math.pi / 64) >= 0 else -1)
    return rows


def pixel_formats(spark: SparkSession) -> DataFrame:
    rows = [(name, c, d, b, c * b, a) for name, c, d, b, a in PIXEL_FORMATS]
    return spark.createDataFrame(rows, "format string, channels int, bit_depth int, bytes_per_channel int, bytes_per_pixel int, has_alpha boolean")


def output_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OUTPUT_FORMATS), "format string, mime string, extension string, supports_alpha boolean")


def matrix(spark: SparkSession, rows: list[list[int]]) -> DataFrame:
    """``(k, n, c)``: a transform matrix as a relation; at most 1024 rows."""
    return spark.createDataFrame([(k, n, c) for k, row in enumerate(rows) for n, c in enumerate(row)], "k long, n long, c long")
