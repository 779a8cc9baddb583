"""Geometry and colour over pixel relations.

A pixel relation has a key (``image_id`` by default), integer ``x`` and ``y``, and one column per channel. Every operator is a
projection or a keyed join, so plans stay in generated code and partition by image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.tables import TRANSPOSING


def level(sample: Column) -> Column:
    """The level 0 to 255 of a sample in [-0.5, 0.5). Single samples stay single, as in SQL: in double precision those just below a level
    would fall to the one before."""
    single = lambda v: F.lit(v).cast("float")
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (sample + single(0.5)) * single(255)))).cast("long")


def from_arrays(images: DataFrame, key: str, samples: str, width: int) -> DataFrame:
    """``(image_id, x, y, v)`` from an array of samples in [-0.5, 0.5) per image, row by row."""
    rows = images.select(F.col(key).alias("image_id"), F.posexplode(samples).alias("pos", "s"))
    return rows.select("image_id", (F.col("pos") % width).cast("long").alias("x"), F.floor(F.col("pos") / width).cast("long").alias("y"), level(F.col("s")).alias("v"))


def orient_xy(x: Column, y: Column, width: Column | int, height: Column | int, orientation: int) -> tuple[Column, Column]:
    """Where a pixel goes under an EXIF orientation tag."""
    right, down = F.lit(width) - 1 - x, F.lit(height) - 1 - y
    places = {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}
    if orientation not in places:
        raise ValueError(f"orientation {orientation} is not in 1 to 8")
    return places[orientation]


def orient(pixels: DataFrame, orientation: int, width: Column | int, height: Column | int) -> DataFrame:
    """Rotate and mirror a picture of the given size."""
    x, y = orient_xy(F.col("x"), F.col("y"), width, height, orientation)
    return pixels.withColumns({"x": x.cast("long"), "y": y.cast("long")})


def oriented_size(width: int, height: int, orientation: int) -> tuple[int, int]:
    return (height, width) if orientation in TRANSPOSING else (width, height)


def assemble_grid(tiles: DataFrame, ordinal: str, columns: int, tile_width: int, tile_height: int, width: int, height: int) -> DataFrame:
    """Tiles of one picture, numbered by row, on one canvas; what lies beyond ``width`` and ``height`` is cut off."""
    x = F.col("x") + (F.col(ordinal) % columns) * tile_width
    y = F.col("y") + F.floor(F.col(ordinal) / columns) * tile_height
    placed = tiles.withColumns({"x": x.cast("long"), "y": y.cast("long")}).drop(ordinal)
    return crop(placed, width, height)


def crop(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.where((F.col("x") < width) & (F.col("y") < height))


def blit(canvas: DataFrame, patch: DataFrame, x: int, y: int, width: int, height: int, keys: Sequence[str] = ("image_id",), channels: Sequence[str] = ("v",)) -> DataFrame:
    """Copy a patch onto a canvas of the given size at (x, y); parts outside are clipped."""
    moved = patch.withColumns({"x": F.col("x") + x, "y": F.col("y") + y}).where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    moved = moved.select(*keys, "x", "y", *[F.col(c).alias(f"_{c}") for c in channels], F.lit(True).alias("_set"))
    joined = canvas.join(moved, [*keys, "x", "y"], "left")
    return joined.select(*keys, "x", "y", *[F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in channels])


def fill(pixels: DataFrame, **channels: int) -> DataFrame:
    return pixels.withColumns({c: F.lit(v).cast("long") for c, v in channels.items()})


def get_pixel(pixels: DataFrame, x: int, y: int) -> DataFrame:
    """The pixel of each picture at a place; no row where it lies outside."""
    return pixels.where((F.col("x") == x) & (F.col("y") == y))


def set_pixel(pixels: DataFrame, x: int, y: int, **channels: int) -> DataFrame:
    here = (F.col("x") == x) & (F.col("y") == y)
    return pixels.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in channels.items()})


def canvas(images: DataFrame, width: Column, height: Column, **channels: int) -> DataFrame:
    """Pictures of one colour: a row per pixel of each image row."""
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), height.cast("long") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1)))
    return rows.withColumns({c: F.lit(v).cast("long") for c, v in channels.items()})


def flatten(channel: Column, alpha: Column, background: int) -> Column:
    """A channel over an opaque background, rounded, in integers."""
    total = channel * alpha + F.lit(background) * (F.lit(255) - alpha) + 127
    return F.floor(total / 255).cast("long")


def flatten_alpha(pixels: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Composite ``r, g, b, a`` over a background; ``a`` goes."""
    return pixels.withColumns({c: flatten(F.col(c), F.col("a"), b) for c, b in zip("rgb", background, strict=True)}).drop("a")


def merge_alpha(color: DataFrame, alpha: DataFrame, keys: Sequence[str] = ("image_id",), alpha_channel: str = "v") -> DataFrame:
    """Give each pixel the value of the mask's pixel at the same place."""
    mask = alpha.select(*keys, "x", "y", F.col(alpha_channel).alias("a"))
    return color.drop("a").join(mask, [*keys, "x", "y"])


def convert_format(pixels: DataFrame, source: str, target: str) -> DataFrame:
    """Reorder channels ``c0, c1, ...`` between rgb8, rgba8, bgr8 and bgra8; a missing alpha is 255."""
    orders = {"rgb8": "rgb", "rgba8": "rgba", "bgr8": "bgr", "bgra8": "bgra"}
    if source not in orders or target not in orders:
        raise ValueError("UNSUPPORTED_FEATURE: only 8-bit formats are converted")
    have = {c: F.col(f"c{i}") for i, c in enumerate(orders[source])}
    rest = [c for c in pixels.columns if c not in {f"c{i}" for i in range(4)}]
    return pixels.select(*rest, *[have.get(c, F.lit(255).cast("long")).alias(f"c{i}") for i, c in enumerate(orders[target])])


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """Integer conversion with ten fractional bits; chroma is centred at 128."""
    b, r, luma = cb - 128, cr - 128, y * 1024 + 512
    clamp = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(v, 10))).cast("long")
    return {"r": clamp(luma + 1436 * r), "g": clamp(luma - 352 * b - 731 * r), "b": clamp(luma + 1814 * b)}


def upsampled_rgb(luma: DataFrame, cb: DataFrame, cr: DataFrame, key: str = "image_id") -> DataFrame:
    """Colour of 4:2:0 planes: chroma is looked up at half of x and y."""
    half = lambda p, name: p.select(key, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("v").alias(name))
    placed = luma.withColumns({"cx": F.shiftright("x", 1), "cy": F.shiftright("y", 1)})
    joined = placed.join(half(cb, "cb"), [key, "cx", "cy"]).join(half(cr, "cr"), [key, "cx", "cy"])
    return joined.select(key, "x", "y", *[c.alias(n) for n, c in ycbcr_to_rgb(F.col("v"), F.col("cb"), F.col("cr")).items()])


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """JPEG luma and chroma, level-shifted to be centred at zero."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    return {
        "luma": F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b - F.lit(128.0),
        "cb": F.lit(-0.168736) * r - F.lit(0.331264) * g + F.lit(0.5) * b,
        "cr": F.lit(0.5) * r - F.lit(0.418688) * g - F.lit(0.081312) * b,
    }
