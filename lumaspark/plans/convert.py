"""Conversion of whole files: detection, metadata, raw pixels, and JPEG or PNG.

Every function takes a table ``(file_id, length, content)`` and returns one row per file, so it works with ``DataFrame.transform``, on
streams, and from SQL. One file is the unit of work: entropy coding is sequential within a picture, so files (and, with
``tile_pictures``, tiles) are what runs in parallel. A failing file gives an error row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.limits import ImageError, Limits
from lumaspark.functions.tables import OUTPUT_FORMATS, QUARTER_TURNS
from lumaspark.operators import encode, hevc
from lumaspark.sources import container, files

MIME = {name: mime for name, mime, _, _ in OUTPUT_FORMATS}
#: Spark's image modes (OpenCV types) by pixel format.
IMAGE_MODES = {"rgb8": 16, "bgr8": 16, "rgba8": 24, "bgra8": 24}
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
ERROR = "struct<code:string,message:string>"


@dataclass(frozen=True)
class Options:
    """Choices of a conversion. ``of`` reads them from a dictionary with the usual aliases."""

    format: str = "jpeg"
    quality: int = 90
    apply_orientation: bool = True
    background: tuple[int, int, int] = (255, 255, 255)
    pixel_format: str = "rgba8"
    compress: bool = False
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def of(cls, given: dict | None = None) -> Options:
        """Unknown formats, qualities and limits raise INVALID_OPTIONS. Qualities up to 1 are fractions; of colours, which are cut to
        0 to 255, the first three numbers count."""
        given, out = dict(given or {}), {}
        name = given.get("format", given.get("type"))
        if name is not None:
            name = str(name).strip().lower().removeprefix("image/")
            name = "jpeg" if name == "jpg" else name
            if name not in MIME:
                raise ImageError("INVALID_OPTIONS", f"output format {name!r}")
            out["format"] = name
        if given.get("quality") is not None:
            quality = float(given["quality"])
            if not 0 <= quality <= 100:
                raise ImageError("INVALID_OPTIONS", "quality is not in 0 to 1 or 1 to 100")
            out["quality"] = min(100, max(1, int(quality * (100 if quality <= 1 else 1) + 0.5)))
        turn = given.get("applyOrientation", given.get("autoRotate"))
        if isinstance(turn, bool):
            out["apply_orientation"] = turn
        color = given.get("backgroundColor")
        if isinstance(color, list | tuple) and len(color) >= 3:
            out["background"] = tuple(int(min(255, max(0, c))) for c in color[:3])
        if given.get("pixelFormat") is not None:
            if given["pixelFormat"] not in IMAGE_MODES:
                raise ImageError("INVALID_OPTIONS", f"pixel format {given['pixelFormat']!r}")
            out["pixel_format"] = given["pixelFormat"]
        caps = {"maxInputBytes": "max_file_size", "maxFileSize": "max_file_size", "maxWidth": "max_width", "maxHeight": "max_height", "maxPixels": "max_pixel_count"}
        caps |= {"maxPixelCount": "max_pixel_count", "maxMemoryBytes": "max_memory_bytes", "maxItemCount": "max_item_count", "maxTileCount": "max_tile_count"}
        found = {}
        for key, value in (given.get("limits") or {}).items():
            if key not in caps or (value is not None and (not isinstance(value, int) or value < 0)):
                raise ImageError("INVALID_OPTIONS", f"limit {key}={value!r}")
            found[caps[key]] = value
        if found:
            out["limits"] = Limits().with_(**found)
        return cls(**out)


def reorient(pixels: np.ndarray, tag: int) -> np.ndarray:
    """Apply an EXIF orientation tag to rows of pixels."""
    if tag in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if tag in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if tag in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def assemble(tiles: list[np.ndarray], rows: int, columns: int, width: int, height: int, limits: Limits) -> np.ndarray:
    """Equal tiles by rows on one canvas, cut on the right and below; what no tile covers is zero."""
    if len(tiles) != rows * columns or not tiles:
        raise ImageError("MALFORMED_INPUT", f"{len(tiles)} tiles for a grid of {rows}x{columns}")
    if any(t.shape != tiles[0].shape for t in tiles):
        raise ImageError("MALFORMED_INPUT", "tiles differ in size")
    limits.check_memory(width * height * tiles[0].shape[2])
    whole = np.concatenate([np.concatenate(tiles[r * columns : (r + 1) * columns], axis=1) for r in range(rows)])[:height, :width]
    out = np.zeros((height, width, whole.shape[2]), dtype=np.uint8)
    out[: whole.shape[0], : whole.shape[1]] = whole
    return out


def flatten(pixels: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    color, alpha = pixels[..., :3].astype(np.int64), pixels[..., 3:].astype(np.int64)
    return ((color * alpha + np.array(background) * (255 - alpha) + 127) // 255).astype(np.uint8)


def decode_picture(content: bytes, limits: Limits, apply_orientation: bool = True) -> tuple[np.ndarray, bool]:
    """(RGBA pixels, truncated): primary picture or grid, its alpha plane's luma as alpha, turned by its rotation."""
    found = container.parse(content, limits)
    primary = files.primary_of(found)
    if primary is None:
        raise ImageError("INVALID_CONTAINER", "no primary item")
    cut = False

    def picture(item: int) -> np.ndarray:
        nonlocal cut
        frame = hevc.decode(container.annex_b(content, found, item), limits)
        cut = cut or frame.truncated
        return frame.rgb()

    if found.items.get(primary, {}).get("item_type") == "grid":
        rows, columns, width, height = container.grid(container.item_data(content, found, primary), limits)
        rgb = assemble([picture(t) for t in files.tiles_of(found, primary)], rows, columns, width, height, limits)
    else:
        rgb = picture(primary)
    alpha = np.full((*rgb.shape[:2], 1), 255, dtype=np.uint8)
    mask = alpha_item(found, primary)
    if mask is not None:
        plane = picture(mask)[..., :1]
        if plane.shape[:2] != rgb.shape[:2]:
            raise ImageError("INVALID_INPUT", f"alpha of {plane.shape[:2]} for a picture of {rgb.shape[:2]}")
        alpha = plane
    out = np.concatenate((rgb, alpha), axis=2)
    turn = container.item_property(found, primary, "irot")
    return (reorient(out, QUARTER_TURNS[turn["angle_ccw"]]) if apply_orientation and turn else out), cut


def alpha_item(found: container.Parsed, primary: int) -> int | None:
    """The source of the first alpha edge to the primary item, else the smallest other item marked as alpha."""
    for edge in found.references or []:
        if edge["ref_type"] == "auxl" and primary in edge["to_item_ids"]:
            return edge["from_item_id"]
    marked = []
    for item in found.items:
        prop = container.item_property(found, item, "auxC")
        if item != primary and prop and files.alpha_urn(prop["aux_type"]):
            marked.append(item)
    return min(marked, default=None)


def _per_file(work, schema: pa.Schema, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "length", "content")), strict=True):
                try:
                    if content is None and limits.max_file_size is not None and (length or 0) > limits.max_file_size:
                        raise ImageError("LIMIT_INPUT_BYTES", f"{length} bytes")
                    row = {"file_id": name, "error": None} | work(name, content or b"")
                except Exception as e:  # whatever is wrong with one file is that file's error
                    row = {"file_id": name, "error": files.failure(e)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _apply(table: DataFrame, work, schema: str, limits: Limits) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    length = F.col("length") if "length" in table.columns else F.octet_length("content").cast("long")
    return table.select("file_id", length.alias("length"), "content").mapInArrow(_per_file(work, to_arrow_schema(_parse_datatype_string(schema)), limits), schema)


def checked(content: bytes, limits: Limits) -> bytes:
    if limits.max_file_size is not None and len(content) > limits.max_file_size:
        raise ImageError("LIMIT_INPUT_BYTES", f"{len(content)} bytes")
    return content


def convert(table: DataFrame, options: Options | dict | None = None) -> DataFrame:
    """``(file_id, mime, width, height, data, truncated, error)``. JPEG is flattened onto the background; ``heic`` returns the input
    if it decodes."""
    chosen = options if isinstance(options, Options) else Options.of(options)

    def work(name: str, content: bytes) -> dict:
        pixels, cut = decode_picture(checked(content, chosen.limits), chosen.limits, chosen.apply_orientation)
        if chosen.format == "heic":
            data = content
        else:
            flat = flatten(pixels, chosen.background) if chosen.format == "jpeg" else pixels
            data = encode.ENCODERS[chosen.format](flat, quality=chosen.quality, compress=chosen.compress)
        return {"mime": MIME[chosen.format], "width": pixels.shape[1], "height": pixels.shape[0], "data": data, "truncated": cut}

    return _apply(table, work, f"file_id string, mime string, width int, height int, data binary, truncated boolean, error {ERROR}", chosen.limits)


def raw_pixels(table: DataFrame, options: Options | dict | None = None) -> DataFrame:
    """``(file_id, image, error)``: decoded pixels in Spark's image structure."""
    chosen = options if isinstance(options, Options) else Options.of(options)

    return _apply(table, lambda name, content: {"image": raw_image(name, content, chosen)}, f"file_id string, image {IMAGE}, error {ERROR}", chosen.limits)


def tile_pictures(table: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(file_id, tile_ord, image, error)``: the pictures of a file's grid (or its one picture) as rows, each decoded by itself, so the
    tiles of one file spread over tasks."""

    def split(name: str, content: bytes) -> dict:
        found = container.parse(checked(content, limits), limits)
        primary = files.primary_of(found)
        if primary is None:
            raise ImageError("INVALID_CONTAINER", "no primary item")
        items = files.tiles_of(found, primary) if found.items.get(primary, {}).get("item_type") == "grid" else [primary]
        return {"streams": [container.annex_b(content, found, i) for i in items]}

    def work(name: str, content: bytes) -> dict:
        return {"image": image_row(name, hevc.decode(content, limits).rgb(), "rgb8")}

    streams = _apply(table, split, f"file_id string, streams array<binary>, error {ERROR}", limits)
    rows = streams.where("error is null").select("file_id", F.posexplode("streams").alias("tile_ord", "content"))
    keyed = rows.select(F.to_json(F.struct("file_id", "tile_ord")).alias("file_id"), "content").repartition(F.col("file_id"))
    done = _apply(keyed, work, f"file_id string, image {IMAGE}, error {ERROR}", limits)
    key = F.from_json("file_id", "file_id string, tile_ord int")
    good = done.select(key["file_id"].alias("file_id"), key["tile_ord"].alias("tile_ord"), "image", "error")
    bad = streams.where("error is not null").select("file_id", F.lit(None).cast("int").alias("tile_ord"), F.lit(None).cast(IMAGE).alias("image"), "error")
    return good.unionByName(bad)


def image_pixels(images: DataFrame, key: str = "file_id", column: str = "image") -> DataFrame:
    """``(key, y, x, c0, c1, ...)`` of 3- or 4-channel images: a row per pixel for SQL; ``c3`` is null without a fourth channel."""
    size = F.col(f"{column}.width") * F.col(f"{column}.height")
    rows = images.where(size > 0).select(key, column, F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    data, channels, width = F.col(f"{column}.data"), F.col(f"{column}.nChannels"), F.col(f"{column}.width")
    byte = lambda c: F.conv(F.hex(F.substr(data, F.col("i") * channels + c + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), *[F.when(channels > c, byte(c)).alias(f"c{c}") for c in range(4)])


def raw_image(name: str, content: bytes, chosen: Options) -> dict:
    """A file's pixels in Spark's image structure."""
    pixels, _ = decode_picture(checked(content, chosen.limits), chosen.limits, chosen.apply_orientation)
    return image_row(name, pixels, chosen.pixel_format)


def image_row(name: str | None, pixels: np.ndarray, pixel_format: str) -> dict:
    """RGBA or RGB pixels as an image structure of a pixel format."""
    if pixel_format.startswith("bgr"):
        pixels = pixels[..., [2, 1, 0, 3][: pixels.shape[2]]]
    if "a" not in pixel_format:
        pixels = pixels[..., :3]
    height, width, channels = pixels.shape
    return {"origin": name, "height": height, "width": width, "nChannels": channels, "mode": IMAGE_MODES[pixel_format], "data": pixels.tobytes()}
