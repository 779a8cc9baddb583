"""Safety limits and the error taxonomy, as expressions over columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stable error codes.
ERROR_CODES = (
    "INVALID_INPUT", "INVALID_CONTAINER", "MALFORMED_INPUT", "UNSUPPORTED_FORMAT", "UNSUPPORTED_BRAND", "UNSUPPORTED_CODEC",
    "UNSUPPORTED_SEQUENCE", "UNSUPPORTED_FEATURE", "LIMIT_EXCEEDED", "LIMIT_INPUT_BYTES", "LIMIT_DIMENSIONS", "LIMIT_PIXELS",
    "PIXEL_LIMIT_EXCEEDED", "LIMIT_MEMORY", "DECODE_ERROR", "DECODE_FAILED", "ENCODE_ERROR", "ENCODE_FAILED", "OPERATION_ABORTED",
    "TIMEOUT", "INTERNAL_ERROR", "INVALID_OPTIONS",
)

ERROR_TYPE = "struct<code:string,message:string>"


class ImageError(ValueError):
    """A failure of one file, with a stable code."""

    def __init__(self, code: str, message: str):
        assert code in ERROR_CODES
        super().__init__(message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class Limits:
    """Caps; None means unlimited. The defaults are the documented ones; ``Limits.none()`` lifts all of them."""

    max_file_size: int | None = 256 * 1024 * 1024
    max_width: int | None = 16_384
    max_height: int | None = 16_384
    max_pixel_count: int | None = 64 * 1024 * 1024
    max_memory_bytes: int | None = 512 * 1024 * 1024
    max_item_count: int | None = 10_000
    max_tile_count: int | None = 1_024

    @classmethod
    def none(cls) -> Limits:
        return cls(*[None] * 7)

    def with_(self, **caps: int | None) -> Limits:
        return replace(self, **caps)

    def check_size(self, width: int, height: int) -> None:
        """The same order as ``dimension_code``, for kernels."""
        if (self.max_width is not None and width > self.max_width) or (self.max_height is not None and height > self.max_height):
            raise ImageError("LIMIT_DIMENSIONS", f"{width}x{height}")
        if self.max_pixel_count is not None and width * height > self.max_pixel_count:
            raise ImageError("LIMIT_PIXELS", f"{width * height} pixels")

    def check_memory(self, size: int) -> None:
        if self.max_memory_bytes is not None and size > self.max_memory_bytes:
            raise ImageError("LIMIT_MEMORY", f"{size} bytes")

    def check_items(self, count: int, what: str = "items", tiles: bool = False) -> None:
        cap = self.max_tile_count if tiles else self.max_item_count
        if cap is not None and count > cap:
            raise ImageError("LIMIT_EXCEEDED", f"{count} {what}")


def _over(value: Column, cap: int | None) -> Column:
    return F.lit(False) if cap is None else value > F.lit(cap)


def file_size_code(length: Column, limits: Limits) -> Column:
    return F.when(_over(length, limits.max_file_size), "LIMIT_INPUT_BYTES")


def dimension_code(width: Column, height: Column, limits: Limits) -> Column:
    """Width, then height, then a product that does not fit, then pixels."""
    pixels = F.try_multiply(width.cast("long"), height.cast("long"))
    code = F.when(_over(width, limits.max_width) | _over(height, limits.max_height) | (width.isNotNull() & height.isNotNull() & pixels.isNull()), "LIMIT_DIMENSIONS")
    return code.when(_over(pixels, limits.max_pixel_count), "LIMIT_PIXELS")


def memory_bytes(width: Column, height: Column, bytes_per_pixel: Column) -> Column:
    """Bytes of a picture; null if the product does not fit."""
    return F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), bytes_per_pixel.cast("long"))


def memory_code(size: Column, limits: Limits) -> Column:
    return F.when(size.isNull(), "LIMIT_EXCEEDED").when(_over(size, limits.max_memory_bytes), "LIMIT_MEMORY")


def item_count_code(count: Column, limits: Limits) -> Column:
    return F.when(_over(count, limits.max_item_count), "LIMIT_EXCEEDED")


def tile_count_code(count: Column, limits: Limits) -> Column:
    return F.when(_over(count, limits.max_tile_count), "LIMIT_EXCEEDED")
