"""Image file kernels: baseline JPEG and PNG from interleaved 8-bit pixels.

Pixels are numpy arrays ``[height, width, channels]`` in RGB or RGBA order.
"""

from __future__ import annotations

import struct
import zlib
from typing import Protocol

import numpy as np

from lumaspark.functions.limits import ImageError
from lumaspark.functions.tables import JPEG_CHROMA, JPEG_LUMA, zigzag

# Code lengths and symbols of the usual Huffman tables of baseline JPEG.
DC_LENGTHS = {"luma": (0, 1, 5, 1, 1, 1, 1, 1, 1), "chroma": (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1)}
AC_LENGTHS = {"luma": (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "chroma": (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)}
AC_SYMBOLS = {
    "luma": (
        1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98,
        114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87,
        88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147,
        148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196,
        197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243,
        244, 245, 246, 247, 248, 249, 250,
    ),
    "chroma": (
        0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193, 9, 35, 51, 82, 240, 21, 98, 114,
        209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38, 39, 40, 41, 42, 53, 54, 55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85,
        86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135, 136, 137,
        138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186,
        194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211, 212, 213, 214, 215, 216, 217, 218, 226, 227, 228, 229, 230, 231, 232, 233, 234, 242,
        243, 244, 245, 246, 247, 248, 249, 250,
    ),
}

_ZIGZAG = np.array(zigzag())


class Encoder(Protocol):
    """Turns pixels into a file; register one in ENCODERS to add a format."""

    def __call__(self, pixels: np.ndarray, **options) -> bytes: ...


def canonical_codes(lengths: tuple[int, ...], symbols: bytes) -> dict[int, tuple[int, int]]:
    """(code, bits) by symbol: codes of one length count up, a longer length starts at twice the next code."""
    out, code, at = {}, 0, 0
    for bits, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            out[symbol] = (code, bits)
            code += 1
        at += count
        code <<= 1
    return out


def quantisation(base: tuple[int, ...], quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def cosine_basis() -> np.ndarray:
    """Rows are frequencies of the orthonormal 8-point cosine transform."""
    k, n = np.arange(8, dtype=np.float32)[:, None], np.arange(8, dtype=np.float32)[None, :]
    rows = np.cos((2 * n + 1) * k * np.float32(np.pi) / np.float32(16)) * np.float32(0.5)
    rows[0] /= np.sqrt(np.float32(2))
    return rows.astype(np.float32)


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Level-shifted luma and chroma in single precision, alpha blended over white."""
    rgb = pixels[..., :3].astype(np.float32)
    if pixels.shape[2] == 4:
        a = pixels[..., 3:].astype(np.float32) / np.float32(255)
        rgb = rgb * a + np.float32(255) * (1 - a)
    weights = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]], dtype=np.float32)
    out = np.moveaxis(rgb @ weights.T, 2, 0)
    out[0] -= 128
    return out


def _blocks(plane: np.ndarray) -> np.ndarray:
    """8x8 blocks row by row; the last row and column are repeated to fill them."""
    height, width = plane.shape
    full = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
    return full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Zigzag coefficients of every block, rounded half away from zero."""
    basis = cosine_basis()
    scaled = (basis @ _blocks(plane) @ basis.T).reshape(-1, 64) / table.astype(np.float32)
    return (np.sign(scaled) * np.floor(np.abs(scaled) + np.float32(0.5))).astype(np.int64)[:, _ZIGZAG]


def _magnitude(value: int) -> tuple[int, int]:
    bits = abs(value).bit_length()
    return bits, value if value >= 0 else value + (1 << bits) - 1


def _block_code(coefficients: np.ndarray, dc: int, dc_codes: dict, ac_codes: dict) -> tuple[int, int]:
    """One block as (bits, count of bits)."""
    total, count = 0, 0

    def put(code: int, bits: int) -> None:
        nonlocal total, count
        total, count = total << bits | code, count + bits

    bits, extra = _magnitude(int(coefficients[0]) - dc)
    put(*dc_codes[bits])
    put(extra, bits)
    last = 0
    for i in np.flatnonzero(coefficients[1:]) + 1:
        run = int(i) - last - 1
        for _ in range(run // 16):
            put(*ac_codes[0xF0])
        bits, extra = _magnitude(int(coefficients[i]))
        put(*ac_codes[run % 16 << 4 | bits])
        put(extra, bits)
        last = int(i)
    if last < 63:
        put(*ac_codes[0])
    return total, count


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(pixels: np.ndarray, quality: int = 90, **_) -> bytes:
    """Baseline JPEG without chroma subsampling."""
    height, width = pixels.shape[:2]
    if not height or not width:
        raise ImageError("INVALID_INPUT", "no pixels")
    tables = {"luma": quantisation(JPEG_LUMA, quality), "chroma": quantisation(JPEG_CHROMA, quality)}
    codes, huffman = {}, []
    for place, kind in enumerate(("luma", "chroma")):
        for group, lengths, symbols in ((0, DC_LENGTHS[kind], bytes(range(12))), (1, AC_LENGTHS[kind], bytes(AC_SYMBOLS[kind]))):
            codes[kind, group] = canonical_codes(lengths, symbols)
            huffman.append(_segment(0xC4, bytes([group << 4 | place, *lengths, *[0] * (16 - len(lengths))]) + symbols))
    kinds = ("luma", "chroma", "chroma")
    planes = [_quantised(plane, tables[kind]) for plane, kind in zip(_planes(pixels), kinds, strict=True)]
    before = [0, 0, 0]
    bits = []
    for mcu in zip(*planes, strict=True):
        for i, block in enumerate(mcu):
            bits.append(_block_code(block, before[i], codes[kinds[i], 0], codes[kinds[i], 1]))
            before[i] = int(block[0])
    text = "".join(f"{value:0{count}b}" for value, count in bits)
    text += "0" * (-len(text) % 8)  # the reader stops at the last block
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""
    frame = struct.pack(">BHHB", 8, height & 0xFFFF, width & 0xFFFF, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    quant = b"".join(bytes([i]) + tables[k][_ZIGZAG].astype(np.uint8).tobytes() for i, k in enumerate(("luma", "chroma")))
    head = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0" + struct.pack(">HHBB", 1, 1, 0, 0)),
        _segment(0xDB, quant),
        _segment(0xC0, frame),
        *huffman,
        _segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])),
    ]
    return b"".join(head) + data + b"\xff\xd9"


def stored_zlib(data: bytes) -> bytes:
    """A zlib stream of uncompressed blocks."""
    pieces = [data[i : i + 65_535] for i in range(0, len(data), 65_535)] or [b""]
    blocks = [struct.pack("<BHH", i == len(pieces) - 1, len(p), len(p) ^ 0xFFFF) + p for i, p in enumerate(pieces)]
    return b"\x78\x01" + b"".join(blocks) + struct.pack(">I", zlib.adler32(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray, compress: bool = False, **_) -> bytes:
    """8-bit PNG, unfiltered rows in one data chunk; stored unless ``compress``."""
    height, width, channels = pixels.shape
    if not height or not width:
        raise ImageError("INVALID_INPUT", "no pixels")
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, width * channels).astype(np.uint8)), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows) if compress else stored_zlib(rows)) + _chunk(b"IEND", b"")


def webp(pixels: np.ndarray, **_) -> bytes:
    raise ImageError("UNSUPPORTED_FORMAT", "WebP pictures are not written")


ENCODERS: dict[str, Encoder] = {"jpeg": jpeg, "png": png, "webp": webp}
