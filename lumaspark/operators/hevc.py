"""Still-picture video bitstreams: units, parameter sets, slice headers, and a simplified intra decoder.

The decoder covers a subset: luma of the first intra slice, one prediction and one residual of at most sixteen low-frequency
coefficients per coding unit, deblocking and a fixed edge offset. Chroma stays at mid-grey, so pictures are grey, and files of real
cameras are not decoded faithfully; parameter sets, headers and container data are read in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from lumaspark.functions.limits import ImageError, Limits
from lumaspark.functions.tables import ANGLES, BETA, DST4, INVERSE_ANGLES, LEVEL_SCALE, TC, dct_matrix
from lumaspark.operators.blocks import smoothing_wanted

VPS, SPS, PPS = 32, 33, 34


# --- units ---


def unescape(payload: bytes) -> bytes:
    """Drop the byte 3 after every two zero bytes."""
    return payload.replace(b"\0\0\3", b"\0\0")


@dataclass(frozen=True)
class Unit:
    kind: int
    layer: int
    temporal: int
    rbsp: bytes

    @property
    def is_slice(self) -> bool:
        return self.kind in (0, 1) or self.is_irap

    @property
    def is_irap(self) -> bool:
        return 16 <= self.kind <= 21


def units(stream: bytes) -> list[Unit]:
    """Units between start codes; those of fewer than two bytes are dropped."""
    starts, at = [], stream.find(b"\0\0\1")
    while at >= 0:
        starts.append(at)
        at = stream.find(b"\0\0\1", at + 3)
    out = []
    for i, start in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else len(stream)
        if i + 1 < len(starts) and end > start + 3 and stream[end - 1] == 0:
            end -= 1  # the start code has four bytes
        raw = stream[start + 3 : end]
        if len(raw) < 2:
            continue
        if raw[0] & 0x80:
            raise ImageError("MALFORMED_INPUT", "forbidden bit of a unit is set")
        out.append(Unit(raw[0] >> 1 & 63, (raw[0] & 1) << 5 | raw[1] >> 3, raw[1] & 7, unescape(raw[2:])))
    return out


class Bits:
    """Reads bits, most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ImageError("MALFORMED_INPUT", "bits ran out")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big")
        self.at += n
        return word >> (8 * last - self.at) & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.read(1) == 1

    def ue(self) -> int:
        """Unsigned exponential Golomb code."""
        zeros = 0
        while not self.read(1):
            zeros += 1
            if zeros > 31:
                raise ImageError("MALFORMED_INPUT", "code of more than 32 bits")
        return (1 << zeros) - 1 + self.read(zeros)

    def se(self) -> int:
        """Signed exponential Golomb code: 1, -1, 2, -2, ..."""
        code = self.ue()
        return (code + 1) // 2 if code % 2 else -(code // 2)

    def align(self) -> int:
        """The next whole byte."""
        self.at = (self.at + 7) & ~7
        return self.at >> 3

    def more(self) -> bool:
        """Whether anything precedes the stop bit."""
        left = 8 * len(self.data) - self.at
        if left <= 0:
            return False
        if left > 8:
            return True
        rest = self.data[-1] & ((1 << left) - 1)
        return rest != 1 << (left - 1)


@dataclass(frozen=True)
class SequenceParameters:
    sps_id: int
    chroma_format: int
    width: int
    height: int
    crop: tuple[int, int, int, int]
    bit_depth: int
    bit_depth_chroma: int
    log2_min_cb: int
    log2_diff_cb: int
    log2_min_tb: int
    log2_diff_tb: int
    intra_depth: int
    scaling_lists: bool
    sao: bool
    pcm: bool

    @property
    def ctu_size(self) -> int:
        return 1 << (self.log2_min_cb + self.log2_diff_cb)

    @property
    def min_cb_size(self) -> int:
        return 1 << self.log2_min_cb

    @property
    def min_tb_size(self) -> int:
        return 1 << self.log2_min_tb

    @property
    def max_tb_size(self) -> int:
        return 1 << (self.log2_min_tb + self.log2_diff_tb)


_PROFILE_BITS = 2 + 1 + 5 + 32 + 4 + 44


def _skip(bits: Bits, n: int) -> None:
    while n:
        step = min(n, 32)
        bits.read(step)
        n -= step


def _profile(bits: Bits, sub_layers: int) -> None:
    _skip(bits, _PROFILE_BITS)
    bits.read(8)
    present = [(bits.flag(), bits.flag()) for _ in range(sub_layers)]
    if sub_layers:
        _skip(bits, 2 * (8 - sub_layers))
    for profile, level in present:
        _skip(bits, _PROFILE_BITS * profile + 8 * level)


def _scaling_lists(bits: Bits) -> None:
    for size in range(4):
        for _ in range(2 if size == 3 else 6):
            if not bits.flag():
                bits.ue()
                continue
            for _ in range(min(64, 1 << (4 + 2 * size)) + (size > 1)):
                bits.se()


def sequence_parameters(rbsp: bytes, limits: Limits) -> SequenceParameters:
    bits = Bits(rbsp)
    bits.read(4)
    sub_layers = bits.read(3)
    bits.read(1)
    _profile(bits, sub_layers)
    out = {"sps_id": bits.ue(), "chroma_format": bits.ue()}
    if out["chroma_format"] == 3:
        bits.flag()
    out |= {"width": bits.ue(), "height": bits.ue()}
    limits.check_size(out["width"], out["height"])
    out["crop"] = tuple(bits.ue() for _ in range(4)) if bits.flag() else (0, 0, 0, 0)
    out |= {"bit_depth": 8 + bits.ue(), "bit_depth_chroma": 8 + bits.ue()}
    bits.ue()
    for _ in range(sub_layers + 1 if bits.flag() else 1):
        for _ in range(3):
            bits.ue()
    out |= {"log2_min_cb": 3 + bits.ue(), "log2_diff_cb": bits.ue(), "log2_min_tb": 2 + bits.ue(), "log2_diff_tb": bits.ue(), "intra_depth": bits.ue()}
    bits.ue()
    out["scaling_lists"] = bits.flag()
    if out["scaling_lists"] and bits.flag():
        _scaling_lists(bits)
    bits.flag()
    out["sao"], out["pcm"] = bits.flag(), bits.flag()
    if out["pcm"]:
        bits.read(8)
        bits.ue()
        bits.ue()
        bits.flag()
    if out["bit_depth"] > 16 or out["log2_min_cb"] + out["log2_diff_cb"] > 10:
        raise ImageError("MALFORMED_INPUT", "sequence parameters out of range")
    return SequenceParameters(**out)


@dataclass(frozen=True)
class PictureParameters:
    pps_id: int
    sps_id: int
    dependent_slices: bool
    output_flag: bool
    extra_bits: int
    sign_hiding: bool
    cabac_init: bool
    init_qp: int
    constrained_intra: bool
    transform_skip: bool
    qp_delta: bool
    qp_delta_depth: int
    cb_offset: int
    cr_offset: int
    slice_chroma_offsets: bool
    deblocking_control: bool
    deblocking_off: bool
    beta_offset: int
    tc_offset: int


def picture_parameters(rbsp: bytes) -> PictureParameters:
    bits = Bits(rbsp)
    out = {"pps_id": bits.ue(), "sps_id": bits.ue(), "dependent_slices": bits.flag(), "output_flag": bits.flag(), "extra_bits": bits.read(3)}
    out |= {"sign_hiding": bits.flag(), "cabac_init": bits.flag()}
    bits.ue()
    bits.ue()
    out |= {"init_qp": 26 + bits.se(), "constrained_intra": bits.flag(), "transform_skip": bits.flag(), "qp_delta": bits.flag()}
    out["qp_delta_depth"] = bits.ue() if out["qp_delta"] else 0
    out |= {"cb_offset": bits.se(), "cr_offset": bits.se(), "slice_chroma_offsets": bits.flag()}
    _skip(bits, 3)
    tiles = bits.flag()
    bits.flag()
    if tiles:
        columns, rows = bits.ue(), bits.ue()
        if not bits.flag():
            for _ in range(columns + rows):
                bits.ue()
        bits.flag()
    bits.flag()
    out |= {"deblocking_control": bits.flag(), "deblocking_off": False, "beta_offset": 0, "tc_offset": 0}
    if out["deblocking_control"]:
        bits.flag()
        out["deblocking_off"] = bits.flag()
        if not out["deblocking_off"]:
            out |= {"beta_offset": 2 * bits.se(), "tc_offset": 2 * bits.se()}
    return PictureParameters(**out)


@dataclass(frozen=True)
class SliceHeader:
    first: bool
    kind: str
    qp: int
    sao_luma: bool
    sao_chroma: bool
    deblocking_off: bool
    beta_offset: int
    tc_offset: int
    data_at: int


def slice_header(unit: Unit, sps: SequenceParameters, pps: PictureParameters) -> SliceHeader:
    """A slice of an unknown type counts as intra; a dependent slice takes everything from the parameter sets."""
    bits = Bits(unit.rbsp)
    first = bits.flag()
    if unit.is_irap:
        bits.flag()
    named = bits.ue()
    if named != pps.pps_id:
        raise ImageError("INVALID_CONTAINER", f"slice names parameter set {named}, {pps.pps_id} is active")
    if not first:
        if pps.dependent_slices and bits.flag():
            return SliceHeader(False, "I", pps.init_qp, sps.sao, sps.sao, pps.deblocking_off, pps.beta_offset, pps.tc_offset, bits.at >> 3)
        count = -(-sps.width // sps.ctu_size) * -(-sps.height // sps.ctu_size)
        bits.read((count - 1).bit_length() if count > 1 else 0)
    kind = {0: "B", 1: "P"}.get(bits.ue(), "I")
    if pps.output_flag:
        bits.flag()
    sao_luma, sao_chroma = (bits.flag(), bits.flag()) if sps.sao else (False, False)
    qp = pps.init_qp + bits.se()
    off, beta, tc = pps.deblocking_off, pps.beta_offset, pps.tc_offset
    if pps.deblocking_control and bits.flag():
        off = bits.flag()
        if not off:
            beta, tc = 2 * bits.se(), 2 * bits.se()
    return SliceHeader(first, kind, qp, sao_luma, sao_chroma, off, beta, tc, bits.align())


# --- entropy decoding ---

# Next state after the less probable symbol.
AFTER_LPS = (
    0, 0, 1, 2, 2, 4, 4, 5, 6, 7, 8, 9, 9, 11, 11, 12, 13, 13, 15, 15, 16, 16, 18, 18, 19, 19, 21, 21, 22, 22, 23, 24, 24, 25, 26, 26, 27, 27, 28, 29,
    29, 30, 30, 30, 31, 32, 32, 33, 33, 33, 34, 34, 35, 35, 35, 35, 36, 36, 36, 37, 37, 37, 38, 38,
)
# Range of the less probable symbol by state (rows) and quarter of the current range, as the standard prints them.
LPS_RANGES = (
    (128, 176, 208, 240), (128, 167, 197, 227), (128, 158, 187, 216), (123, 150, 178, 205), (116, 142, 169, 195), (111, 135, 160, 185), (105, 128, 152, 175),
    (100, 122, 144, 166), (95, 116, 137, 158), (90, 110, 130, 150), (85, 104, 123, 142), (81, 99, 117, 135), (77, 94, 111, 128), (73, 89, 105, 122),
    (69, 85, 100, 116), (66, 80, 95, 110), (62, 76, 90, 104), (59, 72, 86, 99), (56, 69, 81, 94), (53, 65, 77, 89), (51, 62, 73, 85), (48, 59, 69, 80),
    (46, 56, 66, 76), (43, 53, 63, 72), (41, 50, 59, 69), (39, 48, 56, 65), (37, 45, 54, 62), (35, 43, 51, 59), (33, 41, 48, 56), (32, 39, 46, 53),
    (30, 37, 43, 50), (29, 35, 41, 48), (27, 33, 39, 45), (26, 31, 37, 43), (24, 30, 35, 41), (23, 28, 33, 39), (22, 27, 32, 37), (21, 26, 30, 35),
    (20, 24, 29, 33), (19, 23, 27, 31), (18, 22, 26, 30), (17, 21, 25, 28), (16, 20, 23, 27), (15, 19, 22, 25), (14, 18, 21, 24), (14, 17, 20, 23),
    (13, 16, 19, 22), (12, 15, 18, 21), (12, 14, 17, 20), (11, 14, 16, 19), (11, 13, 15, 18), (10, 12, 15, 17), (10, 12, 14, 16), (9, 11, 13, 15),
    (9, 11, 12, 14), (8, 10, 12, 14), (8, 9, 11, 13), (7, 9, 11, 12), (7, 9, 10, 12), (7, 8, 10, 11), (6, 8, 9, 11), (6, 7, 9, 10), (6, 7, 8, 9),
    (2, 2, 2, 2),
)

# Initial values of the contexts that are used.
CONTEXTS = {"split": (139, 141, 157), "mode": (184,), "cbf": (111, 141), "significant": (111,)}


def lps_ranges(compat: bool = False) -> list[tuple[int, ...]]:
    """Range of the less probable symbol by state and quarter of the current range. ``compat`` gives the table that some decoders hold:
    the row of state 58 is left out, so the last rows stand one state early and the last one twice."""
    return [*LPS_RANGES[:58], *LPS_RANGES[59:], LPS_RANGES[63]] if compat else list(LPS_RANGES)


_LPS = lps_ranges()


class Context:
    __slots__ = ("state", "likely")

    def __init__(self, value: int, qp: int):
        start = min(126, max(1, (((value >> 4) * 5 - 45) * qp >> 4) + ((value & 15) << 3) - 16))
        self.likely = int(start >= 64)
        self.state = start - 64 if start >= 64 else 63 - start


class Arithmetic:
    """Binary arithmetic decoder over a bit string. Beyond the end a zero bit and the last byte's seven low bits repeat."""

    def __init__(self, data: bytes, start: int):
        tail = (data[-1] & 0x7F) if data else 0
        self.bits = np.unpackbits(np.frombuffer(data[start:] or b"\0", np.uint8)).tolist()
        self.tail = [tail >> (7 - i) & 1 for i in range(8)]
        self.at, self.range, self.value, self.overrun = 0, 510, 0, False
        for _ in range(9):
            self.value = self.value << 1 | self._bit()

    def _bit(self) -> int:
        at = self.at
        self.at += 1
        if at < len(self.bits):
            return self.bits[at]
        self.overrun = True
        return self.tail[(at - len(self.bits)) & 7]

    def decide(self, context: Context) -> int:
        small = _LPS[context.state][self.range >> 6 & 3]
        self.range -= small
        if self.value < self.range:
            out = context.likely
            context.state += context.state < 62
        else:
            out = 1 - context.likely
            self.value -= self.range
            self.range = small
            if context.state == 0:
                context.likely = out
            context.state = AFTER_LPS[context.state]
        while self.range < 256:
            self.range <<= 1
            self.value = self.value << 1 | self._bit()
        return out

    def bypass(self) -> int:
        self.value = self.value << 1 | self._bit()
        if self.value >= self.range:
            self.value -= self.range
            return 1
        return 0

    def bypass_bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bypass()
        return out

    def terminate(self) -> int:
        self.range -= 2
        if self.value >= self.range:
            return 1
        while self.range < 256:
            self.range <<= 1
            self.value = self.value << 1 | self._bit()
        return 0

    def remaining_level(self, rice: int) -> int:
        prefix = 0
        while self.bypass():
            prefix += 1
            if prefix > 31:
                raise ImageError("MALFORMED_INPUT", "escape prefix too long")
        if prefix < 3:
            return (prefix << rice) + self.bypass_bits(rice)
        return ((1 << (prefix - 3)) + 2 << rice) + self.bypass_bits(prefix - 3 + rice)


# --- reconstruction ---


def dequantise(levels: np.ndarray, qp: int, bit_depth: int, skip: bool = False) -> np.ndarray:
    size = levels.shape[-1]
    shift = 13 + (7 if skip else size.bit_length() - 1) - bit_depth - qp // 6
    scaled = levels.astype(np.int64) * LEVEL_SCALE[qp % 6] * (16 if skip else 1)
    return (scaled + (1 << (shift - 1))) >> shift if shift > 0 else scaled << -shift


_MATRICES: dict[tuple[int, bool], np.ndarray] = {}


def inverse_transform(block: np.ndarray, bit_depth: int, sine: bool = False, compat: bool = True) -> np.ndarray:
    """Rows, then columns; other sizes than 4 to 32 pass unchanged."""
    size = block.shape[-1]
    if size not in (4, 8, 16, 32):
        return block
    key = (size, sine)
    if key not in _MATRICES:
        _MATRICES[key] = np.array(DST4 if sine else dct_matrix(size, compat), dtype=np.int64)
    matrix, last = _MATRICES[key], 20 - bit_depth
    rows = (block.astype(np.int64) @ matrix + 64) >> 7
    return (matrix.T @ rows + (1 << (last - 1))) >> last


def smooth(top: np.ndarray, left: np.ndarray, size: int, mode: int, bit_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Reference smoothing for luma, by size and mode; flat 32-blocks are interpolated between the corners."""
    if not smoothing_wanted(size, mode):
        return top, left
    if size == 32:
        flat = all(abs(int(top[0]) - 2 * int(line[size]) + int(line[2 * size])) < 1 << (bit_depth - 5) for line in (top, left))
        if flat:
            i = np.arange(1, 2 * size + 1)
            blend = [np.concatenate((line[:1], ((2 * size - i) * top[0] + i * line[2 * size] + 32) >> 6)) for line in (top, left)]
            return blend[0], blend[1]
    corner = (left[1] + 2 * top[0] + top[1] + 2) >> 2
    out = []
    for line in (top, left):
        new = line.copy()
        new[1:-1] = (line[:-2] + 2 * line[1:-1] + line[2:] + 2) >> 2
        new[0] = corner
        out.append(new)
    return out[0], out[1]


def predict(top: np.ndarray, left: np.ndarray, size: int, mode: int, luma: bool = True) -> np.ndarray:
    """Planar (0), mean (1) or directional (2 to 34) prediction; other modes give zeros."""
    n = size
    i = np.arange(n)
    if mode == 0:
        total = (n - 1 - i)[None, :] * left[1 : n + 1, None] + (i + 1)[None, :] * top[n + 1] + (n - 1 - i)[:, None] * top[None, 1 : n + 1] + (i + 1)[:, None] * left[n + 1] + n
        return total >> n.bit_length()
    if mode == 1:
        mean = (top[1 : n + 1].sum() + left[1 : n + 1].sum() + n) >> n.bit_length()
        out = np.full((n, n), mean, dtype=np.int64)
        if luma and n < 32:
            out[0], out[:, 0] = (top[1 : n + 1] + 3 * mean + 2) >> 2, (left[1 : n + 1] + 3 * mean + 2) >> 2
            out[0, 0] = (left[1] + 2 * mean + top[1] + 2) >> 2
        return out
    if not 2 <= mode <= 34:
        return np.zeros((n, n), dtype=np.int64)
    main, side = (top, left) if mode >= 18 else (left, top)
    angle = ANGLES[mode - 2]
    if angle < 0:
        back = np.arange((n * angle) >> 5, 0)
        places = (back * INVERSE_ANGLES[mode - 11] + 128) >> 8
        line = np.concatenate((side[np.clip(places, 0, 2 * n)], main))
        zero = len(back)
    else:
        line, zero = main, 0
    line = np.append(line, line[-1])
    step = (i + 1) * angle
    whole, part = step >> 5, step & 31
    at = zero + 1 + i[None, :] + whole[:, None]
    out = ((32 - part)[:, None] * line[at] + part[:, None] * line[np.minimum(at + 1, len(line) - 1)] + 16) >> 5
    if angle == 0 and luma and n < 32:
        out[:, 0] = np.clip(out[:, 0] + ((side[1 : n + 1] - main[0]) >> 1), 0, 65535)
    return out if mode >= 18 else out.T


class _Picture:
    def __init__(self, data: bytes, sps: SequenceParameters, header: SliceHeader):
        self.sps, self.qp, self.depth = sps, header.qp, sps.bit_depth
        self.y = np.full((sps.height, sps.width), 1 << (sps.bit_depth - 1), dtype=np.int64)
        self.code = Arithmetic(data, header.data_at)
        self.contexts = {name: [Context(v, header.qp) for v in values] for name, values in CONTEXTS.items()}

    def quadtree(self, x: int, y: int, size: int, level: int = 0) -> None:
        height, width = self.y.shape
        if x >= width or y >= height:
            return
        split = size > self.sps.min_cb_size
        if split and x + size <= width and y + size <= height:
            split = self.code.decide(self.contexts["split"][min(level, 2)]) == 1
        if not split:
            self.unit(x, y, size)
            return
        half = size // 2
        for dy in (0, half):
            for dx in (0, half):
                self.quadtree(x + dx, y + dy, half, level + 1)

    def references(self, x: int, y: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        height, width = self.y.shape
        grey = 1 << (self.depth - 1)
        top, left = np.full(2 * n + 1, grey, dtype=np.int64), np.full(2 * n + 1, grey, dtype=np.int64)
        if y:
            top[0] = self.y[y - 1, max(x - 1, 0)]
            top[1:] = self.y[y - 1, np.minimum(x + np.arange(2 * n), width - 1)]
        if x:
            left[0] = top[0]
            left[1:] = self.y[np.minimum(y + np.arange(2 * n), height - 1), x - 1]
        return top, left

    def unit(self, x: int, y: int, size: int) -> None:
        n = min(size, 32)
        mode = self.code.bypass() if self.code.decide(self.contexts["mode"][0]) else self.code.bypass_bits(5) + 2
        top, left = smooth(*self.references(x, y, n), n, mode, self.depth)
        block = predict(top, left, n, mode)
        if self.code.decide(self.contexts["cbf"][0]):
            levels = np.zeros(n * n, dtype=np.int64)
            for i in range(min(n, 4) ** 2):
                if self.code.decide(self.contexts["significant"][0]):
                    negative = self.code.bypass()
                    level = 1 + self.code.remaining_level(0)
                    levels[i] = -level if negative else level
            scaled = dequantise(levels.reshape(n, n), self.qp, self.depth)
            block = block + inverse_transform(scaled, self.depth, sine=n == 4 and mode < 35)
        height, width = self.y.shape
        part = np.clip(block, 0, (1 << self.depth) - 1)
        self.y[y : y + n, x : x + n] = part[: height - y, : width - x]


def deblock(y: np.ndarray, qp: int, beta_offset: int, tc_offset: int, bit_depth: int) -> None:
    """Filter four samples out of every eight along the edges of the 8x8 grid: first between rows, then between columns."""
    beta = BETA[min(51, max(0, qp + beta_offset))] << (bit_depth - 8)
    tc = TC[min(53, max(0, qp + 2 + tc_offset))] << (bit_depth - 8)
    if not beta or not tc:
        return
    top, side, half = (1 << bit_depth) - 1, (beta + (beta >> 1)) >> 3, tc >> 1
    for plane in (y, y.T):
        height, width = plane.shape
        along = np.array([c for c in range(width) if c % 8 < 4], dtype=np.int64)
        for edge in range(8, height, 8):
            if edge + 2 >= height:
                continue  # fewer than three rows beyond the edge
            p0, p1, p2 = (plane[edge - 1 - i, along] for i in range(3))
            q0, q1, q2 = (plane[edge + i, along] for i in range(3))
            dp, dq = np.abs(p2 - 2 * p1 + p0), np.abs(q2 - 2 * q1 + q0)
            on = dp + dq < beta
            delta = np.clip((9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4, -tc, tc)
            outer_p = np.clip(p1 + np.clip((((p2 + p0 + 1) >> 1) - p1 + delta) >> 1, -half, half), 0, top)
            outer_q = np.clip(q1 + np.clip((((q2 + q0 + 1) >> 1) - q1 - delta) >> 1, -half, half), 0, top)
            plane[edge - 1, along] = np.where(on, np.clip(p0 + delta, 0, top), p0)
            plane[edge, along] = np.where(on, np.clip(q0 - delta, 0, top), q0)
            plane[edge - 2, along] = np.where(on & (dp < side), outer_p, p1)
            plane[edge + 1, along] = np.where(on & (dq < side), outer_q, q1)


EDGE_STEPS = {0: ((0, -1), (0, 1)), 1: ((-1, 0), (1, 0)), 2: ((-1, -1), (1, 1)), 3: ((-1, 1), (1, -1))}


def edge_offset(y: np.ndarray, kind: int, offsets: tuple[int, int, int, int], bit_depth: int) -> None:
    """In place, in reading order, so neighbours already passed count as changed; the border stays."""
    (ay, ax), (by, bx) = EDGE_STEPS[kind]
    top = (1 << bit_depth) - 1
    add = {-2: offsets[0], -1: offsets[1], 0: 0, 1: -offsets[2], 2: -offsets[3]}
    rows = y.tolist()
    for r in range(1, len(rows) - 1):
        for c in range(1, len(rows[r]) - 1):
            v, a, b = rows[r][c], rows[r + ay][c + ax], rows[r + by][c + bx]
            sign = (v > a) - (v < a) + (v > b) - (v < b)
            if sign:
                rows[r][c] = min(top, max(0, v + add[sign]))
    y[:] = rows


@dataclass
class Frame:
    luma: np.ndarray
    bit_depth: int
    truncated: bool

    def rgb(self) -> np.ndarray:
        """8-bit RGB by the integer matrix; chroma is mid-grey, so all channels are luma."""
        return np.repeat((self.luma >> (self.bit_depth - 8)).astype(np.uint8)[:, :, None], 3, axis=2)


def decode(stream: bytes, limits: Limits) -> Frame:
    """The first slice of a picture. ``truncated`` tells that the decoder read beyond the slice's end."""
    found = units(stream)
    if not found:
        raise ImageError("MALFORMED_INPUT", "no units")
    sps, pps, slices = None, None, []
    for unit in found:
        if unit.kind == SPS:
            sps = sequence_parameters(unit.rbsp, limits)
        elif unit.kind == PPS:
            pps = picture_parameters(unit.rbsp)
        elif unit.is_slice:
            slices.append(unit)
    if sps is None or pps is None:
        raise ImageError("INVALID_CONTAINER", "parameter sets are missing")
    if not slices:
        raise ImageError("MALFORMED_INPUT", "no slice")
    limits.check_size(sps.width, sps.height)
    limits.check_memory(sps.width * sps.height * 3)
    header = slice_header(slices[0], sps, pps)
    if header.kind != "I":
        raise ImageError("UNSUPPORTED_FEATURE", "only intra slices are decoded")
    picture = _Picture(slices[0].rbsp, sps, header)
    for y in range(0, sps.height, sps.ctu_size):
        for x in range(0, sps.width, sps.ctu_size):
            picture.quadtree(x, y, sps.ctu_size)
    if not header.deblocking_off:
        deblock(picture.y, header.qp, header.beta_offset, header.tc_offset, sps.bit_depth)
    if header.sao_luma:
        edge_offset(picture.y, 0, (1, 1, 1, 1), sps.bit_depth)
    return Frame(picture.y, sps.bit_depth, picture.code.overrun)
