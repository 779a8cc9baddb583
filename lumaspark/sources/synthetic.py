"""Synthetic containers: small files with the shapes that a reader has to cope with, sound and broken."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


def u(value: int, size: int) -> bytes:
    return value.to_bytes(size, "big")


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return u(8 + len(body), 4) + kind.encode("latin-1") + body


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, u(version, 1), u(flags, 3), *parts)


def ispe(width: int, height: int) -> bytes:
    return full("ispe", u(width, 4), u(height, 4))


def irot(turns: int) -> bytes:
    return box("irot", u(turns, 1))


def nclx(primaries: int, transfer: int, matrix: int, full_range: bool = True) -> bytes:
    return box("colr", b"nclx", u(primaries, 2), u(transfer, 2), u(matrix, 2), u(128 * full_range, 1))


def auxc(urn: str) -> bytes:
    return full("auxC", urn.encode() + b"\0")


def hvcc(vps: list[bytes] = (), sps: list[bytes] = (), pps: list[bytes] = (), length_size: int = 4) -> bytes:
    arrays = [u(kind, 1) + u(len(units), 2) + b"".join(u(len(x), 2) + x for x in units) for kind, units in ((32, vps), (33, sps), (34, pps))]
    return box("hvcC", b"\1" + bytes(20) + u(length_size - 1, 1) + u(3, 1), *arrays)


@dataclass
class Container:
    """Items with payloads, properties and edges; ``build`` lays them out. Extents may be overridden to break them."""

    major: str = "heic"
    compatible: tuple[str, ...] = ("mif1", "heic")
    primary: int | None = 1
    items: list[tuple[int, str, bytes]] = field(default_factory=list)
    properties: list[bytes] = field(default_factory=list)
    uses: dict[int, list[int]] = field(default_factory=dict)
    edges: list[tuple[str, int, list[int]]] = field(default_factory=list)
    offsets: dict[int, int] = field(default_factory=dict)

    def _meta(self, start: int) -> bytes:
        entries = [full("infe", u(i, 2), u(0, 2), kind.encode(), b"\0", version=2) for i, kind, _ in self.items]
        places, at = [], start
        for i, _, payload in self.items:
            places.append(u(i, 2) + u(0, 2) + u(1, 2) + u(self.offsets.get(i, at), 4) + u(len(payload), 4))
            at += len(payload)
        uses = [u(i, 2) + u(len(p), 1) + bytes(p) for i, p in sorted(self.uses.items())]
        parts = [
            full("hdlr", bytes(4), b"pict", bytes(13)),
            full("pitm", u(self.primary, 2)) if self.primary is not None else b"",
            full("iinf", u(len(entries), 2), *entries),
            full("iref", *[box(kind, u(a, 2), u(len(to), 2), *[u(t, 2) for t in to]) for kind, a, to in self.edges]) if self.edges else b"",
            box("iprp", box("ipco", *self.properties), full("ipma", u(len(uses), 4), *uses)),
            full("iloc", b"\x44\x00", u(len(places), 2), *places),
        ]
        return full("meta", *parts)

    def build(self) -> bytes:
        head = box("ftyp", self.major.encode(), u(0, 4), *[b.encode() for b in self.compatible])
        start = len(head) + len(self._meta(0)) + 8
        return head + self._meta(start) + box("mdat", *[p for _, _, p in self.items])


def single(width: int, height: int, payload: bytes = b"\xab" * 10, extra: list[bytes] = (), **rest) -> bytes:
    properties = [ispe(width, height), *extra]
    return Container(items=[(1, "hvc1", payload)], properties=properties, uses={1: list(range(1, len(properties) + 1))}, **rest).build()


def tiled(rows: int, columns: int, width: int, height: int) -> bytes:
    tiles = list(range(2, 2 + rows * columns))
    descriptor = bytes([0, 0, rows - 1, columns - 1]) + u(width, 2) + u(height, 2)
    return Container(
        items=[(1, "grid", descriptor), *[(t, "hvc1", bytes([t])) for t in tiles]],
        properties=[ispe(width, height), ispe(width // columns, height // rows)],
        uses={1: [1]} | {t: [2] for t in tiles},
        edges=[("dimg", 1, tiles)],
    ).build()


def fixtures() -> dict[str, bytes]:
    """Named files; those that start with ``bad_`` give an error."""
    alpha = Container(
        items=[(1, "hvc1", b"c" * 6), (2, "hvc1", b"a" * 4)],
        properties=[ispe(1200, 1600), auxc("urn:mpeg:mpegB:cicp:systems:auxiliary:alpha")],
        uses={1: [1], 2: [1, 2]},
        edges=[("auxl", 1, [2])],
    ).build()
    burst = Container(major="msf1", compatible=("msf1", "heic"), items=[(i, "hvc1", bytes([i])) for i in range(1, 5)], properties=[ispe(1920, 1080)], uses={i: [1] for i in range(1, 5)}).build()
    sound = single(64, 64)
    out = {
        "still_12mp": single(4032, 3024, extra=[hvcc()]),
        "grid_4x4": tiled(4, 4, 2048, 2048),
        "grid_1x2": tiled(1, 2, 1000, 500),
        "plain": single(1920, 1080),
        "alpha": alpha,
        "wide_gamut": single(3840, 2160, extra=[nclx(12, 13, 6)]),
        "burst": burst,
        "brand_mif1": single(800, 600, major="mif1", compatible=("heic",)),
        "no_primary": Container(primary=None, items=[(7, "Exif", b"\0\0\0\0II"), (9, "hvc1", b"x")], properties=[ispe(10, 20)], uses={9: [1]}).build(),
        "bad_other": box("ftyp", b"mp42", u(0, 4), b"isom") + box("moov"),
        "bad_truncated": b"\0\0\0\x18ft",
        "bad_huge_box": u(0x7FFFFFFF, 4) + b"ftypheic" + bytes(4),
        "bad_extent": single(64, 64, offsets={1: 999_999}),
        "bad_dimensions": single(65_535, 65_535),
        "bad_no_meta": box("ftyp", b"heic", u(0, 4)),
        "bad_trailing": sound + b"\0\0",
        "bad_tile_count": Container(
            items=[(1, "grid", bytes([0, 0, 1, 1]) + u(8, 2) + u(8, 2)), (2, "hvc1", b"t")], properties=[ispe(8, 8)], uses={1: [1]}, edges=[("dimg", 1, [2])]
        ).build(),
    }
    out |= {f"rotation_{t}": single(1280, 720, extra=[irot(t)]) for t in range(4)}
    return out


class BitWriter:
    def __init__(self):
        self.text = ""

    def bits(self, value: int, n: int) -> BitWriter:
        self.text += f"{value:0{n}b}" if n else ""
        return self

    def ue(self, value: int) -> BitWriter:
        code = f"{value + 1:b}"
        self.text += "0" * (len(code) - 1) + code
        return self

    def se(self, value: int) -> BitWriter:
        return self.ue(2 * value - 1 if value > 0 else -2 * value)

    def bytes(self) -> bytes:
        text = self.text + "1"
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")


def unit(kind: int, rbsp: bytes) -> bytes:
    """A bitstream unit with its header and escaped payload."""
    out, zeros = bytearray(), 0
    for byte in rbsp:
        if zeros == 2 and byte <= 3:
            out.append(3)
            zeros = 0
        out.append(byte)
        zeros = zeros + 1 if byte == 0 else 0
    return bytes([kind << 1, 1]) + bytes(out)


def sequence_unit(width: int, height: int, bit_depth: int = 8, sao: bool = True, log2_ctu: int = 4) -> bytes:
    w = BitWriter().bits(0, 4).bits(0, 3).bits(1, 1).bits(0, 8).bits(0, 32).bits(0, 32).bits(0, 16).bits(30, 8)
    w.ue(0).ue(1).ue(width).ue(height).bits(0, 1).ue(bit_depth - 8).ue(bit_depth - 8).ue(0).bits(1, 1).ue(0).ue(0).ue(0)
    w.ue(0).ue(log2_ctu - 3).ue(0).ue(log2_ctu - 3).ue(0).ue(0).bits(0, 1).bits(0, 1).bits(int(sao), 1).bits(0, 1)
    return unit(33, w.bits(0, 3).bytes())


def picture_unit(qp: int = 26) -> bytes:
    w = BitWriter().ue(0).ue(0).bits(0, 2).bits(0, 3).bits(0, 2).ue(0).ue(0).se(qp - 26).bits(0, 2).bits(0, 1).se(0).se(0).bits(0, 1).bits(0, 3).bits(0, 2)
    return unit(34, w.bits(0, 1).bits(0, 1).bytes())


def slice_unit(data: bytes, sao: bool = True, qp_delta: int = 0) -> bytes:
    w = BitWriter().bits(1, 1).bits(0, 1).ue(0).ue(2)
    if sao:
        w.bits(3, 2)
    w.se(qp_delta)
    w.text += "0" * (-len(w.text) % 8)
    return unit(19, int(w.text, 2).to_bytes(len(w.text) // 8, "big") + data)


def coded_item(data: bytes) -> bytes:
    """A slice behind its length, as items store it."""
    body = slice_unit(data)
    return u(len(body), 4) + body


def picture(width: int, height: int, data: bytes, turns: int | None = None, mask: bytes | None = None) -> bytes:
    """A container whose picture can be decoded: arbitrary bytes make an arbitrary picture."""
    properties = [ispe(width, height), hvcc(sps=[sequence_unit(width, height)], pps=[picture_unit()])]
    uses = {1: [1, 2]}
    if turns is not None:
        properties.append(irot(turns))
        uses[1] = [1, 2, 3]
    items, edges = [(1, "hvc1", coded_item(data))], []
    if mask is not None:
        properties.append(auxc("urn:mpeg:hevc:2015:auxid:1"))
        items.append((2, "hvc1", coded_item(mask)))
        uses[2], edges = [1, 2, len(properties)], [("auxl", 2, [1])]
    return Container(items=items, properties=properties, uses=uses, edges=edges).build()


def picture_grid(rows: int, columns: int, tile: int, width: int, height: int, data: list[bytes]) -> bytes:
    tiles = list(range(2, 2 + rows * columns))
    descriptor = bytes([0, 0, rows - 1, columns - 1]) + u(width, 2) + u(height, 2)
    config = hvcc(sps=[sequence_unit(tile, tile)], pps=[picture_unit()])
    return Container(
        items=[(1, "grid", descriptor), *[(t, "hvc1", coded_item(data[i % len(data)])) for i, t in enumerate(tiles)]],
        properties=[ispe(width, height), ispe(tile, tile), config],
        uses={1: [1]} | {t: [2, 3] for t in tiles},
        edges=[("dimg", 1, tiles)],
    ).build()


def pictures() -> dict[str, bytes]:
    """Decodable files, and some that fail while decoding."""
    noise = [b"".join(hashlib.sha256(bytes([k, i])).digest() for i in range(16)) for k in range(4)]
    return {
        "plain": picture(40, 24, noise[0]),
        "turned": picture(40, 24, noise[0], turns=1),
        "masked": picture(16, 16, noise[1], mask=noise[2]),
        "grid": picture_grid(2, 2, 16, 30, 27, noise),
        "empty_slice": picture(16, 16, b""),
        "bad_no_stream": single(16, 16, b""),
        "bad_length": single(16, 16, b"\0\0\0\x09\x26\x01"),
    }
