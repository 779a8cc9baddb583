"""Parsing of ISO base-media still-image containers, one file at a time.

``parse`` turns bytes into plain records of every table that a container consists of; it is the kernel behind sources.files. Failures
are ``ImageError`` with a stable code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from lumaspark.functions.limits import ImageError, Limits
from lumaspark.functions.tables import BRANDS

#: Boxes whose payload is boxes, with the bytes that come before the first of them.
CONTAINERS = {"meta": 4, "iprp": 0, "ipco": 0}
#: Levels of boxes below the topmost that are followed.
MOST_DEPTH = 64


class Cursor:
    """Reads big-endian numbers; running out of bytes is MALFORMED_INPUT."""

    def __init__(self, data: bytes, what: str, at: int = 0):
        self.data, self.what, self.at = data, what, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if self.left < n:
            raise ImageError("MALFORMED_INPUT", f"{self.what} is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def sized(self, n: int) -> int:
        """A number of a width that the file itself declares."""
        if n not in (0, 1, 2, 4, 8):
            if self.left < n:
                raise ImageError("MALFORMED_INPUT", f"{self.what} is cut short")
            raise ImageError("INVALID_CONTAINER", f"{self.what}: numbers of {n} bytes")
        return self.uint(n)

    def text(self) -> str:
        """Up to a zero byte or the end; bytes that are no UTF-8 are replaced."""
        end = self.data.find(b"\0", self.at)
        raw = self.data[self.at : end if end >= 0 else len(self.data)]
        self.at = end + 1 if end >= 0 else len(self.data)
        return raw.decode("utf-8", "replace")


@dataclass(frozen=True)
class Box:
    kind: str
    offset: int
    size: int
    header: int
    data: bytes

    @property
    def payload(self) -> bytes:
        return self.data[self.header :]

    def full(self) -> tuple[int, int, Cursor]:
        """Version, flags and a cursor behind them."""
        cursor = Cursor(self.payload, self.kind)
        return cursor.uint(1), cursor.uint(3), cursor


def header(data: bytes, at: int = 0, end: int | None = None) -> tuple[str, int, int]:
    """(type, size, header size). Size 1 means 64 bits follow, size 0 the rest of the input."""
    end = len(data) if end is None else end
    if end - at < 8:
        raise ImageError("MALFORMED_INPUT", "too few bytes for a box header")
    size, kind, length = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1"), 8
    if size == 1:
        if end - at < 16:
            raise ImageError("MALFORMED_INPUT", "too few bytes for a long box header")
        size, length = int.from_bytes(data[at + 8 : at + 16], "big"), 16
    elif size == 0:
        size = end - at
    if size < length:
        raise ImageError("INVALID_CONTAINER", f"box {kind!r} of {size} bytes")
    return kind, size, length


def boxes(data: bytes, base: int = 0) -> Iterator[Box]:
    """Sibling boxes until the end of ``data``."""
    at = 0
    while at < len(data):
        kind, size, length = header(data, at)
        if size > len(data) - at:
            raise ImageError("MALFORMED_INPUT", f"box {kind!r} declares {size} bytes, {len(data) - at} remain")
        yield Box(kind, base + at, size, length, data[at : at + size])
        at += size


def walk(data: bytes, out: list[dict] | None = None, most_depth: int = MOST_DEPTH) -> list[dict]:
    """Every box, in file order, with its parent's ordinal; boxes are not copied. Deeper nesting than ``most_depth`` is
    INVALID_CONTAINER."""
    out = [] if out is None else out
    open_ = [(0, len(data), -1)]
    while open_:
        at, end, parent = open_.pop()
        if at >= end:
            continue
        kind, size, length = header(data, at, end)
        if size > end - at:
            raise ImageError("MALFORMED_INPUT", f"box {kind!r} declares {size} bytes, {end - at} remain")
        ordinal, depth = len(out), len(open_)
        out.append({"ord": ordinal, "parent_ord": parent, "depth": depth, "box_type": kind, "offset": at, "size": size, "header_size": length})
        open_.append((at + size, end, parent))
        skip = CONTAINERS.get(kind)
        if skip is not None and size - length >= skip:
            if depth >= most_depth:
                raise ImageError("INVALID_CONTAINER", f"boxes nested deeper than {most_depth}")
            open_.append((at + length + skip, at + size, ordinal))
    return out


@dataclass
class Parsed:
    """Tables of one container as lists of records."""

    major_brand: str = ""
    compatible_brands: list[str] = field(default_factory=list)
    handler: str | None = None
    declared_primary: int | None = None
    idat: bytes | None = None
    items: dict[int, dict] = field(default_factory=dict)
    locations: dict[int, dict] = field(default_factory=dict)
    properties: list[dict] | None = None
    associations: dict[int, list[dict]] = field(default_factory=dict)
    references: list[dict] | None = None


def file_type(payload: bytes) -> tuple[str, list[str]]:
    if len(payload) < 8:
        raise ImageError("MALFORMED_INPUT", "ftyp is cut short")
    brands = [payload[i : i + 4].decode("latin-1") for i in range(8, len(payload) - 3, 4)]
    return payload[:4].decode("latin-1"), brands


def detect(data: bytes) -> bool:
    """Starts with a well-formed file type box of a supported brand."""
    try:
        kind, size, length = header(data)
        if len(data) < 12 or kind != "ftyp" or size > len(data):
            return False
        major, compatible = file_type(data[length:size])
    except ImageError:
        return False
    return major in BRANDS or any(b in BRANDS for b in compatible)


def _item_entry(box: Box) -> dict:
    version, _, cursor = box.full()
    item = cursor.uint(4 if version == 3 else 2)
    protection = cursor.uint(2)
    kind = cursor.take(4).decode("latin-1") if version in (2, 3) else "hvc1"
    name = cursor.text()
    typed = kind == "mime" if version in (2, 3) else cursor.left > 0
    return {"item_id": item, "protection_index": protection, "item_type": kind, "item_name": name, "content_type": cursor.text() if typed else None}


def _item_info(box: Box, limits: Limits) -> dict[int, dict]:
    version, _, cursor = box.full()
    limits.check_items(cursor.uint(2 if version == 0 else 4))
    entries = [_item_entry(b) for b in boxes(cursor.data[cursor.at :]) if b.kind == "infe"]
    return {e["item_id"]: e for e in entries}


def _locations(box: Box, limits: Limits) -> dict[int, dict]:
    version, _, cursor = box.full()
    sizes = cursor.uint(2)
    offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
    indexed = version in (1, 2)
    count = cursor.uint(2 if version < 2 else 4)
    limits.check_items(count)
    out = {}
    for _ in range(count):
        item = cursor.uint(2 if version < 2 else 4)
        method = cursor.uint(2) & 15 if indexed else 0
        reference = cursor.uint(2)
        base = cursor.sized(base_size)
        extents = []
        for _ in range(cursor.uint(2)):
            index = cursor.sized(index_size) if indexed and index_size else None
            extents.append({"offset": cursor.sized(offset_size), "length": cursor.sized(length_size), "extent_index": index})
        out[item] = {"construction_method": method if method < 3 else 0, "data_reference_index": reference, "base_offset": base, "extents": extents}
    return out


def _parameter_sets(payload: bytes) -> dict:
    if len(payload) < 23:
        raise ImageError("MALFORMED_INPUT", "hvcC is cut short")
    cursor = Cursor(payload, "hvcC", 23)
    sets: dict[int, list[bytes]] = {32: [], 33: [], 34: []}
    try:
        for _ in range(payload[22]):
            kind = cursor.uint(1) & 63
            for _ in range(cursor.uint(2)):
                unit = cursor.take(cursor.uint(2))
                sets.get(kind, []).append(unit)
    except ImageError:
        pass  # units before the cut are kept
    return {"nal_length_size": (payload[21] & 3) + 1, "vps": sets[32], "sps": sets[33], "pps": sets[34]}


def _property(box: Box) -> dict:
    out = {"kind": box.kind}
    if box.kind == "ispe":
        _, _, cursor = box.full()
        out |= {"width": cursor.uint(4), "height": cursor.uint(4)}
    elif box.kind in ("irot", "imir"):
        value = Cursor(box.payload, box.kind).uint(1)
        out |= {"angle_ccw": value & 3} if box.kind == "irot" else {"mirror_axis": value & 1}
    elif box.kind == "colr":
        cursor = Cursor(box.payload, "colr")
        kind = cursor.take(4).decode("latin-1")
        if kind == "nclx":
            out |= {"color_kind": kind, "primaries": cursor.uint(2), "transfer": cursor.uint(2), "matrix": cursor.uint(2), "full_range": cursor.uint(1) >= 128}
        elif kind in ("rICC", "prof"):
            out |= {"color_kind": kind, "icc": cursor.take(cursor.left)}
        else:
            out["kind"] = "other"
    elif box.kind == "auxC":
        _, _, cursor = box.full()
        out |= {"aux_type": cursor.text(), "aux_subtype": cursor.take(cursor.left)}
    elif box.kind == "hvcC":
        out |= _parameter_sets(box.payload)
    return out


def _associations(box: Box, limits: Limits) -> dict[int, list[dict]]:
    version, flags, cursor = box.full()
    count = cursor.uint(4)
    limits.check_items(count)
    wide = 2 if flags & 1 else 1
    out = {}
    for _ in range(count):
        item = cursor.uint(2 if version < 1 else 4)
        raw = [cursor.uint(wide) for _ in range(cursor.uint(1))]
        top = 1 << (8 * wide - 1)
        out[item] = [{"essential": r >= top, "prop_idx": r & (top - 1)} for r in raw]
    return out


def _item_properties(box: Box, limits: Limits) -> tuple[list[dict], dict[int, list[dict]]]:
    properties: list[dict] = []
    associations: dict[int, list[dict]] = {}
    for child in boxes(box.payload):
        if child.kind == "ipco":
            properties = [_property(b) for b in boxes(child.payload)]
        elif child.kind == "ipma":
            for item, found in _associations(child, limits).items():
                associations.setdefault(item, []).extend(found)
    return properties, associations


def _references(box: Box, limits: Limits) -> list[dict]:
    version, _, cursor = box.full()
    wide = 2 if version == 0 else 4
    out = []
    for edge in boxes(cursor.data[cursor.at :]):
        inner = Cursor(edge.payload, "iref")
        source, count = inner.uint(wide), inner.uint(2)
        limits.check_items(count)
        out.append({"ref_type": edge.kind, "from_item_id": source, "to_item_ids": [inner.uint(wide) for _ in range(count)]})
    return out


def _meta(box: Box, limits: Limits, out: Parsed) -> None:
    _, _, cursor = box.full()
    for child in boxes(cursor.data[cursor.at :]):
        if child.kind == "hdlr" and len(child.payload) >= 12:
            out.handler = child.payload[8:12].decode("latin-1")
        elif child.kind == "pitm":
            version, _, inner = child.full()
            wide = 2 if version == 0 else 4
            if inner.left >= wide:
                out.declared_primary = inner.uint(wide)
        elif child.kind == "iloc":
            out.locations = _locations(child, limits)
        elif child.kind == "iinf":
            out.items = _item_info(child, limits)
        elif child.kind == "iprp":
            out.properties, out.associations = _item_properties(child, limits)
        elif child.kind == "iref":
            out.references = _references(child, limits)
        elif child.kind == "idat":
            out.idat = child.payload


def parse(data: bytes, limits: Limits) -> Parsed:
    """All tables of a container. Properties and references inside ``meta`` take precedence over those at the root."""
    if limits.max_file_size is not None and len(data) > limits.max_file_size:
        raise ImageError("LIMIT_INPUT_BYTES", f"{len(data)} bytes")
    found: Parsed | None = None
    brands: tuple[str, list[str]] | None = None
    root_properties, root_references = None, None
    for box in boxes(data):
        if box.kind == "ftyp":
            brands = file_type(box.payload)
            if not detect(box.data):
                raise ImageError("UNSUPPORTED_BRAND", brands[0])
        elif box.kind == "meta":
            found = Parsed()
            _meta(box, limits, found)
        elif box.kind == "iprp":
            root_properties = _item_properties(box, limits)
        elif box.kind == "iref":
            root_references = _references(box, limits)
    if brands is None or found is None:
        raise ImageError("INVALID_CONTAINER", f"no {'ftyp' if brands is None else 'meta'} box")
    found.major_brand, found.compatible_brands = brands
    if found.properties is None:
        found.properties, found.associations = root_properties or ([], {})
    if found.references is None:
        found.references = root_references or []
    return found


def item_data(data: bytes, parsed: Parsed, item: int) -> bytes:
    """An item's extents in order, from the file or from ``idat``."""
    place = parsed.locations.get(item)
    if place is None:
        raise ImageError("INVALID_CONTAINER", f"item {item} has no location")
    if place["construction_method"] == 2:
        raise ImageError("UNSUPPORTED_FEATURE", "items inside items")
    source = data if place["construction_method"] == 0 else parsed.idat
    if source is None:
        raise ImageError("INVALID_CONTAINER", "no idat box")
    out = []
    for extent in place["extents"]:
        start = place["base_offset"] + extent["offset"]
        if start + extent["length"] > len(source):
            raise ImageError("MALFORMED_INPUT", f"extent of item {item} reaches beyond {len(source)} bytes")
        out.append(source[start : start + extent["length"]])
    return b"".join(out)


def grid(payload: bytes, limits: Limits) -> tuple[int, int, int, int]:
    """(rows, columns, width, height) of a grid item's descriptor."""
    if len(payload) < 8:
        raise ImageError("MALFORMED_INPUT", "grid descriptor is cut short")
    cursor = Cursor(payload, "grid descriptor", 1)
    wide = 4 if cursor.uint(1) & 1 else 2
    rows, columns = cursor.uint(1) + 1, cursor.uint(1) + 1
    limits.check_items(rows * columns, "tiles", tiles=True)
    width, height = cursor.uint(wide), cursor.uint(wide)
    limits.check_size(width, height)
    return rows, columns, width, height


def item_property(parsed: Parsed, item: int, kind: str) -> dict | None:
    """The item's first property of a kind."""
    properties = parsed.properties or []
    for a in parsed.associations.get(item, []):
        if 0 < a["prop_idx"] <= len(properties) and properties[a["prop_idx"] - 1]["kind"] == kind:
            return properties[a["prop_idx"] - 1]
    return None


def annex_b(data: bytes, parsed: Parsed, item: int) -> bytes:
    """An item's bitstream: parameter sets, then its units, each behind a start code."""
    payload, config = item_data(data, parsed, item), item_property(parsed, item, "hvcC")
    units = [*config["vps"], *config["sps"], *config["pps"]] if config else []
    wide, at = config["nal_length_size"] if config else 4, 0
    while at + wide <= len(payload):
        length = int.from_bytes(payload[at : at + wide], "big")
        at += wide
        if at + length > len(payload):
            raise ImageError("MALFORMED_INPUT", f"unit of {length} bytes at {at}")
        units.append(payload[at : at + length])
        at += length
    return b"".join(b"\0\0\0\1" + u for u in units)
