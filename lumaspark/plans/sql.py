"""Functions for SQL over bytes of files, registered by name.

Scalar: ``image_detect(content)``, ``image_probe(content)``, ``image_inspect(content)``, ``image_convert(content, format, quality)``,
``image_raw_pixels(content, pixel_format)``, ``image_decode_item(content, item_id)``, ``image_adler32(data)``. Table functions, for
``lateral`` joins: ``image_boxes``, ``image_items``, ``image_extents``, ``image_properties``, ``image_refs``, ``image_nals``. A null content
counts as empty. Scalar functions give whatever is wrong with a value as their ``error`` field; table functions give no rows for it,
but boxes up to the first bad one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf
from pyspark.sql.types import DecimalType, _parse_datatype_string

from lumaspark.functions.limits import Limits
from lumaspark.operators import encode, hevc
from lumaspark.sources import container, files

from .convert import ERROR, IMAGE, Options, checked, decode_picture, flatten, image_row, raw_image

NAL = "struct<item_id:bigint,nal_ord:int,nal_type:int,layer_id:int,tid_plus1:int,rbsp_length:int>"
PROBED = f"struct<{files.METADATA.removeprefix('file_id string, ')}>"
INSPECTED = f"struct<width:bigint,height:bigint,image_count:bigint,has_alpha:boolean,error:{ERROR}>"


def caught(work: Callable[..., dict]) -> Callable[..., dict]:
    """``work`` over bytes, with its failure as the error field."""

    def run(content: bytes | None, *rest) -> dict:
        try:
            return work(bytes(content or b""), *rest)
        except Exception as e:  # whatever is wrong with one value is that row's error
            return {"error": files.failure(e)}

    return run


def probe(content: bytes) -> dict:
    return files.describe("", len(content), content)


def inspect(content: bytes) -> dict:
    found = probe(content)
    return found | {"image_count": found.get("item_count")}


def converted(content: bytes, kind: str, quality: float) -> dict:
    chosen = Options.of({"format": kind, "quality": quality})
    pixels, _ = decode_picture(checked(content, chosen.limits), chosen.limits, chosen.apply_orientation)
    if chosen.format == "heic":
        return {"data": content}
    flat = flatten(pixels, chosen.background) if chosen.format == "jpeg" else pixels
    return {"data": encode.ENCODERS[chosen.format](flat, quality=chosen.quality)}


def raw_pixels(content: bytes, pixel_format: str | None) -> dict:
    return {"image": raw_image("", content, Options.of({"pixelFormat": pixel_format}))}


def decode_item(content: bytes, item: int) -> dict:
    """One item's own picture, as it is coded."""
    limits = Limits()
    return {"image": image_row("", hevc.decode(container.annex_b(content, container.parse(content, limits), item), limits).rgb(), "rgb8")}


def boxes(content: bytes) -> list[dict]:
    rows: list[dict] = []
    try:
        container.walk(content, out=rows)
    except Exception:  # rows before the bad box are kept
        pass
    return rows


def nals(content: bytes) -> Iterator[dict]:
    """Units of every item that holds a coded picture, parameter sets first."""
    found = container.parse(content, Limits())
    for item, entry in sorted(found.items.items()):
        if entry["item_type"] == "hvc1":
            for i, unit in enumerate(hevc.units(container.annex_b(content, found, item))):
                yield {"item_id": item, "nal_ord": i, "nal_type": unit.kind, "layer_id": unit.layer, "tid_plus1": unit.temporal, "rbsp_length": len(unit.rbsp)}


def _part(name: str) -> Callable[[bytes], list[dict]]:
    return lambda content: files.record("", len(content), content, Limits()).get(name) or []


def _table(work: Callable[[bytes], list[dict] | Iterator[dict]], schema: str):
    """A table function over bytes."""
    kind = _parse_datatype_string(schema)
    made = [(f.name, Decimal if isinstance(f.dataType, DecimalType) else lambda value: value) for f in kind.fields]

    class Rows:
        def eval(self, content: bytes):
            try:
                rows = list(work(bytes(content or b"")))
            except Exception:  # no table can be read from it
                rows = []
            for row in rows:
                yield tuple(None if row.get(name) is None else make(row[name]) for name, make in made)

    return udtf(Rows, returnType=kind)


def register(spark: SparkSession) -> None:
    """Make all functions callable from SQL of this session."""
    scalar = {
        "image_detect": (lambda content: container.detect(bytes(content or b"")), "boolean"),
        "image_adler32": (lambda data: zlib.adler32(bytes(data or b"")), "bigint"),
        "image_probe": (caught(probe), PROBED),
        "image_inspect": (caught(inspect), INSPECTED),
        "image_convert": (caught(converted), f"struct<data:binary,error:{ERROR}>"),
        "image_raw_pixels": (caught(raw_pixels), f"struct<image:{IMAGE},error:{ERROR}>"),
        "image_decode_item": (caught(decode_item), f"struct<image:{IMAGE},error:{ERROR}>"),
    }
    for name, (work, kind) in scalar.items():
        spark.udf.register(name, udf(work, kind))
    table = {
        "image_boxes": (boxes, files.BOX), "image_items": (_part("items"), files.ITEM), "image_extents": (_part("extents"), files.EXTENT),
        "image_properties": (_part("properties"), files.PROPERTY), "image_refs": (_part("refs"), files.REF), "image_nals": (nals, NAL),
    }
    for name, (work, kind) in table.items():
        spark.udtf.register(name, _table(work, kind))
