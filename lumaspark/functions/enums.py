"""Enumerations as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import NAL_TYPES, ORIENTATIONS, OUTPUT_FORMATS, TRANSPOSING

_ALIASES = {"image/jpg": "jpeg", "jpg": "jpeg"}


def output_format(text: Column) -> Column:
    """Format of a MIME type, name or extension; case and outer spaces do not count; null if unknown."""
    names = {key: name for name, mime, ext, _ in OUTPUT_FORMATS for key in (name, mime, ext)} | _ALIASES
    clean, out = F.lower(F.trim(text)), F.lit(None).cast("string")
    for name in dict.fromkeys(names.values()):
        out = F.when(clean.isin(*[k for k, v in names.items() if v == name]), name).otherwise(out)
    return out


def nal_name(kind: Column) -> Column:
    """Name of a unit type; OTHER for unnamed numbers."""
    out = F.lit("OTHER")
    for number, name in NAL_TYPES.items():
        out = F.when(kind == number, name).otherwise(out)
    return out


def nal_is_irap(kind: Column) -> Column:
    return kind.between(16, 21)


def nal_is_slice(kind: Column) -> Column:
    return kind.isin(0, 1) | nal_is_irap(kind)


def orientation(tag: Column) -> Column:
    """The tag if it is one, else null."""
    return F.when(tag.isin(*ORIENTATIONS), tag)


def oriented(width: Column, height: Column, tag: Column) -> tuple[Column, Column]:
    """Width and height after an orientation is applied."""
    swap = tag.isin(*TRANSPOSING)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def context_state(value: Column, qp: Column) -> tuple[Column, Column]:
    """(state, likely symbol) of an entropy-coding context from its initial value and the slice's qp."""
    slope, offset = F.shiftright(value, 4) * 5 - 45, F.shiftleft(value.bitwiseAND(15), 3) - 16
    start = F.least(F.lit(126), F.greatest(F.lit(1), F.shiftright(slope * qp, 4) + offset))
    return F.when(start >= 64, start - 64).otherwise(63 - start), (start >= 64).cast("int")
