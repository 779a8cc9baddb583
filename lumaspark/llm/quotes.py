"""Conversations without quotations, ordered by reply.

Messages are parsed into their own passages and quoted passages with nesting levels. Normalised passages are hashed and
joined with the message of the same conversation that first said them; the join tells what a message replies to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Letters, digits and spaces that a quoted passage needs at least: shorter ones ("Yes") say nothing about whose they are.
LEAST = 8

_MARKS = re.compile(r"^(?:\s*>)+ ?")
_SAID = re.compile(r"^\s*(?:on\b.{0,300}\bwrote|.{0,200}\bwrote|.{0,200}\ba écrit|.{0,200}\bschrieb.{0,200}|.{0,200}\bescribió)\s*:\s*$", re.I)
_WORD = re.compile(r"[^\W_]+")


def normalised(passage: str) -> str:
    """Lower-cased letters and digits with single spaces: wrapping, indents and punctuation do not count."""
    return " ".join(_WORD.findall(passage.lower()))


def _hash(passage: str, least: int = 1) -> int | None:
    words = normalised(passage)
    return xxhash.xxh3_64_intdigest(words) - 2**63 if len(words) >= least else None


def parse(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) in order. Level 0 is the message's own text; a passage is a run of lines of one level. A line that
    only names the author of the quotation below it is dropped."""
    lines = (text or "").split("\n")
    levels = [0] * len(lines)
    for i, line in enumerate(lines):
        mark = _MARKS.match(line)
        if mark:
            levels[i], lines[i] = mark[0].count(">"), line[mark.end() :]
    out: list[tuple[int, list[str]]] = []
    for i, (level, line) in enumerate(zip(levels, lines, strict=True)):
        following = next((levels[j] for j in range(i + 1, min(i + 3, len(lines))) if levels[j] or lines[j].strip()), 0)
        if following > level and _SAID.match(line):
            continue
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(part)) for level, part in out]


def passages(text: str) -> list[str]:
    """The forms under which a passage can be quoted: whole, by paragraph, by line."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return list(dict.fromkeys(p for p in parts if p.strip()))


def own_text(text: str | None) -> str:
    """The message without quotations, trimmed, at most one empty line in a row."""
    kept = "\n".join(part.strip("\n") for level, part in parse(text) if level == 0)
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", kept).strip()


def _parse_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parsed(batch)

    def parsed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            own, said, quoted, levels = [], [], [], []
            for text in rows.column("text").to_pylist():
                parts = parse(text)
                clean = own_text(text)
                own.append(clean)
                hashes = {_hash(p) for level, part in parts if level == 0 for p in [*passages(part)]} | {_hash(clean)}
                said.append(sorted(h for h in hashes if h is not None))
                found = {(_hash(p, least), level) for level, part in parts if level > 0 for p in passages(part)}
                found = sorted(x for x in found if x[0] is not None)
                quoted.append([h for h, _ in found])
                levels.append([level for _, level in found])
            arrays = [pa.array(own, pa.string()), *(pa.array([np.array(x, np.int64) for x in c], pa.list_(pa.int64())) for c in (said, quoted, levels))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("conv", "turn", "role")), *arrays], names=["conv", "turn", "role", "text", "said", "quoted", "levels"])

    return run


def reply_ordered(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 1024, least: int = LEAST
) -> DataFrame:
    """``(conv_id, turn, role, text, position, reply_to, n_quoted, n_linked)``, one row per message.

    ``text`` is the message without quotations. A quoted passage links to the earliest message of the conversation that
    holds it as its own text, if that message is older. ``reply_to`` is the turn of the latest message linked by a
    passage of the lowest level that links at all; without any it is the conversation's previous turn, null for its first.
    ``position`` counts the conversation's messages of smaller turn, so a reply always stands after what it replies to.
    ``n_quoted`` and ``n_linked`` count distinct quoted passages of at least ``least`` normalised characters and those that were
    found; shorter ones are taken out of the text but link to nothing.

    Messages that share conversation and turn (repeated rows too) share a position; their passages count as one message's
    for originals. Null texts are empty; very long ones are parsed whole, a few at a time; messages with a null conversation or turn are returned without position
    and links. Other columns are ignored; an empty table gives an empty table.

    No conversation is gathered in one task: originals are minima, quotations join them by passage, and turns are numbered in
    blocks of ``block`` distinct turn values whose totals are then summed.
    """
    scratch = Scratch(messages.sparkSession)
    rows = messages.select(
        messages[conv_col].cast("long").alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].cast("string").alias("text")
    )
    schema = "conv long, turn long, role string, text string, said array<long>, quoted array<long>, levels array<long>"
    parsed = scratch.keep(rows.mapInArrow(_parse_batches(least), schema).withColumn("msg", F.monotonically_increasing_id()), "parsed")
    placed = parsed.where("conv is not null and turn is not null")

    quoted = placed.where(F.size("quoted") > 0).select("msg", "conv", "turn", F.explode(F.arrays_zip("quoted", "levels")).alias("q"))
    quoted = quoted.select("msg", "conv", "turn", F.col("q.quoted").alias("hash"), F.col("q.levels").alias("level"))
    links = None
    if not quoted.isEmpty():
        wanted = quoted.select("conv", "hash").distinct()
        said = placed.select("conv", "turn", F.explode("said").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
        origins = scratch.keep(said.join(wanted, ["conv", "hash"], "left_semi"), "origins")
        found = quoted.join(origins, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
        best = F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level"), (-F.col("origin")).alias("minus"))))
        links = found.groupBy("msg").agg(
            F.countDistinct("hash").alias("n_quoted"), F.countDistinct(F.when(F.col("origin").isNotNull(), F.col("hash"))).alias("n_linked"), (-best["minus"]).alias("linked")
        )

    turns = scratch.keep(placed.groupBy("conv", "turn").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("turn") / block)), "turns")
    totals = turns.groupBy("conv", "block").agg(F.sum("n").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.max("last").over(earlier).alias("last"))
    within = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.select("conv", "block", "turn", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("own"), F.max("turn").over(within).alias("prev"))
    numbered = scratch.keep(
        inside.join(base, ["conv", "block"]).select("conv", "turn", (F.col("base") + F.col("own")).alias("position"), F.coalesce("prev", "last").alias("previous")), "numbered"
    )
    out = placed.drop("said", "quoted", "levels").join(numbered, ["conv", "turn"], "left")
    unplaced = parsed.where("conv is null or turn is null").drop("said", "quoted", "levels")
    out = out.unionByName(unplaced.withColumns({"position": F.lit(None).cast("long"), "previous": F.lit(None).cast("long")}))
    if links is None:
        out = out.withColumns({"n_quoted": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long"), "linked": F.lit(None).cast("long")})
    else:
        out = out.join(links, "msg", "left")
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("text").alias(text_col),
        "position",
        F.coalesce("linked", "previous").alias("reply_to"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
