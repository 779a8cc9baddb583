"""Block transforms, prediction, in-loop filters and run-length coding over relations of samples.

A block relation has ``block_id``, ``x``, ``y`` and a value ``v``. Transforms join with a coefficient relation of at most 1024 rows and
sum; filters and predictions are projections or windows within a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.functions.tables import ANGLES, BETA, INVERSE_ANGLES, JPEG_CHROMA, JPEG_LUMA, LEVEL_SCALE, TC, dct_matrix, matrix


def dequantize(value: Column, size: int, qp: int, bit_depth: int = 8, transform_skip: bool = False) -> Column:
    """Scale a coefficient. A shift of zero adds no rounding term, and a negative qp keeps its true remainder."""
    bits = 7 if transform_skip else size.bit_length() - 1
    scaled = value.cast("long") * LEVEL_SCALE[qp % 6] * (16 if transform_skip else 1)
    shift = 13 + bits - bit_depth - qp // 6
    if shift > 0:
        return F.shiftright(scaled + (1 << (shift - 1)), shift)
    return F.shiftleft(scaled, -shift)


def inverse_transform(blocks: DataFrame, rows: Sequence[Sequence[int]], bit_depth: int = 8) -> DataFrame:
    """Two passes of a separable transform: rows with a shift of 7, then columns with 20 less the bit depth.

    The coefficient relation has a fixed size, so it is broadcast. Samples are partitioned by block once, which serves the aggregations of
    both passes: one shuffle, of the samples themselves and not of their products."""
    table = F.broadcast(matrix(blocks.sparkSession, rows))
    last = 20 - bit_depth
    first = blocks.repartition("block_id").withColumnRenamed("x", "k").join(table, "k").groupBy("block_id", "y", F.col("n").alias("x"))
    half = first.agg(F.shiftright(F.sum(F.col("v") * F.col("c")) + 64, 7).alias("v"))
    second = half.withColumnRenamed("y", "k").join(table, "k").groupBy("block_id", "x", F.col("n").alias("y"))
    return second.agg(F.shiftright(F.sum(F.col("v") * F.col("c")) + (1 << (last - 1)), last).alias("v")).select("block_id", "x", "y", "v")


def inverse_dct(blocks: DataFrame, size: int, bit_depth: int = 8, compat: bool = False) -> DataFrame:
    return inverse_transform(blocks, dct_matrix(size, compat), bit_depth)


def quant_table(base: Sequence[int], quality: Column, place: Column) -> Column:
    """An entry of a JPEG quantisation table scaled to a quality of 1 to 100."""
    q = F.least(F.lit(100), F.greatest(F.lit(1), quality)).cast("long")
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q)
    entry = F.element_at(F.array(*[F.lit(v).cast("long") for v in base]), (place + 1).cast("int"))
    return F.least(F.lit(255), F.greatest(F.lit(1), F.floor((entry * scale + 50) / 100))).cast("long")


def quant_tables(spark, low: int = 1, high: int = 100) -> DataFrame:
    """``(quality, place, luma, chroma)`` for every quality."""
    rows = spark.range(low, high + 1).select(F.col("id").alias("quality"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("place"))
    return rows.select("quality", "place", *[quant_table(t, F.col("quality"), F.col("place")).alias(n) for n, t in (("luma", JPEG_LUMA), ("chroma", JPEG_CHROMA))])


# --- prediction: references are arrays of 2n + 1 samples, the corner first ---


def planar(top: Column, left: Column, x: Column, y: Column, size: int) -> Column:
    n, at = size, F.element_at
    total = (n - 1 - x) * at(left, (y + 2).cast("int")) + (x + 1) * at(top, F.lit(n + 2))
    total = total + (n - 1 - y) * at(top, (x + 2).cast("int")) + (y + 1) * at(left, F.lit(n + 2)) + n
    return F.shiftright(total, n.bit_length())


def dc_value(top: Column, left: Column, size: int) -> Column:
    both = F.concat(F.slice(top, 2, size), F.slice(left, 2, size))
    return F.shiftright(F.aggregate(both, F.lit(size).cast("long"), lambda a, v: a + v), size.bit_length())


def dc(top: Column, left: Column, x: Column, y: Column, size: int, luma: bool = True) -> Column:
    """The mean of the references; for small luma blocks the first row and column lean towards their references."""
    mean = dc_value(top, left, size)
    if not luma or size >= 32:
        return mean
    up, side = F.element_at(top, (x + 2).cast("int")), F.element_at(left, (y + 2).cast("int"))
    corner = F.shiftright(side + 2 * mean + up + 2, 2)
    return F.when((x == 0) & (y == 0), corner).when(y == 0, F.shiftright(up + 3 * mean + 2, 2)).when(x == 0, F.shiftright(side + 3 * mean + 2, 2)).otherwise(mean)


def angular(top: Column, left: Column, x: Column, y: Column, size: int, mode: int, luma: bool = True) -> Column:
    """Directional prediction, modes 2 to 34. Modes from 18 project along the top, others along the left; a negative
    angle extends the main reference by samples of the other side."""
    angle = ANGLES[mode - 2]
    main, side, along, across = (top, left, x, y) if mode >= 18 else (left, top, y, x)
    step = (across + 1) * angle
    place = along + 1 + F.shiftright(step, 5)

    def sample(at: Column) -> Column:
        inside = F.element_at(main, (F.greatest(at, F.lit(0)) + 1).cast("int"))
        if angle >= 0:
            return inside
        inverse = INVERSE_ANGLES[mode - 11]
        other = F.element_at(side, (F.least(F.lit(2 * size), F.greatest(F.lit(0), F.shiftright(at * inverse + 128, 8))) + 1).cast("int"))
        return F.when(at >= 0, inside).otherwise(other)

    part = step.bitwiseAND(F.lit(31).cast("long"))
    value = F.when(part == 0, sample(place)).otherwise(F.shiftright((32 - part) * sample(place) + part * sample(place + 1) + 16, 5))
    if angle == 0 and luma and size < 32:
        edge = sample(along + 1) + F.shiftright(F.element_at(side, (across + 2).cast("int")) - F.element_at(main, 1), 1)
        value = F.when(along == 0, F.least(F.lit(65535), F.greatest(F.lit(0), edge))).otherwise(value)
    return value


def smooth_references(refs: DataFrame, keys: Sequence[str], order: str = "i", value: str = "v") -> DataFrame:
    """Three-tap smoothing along a line of references; both ends keep their value."""
    line = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    smooth = F.shiftright(before + 2 * F.col(value) + after + 2, 2)
    return refs.withColumn("smooth", F.coalesce(smooth, F.col(value)))


def smoothing_wanted(size: int, mode: int) -> bool:
    """Whether luma references of a block are smoothed before prediction in a mode (0 planar, 1 mean, 2 to 34 directions)."""
    if size == 8:
        return mode in (0, 2, 18, 22, 26, 30, 34)
    near = {16: (9, 10, 11, 25, 26, 27), 32: (10, 26)}
    return size in near and mode not in near[size]


def filtered_references(top: Column, left: Column, size: int, mode: int, bit_depth: int = 8) -> tuple[Column, Column]:
    """Reference arrays as prediction takes them: as they are, smoothed by three taps around the shared corner, or for flat blocks of 32
    the straight line from the corner to either end."""
    if not smoothing_wanted(size, mode):
        return top, left
    whole = 2 * size
    at = lambda line, i: F.element_at(line, F.lit(i + 1)).cast("long")
    corner = F.shiftright(at(left, 1) + 2 * at(top, 0) + at(top, 1) + 2, 2)

    def taps(line: Column) -> Column:
        near = lambda i: F.element_at(line, i + 1).cast("long")
        inner = F.transform(F.sequence(F.lit(1), F.lit(whole - 1)), lambda i: F.shiftright(near(i - 1) + 2 * near(i) + near(i + 1) + 2, 2))
        return F.concat(F.array(corner), inner, F.array(at(line, whole)))

    if size != 32:
        return taps(top), taps(left)

    def straight(line: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(whole))
        return F.concat(F.array(at(line, 0)), F.transform(places, lambda i: F.shiftright((whole - i) * at(top, 0) + i * at(line, whole) + 32, 6).cast("long")))

    bend = lambda line: F.abs(at(line, 0) - 2 * at(line, size) + at(line, whole))
    flat = (bend(top) < 1 << (bit_depth - 5)) & (bend(left) < 1 << (bit_depth - 5))
    return F.when(flat, straight(top)).otherwise(taps(top)), F.when(flat, straight(left)).otherwise(taps(left))


# --- filters ---


def _clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    return F.least(F.lit(high) if isinstance(high, int) else high, F.greatest(F.lit(low) if isinstance(low, int) else low, value))


def deblock_edge(p: Sequence[Column], q: Sequence[Column], qp: int, beta_offset: int = 0, tc_offset: int = 0, bit_depth: int = 8) -> dict[str, Column]:
    """New p1, p0, q0, q1 across one edge from the three samples on either side (nearest first)."""
    beta = BETA[min(51, max(0, qp + beta_offset))] << (bit_depth - 8)
    tc = TC[min(53, max(0, qp + 2 + tc_offset))] << (bit_depth - 8)
    top = (1 << bit_depth) - 1
    same = {"p1": p[1], "p0": p[0], "q0": q[0], "q1": q[1]}
    if not beta or not tc:
        return same
    dp, dq = F.abs(p[2] - 2 * p[1] + p[0]), F.abs(q[2] - 2 * q[1] + q[0])
    delta = _clamp(F.shiftright(9 * (q[0] - p[0]) - 3 * (q[1] - p[1]) + 8, 4), -tc, tc)
    on, side = dp + dq < beta, (beta + (beta >> 1)) >> 3

    def outer(near: Column, middle: Column, far: Column, change: Column) -> Column:
        move = F.shiftright(F.shiftright(far + near + 1, 1) - middle + change, 1)
        return _clamp(middle + _clamp(move, -(tc >> 1), tc >> 1), 0, top)

    new = {
        "p1": F.when(on & (dp < side), outer(p[0], p[1], p[2], delta)),
        "p0": F.when(on, _clamp(p[0] + delta, 0, top)),
        "q0": F.when(on, _clamp(q[0] - delta, 0, top)),
        "q1": F.when(on & (dq < side), outer(q[0], q[1], q[2], -delta)),
    }
    return {k: F.coalesce(v, same[k]).cast("long") for k, v in new.items()}


def sao_band(value: Column, start: int, offsets: Sequence[int], bit_depth: int = 8) -> Column:
    """Add an offset to samples of four neighbouring bands of 32."""
    band = F.shiftright(value, bit_depth - 5)
    out = F.when(F.lit(False), value)
    for i, offset in enumerate(offsets):
        out = out.when(band == start + i, _clamp(value + offset, 0, (1 << bit_depth) - 1))
    return out.otherwise(value).cast("long")


def sao_edge_row(row: Column, offsets: Sequence[int], bit_depth: int = 8) -> Column:
    """Edge offsets along one row, in place: the left neighbour is taken as already changed, ends stay."""
    top = (1 << bit_depth) - 1
    first = F.slice(row, 1, 1)

    def step(done: Column, i: Column) -> Column:
        a, c, b = F.element_at(done, -1), F.element_at(row, i), F.element_at(row, i + 1)
        sign = F.signum(c - a) + F.signum(c - b)
        offset = F.when(sign == -2, offsets[0]).when(sign == -1, offsets[1]).when(sign == 1, -offsets[2]).when(sign == 2, -offsets[3]).otherwise(0)
        return F.concat(done, F.array(_clamp(c + offset, 0, top).cast("long")))

    inner = F.when(F.size(row) > 2, F.sequence(F.lit(2), F.size(row) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.aggregate(inner, first, step), F.when(F.size(row) > 1, F.slice(row, -1, 1)).otherwise(F.array().cast("array<bigint>")))


def sao_edge(samples: DataFrame, edge_class: int, width: int, height: int, offsets: Sequence[int], key: str = "image_id", bit_depth: int = 8) -> DataFrame:
    """Edge offsets of blocks ``(key, x, y, v)`` along rows (class 0), columns (1), falling (2) or rising diagonals (3), in place.

    Samples on one line only ever see that line, so a line is the unit of work: one shuffle by block and line. The rim stays."""
    line, along = {0: ("y", "x"), 1: ("x", "y"), 2: ("x - y", "y"), 3: ("x + y", "y")}[edge_class]
    lines = samples.groupBy(key, F.expr(line).alias("line")).agg(F.sort_array(F.collect_list(F.struct(F.expr(along).alias("along"), "x", "y", "v"))).alias("s"))
    before = F.transform("s", lambda s: s["v"].cast("long"))
    rim = F.col("line").isin(0, (height if edge_class == 0 else width) - 1) if edge_class < 2 else F.lit(False)
    changed = lines.withColumn("new", F.when(rim, before).otherwise(sao_edge_row(before, offsets, bit_depth)))
    rows = changed.select(key, F.explode(F.arrays_zip("s", "new")).alias("r"))
    return rows.select(key, "r.s.x", "r.s.y", F.col("r.new").alias("v"))


def reconstruct(predicted: Column, residual: Column, bit_depth: int = 8) -> Column:
    """A sample from its prediction and residual."""
    return _clamp(predicted + residual, 0, (1 << bit_depth) - 1).cast("long")


# --- run lengths ---


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """``(symbol, bits, code)`` of a Huffman table given as ``(place, symbol, bits)``: within the order of places, a code is the sum
    of the spans of all codes before, read at its own length."""
    line = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (16 - F.col("bits")).cast("int"))
    before = F.coalesce(F.sum(span).over(line), F.lit(0).cast("long"))
    return lengths.select("symbol", "bits", F.call_function("shiftright", before, (16 - F.col("bits")).cast("int")).alias("code"))


def run_lengths(coefficients: DataFrame, key: str = "block_id", order: str = "i", value: str = "v") -> DataFrame:
    """Non-zero AC coefficients in zigzag order with the zeros before each: ``(key, i, v, run, skips, bits)``; ``skips``
    counts whole runs of 16 zeros, ``run`` what remains, ``bits`` the length of the value's code."""
    line = Window.partitionBy(key).orderBy(order)
    kept = coefficients.where((F.col(order) > 0) & (F.col(value) != 0)).select(key, order, value)
    zeros = F.col(order) - F.coalesce(F.lag(order).over(line), F.lit(0)) - 1
    return kept.withColumn("zeros", zeros).select(
        key, order, value, (F.col("zeros") % 16).cast("long").alias("run"), F.floor(F.col("zeros") / 16).cast("long").alias("skips"), category(F.col(value)).alias("bits")
    )


def category(value: Column) -> Column:
    """Bits of a coefficient's magnitude."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value)))).cast("long")


def code_bits(value: Column) -> Column:
    """The magnitude's bits; negative values as ones' complement."""
    size = category(value)
    return F.when(value < 0, value + F.call_function("shiftleft", F.lit(1).cast("long"), size.cast("int")) - 1).otherwise(value)


def dc_differences(blocks: DataFrame, keys: Sequence[str], order: str, value: str = "v") -> DataFrame:
    """Each block's DC value less the one before in its picture and component (``keys``)."""
    line = Window.partitionBy(*keys).orderBy(order)
    return blocks.withColumn("diff", F.col(value) - F.coalesce(F.lag(value).over(line), F.lit(0)))
