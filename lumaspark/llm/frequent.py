"""The most frequent rows of a counted table, without ranking it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps in which a count doubles.
STEPS = 8


def most_frequent(table: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """Rows of the largest counts, ``limit`` at most, in no order.

    Counts fall into classes of about 9 % each; a histogram of a few hundred rows tells which classes fit, and only their rows are
    selected. Whole classes are taken, so the choice depends on the counts alone; rows of the class that would exceed the limit
    are left out with all smaller ones, unless it is the very first (then the first rows by the other columns count)."""
    step = F.floor(F.log2(F.col(count)) * STEPS).cast("int")
    classes = sorted(((r.step, r.rows) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for number, rows in classes:
        if total + rows > limit:
            break
        total, least = total + rows, number
    if least is None:
        others = [c for c in table.columns if c != count]
        return table.where(step == classes[0][0]).orderBy(F.desc(count), *others).limit(limit) if classes else table.limit(0)
    return table.where(step >= least)
