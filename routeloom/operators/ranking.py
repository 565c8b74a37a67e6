"""Exact ranks of all rows of a table without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.session import materialize


def ranked(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's rank from 0 in its group, by ``order``.

    Rows are dealt by ranges of (group, order) and counted in each range; a row's rank is its
    place in its range plus the counts of the ranges before it. No task holds more than a range,
    however large a group is. ``order`` has to tell the rows of a group apart.
    """
    group = group or []
    dealt = materialize(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    rows = dealt.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, ["_range", *group])
    return rows.select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one by ``order``, which has to tell rows apart.

    As in :func:`ranked` ranges are summed up apart, so no task holds more than one of them.
    """
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.sum(value).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_place", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, "_range")
    return rows.select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def range_best(values: DataFrame, ranges: DataFrame, group: list[str], best: dict[str, Callable]) -> DataFrame:
    """``ranges`` (group, lo, hi and other columns) with the best of each column of ``best`` over the positions lo to hi.

    ``values`` (group, pos and the columns) has every position once, without gaps; ``best`` says what
    two values come to: ``F.least`` or ``F.greatest``. Step k holds the best of 2^k positions from
    each one on, and answers the ranges of 2^k to 2^(k+1) - 1 positions from both of their ends.
    """
    names = list(best)
    size = F.col("hi") - F.col("lo") + 1
    longest = ranges.agg(F.max(size)).first()[0] or 0
    level, found, width = values.select(*group, "pos", *names), None, 1
    while True:
        part = ranges.filter((size >= width) & (size < 2 * width))
        for side, at in (("a", F.col("lo")), ("b", F.col("hi") - (width - 1))):
            held = level.select(*group, F.col("pos").alias("_at"), *[F.col(c).alias(f"_{side}{c}") for c in names])
            part = part.withColumn("_at", at).join(held, [*group, "_at"]).drop("_at")
        part = part.select(*ranges.columns, *[f(F.col(f"_a{c}"), F.col(f"_b{c}")).alias(c) for c, f in best.items()])
        found = part if found is None else found.unionByName(part)
        if 2 * width > longest:
            return found
        ahead = level.select(*group, (F.col("pos") - width).alias("pos"), *[F.col(c).alias(f"_{c}") for c in names])
        level = materialize(level.join(ahead, [*group, "pos"]).select(*group, "pos", *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in best.items()]), "range-level")
        width *= 2
