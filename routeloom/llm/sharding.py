"""Minimax contiguous partition of documents into shards, in DataFrame operations only.

Documents with equal texts form an atomic group. The groups stand in the order of their first
document and are cut into contiguous shards so that the largest shard is as small as possible:
the smallest feasible capacity is found by search, each candidate being checked greedily against
the groups' running sizes, and the groups are cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.session import materialize

#: Capacities tried at once; each takes one aggregation row, whatever the number of groups.
_TRIED = 63


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row in ``order``, without one task for all.

    Rows are dealt by ranges of ``within`` and ``order``, as many as the session shuffles to; sums
    run inside each range, and the ranges' totals are added.
    """
    within = list(within)
    dealt = materialize(df.withColumn("_v", value).repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*within, "_range").agg(F.sum("_v").alias("_t"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(outer), F.lit(0))).drop("_t")
    return (
        dealt.withColumn("_inner", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
        .join(F.broadcast(base), [*within, "_range"])  # a row for each range, and one more for each group that begins in it
        .withColumn(name, (F.col("_base") + F.col("_inner")).cast("long"))
        .drop("_v", "_range", "_inner", "_base")
    )


def smallest_capacity(groups: DataFrame, shards: int, before: str = "before", size: str = "size") -> tuple[int, list[int]]:
    """The smallest capacity at which ``shards`` contiguous shards hold all groups, and the cuts.

    ``before``: sizes of all earlier groups. Cut k is the running size at which shard k + 1
    starts. Each round tries many capacities side by side; a greedy step over the groups is one
    aggregation that finds, for every capacity, the last group that still fits.
    """
    total, largest = groups.select(F.sum(size), F.max(size)).first()
    if total is None:
        return 0, []
    end = F.col(before) + F.col(size)

    def cuts(capacities: list[int]) -> list[list[int]]:
        reached: list[list[int]] = [[0] for _ in capacities]
        for _ in range(shards):
            found = groups.agg(*[F.max(F.when(end <= r[-1] + c, end)).alias(f"c{k}") for k, (r, c) in enumerate(zip(reached, capacities))]).first()
            for r, x in zip(reached, found):
                r.append(max(r[-1], x or 0))
        return reached

    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    best: list[int] | None = None
    while best is None or low < high:
        width = max(1, -(-(high - low + 1) // _TRIED))
        tried = sorted({min(high, low + width * k) for k in range(_TRIED + 1)})
        fits = [(c, r) for c, r in zip(tried, cuts(tried)) if r[-1] >= total]
        high, best = fits[0]
        low = max([low, *(c + 1 for c in tried if c < high)])
    return high, best[1:-1]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards under the law ``bytes``.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in
    each shard, in the order of ids) and grown_shard (null under this law).
    Null and empty texts have size 1 and form one group. Repeated rows are separate documents of
    one group. A null id is ordered first. Fewer groups than shards leave shards empty; no rows
    in, no rows out. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("ord"),
    )
    rows = materialize(rows, "sizes")
    members = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("ord").alias("first"))
    groups = materialize(running_sum(members, ["first", "digest"], F.col("size"), "before"), "groups")
    _, cuts = smallest_capacity(groups, shards)
    shard = sum([(F.col("before") >= F.lit(c)).cast("int") for c in cuts], F.lit(0)).cast("int")
    placed = rows.join(groups.select("digest", shard.alias("shard")), "digest")
    slots = running_sum(placed.select("doc_id", "size", "text_crc32", "shard", "ord", "digest"), ["ord", "digest"], F.lit(1), "slot", ("shard",))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
