"""Tours ``tour(tour_id, pos, node)``: many in one table; each is a cycle over its positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norms import length_col
from ..jobs.session import materialize


def _next(tour: DataFrame, nodes: DataFrame, norm: str, closed: bool) -> DataFrame:
    """Each position with its successor and their length; a self-join on pos + 1, so one long tour is spread too."""
    point = F.struct(*[c for c in nodes.columns if c != "id"])
    rows = tour.join(nodes.select(F.col("id").alias("node"), point.alias("p")), "node")
    after = rows.select("tour_id", (F.col("pos") - 1).alias("pos"), F.col("node").alias("to"), F.col("p").alias("q"))
    ends = tour.groupBy("tour_id").agg(F.max("pos").alias("pos"), F.count("*").alias("n")).filter("n > 1").drop("n")
    if closed:
        first = rows.filter("pos = 0").select("tour_id", F.col("node").alias("to"), F.col("p").alias("q"))
        after = after.filter("pos >= 0").unionByName(first.join(ends, "tour_id").select("tour_id", "pos", "to", "q"))
    return rows.join(after, ["tour_id", "pos"]).select("tour_id", "pos", "node", "to", length_col(norm, F.col("p"), F.col("q")).alias("len"))


def tour_edges(tour: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, pos, i, j, len with the closing edge."""
    return _next(tour, nodes, norm, True).select("tour_id", "pos", F.col("node").alias("i"), F.col("to").alias("j"), "len")


def tour_length(tour: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, len of the cycle (0 for a single node)."""
    return tour.select("tour_id").distinct().join(_next(tour, nodes, norm, True).groupBy("tour_id").agg(F.sum("len").alias("len")), "tour_id", "left").select("tour_id", F.coalesce("len", F.lit(0)).alias("len"))


def path_length(tour: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, len without the closing edge."""
    return tour.select("tour_id").distinct().join(_next(tour, nodes, norm, False).groupBy("tour_id").agg(F.sum("len").alias("len")), "tour_id", "left").select("tour_id", F.coalesce("len", F.lit(0)).alias("len"))


def partial_tour_sum(tour: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    return tour_length(tour, nodes, norm).agg(F.sum("len").alias("len"))


def check_tour(tour: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that a tour misses, has twice or more, or that don't exist: node, n, problem."""
    counts = tour.groupBy("node").agg(F.count("*").alias("n"))
    both = counts.join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("known")), "node", "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("node", F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem")).filter("problem is not null")


def induced_order(parts: DataFrame, tour: DataFrame) -> DataFrame:
    """part_id, id, rank: the order that the tour gives to each part's nodes."""
    rows = parts.join(tour.select(F.col("node").alias("id"), "pos"), "id")
    return rows.select("part_id", "id", (F.row_number().over(Window.partitionBy("part_id").orderBy("pos")) - 1).alias("rank"))


def tour_segments(tour: DataFrame, bucket: int, first: int | None = None) -> DataFrame:
    """tour_id, pos, node, seg_id: consecutive stretches; a remainder of over bucket/16 is its own segment."""
    first = bucket if first is None else first
    n = tour.groupBy("tour_id").agg(F.count("*").alias("n"))
    rest = F.greatest(F.col("n") - first, F.lit(0))
    left = F.pmod(rest, F.lit(bucket))
    count = F.greatest(1 + F.floor(rest / bucket) + F.when(left > F.lit(bucket / 16), 1).otherwise(0), F.lit(1))
    seg = F.when(F.col("pos") < first, F.lit(0)).otherwise(1 + F.floor((F.col("pos") - first) / bucket))
    return tour.join(n.select("tour_id", (count - 1).alias("last")), "tour_id").select("tour_id", "pos", "node", F.least(seg, F.col("last")).cast("long").alias("seg_id"))


def tour_positions(tour: DataFrame) -> DataFrame:
    """tour_id, node, pos: where each node stands."""
    return tour.select("tour_id", "node", "pos")


def steps(tour: DataFrame) -> DataFrame:
    """tour_id, pos, i, j: each position's edge to the next, the closing one too, without lengths."""
    sizes = tour.groupBy("tour_id").agg(F.count("*").alias("n")).filter("n > 1")
    rows = tour.join(sizes, "tour_id")
    after = rows.select("tour_id", F.pmod(F.col("pos") - 1, "n").alias("pos"), F.col("node").alias("j"))
    return rows.select("tour_id", "pos", F.col("node").alias("i")).join(after, ["tour_id", "pos"])


def uses_only_real_edges(tour: DataFrame, edges: DataFrame) -> DataFrame:
    """tour_id, n_missing, ok: how many of the tour's edges the graph lacks."""
    pairs = steps(tour).select("tour_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    known = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(1).alias("known")).distinct()
    found = pairs.join(known, ["i", "j"], "left").groupBy("tour_id").agg(F.count_if(F.col("known").isNull()).alias("n_missing"))
    return found.select("tour_id", "n_missing", (F.col("n_missing") == 0).alias("ok"))


def tour_file_length(edges: DataFrame, n: int) -> int:
    """The sum of a tour's stored lengths; its n edges are checked."""
    m, total = edges.agg(F.count("*"), F.sum("len")).first()
    if m != n:
        raise ValueError(f"{m} edges for {n} nodes")
    return total


#: Edges of a tour that one task walks along; longer tours take rounds of joins.
LOCAL_TOUR = 50_000


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, list[int]] = {}
    for u, v in zip(rows["u"].tolist(), rows["v"].tolist()):
        near.setdefault(u, []).append(v)
    start = min(near)
    path, last, now = [start], start, min(near[start])
    while now != start:
        path.append(now)
        last, now = now, next((v for v in near[now] if v != last), start)
    return pd.DataFrame({"tour_id": rows["tour_id"].iloc[0], "pos": range(len(path)), "node": path})


def _check_whole(sizes: DataFrame, tours: DataFrame) -> None:
    """Raise an error if a tour hasn't the ``n`` nodes that its edges have."""
    found = tours.groupBy("tour_id").agg(F.count("*").alias("found"))
    if off := sizes.join(found, "tour_id", "left").filter("found is null or found != n").take(1):
        raise ValueError(f"the edges of tour {off[0]['tour_id']} aren't one cycle of its {off[0]['n']} nodes")


def edges_to_tour(edges: DataFrame) -> DataFrame:
    """tour_id, pos, node of tours given as edges (i, j, and tour_id if there are several).

    A tour starts at its smallest node, towards the smaller neighbour. Each undirected edge is two
    arcs; an arc's follower leaves the node it enters by the other edge. The arc that would return
    to the start has none, and the distance to it is found by doubling the followers' reach, in
    log2(n) joins; tours of up to ``LOCAL_TOUR`` edges are walked, each in one task. Where a tour's
    edges are several cycles, or a node hasn't two of them, it is an error.
    """
    e = edges if "tour_id" in edges.columns else edges.withColumn("tour_id", F.lit(0).cast("long"))
    both = e.select("tour_id", F.col("i").alias("u"), F.col("j").alias("v")).unionByName(e.select("tour_id", F.col("j").alias("u"), F.col("i").alias("v"))).filter("u != v").distinct()
    both = materialize(both.select(F.col("tour_id").cast("long").alias("tour_id"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "ends")
    degrees = both.groupBy("tour_id", "u").agg(F.count("*").alias("d"))
    sizes = degrees.groupBy("tour_id").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    sizes = materialize(sizes.withColumn("short", F.col("n") <= max(LOCAL_TOUR, 2)), "tour-sizes")
    if off := sizes.filter("n > 2 and (low != 2 or high != 2)").take(1):
        raise ValueError(f"the edges of tour {off[0]['tour_id']} aren't one cycle: a node has {off[0]['low']} and one {off[0]['high']} of them")
    walked = both.join(sizes.filter("short").select("tour_id"), "tour_id").groupBy("tour_id").applyInPandas(_walked, "tour_id long, pos long, node long")
    walked = materialize(walked, "walked")
    _check_whole(sizes.filter("short"), walked)
    longest = sizes.filter("not short").agg(F.max("n")).first()[0]
    if longest is None:
        return walked
    both = both.join(sizes.filter("not short").select("tour_id"), "tour_id")
    start = both.groupBy("tour_id").agg(F.min(F.struct("u", "v")).alias("s"))
    on = both.select("tour_id", F.col("u").alias("v"), F.col("v").alias("w"))
    arcs = both.join(on, ["tour_id", "v"]).filter("u != w").join(start, "tour_id")
    ends = (F.col("v") == F.col("s.u")) & (F.col("w") == F.col("s.v"))
    now = materialize(arcs.select("tour_id", "u", "v", F.when(~ends, F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("next"), F.when(ends, 0).otherwise(1).cast("long").alias("far")), "arcs")
    for _ in range(longest.bit_length()):
        ahead = now.select("tour_id", F.struct("u", "v").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        open_ = now.filter("next is not null").join(ahead, ["tour_id", "next"]).select("tour_id", "u", "v", F.col("_next").alias("next"), (F.col("far") + F.col("_far")).alias("far"))
        now = materialize(now.filter("next is null").unionByName(open_), "arcs")
    chain = now.filter("next is null")
    last = chain.groupBy("tour_id").agg(F.max("far").alias("last"))
    found = materialize(chain.join(last, "tour_id").select("tour_id", (F.col("last") - F.col("far")).alias("pos"), F.col("u").alias("node")), "placed")
    _check_whole(sizes.filter("not short"), found)
    return walked.unionByName(found)
