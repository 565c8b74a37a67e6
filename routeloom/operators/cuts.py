"""Cliques and cuts evaluated against edge values.

``members(clique_id, node)``, ``xedges(i, j, x)``, ``cuts(cut_id, rhs)``, ``cut_cliques(cut_id, clique_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _crossings(members: DataFrame, edges: DataFrame, values: list[str]) -> DataFrame:
    """(clique, edge) rows with exactly one end inside: an edge met by both of its ends is inside."""
    one = edges.join(members.withColumnRenamed("node", "i"), "i").select("clique_id", "i", "j", *values)
    two = edges.join(members.withColumnRenamed("node", "j"), "j").select("clique_id", "i", "j", *values)
    return one.unionByName(two).groupBy("clique_id", "i", "j").agg(F.count("*").alias("ends"), *[F.first(v).alias(v) for v in values]).filter("ends = 1").drop("ends")


def clique_delta(members: DataFrame, xedges: DataFrame, x_eps: float = 1e-10) -> DataFrame:
    """clique_id, delta: the sum of x over edges with exactly one end in the clique."""
    crossing = _crossings(members.distinct(), xedges.filter(F.col("x") >= x_eps), ["x"]).groupBy("clique_id").agg(F.sum("x").alias("delta"))
    return members.select("clique_id").distinct().join(crossing, "clique_id", "left").select("clique_id", F.coalesce("delta", F.lit(0.0)).alias("delta"))


def cut_slack(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame, xedges: DataFrame) -> DataFrame:
    """cut_id, slack: the deltas of the cut's cliques less its right-hand side."""
    total = cut_cliques.join(clique_delta(members, xedges), "clique_id").groupBy("cut_id").agg(F.sum("delta").alias("total"))
    return cuts.join(total, "cut_id", "left").select("cut_id", (F.coalesce("total", F.lit(0.0)) - F.col("rhs")).alias("slack"))


def violated_cuts(slack: DataFrame, least: float = 0.001, limit: int = 500) -> DataFrame:
    """The most violated cuts, at most ``limit``."""
    return slack.filter(F.col("slack") < -least).orderBy("slack", "cut_id").limit(limit)


def cliques_in_range(delta: DataFrame, low: float, high: float) -> DataFrame:
    return delta.filter(F.col("delta").between(low, high))


def branch_cliques(delta: DataFrame, m: int, within: float = 0.99) -> DataFrame:
    """The m cliques whose delta is closest to 3."""
    return delta.withColumn("off", F.abs(F.col("delta") - 3.0)).filter(F.col("off") <= within).orderBy("off", "clique_id").limit(m).drop("off")


def cliques_to_segments(members: DataFrame) -> DataFrame:
    """clique_id, lo, hi: maximal runs of consecutive nodes."""
    order = Window.partitionBy("clique_id").orderBy("node")
    rows = members.distinct().withColumn("g", F.col("node") - F.row_number().over(order))
    return rows.groupBy("clique_id", "g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).drop("g")


def segments_to_nodes(segments: DataFrame) -> DataFrame:
    return segments.select("clique_id", F.explode(F.sequence("lo", "hi")).alias("node"))


def clique_sizes(members: DataFrame) -> DataFrame:
    return members.distinct().groupBy("clique_id").agg(F.count("*").alias("size"))


def crossing_pairs(members: DataFrame) -> DataFrame:
    """a, b, shared: cliques that meet while neither of them holds the other.

    Nodes in the same cliques are first put together with their number, so a pair of cliques gets
    one row for each such kind of node, not for each node.
    """
    m = members.distinct()
    sizes = clique_sizes(m)
    kinds = m.groupBy("node").agg(F.sort_array(F.collect_set("clique_id")).alias("of")).filter(F.size("of") > 1).groupBy("of").agg(F.count("*").alias("n"))
    pairs = kinds.select("n", "of", F.explode("of").alias("a")).select("a", "n", F.explode("of").alias("b")).filter("a < b")
    met = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    met = met.join(sizes.withColumnsRenamed({"clique_id": "a", "size": "sa"}), "a").join(sizes.withColumnsRenamed({"clique_id": "b", "size": "sb"}), "b")
    return met.filter("shared < least(sa, sb)").select("a", "b", "shared")


def cut_rows(cut_cliques: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """cut_id, i, j, coef: how many of the cut's cliques the edge crosses."""
    return cut_cliques.join(_crossings(members.distinct(), edges.select("i", "j").distinct(), []), "clique_id").groupBy("cut_id", "i", "j").agg(F.count("*").alias("coef"))
