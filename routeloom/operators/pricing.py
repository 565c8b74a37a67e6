"""Reduced costs of edges against dual values, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norms import length_col
from ..jobs.session import materialize
from .components import component_labels
from .neighbors import NORM_CELLS


def clique_duals(cut_pi: DataFrame, cut_cliques: DataFrame) -> DataFrame:
    """clique_id, pi: the duals of the cuts that use the clique, each time they do."""
    return cut_cliques.join(cut_pi, "cut_id").groupBy("clique_id").agg(F.sum("pi").alias("pi"))


def node_duals(node_pi: DataFrame, clique_pi: DataFrame, members: DataFrame) -> DataFrame:
    """id, pi (with all its cliques' duals) and est (with the positive ones alone)."""
    extra = members.join(clique_pi, "clique_id").groupBy(F.col("node").alias("id")).agg(F.sum("pi").alias("c"), F.sum(F.greatest("pi", F.lit(0.0))).alias("p"))
    zero = F.lit(0.0)
    return node_pi.join(extra, "id", "left").select("id", (F.col("pi") + F.coalesce("c", zero)).alias("pi"), (F.col("pi") + F.coalesce("p", zero)).alias("est"))


def reduced_costs(edges: DataFrame, duals: DataFrame, clique_pi: DataFrame, members: DataFrame) -> DataFrame:
    """i, j, len, rc: the length less both nodes' duals, plus twice those of cliques that hold both ends."""
    a = duals.select(F.col("id").alias("i"), F.col("pi").alias("pa"))
    b = duals.select(F.col("id").alias("j"), F.col("pi").alias("pb"))
    one = members.select(F.col("node").alias("i"), "clique_id")
    two = members.select(F.col("node").alias("j"), "clique_id")
    inside = edges.select("i", "j").distinct().join(one, "i").join(two, ["j", "clique_id"]).join(clique_pi, "clique_id").groupBy("i", "j").agg(F.sum("pi").alias("both"))
    rows = edges.join(a, "i").join(b, "j").join(inside, ["i", "j"], "left")
    return rows.select("i", "j", "len", (F.col("len") - F.col("pa") - F.col("pb") + 2 * F.coalesce("both", F.lit(0.0))).alias("rc"))


def negative_edges(priced: DataFrame, current: DataFrame, eps: float = 1e-5, limit: int = 20_000) -> DataFrame:
    """The most negative edges that aren't in the current graph, at most ``limit``."""
    new = priced.join(current.select("i", "j"), ["i", "j"], "left_anti")
    return new.filter(F.col("rc") < -eps).orderBy("rc", "i", "j").limit(limit)


def penalty(priced: DataFrame) -> DataFrame:
    return priced.agg(F.sum(F.least("rc", F.lit(0.0))).alias("penalty"))


def pricing_candidates(edges: DataFrame, duals: DataFrame, eps: float = 1e-4) -> DataFrame:
    """The edges (i, j, len) whose length less both ends' estimates (``duals``: id, est) is below ``eps``."""
    a, b = (duals.select(F.col("id").alias(c), F.col("est").alias(f"e{c}")) for c in ("i", "j"))
    return edges.join(a, "i").join(b, "j").filter(F.col("len") - F.col("ei") - F.col("ej") < eps).select(*edges.columns)


#: Estimates up to this are one class; lengths are integers.
_LEAST_CLASS = 1.0


def near_enough_pairs(nodes: DataFrame, duals: DataFrame, norm: str, eps: float = 1e-4) -> DataFrame:
    """i, j, pi, pj (structs of the points), ei, ej of the pairs of ``nodes(id, x, y)`` that a layered grid brings together.

    Nodes are in classes by their estimate, each twice as high as the one before. Two classes meet
    on cells as wide as both heights together allow a candidate to be long, so a node of a large
    estimate reaches far without making the others do so. Pairs come once each; of the classes in
    use (64 at most) a node takes part in the grid of every one with its own.
    """
    params = NORM_CELLS.get(norm)
    if params is None:
        raise ValueError(f"{norm} has no grid bound")
    level = F.ceil(F.log2(F.greatest("est", F.lit(_LEAST_CLASS)))).cast("int")
    rows = nodes.join(duals.select("id", "est"), "id").withColumn("level", level)
    used = sorted(r[0] for r in rows.select("level").distinct().collect())  # as many as powers of two at most
    levels = F.array(*[F.lit(v) for v in used])
    side = (F.pow(F.lit(2.0), "high") + F.pow(F.lit(2.0), "low") + eps + 1) * params
    dims = "xyz" if norm == "EUC_3D" else "xy"
    cell = [F.floor(F.col(c) / side).alias(f"_{c}") for c in dims]
    point = F.struct(*dims)
    upper = rows.select(F.col("id").alias("a"), point.alias("pa"), F.col("est").alias("ea"), F.col("level").alias("high"), F.explode(levels).alias("low"), *dims).filter("low <= high").withColumns({f"_{c}": F.floor(F.col(c) / side) for c in dims})
    for c in dims:
        upper = upper.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + k for k in (-1, 0, 1)])))
    lower = rows.select(F.col("id").alias("b"), point.alias("pb"), F.col("est").alias("eb"), F.col("level").alias("low"), F.explode(levels).alias("high"), *dims).filter("low <= high").select("b", "pb", "eb", "low", "high", *cell)
    pairs = upper.drop(*dims).join(lower, ["high", "low", *[f"_{c}" for c in dims]]).filter("high > low or a < b").filter("a != b")
    swap = F.col("a") > F.col("b")
    ends = {"i": ("a", "b"), "j": ("b", "a"), "pi": ("pa", "pb"), "pj": ("pb", "pa"), "ei": ("ea", "eb"), "ej": ("eb", "ea")}
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for name, (x, y) in ends.items()])


def pricing_candidates_complete(nodes: DataFrame, duals: DataFrame, norm: str, eps: float = 1e-4) -> DataFrame:
    """As :func:`pricing_candidates` over all pairs of ``nodes(id, x, y)``, from :func:`near_enough_pairs`.

    The work follows the candidates that each node's own estimate allows, however uneven the
    estimates are. Nodes without an estimate have no candidate.
    """
    pairs = near_enough_pairs(nodes, duals, norm, eps).withColumn("len", length_col(norm, F.col("pi"), F.col("pj")))
    return pairs.filter(F.col("len") - F.col("ei") - F.col("ej") < eps).select("i", "j", "len")


def _scaled(c: Column) -> Column:
    """A value as an integer of 2^-32, so that sums are exact."""
    return F.round(c * 2.0**32).cast("decimal(38,0)")


def dual_bound(node_pi: DataFrame, cut_pi: DataFrame, cuts: DataFrame, priced: DataFrame, fixed: DataFrame | None = None, branched: DataFrame | None = None, upper: float | None = None) -> DataFrame:
    """bound: ``2 sum pi + sum cut_pi rhs + sum min(0, rc)``, summed exactly; with ``upper`` also prunable and infeasible.

    ``fixed(i, j)`` and ``branched(i, j, rhs)`` edges with rhs 1 add their reduced cost where it is
    positive; branched ones with rhs 0 give a negative one back. A bound over ``upper - 1`` prunes;
    a positive bound while all lengths are 0 shows that there is no solution.
    """
    parts = (
        node_pi.select(_scaled(2 * F.col("pi")).alias("v"))
        .unionByName(cut_pi.join(cuts, "cut_id").select(_scaled(F.col("pi") * F.col("rhs")).alias("v")))
        .unionByName(priced.filter("rc < 0").select(_scaled(F.col("rc")).alias("v")))
    )
    cost = priced.select("i", "j", "rc")
    if fixed is not None:
        parts = parts.unionByName(cost.join(fixed.select("i", "j").distinct(), ["i", "j"]).filter("rc > 0").select(_scaled(F.col("rc")).alias("v")))
    if branched is not None:
        rows = cost.join(branched.select("i", "j", "rhs").distinct(), ["i", "j"])
        parts = parts.unionByName(rows.filter("rhs = 1 and rc > 0").select(_scaled(F.col("rc")).alias("v")))
        parts = parts.unionByName(rows.filter("rhs = 0 and rc < 0").select(_scaled(-F.col("rc")).alias("v")))
    out = parts.agg((F.sum("v").cast("double") / 2.0**32).alias("bound"))
    if upper is None:
        return out
    longest = priced.agg(F.max(F.abs("len")).alias("longest"))  # one row each
    return out.join(F.broadcast(longest)).select("bound", (F.col("bound") > upper - 1).alias("prunable"), ((F.col("longest") == 0) & (F.col("bound") > 0)).alias("infeasible"))


def eliminate_edges(priced: DataFrame, upper: float, lower: float, current: DataFrame | None = None, fixed: DataFrame | None = None, branched: DataFrame | None = None) -> DataFrame:
    """i, j, len, rc, fate of the edges that stay: those with a reduced cost up to ``upper - lower - 1``, and all that were ``fixed`` or ``branched`` before.

    fate: ``held`` for the latter, ``fixed`` for other edges of the ``current`` graph (all, if none
    is given) that every better solution has, else ``kept``.
    """
    gap = upper - lower - 1
    if gap < 0:
        raise ValueError("the bounds leave nothing to eliminate")
    rows = priced
    for name, given in (("f", fixed), ("b", branched), ("c", current)):
        mark = F.lit(True).alias(name)
        rows = rows.withColumn(name, F.lit(None).cast("boolean")) if given is None else rows.join(given.select("i", "j", mark).distinct(), ["i", "j"], "left")
    held = F.coalesce("f", "b", F.lit(False))
    mine = F.lit(True) if current is None else F.coalesce("c", F.lit(False))
    fate = F.when(held, "held").when((F.col("rc") < -gap) & mine, "fixed").otherwise("kept")
    return rows.filter(held | (F.col("rc") <= gap)).select(*priced.columns, fate.alias("fate"))


def check_integral(xedges: DataFrame, edges: DataFrame, n: int, eps: float = 1e-4) -> DataFrame:
    """One row: integral (every x is within ``eps`` of 0 or 1), connected, is_tour (over n nodes) and value (the lengths of the edges of x one)."""
    off = xedges.filter(F.least(F.abs("x"), F.abs(1 - F.col("x"))) > eps).take(1)
    support = materialize(xedges.filter(F.col("x") > eps).select("i", "j").join(edges.select("i", "j", "len"), ["i", "j"], "left"), "support")
    labels = component_labels(support)
    reached, parts = labels.agg(F.count("*"), F.count_distinct("component")).first()
    connected = reached == n and parts == 1
    degrees = support.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).agg(F.min("d"), F.max("d")).first()
    is_tour = not off and connected and tuple(degrees) == (2, 2)
    return support.agg(F.lit(not off).alias("integral"), F.lit(connected).alias("connected"), F.lit(is_tour).alias("is_tour"), F.sum("len").alias("value"))


def reduced_cost_nearest(priced: DataFrame, k: int) -> DataFrame:
    """id, nbr, len, rc, rank: the k least reduced costs at each node, ties by length, then id."""
    both = priced.select(F.col("i").alias("id"), F.col("j").alias("nbr"), "len", "rc").unionByName(priced.select(F.col("j").alias("id"), F.col("i").alias("nbr"), "len", "rc"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rc", "len", "nbr"))).filter(F.col("rank") <= k)


def fractional_edges(xedges: DataFrame, eps: float = 1e-4) -> DataFrame:
    return xedges.filter((F.col("x") > eps) & (F.col("x") < 1 - eps))


def most_fractional_edge(xedges: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The edge with x closest to one half, ties by (i, j); not one of the ``held`` (fixed or branched) ones."""
    rows = fractional_edges(xedges)
    if held is not None:
        rows = rows.join(held.select("i", "j"), ["i", "j"], "left_anti")
    return rows.orderBy(F.abs(F.col("x") - 0.5), "i", "j").limit(1)


def subdivision_bound(regions: DataFrame) -> DataFrame:
    """Sum of the regions' bounds; a negative one is a failure and doesn't count."""
    return regions.filter("bound >= 0").agg(F.sum("bound").alias("bound"), F.count("*").alias("n"))


def reduced_cost_nearest_graph(priced: DataFrame, k: int) -> DataFrame:
    """i, j, len, rc: the undirected union of :func:`reduced_cost_nearest`."""
    return reduced_cost_nearest(priced, k).select(F.least("id", "nbr").alias("i"), F.greatest("id", "nbr").alias("j"), "len", "rc").distinct()
