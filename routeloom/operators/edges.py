"""Edge tables ``edges(i, j[, len][, x])``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norms import length_col
from .components import component_labels


def oriented(edges: DataFrame) -> DataFrame:
    """The same rows with i < j; loops go."""
    others = [c for c in edges.columns if c not in ("i", "j")]
    return edges.filter("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *others)


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct pairs with i < j."""
    return oriented(edges.select("i", "j")).distinct()


def edge_lengths(edges: DataFrame, nodes: DataFrame, norm: str, **params) -> DataFrame:
    """i, j, len from the nodes' coordinates."""
    point = F.struct(*[c for c in nodes.columns if c != "id"])
    a = nodes.select(F.col("id").alias("i"), point.alias("_a"))
    b = nodes.select(F.col("id").alias("j"), point.alias("_b"))
    return edges.select("i", "j").join(a, "i").join(b, "j").select("i", "j", length_col(norm, F.col("_a"), F.col("_b"), **params).alias("len"))


def edge_union(sets: list[DataFrame]) -> DataFrame:
    """Union of edge sets; a repeated edge has the length of the last set that holds it."""
    ranked = [oriented(s.select("i", "j", "len")).withColumn("r", F.lit(k)) for k, s in enumerate(sets)]
    return union_last(reduce(DataFrame.unionByName, ranked), "r")


def union_last(edges: DataFrame, rank: str) -> DataFrame:
    """As :func:`edge_union` for one table that has each row's set in ``rank``; ties take the larger length."""
    return oriented(edges.select("i", "j", "len", F.col(rank).alias("r"))).groupBy("i", "j").agg(F.max(F.struct("r", "len"))["len"].alias("len"))


def edges_semi(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("i", "j"), ["i", "j"], "left_semi")


def edges_anti(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose pair isn't in ``keys`` (deletion; missing edges)."""
    return edges.join(keys.select("i", "j"), ["i", "j"], "left_anti")


missing_edges = edges_anti


def filter_x(edges: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Edges with low < x < high."""
    return edges.filter((F.col("x") > low) & (F.col("x") < high))


def strip_default(edges: DataFrame, default_len: int) -> DataFrame:
    return edges.filter(F.col("len") != default_len)


def node_degree(edges: DataFrame) -> DataFrame:
    """id, degree and, if there is an x, its sum over the node's edges."""
    x = F.col("x") if "x" in edges.columns else F.lit(0.0)
    ends = edges.select(F.explode(F.array("i", "j")).alias("id"), x.alias("x"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("x").alias("x"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, degree, nbrs (array of end, len in order of the end)."""
    both = edges.select(F.col("i").alias("id"), F.col("j").alias("end"), "len").unionByName(edges.select(F.col("j").alias("id"), F.col("i").alias("end"), "len"))
    return both.groupBy("id").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list(F.struct("end", "len"))).alias("nbrs"))


def from_adjacency(adj: DataFrame) -> DataFrame:
    """The edges again, each once."""
    return adj.select("id", F.explode("nbrs").alias("n")).select(F.col("id").alias("i"), F.col("n.end").alias("j"), F.col("n.len").alias("len")).filter("i < j")


def relabel(df: DataFrame, perm: DataFrame, cols: list[str]) -> DataFrame:
    """Replace ids in ``cols`` by ``perm`` (old, new)."""
    for c in cols:
        df = df.join(perm.select(F.col("old").alias(c), F.col("new").alias("_new")), c).drop(c).withColumnRenamed("_new", c)
    return df


def x_summary(edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: how many edges, how many with x above the tolerance, and the sum of x."""
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("x") > tolerance).alias("n_nonzero"), F.round(F.sum("x"), 6).alias("sum_x"))


def default_length(edges: DataFrame, n: int) -> int:
    """The length of pairs that a sparse graph lacks: (longest + 1) n, or 2^31 / 256 if 256 times that is too much for 32 bits."""
    value = ((edges.agg(F.max("len")).first()[0] or 0) + 1) * n
    return (2**31 - 1) // 256 if 256 * value > 2**31 - 1 else value


#: All pairs are dealt by so many rows and columns; so many rows together go over so many columns at a time.
_HIGH, _WIDE, _ROWS, _STRIDE = 512, 1 << 14, 64, 1 << 9


def complete_graph(edges: DataFrame, n: int, default: int = 0) -> DataFrame:
    """i, j, len of all pairs of 0..n-1: the given length (the shortest of repeats) or the default; n is the caller's bound.

    A few nodes go over the others together, a stride at a time: rows that follow each other repeat the same j, and a task has few
    different ones, so Parquet files keep them as places in a dictionary that repeat.
    """
    default = default if default > 0 else default_length(edges, n)
    given = oriented(edges.select("i", "j", "len")).groupBy("i", "j").agg(F.min("len").cast("long").alias("len"))
    given = given.filter((F.col("i") >= 0) & (F.col("j") < n))
    # Only the given edges are dealt; the other pairs are the stretches between a node's edges, made where they are.
    high, wide, strides = -(-n // _HIGH), max(1, -(-n // _WIDE)), _WIDE // _STRIDE
    cell = F.floor(F.col("i") / _HIGH) * wide + F.floor(F.col("j") / _WIDE)
    bin_ = F.floor(F.col("i") % _HIGH / _ROWS) * strides + F.floor(F.col("j") % _WIDE / _STRIDE)
    binned = given.select(cell.alias("cell"), bin_.alias("bin"), "i", "j", "len").groupBy("cell", "bin").agg(F.collect_list(F.struct("i", "j", "len")).alias("e"))
    tasks = max(1, min(8000, high * wide // 2))
    held = binned.repartition(tasks, "cell").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("bin", "e"))).alias("bins"))
    top, left = F.floor(F.col("cell") / wide) * _HIGH, F.col("cell") % wide * _WIDE
    cells = edges.sparkSession.range(0, high * wide).withColumnRenamed("id", "cell").filter(left + _WIDE - 1 > top).repartition(tasks, "cell").join(held.hint("merge"), "cell", "left")
    bins = cells.select("bins", top.alias("top"), left.alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_HIGH // _ROWS * strides - 1).cast("long"))).alias("bin"))
    bins = bins.select(F.try_element_at("bins", F.col("bin")).alias("e"), (F.col("top") + F.floor(F.col("bin") / strides) * _ROWS).alias("i0"), (F.col("left") + F.col("bin") % strides * _STRIDE).alias("j0"))
    bins = bins.filter((F.col("i0") < n - 1) & (F.col("j0") < n) & (F.col("j0") + (_STRIDE - 1) > F.col("i0")))
    rows = bins.select("e", "j0", F.explode(F.sequence("i0", F.least(F.col("i0") + (_ROWS - 1), F.lit(n - 2).cast("long")))).alias("i"))
    lo, hi = F.greatest(F.col("j0"), F.col("i") + 1), F.least(F.col("j0") + (_STRIDE - 1), F.lit(n - 1).cast("long"))
    own = F.transform(F.filter("e", lambda e: e["i"] == F.col("i")), lambda e: F.struct(e["j"].alias("lo"), e["j"].alias("hi"), e["len"].alias("len")))
    own = F.sort_array(F.coalesce(own, F.array().cast("array<struct<lo:long,hi:long,len:long>>")))
    at = F.transform(own, lambda e: e["lo"])
    free = F.zip_with(F.concat(F.array(lo - 1), at), F.concat(at, F.array(hi + 1)), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi"), F.lit(default).cast("long").alias("len")))
    pieces = F.sort_array(F.concat(own, F.filter(free, lambda s: s["lo"] <= s["hi"])))
    return rows.select("i", F.explode(pieces).alias("s")).select("i", F.explode(F.sequence("s.lo", "s.hi")).alias("j"), F.col("s.len").alias("len"))


def contract_ones(xedges: DataFrame, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """members(super, node) and xedges(i, j, x) after edges of x of 1 - eps or more are contracted.

    A super-node is named by its smallest node; parallel edges are summed, loops go. Nodes that
    aren't in ``members`` stand for themselves.
    """
    labels = component_labels(xedges.filter(F.col("x") >= 1 - eps))
    moved = xedges.select("i", "j", "x")
    for end in ("i", "j"):
        moved = moved.join(labels.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return labels.select(F.col("component").alias("super"), "node"), oriented(moved).groupBy("i", "j").agg(F.sum("x").alias("x"))


def x_nonzero(edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """The rows of an x-vector with x above the tolerance."""
    return edges.filter(F.col("x") > tolerance)


def best_tour_among(edges: DataFrame, n: int) -> DataFrame:
    """set_id, n_edges, is_tour, len of ``edges(set_id, i, j, len)``, and ``best``: which tour is the shortest (ties by set).

    A set is a tour if it has n edges, n nodes of degree two and one component.
    """
    e = edges.filter("i != j")
    node = lambda c: F.struct("set_id", F.col(c).cast("long").alias("node"))
    degrees = e.select("set_id", F.explode(F.array("i", "j")).alias("node")).groupBy("set_id", "node").agg(F.count("*").alias("d"))
    shape = degrees.groupBy("set_id").agg(F.count("*").alias("nodes"), F.min("d").alias("low"), F.max("d").alias("high"))
    parts = component_labels(e.select(node("i").alias("i"), node("j").alias("j"))).select("component").distinct().groupBy(F.col("component.set_id").alias("set_id")).agg(F.count("*").alias("parts"))
    sums = edges.groupBy("set_id").agg(F.count("*").alias("n_edges"), F.sum("len").alias("len"))
    ok = (F.col("n_edges") == n) & (F.col("nodes") == n) & (F.col("low") == 2) & (F.col("high") == 2) & (F.col("parts") == 1)
    rows = sums.join(shape, "set_id", "left").join(parts, "set_id", "left").select("set_id", "n_edges", F.coalesce(ok, F.lit(False)).alias("is_tour"), "len")
    best = rows.filter("is_tour").agg(F.min(F.struct("len", "set_id"))["set_id"].alias("best_id"))  # one row
    return rows.join(F.broadcast(best)).select("set_id", "n_edges", "is_tour", "len", F.coalesce(F.col("set_id") == F.col("best_id"), F.lit(False)).alias("best"))
