"""Blocks (two-connected components) of a graph of any size, by joins and aggregations.

A spanning forest is walked as an Euler tour: every tree edge is two arcs, an arc's follower
leaves its end by the next edge there, and positions come from doubling the followers' reach.
Positions give each node its parent, its number in preorder and the size of its subtree, which
is a range of numbers. The least and the greatest number that non-tree edges reach from a
subtree are bests over its range. Two tree edges are of one block if

* a non-tree edge joins the lower ends of both, neither of which lies above the other, or
* one follows the other downwards, and the lower one's subtree reaches out of the upper end's,

or if such steps connect them; a non-tree edge is of its lower end's block. No component, node
or block is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize
from .components import component_labels
from .construct import LOCAL_EDGES, minimum_spanning_tree
from .ranking import range_best, ranked


def _tour_positions(arcs: DataFrame) -> DataFrame:
    """component, u, v, at: the place of each arc (component, u, v, both directions) in its tree's Euler tour from the smallest node."""
    placed = materialize(ranked(arcs, ["v"], ["u"], "k"), "arcs")
    degrees = placed.groupBy("u").agg(F.count("*").alias("d"))
    back = placed.join(degrees, "u").select(F.col("u").alias("v"), F.col("v").alias("u"), F.pmod(F.col("k") + 1, "d").alias("nk"))
    on = placed.select(F.col("u").alias("v"), F.col("k").alias("nk"), F.col("v").alias("w"))
    steps = placed.join(back, ["u", "v"]).join(on, ["v", "nk"])
    ends = (F.col("v") == F.col("component")) & (F.col("nk") == 0)
    now = steps.select("component", "u", "v", F.when(~ends, F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("next"), F.when(ends, 0).otherwise(1).cast("long").alias("far"))
    now = materialize(now, "tour-arcs")
    sizes = now.groupBy("component").agg(F.count("*").alias("n"))
    for _ in range((sizes.agg(F.max("n")).first()[0] or 1).bit_length()):
        ahead = now.select(F.struct("u", "v").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        open_ = now.filter("next is not null").join(ahead, "next").select("component", "u", "v", F.col("_next").alias("next"), (F.col("far") + F.col("_far")).alias("far"))
        now = materialize(now.filter("next is null").unionByName(open_), "tour-arcs")
    return now.join(sizes, "component").select("component", "u", "v", (F.col("n") - 1 - F.col("far")).alias("at"))


def rooted_forest(tree: DataFrame) -> DataFrame:
    """component, node, parent (null at the root), pre, size of the nodes of forest edges ``tree(i, j)``.

    Each component's root is its smallest node; ``pre`` numbers it from 0 so that the ``size`` nodes
    of a subtree stand together, children by their ids.
    """
    labels = component_labels(tree)
    both = tree.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(tree.select(F.col("j").alias("u"), F.col("i").alias("v")))
    placed = materialize(_tour_positions(both.join(labels.withColumnRenamed("node", "u"), "u").select("component", "u", "v")), "tour-positions")
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("at").alias("back"))
    down = placed.join(back, ["u", "v"]).filter("at < back")
    nodes = ranked(down, ["at"], ["component"], "k").select("component", F.col("v").alias("node"), F.col("u").alias("parent"), (F.col("k") + 1).alias("pre"), F.floor((F.col("back") - F.col("at") + 1) / 2).alias("size"))
    roots = placed.groupBy("component").agg((F.floor(F.count("*") / 2) + 1).alias("size"))
    return materialize(nodes.unionByName(roots.select("component", F.col("component").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("pre"), "size")), "forest")


def edge_blocks(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """component, block, i, j for each of ``edges(i, j)`` (long ids, i < j, each once).

    ``component`` is the smallest node of the connected component. ``block`` is a number of the block:
    the smallest of its nodes but the one nearest to the component's smallest node. ``local``: edges
    that the spanning forest leaves to one task.
    """
    tree = materialize(minimum_spanning_tree(edges.select("i", "j", F.lit(0).cast("long").alias("len")), local).select("i", "j"), "forest-edges")
    forest = rooted_forest(tree)
    rest = edges.select("i", "j").join(tree, ["i", "j"], "left_anti")
    for end in ("i", "j"):
        rest = rest.join(forest.select(F.col("node").alias(end), F.struct("pre", "size", F.col("node").alias("id")).alias(f"n{end}")), end)
    # upper: the end of the smaller number
    rest = materialize(rest.select("i", "j", F.least("ni", "nj").alias("upper"), F.greatest("ni", "nj").alias("lower")), "other-edges")
    reach = rest.select(F.col("upper.id").alias("node"), F.col("lower.pre").alias("to")).unionByName(rest.select(F.col("lower.id").alias("node"), F.col("upper.pre").alias("to")))
    reach = reach.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    own = forest.join(reach, "node", "left").select("component", F.col("pre").alias("pos"), F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    ranges = forest.select("component", "node", "parent", F.col("pre").alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi"))
    spans = materialize(range_best(materialize(own, "reach"), ranges, ["component"], {"low": F.least, "high": F.greatest}), "spans")
    above = forest.select(F.col("node").alias("parent"), F.col("pre").alias("p"), F.col("size").alias("s"), F.col("parent").alias("up"))
    out = spans.join(above, "parent").filter(F.col("up").isNotNull() & ((F.col("low") < F.col("p")) | (F.col("high") >= F.col("p") + F.col("s"))))
    across = rest.filter(F.col("upper.pre") + F.col("upper.size") <= F.col("lower.pre"))
    same = out.select(F.col("node").alias("i"), F.col("parent").alias("j")).unionByName(across.select(F.col("upper.id").alias("i"), F.col("lower.id").alias("j")))
    labels = component_labels(same).select("node", F.col("component").alias("block"))
    of_node = materialize(forest.join(labels, "node", "left").select("component", "node", "parent", F.coalesce("block", "node").alias("block")), "node-blocks")
    downward = of_node.filter("parent is not null").select("component", "block", F.least("node", "parent").alias("i"), F.greatest("node", "parent").alias("j"))
    others = rest.select("i", "j", F.col("lower.id").alias("node")).join(of_node, "node").select("component", "block", "i", "j")
    return downward.unionByName(others)
