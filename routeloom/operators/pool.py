"""Pools of cuts as tables: content keys, merging, atoms, comb tests, set operations and interval cuts.

``members(clique_id, node)``, ``cuts(cut_id, sense, rhs)``, ``cut_cliques(cut_id, clique_id)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.session import materialize
from .blocks import edge_blocks
from .components import component_labels
from .cuts import clique_sizes
from .equality import equal_classes
from .segments import all_segment_cuts, interval_deltas, segment_cuts  # noqa: F401  (intervals are cuts too)

#: x values that count as zero and as one, and a violation that counts.
ZERO, ONE, MARGIN = 1e-6, 0.999999, 0.01


def clique_key(members: DataFrame) -> DataFrame:
    """clique_id, key: equal for cliques of the same nodes (size and two 64-bit sums of node hashes), gathered map-side."""
    key = F.struct(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    return members.select("clique_id", "node").distinct().groupBy("clique_id").agg(key.alias("key"))


def cut_keys(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id, sense, rhs, key: the sorted keys of the cut's cliques, repeats included."""
    keys = cut_cliques.join(clique_key(members), "clique_id").groupBy("cut_id").agg(F.sort_array(F.collect_list("key")).alias("key"))
    return cuts.join(keys, "cut_id").select("cut_id", "sense", "rhs", "key")


def clique_classes(members: DataFrame) -> DataFrame:
    """clique_id, first: the smallest clique of the same nodes; cliques of equal keys are compared node by node."""
    rows = members.select("clique_id", "node").distinct()
    keys = clique_key(rows).withColumnRenamed("clique_id", "item")
    return equal_classes(keys, rows.select(F.col("clique_id").alias("item"), F.col("node").alias("part"))).select(F.col("item").alias("clique_id"), "first")


def cut_classes(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id, first: the smallest cut of the same sense, right-hand side and cliques, repeats included; compared clique by clique and node by node."""
    keys = cut_keys(cuts, cut_cliques, members).select(F.col("cut_id").alias("item"), F.struct("sense", "rhs", "key").alias("key"))
    parts = cut_cliques.join(clique_classes(members), "clique_id").select(F.col("cut_id").alias("item"), F.col("first").alias("part"))
    return equal_classes(keys, parts).select(F.col("item").alias("cut_id"), "first")


def distinct_cuts(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id, n_equal: the first of the cuts with the same sense, right-hand side and cliques."""
    return cut_classes(cuts, cut_cliques, members).groupBy(F.col("first").alias("cut_id")).agg(F.count("*").alias("n_equal"))


def pool_merge(pools: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pool of (cuts, cut_cliques, members) tables; equal cuts come once, from the first pool that has them, and equal cliques are shared.

    Ids become structs (pool, id).
    """

    def tagged(df: DataFrame, k: int, names: list[str]) -> DataFrame:
        for c in names:
            df = df.withColumn(c, F.struct(F.lit(k).alias("pool"), F.col(c).cast("long").alias("id")))
        return df

    cuts = reduce(DataFrame.unionByName, [tagged(p[0].select("cut_id", "sense", "rhs"), k, ["cut_id"]) for k, p in enumerate(pools)])
    links = reduce(DataFrame.unionByName, [tagged(p[1].select("cut_id", "clique_id"), k, ["cut_id", "clique_id"]) for k, p in enumerate(pools)])
    members = reduce(DataFrame.unionByName, [tagged(p[2].select("clique_id", "node"), k, ["clique_id"]) for k, p in enumerate(pools)])
    kept = cuts.join(distinct_cuts(cuts, links, members).select("cut_id"), "cut_id")
    shared = clique_classes(members)
    links = links.join(kept.select("cut_id"), "cut_id").join(shared, "clique_id").select("cut_id", F.col("first").alias("clique_id"))
    return kept, links, members.distinct().join(links.select("clique_id").distinct(), "clique_id")


def poolable(cuts: DataFrame, cut_cliques: DataFrame) -> DataFrame:
    """Cuts of two cliques or more; those of one clique aren't pooled."""
    many = cut_cliques.groupBy("cut_id").agg(F.count("*").alias("n")).filter("n > 1").select("cut_id")
    return cuts.join(many, "cut_id")


def clique_union(members: DataFrame, more: DataFrame) -> DataFrame:
    """Cliques with the nodes of both tables."""
    return members.select("clique_id", "node").unionByName(more.select("clique_id", "node")).distinct()


def clique_remove(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("clique_id", "node"), ["clique_id", "node"], "left_anti")


def clique_marked_count(members: DataFrame, marked: DataFrame) -> DataFrame:
    """clique_id, size, n_marked: how many nodes of each clique are in ``marked(node)``."""
    flag = marked.select("node", F.lit(1).alias("m")).distinct()
    return members.distinct().join(flag, "node", "left").groupBy("clique_id").agg(F.count("*").alias("size"), F.count("m").alias("n_marked"))


def clique_neighbors(members: DataFrame, edges: DataFrame) -> DataFrame:
    """clique_id, node: nodes outside that an edge joins to the clique."""
    m = members.select("clique_id", "node").distinct()
    both = edges.select(F.col("i").alias("node"), F.col("j").alias("end")).unionByName(edges.select(F.col("j").alias("node"), F.col("i").alias("end")))
    reached = m.join(both, "node").select("clique_id", F.col("end").alias("node")).distinct()
    return reached.join(m, ["clique_id", "node"], "left_anti")


def relabel_members(members: DataFrame, perm: DataFrame) -> DataFrame:
    """Members with nodes replaced by ``perm(old, new)``."""
    return members.join(perm.select(F.col("old").alias("node"), "new"), "node").select("clique_id", F.col("new").alias("node"))


def truncate_cuts(slack: DataFrame, m: int) -> DataFrame:
    """The m cuts of least slack."""
    return slack.orderBy("slack", "cut_id").limit(m)


def accept_cuts(slack: DataFrame, least: float = 0.002) -> DataFrame:
    """Cuts that are violated by more than ``least``."""
    return slack.filter(F.col("slack") < -least)


def tight_cliques(delta: DataFrame, m: int, limit: float) -> DataFrame:
    """The m cliques of smallest delta below ``limit``."""
    return delta.filter(F.col("delta") < limit).orderBy("delta", "clique_id").limit(m)


def cut_atoms(cut_cliques: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """cut_id, node, size, n_cliques: nodes 0..n-1 grouped by the cut's cliques that hold them, with the smallest node of each.

    Nodes in no clique are one more atom, if there are any (n_cliques 0); it's found from the first
    gap in the nodes that are held, not by listing the others.
    """
    held = cut_cliques.select("cut_id", "clique_id").distinct().join(members.distinct(), "clique_id").groupBy("cut_id", "node").agg(F.sort_array(F.collect_set("clique_id")).alias("of"))
    atoms = held.groupBy("cut_id", "of").agg(F.min("node").alias("node"), F.count("*").alias("size")).select("cut_id", "node", "size", F.size("of").cast("long").alias("n_cliques"))
    place = F.row_number().over(Window.partitionBy("cut_id").orderBy("node")) - 1
    gaps = held.select("cut_id", "node", place.alias("place")).groupBy("cut_id").agg(F.count("*").alias("held"), F.min(F.when(F.col("node") != F.col("place"), F.col("place"))).alias("gap"))
    outside = gaps.filter(F.col("held") < n).select("cut_id", F.coalesce("gap", "held").cast("long").alias("node"), (F.lit(n) - F.col("held")).alias("size"), F.lit(0).cast("long").alias("n_cliques"))
    return atoms.unionByName(outside)


def _meetings(cut_cliques: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id, a, b, shared of each pair of the cut's cliques that meet.

    The nodes of a cut that lie in the same cliques count as one row with their number, so a node
    row meets only the few other cliques that hold it.
    """
    held = cut_cliques.join(members.distinct(), "clique_id").groupBy("cut_id", "node").agg(F.sort_array(F.collect_set("clique_id")).alias("of"))
    kinds = held.filter(F.size("of") > 1).groupBy("cut_id", "of").agg(F.count("*").alias("n"))
    a = kinds.select("cut_id", "n", "of", F.explode("of").alias("a"))
    return a.select("cut_id", "a", "n", F.explode("of").alias("b")).filter("a < b").groupBy("cut_id", "a", "b").agg(F.sum("n").alias("shared"))


def teeth_disjoint(teeth: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id of cuts of which no two ``teeth(cut_id, clique_id)`` meet."""
    return teeth.select("cut_id").distinct().join(_meetings(teeth, members).select("cut_id"), "cut_id", "left_anti")


def pure_combs(roles: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id of cuts in ``roles(cut_id, clique_id, handle)`` whose one handle meets each tooth and holds none, with teeth that don't meet."""
    rows = roles.join(members.distinct(), "clique_id")
    handle = rows.filter("handle").select("cut_id", "node", F.lit(1).alias("h"))
    met = rows.filter("not handle").join(handle, ["cut_id", "node"], "left").groupBy("cut_id", "clique_id").agg(F.count("*").alias("size"), F.count("h").alias("in_handle"))
    good = met.groupBy("cut_id").agg(F.every((F.col("in_handle") > 0) & (F.col("in_handle") < F.col("size"))).alias("ok")).filter("ok").select("cut_id")
    single = roles.filter("handle").groupBy("cut_id").agg(F.count("*").alias("n")).filter("n = 1").select("cut_id")
    return good.join(single, "cut_id").join(teeth_disjoint(roles.filter("not handle"), members), "cut_id")


def comb_sizes(cut_cliques: DataFrame, members: DataFrame) -> DataFrame:
    """cut_id, n_cliques, smallest, largest: the sizes of each cut's cliques."""
    return cut_cliques.join(clique_sizes(members), "clique_id").groupBy("cut_id").agg(F.count("*").alias("n_cliques"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def _cleaned(handles: DataFrame, teeth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cuts, roles and members of the blossoms with ``handles(cut_id, node)`` and ``teeth(cut_id, inner, outer)``.

    A node inside that two teeth share leaves the handle, one outside joins it; teeth that don't
    cross the handle any more go. A blossom stays with three handle nodes or more and an odd number of teeth.
    """
    shared = lambda end: teeth.groupBy("cut_id", F.col(end).alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("cut_id", "node")
    handle = materialize(handles.join(shared("inner"), ["cut_id", "node"], "left_anti").unionByName(shared("outer")).distinct(), "handles")
    for end in ("inner", "outer"):
        teeth = teeth.join(handle.select("cut_id", F.col("node").alias(end), F.lit(1).alias(f"in_{end}")), ["cut_id", end], "left")
    crossing = materialize(teeth.filter(F.coalesce("in_inner", F.lit(0)) != F.coalesce("in_outer", F.lit(0))).select("cut_id", "inner", "outer"), "teeth")
    sizes = handle.groupBy("cut_id").agg(F.count("*").alias("h")).join(crossing.groupBy("cut_id").agg(F.count("*").alias("t")), "cut_id")
    kept = materialize(sizes.filter("h >= 3 and t % 2 = 1"), "blossoms")
    cuts = kept.select("cut_id", F.lit("G").alias("sense"), (3 * (F.col("t") + 1) - 2).cast("int").alias("rhs"))
    handle, crossing = (df.join(kept.select("cut_id"), "cut_id") for df in (handle, crossing))
    of_handle = F.concat(F.col("cut_id").cast("string"), F.lit(":h"))
    of_tooth = F.concat_ws(":", F.col("cut_id").cast("string"), F.col("inner").cast("string"), F.col("outer").cast("string"))
    roles = cuts.select("cut_id", of_handle.alias("clique_id"), F.lit(True).alias("handle")).unionByName(crossing.select("cut_id", of_tooth.alias("clique_id"), F.lit(False).alias("handle")))
    members = handle.select(of_handle.alias("clique_id"), "node").unionByName(crossing.select(of_tooth.alias("clique_id"), F.explode(F.array("inner", "outer")).alias("node")))
    return cuts, roles, members


def _handles(xedges: DataFrame, below: float) -> tuple[DataFrame, DataFrame]:
    """Components (cut_id, node) of three nodes or more of the edges with ZERO < x < below, and the edges with both ends' components."""
    labels = materialize(component_labels(xedges.filter((F.col("x") > ZERO) & (F.col("x") < below))), "handles")
    large = labels.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 3").select("component")
    handles = materialize(labels.join(large, "component").select(F.col("component").alias("cut_id"), "node"), "handles")
    rows = xedges.select("i", "j", "x")
    for end in ("i", "j"):
        rows = rows.join(handles.select(F.col("node").alias(end), F.col("cut_id").alias(f"c{end}")), end, "left")
    return handles, rows


def _boundary(rows: DataFrame, least: float) -> DataFrame:
    """cut_id, inner, outer, x of the edges with x >= least that leave a handle; one between two handles leaves both."""
    ends = F.explode(F.array(F.struct(F.col("ci").alias("cut_id"), F.col("i").alias("inner"), F.col("j").alias("outer")), F.struct(F.col("cj").alias("cut_id"), F.col("j").alias("inner"), F.col("i").alias("outer"))))
    apart = F.coalesce(F.col("ci") != F.col("cj"), F.lit(True))
    return rows.filter((F.col("x") >= least) & apart).select(ends.alias("e"), "x").filter("e.cut_id is not null").select("e.*", "x")


def fast_blossoms(xedges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cuts(cut_id, sense, rhs), roles(cut_id, clique_id, handle) and members(clique_id, node) of blossoms.

    Handles are the components of the fractional edges, teeth the edges of x one at them; those
    with an odd number of teeth are cleaned up. ``cut_id`` is the handle's smallest node.
    """
    handles, rows = _handles(xedges, ONE)
    teeth = materialize(_boundary(rows, ONE), "teeth")
    odd = teeth.groupBy("cut_id").agg(F.count("*").alias("t")).filter("t % 2 = 1").select("cut_id")
    return _cleaned(handles.join(odd, "cut_id"), teeth.join(odd, "cut_id").select("cut_id", "inner", "outer"))


def gh_blossoms(xedges: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`fast_blossoms`, with handles from edges below ``least`` and teeth from it on.

    Of a handle's teeth, by falling x (ties by the edge), the smallest odd number is taken at which
    the x inside the handle and of the teeth exceeds the handle's size and half of the teeth but one.
    """
    handles, rows = _handles(xedges, least)
    inside = rows.filter((F.col("x") > ZERO) & (F.col("ci") == F.col("cj"))).groupBy(F.col("ci").alias("cut_id")).agg(F.sum("x").alias("inside"))
    sizes = handles.groupBy("cut_id").agg(F.count("*").alias("h")).join(inside, "cut_id", "left")
    order = Window.partitionBy("cut_id").orderBy(F.desc("x"), F.least("inner", "outer"), F.greatest("inner", "outer"))
    teeth = _boundary(rows, least).withColumn("t", F.row_number().over(order)).withColumn("z", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    teeth = materialize(teeth.join(sizes, "cut_id"), "teeth")
    enough = F.round(F.coalesce("inside", F.lit(0.0)) + F.col("z"), 9) > F.col("h") + (F.col("t") - 1) / 2 + MARGIN
    first = materialize(teeth.filter((F.col("t") % 2 == 1) & enough).groupBy("cut_id").agg(F.min("t").alias("first")), "taken")
    return _cleaned(handles.join(first.select("cut_id"), "cut_id"), teeth.join(first, "cut_id").filter("t <= first").select("cut_id", "inner", "outer"))


def classify_cuts(cuts: DataFrame, cut_cliques: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """cut_id, kind (subtour, comb or other) of ``cuts(cut_id, sense, rhs)`` over nodes 0..n-1.

    A subtour cut has one clique, two atoms and right-hand side 2. A comb has an even number c >= 4
    of cliques, right-hand side 3c - 2 and 2c - 2 to 2c atoms, one clique of the handle's number of
    atoms, and teeth of two atoms (or of all but two, which are then turned inside out): one in
    just the tooth, one in just the tooth and the handle.
    """
    links = cut_cliques.select("cut_id", "clique_id").distinct()
    held = links.join(members.distinct(), "clique_id").groupBy("cut_id", "node").agg(F.sort_array(F.collect_set("clique_id")).alias("of"))
    atoms = held.groupBy("cut_id", "of").agg(F.count("*").alias("size"))
    outside = atoms.groupBy("cut_id").agg(F.sum("size").alias("held")).filter(F.col("held") < n)
    atoms = materialize(atoms.select("cut_id", "of").unionByName(outside.join(atoms, "cut_id").select("cut_id", F.array_except("of", "of").alias("of")).distinct()), "atoms")
    n_atoms = atoms.groupBy("cut_id").agg(F.count("*").alias("atoms"))
    of_clique = atoms.select("cut_id", F.explode("of").alias("clique_id")).groupBy("cut_id", "clique_id").agg(F.count("*").alias("k"))
    counts = links.groupBy("cut_id").agg(F.count("*").alias("c"))
    shape = cuts.join(counts, "cut_id").join(n_atoms, "cut_id")
    low = F.when(F.col("atoms") == 2 * F.col("c"), F.col("c")).otherwise(F.col("c") - 1)
    high = F.when(F.col("atoms") == 2 * F.col("c") - 2, F.col("c") - 1).otherwise(F.col("c"))
    right = (F.col("c") % 2 == 0) & (F.col("c") >= 4) & (F.col("rhs") == 3 * F.col("c") - 2) & (F.col("sense") == "G") & F.col("atoms").between(2 * F.col("c") - 2, 2 * F.col("c"))
    role = F.when(F.col("k").between(low, high), "handle").when(F.col("k") == 2, "tooth").when(F.col("k") == F.col("atoms") - 2, "inverted").otherwise("wrong")
    roles = materialize(shape.filter(right).join(of_clique, "cut_id").select("cut_id", "c", "clique_id", role.alias("role")), "roles")
    combs = roles.groupBy("cut_id").agg(
        F.first("c").alias("c"), F.count_if(F.col("role") == "handle").alias("handles"), F.count_if(F.col("role") == "wrong").alias("wrong"),
        F.min(F.when(F.col("role") == "handle", F.col("clique_id"))).alias("handle"), F.collect_list(F.when(F.col("role") == "inverted", F.col("clique_id"))).alias("inverted"),
    ).filter("handles = 1 and wrong = 0")
    turned = atoms.join(combs, "cut_id").select("cut_id", "c", "handle", F.concat(F.array_except("of", "inverted"), F.array_except("inverted", "of")).alias("of"))
    teeth = turned.select("cut_id", "c", "handle", "of", F.explode("of").alias("tooth")).filter("tooth != handle")
    single = F.count_if(F.size("of") == 1)
    double = F.count_if((F.size("of") == 2) & F.array_contains("of", F.col("handle")))
    good = teeth.groupBy("cut_id", "c", "tooth").agg(F.count("*").alias("k"), single.alias("s"), double.alias("d")).filter("k = 2 and s = 1 and d = 1")
    comb = good.groupBy("cut_id", "c").agg(F.count("*").alias("teeth")).filter("teeth = c - 1").select("cut_id", F.lit(True).alias("comb"))
    subtour = (F.col("c") == 1) & (F.col("atoms") == 2) & (F.col("rhs") == 2) & (F.col("sense") == "G")
    return shape.join(comb, "cut_id", "left").select("cut_id", F.when(subtour, "subtour").when(F.col("comb"), "comb").otherwise("other").alias("kind"))


def blocks(xedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two-connected components of the edges with 0 < x < 1: (component, block, i, j), and cut nodes (node, n_blocks); see :func:`edge_blocks`."""
    edges = xedges.filter((F.col("x") > ZERO) & (F.col("x") < ONE) & (F.col("i") != F.col("j"))).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    found = materialize(edge_blocks(materialize(edges, "fractional")), "blocks")
    nodes = found.select("component", "block", F.explode(F.array("i", "j")).alias("node")).distinct()
    return found, nodes.groupBy("node").agg(F.count("*").alias("n_blocks")).filter("n_blocks > 1")
