"""Trees and tours grown on edge tables in rounds, each a few joins whatever the table's size.

Rounds shrink what is open; once that is at most ``LOCAL_EDGES`` edges or ``LOCAL_ENDS`` nodes, one
task finishes by the same rule, which has the same result in fewer steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norms import ARRAY_NORMS, length_col
from ..jobs.session import materialize
from .components import component_labels
from .neighbors import nearest_outside_group
from .ranking import ranked
from .tours import edges_to_tour

#: What one task finishes: open edges, and nodes that links may start from.
LOCAL_EDGES, LOCAL_ENDS = 50_000, 2_000


class _Roots(dict):
    """Union-find over any labels."""

    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _tree_tail(rows: pd.DataFrame) -> pd.DataFrame:
    roots = _Roots()
    kept = [roots.join(a, b) for a, b in zip(rows["ci"], rows["cj"])]
    return rows.loc[kept, ["i", "j", "len"]]


def minimum_spanning_tree(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """i, j, len of the minimum spanning forest under the order (len, i, j); Boruvka rounds.

    Each round every component takes its smallest outgoing edge; components at least halve.
    """
    todo = materialize(edges.select("i", "j", F.col("len").cast("long").alias("len"), F.col("i").alias("ci"), F.col("j").alias("cj")).filter("i != j"), "open")
    tree = edges.select("i", "j", F.col("len").cast("long").alias("len")).limit(0)
    while n := todo.count():
        if n <= local:
            tail = lambda rows: _tree_tail(rows.sort_values(["len", "i", "j"], kind="stable"))
            return tree.unionByName(materialize(todo.groupBy(F.lit("all")).applyInPandas(tail, tree.schema), "tree"))
        least = F.struct("len", "i", "j")
        picks = todo.select(F.explode(F.array("ci", "cj")).alias("c"), least.alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.i", "e.j", "e.len").distinct()
        picks = materialize(picks.join(todo.select("i", "j", "len", "ci", "cj"), ["i", "j", "len"]).distinct(), "picks")
        tree = tree.unionByName(picks.select("i", "j", "len"))
        labels = component_labels(picks, "ci", "cj")
        for end in ("ci", "cj"):
            moved = labels.select(F.col("node").alias(end), F.col("component").alias("_to"))
            todo = todo.join(moved, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        todo = materialize(todo.filter("ci != cj").select("i", "j", "len", "ci", "cj"), "open")
    return tree


def _fragment_tail(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["key", "i", "j"], kind="stable")
    roots, degree = _Roots(), {}
    kept = []
    for i, j, fi, fj, di, dj in zip(rows["i"], rows["j"], rows["fi"], rows["fj"], rows["di"], rows["dj"]):
        free = degree.setdefault(i, di) < 2 and degree.setdefault(j, dj) < 2
        take = free and roots.join(fi, fj)
        if take:
            degree[i], degree[j] = degree[i] + 1, degree[j] + 1
        kept.append(take)
    return rows.loc[kept, ["i", "j", "len"]]


def _degrees(taken: DataFrame) -> DataFrame:
    return taken.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("degree"))


def _fragments(taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, degree and node, component of the edges taken so far."""
    return _degrees(taken), component_labels(taken)


def _after(todo: DataFrame, degrees: DataFrame, labels: DataFrame) -> DataFrame:
    """Open edges (i, j, len, key, di, dj, fi, fj) after edges were taken that add ``degrees`` (node, degree) to nodes and put fragments together by ``labels`` (node, component)."""
    for end in "ij":
        todo = todo.join(degrees.select(F.col("node").alias(end), F.col("degree").alias(f"_d{end}")), end, "left")
        todo = todo.join(labels.select(F.col("node").alias(f"f{end}"), F.col("component").alias(f"_f{end}")), f"f{end}", "left")
    more = [(F.col(f"d{e}") + F.coalesce(f"_d{e}", F.lit(0))).alias(f"d{e}") for e in "ij"]
    return todo.select("i", "j", "len", "key", *more, *[F.coalesce(f"_f{e}", f"f{e}").alias(f"f{e}") for e in "ij"])


def _sure(todo: DataFrame) -> DataFrame:
    """i, j, len, fi, fj: of open edges (key, i, j, len, fi, fj) those that the scan by (key, i, j) takes whatever it takes before.

    Such an edge is the smallest one at both of its nodes, so both still have room, and the smallest
    one of all that leave one of the fragments ``fi``, ``fj``, which is therefore still as it is now:
    the edge can't close a cycle.
    """
    at = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in (("node", "i"), ("node", "j"), ("path", "fi"), ("path", "fj"))]))
    least = todo.select(at.alias("at"), F.struct("key", "i", "j", "len", "fi", "fj").alias("e")).groupBy("at").agg(F.min("e").alias("e"))
    votes = least.groupBy("e").agg(F.count_if(F.col("at.kind") == "node").alias("nodes"), F.count_if(F.col("at.kind") == "path").alias("paths"))
    return votes.filter("nodes = 2 and paths > 0").select("e.i", "e.j", "e.len", "e.fi", "e.fj")


def greedy_fragments(edges: DataFrame, key: Column | None = None, taken: DataFrame | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """i, j, len taken by the scan in (len, i, j) order that keeps degrees below three and makes no cycle.

    ``key``: what to scan by in place of the length. ``taken``: edges (i, j, len) that are already
    in; they aren't returned. Each round takes the edges that the scan is sure to take; edges at
    nodes of degree two or inside one fragment close. Degrees and fragments go on from those of the
    round before, so a round's work goes with its own edges, not with all that are taken.
    """
    key = F.col("len") if key is None else key
    todo = materialize(edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("len").cast("long").alias("len"), key.alias("key")).filter("i != j").distinct(), "open")
    new = todo.select("i", "j", "len").limit(0)
    todo = todo.select("*", *[F.lit(0).cast("long").alias(f"d{e}") for e in "ij"], *[F.col(e).alias(f"f{e}") for e in "ij"])
    if taken is not None:
        todo = _after(todo, *_fragments(taken))
    while True:
        todo = materialize(todo.filter("di < 2 and dj < 2 and fi != fj"), "open")
        if (n := todo.count()) <= local:
            return new.unionByName(materialize(todo.groupBy(F.lit("all")).applyInPandas(_fragment_tail, new.schema), "fragments")) if n else new
        both = materialize(_sure(todo), "taken")
        new = new.unionByName(both.select(*new.columns))
        todo = _after(todo.join(both.select("i", "j"), ["i", "j"], "left_anti"), _degrees(both), component_labels(both, "fi", "fj"))


def _free(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """id, x, y, degree, part_id (its fragment) of the nodes that take another edge."""
    degrees, labels = _fragments(taken)
    rows = nodes.select("id", "x", "y").join(degrees.withColumnRenamed("node", "id"), "id", "left").join(labels.withColumnsRenamed({"node": "id", "component": "part_id"}), "id", "left")
    return materialize(rows.select("id", "x", "y", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("part_id", "id").alias("part_id")).filter("degree < 2"), "free")


class _Ends:
    """The free ends of paths in one task; a path's other end is its ``tail``."""

    def __init__(self, rows: pd.DataFrame, norm: str):
        rows = rows.sort_values("id").reset_index(drop=True)
        self.ids, self.x, self.y = (rows[c].to_numpy() for c in ("id", "x", "y"))
        self.norm, self.degree, self.tail = norm, rows["degree"].to_numpy().copy(), np.arange(len(rows))
        for _, group in rows[rows["degree"] == 1].groupby("part_id"):
            a, b = group.index
            self.tail[a], self.tail[b] = b, a
        self.out: list[tuple[int, int]] = []

    def lengths(self, a, b) -> np.ndarray:
        return ARRAY_NORMS[self.norm](self.x[a] - self.x[b], self.y[a] - self.y[b])

    def link(self, a: int, b: int) -> bool:
        """Link two ends, if neither is used up and they are of two paths."""
        if self.degree[a] > 1 or self.degree[b] > 1 or self.tail[a] == b or a == b:
            return False
        self.out.append((min(a, b), max(a, b)))
        self.degree[[a, b]] += 1
        ends = self.tail[a], self.tail[b]
        self.tail[ends[0]], self.tail[ends[1]] = ends[1], ends[0]
        return True

    def paths(self) -> int:
        return int(((self.degree < 2) & (self.tail >= np.arange(len(self.ids)))).sum())

    def closed(self) -> pd.DataFrame:
        """All links, with the one that closes the tour."""
        ends = np.flatnonzero(self.degree < 2).tolist()
        if len(ends) == 2:
            self.out.append((ends[0], ends[1]))
        a, b = (np.array([p[k] for p in self.out], np.int64) for k in (0, 1))
        return pd.DataFrame({"i": self.ids[a], "j": self.ids[b], "len": self.lengths(a, b).astype(np.int64)})


def _shortest_tail(norm: str):
    """The scan over all pairs of ends, by (len, i, j)."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        ends = _Ends(rows, norm)
        a, b = np.triu_indices(len(rows), 1)
        for k in np.lexsort((b, a, ends.lengths(a, b))).tolist():
            ends.link(int(a[k]), int(b[k]))
        return ends.closed()

    return links


def _rounds_tail(norm: str):
    """Rounds of proposals, as with many ends."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        ends = _Ends(rows, norm)
        every = np.arange(len(rows))
        while ends.paths() > 1:
            proposals = set()
            for k in np.flatnonzero(ends.degree < 2).tolist():
                legal = ends.degree < 2
                legal[[k, ends.tail[k]]] = False
                d = np.where(legal, ends.lengths(every, k), np.inf)
                to = int(d.argmin())
                proposals.add((d[to], min(k, to), max(k, to)))
            for _, a, b in sorted(proposals):
                ends.link(a, b)
        return ends.closed()

    return links


def _lowest_links(free: DataFrame) -> DataFrame:
    """i, j: the links and the closing edge of the scan that links the lowest free end to the next one of another path, as one plan.

    Ends are paired by rank, (0, 1), (2, 3) and so on; a node without an edge is two ends of its
    path. That is what the scan does but where a pair's ends are those of one path by then, which
    are the last pairs of the cycles that all pairs and paths make. Of neighbouring such pairs p, ..., q - 1
    and the pair q after them the scan links the first end of p to that of p + 1, each second
    end to the first one of the pair after the next, and at last the second ends of q - 1 and q. The
    last pair of all closes the tour.
    """
    both = free.select("id", "part_id", F.explode(F.when(F.col("degree") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    ends = materialize(ranked(both, ["id", "copy"], name="rank"), "ends")
    pair = F.floor(F.col("rank") / 2)
    pairs = materialize(ends.groupBy(pair.alias("p")).agg(F.min("part_id").alias("a"), F.max("part_id").alias("b")), "pairs")
    labels = component_labels(pairs, "a", "b").withColumnRenamed("node", "a")
    ringed = pairs.join(labels, "a", "left").select("p", F.coalesce("component", "a").alias("ring"))
    last = materialize(ringed.groupBy("ring").agg(F.max("p").alias("p")).select("p"), "last-pairs")
    # Neighbouring ones have the same difference of pair and rank.
    runs = ranked(last, ["p"], name="at").withColumn("run", F.col("p") - F.col("at"))
    end = pairs.agg(F.max("p").alias("end"))  # one row
    bounds = runs.groupBy("run").agg(F.min("p").alias("first"), F.max("p").alias("to")).join(F.broadcast(end)).select("run", "first", F.least(F.col("to") + 1, "end").alias("q"))
    runs = materialize(runs.join(bounds, "run").select("p", "first", "q"), "runs")

    def link(when, a, b):
        return runs.filter(when).select(a.alias("ra"), b.alias("rb"))

    p = F.col("p")
    special = (
        link((p == F.col("first")) & (p < F.col("q")), 2 * p, 2 * p + 2)
        .unionByName(link(p <= F.col("q") - 2, 2 * p + 1, 2 * p + 4))
        .unionByName(link(p == F.col("q") - 1, 2 * p + 1, 2 * p + 3))
        .unionByName(link((p == F.col("first")) & (p == F.col("q")), 2 * p, 2 * p + 1))
    )
    changed = runs.select("p").unionByName(runs.select(F.col("q").alias("p"))).distinct()
    plain = pairs.select("p").join(changed, "p", "left_anti").select((2 * p).alias("ra"), (2 * p + 1).alias("rb"))
    rows = special.unionByName(plain)
    for side in ("a", "b"):
        rows = rows.join(ends.select(F.col("rank").alias(f"r{side}"), F.col("id").alias(side)), f"r{side}")
    return rows.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).filter("i != j")


def _with_lengths(pairs: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    for end in ("i", "j"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end), F.struct("x", "y").alias(f"p{end}")), end)
    return pairs.select("i", "j", length_col(norm, F.col("pi"), F.col("pj")).alias("len"))


def link_fragments(nodes: DataFrame, taken: DataFrame, norm: str, rule: str = "nearest", local: int = LOCAL_ENDS) -> DataFrame:
    """i, j, len of the edges that make one tour of all ``nodes(id, x, y)`` from the paths ``taken(i, j, len)``.

    ``rule``, each the same at any size:

    * ``nearest``: the shortest edge between free ends of two paths is taken again and again, ties by
      (i, j). A round takes all edges that are sure to be taken, from every end's nearest one.
    * ``lowest``: the lowest free end is linked to the next one that is of another path.
    * ``rounds``: each free end proposes its nearest one of another path; proposals are taken in the
      order of lengths, then come new ones.

    At last the ends of the one path are linked. Of ``nearest`` and ``rounds``, ``local`` ends or
    fewer are finished in one task by the same rule. Points in a row with ever larger gaps take
    ``nearest`` a round for each link before that.
    """
    if norm not in ARRAY_NORMS:
        raise ValueError(f"norm {norm!r} isn't one of {sorted(ARRAY_NORMS)}")
    if rule not in ("nearest", "lowest", "rounds"):
        raise ValueError(f"no rule {rule!r}")
    new = taken.select("i", "j", F.col("len").cast("long").alias("len")).limit(0)
    if rule == "lowest":
        return materialize(_with_lengths(_lowest_links(_free(nodes, taken)), nodes, norm), "links")
    tail = _shortest_tail(norm) if rule == "nearest" else _rounds_tail(norm)
    while True:
        free = _free(nodes, taken.select("i", "j").unionByName(new.select("i", "j")))
        n = free.count()
        if n <= max(local, 2):
            return new.unionByName(materialize(free.groupBy(F.lit("all")).applyInPandas(tail, new.schema), "links")) if n > 1 else new
        near = nearest_outside_group(free, norm).select(F.col("id").alias("i"), F.col("nbr").alias("j"), "len")
        if rule == "rounds":
            new = new.unionByName(greedy_fragments(near, taken=taken.select("i", "j", "len").unionByName(new)))
            continue
        open_ = near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("len").cast("long").alias("len")).distinct().withColumn("key", F.col("len"))
        for end in ("i", "j"):
            open_ = open_.join(free.select(F.col("id").alias(end), F.col("part_id").alias(f"f{end}")), end)
        # Each end's nearest one is all it takes: what isn't in the table is longer than what is.
        new = new.unionByName(materialize(_sure(open_).select(*new.columns), "links"))


def _closed(nodes: DataFrame, taken: DataFrame, norm: str, rule: str) -> DataFrame:
    taken = materialize(taken, "fragments")
    return edges_to_tour(materialize(taken.unionByName(link_fragments(nodes, taken, norm, rule)), "tour-edges"))


def greedy_tour(nodes: DataFrame, edges: DataFrame, norm: str) -> DataFrame:
    """tour_id, pos, node: the greedy fragments of candidate ``edges(i, j, len)``, linked to a tour."""
    return _closed(nodes, greedy_fragments(edges), norm, "nearest")


def x_greedy_tour(nodes: DataFrame, xedges: DataFrame, norm: str) -> DataFrame:
    """tour_id, pos, node: fragments by falling x, then the lowest links that are legal."""
    point = F.struct("x", "y")
    rows = xedges.select("i", "j", F.col("x").alias("value"))
    for end in ("i", "j"):
        rows = rows.join(nodes.select(F.col("id").alias(end), point.alias(f"p{end}")), end)
    rows = rows.select("i", "j", length_col(norm, F.col("pi"), F.col("pj")).alias("len"), "value")
    return _closed(nodes, greedy_fragments(rows, -F.col("value")), norm, "lowest")


def boruvka_tour(nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, pos, node: each round every node with an edge to give proposes its nearest legal node; proposals are taken in the order of lengths."""
    none = nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0).cast("long").alias("len")).limit(0)
    return _closed(nodes, none, norm, "rounds")


def component_cuts(xedges: DataFrame, x_eps: float = 1e-10) -> DataFrame:
    """cut_id, node, rhs: each component of the support but the one with the largest smallest node."""
    labels = materialize(component_labels(xedges.filter(F.col("x") > x_eps)), "components")
    last = labels.agg(F.max("component")).first()[0]
    return labels.filter(F.col("component") != F.lit(-1 if last is None else last)).select(F.col("component").alias("cut_id"), "node", F.lit(2).alias("rhs"))


def is_tour(edges: DataFrame, n: int) -> bool:
    """Is this edge set one cycle through n nodes?"""
    count = edges.agg(F.count("*")).first()[0]
    degrees = edges.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).agg(F.count("*"), F.min("d"), F.max("d")).first()
    if (count, *degrees) != (n, n, 2, 2):
        return False
    return component_labels(edges).select("component").distinct().count() == 1


def spanning_tree_bound(tree: DataFrame, weights: DataFrame) -> DataFrame:
    """len, bound: the tree's length, and that less twice the nodes' weights."""
    total = tree.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    taken = weights.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    return total.join(taken).select("len", (F.col("len") - 2 * F.col("w")).alias("bound"))


def curve_key(x, y, m: int, bits: int):
    """Place of (x, y), integers from 0, on the Sierpinski curve of a triangle of side ``m``: ``bits`` binary digits.

    The first digit tells the half of the square; then the triangle is halved time after time, with
    the coordinates turned into the half that holds the point, and doubled after every second turn.
    """
    over = x > y
    start = F.struct(over.cast("long").alias("h"), F.when(over, m - x).otherwise(x).alias("x"), F.when(over, m - y).otherwise(y).alias("y"))

    def turn(s, k):
        odd = k % 2 == 1
        px, py = F.when(odd, s["x"]).otherwise(2 * s["x"]), F.when(odd, s["y"]).otherwise(2 * s["y"])
        far = F.when(odd, px + py > m).otherwise(py > m)
        nx = F.when(~far, px).when(odd, m - py).otherwise(py - m)
        ny = F.when(~far, py).when(odd, px).otherwise(m - px)
        return F.struct((2 * s["h"] + far.cast("long")).alias("h"), nx.alias("x"), ny.alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), start, turn)["h"]


def space_filling_tour(nodes: DataFrame) -> DataFrame:
    """tour_id, pos, node: all nodes in the order of a space-filling curve, ties by id."""
    n, x0, x1, y0, y1 = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    low = [min(0.0, v or 0.0) for v in (x0, y0)]
    m = int(max(0.0, x1 or 0.0, y1 or 0.0) - low[0] - low[1] + 1.0)
    bits = max(n - 1, 0).bit_length() + 2
    keyed = nodes.select("id", curve_key((F.col("x") - low[0]).cast("long"), (F.col("y") - low[1]).cast("long"), m, bits).alias("key"))
    return ranked(keyed, ["key", "id"], name="pos").select(F.lit(0).cast("long").alias("tour_id"), "pos", F.col("id").alias("node"))
