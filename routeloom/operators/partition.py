"""Dividing nodes into regions and tours into segments, and what joins the parts again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norms import ARRAY_NORMS, length_col
from ..jobs.session import materialize
from .improve import shorter_path
from .neighbors import nearest_of_group
from .ranking import ranked
from .tours import edges_to_tour, path_length, steps, tour_segments


def _polar_caps(nodes: DataFrame, n: int, bucket: int, box: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Nodes with codes 2 (the cap of low x), 6 (between) and 7 (the cap of high x), and these regions."""
    parts = 2
    while n // (parts + 2) > bucket:
        parts *= 2
    cap = n // (parts + 2)
    placed = materialize(ranked(nodes.select("id", "x", "y"), ["x", "id"], name="r"), "caps")
    code = F.when(F.col("r") <= cap, 2).when(F.col("r") <= n - 1 - cap, 6).otherwise(7).cast("long")
    low, high = (placed.filter(F.col("r") == k).first()["x"] for k in (cap, n - 1 - cap))
    whole = nodes.sparkSession.range(1).select(*box)
    sides = [(2, 1, "x0", low), (6, 2, low, high), (7, 2, high, "x1")]
    edge = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    regions = [whole.select(F.lit(c).cast("long").alias("code"), F.lit(d).alias("depth"), edge(a).alias("x0"), edge(b).alias("x1"), "y0", "y1") for c, d, a, b in sides]
    return placed.select("id", "x", "y", code.alias("code")), regions[0].unionByName(regions[1]).unionByName(regions[2])


def karp_partition(nodes: DataFrame, bucket: int, polar: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with their part_id, and regions(part_id, x0, x1, y0, y1, cnt).

    Each part with over ``bucket`` nodes is halved at the median of its wider side (x if both are
    equal, ties by id); the lower half has the odd node. Parts are numbered from the lower halves
    up. A level costs one range sort of the open parts, so a part of any size is spread. With
    ``polar`` (x is a latitude) a cap at each pole is cut off first: as many nodes as one of ``p + 2``
    parts, for the smallest power of two ``p`` at which these fit ``bucket``, and one more in the low cap.
    """
    total = nodes.agg(F.count("*"), *[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    if total[0] < 2 * bucket:
        raise ValueError(f"{total[0]} nodes are too few for parts of {bucket}")
    box = [F.lit(float(v)).alias(c) for v, c in zip(total[1:], ("x0", "x1", "y0", "y1"))]
    open_ = nodes.select("id", "x", "y", F.lit(1).cast("long").alias("code"))
    regions = nodes.sparkSession.range(1).select(F.lit(1).cast("long").alias("code"), F.lit(0).alias("depth"), *box)
    parts, boxes = None, None
    if polar:
        open_, regions = _polar_caps(nodes, total[0], bucket, box)
    while True:
        stats = open_.groupBy("code").agg(F.count("*").alias("n"), (F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("by_x"))
        sized = materialize(regions.join(stats, "code"), "regions")
        done = sized.filter(F.col("n") <= bucket)
        small = open_.join(done.select("code", "depth"), "code").select("id", "x", "y", "code", "depth")
        parts, boxes = (small, done) if parts is None else (parts.unionByName(small), boxes.unionByName(done))
        if not sized.filter(F.col("n") > bucket).take(1):
            break
        wide = open_.join(sized.filter(F.col("n") > bucket).select("code", "n", "by_x"), "code").withColumn("at", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y")))
        placed = materialize(ranked(wide, ["at", "id"], ["code"], "r").withColumn("last", F.floor((F.col("n") - 1) / 2)), "halves")
        cut = placed.filter("r = last").select("code", F.col("at").alias("cut"))
        split = sized.join(cut, "code")
        sides = []
        for high in (0, 1):
            edge = {c: F.when(on & F.lit(bool(high) == (c[1] == "0")), F.col("cut")).otherwise(F.col(c)) for c, on in (("x0", F.col("by_x")), ("x1", F.col("by_x")), ("y0", ~F.col("by_x")), ("y1", ~F.col("by_x")))}
            sides.append(split.select((F.col("code") * 2 + high).alias("code"), (F.col("depth") + 1).alias("depth"), *[v.alias(c) for c, v in edge.items()]))
        regions = sides[0].unionByName(sides[1])
        open_ = placed.select("id", "x", "y", (F.col("code") * 2 + F.when(F.col("r") <= F.col("last"), 0).otherwise(1)).alias("code"))
    depth = boxes.agg(F.max("depth")).first()[0]
    numbered = materialize(ranked(boxes.withColumn("place", F.col("code") * F.pow(F.lit(2.0), depth - F.col("depth"))), ["place"], name="part_id"), "parts")
    out = numbered.select("part_id", "x0", "x1", "y0", "y1", F.col("n").alias("cnt"))
    return parts.join(numbered.select("code", "part_id"), "code").select("id", "x", "y", "part_id"), out


def overlapping_regions(regions: DataFrame) -> DataFrame:
    """a, b (a < b): regions of which one has a corner strictly inside the other.

    Regions meet in the cells of a grid of their average side, not in all pairs.
    """
    side = float(regions.agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")))).first()[0] or 0) or 1.0
    box = F.struct("x0", "x1", "y0", "y1")
    cells = regions.select(F.col("part_id"), box.alias("r"), F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side))).alias("cx"), "y0", "y1")
    cells = cells.select("part_id", "r", "cx", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor(F.col("y1") / side))).alias("cy"))
    a, b = cells.select(F.col("part_id").alias("a"), F.col("r").alias("ra"), "cx", "cy"), cells.select(F.col("part_id").alias("b"), F.col("r").alias("rb"), "cx", "cy")

    def holds(outer: str, inner: str):
        corners = [(F.col(f"{inner}.{x}"), F.col(f"{inner}.{y}")) for x in ("x0", "x1") for y in ("y0", "y1")]
        found = F.lit(False)
        for x, y in corners:
            found = found | ((x > F.col(f"{outer}.x0")) & (x < F.col(f"{outer}.x1")) & (y > F.col(f"{outer}.y0")) & (y < F.col(f"{outer}.y1")))
        return found

    return a.join(b, ["cx", "cy"]).filter("a < b").filter(holds("ra", "rb") | holds("rb", "ra")).select("a", "b").distinct()


def check_partition(nodes: DataFrame, parts: DataFrame, regions: DataFrame) -> DataFrame:
    """id, problem: nodes in no part, in several, in one that isn't known, or outside their part's box."""
    counts = parts.groupBy("id").agg(F.count("*").alias("n"))
    lost = nodes.join(counts, "id", "left").filter("n is null or n > 1").select("id", F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("problem"))
    placed = parts.select("id", "part_id").join(nodes.select("id", "x", "y"), "id").join(regions, "part_id", "left")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return lost.unionByName(placed.filter(~F.coalesce(inside, F.lit(False))).select("id", F.when(F.col("x0").isNull(), "unknown part").otherwise("outside").alias("problem")))


def region_adjacency(regions: DataFrame, mode: str = "plane") -> DataFrame:
    """a, b, side (a < b) of regions that touch; equi-joins on the coordinate that they share.

    ``plane``: they share a side's coordinate with ranges that meet. ``dateline``: one ends at the
    largest y of all, the other begins at the smallest, and their x ranges meet (side ``dateline``).
    ``poles``: both reach the largest x (side ``north``) or the smallest (``south``), north first.
    """
    s = regions.select(F.col("part_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")])
    t = regions.select(F.col("part_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")])
    other = F.col("a") != F.col("b")
    meets = lambda c: (F.col(f"a_{c}0") <= F.col(f"b_{c}1")) & (F.col(f"b_{c}0") <= F.col(f"a_{c}1"))
    if mode == "plane":
        found = [(s.join(t, F.col(f"a_{along}1") == F.col(f"b_{along}0")).filter(meets(across) & other), along) for along, across in (("x", "y"), ("y", "x"))]
    else:
        x0, x1, y0, y1 = regions.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
        if mode == "dateline":
            found = [(s.filter(F.col("a_y1") == F.lit(y1)).join(t.filter(F.col("b_y0") == F.lit(y0)), meets("x") & other), "dateline")]
        elif mode == "poles":
            found = [(s.filter(F.col(f"a_{c}") == F.lit(v)).join(t.filter(F.col(f"b_{c}") == F.lit(v)), other), name) for c, v, name in (("x1", x1, "north"), ("x0", x0, "south"))]
        else:
            raise ValueError(f"mode {mode!r}: plane, dateline or poles")
    rows = [p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(side).alias("side")) for p, side in found]
    union = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return union.groupBy("a", "b").agg(F.min("side").alias("side"))


def region_pairs(regions: DataFrame, mode: str = "plane") -> DataFrame:
    """i, j, len of all pairs of regions: 0 if they touch, else 1. As many rows as there are pairs: a table of parts, not of nodes."""
    ids = regions.select("part_id")
    pairs = ids.select(F.col("part_id").alias("i")).join(ids.select(F.col("part_id").alias("j")), F.col("i") < F.col("j"))
    touching = region_adjacency(regions, mode).select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(0).alias("len"))
    return pairs.join(touching, ["i", "j"], "left").select("i", "j", F.coalesce("len", F.lit(1)).alias("len"))


def export_parts(parts: DataFrame, path: str) -> None:
    """Each part's points in a folder of its own (``part_id=...``), with the nodes' own names in ``id``."""
    parts.select("part_id", "id", "x", "y").repartition("part_id").sortWithinPartitions("part_id", "id").write.partitionBy("part_id").parquet(path)


def border_points(parts: DataFrame, regions: DataFrame, pairs: DataFrame, m: int = 4000) -> DataFrame:
    """a, b, part_id, id, x, y, off, rank: the ``m`` nodes of each part nearest to a border that it shares, within the other's range.

    ``m`` is the limit of a border's work, as in the stitching of tours.
    """
    boxes = lambda c: regions.select(F.col("part_id").alias(c), F.struct("x0", "x1", "y0", "y1").alias(f"r{c}"))
    framed = materialize(pairs.join(boxes("a"), "a").join(boxes("b"), "b"), "borders")
    found = []
    for own, other in (("a", "b"), ("b", "a")):
        rows = framed.withColumn("part_id", F.col(own)).join(parts, "part_id")
        for along, across in (("x", "y"), ("y", "x")):
            here = rows.filter(F.col("side") == along).filter(F.col(across).between(F.col(f"r{other}.{across}0"), F.col(f"r{other}.{across}1")))
            line = F.when(F.col(f"r{own}.{along}1") == F.col(f"r{other}.{along}0"), F.col(f"r{own}.{along}1")).otherwise(F.col(f"r{own}.{along}0"))
            found.append(here.select("a", "b", "part_id", "id", "x", "y", F.abs(F.col(along) - line).alias("off")))
    union = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    by = Window.partitionBy("a", "b", "part_id").orderBy("off", "id")
    return union.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= m)


def closest_border_pairs(borders: DataFrame, norm: str) -> DataFrame:
    """a, b, i, j, len: the closest nodes across each border (ties by i, then j), from :func:`border_points`, by a neighbour search."""
    rows = borders.select(F.struct("a", "b", "id").alias("id"), "x", "y", F.struct("a", "b").cast("string").alias("border"), "a", "b", "part_id")
    side = lambda c: rows.filter(F.col("part_id") == F.col(c)).select("id", "x", "y", F.col("border").alias("part_id"))
    near = nearest_of_group(side("a"), side("b"), norm)
    best = near.groupBy("id.a", "id.b").agg(F.min(F.struct("len", F.col("id.id").alias("i"), F.col("nbr.id").alias("j"))).alias("e"))
    return best.select("a", "b", "e.i", "e.j", "e.len")


def stitch_tours(tours: DataFrame, order: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, pos, node: one tour from ``tours(part_id, pos, node)``, spliced part by part in ``order(rank, part_id)``.

    Two parts that follow each other are joined at their closest nodes p and q (ties by p, then
    q): p's and q's edges to their next nodes go, and the cheaper of the two ways to reconnect the
    four ends is taken. All splices are found at once; where the edge of p went to the splice before,
    its edge from the node before it goes instead. Each part needs three nodes or more.
    """
    small = tours.groupBy("part_id").agg(F.count("*").alias("n")).filter("n < 3").take(1)
    if small:
        raise ValueError(f"part {small[0]['part_id']} has fewer than three nodes")
    placed = materialize(tours.join(order, "part_id").join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").select("rank", "pos", "node", "x", "y"), "placed")
    own = placed.select(F.col("node").alias("id"), "x", "y", F.col("rank").alias("part_id"))
    near = nearest_of_group(own, own.withColumn("part_id", F.col("part_id") - 1), norm)
    pairs = near.join(own.select("id", F.col("part_id").alias("rank")), "id").groupBy("rank").agg(F.min(F.struct("len", F.col("id").alias("p"), F.col("nbr").alias("q"))).alias("e"))
    pairs = materialize(pairs.select("rank", "e.p", "e.q"), "closest")
    used = pairs.select((F.col("rank") + 1).alias("rank"), F.col("q").alias("entered"))
    cycles = steps(placed.select(F.col("rank").alias("tour_id"), "pos", "node"))
    after = cycles.select(F.col("i").alias("node"), F.col("j").alias("next"))
    before = cycles.select(F.col("j").alias("node"), F.col("i").alias("previous"))
    point = lambda c: nodes.select(F.col("id").alias(c), F.struct("x", "y").alias(f"at_{c}"))
    rows = pairs.join(used, "rank", "left").join(after.withColumnsRenamed({"node": "p", "next": "p_next"}), "p").join(before.withColumnsRenamed({"node": "p", "previous": "p_before"}), "p").join(after.withColumnsRenamed({"node": "q", "next": "q1"}), "q")
    rows = rows.withColumn("p1", F.when(F.col("p") == F.col("entered"), F.col("p_before")).otherwise(F.col("p_next")))
    for c in ("p", "q", "p1", "q1"):
        rows = rows.join(point(c), c)
    cost = lambda a, b: length_col(norm, F.col(f"at_{a}"), F.col(f"at_{b}"))
    straight = cost("p", "q") + cost("p1", "q1") <= cost("p", "q1") + cost("p1", "q")
    splices = materialize(rows.select("p", "p1", "q", "q1", straight.alias("straight")), "splices")
    edge = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    gone = splices.select(F.explode(F.array(edge("p", "p1"), edge("q", "q1"))).alias("e")).select("e.*")
    made = splices.select(F.explode(F.when(F.col("straight"), F.array(edge("p", "q"), edge("p1", "q1"))).otherwise(F.array(edge("p", "q1"), edge("p1", "q")))).alias("e")).select("e.*")
    kept = cycles.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(gone, ["i", "j"], "left_anti")
    return edges_to_tour(materialize(kept.unionByName(made), "stitched"))


def _shorter(norm: str, near: int):
    """Each segment's nodes in a better order, the first and the last fixed; rows come in the order of segments and positions."""

    def improved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of a segment that may go on

        def better(rows: pd.DataFrame) -> pd.DataFrame:
            tour, seg, node, x, y = (rows[c].to_numpy() for c in ("tour_id", "seg_id", "node", "x", "y"))
            starts = np.flatnonzero((tour[1:] != tour[:-1]) | (seg[1:] != seg[:-1])) + 1
            order = [lo + shorter_path(x[lo:hi], y[lo:hi], norm, near) for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(rows)])]
            return rows[["tour_id", "seg_id", "pos"]].assign(node=node[np.concatenate(order)])

        for batch in batches:
            if not len(batch):
                continue
            last = batch[["tour_id", "seg_id"]].iloc[-1]
            open_ = ((batch["tour_id"] == last["tour_id"]) & (batch["seg_id"] == last["seg_id"])).to_numpy()
            if not open_.all() or held and (held[-1][["tour_id", "seg_id"]].iloc[-1] != last).any():
                yield better(pd.concat([*held, batch[~open_]]))
                held = []
            held.append(batch[open_])
        if held:
            yield better(pd.concat(held))

    return improved


def improve_segments(tour: DataFrame, nodes: DataFrame, norm: str, bucket: int = 1000, first: int | None = None, near: int = 10) -> DataFrame:
    """tour_id, seg_id, pos, node: each segment of ``bucket`` nodes improved by 2-opt and 2.5-opt moves, both ends fixed.

    Moves make an edge between a node and one of its ``near`` nearest in the segment; at the end none
    of them makes it shorter. A segment's task holds memory for its nodes and their lists alone. A
    segment is never longer than before; :func:`concat_segments` joins them again.
    """
    if norm not in ARRAY_NORMS:
        raise ValueError(f"norm {norm!r} isn't one of {sorted(ARRAY_NORMS)}")
    rows = tour_segments(tour, bucket, first).join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    rows = rows.select("tour_id", "seg_id", F.col("pos").cast("long").alias("pos"), F.col("node").cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # Segments are many and small: a task takes its own one after the other, not a call of Python for each.
    dealt = rows.repartition("tour_id", "seg_id").sortWithinPartitions("tour_id", "seg_id", "pos")
    return dealt.mapInPandas(_shorter(norm, near), rows.select("tour_id", "seg_id", "pos", "node").schema)


def segment_index(tour: DataFrame, nodes: DataFrame, norm: str, bucket: int, first: int | None = None) -> DataFrame:
    """tour_id, seg_id, cnt, start, origlen: each segment's size, first position and path length."""
    rows = tour_segments(tour, bucket, first)
    begins = rows.groupBy("tour_id", "seg_id").agg(F.count("*").alias("cnt"), F.min("pos").alias("start"))
    within = rows.join(begins, ["tour_id", "seg_id"])
    key = F.struct("tour_id", "seg_id")
    paths = path_length(within.select(key.alias("tour_id"), (F.col("pos") - F.col("start")).alias("pos"), "node"), nodes, norm)
    return begins.join(paths.select("tour_id.*", F.col("len").alias("origlen")), ["tour_id", "seg_id"]).select("tour_id", "seg_id", "cnt", "start", "origlen")


def shortening_turns(segments: DataFrame, nodes: DataFrame, norm: str) -> DataFrame:
    """tour_id, seg_id, n_turns: how many pairs of edges of each of ``segments(tour_id, seg_id, pos, node)`` could be replaced to make it shorter by turning what is between them."""
    point = nodes.select(F.col("id").alias("node"), F.struct("x", "y").alias("p"))
    rows = segments.join(point, "node").select("tour_id", "seg_id", "pos", "p")
    after = rows.select("tour_id", "seg_id", (F.col("pos") - 1).alias("pos"), F.col("p").alias("q"))
    edges = rows.join(after, ["tour_id", "seg_id", "pos"])
    a = edges.select("tour_id", "seg_id", F.col("pos").alias("a"), F.col("p").alias("p1"), F.col("q").alias("q1"))
    b = edges.select("tour_id", "seg_id", F.col("pos").alias("b"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    cost = lambda s, t: length_col(norm, F.col(s), F.col(t))
    gain = cost("p1", "q1") + cost("p2", "q2") - cost("p1", "p2") - cost("q1", "q2")
    found = a.join(b, ["tour_id", "seg_id"]).filter("b > a + 1").groupBy("tour_id", "seg_id").agg(F.count_if(gain > 0).alias("n_turns"))
    return segments.select("tour_id", "seg_id").distinct().join(found, ["tour_id", "seg_id"], "left").select("tour_id", "seg_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


def concat_segments(segments: DataFrame) -> DataFrame:
    """tour_id, pos, node of ``segments(tour_id, seg_id, pos, node)``: positions run on from one segment to the next."""
    sizes = segments.groupBy("tour_id", "seg_id").agg(F.count("*").alias("n"), F.min("pos").alias("low"))
    before = Window.partitionBy("tour_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tour_id", "seg_id", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return segments.join(starts, ["tour_id", "seg_id"]).select("tour_id", (F.col("start") + F.col("pos") - F.col("low")).alias("pos"), "node")


def depot_subproblems(parts: DataFrame, tour: DataFrame, costs: DataFrame) -> DataFrame:
    """part_id, id, rank, cost, depots: nodes in tour order with the depot cost; four times the root of the size, rounded down, plus one, depots."""
    from .tours import induced_order

    sizes = parts.groupBy("part_id").agg((4 * (F.floor(F.sqrt(F.count("*"))) + 1)).cast("long").alias("depots"))
    return induced_order(parts.select("part_id", "id"), tour).join(costs.select("id", "cost"), "id").join(sizes, "part_id").select("part_id", "id", "rank", "cost", "depots")
