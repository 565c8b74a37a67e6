"""Cuts by intervals of the node order, from weights that cross the gaps between nodes.

Let H(b) be the weight of the edges from nodes up to b to later ones, and X(a, b) that of the edges
from before a into a..b. Then the weight that leaves a..b is H(b) - H(a - 1) + 2 X(a, b). For one a,
X steps up only where an edge that crosses the gap before a ends; between two such ends only the
least H counts. So nodes are cut into blocks: a block's task has the edges that cross a gap of
it, its own nodes one by one, and of all later nodes only the least H of each stretch between two
of these edges' ends, which is a best over a range. Listing all intervals up to a limit goes
over the nodes of the stretches whose least interval is within it.

Weights are integers of 2^-32, so sums don't depend on their order. Intervals start and end at
nodes that have an edge to another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.session import materialize
from .ranking import range_best, ranked

_UNIT = float(1 << 32)
#: Nodes of a block.
BLOCK = 512
#: What a delta may be over a limit: weights are rounded, by half a unit each.
_CLOSE = 1e-8
#: Stands for no weight: larger than any.
_NONE = 1 << 62
#: Right ends of a part of the intervals that are listed, and left ends of one at least; left ends are of so many groups at most.
_ENDS, _LEFT, _GROUPS = 1 << 17, 1 << 10, 64
#: Left ends that are listed together go over a part's right ends in so many strides: 2 ** this.
_FAN = 5
#: How many left ends that are, and rows that are made at once.
_HITS, _ROWS = 32, 1 << 16


def _placed(xedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (v, pos, h, before) in the order of ids, with H after and before each; edges (i, j, w) by positions, i < j."""
    e = xedges.filter("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round(F.col("x") * _UNIT).cast("long").alias("w"))
    e = materialize(e.groupBy("i", "j").agg(F.sum("w").alias("w")), "weights")
    change = e.select(F.explode(F.array(F.struct(F.col("i").alias("v"), F.col("w").alias("d")), F.struct(F.col("j").alias("v"), (-F.col("w")).alias("d")))).alias("x")).groupBy("x.v").agg(F.sum("x.d").alias("d"))
    nodes = materialize(ranked(change, ["v"], name="pos").withColumn("block", F.floor(F.col("pos") / BLOCK)), "positions")
    inside = F.sum("d").over(Window.partitionBy("block").orderBy("pos"))
    sums = nodes.groupBy("block").agg(F.sum("d").alias("all"))
    # One row for each block of nodes.
    offsets = sums.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    nodes = nodes.withColumn("in", inside).join(offsets, "block").withColumn("h", F.col("in") + F.col("offset"))
    nodes = materialize(nodes.select("v", "pos", "h", (F.col("h") - F.col("d")).alias("before")), "crossing-weights")
    for end in ("i", "j"):
        e = e.join(nodes.select(F.col("v").alias(end), F.col("pos").alias(f"p{end}")), end)
    return nodes, materialize(e.select(F.col("pi").alias("i"), F.col("pj").alias("j"), "w"), "placed-edges")


_CELLS = "block long, own boolean, lo long, hi long, h long, at long, before long, ends boolean"
_FOUND = "a long, lo long, hi long, at long, delta long"


def _block_rows(length: int | None, limit: int | None, best: bool):
    """a, lo, hi, at, delta: intervals of left ends a of a block; ``at`` is the right end of the least one that ends in lo..hi."""

    def rows(edges: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("lo")
        lo, hi, h, at = (cells[c].to_numpy(np.int64) for c in ("lo", "hi", "h", "at"))
        own = cells[cells["own"]]
        i, j, w = (edges[c].to_numpy(np.int64) for c in ("i", "j", "w"))
        cell = np.searchsorted(lo, j)
        inside = cell < len(lo)  # with a bound on the length, edges may end further on
        i, j, w, cell = i[inside], j[inside], w[inside], cell[inside]
        first, last = (int(own["lo"].min()), int(own["lo"].max())) if len(own) else (0, -1)
        through = (i < first) & (j > last)

        def added(some: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lo), np.int64)
            np.add.at(out, cell[some], w[some])
            return out

        shared, local = added(through), np.flatnonzero(~through)
        parts = []
        for a, before, ends in zip(own["lo"].tolist(), own["before"].tolist(), own["ends"].tolist()):
            if not ends:
                continue
            crossing = local[(i[local] < a) & (j[local] >= a)]
            x = np.cumsum(shared + added(crossing))
            from_ = int(np.searchsorted(lo, a, side="right"))
            to = len(lo) if length is None else int(np.searchsorted(lo, a + length - 1, side="right"))
            delta = np.where(h[from_:to] >= _NONE, _NONE, h[from_:to] - before + 2 * x[from_:to])
            if not len(delta):
                continue
            chosen = np.array([int(delta.argmin())]) if best else np.arange(len(delta)) if limit is None else np.flatnonzero(delta <= limit)
            chosen = chosen[delta[chosen] < _NONE]
            parts.append(np.stack([np.full(len(chosen), a), lo[from_:to][chosen], hi[from_:to][chosen], at[from_:to][chosen], delta[chosen]]))
        data = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
        return pd.DataFrame(dict(zip(("a", "lo", "hi", "at", "delta"), data)))

    return rows


def _intervals(nodes: DataFrame, edges: DataFrame, length: int | None, limit: int | None, best: bool, tied: DataFrame | None = None) -> DataFrame:
    """What :func:`_block_rows` finds in all blocks; nodes of ``tied(v)`` are no ends."""
    free = F.lit(True)
    if tied is not None:
        nodes = nodes.join(tied.select("v", F.lit(True).alias("t")), "v", "left")
        free = F.col("t").isNull()
    nodes = materialize(nodes.select("pos", F.when(free, F.col("h")).otherwise(_NONE).alias("h"), "before", free.alias("ends")), "ends")
    block, last_block = F.floor(F.col("pos") / BLOCK), F.floor(F.col("j") / BLOCK)
    first = F.col("i") + 1 if length is None else F.greatest(F.col("i") + 1, F.col("j") - (length - 1))
    crossing = materialize(edges.filter(first <= F.col("j")).select("i", "j", "w", F.explode(F.sequence(F.floor(first / BLOCK), last_block)).alias("block")), "crossing-edges")
    single = [F.col("pos").alias("lo"), F.col("pos").alias("hi"), "h", F.col("pos").alias("at"), "before", "ends"]
    cells = nodes.select(block.alias("block"), F.lit(True).alias("own"), *single)
    if length is not None:
        before = F.floor(F.greatest(F.col("pos") - (length - 1), F.lit(0)) / BLOCK)
        later = nodes.select("*", block.alias("mine"), F.explode(F.sequence(before, block)).alias("block")).filter("block < mine")
        cells = cells.unionByName(later.select("block", F.lit(False).alias("own"), *single))
    else:
        n = nodes.agg(F.max("pos")).first()[0]
        end = (F.col("block") + 1) * BLOCK
        starts = crossing.filter(F.col("j") >= end).select("block", F.col("j").alias("lo")).unionByName(nodes.select(block.alias("block")).distinct().select("block", end.alias("lo"))).distinct()
        hi = F.coalesce(F.lead("lo").over(Window.partitionBy("block").orderBy("lo")) - 1, F.lit(n))
        gaps = materialize(starts.filter(F.col("lo") <= F.lit(n)).withColumn("hi", hi), "stretches")
        values = nodes.select(F.lit(0).alias("g"), "pos", F.struct("h", "pos").alias("least"))
        least = range_best(values, gaps.withColumn("g", F.lit(0)), ["g"], {"least": F.least})
        cells = cells.unionByName(least.select("block", F.lit(False).alias("own"), "lo", "hi", F.col("least.h").alias("h"), F.col("least.pos").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("ends")))
    cells = cells.selectExpr(*[f"CAST({c.split(' ')[0]} AS {c.split(' ')[1]}) AS {c.split(' ')[0]}" for c in _CELLS.split(", ")])
    # Blocks are few bytes and much work: by bytes a task would get many.
    tasks = max(1, min(2000, (nodes.agg(F.max("pos")).first()[0] or 0) // (4 * BLOCK) + 1))
    crossing, cells = crossing.repartition(tasks, "block"), cells.repartition(tasks, "block")
    return materialize(crossing.groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(_block_rows(length, limit, best), _FOUND), "intervals")


def _named(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, delta with the nodes' ids."""
    for end in ("a", "b"):
        found = found.join(nodes.select(F.col("pos").alias(end), F.col("v").alias(f"n{end}")), end)
    return found.select(F.col("na").alias("a"), F.col("nb").alias("b"), (F.col("delta") / F.lit(_UNIT)).alias("delta"))


def _end_rows(limit: int, stride: int):
    """a, b, delta of the intervals of hits (``kind`` 1) with the ends of their part (``kind`` 0), which stand before them.

    Hits of a few left ends go over the ends together, ``stride`` positions at a time: rows that follow each other
    repeat the same ends, which Parquet files keep in little space.
    """

    def listed(ends: list[np.ndarray], names: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, pos, h = ends
        strides = np.arange(pos[0], pos[-1] + stride + 1, stride)
        for some in (slice(k, k + _HITS) for k in range(0, len(names), _HITS)):
            within = {t: np.flatnonzero(h <= limit - t) for t in set(more[some].tolist())}
            found = [within[t] for t in more[some].tolist()]
            cuts = [np.searchsorted(pos[x], np.clip(strides, first, last + 1)) for x, first, last in zip(found, lo[some].tolist(), hi[some].tolist())]
            parts, of = [], []
            for n in range(len(strides) - 1):
                for k, (x, cut) in enumerate(zip(found, cuts)):
                    if cut[n] < cut[n + 1]:
                        parts.append(x[cut[n] : cut[n + 1]])
                        of.append(k)
                if parts and (n == len(strides) - 2 or sum(map(len, parts)) >= _ROWS):
                    at, hit = np.concatenate(parts), np.repeat(of, [len(x) for x in parts])
                    yield pa.record_batch([names[some][hit], v[at], (h[at] + more[some][hit]) / _UNIT], names=["a", "b", "delta"])
                    parts, of = [], []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = None, []
        for batch in batches:
            parts, kinds, *columns = (batch.column(c).to_numpy() for c in ("part", "kind", "v", "lo", "hi", "more"))
            starts = np.flatnonzero(np.diff(parts, prepend=-1) | np.diff(kinds, prepend=-1)).tolist() if len(parts) else []
            for start, stop in zip(starts, [*starts[1:], len(parts)]):
                if parts[start] != part:
                    part, ends = parts[start], []
                v, lo, hi, more = (c[start:stop] for c in columns)
                if kinds[start] == 0:
                    ends.append((v, lo, more))
                    continue
                ends = [tuple(map(np.concatenate, zip(*ends)))]
                yield from listed(ends[0], v, lo, hi, more)

    return rows


def _enumerated(hits: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """a, b, delta of all intervals of ``hits`` (a, lo, hi, at, delta: the least one) that end in lo..hi and are within the limit.

    There may be as many as pairs of nodes, so they are made where they are read: what is shuffled are the hits
    of a group of left ends and the right ends of a block of nodes, once for each block and group.
    """
    n = nodes.agg(F.max("pos")).first()[0] or 0
    groups = min(n // _LEFT + 1, _GROUPS)
    group = F.floor(F.col("a") * groups / (n + 1))
    # What is added to H is the same for all ends in lo..hi.
    base = nodes.select(F.col("pos").alias("at"), F.col("h").alias("ha"))
    named = nodes.select(F.col("pos").alias("a"), "v")
    hits = materialize(hits.join(base, "at").join(named, "a").select(group.alias("group"), "v", "lo", "hi", (F.col("delta") - F.col("ha")).alias("more")), "hits")
    block = lambda c: F.floor(F.col(c) / _ENDS)
    lefts = hits.select("group", F.explode(F.sequence(block("lo"), block("hi"))).alias("block"), F.lit(1).alias("kind"), "v", "lo", "hi", "more")
    used = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.floor(((block("pos") + 1) * _ENDS) * groups / (n + 1)), F.lit(groups - 1))))
    rights = nodes.select(used.alias("group"), block("pos").alias("block"), F.lit(0).alias("kind"), "v", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.col("h").alias("more"))
    dealt = lefts.unionByName(rights).withColumn("part", F.col("block") * groups + F.col("group")).drop("block", "group")
    parts = groups * (n // _ENDS + 1)
    dealt = dealt.repartition(min(2000, parts), "part").sortWithinPartitions("part", "kind", "lo", "v")
    return dealt.mapInArrow(_end_rows(limit, max(1, _ENDS >> _FAN)), "a long, b long, delta double")


def interval_deltas(xedges: DataFrame, length: int) -> DataFrame:
    """a, b, delta of all intervals of 2 to ``length`` consecutive nodes: the x of edges with one end in a..b."""
    nodes, edges = _placed(xedges)
    return _named(_intervals(nodes, edges, length, None, False).withColumnRenamed("at", "b"), nodes)


def all_segment_cuts(xedges: DataFrame, length: int | None, limit: float) -> DataFrame:
    """a, b, delta of the intervals of two nodes or more (``length`` at most, if given) with a delta of at most ``limit``."""
    nodes, edges = _placed(xedges)
    if not nodes.take(1):
        return _named(nodes.select(F.col("pos").alias("a"), F.col("pos").alias("b"), F.col("h").alias("delta")), nodes)
    most = int((limit + _CLOSE) * _UNIT)
    found = _intervals(nodes, edges, length, most, False)
    alone = materialize(_named(found.filter("lo = hi").select("a", F.col("at").alias("b"), "delta"), nodes), "intervals-of-blocks")
    return alone if length is not None else alone.unionByName(_enumerated(found.filter("lo != hi"), nodes, most))


def segment_cuts(xedges: DataFrame, length: int | None = None, below: float = 2 - 1e-4, one: float = 0.999999) -> DataFrame:
    """a, b, delta: for each left end the interval of least delta (the smallest b of equal ones), if it's less than ``below``.

    ``length`` bounds the intervals' nodes, if it is given. A node with two edges of x of ``one`` or
    more starts or ends no interval.
    """
    tied = xedges.filter(F.col("x") >= one).select(F.explode(F.array("i", "j")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).filter("n >= 2").select("v")
    nodes, edges = _placed(xedges)
    if not nodes.take(1):
        return _named(nodes.select(F.col("pos").alias("a"), F.col("pos").alias("b"), F.col("h").alias("delta")), nodes)
    return _named(_intervals(nodes, edges, length, None, True, tied).withColumnRenamed("at", "b"), nodes).filter(F.col("delta") < below)
