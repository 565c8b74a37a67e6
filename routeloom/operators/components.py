"""Connected components by alternating large-star and small-star steps.

Every step joins edges with a per-node minimum, which is aggregated map-side, so a node with a
third of all edges costs no more than any other; no neighbour list is ever gathered. The number
of rounds grows with the logarithm of the longest path, not with its length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..jobs.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


#: Edges that one task labels at once; more take rounds of joins.
LOCAL_EDGES = 50_000


def _label_rows(rows: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(rows["u"].tolist(), rows["v"].tolist()):
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(parent), "component": [root(x) for x in list(parent)]})


def component_labels(edges: DataFrame, a: str = "i", b: str = "j", local: int | None = None) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node that has an edge to another one.

    Nulls and loops are ignored. Up to ``local`` (else ``LOCAL_EDGES``) edges between integers are labelled in one task.
    """
    local = LOCAL_EDGES if local is None else local
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and {a} != {b}").distinct()
    now = materialize(start, "edges")
    state = _state(now)
    if state[0] <= local and isinstance(now.schema["u"].dataType, T.LongType):
        return now.groupBy(F.lit("all")).applyInPandas(_label_rows, "node long, component long")
    while True:
        now = materialize(_small_star(materialize(_large_star(now), "large-star")), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(nodes: DataFrame, edges: DataFrame, x_eps: float = 1e-10) -> DataFrame:
    """node, component, size for every node (``nodes``: id), the isolated ones too; with an ``x`` only edges above ``x_eps`` count."""
    if "x" in edges.columns:
        edges = edges.filter(F.col("x") > x_eps)
    labels = nodes.select(F.col("id").alias("node")).distinct().join(component_labels(edges), "node", "left")
    labels = materialize(labels.select("node", F.coalesce("component", "node").alias("component")), "components")
    return labels.join(labels.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")
