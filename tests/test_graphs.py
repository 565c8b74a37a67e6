"""Neighbour searches on uneven points, tours, stitching, blossoms, cut classes and blocks against brute force."""

import random

import pytest
from pyspark.sql import functions as F


def points(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "id long, x double, y double")


def nearest(rows, k):
    out = set()
    for a, (x, y) in enumerate(rows):
        near = sorted((int(((x - u) ** 2 + (y - v) ** 2) ** 0.5 + 0.5), b) for b, (u, v) in enumerate(rows) if a != b)[:k]
        out |= {(a, b, n, r + 1) for r, (n, b) in enumerate(near)}
    return out


def test_uneven_points(spark, monkeypatch):
    """An outlier, a dense spot and many equal points: right, and with few pairs for each node."""
    from routeloom.operators import neighbors

    rng = random.Random(3)
    rows = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(500)] + [(10**6, 10**6)] + [(5, 5)] * 300 + [(rng.random(), rng.random()) for _ in range(100)]
    made = []
    monkeypatch.setattr(neighbors, "length_col", lambda norm, a, b, **p: made.append(1) or F.floor(F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)) + 0.5).cast("long"))
    found = {(r["id"], r["nbr"], r["len"], r["rank"]) for r in neighbors.knn(points(spark, rows), 3).collect()}
    assert found == nearest(rows, 3)
    with pytest.raises(ValueError):
        neighbors.knn(points(spark, rows[:3]), 3)
    with pytest.raises(ValueError):
        neighbors.knn(points(spark, rows[:9]), 2, weights=spark.createDataFrame([(k, -1.0) for k in range(9)], "id long, w double"))
    with pytest.raises(ValueError):
        neighbors.knn(points(spark, rows[:9]), 2, "RH5")


def test_levels_hold_few_points(spark):
    """4,000 even points and one far away: cells around hold under 20 candidates a node on average."""
    from routeloom.operators.neighbors import _Cells

    rows = [(k % 64, k // 64) for k in range(4000)] + [(10**7, 0)]
    nodes = points(spark, rows)
    cells = _Cells(nodes, "EUC_2D", {}, "xy")
    held = cells.levels(nodes, 2).select("lv", cells.cell("x", F.col("lv")).alias("cx"), cells.cell("y", F.col("lv")).alias("cy"))
    assert held.count() == len(rows)
    assert held.groupBy("lv", "cx", "cy").count().agg(F.max("count")).first()[0] <= 11


def test_tours_from_rounds_and_locally(spark):
    from routeloom.operators import components, construct, tours

    rng = random.Random(8)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(40)]
    nodes = points(spark, rows)
    e = spark.createDataFrame([(a, b, int(((rows[a][0] - rows[b][0]) ** 2 + (rows[a][1] - rows[b][1]) ** 2) ** 0.5 + 0.5)) for a in range(40) for b in range(a) if (a * b) % 3 == 0], "i long, j long, len long")
    trees = [sorted(map(tuple, construct.minimum_spanning_tree(e, n).collect())) for n in (50_000, 0)]
    assert trees[0] == trees[1] and len(trees[0]) == 39
    taken = [sorted(map(tuple, construct.greedy_fragments(e, local=n).collect())) for n in (50_000, 60)]
    assert taken[0] == taken[1]
    paths = construct.greedy_fragments(e)
    for rule, local in (("nearest", 2000), ("lowest", 2000), ("rounds", 2000), ("rounds", 6)):
        links = construct.link_fragments(nodes, paths, "EUC_2D", rule, local)
        whole = paths.unionByName(links)
        assert construct.is_tour(whole, 40)
    walked = sorted((r["pos"], r["node"]) for r in tours.edges_to_tour(whole).collect())
    old = tours.LOCAL_TOUR, components.LOCAL_EDGES
    tours.LOCAL_TOUR = components.LOCAL_EDGES = 0
    try:
        assert sorted((r["pos"], r["node"]) for r in tours.edges_to_tour(whole).collect()) == walked
        assert components.component_labels(whole).select("component").distinct().count() == 1
    finally:
        tours.LOCAL_TOUR, components.LOCAL_EDGES = old


def test_segments_never_get_longer(spark):
    from routeloom.operators.partition import concat_segments, improve_segments, stitch_tours
    from routeloom.operators.tours import path_length, tour_length

    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)]
    nodes = points(spark, rows)
    tour = spark.createDataFrame([(0, k, k) for k in range(60)], "tour_id long, pos long, node long")
    better = concat_segments(improve_segments(tour, nodes, "EUC_2D", 20))
    before, after = (path_length(t, nodes, "EUC_2D").first()["len"] for t in (tour, better))
    assert after < before and better.select("node").distinct().count() == 60
    kept = {r["pos"]: r["node"] for r in better.collect()}
    assert all(kept[k] == k for k in (0, 19, 20, 39, 40, 59))
    parts = tour.select((F.col("pos") % 3).alias("part_id"), F.floor(F.col("pos") / 3).alias("pos"), "node")
    whole = stitch_tours(parts, spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "rank long, part_id long"), nodes, "EUC_2D")
    assert whole.select("node").distinct().count() == 60 == whole.count() and tour_length(whole, nodes, "EUC_2D").first()["len"] > 0


@pytest.mark.parametrize("norm", ["EUC_2D", "MAN_2D", "CEIL_2D"])
def test_shorter_paths(norm):
    import numpy as np

    from routeloom.functions.norms import ARRAY_NORMS
    from routeloom.operators.improve import nearest_lists, shorter_path

    rng = np.random.default_rng(5)
    for n in (1, 3, 4, 5, 60, 300):
        x, y = (rng.integers(0, 200, n).astype(float) for _ in range(2))
        x[n // 2 :: 7] = x[0]
        if n == 300:
            x[5], y[5] = 1e6, 1e6
        d = ARRAY_NORMS[norm](x[:, None] - x[None, :], y[:, None] - y[None, :])
        for k in (4, n):
            wanted = [[b for b in np.lexsort((np.arange(n), d[a])).tolist() if b != a][:k] for a in range(n)]
            assert [[d[a, b] for b in row] for a, row in enumerate(nearest_lists(x, y, k, norm))] == [[d[a, b] for b in row] for a, row in enumerate(wanted)]
            at = shorter_path(x, y, norm, k)
            assert sorted(at.tolist()) == list(range(n)) and at[0] == 0 and at[-1] == n - 1
            assert d[at[:-1], at[1:]].sum() <= d[np.arange(n - 1), np.arange(1, n)].sum()
        left = [(i, j) for i in range(n - 1) for j in range(i + 2, n - 1) if d[at[i], at[i + 1]] + d[at[j], at[j + 1]] > d[at[i], at[j]] + d[at[i + 1], at[j + 1]]]
        assert not left  # with all nodes as neighbours no 2-opt move is left


def test_blossoms_and_classes(spark):
    from routeloom.operators.cuts import cut_slack
    from routeloom.operators.pool import classify_cuts, fast_blossoms, gh_blossoms

    # An odd cycle of halves with three edges of one at it.
    x = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5), (0, 3, 1.0), (1, 4, 1.0), (2, 5, 1.0), (3, 4, 0.5), (4, 5, 0.5), (3, 5, 0.5)], "i long, j long, x double")
    cuts, roles, members = fast_blossoms(x)
    assert {(r["cut_id"], r["rhs"]) for r in cuts.collect()} == {(0, 10), (3, 10)}
    links = roles.select("cut_id", "clique_id")
    slack = {r["cut_id"]: r["slack"] for r in cut_slack(cuts, links, members, x).collect()}
    assert all(abs(v + 1) < 1e-9 for v in slack.values())
    kinds = {r["cut_id"]: r["kind"] for r in classify_cuts(cuts, links, members, 9).collect()}
    assert kinds == {0: "comb", 3: "comb"}
    turned = members.filter("clique_id like '0:0:3'").select("clique_id")
    inverted = members.filter("clique_id != '0:0:3'").unionByName(spark.range(9).filter("id not in (0, 3)").select(F.lit("0:0:3").alias("clique_id"), F.col("id").alias("node")))
    assert turned.count() == 2 and {r["kind"] for r in classify_cuts(cuts.filter("cut_id = 0"), links, inverted, 9).collect()} == {"comb"}
    worse = cuts.withColumn("rhs", F.col("rhs") + 1)
    assert {r["kind"] for r in classify_cuts(worse, links, members, 9).collect()} == {"other"}
    assert gh_blossoms(x).__len__() == 3 and gh_blossoms(x)[0].count() == 2
    # A node inside that two teeth share leaves the handle; its teeth go.
    shared = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 6, 0.5), (6, 0, 0.5), (0, 3, 1.0), (0, 7, 1.0), (1, 4, 1.0)], "i long, j long, x double")
    cuts, roles, members = fast_blossoms(shared)
    assert sorted(r["node"] for r in members.filter("clique_id like '%:h'").collect()) == [1, 2, 6] and roles.filter("not handle").count() == 1


def test_blocks(spark):
    from routeloom.operators.pool import blocks

    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(16)})
    x = spark.createDataFrame([(i, j, 0.5) for i, j in edges], "i long, j long, x double")

    def parts(without):
        seen, n = set(), 0
        for s in {v for e in edges for v in e} - {without}:
            if s not in seen:
                n, todo = n + 1, [s]
                while todo:
                    v = todo.pop()
                    if v not in seen:
                        seen.add(v)
                        todo += [b if a == v else a for a, b in edges if v in (a, b) and without not in (a, b)]
        return n

    found, cut = blocks(x)
    whole = parts(None)
    assert {r["node"] for r in cut.collect()} == {v for e in edges for v in e if parts(v) > whole}
    rows = [(r["component"], r["block"], r["i"], r["j"]) for r in found.collect()]
    assert sorted((i, j) for _, _, i, j in rows) == edges
    nodes = {}
    for c, b, i, j in rows:
        nodes.setdefault((c, b), set()).update((i, j))
    held = list(nodes.values())
    assert all(len(a & b) <= 1 for k, a in enumerate(held) for b in held[:k])


def test_plans(spark):
    from routeloom.operators.candidates import candidate_edges, parse_plan

    plan = parse_plan("# all\nEDGEGEN NEAREST 2\n\nEDGEGEN TREE\nEDGEGEN RANDOM 5\nEDGEGEN BORUVKA_TOUR\nEDGEGEN SPACE_FILLING_TOUR\n")
    assert plan == {"NEAREST": 2, "TREE": 1, "RANDOM": 5, "BORUVKA_TOUR": 1, "SPACE_FILLING_TOUR": 1}
    rng = random.Random(2)
    found = candidate_edges(points(spark, [(rng.randrange(99), rng.randrange(99)) for _ in range(20)]), plan)
    assert found.filter("i >= j").count() == 0 and found.select("i", "j").distinct().count() == found.count() >= 30
    for bad in ("EDGEGEN DELAUNAY", "NEAREST 3", "EDGEGEN LINKERN 1 2"):
        with pytest.raises(ValueError):
            parse_plan(bad)
