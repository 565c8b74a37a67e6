"""Partitions, borders, pools, generators and single norms on small made tables."""

import pytest
from pyspark.sql import functions as F


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_karp_regions(spark):
    from routeloom.operators.partition import border_points, check_partition, closest_border_pairs, karp_partition, overlapping_regions, region_adjacency

    nodes = points(spark, [(k, float(k * 37 % 101), float(k * 53 % 97)) for k in range(90)])
    parts, regions = karp_partition(nodes, 12)
    rows = regions.collect()
    assert sum(r["cnt"] for r in rows) == 90 and max(r["cnt"] for r in rows) <= 12 and len(rows) == 8
    assert check_partition(nodes, parts, regions).count() == 0 and overlapping_regions(regions).count() == 0
    want = set()
    for s in rows:
        for t in rows:
            meets = lambda c: s[c + "0"] <= t[c + "1"] and t[c + "0"] <= s[c + "1"]  # noqa: B023, E731
            if s["part_id"] < t["part_id"] and ((s["x0"] == t["x1"] or s["x1"] == t["x0"]) and meets("y") or (s["y0"] == t["y1"] or s["y1"] == t["y0"]) and meets("x")):
                want.add((s["part_id"], t["part_id"]))
    pairs = region_adjacency(regions)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    closest = closest_border_pairs(border_points(parts, regions, pairs, 100), "EUC_2D")
    assert 0 < closest.count() <= len(want)
    crossed = spark.createDataFrame([(0, 0.0, 4.0, 0.0, 4.0), (1, 3.0, 9.0, 3.0, 9.0), (2, 9.0, 12.0, 0.0, 9.0)], "part_id long, x0 double, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in overlapping_regions(crossed).collect()] == [(0, 1)]
    bad = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (9, 0)], "id long, part_id long")
    lost = {(r["id"], r["problem"]) for r in check_partition(points(spark, [(0, 3.5, 3.5), (1, 0.0, 0.0), (2, 0.0, 0.0)]), bad, crossed).collect()}
    assert lost == {(0, "repeated"), (1, "outside"), (2, "missing")}
    with pytest.raises(ValueError):
        karp_partition(nodes, 60)


def test_partition_of_equal_points(spark):
    from routeloom.operators.partition import karp_partition

    parts, regions = karp_partition(points(spark, [(k, 1.0, 1.0) for k in range(9)]), 3)
    assert sorted(r["cnt"] for r in regions.collect()) == [2, 2, 2, 3] and parts.select("id").distinct().count() == 9


def test_segments_join_again(spark):
    from routeloom.operators.partition import concat_segments, depot_subproblems
    from routeloom.operators.tours import tour_segments

    tour = spark.createDataFrame([(0, k, k * 7 % 40) for k in range(40)], "tour_id long, pos long, node long")
    cut = tour_segments(tour, 9)
    assert {tuple(r) for r in concat_segments(cut.withColumn("pos", F.col("pos") + 5)).collect()} == {tuple(r) for r in tour.collect()}
    parts = tour.select(F.col("node").alias("id"), (F.col("node") % 2).alias("part_id"))
    found = depot_subproblems(parts, tour, parts.select("id", F.lit(3).alias("cost")))
    assert found.count() == 40 and {r["depots"] for r in found.collect()} == {20}


def test_pools(spark):
    from routeloom.operators.pool import cut_atoms, pool_merge, pure_combs, teeth_disjoint

    cuts = spark.createDataFrame([(1, "G", 2), (2, "G", 2)], "cut_id long, sense string, rhs int")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 11)], "cut_id long, clique_id long")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 5), (12, 2), (12, 1)], "clique_id long, node long")
    kept, kept_links, kept_members = pool_merge([(cuts, links, members), (cuts.filter("cut_id = 2"), links, members)])
    assert kept.count() == 1 and kept_links.count() == 2 and kept_members.count() == 3
    atoms = {(r["node"], r["size"], r["n_cliques"]) for r in cut_atoms(links.filter("cut_id = 1"), members, 7).collect()}
    assert atoms == {(1, 2, 1), (5, 1, 1), (0, 4, 0)}
    full = spark.createDataFrame([(10, 0), (10, 1)], "clique_id long, node long")
    assert cut_atoms(links.filter("clique_id = 10"), full, 2).count() == 1
    roles = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, True), (2, 4, False)], "cut_id long, clique_id long, handle boolean")
    nodes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 7), (3, 1), (3, 8), (4, 0), (4, 1)], "clique_id long, node long")
    assert [r["cut_id"] for r in pure_combs(roles, nodes).collect()] == [1]
    assert teeth_disjoint(roles, nodes).count() == 0


def test_ranks_do_not_depend_on_ranges(spark):
    from routeloom.operators.ranking import ranked

    rows = spark.createDataFrame([(k * 31 % 500, k % 3) for k in range(500)], "v long, g long")
    want = {}
    for v, g in sorted(map(tuple, rows.collect())):
        want[v] = sum(1 for w in want.values() if w[0] == g), g
        want[v] = (g, want[v][0])
    got = {r["v"]: (r["g"], r["rank"]) for r in ranked(rows.repartition(7), ["v"], ["g"]).collect()}
    assert got == want and ranked(rows.limit(0), ["v"]).count() == 0


def test_generators(spark):
    from routeloom.operators.tours import check_tour
    from routeloom.sources.generate import random_edges, random_geo, random_matrix, random_points, random_tour, random_weights

    assert random_points(spark, 50, 10, 1, dups=False).select("x", "y").distinct().count() == 50
    assert random_points(spark, 50, 10, 1, dims="xyz").filter("x between 0 and 9 and z between 0 and 9").count() == 50
    assert random_geo(spark, 40, 2).filter("x >= -90 and x < 90 and y >= -180 and y < 180").count() == 40
    assert random_matrix(spark, 9, 3).filter("i < j and len between 0 and 89").count() == 36
    for m in (5, 40):
        assert random_edges(spark, 10, m, 100, 4).select("i", "j").distinct().filter("i < j").count() == m
    with pytest.raises(ValueError):
        random_edges(spark, 3, 4, 9, 1)
    assert random_weights(spark, 9, 5, 1).filter("w between 0 and 4").count() == 9
    assert check_tour(random_tour(spark, 30, 5), spark.range(30)).count() == 0
    again = [sorted(map(tuple, random_points(spark.newSession(), 20, 99, 7).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_sparse_graphs_and_depots(spark):
    from routeloom.functions.norms import length_col, weighted, with_depots
    from routeloom.operators.edges import complete_graph, contract_ones, default_length

    e = spark.createDataFrame([(0, 1, 4), (1, 2, 9)], "i long, j long, len long")
    assert default_length(e, 4) == 40 and default_length(e.withColumn("len", F.lit(10**8)), 4) == (2**31 - 1) // 256
    assert sorted(tuple(r) for r in complete_graph(e, 4).collect()) == [(0, 1, 4), (0, 2, 40), (0, 3, 40), (1, 2, 9), (1, 3, 40), (2, 3, 40)]
    x = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (0, 2, 0.25), (3, 1, 1.0)], "i long, j long, x double")
    members, less = contract_ones(x)
    assert members.count() == 3 and [tuple(r) for r in less.collect()] == [(0, 2, 0.75)]
    v = spark.createDataFrame([(([1, 0, 2],), (None,), (None,))], "a struct<vec:array<int>>, b struct<vec:array<int>>, c struct<vec:array<int>>")
    got = v.select(*[length_col(n, F.col("a"), F.col("b"), p1=0.25) for n in ("RH2", "RH3", "RH4")], length_col("RH3", F.col("b"), F.col("c"), p1=0.25), weighted(F.lit(3), F.lit(1), F.lit(2))).first()
    assert tuple(got) == (0, 3, 3, 0, 6)
    d = spark.range(1).select(*[with_depots(F.lit(8), F.lit(i), F.lit(j), F.lit(2), F.lit(5), 10) for i, j in ((1, 2), (1, 10), (11, 2), (10, 11))]).first()
    assert tuple(d) == (8, 2, 5, 0)
