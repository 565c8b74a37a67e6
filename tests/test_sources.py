"""Text sources, streams and small helpers."""

import pytest
from pyspark.sql import functions as F


def test_text_files(spark, tmp_path):
    from routeloom.operators.edges import adjacency, canonical_edges, edge_union, from_adjacency, relabel
    from routeloom.sources.text import read_edges, read_points2d, read_tour, read_tsplib, read_xvector, write_edges

    (tmp_path / "p").write_text("3\n0 0\n3.5 4\n-1 2\n")
    assert [tuple(r) for r in read_points2d(spark, str(tmp_path / "p")).orderBy("id").collect()] == [(0, 0.0, 0.0), (1, 3.5, 4.0), (2, -1.0, 2.0)]
    (tmp_path / "bad").write_text("4\n0 0\n")
    with pytest.raises(ValueError):
        read_points2d(spark, str(tmp_path / "bad"))
    (tmp_path / "e").write_text("3 3\n0 1 5\n2 1 7\n1 0 6\n")
    e = read_edges(spark, str(tmp_path / "e"))
    assert canonical_edges(e).count() == 2
    assert {tuple(r) for r in edge_union([e.filter("len = 5"), e.filter("len > 5")]).collect()} == {(0, 1, 6), (1, 2, 7)}
    once = e.filter("len != 6")
    assert from_adjacency(adjacency(once)).count() == 2
    perm = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "old long, new long")
    assert {tuple(r) for r in relabel(once, perm, ["i", "j"]).select("i", "j", "len").collect()} == {(2, 1, 5), (0, 1, 7)}
    write_edges(once, 3, str(tmp_path / "out"))
    assert read_edges(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "x").write_text("2 1\n0 1 0.5\n")
    assert read_xvector(spark, str(tmp_path / "x")).first()["x"] == 0.5
    (tmp_path / "t").write_text("4\n2 0\n1 3\n")
    assert [r["node"] for r in read_tour(spark, str(tmp_path / "t")).orderBy("pos").collect()] == [2, 0, 1, 3]
    (tmp_path / "i").write_text("NAME: a\nTYPE : TSP\nDIMENSION: 2\nEDGE_WEIGHT_TYPE : CEIL_2D\nNODE_COORD_SECTION\n7 1 2\n9 3 4\nEOF\n")
    nodes, norm = read_tsplib(spark, str(tmp_path / "i"))
    assert norm == "CEIL_2D" and [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_norms(spark):
    from routeloom.functions.norms import length_col, register_norm

    row = spark.createDataFrame([((10.3, 20.0, 1.0), (10.3, 20.0, 1.0), (50.30, -3.45, 9.0))], "a struct<x:double,y:double,z:double>, s struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    one = lambda norm, p, q: row.select(length_col(norm, F.col(p), F.col(q)).alias("n")).first()["n"]
    assert one("GEO", "a", "s") == 1 and one("GEOM", "a", "s") == 1 and one("EUC_3D", "a", "b") == 47 and one("CRYSTAL", "a", "b") == 40
    assert 4_900_000 < one("GEOM", "a", "b") < 5_200_000
    register_norm("ZERO", lambda a, b: F.lit(0).cast("long"))
    assert one("ZERO", "a", "b") == 0
    with pytest.raises(ValueError):
        one("NONE", "a", "b")


def test_tours_and_components(spark):
    from routeloom.operators.components import component_labels
    from routeloom.operators.construct import component_cuts, is_tour
    from routeloom.operators.tours import check_tour

    path = [(k, k + 1, 1.0) for k in range(50)] + [(100, 101, 1.0), (7, 7, 1.0)]
    e = spark.createDataFrame(path, "i long, j long, x double")
    found = {r["node"]: r["component"] for r in component_labels(e).collect()}
    assert len(found) == 53 and {found[k] for k in range(51)} == {0} and found[101] == 100
    assert {r["node"] for r in component_cuts(e).collect()} == set(range(51))
    ring = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "i long, j long")
    two = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], "i long, j long")
    assert is_tour(ring, 6) and not is_tour(two, 6)
    t = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 9)], "tour_id long, pos long, node long")
    n = spark.createDataFrame([(1,), (2,)], "id long")
    assert {(r["node"], r["problem"]) for r in check_tour(t, n).collect()} == {(1, "repeated"), (2, "missing"), (9, "unknown")}


def test_streams(spark, tmp_path):
    from routeloom.streaming.results import append_first, incumbent, region_totals, remaining, run_to_table, segment_gains, stored

    rows = spark.createDataFrame([(1, 2.0, 10.0, 5), (2, 1.0, -1.0, 6), (1, 9.0, 99.0, 7), (3, 1.0, 4.0, 9), (3, 2.0, 5.0, 8)], "id long, rtime double, bound double, arrival long")
    # The latest arrivals come in the first files.
    for low, high in ((8, 9), (7, 7), (5, 6)):
        rows.filter(f"arrival between {low} and {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    for _ in range(2):  # what has been read isn't read again
        append_first(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["id"]).awaitTermination()
    first = stored(spark, str(tmp_path / "t"), rows.schema, ["id"])
    assert {r["id"]: (r["bound"], r["arrival"]) for r in first.collect()} == {1: (10.0, 5), 2: (-1.0, 6), 3: (5.0, 8)}
    assert tuple(region_totals(first).first()) == (3, 1, 15.0, 5.0)
    assert [r["part_id"] for r in remaining(first, spark.createDataFrame([(2,), (4,)], "part_id long")).collect()] == [4]
    segments = spark.createDataFrame([(1, 100), (2, 50)], "seg_id long, origlen long")
    new = spark.createDataFrame([(1, 90), (2, 60)], "id long, newlen long")
    assert tuple(segment_gains(new, segments, 1000).first()) == (2, 10, 990)
    assert tuple(incumbent(spark.createDataFrame([(1, 9), (2, 7), (3, 7)], "arrival long, len long")).first()) == (7, 2)
    best = run_to_table(incumbent(stream.select("arrival", (10 * (10 - stream.arrival)).alias("len"))), "best_of_test")
    assert tuple(best.first()) == (10, 9)


def test_more_files(spark, tmp_path):
    from routeloom.sources.text import read_cuts, read_rhvectors, read_tour_edges, read_tour_tsplib, write_cuts, write_tour, write_tsplib

    (tmp_path / "t").write_text("NAME: a\nTYPE : TOUR\nDIMENSION : 4\nTOUR_SECTION\n3 1\n4\n2\n-1\nEOF\n")
    assert [r["node"] for r in read_tour_tsplib(spark, str(tmp_path / "t"), 4).orderBy("pos").collect()] == [2, 0, 3, 1]
    with pytest.raises(ValueError):
        read_tour_tsplib(spark, str(tmp_path / "t"), 5)
    (tmp_path / "e").write_text("4 4\n0 2 1\n2 1 1\n1 3 1\n3 0 1\n")
    assert [r["node"] for r in read_tour_edges(spark, str(tmp_path / "e")).orderBy("pos").collect()] == [0, 2, 1, 3]
    (tmp_path / "bad").write_text("6 6\n0 1 1\n1 2 1\n2 0 1\n3 4 1\n4 5 1\n5 3 1\n")
    with pytest.raises(ValueError):
        read_tour_edges(spark, str(tmp_path / "bad"))
    (tmp_path / "v").write_text("2 4 0 10 4 6 1\n0 a 0120\n1 b 2211\n")
    vectors, params = read_rhvectors(spark, str(tmp_path / "v"))
    assert {r["id"]: r["vec"] for r in vectors.collect()} == {0: None, 1: [0, 1, 2, 0], 2: [2, 2, 1, 1]} and params["p1"] == 0.6 and params["d12"] == 6
    folder = tmp_path / "cuts"
    folder.mkdir()
    (folder / "a").write_text("2 2 0 3\n1 5 4\n1 3\n7 8 9 2")
    (folder / "b").write_text("1\n1 6\n2\n")
    cuts, links, members = read_cuts(spark, str(folder))
    assert [tuple(r) for r in cuts.orderBy("cut_id").collect()] == [(0, "G", 4), (1, "G", 2), (2, "G", 2)]
    assert sorted((r["clique_id"], r["node"]) for r in members.collect()) == [(0, 0), (0, 3), (1, 5), (2, 7), (2, 8), (2, 9), (3, 6)]
    tour = spark.createDataFrame([(0, k, 9 - k) for k in range(10)], "tour_id long, pos long, node long")
    write_cuts(cuts.withColumn("branch", (F.col("cut_id") == 1).cast("int")), links, members, str(tmp_path / "w"), tour)
    again = read_cuts(spark, str(tmp_path / "w"), tour)
    assert again[0].count() == 2 and sorted(r["node"] for r in again[2].collect()) == [0, 3, 5, 6]
    with pytest.raises(ValueError):
        write_tsplib(tour, "CRYSTAL", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        write_tour(tour, str(tmp_path / "y"), "other")


def test_long_cut_files(spark, tmp_path):
    """A file that many tasks read is the same table as when one task reads it, whatever its lines are."""
    import random

    from routeloom.sources.text import read_cuts

    rng = random.Random(7)
    folder = tmp_path / "cuts"
    folder.mkdir()
    for name in "ab":
        tokens = []
        for _ in range(40):
            cliques = [[rng.randrange(1, 6) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 6))]  # small numbers look like sizes
            tokens += [len(cliques), *[x for c in cliques for x in (len(c), *c)], 2 * len(cliques)]
        text = "".join(str(x) + rng.choice([" ", " ", "\n", "\n\n", "\t"]) for x in tokens)
        (folder / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    try:
        found = [[sorted(map(tuple, t.collect())) for t in read_cuts(spark, str(folder), None, size)] for size in (1 << 24, 0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len(found[0][0]) == 80
    (tmp_path / "torn").write_text("1 2 3 4 2\n2 1 5\n3 1")
    for size in (1 << 24, 0):
        with pytest.raises(Exception, match="isn't complete"):
            read_cuts(spark, str(tmp_path / "torn"), None, size)[0].collect()


def test_off_one_machine_a_shared_folder_has_to_be_named():
    from types import SimpleNamespace

    from routeloom.jobs.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(fake)
