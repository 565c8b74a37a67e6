"""Pools under colliding keys, and running totals of streams that stop and go on."""

from pyspark.sql import functions as F


def test_colliding_keys_keep_both(spark, monkeypatch):
    """All cliques of a size get one key: only those of the same nodes are equal."""
    from routeloom.operators import pool

    monkeypatch.setattr(pool, "clique_key", lambda m: m.select("clique_id", "node").distinct().groupBy("clique_id").agg(F.count("*").alias("key")))
    sets = {1: [1, 2], 2: [3, 4], 3: [2, 1, 1], 4: [5, 6], 5: [4, 3], 6: [1, 2, 3], 7: [9]}
    members = spark.createDataFrame([(c, v) for c, vs in sets.items() for v in vs], "clique_id long, node long")
    classes = {r["clique_id"]: r["first"] for r in pool.clique_classes(members).collect()}
    assert classes == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6, 7: 7}
    # Cuts of the same number of cliques collide too; 11 and 15 are equal, 14 holds a clique twice.
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 4), (12, 4), (12, 2), (13, 1), (13, 2), (14, 1), (14, 3), (15, 4), (15, 3), (16, 1), (16, 5)], "cut_id long, clique_id long")
    cuts = spark.createDataFrame([(k, "G", 5 if k == 13 else 4) for k in range(10, 17)], "cut_id long, sense string, rhs int")
    assert {r["cut_id"]: r["first"] for r in pool.cut_classes(cuts, links, members).collect()} == {10: 10, 11: 11, 12: 12, 13: 13, 14: 14, 15: 11, 16: 10}
    assert {r["cut_id"]: r["n_equal"] for r in pool.distinct_cuts(cuts, links, members).collect()} == {10: 2, 11: 2, 12: 1, 13: 1, 14: 1}
    kept, kept_links, kept_members = pool.pool_merge([(cuts, links, members), (cuts.filter("cut_id = 11"), links, members)])
    assert sorted(r["cut_id"]["id"] for r in kept.collect()) == [10, 11, 12, 13, 14] and kept_members.select("clique_id").distinct().count() == 3
    assert pool.distinct_cuts(cuts.limit(0), links.limit(0), members.limit(0)).count() == 0


def test_totals_go_on_after_a_stop(spark, tmp_path):
    from routeloom.streaming.results import first_changes, keep_totals, new_keys, region_values, running_totals, segment_values

    schema = "id long, rtime double, bound double, newlen long, arrival long"
    arrivals = [
        [(1, 2.0, 10.0, 90, 5), (2, 1.0, -1.0, 60, 6), (2, 1.0, 3.0, 1, 6)],
        [(1, 9.0, 99.0, 1, 7), (3, 1.0, 4.0, 50, 9), (3, 2.0, 5.0, 55, 8), (4, 1.0, None, 70, None)],
        [(1, 4.0, 20.0, 80, 4), (9, 1.0, 1.0, 10, 20)],
    ]
    (tmp_path / "s").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    segments = spark.createDataFrame([(1, 100), (2, 50), (3, 60)], "seg_id long, origlen long")
    kinds = {
        "regions": (lambda: region_values(stream), ["n_done", "n_failed", "bound", "rtime"]),
        "segments": (lambda: segment_values(stream, segments), ["n_done", "gain"]),
    }
    assert running_totals(spark, str(tmp_path / "none")) is None
    seen, wrote = [], []
    for rows in arrivals:  # each time the queries start anew from their checkpoints
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        seen += rows
        first = {}
        for r in sorted((r for r in seen if r[4] is not None), key=lambda r: (r[4], 0.0 if r[2] >= 0 else 1.0)):
            first.setdefault(r[0], r)
        for name, (values, columns) in kinds.items():
            path = str(tmp_path / name)
            keep_totals(first_changes(values(), ["id"], columns), path, path + "-checkpoint").awaitTermination()
        best = list(first.values())
        found = running_totals(spark, str(tmp_path / "regions")).first()
        assert (found["n_done"], found["n_failed"], found["bound"], found["rtime"]) == (len(best), sum(r[2] < 0 for r in best), sum(max(r[2], 0) for r in best), sum(r[1] for r in best))
        new_keys(stream.select("id"), str(tmp_path / "ids"), str(tmp_path / "ids-checkpoint"), ["id"]).awaitTermination()
        wrote.append(sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "ids")).collect()))
    assert wrote == [[1, 2], [1, 2, 3, 4], [1, 2, 3, 4, 9]]
    assert tuple(running_totals(spark, str(tmp_path / "segments")).select("n_done", "gain").first()) == (3.0, 25.0)
