"""What lets queries grow with their tables: no broadcasts by file size, bounded tasks, SQL of the same rule at any ids."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from routeloom.jobs import registry
from routeloom.jobs.queries import oracle_sql, queries


def test_segment_cuts_sql_with_gaps_between_ids(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT r * 500 + k AS c_custkey, CAST(k % 7 AS INT) AS c_nationkey FROM range(2) t(r), range(40) s(k)")
    c.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    for name in ("all_segment_cuts", "segment_cuts"):
        df, found = queries()[name](spark, str(tmp_path)), c.sql(oracle_sql()[name])
        assert sorted(map(tuple, df.select("a", "b", "delta").collect())) == sorted(found.select("a", "b", "delta").fetchall())


def test_no_broadcasts_by_size(spark):
    seen = []

    def joined(spark, d):
        seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        return spark.range(3).join(spark.range(2), "id")

    found = registry.shuffled(joined)(spark, "")
    assert seen == ["-1"] and found.inputFiles() and sorted(r["id"] for r in found.collect()) == [0, 1]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_nearest_on_a_sphere_looks_only_around(spark):
    from routeloom.functions.norms import length_col
    from routeloom.operators import neighbors

    rows = [(k, float(k % 3), round(k * 0.9 - 179.5, 2)) for k in range(400)] + [(400, 89.9, 10.0), (401, 89.9, -170.0), (402, -89.5, 0.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    point = lambda s: nodes.select(*[F.col(c).alias(f"{s}{c}") for c in nodes.columns])
    for norm in ("GEO", "GEOM"):
        cells = neighbors._Cells(nodes, norm, {}, "xy")
        placed = cells.placed(nodes).select(*[cells.cell(c, F.lit(4)).alias(c) for c in cells.dims])
        assert placed.groupBy(*placed.columns).count().agg(F.max("count")).first()[0] < 20  # a band of latitudes has 134
        pairs = point("a").join(point("b"), F.col("aid") != F.col("bid"))
        of = lambda s: F.struct(*[F.col(f"{s}{c}").alias(c) for c in "xy"])
        every = pairs.select("aid", "bid", length_col(norm, of("a"), of("b")).alias("len")).collect()
        want = {}
        for a, b, d in sorted(every, key=lambda r: (r[0], r[2], r[1])):
            want.setdefault(a, []).append((b, d))
        found = {}
        for r in sorted(neighbors.knn(nodes, 3, norm).collect(), key=lambda r: (r["id"], r["rank"])):
            found.setdefault(r["id"], []).append((r["nbr"], r["len"]))
        assert found == {a: v[:3] for a, v in want.items()}


def test_vector_neighbours_of_any_number(spark):
    from routeloom.functions.norms import length_col
    from routeloom.operators import neighbors

    rows = [(k * 3 % 71, [(k * (j + 3) + j * j) % 5 % 3 for j in range(k % 4 + 5)]) for k in range(60)] + [(500, [2, 2, 2])]
    points = spark.createDataFrame(rows, "id long, vec array<int>")
    pairs = points.select(F.col("id").alias("a"), F.struct("vec").alias("p")).join(points.select(F.col("id").alias("b"), F.struct("vec").alias("q")), F.col("a") != F.col("b"))
    every = sorted((r["a"], r["len"], r["b"]) for r in pairs.select("a", "b", length_col("RH5", F.col("p"), F.col("q")).alias("len")).collect())
    want = {a: [(b, d) for x, d, b in every if x == a][:3] for a, _ in rows}
    found = sorted((r["id"], r["rank"], r["nbr"], r["len"]) for r in neighbors.knn_all_pairs(points, 3, "RH5", most=10).collect())
    assert found == [(a, k + 1, *want[a][k]) for a in sorted(want) for k in range(3)]


def test_complete_graph_deals_only_given_edges(spark):
    from routeloom.operators.edges import complete_graph

    given = spark.createDataFrame([(3, 1, 9), (1, 3, 7), (0, 4, 5), (2, 2, 1), (0, 1, 3)], "i long, j long, len long")
    found = complete_graph(given, 5, 40)
    lens = {(1, 3): 7, (0, 4): 5, (0, 1): 3}
    assert sorted(map(tuple, found.select("i", "j", "len").collect())) == [(i, j, lens.get((i, j), 40)) for i in range(5) for j in range(i + 1, 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan[: plan.index("Join")]  # pairs are made after the join


def test_segments_that_span_batches():
    from routeloom.operators.partition import _shorter

    rows = pd.DataFrame([(t, s, 20 * s + p, 1000 * t + 20 * s + p, float(p * 37 % 11), float(p * 23 % 13)) for t in range(3) for s in range(2) for p in range(20)], columns=["tour_id", "seg_id", "pos", "node", "x", "y"])
    run = lambda sizes: pd.concat(_shorter("EUC_2D", 5)(iter(sizes)))
    whole = run([g for _, g in rows.groupby(["tour_id", "seg_id"])])
    for n in (1, 7, 20, 33, 120):
        parts = run([rows.iloc[k : k + n] for k in range(0, len(rows), n)])
        assert parts.reset_index(drop=True).equals(whole.reset_index(drop=True)) and set(parts["node"]) == set(rows["node"])


def test_radius_meets_each_pair_once(spark):
    from routeloom.functions.norms import length_col
    from routeloom.operators.neighbors import fixed_radius

    result = queries()["fixed_radius_customer"](spark, "/root/testdata/sf0.001")
    assert [f.rsplit("/", 1)[-1] for f in result.inputFiles()] == ["customer.parquet"]  # pairs aren't written before they are read
    nodes = spark.range(101).selectExpr("id * 7 % 101 AS id", *[f"double(id * {k} % 60 - 30) AS {c}" for c, k in (("x", 37), ("y", 53), ("z", 29))])
    weights = nodes.select("id", (F.col("id") % 3).cast("double").alias("w"))
    for norm, w in (("EUC_2D", weights), ("ATT", None), ("EUC_3D", None)):
        # No join goes by the session's settings for broadcasts.
        found = fixed_radius(nodes, 12, norm, w)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        point = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("x", "y", "z")])
        held = nodes.withColumn("w", F.lit(0.0)) if w is None else nodes.join(w, "id")
        pairs = held.alias("a").join(held.alias("b"), F.col("a.id") < F.col("b.id"))
        length = length_col(norm, point("a"), point("b"))
        every = pairs.select("a.id", "b.id", (length if w is None else length + F.col("a.w") + F.col("b.w")).alias("len")).filter("len < 12")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    from routeloom.jobs import session

    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(parts, None)
    (tmp_path / "a.parquet").write_bytes(b"x" * 1000)
    seen = []
    for size in (session._PART_BYTES, 100):
        monkeypatch.setattr(session, "_PART_BYTES", size)
        registry.shuffled(lambda s, d: (seen.append(s.conf.get(parts)), s.range(1))[1])(spark, str(tmp_path))
    assert seen == [spark.conf.get("spark.sql.shuffle.partitions"), "10"] and spark.conf.get(parts, None) == before


def test_fragments_go_on_from_the_round_before(spark, monkeypatch):
    from routeloom.operators import construct

    rows = sorted({(a, b, (a * 31 + b * 17) % 97) for a in range(60) for b in ((a * 7 + 3) % 60, (a * 11 + 5) % 60, (a + 1) % 60) if a < b})
    edges, labelled, label = spark.createDataFrame(rows, "i long, j long, len long"), [], construct.component_labels

    def counted(e, *ends):
        labelled.append(e.count())
        return label(e, *ends)

    want = {tuple(r) for r in construct.greedy_fragments(edges, local=10_000).collect()}
    taken = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "i long, j long, len long")
    more = {tuple(r) for r in construct.greedy_fragments(edges, taken=taken, local=10_000).collect()}
    monkeypatch.setattr(construct, "component_labels", counted)
    assert {tuple(r) for r in construct.greedy_fragments(edges, local=0).collect()} == want
    assert len(labelled) > 2 and sum(labelled) == len(want)  # each taken edge is labelled once
    assert {tuple(r) for r in construct.greedy_fragments(edges, taken=taken, local=0).collect()} == more


def test_a_scan_takes_little_of_a_file(spark, tmp_path):
    from routeloom.jobs import session

    path = str(tmp_path / "long.parquet")
    spark.range(0, 1_600_000, 1, 1).select(F.xxhash64("id").alias("h"), F.xxhash64("id", "id").alias("g")).write.option("parquet.block.size", 1 << 20).parquet(path)
    keys = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        with session.small_tasks(spark):
            counts = spark.read.parquet(path).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    # The file has 26 MB; what a scan's task reads and aggregates is 8 MB of it.
    assert sum(r["n"] for r in counts) == 1_600_000 and len(counts) > 2 and max(r["n"] for r in counts) < 650_000


def test_segment_cuts_of_any_length(spark, tmp_path, monkeypatch):
    from routeloom.operators import segments

    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT k AS c_custkey, CAST(0 AS INT) AS c_nationkey FROM range(40) t(k)")
    c.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    # A path of weights of 0.25 to 1: an interval of any length is left by the two edges at its ends.
    for ends, left, groups, rows in ((1 << 17, 1 << 10, 64, 1 << 16), (8, 4, 5, 16)):
        for name, value in (("BLOCK", 4), ("_ENDS", ends), ("_LEFT", left), ("_GROUPS", groups), ("_ROWS", rows)):
            monkeypatch.setattr(segments, name, value)
        result = queries()["all_segment_cuts"](spark, str(tmp_path))
        found = sorted(map(tuple, result.select("a", "b", "delta").collect()))
        w = lambda k: (1 + k % 4) / 4 if 0 <= k < 40 else 0.0
        assert found == [(a, b, w(a - 1) + w(b)) for a in range(41) for b in range(a + 1, 41) if w(a - 1) + w(b) <= 1.5]
        assert max(b - a for a, b, _ in found) > 8
    # The intervals are made where they are read: only what is dealt to their tasks is shuffled, and nothing after it.
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and not any("/result-" in f for f in result.inputFiles())
    best = {r["a"]: (r["b"], r["delta"]) for r in queries()["segment_cuts"](spark, str(tmp_path)).collect()}
    assert best[0] == (40, 0.0) and max(b - a for a, (b, _) in best.items()) > 8


def test_counters_reach_the_driver_as_columns(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from routeloom.llm import near_dedup

    # Texts of ten shingles each: those of a pair share nine, and no others share any.
    sets = [(k, 0, np.unique(np.arange(10, dtype=np.uint64) + np.uint64(1000 * (k // 2) + k % 2)).tobytes()) for k in range(200)]
    known = spark.createDataFrame(sets, "rid long, fp long, shingles binary")
    shards = known.select(F.lit(0).cast("long").alias("part"), "rid", F.col("rid").alias("component"), F.lit(80).cast("long").alias("size"))
    rows, collect = [], DataFrame.collect

    def counted(self):
        rows.append(len(found := collect(self)))
        return found

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", counted)
        found = near_dedup._parts(shards, known, 0.8)
    assert sorted((r["part"], r["rid"]) for r in found.collect()) == [(k - k % 2, k) for k in range(200)]
    assert max(rows, default=0) <= 1  # 900 counters are met twice


def test_complete_graph_takes_little_space(spark, tmp_path, monkeypatch):
    from routeloom.operators import edges

    n = 3000
    given = spark.createDataFrame([(k, (k * 17 + 5) % n, k % 50 + 1) for k in range(n)] + [(7, k, k) for k in range(900, 2100)], "i long, j long, len long")
    edges.complete_graph(given, n, 77).write.parquet(path := str(tmp_path / "pairs"))
    rows = n * (n - 1) // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < rows / 2  # less than half a byte a pair
    found = spark.read.parquet(path)
    assert found.count() == rows == found.filter("i < j and i >= 0 and j < 3000").select("i", "j").distinct().count()
    want = {}
    for i, j, m in given.collect():
        if i != j:
            want[min(i, j), max(i, j)] = min(m, want.get((min(i, j), max(i, j)), m))
    assert {(r["i"], r["j"]): r["len"] for r in found.filter("len <> 77").collect()} == {e: m for e, m in want.items() if m != 77}
    # Cells, rows and strides that the pairs don't fill.
    for name, value in (("_HIGH", 6), ("_WIDE", 8), ("_ROWS", 2), ("_STRIDE", 4)):
        monkeypatch.setattr(edges, name, value)
    few = spark.createDataFrame([(3, 1, 9), (1, 3, 7), (0, 20, 5), (2, 2, 1), (0, 1, 3), (13, 14, 2), (-1, 3, 1), (4, 21, 1)], "i long, j long, len long")
    lens = {(1, 3): 7, (0, 20): 5, (0, 1): 3, (13, 14): 2}
    for n in (0, 1, 2, 21):
        assert sorted(map(tuple, edges.complete_graph(few, n, 40).collect())) == [(i, j, lens.get((i, j), 40)) for i in range(n) for j in range(i + 1, n)]
