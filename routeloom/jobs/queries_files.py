"""Queries of sources, writers, generators and norms: files are round trips of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norms
from ..functions.norms import length_col
from ..operators import tours
from ..operators.ranking import ranked
from ..sources import generate, text
from .fixtures import fixture, sql
from .registry import euc, query
from .session import load_table, save_table, shared_path


def _path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"file-{name}")


@query("file_points2d", f"{sql('suppliers')} SELECT * FROM suppliers")
def file_points2d(spark, d):
    text.write_points(fixture(spark, d, "suppliers"), path := _path(spark, "points2d"))
    return text.read_points2d(spark, path)


@query("file_points3d", f"{sql('space')} SELECT * FROM space")
def file_points3d(spark, d):
    text.write_points(fixture(spark, d, "space"), path := _path(spark, "points3d"))
    return text.read_points3d(spark, path)


@query("file_edges", f"{sql('xedges')} SELECT i, j, len FROM xedges")
def file_edges(spark, d):
    text.write_edges(fixture(spark, d, "xedges"), 1, path := _path(spark, "edges"))
    return text.read_edges(spark, path)


@query("file_xvector", f"{sql('xedges')} SELECT i, j, x FROM xedges")
def file_xvector(spark, d):
    text.write_edges(fixture(spark, d, "xedges"), 1, path := _path(spark, "xvector"), "x")
    return text.read_xvector(spark, path)


_TOUR = f"{sql('suppliers')}, t AS (SELECT CAST(0 AS BIGINT) AS tour_id, row_number() OVER (ORDER BY x, id) - 1 AS pos, id AS node FROM suppliers)"


def one_tour(spark: SparkSession, d: str, by: str = "x") -> DataFrame:
    """The suppliers in the order of a coordinate."""
    rows = ranked(fixture(spark, d, "suppliers"), [by, "id"], name="pos")
    return rows.select(F.lit(0).cast("long").alias("tour_id"), "pos", F.col("id").alias("node"))


@query("file_tour_nodes", f"{_TOUR} SELECT * FROM t")
def file_tour_nodes(spark, d):
    text.write_tour(one_tour(spark, d), path := _path(spark, "tour"))
    return text.read_tour(spark, path)


@query("file_tour_tsplib", f"{_TOUR} SELECT * FROM t")
def file_tour_tsplib(spark, d):
    text.write_tour(one_tour(spark, d), path := _path(spark, "tour"), "tsplib")
    return text.read_tour_tsplib(spark, path, load_table(spark, d, "supplier").count())


@query("file_tour_edges", f"{_TOUR}, n AS (SELECT count(*) AS n FROM t), z AS (SELECT arg_min(pos, node) AS p0 FROM t), f AS (SELECT (pos - p0 + n) % n AS fwd, node, n FROM t, n, z), g AS (SELECT max(node) FILTER (WHERE fwd = 1) < max(node) FILTER (WHERE fwd = n - 1) AS ahead FROM f) SELECT CAST(0 AS BIGINT) AS tour_id, CASE WHEN ahead THEN fwd ELSE (n - fwd) % n END AS pos, node FROM f, g")
def file_tour_edges(spark, d):
    text.write_tour(one_tour(spark, d), path := _path(spark, "tour"), "edges", fixture(spark, d, "suppliers"))
    return text.read_tour_edges(spark, path)


@query("file_weights", "SELECT CAST(s_suppkey AS BIGINT) AS id, round(s_acctbal - least(min(s_acctbal) OVER (), 0), 6) AS w FROM supplier")
def file_weights(spark, d):
    rows = load_table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").cast("double").alias("w"))
    text.write_weights(rows, path := _path(spark, "weights"))
    return text.read_weights(spark, path).withColumn("w", F.round("w", 6))


@query("file_tsplib", f"{sql('suppliers')} SELECT *, 'CEIL_2D' AS norm FROM suppliers")
def file_tsplib(spark, d):
    text.write_tsplib(fixture(spark, d, "suppliers"), "CEIL_2D", path := _path(spark, "tsplib"))
    nodes, norm = text.read_tsplib(spark, path)
    return nodes.withColumn("norm", F.lit(norm))


@query("file_tsplib_matrix", f"{sql('suppliers')} SELECT a.id AS i, b.id AS j, {euc('a', 'b')} AS len FROM suppliers a JOIN suppliers b ON a.id < b.id")
def file_tsplib_matrix(spark, d):
    text.write_tsplib_matrix(fixture(spark, d, "suppliers"), "EUC_2D", path := _path(spark, "matrix"))
    return text.read_tsplib_matrix(spark, path)


_BOXES = f"{sql('suppliers', 'members')}, boxes AS (SELECT clique_id AS part_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS cnt, CAST(clique_id % 3 AS DOUBLE) AS bound FROM suppliers JOIN members ON node = id GROUP BY clique_id)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of each nation's suppliers, as regions."""
    rows = fixture(spark, d, "suppliers").join(fixture(spark, d, "members").withColumnRenamed("node", "id"), "id")
    found = rows.groupBy(F.col("clique_id").alias("part_id")).agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))], F.count("*").alias("cnt"))
    return found.withColumn("bound", (F.col("part_id") % 3).cast("double"))


@query("file_region_index", f"{_BOXES} SELECT * FROM boxes")
def file_region_index(spark, d):
    text.write_region_index(boxes(spark, d), "regions", 1, path := _path(spark, "regions"))
    return text.read_region_index(spark, path)[0]


@query("file_segment_index", "SELECT CAST(user_id AS BIGINT) AS seg_id, count(*) AS cnt, CAST(min(event_id) AS BIGINT) AS start, CAST(sum(event_id) AS BIGINT) AS origlen, CAST(max(event_id) AS BIGINT) AS newlen FROM events GROUP BY 1")
def file_segment_index(spark, d):
    e = load_table(spark, d, "events")
    rows = e.groupBy(F.col("user_id").cast("long").alias("seg_id")).agg(F.count("*").alias("cnt"), F.min("event_id").alias("start"), F.sum("event_id").alias("origlen"), F.max("event_id").alias("newlen"))
    text.write_segment_index(rows, "segments", 1, 1, path := _path(spark, "segments"))
    return text.read_segment_index(spark, path)[0]


_SYMBOLS = "list_transform(embedding, lambda e: CASE WHEN e < -0.0625 THEN 0 WHEN e < 0.0625 THEN 2 ELSE 1 END)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id from 1 and vec of 0, 1 and 2 from the embeddings."""
    symbol = lambda e: F.when(e < -0.0625, 0).when(e < 0.0625, 2).otherwise(1)
    rows = ranked(load_table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], name="r")
    return rows.select((F.col("r") + 1).alias("id"), F.transform("embedding", symbol).alias("vec"))


@query("file_rhvectors", f"WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, {_SYMBOLS} AS vec FROM embeddings), p AS (SELECT sum(len(list_filter(vec, lambda s: s = 1))) / sum(len(list_filter(vec, lambda s: s <> 2))) AS p1 FROM v) SELECT id, array_to_string(vec, '') AS vec, round(p1, 9) AS p1 FROM v, p UNION ALL SELECT 0, NULL, round(p1, 9) FROM p")
def file_rhvectors(spark, d):
    costs = {"d00": 0, "d01": 10, "d02": 4, "d12": 6, "d22": 1}
    text.write_rhvectors(vectors(spark, d), costs, path := _path(spark, "vectors"))
    found, params = text.read_rhvectors(spark, path)
    return found.select("id", F.array_join(F.transform("vec", lambda s: s.cast("string")), "").alias("vec"), F.lit(round(params["p1"], 9)).alias("p1"))


@query("file_cuts", f"{sql('sets', 'set_cuts')}, r AS (SELECT cut_id, 2 * count(*) AS rhs FROM set_cuts GROUP BY 1), l AS (SELECT cut_id, clique_id, row_number() OVER (ORDER BY cut_id, clique_id) - 1 AS place FROM set_cuts) SELECT dense_rank() OVER (ORDER BY l.cut_id) - 1 AS cut_id, 'G' AS sense, CAST(rhs AS INT) AS rhs, place AS clique_id, node FROM l JOIN r USING (cut_id) JOIN sets USING (clique_id)")
def file_cuts(spark, d):
    links = fixture(spark, d, "set_cuts")
    cuts = links.groupBy("cut_id").agg((2 * F.count("*")).cast("int").alias("rhs"))
    text.write_cuts(cuts, links, fixture(spark, d, "sets"), path := _path(spark, "cuts"))
    found, found_links, members = text.read_cuts(spark, path)
    return found.join(found_links, "cut_id").join(members, "clique_id").select("cut_id", "sense", "rhs", "clique_id", "node")


@query("table_round_trip", f"{sql('customers')} SELECT * FROM customers")
def table_round_trip(spark, d):
    save_table(fixture(spark, d, "customers"), path := _path(spark, "tables"), "nodes")
    return load_table(spark, path, "nodes")


@query("random_points_distinct", "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_inside FROM customer")
def random_points_distinct(spark, d):
    n = load_table(spark, d, "customer").count()
    inside = F.col("x").between(0, 99_999) & F.col("y").between(0, 99_999)
    return generate.random_points(spark, n, 100_000, 7, dups=False).agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("n_distinct"), F.count_if(inside).alias("n_inside"))


@query("random_geo_points", "SELECT count(*) AS n, count(*) AS n_inside FROM customer")
def random_geo_points(spark, d):
    inside = (F.col("x") >= -90) & (F.col("x") < 90) & (F.col("y") >= -180) & (F.col("y") < 180)
    return generate.random_geo(spark, load_table(spark, d, "customer").count(), 3).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


@query("random_edges_of_customers", "SELECT 3 * count(*) AS n, 3 * count(*) AS n_distinct, CAST(0 AS BIGINT) AS n_bad FROM customer")
def random_edges_of_customers(spark, d):
    nodes = fixture(spark, d, "customers")
    e = generate.random_edges_of(nodes, 3 * nodes.count(), "EUC_2D", 5)
    far = e.join(nodes.select(F.col("id").alias("i"), F.struct("x", "y").alias("p")), "i").join(nodes.select(F.col("id").alias("j"), F.struct("x", "y").alias("q")), "j")
    return far.agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("n_distinct"), F.count_if((F.col("i") >= F.col("j")) | (F.col("len") != length_col("EUC_2D", F.col("p"), F.col("q")))).alias("n_bad"))


@query("random_matrix_of_suppliers", "SELECT count(*) * (count(*) - 1) // 2 AS n, count(*) * (count(*) - 1) // 2 AS n_good FROM supplier")
def random_matrix_of_suppliers(spark, d):
    n = load_table(spark, d, "supplier").count()
    return generate.random_matrix(spark, n, 9).agg(F.count("*").alias("n"), F.count_if((F.col("i") < F.col("j")) & F.col("len").between(0, 10 * n - 1)).alias("n_good"))


@query("random_tour_of_customers", "SELECT count(*) AS n, count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_problems, true AS long_enough FROM customer")
def random_tour_of_customers(spark, d):
    nodes = fixture(spark, d, "customers")
    tour, length = generate.random_tour_of(nodes, "EUC_2D", 11)
    problems = tours.check_tour(tour, nodes).agg(F.count("*").alias("n_problems"))
    found = tour.agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes")).crossJoin(problems).crossJoin(length)  # one row each
    return found.select("n", "n_nodes", "n_problems", (F.col("len") >= F.col("n")).alias("long_enough"))


@query("random_weights_of_customers", "SELECT count(*) AS n, count(*) AS n_inside FROM customer")
def random_weights_of_customers(spark, d):
    return generate.random_weights(spark, load_table(spark, d, "customer").count(), 50, 2).agg(F.count("*").alias("n"), F.count_if(F.col("w").between(0, 49)).alias("n_inside"))


def sphere(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Points of a table with x as a latitude and y as a longitude, of two decimals."""
    rows = fixture(spark, d, name)
    return rows.select("id", ((F.col("id") * 7919 % 17000) / 100 - 85).alias("x"), ((F.col("id") * 104729 % 35800) / 100 - 179).alias("y"))


def sphere_sql(name: str) -> str:
    return f"{sql(name)}, globe AS (SELECT id, (id * 7919 % 17000) / 100 - 85 AS x, (id * 104729 % 35800) / 100 - 179 AS y FROM {name})"


def _rad(c: str) -> str:
    return f"(3.141592::DOUBLE * (trunc({c}) + 5.0::DOUBLE * ({c} - trunc({c})) / 3.0::DOUBLE) / 180.0::DOUBLE)"


def geo_sql(a: str, b: str) -> str:
    q1, q2, q3 = f"cos({_rad(a + '.y')} - {_rad(b + '.y')})", f"cos({_rad(a + '.x')} - {_rad(b + '.x')})", f"cos({_rad(a + '.x')} + {_rad(b + '.x')})"
    return f"CAST(trunc(6378.388::DOUBLE * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * ((1.0::DOUBLE + {q1}) * {q2} - (1.0::DOUBLE - {q1}) * {q3})))) + 1.0::DOUBLE) AS BIGINT)"


def geom_sql(ax: str, ay: str, bx: str, by: str) -> str:
    """The haversine form, in which the truncated metres agree away from opposite points."""
    h = f"(pow(sin(radians(({ax}) - ({bx})) / 2), 2) + cos(radians({ax})) * cos(radians({bx})) * pow(sin(radians(({ay}) - ({by})) / 2), 2))"
    return f"CAST(trunc(6378388.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))) + 1.0::DOUBLE) AS BIGINT)"


@query("norms_sphere_customer", f"{sphere_sql('customers')} SELECT a.id, {geo_sql('a', 'b')} AS geo, {geom_sql('a.x', 'a.y', 'b.x', 'b.y')} // 10 AS geom FROM globe a JOIN globe b ON b.id = a.id + 1")
def norms_sphere_customer(spark, d):
    n = sphere(spark, d, "customers").select("id", F.struct("x", "y").alias("a"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    # Metres are compared without their last digit: two formulas differ beyond a double's precision.
    return pairs.select("id", length_col("GEO", F.col("a"), F.col("b")).alias("geo"), F.floor(length_col("GEOM", F.col("a"), F.col("b")) / 10).alias("geom"))


@query(
    "norms_space",
    f"{sql('space')} SELECT a.id, CAST(trunc(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) + 0.5) AS BIGINT) AS euc_3d, CAST(trunc(greatest(abs(a.x - b.x), CASE WHEN 280 * abs(a.y - b.y) > 1440000 THEN 2880000 - 280 * abs(a.y - b.y) ELSE 280 * abs(a.y - b.y) END, abs(a.z - b.z))) AS BIGINT) AS crystal FROM space a JOIN space b ON b.id = a.id + 1",
)
def norms_space(spark, d):
    n = fixture(spark, d, "space").select("id", F.struct("x", "y", "z").alias("a"), F.struct("x", (F.col("y") * 280).alias("y"), "z").alias("c"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"), F.col("c").alias("e")), "id")
    return pairs.select("id", length_col("EUC_3D", F.col("a"), F.col("b")).alias("euc_3d"), length_col("CRYSTAL", F.col("c"), F.col("e")).alias("crystal"))


@query("norm_rh5_vectors", f"WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, {_SYMBOLS} AS vec FROM embeddings), s AS (SELECT a.id, len(a.vec) AS n, unnest(a.vec) AS p, unnest(b.vec) AS q FROM v a JOIN v b ON b.id = a.id + 1) SELECT id, CASE WHEN count(*) FILTER (WHERE p <> 2 AND q <> 2) = 0 THEN 0 ELSE 10 * max(n) * count(*) FILTER (WHERE p <> q AND p <> 2 AND q <> 2) // count(*) FILTER (WHERE p <> 2 AND q <> 2) END AS len FROM s GROUP BY id")
def norm_rh5_vectors(spark, d):
    v = vectors(spark, d).select("id", F.struct("vec").alias("a"))
    pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return pairs.select("id", length_col("RH5", F.col("a"), F.col("b")).alias("len"))


def _board_sql(d: str, first: float, pieces: tuple) -> str:
    inner = " ".join(f"WHEN CAST(trunc(({d}) / 0.05::DOUBLE) AS INT) = {k} THEN ({d}) * {s}::DOUBLE + {b}::DOUBLE - {at}::DOUBLE * {s}::DOUBLE" for k, (s, b, at) in enumerate(pieces))
    s, b, at = pieces[-1]
    return f"(CASE WHEN ({d}) <= 0.01 THEN ({d}) * {first} WHEN ({d}) >= 0.30 THEN ({d}) * {s}::DOUBLE + {b}::DOUBLE - {at}::DOUBLE * {s}::DOUBLE {inner} END)"


@query("norm_board_customer", f"{sql('customers')}, p AS (SELECT a.id, abs(a.x - b.x) / 25400.0::DOUBLE AS dx, abs(a.y - b.y) / 25400.0::DOUBLE AS dy FROM customers a JOIN customers b ON b.id = a.id + 1) SELECT id, CAST(trunc(greatest({_board_sql('dx', *norms.BOARD_X)}, {_board_sql('dy', *norms.BOARD_Y)})) AS BIGINT) AS len FROM p")
def norm_board_customer(spark, d):
    n = fixture(spark, d, "customers").select("id", F.struct("x", "y").alias("a"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return pairs.select("id", length_col("BOARD", F.col("a"), F.col("b")).alias("len"))


@query("norm_hooks_customer", f"{sql('customers')} SELECT a.id, CAST(trunc(abs(a.x - b.x) + 3 * abs(a.y - b.y)) AS BIGINT) AS custom, {euc('a', 'b')} + a.id % 5 + b.id % 5 AS weighted, CASE WHEN a.id % 10 >= 8 AND b.id % 10 >= 8 THEN 0 WHEN a.id % 10 >= 8 THEN b.id % 7 WHEN b.id % 10 >= 8 THEN a.id % 7 ELSE {euc('a', 'b')} END AS depot FROM customers a JOIN customers b ON b.id = a.id + 1")
def norm_hooks_customer(spark, d):
    norms.register_norm("THREE_DOWN", lambda a, b: (F.abs(a["x"] - b["x"]) + 3 * F.abs(a["y"] - b["y"])).cast("long"))
    n = fixture(spark, d, "customers").select("id", F.struct("x", "y").alias("a"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("id").alias("jd"), F.col("a").alias("b")), "id")
    length = length_col("EUC_2D", F.col("a"), F.col("b"))
    i, j = F.col("id"), F.col("jd")
    return pairs.select("id", length_col("THREE_DOWN", F.col("a"), F.col("b")).alias("custom"), norms.weighted(length, i % 5, j % 5).alias("weighted"), norms.with_depots(length, i % 10, j % 10, i % 7, j % 7, 8).alias("depot"))


@query("lookup_lengths", f"{sql('lines', 'xedges')}, p AS (SELECT DISTINCT j AS i, i + (j % 2) AS j FROM lines) SELECT p.i, p.j, CASE WHEN p.i = p.j THEN 0 ELSE coalesce(len, 100000) END AS len FROM p LEFT JOIN xedges x ON x.i = p.j AND x.j = p.i")
def lookup_lengths(spark, d):
    pairs = fixture(spark, d, "lines").select(F.col("j").alias("i"), (F.col("i") + F.col("j") % 2).alias("j")).distinct()
    return norms.lookup_lengths(pairs, fixture(spark, d, "xedges"))
