"""Queries over the given tables, with SQL that must agree."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norms import length_col
from ..operators import construct, cuts, edges, neighbors, partition, pool, pricing, tours
from ..operators.components import component_labels
from ..operators.ranking import ranked
from .fixtures import fixture, sql
from .registry import ALL, KNN as _KNN, Query, euc as _euc, pair_sql as _pair_sql, query as _query
from .session import load_table

_MAX = "CAST(trunc(greatest(abs(a.x - b.x) + 0.5, abs(a.y - b.y) + 0.5)) AS BIGINT)"


@_query("knn_graph_supplier", f"{sql('suppliers')}, {_pair_sql('suppliers', _euc('a', 'b'))}, k AS ({_KNN.format(k=5)}) SELECT DISTINCT least(id, nbr) AS i, greatest(id, nbr) AS j, len FROM k")
def knn_graph_supplier(spark, d):
    return neighbors.knn_graph(fixture(spark, d, "suppliers"), 5)


@_query("knn_customer_euc", f"{sql('customers')}, {_pair_sql('customers', _euc('a', 'b'))} {_KNN.format(k=4)}")
def knn_customer_euc(spark, d):
    return neighbors.knn(fixture(spark, d, "customers"), 4)


@_query("knn_customer_max", f"{sql('customers')}, {_pair_sql('customers', _MAX)} {_KNN.format(k=3)}")
def knn_customer_max(spark, d):
    return neighbors.knn(fixture(spark, d, "customers"), 3, "MAX_2D")


@_query(
    "quadrant_knn_customer",
    f"""{sql('customers')}, {_pair_sql('customers', _euc('a', 'b'))},
    q AS (SELECT id, nbr, len, 0 AS quadrant FROM pairs WHERE bx >= ax AND by_ >= ay UNION ALL SELECT id, nbr, len, 1 FROM pairs WHERE bx <= ax AND by_ >= ay
    UNION ALL SELECT id, nbr, len, 2 FROM pairs WHERE bx <= ax AND by_ <= ay UNION ALL SELECT id, nbr, len, 3 FROM pairs WHERE bx >= ax AND by_ <= ay)
    SELECT id, nbr, len, quadrant, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id, quadrant ORDER BY len, nbr) AS INT) AS r FROM q) WHERE r <= 2""",
)
def quadrant_knn_customer(spark, d):
    return neighbors.quadrant_knn(fixture(spark, d, "customers"), 2)


@_query("fixed_radius_customer", f"{sql('customers')}, {_pair_sql('customers', _euc('a', 'b'))} SELECT id AS i, nbr AS j, len FROM pairs WHERE id < nbr AND len < 150", write=False)
def fixed_radius_customer(spark, d):
    return neighbors.fixed_radius(fixture(spark, d, "customers"), 150)


_D = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@_query(
    "norms_customer",
    f"""{sql('customers')} SELECT a.id, {_MAX} AS max_2d, CAST(trunc(abs(a.x - b.x) + abs(a.y - b.y) + 0.5) AS BIGINT) AS man_2d, {_euc('a', 'b')} AS euc_2d,
    CAST(ceil(sqrt({_D})) AS BIGINT) AS ceil_2d, CAST(ceil(sqrt(({_D}) / 10.0)) AS BIGINT) AS att,
    CAST(trunc(sqrt(least(abs(a.x - b.x), 12000 - abs(a.x - b.x)) ** 2 + least(abs(a.y - b.y), 12000 - abs(a.y - b.y)) ** 2) + 0.5) AS BIGINT) AS toroidal
    FROM customers a JOIN customers b ON b.id = a.id + 1""",
)
def norms_customer(spark, d):
    n = fixture(spark, d, "customers").select("id", F.struct("x", "y").alias("a"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("id", *[length_col(x, a, b).alias(x.lower()) for x in ("MAX_2D", "MAN_2D", "EUC_2D", "CEIL_2D", "ATT")], length_col("TOROIDAL", a, b, grid=12000).alias("toroidal"))


@_query("edge_union_last", f"{sql('lines')} SELECT i, j, len FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY set_id DESC, len DESC) AS r FROM lines) WHERE r = 1")
def edge_union_last(spark, d):
    return edges.union_last(fixture(spark, d, "lines"), "set_id")


@_query("canonical_edges", f"{sql('lines')} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM lines WHERE i <> j")
def canonical(spark, d):
    return edges.canonical_edges(fixture(spark, d, "lines"))


@_query("node_degree", f"{sql('xedges')} SELECT id, count(*) AS degree, round(sum(x), 6) AS x FROM (SELECT i AS id, x FROM xedges UNION ALL SELECT j, x FROM xedges) GROUP BY id")
def node_degree(spark, d):
    return edges.node_degree(fixture(spark, d, "xedges")).withColumn("x", F.round("x", 6))


@_query("x_summary", f"{sql('xedges')} SELECT count(*) AS n_edges, count(*) FILTER (WHERE x > 0.0001) AS n_nonzero, round(sum(x), 6) AS sum_x FROM xedges")
def x_summary(spark, d):
    return edges.x_summary(fixture(spark, d, "xedges"))


@_query("filter_x_fractional", f"{sql('xedges')} SELECT i, j, x FROM xedges WHERE x > 0 AND x < 1")
def filter_x(spark, d):
    return edges.filter_x(fixture(spark, d, "xedges")).select("i", "j", "x")


@_query("missing_edges", f"{sql('lines')} SELECT DISTINCT i, j FROM lines WHERE set_id = 1 AND (i, j) NOT IN (SELECT (i, j) FROM lines WHERE set_id = 2)")
def missing(spark, d):
    lines = fixture(spark, d, "lines")
    return edges.missing_edges(lines.filter("set_id = 1").select("i", "j").distinct(), lines.filter("set_id = 2"))


@_query("edge_lengths_customer", f"{sql('customers')} SELECT a.id AS i, b.id AS j, {_euc('a', 'b')} AS len FROM customers a JOIN customers b ON b.id = (a.id * 17 + 5) % 1000")
def edge_lengths_customer(spark, d):
    nodes = fixture(spark, d, "customers")
    return edges.edge_lengths(nodes.select(F.col("id").alias("i"), ((F.col("id") * 17 + 5) % 1000).alias("j")), nodes, "EUC_2D")


_STEPS = f"p AS (SELECT t.tour_id, t.pos, t.node, x, y FROM tours t JOIN points ON id = node), n AS (SELECT tour_id, max(pos) AS last FROM p GROUP BY tour_id), e AS (SELECT a.tour_id, a.pos, a.node AS i, b.node AS j, {_euc('a', 'b')} AS len FROM p a JOIN n USING (tour_id) JOIN p b ON b.tour_id = a.tour_id AND b.pos = CASE WHEN a.pos = n.last THEN 0 ELSE a.pos + 1 END WHERE n.last > 0)"


@_query("tour_edges", f"{sql('points', 'tours')}, {_STEPS} SELECT * FROM e")
def tour_edges(spark, d):
    return tours.tour_edges(fixture(spark, d, "tours"), fixture(spark, d, "points"), "EUC_2D")


@_query("tour_length", f"{sql('points', 'tours')}, {_STEPS} SELECT n.tour_id, CAST(coalesce(sum(len), 0) AS BIGINT) AS len FROM n LEFT JOIN e USING (tour_id) GROUP BY n.tour_id")
def tour_length(spark, d):
    return tours.tour_length(fixture(spark, d, "tours"), fixture(spark, d, "points"), "EUC_2D")


@_query("path_length", f"{sql('points', 'tours')}, {_STEPS} SELECT n.tour_id, CAST(coalesce(sum(len) FILTER (WHERE pos < last), 0) AS BIGINT) AS len FROM n LEFT JOIN e USING (tour_id) GROUP BY n.tour_id")
def path_length(spark, d):
    return tours.path_length(fixture(spark, d, "tours"), fixture(spark, d, "points"), "EUC_2D")


@_query(
    "tour_segments",
    f"{sql('tours')}, n AS (SELECT tour_id, count(*) AS n FROM tours GROUP BY tour_id), c AS (SELECT tour_id, greatest(n - 16, 0) // 16 + CASE WHEN greatest(n - 16, 0) % 16 > 1 THEN 1 ELSE 0 END AS last FROM n) SELECT t.tour_id, pos, node, CAST(least(pos // 16, last) AS BIGINT) AS seg_id FROM tours t JOIN c USING (tour_id)",
)
def tour_segments(spark, d):
    return tours.tour_segments(fixture(spark, d, "tours"), 16)


_CROSS = "crossing AS (SELECT clique_id, i, j, x FROM xedges JOIN members m ON m.node = i)"


@_query("clique_delta", f"{sql('xedges', 'members')}, {_CROSS} SELECT m.clique_id, round(coalesce(s, 0), 6) AS delta FROM (SELECT DISTINCT clique_id FROM members) m LEFT JOIN (SELECT clique_id, sum(x) AS s FROM crossing GROUP BY 1) USING (clique_id)")
def clique_delta(spark, d):
    return cuts.clique_delta(fixture(spark, d, "members"), fixture(spark, d, "xedges").select("i", "j", "x")).withColumn("delta", F.round("delta", 6))


@_query("cut_slack", f"{sql('xedges', 'members', 'cuts')}, {_CROSS} SELECT c.cut_id, round(coalesce(s, 0) - rhs, 6) AS slack FROM cuts c LEFT JOIN (SELECT cut_id, sum(x) AS s FROM crossing JOIN cut_cliques USING (clique_id) GROUP BY 1) USING (cut_id)")
def cut_slack(spark, d):
    f = lambda n: fixture(spark, d, n)
    return cuts.cut_slack(f("cuts"), f("cut_cliques"), f("members"), f("xedges").select("i", "j", "x")).withColumn("slack", F.round("slack", 6))


@_query("clique_segments", f"{sql('members')} SELECT clique_id, min(node) AS lo, max(node) AS hi FROM (SELECT *, node - row_number() OVER (PARTITION BY clique_id ORDER BY node) AS g FROM members) GROUP BY clique_id, g")
def clique_segments(spark, d):
    return cuts.cliques_to_segments(fixture(spark, d, "members"))


@_query("cut_rows", f"{sql('xedges', 'members', 'cut_cliques')}, {_CROSS} SELECT cut_id, i, j, count(*) AS coef FROM crossing JOIN cut_cliques USING (clique_id) GROUP BY 1, 2, 3")
def cut_rows(spark, d):
    f = lambda n: fixture(spark, d, n)
    return cuts.cut_rows(f("cut_cliques"), f("members"), f("xedges"))


_DUALS = "clique_pi AS (SELECT clique_id, CAST(sum(pi) AS DOUBLE) AS pi FROM cut_cliques JOIN cut_pi USING (cut_id) GROUP BY 1), duals AS (SELECT p.id, p.pi + coalesce(sum(c.pi), 0) AS pi, p.pi + coalesce(sum(greatest(c.pi, 0)), 0) AS est FROM node_pi p LEFT JOIN members m ON m.node = p.id LEFT JOIN clique_pi c USING (clique_id) GROUP BY p.id, p.pi)"


@_query("node_duals", f"{sql('node_pi', 'members', 'cut_pi')}, {_DUALS} SELECT id, round(CAST(pi AS DOUBLE), 6) AS pi, round(CAST(est AS DOUBLE), 6) AS est FROM duals")
def node_duals(spark, d):
    f = lambda n: fixture(spark, d, n)
    found = pricing.node_duals(f("node_pi"), pricing.clique_duals(f("cut_pi"), f("cut_cliques")), f("members"))
    return found.select("id", F.round("pi", 6).alias("pi"), F.round("est", 6).alias("est"))


def _priced(spark, d):
    f = lambda n: fixture(spark, d, n)
    pi = pricing.clique_duals(f("cut_pi"), f("cut_cliques"))
    return pricing.reduced_costs(f("xedges").select("i", "j", (F.col("len") % 20).alias("len")), pricing.node_duals(f("node_pi"), pi, f("members")), pi, f("members"))


_RC = f"{sql('node_pi', 'members', 'cut_pi')}, {_DUALS}, priced AS (SELECT i, j, len % 20 AS len, round(CAST(len % 20 - a.pi - b.pi AS DOUBLE), 6) AS rc FROM xedges JOIN duals a ON a.id = i JOIN duals b ON b.id = j)"


@_query("reduced_costs", f"{_RC} SELECT * FROM priced")
def reduced_costs(spark, d):
    return _priced(spark, d).withColumn("rc", F.round("rc", 6))


@_query("reduced_cost_nearest", f"{_RC}, b AS (SELECT i AS id, j AS nbr, len, rc FROM priced UNION ALL SELECT j, i, len, rc FROM priced) SELECT id, nbr, len, rc, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY rc, len, nbr) AS INT) AS r FROM b) WHERE r <= 3")
def reduced_cost_nearest(spark, d):
    return pricing.reduced_cost_nearest(_priced(spark, d).withColumn("rc", F.round("rc", 6)), 3)


@_query("components_knn1", f"WITH RECURSIVE {sql('suppliers')[5:]}, {_pair_sql('suppliers', _euc('a', 'b'))}, k AS ({_KNN.format(k=1)}), e AS (SELECT id AS a, nbr AS b FROM k UNION SELECT nbr, id FROM k), r AS (SELECT id AS node, id AS c FROM suppliers UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def components_knn1(spark, d):
    return component_labels(neighbors.knn_graph(fixture(spark, d, "suppliers"), 1))


_TREE = f"WITH RECURSIVE {sql('suppliers')[5:]}, {_pair_sql('suppliers', _euc('a', 'b'))}, k AS ({_KNN.format(k=8)}), e AS (SELECT *, row_number() OVER (ORDER BY len, i, j) AS r FROM (SELECT DISTINCT least(id, nbr) AS i, greatest(id, nbr) AS j, len FROM k)), two AS (SELECT i AS a, j AS b, r FROM e UNION ALL SELECT j, i, r FROM e), reach AS (SELECT r, i AS node FROM e UNION SELECT reach.r, two.b FROM reach JOIN two ON two.a = reach.node AND two.r < reach.r), tree AS (SELECT i, j, len FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = e.r AND reach.node = e.j))"


#: An edge is in the tree if smaller edges don't connect its ends.
@_query("minimum_spanning_tree", f"{_TREE} SELECT * FROM tree")
def minimum_spanning_tree(spark, d):
    return construct.minimum_spanning_tree(neighbors.knn_graph(fixture(spark, d, "suppliers"), 8))


@_query("spanning_tree_bound", f"{_TREE} SELECT CAST((SELECT sum(len) FROM tree) AS BIGINT) AS len, CAST((SELECT sum(len) FROM tree) - 2 * (SELECT sum(id % 5) FROM suppliers) AS DOUBLE) AS bound")
def spanning_tree_bound(spark, d):
    weights = fixture(spark, d, "suppliers").select("id", (F.col("id") % 5).cast("double").alias("w"))
    return construct.spanning_tree_bound(minimum_spanning_tree(spark, d), weights)


#: The scan, an edge a step, with the nodes' fragments and degrees in lists.
_SCAN = "scan AS (SELECT CAST(0 AS BIGINT) AS r, (SELECT list(id ORDER BY id) FROM suppliers) AS f, (SELECT list(0 ORDER BY id) FROM suppliers) AS d, false AS took UNION ALL SELECT s.r + 1, CASE WHEN t THEN list_transform(f, lambda v: CASE WHEN v = f[j + 1] THEN f[i + 1] ELSE v END) ELSE f END, CASE WHEN t THEN list_transform(d, lambda v, k: v + CASE WHEN k IN (i + 1, j + 1) THEN 1 ELSE 0 END) ELSE d END, t FROM (SELECT s.*, e.i, e.j, d[e.i + 1] < 2 AND d[e.j + 1] < 2 AND f[e.i + 1] <> f[e.j + 1] AS t FROM scan s JOIN e ON e.r = s.r + 1) s)"


@_query("greedy_fragments", f"WITH RECURSIVE {sql('suppliers')[5:]}, {_pair_sql('suppliers', _euc('a', 'b'))}, k AS ({_KNN.format(k=5)}), e AS (SELECT *, row_number() OVER (ORDER BY len, i, j) AS r FROM (SELECT DISTINCT least(id, nbr) AS i, greatest(id, nbr) AS j, len FROM k)), {_SCAN} SELECT i, j, len FROM e JOIN scan USING (r) WHERE took")
def greedy_fragments(spark, d):
    return construct.greedy_fragments(neighbors.knn_graph(fixture(spark, d, "suppliers"), 5))


_FOLD = lambda v: f"((({v} + 2147483648) & 4294967295) - 2147483648)"


@_query(
    "norm_dsjrand_customer",
    f"""WITH p AS (SELECT CAST(a.c_custkey AS BIGINT) AS id, CAST((a.c_custkey * 7919) % 10007 AS BIGINT) AS dp, CAST((b.c_custkey * 7919) % 10007 AS BIGINT) AS dq FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
    s0 AS (SELECT *, dp & dq AS x0, dp | dq AS y0, CAST(313 AS BIGINT) AS z0 FROM p),
    s1 AS (SELECT *, {_FOLD('x0 * z0')} AS x1 FROM s0), s2 AS (SELECT *, {_FOLD('y0 * x1')} AS y1 FROM s1), s3 AS (SELECT *, xor({_FOLD('z0 * y1')}, 313) AS z1 FROM s2),
    s4 AS (SELECT *, {_FOLD('x1 * z1')} AS x2 FROM s3), s5 AS (SELECT *, {_FOLD('y1 * x2')} AS y2 FROM s4), s6 AS (SELECT *, {_FOLD('z1 * y2')} AS z3 FROM s5)
    SELECT id, CAST(trunc((xor(dp + dq, z3) & 2147483647) * (1000 / 2147483648.0)) AS BIGINT) AS len FROM s6""",
)
def norm_dsjrand(spark, d):
    n = fixture(spark, d, "customers").select("id", F.struct(F.col("y").alias("x")).alias("a"))
    pairs = n.join(n.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return pairs.select("id", length_col("DSJRAND", F.col("a"), F.col("b"), maxdist=1000, seed=3).alias("len"))


@_query(
    "norms_vectors",
    """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda e: CASE WHEN e < -0.0625 THEN 0 WHEN e < 0.0625 THEN 2 ELSE 1 END) AS vec FROM embeddings),
    s AS (SELECT a.id, unnest(a.vec) AS p, unnest(b.vec) AS q FROM v a JOIN v b ON b.id = a.id + 1),
    g AS (SELECT id, sum(CASE WHEN p = 2 AND q = 2 THEN 1 WHEN p <> 2 AND q <> 2 THEN CASE WHEN p = q THEN 0 ELSE 10 END WHEN least(p, q) = 0 THEN 4 ELSE 6 END) AS rh1,
      sum(CASE WHEN p = 2 AND q = 2 THEN 0.375 WHEN p <> 2 AND q <> 2 THEN CASE WHEN p = q THEN 0.0 ELSE 1.0 END WHEN least(p, q) = 0 THEN 0.25 ELSE 0.75 END) AS r2,
      count(*) FILTER (WHERE p <> 2 OR q <> 2) AS n3, count(*) FILTER (WHERE p <> 2 AND q <> 2) AS n4, count(*) FILTER (WHERE p = 1 AND q = 1) AS a, count(*) FILTER (WHERE p = 0 AND q = 0) AS d, count(*) FILTER (WHERE p <> q AND p <> 2 AND q <> 2) AS bc FROM s GROUP BY id),
    h AS (SELECT *, n3 - a * 0.25::DOUBLE - d * 0.75::DOUBLE AS t3, 4.0::DOUBLE * n3 * 0.1875 * bc AS u3, n4 - a * 0.25::DOUBLE - d * 0.75::DOUBLE AS t4, 4.0::DOUBLE * n4 * 0.1875 * bc AS u4 FROM g),
    k AS (SELECT *, CASE WHEN n3 = 0 OR u3 >= t3 * t3 THEN 9 ELSE (t3 - sqrt(t3 * t3 - u3)) / (2.0::DOUBLE * n3 * 0.1875) END AS h3, CASE WHEN n4 = 0 OR u4 >= t4 * t4 THEN 9 ELSE (t4 - sqrt(t4 * t4 - u4)) / (2.0::DOUBLE * n4 * 0.1875) END AS h4 FROM h)
    SELECT id, CAST(rh1 AS BIGINT) AS rh1, CAST(trunc(r2 * 100.0 + 0.5) AS BIGINT) AS rh2,
      CASE WHEN h3 >= 1 THEN 1000 ELSE CAST(trunc(-10 * log10(pow(1 - h3 * 0.25, d) * pow(1 - h3 * 0.75, a) * pow(h3 * sqrt(0.1875), bc))) AS BIGINT) END AS rh3,
      CASE WHEN h4 >= 1 THEN 1000 ELSE CAST(trunc(-10 * log10(pow(1 - h4 * 0.25, d) * pow(1 - h4 * 0.75, a) * pow(h4 * sqrt(0.1875), bc))) AS BIGINT) END AS rh4 FROM k""",
)
def norms_vectors(spark, d):
    symbol = lambda e: F.when(e < -0.0625, 0).when(e < 0.0625, 2).otherwise(1)
    v = ranked(load_table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"]).select(F.col("rank").alias("id"), F.struct(F.transform("embedding", symbol).alias("vec")).alias("a"))
    pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    a, b = F.col("a"), F.col("b")
    rh1 = length_col("RH1", a, b, d00=0, d01=10, d02=4, d12=6, d22=1)
    return pairs.select("id", rh1.alias("rh1"), length_col("RH2", a, b, p1=0.25).alias("rh2"), length_col("RH3", a, b, p1=0.25).alias("rh3"), length_col("RH4", a, b, p1=0.25).alias("rh4"))


@_query(
    "karp_partition_customer",
    f"""WITH RECURSIVE {sql('customers')[5:]}, k AS (SELECT id, x, y, CAST(1 AS BIGINT) AS code, 0 AS depth FROM customers UNION ALL
    SELECT id, x, y, 2 * code + CASE WHEN r <= (n - 1) // 2 + 1 THEN 0 ELSE 1 END, depth + 1 FROM
      (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN dx >= dy THEN x ELSE y END, id) AS r FROM
        (SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS dx, max(y) OVER w - min(y) OVER w AS dy FROM k WINDOW w AS (PARTITION BY code))) WHERE n > 100)
    SELECT id, x, y, dense_rank() OVER (ORDER BY place) - 1 AS part_id FROM (SELECT id, x, y, arg_max(code, depth) * pow(2, 40 - max(depth)) AS place FROM k GROUP BY id, x, y)""",
)
def karp_partition_customer(spark, d):
    return partition.karp_partition(fixture(spark, d, "customers"), 100)[0]


@_query("segment_index", f"{sql('points', 'tours')}, {_STEPS}, z AS (SELECT tour_id, count(*) AS n FROM tours GROUP BY tour_id), c AS (SELECT tour_id, greatest(n - 16, 0) // 16 + CASE WHEN greatest(n - 16, 0) % 16 > 1 THEN 1 ELSE 0 END AS last FROM z), s AS (SELECT tour_id, pos, least(pos // 16, last) AS seg_id FROM tours JOIN c USING (tour_id)) SELECT s.tour_id, CAST(s.seg_id AS BIGINT) AS seg_id, count(*) AS cnt, min(s.pos) AS start, CAST(coalesce(sum(CASE WHEN t.seg_id = s.seg_id THEN len END), 0) AS BIGINT) AS origlen FROM s LEFT JOIN s t ON t.tour_id = s.tour_id AND t.pos = s.pos + 1 LEFT JOIN e ON e.tour_id = s.tour_id AND e.pos = s.pos GROUP BY s.tour_id, s.seg_id")
def segment_index(spark, d):
    return partition.segment_index(fixture(spark, d, "tours"), fixture(spark, d, "points"), "EUC_2D", 16)


@_query("edges_to_tour", f"{sql('tours')}, n AS (SELECT tour_id, count(*) AS n, min(node) AS low FROM tours GROUP BY tour_id HAVING count(*) > 2), a AS (SELECT t.*, n, (SELECT 1) AS one, (pos - p0 + n) % n AS fwd FROM tours t JOIN n USING (tour_id) JOIN (SELECT tour_id, arg_min(pos, node) AS p0 FROM tours GROUP BY tour_id) USING (tour_id)), f AS (SELECT tour_id, max(node) FILTER (WHERE fwd = 1) < max(node) FILTER (WHERE fwd = n - 1) AS ahead FROM a GROUP BY tour_id) SELECT tour_id, CASE WHEN ahead THEN fwd ELSE (n - fwd) % n END AS pos, node FROM a JOIN f USING (tour_id)")
def edges_to_tour(spark, d):
    t = fixture(spark, d, "tours")
    return tours.edges_to_tour(tours.steps(t.join(t.groupBy("tour_id").count().filter("count > 2").select("tour_id"), "tour_id")))


@_query("tour_missing_edges", f"{sql('tours')}, n AS (SELECT tour_id, count(*) AS n FROM tours GROUP BY 1 HAVING count(*) > 1), s AS (SELECT a.tour_id, least(a.node, b.node) AS i, greatest(a.node, b.node) AS j FROM tours a JOIN n USING (tour_id) JOIN tours b ON b.tour_id = a.tour_id AND b.pos = (a.pos + 1) % n) SELECT tour_id, count(*) FILTER (WHERE (i + j) % 3 = 0) AS n_missing, count(*) FILTER (WHERE (i + j) % 3 = 0) = 0 AS ok FROM s GROUP BY tour_id")
def tour_missing_edges(spark, d):
    t = fixture(spark, d, "tours")
    return tours.uses_only_real_edges(t, tours.steps(t).filter("(i + j) % 3 != 0"))


@_query("octant_knn_supplier", f"{sql('space')}, {_pair_sql('space', 'CAST(trunc(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) + 0.5) AS BIGINT)')}, q AS (SELECT pairs.*, o.octant FROM pairs JOIN space a ON a.id = pairs.id JOIN space b ON b.id = pairs.nbr JOIN (SELECT unnest(range(8)) AS octant) o ON (CASE WHEN octant & 1 = 1 THEN b.x <= a.x ELSE b.x >= a.x END) AND (CASE WHEN octant & 2 = 2 THEN b.y <= a.y ELSE b.y >= a.y END) AND (CASE WHEN octant & 4 = 4 THEN b.z <= a.z ELSE b.z >= a.z END)) SELECT id, nbr, len, CAST(octant AS INT) AS octant, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id, octant ORDER BY len, nbr) AS INT) AS r FROM q) WHERE r <= 1")
def octant_knn_supplier(spark, d):
    return neighbors.octant_knn(fixture(spark, d, "space"), 1)


@_query("nearest_unmarked_customer", f"{sql('customers')}, {_pair_sql('customers', _euc('a', 'b'))} SELECT id, arg_min(nbr, (len, nbr)) AS nbr, min(len) AS len FROM pairs WHERE nbr % 3 <> 0 GROUP BY id")
def nearest_unmarked_customer(spark, d):
    n = fixture(spark, d, "customers")
    return neighbors.nearest_unmarked(n, n.filter("id % 3 = 0"))


@_query("nearest_outside_group_customer", f"{sql('customers')}, {_pair_sql('customers', _euc('a', 'b'))} SELECT id, arg_min(nbr, (len, nbr)) AS nbr, min(len) AS len, min(len) // 2 AS cost FROM pairs WHERE id % 4 <> nbr % 4 GROUP BY id")
def nearest_outside_group_customer(spark, d):
    return neighbors.nearest_outside_group(fixture(spark, d, "customers").withColumn("part_id", F.col("id") % 4))


@_query("space_filling_tour", f"WITH RECURSIVE {sql('customers')[5:]}, g AS (SELECT count(*) AS n, least(min(x), 0) AS tx, least(min(y), 0) AS ty, greatest(max(x), max(y), 0) AS tm FROM customers), m AS (SELECT CAST(trunc(tm - tx - ty + 1) AS BIGINT) AS m, tx, ty, CAST(ceil(log2(n)) AS BIGINT) + 2 AS bits FROM g), s AS (SELECT id, CAST(1 AS BIGINT) AS k, CASE WHEN x0 > y0 THEN 1::BIGINT ELSE 0 END AS h, CASE WHEN x0 > y0 THEN m - x0 ELSE x0 END AS x, CASE WHEN x0 > y0 THEN m - y0 ELSE y0 END AS y, m, bits FROM (SELECT id, CAST(trunc(x - tx) AS BIGINT) AS x0, CAST(trunc(y - ty) AS BIGINT) AS y0, m, bits FROM customers, m) UNION ALL SELECT id, k + 1, 2 * h + CASE WHEN k % 2 = 1 THEN CASE WHEN x + y > m THEN 1 ELSE 0 END ELSE CASE WHEN 2 * y > m THEN 1 ELSE 0 END END, CASE WHEN k % 2 = 1 THEN CASE WHEN x + y > m THEN m - y ELSE x END ELSE CASE WHEN 2 * y > m THEN 2 * y - m ELSE 2 * x END END, CASE WHEN k % 2 = 1 THEN CASE WHEN x + y > m THEN x ELSE y END ELSE CASE WHEN 2 * y > m THEN m - 2 * x ELSE 2 * y END END, m, bits FROM s WHERE k < bits) SELECT CAST(0 AS BIGINT) AS tour_id, row_number() OVER (ORDER BY h, id) - 1 AS pos, id AS node FROM s WHERE k = bits")
def space_filling_tour(spark, d):
    return construct.space_filling_tour(fixture(spark, d, "customers"))


@_query("contract_ones_chain", f"WITH RECURSIVE {sql('chain')[5:]}, e AS (SELECT i AS a, j AS b FROM chain WHERE x >= 0.999999 UNION SELECT j, i FROM chain WHERE x >= 0.999999), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(c) AS c FROM r GROUP BY node) SELECT least(p, q) AS i, greatest(p, q) AS j, round(sum(x), 6) AS x FROM (SELECT coalesce(a.c, i) AS p, coalesce(b.c, j) AS q, x FROM chain LEFT JOIN l a ON a.node = i LEFT JOIN l b ON b.node = j) WHERE p <> q GROUP BY 1, 2")
def contract_ones_chain(spark, d):
    return edges.contract_ones(fixture(spark, d, "chain"))[1].withColumn("x", F.round("x", 6))


@_query("cut_atoms", f"{sql('sets', 'set_cuts')}, h AS (SELECT cut_id, node, list_sort(list(DISTINCT clique_id)) AS o FROM set_cuts JOIN sets USING (clique_id) GROUP BY 1, 2), n AS (SELECT c.cut_id, s.s_suppkey AS node, coalesce(o, []) AS o FROM (SELECT DISTINCT cut_id FROM set_cuts) c CROSS JOIN supplier s LEFT JOIN h ON h.cut_id = c.cut_id AND h.node = s.s_suppkey) SELECT cut_id, min(node) AS node, count(*) AS size, CAST(len(o) AS BIGINT) AS n_cliques FROM n GROUP BY cut_id, o")
def cut_atoms(spark, d):
    return pool.cut_atoms(fixture(spark, d, "set_cuts"), fixture(spark, d, "sets"), load_table(spark, d, "supplier").count())


@_query("distinct_cuts", f"{sql('sets', 'set_cuts')}, k AS (SELECT clique_id, string_agg(DISTINCT node::VARCHAR, ',' ORDER BY node::VARCHAR) AS k FROM sets GROUP BY 1), t AS (SELECT cut_id AS cut_id, clique_id FROM set_cuts UNION ALL SELECT cut_id + 10 + 10 * (cut_id % 2), clique_id FROM set_cuts), c AS (SELECT cut_id, string_agg(k, ';' ORDER BY k) AS k FROM t JOIN k USING (clique_id) GROUP BY 1) SELECT min(cut_id) AS cut_id, count(*) AS n_equal FROM c GROUP BY k, cut_id >= 20")
def distinct_cuts(spark, d):
    links = fixture(spark, d, "set_cuts")
    links = links.unionByName(links.withColumn("cut_id", F.col("cut_id") + 10 + 10 * (F.col("cut_id") % 2)))
    cuts_ = links.select("cut_id").distinct().select("cut_id", F.lit("G").alias("sense"), F.when(F.col("cut_id") >= 20, 4).otherwise(2).alias("rhs"))
    return pool.distinct_cuts(cuts_, links, fixture(spark, d, "sets"))


@_query("clique_neighbors", f"{sql('sets', 'chain')} SELECT DISTINCT clique_id, e AS node FROM sets s JOIN (SELECT i AS node, j AS e FROM chain UNION ALL SELECT j, i FROM chain) USING (node) WHERE NOT EXISTS (SELECT 1 FROM sets t WHERE t.clique_id = s.clique_id AND t.node = e)")
def clique_neighbors(spark, d):
    return pool.clique_neighbors(fixture(spark, d, "sets"), fixture(spark, d, "chain"))


@_query("crossing_pairs", f"{sql('sets')}, z AS (SELECT clique_id, count(*) AS n FROM sets GROUP BY 1) SELECT a, b, shared FROM (SELECT s.clique_id AS a, t.clique_id AS b, count(*) AS shared FROM sets s JOIN sets t USING (node) WHERE s.clique_id < t.clique_id GROUP BY 1, 2) JOIN z p ON p.clique_id = a JOIN z q ON q.clique_id = b WHERE shared < least(p.n, q.n)")
def crossing_pairs(spark, d):
    return cuts.crossing_pairs(fixture(spark, d, "sets"))


#: Intervals of two consecutive nodes or more; ids that no edge has are no nodes.
_INTERVALS = "v AS (SELECT i AS v FROM chain UNION SELECT j FROM chain), w AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM v), ab AS (SELECT p.v AS a, q.v AS b FROM w p JOIN w q ON q.k > p.k), d AS (SELECT a, b, sum(CASE WHEN (i >= a) <> (j <= b) THEN x ELSE 0 END) AS delta FROM (SELECT a, b, i, j, x FROM ab JOIN chain ON i BETWEEN a AND b UNION ALL SELECT a, b, i, j, x FROM ab JOIN chain ON j BETWEEN a AND b AND i < a) GROUP BY a, b)"


@_query("all_segment_cuts", f"{sql('chain')}, {_INTERVALS} SELECT a, b, round(delta, 6) AS delta FROM d WHERE delta <= 1.5")
def all_segment_cuts(spark, d):
    return pool.all_segment_cuts(fixture(spark, d, "chain"), None, 1.5).withColumn("delta", F.round("delta", 6))


@_query("segment_cuts", f"{sql('chain')}, {_INTERVALS}, t AS (SELECT v FROM (SELECT i AS v FROM chain WHERE x >= 0.999999 UNION ALL SELECT j FROM chain WHERE x >= 0.999999) GROUP BY v HAVING count(*) > 1) SELECT * FROM (SELECT a, arg_min(b, (round(delta, 9), b)) AS b, round(min(delta), 9) AS delta FROM d WHERE a NOT IN (FROM t) AND b NOT IN (FROM t) GROUP BY a) WHERE delta < 1.9999")
def segment_cuts(spark, d):
    return pool.segment_cuts(fixture(spark, d, "chain"))


def _by_rounds(spark, d, k: int, run) -> DataFrame:
    return run(neighbors.knn_graph(fixture(spark, d, "suppliers"), k))


#: Queries of which nothing is left to one task, with the SQL of those that leave small rests to one.
for _name, _k, _run in (
    ("components_knn1", 1, lambda e: component_labels(e, local=0)),
    ("minimum_spanning_tree", 8, lambda e: construct.minimum_spanning_tree(e, local=0)),
    ("greedy_fragments", 5, lambda e: construct.greedy_fragments(e, local=0)),
):
    _query(f"{_name}_by_rounds", ALL[_name][1])(partial(_by_rounds, k=_k, run=_run))

from . import queries_files, queries_graphs  # noqa: E402, F401  (they register their queries)


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text}
