"""Queries of edge tables, neighbour graphs, tours, constructions, partitions, cuts, pricing and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norms import length_col
from ..operators import candidates, construct, cuts, edges, neighbors, partition, pool, pricing, tours
from ..operators.components import connected_components
from ..operators.ranking import ranked
from ..streaming import results as streams
from .fixtures import fixture, sql
from .queries_files import _BOXES, _SYMBOLS, _TOUR, boxes, geo_sql, geom_sql, one_tour, sphere, sphere_sql, vectors
from .registry import KNN, euc, pair_sql, query
from .session import load_table, materialize, shared_path

# --- edges

_SETS = f"{_TOUR}, u AS (SELECT row_number() OVER (ORDER BY y, id) - 1 AS pos, id AS node FROM suppliers), n AS (SELECT count(*) AS n FROM suppliers), s AS (SELECT 0 AS set_id, pos, node FROM t UNION ALL SELECT 1, pos, node FROM u UNION ALL SELECT 2, pos, node FROM t), e AS (SELECT s.set_id, s.pos, s.node AS i, q.node AS j, {euc('a', 'b')} AS len FROM s JOIN n ON true JOIN s q ON q.set_id = s.set_id AND q.pos = (s.pos + 1) % n JOIN suppliers a ON a.id = s.node JOIN suppliers b ON b.id = q.node WHERE s.set_id < 2 OR s.pos < n - 1)"


def edge_sets(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two tours (by x and by y) and of a path."""
    nodes = fixture(spark, d, "suppliers")
    by_x, by_y = (tours.tour_edges(one_tour(spark, d, c), nodes, "EUC_2D") for c in "xy")
    last = load_table(spark, d, "supplier").count() - 1
    parts = [by_x, by_y, by_x.filter(F.col("pos") < last)]
    return parts[0].withColumn("set_id", F.lit(0)).unionByName(parts[1].withColumn("set_id", F.lit(1))).unionByName(parts[2].withColumn("set_id", F.lit(2))).select("set_id", "i", "j", "len")


@query("best_tour_among", f"{_SETS}, z AS (SELECT set_id, count(*) AS n_edges, set_id < 2 AS is_tour, CAST(sum(len) AS BIGINT) AS len FROM e GROUP BY set_id) SELECT *, is_tour AND set_id = (SELECT arg_min(set_id, (len, set_id)) FROM z WHERE is_tour) AS best FROM z")
def best_tour_among(spark, d):
    return edges.best_tour_among(edge_sets(spark, d), load_table(spark, d, "supplier").count())


@query("is_tour", f"{_SETS} SELECT set_id, count(*) = (SELECT n FROM n) AS is_tour FROM e GROUP BY set_id")
def is_tour(spark, d):
    e, n = materialize(edge_sets(spark, d), "sets"), load_table(spark, d, "supplier").count()
    flags = [construct.is_tour(e.filter(F.col("set_id") == k), n) for k in range(3)]
    return e.select("set_id").distinct().withColumn("is_tour", F.element_at(F.array(*[F.lit(f) for f in flags]), F.col("set_id") + 1))


@query("strip_default", f"{sql('xedges')} SELECT i, j, len FROM xedges WHERE len <> 1000")
def strip_default(spark, d):
    return edges.strip_default(fixture(spark, d, "xedges"), 1000).select("i", "j", "len")


@query("complete_graph", f"{sql('suppliers')}, n AS (SELECT count(*) AS n FROM suppliers), g AS (SELECT least(i, j) AS i, greatest(i, j) AS j, min(len) AS len FROM (SELECT id AS i, (id * 17 + 5) % n AS j, id % 50 + 1 AS len FROM suppliers, n) WHERE i <> j GROUP BY 1, 2), w AS (SELECT CASE WHEN 256 * (max(len) + 1) * max(n) > 2147483647 THEN 8388607 ELSE (max(len) + 1) * max(n) END AS w FROM g, n) SELECT a.id AS i, b.id AS j, coalesce(g.len, w) AS len FROM suppliers a JOIN suppliers b ON a.id < b.id LEFT JOIN g ON g.i = a.id AND g.j = b.id JOIN w ON true", write=False)
def complete_graph(spark, d):
    n = load_table(spark, d, "supplier").count()
    given = fixture(spark, d, "suppliers").select(F.col("id").alias("i"), ((F.col("id") * 17 + 5) % n).alias("j"), (F.col("id") % 50 + 1).alias("len"))
    return edges.complete_graph(given, n)


@query("adjacency", f"{sql('chain')}, b AS (SELECT i AS id, j AS e FROM chain UNION ALL SELECT j, i FROM chain) SELECT id, count(*) AS degree, string_agg(e::VARCHAR || ':' || (id + e)::VARCHAR, ' ' ORDER BY e) AS nbrs FROM b GROUP BY id")
def adjacency(spark, d):
    found = edges.adjacency(fixture(spark, d, "chain").withColumn("len", F.col("i") + F.col("j")))
    return found.select("id", "degree", F.array_join(F.transform("nbrs", lambda e: F.concat_ws(":", e["end"], e["len"])), " ").alias("nbrs"))


@query("from_adjacency", f"{sql('chain')} SELECT DISTINCT i, j, i + j AS len FROM chain")
def from_adjacency(spark, d):
    return edges.from_adjacency(edges.adjacency(fixture(spark, d, "chain").select("i", "j", (F.col("i") + F.col("j")).alias("len")).distinct()))


@query("relabel", f"{sql('chain')}, m AS (SELECT max(j) AS m FROM chain) SELECT m - i AS i, m - j AS j, x FROM chain, m")
def relabel(spark, d):
    chain = fixture(spark, d, "chain")
    top = chain.agg(F.max("j")).first()[0]
    return edges.relabel(chain, spark.range(top + 1).select(F.col("id").alias("old"), (F.lit(top) - F.col("id")).alias("new")), ["i", "j"])


@query("x_nonzero", f"{sql('xedges')} SELECT i, j, x FROM xedges WHERE x > 0.0001")
def x_nonzero(spark, d):
    return edges.x_nonzero(fixture(spark, d, "xedges")).select("i", "j", "x")


@query("edges_semi", f"{sql('lines')} SELECT DISTINCT i, j FROM lines WHERE set_id = 1 AND (i, j) IN (SELECT (i, j) FROM lines WHERE set_id = 2)")
def edges_semi(spark, d):
    lines = fixture(spark, d, "lines")
    return edges.edges_semi(lines.filter("set_id = 1").select("i", "j").distinct(), lines.filter("set_id = 2"))


# --- neighbours

_WEIGHTED = f"{sql('customers')}, {pair_sql('customers', euc('a', 'b') + ' + a.id % 13 * 10.0::DOUBLE + b.id % 13 * 10.0::DOUBLE')}"


def _weights(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", (F.col("id") % 13 * 10.0).alias("w"))


@query("knn_weighted_customer", f"{_WEIGHTED} {KNN.format(k=3)}")
def knn_weighted_customer(spark, d):
    nodes = fixture(spark, d, "customers")
    return neighbors.knn(nodes, 3, weights=_weights(nodes))


@query("radius_weighted_customer", f"{_WEIGHTED} SELECT id AS i, nbr AS j, len FROM pairs WHERE id < nbr AND len < 200", write=False)
def radius_weighted_customer(spark, d):
    nodes = fixture(spark, d, "customers")
    return neighbors.fixed_radius(nodes, 200, weights=_weights(nodes))


@query("knn_geo_customer", f"{sphere_sql('customers')}, {pair_sql('globe', geo_sql('a', 'b'))} {KNN.format(k=3)}")
def knn_geo_customer(spark, d):
    return neighbors.knn(sphere(spark, d, "customers"), 3, "GEO")


@query("knn_geom_supplier", f"{sphere_sql('suppliers')}, {pair_sql('globe', geom_sql('a.x', 'a.y', 'b.x', 'b.y'))} SELECT id, nbr, r AS rank FROM (SELECT id, nbr, CAST(row_number() OVER (PARTITION BY id ORDER BY len, nbr) AS INT) AS r FROM pairs) WHERE r <= 3")
def knn_geom_supplier(spark, d):
    return neighbors.knn(sphere(spark, d, "suppliers"), 3, "GEOM").drop("len")


@query("knn_toroidal_customer", f"{sql('customers')}, {pair_sql('customers', 'CAST(trunc(sqrt(least(abs(a.x - b.x), 12000 - abs(a.x - b.x)) ** 2 + least(abs(a.y - b.y), 12000 - abs(a.y - b.y)) ** 2) + 0.5) AS BIGINT)')} {KNN.format(k=3)}")
def knn_toroidal_customer(spark, d):
    return neighbors.knn(fixture(spark, d, "customers"), 3, "TOROIDAL", grid=12000)


@query("knn_all_pairs_vectors", f"WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, {_SYMBOLS} AS vec FROM embeddings), p AS (SELECT a.id, b.id AS nbr, len(list_filter(list_zip(a.vec, b.vec), lambda z: z[1] <> 2 AND z[2] <> 2)) AS k, len(list_filter(list_zip(a.vec, b.vec), lambda z: z[1] <> 2 AND z[2] <> 2 AND z[1] <> z[2])) AS m, len(a.vec) AS n FROM v a JOIN v b ON a.id <> b.id), pairs AS (SELECT id, nbr, CAST(CASE WHEN k = 0 THEN 0 ELSE 10 * n * m // k END AS BIGINT) AS len FROM p) {KNN.format(k=2)}")
def knn_all_pairs_vectors(spark, d):
    return neighbors.knn_all_pairs(vectors(spark, d), 2, "RH5")


@query("candidate_edges", f"{sql('suppliers')}, {pair_sql('suppliers', euc('a', 'b'))}, k AS ({KNN.format(k=3)}), q AS (SELECT *, 0 AS u FROM pairs WHERE bx >= ax AND by_ >= ay UNION ALL SELECT *, 1 FROM pairs WHERE bx <= ax AND by_ >= ay UNION ALL SELECT *, 2 FROM pairs WHERE bx <= ax AND by_ <= ay UNION ALL SELECT *, 3 FROM pairs WHERE bx >= ax AND by_ <= ay), r AS (SELECT id, nbr, len, row_number() OVER (PARTITION BY id, u ORDER BY len, nbr) AS r FROM q) SELECT DISTINCT least(id, nbr) AS i, greatest(id, nbr) AS j, len FROM (SELECT id, nbr, len FROM k UNION ALL SELECT id, nbr, len FROM r WHERE r <= 2)")
def candidate_edges(spark, d):
    return candidates.candidate_edges(fixture(spark, d, "suppliers"), candidates.parse_plan("EDGEGEN NEAREST 3\nEDGEGEN QUADNEAREST 2\n"))


@query("border_distance", f"{sphere_sql('suppliers')}, g AS (SELECT globe.*, id % 4 AS part_id FROM globe), r AS (SELECT part_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g GROUP BY 1) SELECT id, part_id, least({geom_sql('x', 'y', 'x0', 'y')}, {geom_sql('x', 'y', 'x1', 'y')}, {geom_sql('x', 'y', 'x', 'y0')}, {geom_sql('x', 'y', 'x', 'y1')}) // 100 AS cost FROM g JOIN r USING (part_id)")
def border_distance(spark, d):
    nodes = sphere(spark, d, "suppliers").withColumn("part_id", F.col("id") % 4)
    regions = nodes.groupBy("part_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return neighbors.border_distance(nodes, regions).withColumn("cost", F.floor(F.col("cost") / 100))


# --- tours

@query("check_tour", f"{sql('points', 'tours')}, t AS (SELECT node FROM tours UNION ALL SELECT node FROM tours WHERE node % 50 = 0 UNION ALL SELECT -1 - node FROM tours WHERE node % 97 = 0), c AS (SELECT node, count(*) AS n FROM t WHERE node % 31 <> 0 GROUP BY 1) SELECT coalesce(node, id) AS node, coalesce(n, 0) AS n, CASE WHEN id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM c FULL JOIN points ON id = node WHERE id IS NULL OR n IS NULL OR n > 1")
def check_tour(spark, d):
    t = fixture(spark, d, "tours")
    t = t.unionByName(t.filter("node % 50 = 0")).unionByName(t.filter("node % 97 = 0").withColumn("node", -1 - F.col("node")))
    return tours.check_tour(t.filter("node % 31 != 0"), fixture(spark, d, "points"))


@query("tour_file_length", f"{_SETS} SELECT CAST(sum(len) AS BIGINT) AS len FROM e WHERE set_id = 0")
def tour_file_length(spark, d):
    total = tours.tour_file_length(edge_sets(spark, d).filter("set_id = 0"), load_table(spark, d, "supplier").count())
    return spark.range(1).select(F.lit(total).cast("long").alias("len"))


@query("tour_positions", f"{sql('tours')} SELECT tour_id, node, pos FROM tours")
def tour_positions(spark, d):
    return tours.tour_positions(fixture(spark, d, "tours"))


@query("induced_order", f"{_TOUR} SELECT node % 7 AS part_id, node AS id, row_number() OVER (PARTITION BY node % 7 ORDER BY pos) - 1 AS rank FROM t")
def induced_order(spark, d):
    return tours.induced_order(fixture(spark, d, "suppliers").select("id", (F.col("id") % 7).alias("part_id")), one_tour(spark, d))


@query("partial_tour_sum", f"{_SETS} SELECT CAST(sum(len) AS BIGINT) AS len FROM e WHERE set_id < 2")
def partial_tour_sum(spark, d):
    both = one_tour(spark, d).unionByName(one_tour(spark, d, "y").withColumn("tour_id", F.lit(1).cast("long")))
    return tours.partial_tour_sum(both, fixture(spark, d, "suppliers"), "EUC_2D")


# --- constructions: a tour is a permutation, and no longer than what it improves

_PERMUTATION = "SELECT count(*) AS n, count(*) AS n_nodes, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM supplier"


def _permutation(tour: DataFrame) -> DataFrame:
    return tour.agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("greedy_tour", _PERMUTATION)
def greedy_tour(spark, d):
    nodes = fixture(spark, d, "suppliers")
    return _permutation(construct.greedy_tour(nodes, neighbors.knn_graph(nodes, 5), "EUC_2D"))


@query("x_greedy_tour", _PERMUTATION)
def x_greedy_tour(spark, d):
    nodes = fixture(spark, d, "suppliers")
    x = neighbors.knn_graph(nodes, 3).select("i", "j", ((F.col("i") * 7 + F.col("j")) % 10 / 10.0).alias("x"))
    return _permutation(construct.x_greedy_tour(nodes, x, "EUC_2D"))


@query("boruvka_tour", _PERMUTATION)
def boruvka_tour(spark, d):
    return _permutation(construct.boruvka_tour(fixture(spark, d, "suppliers"), "EUC_2D"))


#: Free ends of the short paths, in the order of ids; a node without an edge is two ends of its path.
_ENDS = f"WITH RECURSIVE {sql('suppliers', 'short_paths')[5:]}, f AS (SELECT s.id, x, y, coalesce(p.i, q.i, s.id) AS f, CASE WHEN p.i IS NULL AND q.i IS NULL THEN [0, 1] ELSE [0] END AS copies FROM suppliers s LEFT JOIN short_paths p ON p.i = s.id LEFT JOIN short_paths q ON q.j = s.id), ends AS (SELECT list({{'id': id, 'x': x, 'y': y, 'f': f}} ORDER BY id) AS l FROM (SELECT *, unnest(copies) FROM f))"
#: What is left after entries p and q (p < q) are linked.
_MERGED = "list_transform(l[1 : p - 1] || l[p + 1 : q - 1] || l[q + 1 :], lambda e: {'id': e.id, 'x': e.x, 'y': e.y, 'f': CASE WHEN e.f = l[q].f THEN l[p].f ELSE e.f END})"
_LINKED = f"SELECT i, j, {euc('a', 'b')} AS len FROM (SELECT i, j FROM steps WHERE i IS NOT NULL UNION ALL SELECT l[1].id, l[2].id FROM steps WHERE len(l) = 2 AND l[1].id <> l[2].id) JOIN suppliers a ON a.id = i JOIN suppliers b ON b.id = j"


def _links(spark: SparkSession, d: str, rule: str, local: int) -> DataFrame:
    taken = fixture(spark, d, "short_paths").withColumn("len", F.lit(0).cast("long"))
    return construct.link_fragments(fixture(spark, d, "suppliers"), taken, "EUC_2D", rule, local)


@query("lowest_links", f"{_ENDS}, steps AS (SELECT l, NULL::BIGINT AS i, NULL::BIGINT AS j FROM ends UNION ALL SELECT {_MERGED}, l[p].id, l[q].id FROM (SELECT l, 1 AS p, list_position(list_transform(l, lambda e: e.f <> l[1].f), true) AS q FROM steps WHERE len(l) > 2)) {_LINKED}")
def lowest_links(spark, d):
    return _links(spark, d, "lowest", 0)


@query(
    "shortest_links",
    f"{_ENDS}, steps AS (SELECT l, NULL::BIGINT AS i, NULL::BIGINT AS j FROM ends UNION ALL SELECT {_MERGED}, l[p].id, l[q].id FROM (SELECT l, list_position(list_transform(l, lambda e: e.id), m.i) AS p, list_position(list_transform(l, lambda e: e.id), m.j) AS q FROM (SELECT l, list_min(flatten(list_transform(l, lambda a: list_transform(list_filter(l, lambda b: b.id > a.id AND b.f <> a.f), lambda b: {{'len': {euc('a', 'b')}, 'i': a.id, 'j': b.id}})))) AS m FROM steps WHERE len(l) > 2))) {_LINKED}",
)
def shortest_links(spark, d):
    return _links(spark, d, "nearest", 16)


@query("segments_without_shorter_turns", f"{sql('tours')} SELECT tour_id, CAST(0 AS BIGINT) AS n_turns FROM tours GROUP BY tour_id")
def segments_without_shorter_turns(spark, d):
    """What 2-opt moves over all pairs of edges are left in the improved segments: none."""
    tour, nodes = fixture(spark, d, "tours"), fixture(spark, d, "points")
    better = materialize(partition.improve_segments(tour, nodes, "EUC_2D", 16, near=40), "better")
    return partition.shortening_turns(better, nodes, "EUC_2D").groupBy("tour_id").agg(F.sum("n_turns").alias("n_turns"))


@query("improve_segments", f"{sql('tours')} SELECT tour_id, count(*) AS n, count(*) AS n_nodes, true AS no_longer FROM tours GROUP BY tour_id")
def improve_segments(spark, d):
    tour, nodes = fixture(spark, d, "tours"), fixture(spark, d, "points")
    better = materialize(partition.concat_segments(partition.improve_segments(tour, nodes, "EUC_2D", 16)), "better")
    old = tours.path_length(tour, nodes, "EUC_2D").withColumnRenamed("len", "old")
    counts = better.join(tour.select("tour_id", "node").distinct(), ["tour_id", "node"]).groupBy("tour_id").agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"))
    return counts.join(tours.path_length(better, nodes, "EUC_2D"), "tour_id").join(old, "tour_id").select("tour_id", "n", "n_nodes", (F.col("len") <= F.col("old")).alias("no_longer"))


_LINKS = "e AS (SELECT i AS a, j AS b FROM chain WHERE x >= 0.75 UNION SELECT j, i FROM chain WHERE x >= 0.75), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(c) AS component FROM r GROUP BY node)"


@query("component_cuts", f"WITH RECURSIVE {sql('chain')[5:]}, {_LINKS} SELECT component AS cut_id, node, 2 AS rhs FROM l WHERE component <> (SELECT max(component) FROM l)")
def component_cuts(spark, d):
    return construct.component_cuts(fixture(spark, d, "chain").filter("x >= 0.75"))


@query("connected_components", f"WITH RECURSIVE {sql('chain', 'customers')[5:]}, {_LINKS}, f AS (SELECT id AS node, coalesce(component, id) AS component FROM customers LEFT JOIN l ON node = id) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM f")
def components_of_customers(spark, d):
    return connected_components(fixture(spark, d, "customers"), fixture(spark, d, "chain"), 0.7)


# --- partitions

@query("overlapping_regions", f"{_BOXES}, h AS (SELECT s.part_id AS a, t.part_id AS b FROM boxes s JOIN boxes t ON s.part_id <> t.part_id JOIN (SELECT unnest([0, 1]) AS cx) ON true JOIN (SELECT unnest([0, 1]) AS cy) ON true WHERE CASE WHEN cx = 0 THEN t.x0 ELSE t.x1 END > s.x0 AND CASE WHEN cx = 0 THEN t.x0 ELSE t.x1 END < s.x1 AND CASE WHEN cy = 0 THEN t.y0 ELSE t.y1 END > s.y0 AND CASE WHEN cy = 0 THEN t.y0 ELSE t.y1 END < s.y1) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM h")
def overlapping_regions(spark, d):
    return partition.overlapping_regions(boxes(spark, d))


@query("check_partition", f"{sql('customers')}, p AS (SELECT id, id % 6 AS part_id FROM customers WHERE id % 50 <> 0 UNION ALL SELECT id, 1 FROM customers WHERE id % 60 = 1), r AS (SELECT id % 6 AS part_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM customers WHERE id % 4 < 3 AND id % 6 < 5 GROUP BY 1), c AS (SELECT id, count(*) AS n FROM p GROUP BY 1) SELECT id, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM customers LEFT JOIN c USING (id) WHERE n IS NULL OR n > 1 UNION ALL SELECT p.id, CASE WHEN x0 IS NULL THEN 'unknown part' ELSE 'outside' END FROM p JOIN customers USING (id) LEFT JOIN r USING (part_id) WHERE x0 IS NULL OR x < x0 OR x > x1 OR y < y0 OR y > y1")
def check_partition(spark, d):
    n = fixture(spark, d, "customers")
    parts = n.filter("id % 50 != 0").select("id", (F.col("id") % 6).alias("part_id")).unionByName(n.filter("id % 60 = 1").select("id", F.lit(1).cast("long").alias("part_id")))
    regions = n.filter("id % 4 < 3 and id % 6 < 5").groupBy((F.col("id") % 6).alias("part_id")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return partition.check_partition(n, parts, regions)


_GRID = f"{sql('customers')}, cells AS (SELECT id, x, y, CAST(floor(x / 2500) AS BIGINT) AS cx, CAST(floor(y / 2500) AS BIGINT) AS cy FROM customers), parts AS (SELECT id, x, y, 100 + 10 * cx + cy AS part_id FROM cells), regions AS (SELECT DISTINCT 100 + 10 * cx + cy AS part_id, cx * 2500.0::DOUBLE AS x0, (cx + 1) * 2500.0::DOUBLE AS x1, cy * 2500.0::DOUBLE AS y0, (cy + 1) * 2500.0::DOUBLE AS y1 FROM cells)"
_ADJACENT = "adj AS (SELECT least(s.part_id, t.part_id) AS a, greatest(s.part_id, t.part_id) AS b, min(CASE WHEN s.x1 = t.x0 THEN 'x' ELSE 'y' END) AS side FROM regions s JOIN regions t ON s.part_id <> t.part_id AND s.x0 <= t.x1 AND t.x0 <= s.x1 AND s.y0 <= t.y1 AND t.y0 <= s.y1 AND (s.x1 = t.x0 OR s.y1 = t.y0) GROUP BY 1, 2)"


def grid_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers in square regions of a grid."""
    cells = fixture(spark, d, "customers").withColumn("cx", F.floor(F.col("x") / 2500)).withColumn("cy", F.floor(F.col("y") / 2500)).withColumn("part_id", 100 + 10 * F.col("cx") + F.col("cy"))
    regions = cells.select("part_id", *[((F.col(f"c{c}") + k) * 2500.0).alias(f"{c}{k}") for c in "xy" for k in (0, 1)]).distinct()
    return cells.select("id", "x", "y", "part_id"), regions


@query("region_adjacency", f"{_GRID}, {_ADJACENT} SELECT * FROM adj")
def region_adjacency(spark, d):
    return partition.region_adjacency(grid_parts(spark, d)[1])


@query("region_adjacency_dateline", f"{_GRID}, z AS (SELECT min(y0) AS lo, max(y1) AS hi FROM regions) SELECT DISTINCT least(s.part_id, t.part_id) AS a, greatest(s.part_id, t.part_id) AS b, 'dateline' AS side FROM regions s JOIN regions t ON s.part_id <> t.part_id JOIN z ON s.y1 = hi AND t.y0 = lo AND s.x0 <= t.x1 AND t.x0 <= s.x1")
def region_adjacency_dateline(spark, d):
    return partition.region_adjacency(grid_parts(spark, d)[1], "dateline")


@query("region_adjacency_poles", f"{_GRID}, z AS (SELECT min(x0) AS lo, max(x1) AS hi FROM regions) SELECT s.part_id AS a, t.part_id AS b, CASE WHEN s.x1 = hi AND t.x1 = hi THEN 'north' ELSE 'south' END AS side FROM regions s JOIN regions t ON s.part_id < t.part_id JOIN z ON s.x1 = hi AND t.x1 = hi OR s.x0 = lo AND t.x0 = lo")
def region_adjacency_poles(spark, d):
    return partition.region_adjacency(grid_parts(spark, d)[1], "poles")


@query("region_pairs", f"{_GRID}, {_ADJACENT} SELECT s.part_id AS i, t.part_id AS j, CASE WHEN side IS NULL THEN 1 ELSE 0 END AS len FROM regions s JOIN regions t ON s.part_id < t.part_id LEFT JOIN adj ON a = s.part_id AND b = t.part_id")
def region_pairs(spark, d):
    return partition.region_pairs(grid_parts(spark, d)[1])


_BORDER = "own AS (SELECT a, b, side, a AS o, b AS t FROM adj UNION ALL SELECT a, b, side, b, a FROM adj), f AS (SELECT own.a, own.b, o AS part_id, p.id, p.x, p.y, CASE WHEN side = 'x' THEN abs(p.x - CASE WHEN ro.x1 = rt.x0 THEN ro.x1 ELSE ro.x0 END) ELSE abs(p.y - CASE WHEN ro.y1 = rt.y0 THEN ro.y1 ELSE ro.y0 END) END AS off FROM own JOIN regions ro ON ro.part_id = o JOIN regions rt ON rt.part_id = t JOIN parts p ON p.part_id = o WHERE CASE WHEN side = 'x' THEN p.y BETWEEN rt.y0 AND rt.y1 ELSE p.x BETWEEN rt.x0 AND rt.x1 END), border AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a, b, part_id ORDER BY off, id) AS INT) AS rank FROM f) WHERE rank <= 25)"


def _borders(spark: SparkSession, d: str) -> DataFrame:
    parts, regions = grid_parts(spark, d)
    return partition.border_points(parts, regions, partition.region_adjacency(regions), 25)


@query("border_points", f"{_GRID}, {_ADJACENT}, {_BORDER} SELECT * FROM border")
def border_points(spark, d):
    return _borders(spark, d)


@query("closest_border_pairs", f"{_GRID}, {_ADJACENT}, {_BORDER}, w AS (SELECT p.a, p.b, p.id AS i, q.id AS j, CAST(trunc(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) + 0.5) AS BIGINT) AS len FROM border p JOIN border q ON q.a = p.a AND q.b = p.b AND p.part_id = p.a AND q.part_id = q.b) SELECT a, b, arg_min(i, (len, i, j)) AS i, arg_min(j, (len, i, j)) AS j, min(len) AS len FROM w GROUP BY a, b")
def closest_border_pairs(spark, d):
    return partition.closest_border_pairs(materialize(_borders(spark, d), "borders"), "EUC_2D")


@query("depot_subproblems", f"{_TOUR} SELECT node % 7 AS part_id, node AS id, row_number() OVER (PARTITION BY node % 7 ORDER BY pos) - 1 AS rank, node % 10 AS cost, CAST(4 * (floor(sqrt(count(*) OVER (PARTITION BY node % 7))) + 1) AS BIGINT) AS depots FROM t")
def depot_subproblems(spark, d):
    nodes = fixture(spark, d, "suppliers")
    return partition.depot_subproblems(nodes.select("id", (F.col("id") % 7).alias("part_id")), one_tour(spark, d), nodes.select("id", (F.col("id") % 10).alias("cost")))


@query("concat_segments", f"{sql('tours')} SELECT * FROM tours")
def concat_segments(spark, d):
    return partition.concat_segments(tours.tour_segments(fixture(spark, d, "tours"), 16))


@query("export_parts", f"{_GRID} SELECT id, x, y, CAST(part_id AS BIGINT) AS part_id FROM parts")
def export_parts(spark, d):
    partition.export_parts(grid_parts(spark, d)[0], path := shared_path(spark, "export"))
    return spark.read.parquet(path).withColumn("part_id", F.col("part_id").cast("long"))


@query(
    "karp_partition_polar",
    f"""WITH RECURSIVE {sphere_sql('customers')[5:]}, c AS (SELECT count(*) AS n FROM globe), q AS (SELECT n, n // (min(p) + 2) AS cap FROM c, (SELECT unnest([CAST(pow(2, k) AS BIGINT) for k in range(1, 40)]) AS p) WHERE n // (p + 2) <= 100 GROUP BY n),
    s AS (SELECT globe.id, x, y, row_number() OVER (ORDER BY x, globe.id) - 1 AS r, n, cap FROM globe, q),
    k AS (SELECT id, x, y, CAST(CASE WHEN r <= cap THEN 2 WHEN r <= n - 1 - cap THEN 6 ELSE 7 END AS BIGINT) AS code, CASE WHEN r <= cap THEN 1 ELSE 2 END AS depth FROM s UNION ALL
    SELECT id, x, y, 2 * code + CASE WHEN r <= (n - 1) // 2 + 1 THEN 0 ELSE 1 END, depth + 1 FROM
      (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN dx >= dy THEN x ELSE y END, id) AS r FROM
        (SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS dx, max(y) OVER w - min(y) OVER w AS dy FROM k WINDOW w AS (PARTITION BY code))) WHERE n > 100)
    SELECT id, x, y, dense_rank() OVER (ORDER BY place) - 1 AS part_id FROM (SELECT id, x, y, arg_max(code, depth) * pow(2, 40 - max(depth)) AS place FROM k GROUP BY id, x, y)""",
)
def karp_partition_polar(spark, d):
    return partition.karp_partition(sphere(spark, d, "customers"), 100, polar=True)[0]


_STITCH = f"""{sql('customers')}, p AS (SELECT id, x, y, id % 8 AS k, row_number() OVER (PARTITION BY id % 8 ORDER BY y, id) - 1 AS pos, count(*) OVER (PARTITION BY id % 8) AS n FROM customers),
    c AS (SELECT a.k, a.id AS node, a.x, a.y, b.id AS next, b.x AS nx, b.y AS ny, {euc('a', 'b')} AS len FROM p a JOIN p b ON b.k = a.k AND b.pos = (a.pos + 1) % a.n),
    w AS (SELECT a.k, a.id AS p, b.id AS q, {euc('a', 'b')} AS len FROM p a JOIN p b ON b.k = a.k + 1),
    m AS (SELECT k, arg_min(p, (len, p, q)) AS p, arg_min(q, (len, p, q)) AS q FROM w GROUP BY k),
    s AS (SELECT m.k, m.p, m.q, CASE WHEN m.p = e.q THEN o.node ELSE f.next END AS p1, g.next AS q1, CASE WHEN m.p = e.q THEN o.len ELSE f.len END + g.len AS gone FROM m LEFT JOIN m e ON e.k = m.k - 1 JOIN c f ON f.node = m.p JOIN c o ON o.next = m.p JOIN c g ON g.node = m.q),
    z AS (SELECT least({euc('a', 'b')} + {euc('a1', 'b1')}, {euc('a', 'b1')} + {euc('a1', 'b')}) - gone AS more FROM s JOIN p a ON a.id = s.p JOIN p b ON b.id = s.q JOIN p a1 ON a1.id = s.p1 JOIN p b1 ON b1.id = s.q1)"""


@query("stitch_tours", f"{_STITCH} SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM p) AS n_nodes, CAST((SELECT sum(len) FROM c) + (SELECT sum(more) FROM z) AS BIGINT) AS len")
def stitch_tours(spark, d):
    nodes = fixture(spark, d, "customers")
    rows = ranked(nodes.withColumn("part_id", F.col("id") % 8), ["y", "id"], ["part_id"], "pos").select("part_id", "pos", F.col("id").alias("node"))
    order = spark.range(8).select(F.col("id").alias("rank"), F.col("id").alias("part_id"))
    tour = materialize(partition.stitch_tours(rows, order, nodes, "EUC_2D"), "whole")
    counts = tour.agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"))
    return counts.crossJoin(tours.tour_length(tour, nodes, "EUC_2D").select("len"))  # one row each


# --- cuts

_DELTA = f"{sql('sets', 'set_cuts', 'chain')}, d AS (SELECT clique_id, round(sum(x), 6) AS delta FROM (SELECT clique_id, i, j, max(x) AS x, count(*) AS n FROM (SELECT clique_id, i, j, x FROM chain JOIN sets ON node = i UNION ALL SELECT clique_id, i, j, x FROM chain JOIN sets ON node = j) GROUP BY 1, 2, 3) WHERE n = 1 GROUP BY 1), slack AS (SELECT cut_id, round(sum(delta) - 20 * (cut_id + 1), 6) AS slack FROM set_cuts JOIN d USING (clique_id) GROUP BY 1)"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return cuts.clique_delta(fixture(spark, d, "sets"), fixture(spark, d, "chain")).withColumn("delta", F.round("delta", 6))


def _slacks(spark: SparkSession, d: str) -> DataFrame:
    links = fixture(spark, d, "set_cuts")
    heads = links.select("cut_id").distinct().withColumn("rhs", 20 * (F.col("cut_id") + 1))
    return cuts.cut_slack(heads, links, fixture(spark, d, "sets"), fixture(spark, d, "chain")).withColumn("slack", F.round("slack", 6))


@query("violated_cuts", f"{_DELTA} SELECT cut_id, slack - 1000 AS slack FROM slack WHERE slack - 1000 < -0.001 ORDER BY slack, cut_id LIMIT 500")
def violated_cuts(spark, d):
    return cuts.violated_cuts(_slacks(spark, d).withColumn("slack", F.col("slack") - 1000))


@query("truncate_cuts", f"{_DELTA} SELECT cut_id, slack FROM slack ORDER BY slack, cut_id LIMIT 3")
def truncate_cuts(spark, d):
    return pool.truncate_cuts(_slacks(spark, d), 3)


@query("accept_cuts", f"{_DELTA} SELECT cut_id, slack - 1000 AS slack FROM slack WHERE slack - 1000 < -0.002")
def accept_cuts(spark, d):
    return pool.accept_cuts(_slacks(spark, d).withColumn("slack", F.col("slack") - 1000))


@query("cliques_in_range", f"{_DELTA} SELECT clique_id, delta FROM d WHERE delta BETWEEN 5 AND 50")
def cliques_in_range(spark, d):
    return cuts.cliques_in_range(_deltas(spark, d), 5, 50)


@query("tight_cliques", f"{_DELTA} SELECT clique_id, delta FROM d WHERE delta < 1000 ORDER BY delta, clique_id LIMIT 7")
def tight_cliques(spark, d):
    return pool.tight_cliques(_deltas(spark, d), 7, 1000)


@query("branch_cliques", f"{_DELTA} SELECT clique_id, delta FROM d WHERE abs(delta - 3) <= 1000 ORDER BY abs(delta - 3), clique_id LIMIT 4")
def branch_cliques(spark, d):
    return cuts.branch_cliques(_deltas(spark, d), 4, 1000)


@query("clique_union", f"{sql('sets')} SELECT DISTINCT clique_id, node FROM (SELECT clique_id, node FROM sets UNION ALL SELECT clique_id, node + 1 FROM sets)")
def clique_union(spark, d):
    s = fixture(spark, d, "sets")
    return pool.clique_union(s, s.withColumn("node", F.col("node") + 1))


@query("clique_remove", f"{sql('sets')} SELECT clique_id, node FROM sets WHERE (clique_id, node) NOT IN (SELECT (clique_id, node + 1) FROM sets)")
def clique_remove(spark, d):
    s = fixture(spark, d, "sets")
    return pool.clique_remove(s, s.withColumn("node", F.col("node") + 1))


@query("clique_marked_count", f"{sql('sets')} SELECT clique_id, count(*) AS size, count(*) FILTER (WHERE node % 3 = 0) AS n_marked FROM sets GROUP BY 1")
def clique_marked_count(spark, d):
    return pool.clique_marked_count(fixture(spark, d, "sets"), fixture(spark, d, "suppliers").filter("id % 3 = 0").select(F.col("id").alias("node")))


@query("relabel_members", f"{sql('sets')} SELECT clique_id, 1000 - node AS node FROM sets")
def relabel_members(spark, d):
    s = fixture(spark, d, "sets")
    return pool.relabel_members(s, s.select(F.col("node").alias("old")).distinct().select("old", (1000 - F.col("old")).alias("new")))


@query("clique_key", f"{sql('sets')}, t AS (SELECT clique_id, node FROM sets UNION ALL SELECT 500 + clique_id, node FROM sets), k AS (SELECT clique_id, string_agg(node::VARCHAR, ',' ORDER BY node) AS k FROM t GROUP BY 1) SELECT clique_id, min(clique_id) OVER (PARTITION BY k) AS first FROM k")
def clique_key(spark, d):
    s = fixture(spark, d, "sets")
    keys = pool.clique_key(s.unionByName(s.withColumn("clique_id", 500 + F.col("clique_id"))))
    return keys.join(keys.groupBy("key").agg(F.min("clique_id").alias("first")), "key").select("clique_id", "first")


@query("pool_merge", f"{sql('set_cuts', 'sets')} SELECT cut_id, count(*) AS n_cliques, CAST(sum(size) AS BIGINT) AS n_members FROM set_cuts JOIN (SELECT clique_id, count(*) AS size FROM sets GROUP BY 1) USING (clique_id) GROUP BY 1")
def pool_merge(spark, d):
    links, members = fixture(spark, d, "set_cuts"), fixture(spark, d, "sets")
    heads = links.select("cut_id").distinct().select("cut_id", F.lit("G").alias("sense"), F.lit(2).alias("rhs"))
    again = (heads.withColumn("cut_id", F.col("cut_id") + 50), links.withColumn("cut_id", F.col("cut_id") + 50), members)
    kept, kept_links, kept_members = pool.pool_merge([(heads, links, members), again])
    sizes = kept_members.groupBy("clique_id").agg(F.count("*").alias("size"))
    rows = kept.select("cut_id").join(kept_links, "cut_id").join(sizes, "clique_id").groupBy("cut_id").agg(F.count("*").alias("n_cliques"), F.sum("size").alias("n_members"))
    return rows.select("cut_id.id", "n_cliques", "n_members").withColumnRenamed("id", "cut_id")


@query("poolable_cuts", f"{sql('set_cuts')} SELECT cut_id FROM set_cuts WHERE clique_id % 2 = 0 GROUP BY 1 HAVING count(*) > 1")
def poolable_cuts(spark, d):
    links = fixture(spark, d, "set_cuts").filter("clique_id % 2 = 0")
    return pool.poolable(links.select("cut_id").distinct(), links)


@query("teeth_disjoint", f"{sql('set_cuts', 'sets')}, m AS (SELECT DISTINCT a.cut_id FROM set_cuts a JOIN sets s ON s.clique_id = a.clique_id JOIN set_cuts b ON b.cut_id = a.cut_id AND b.clique_id > a.clique_id JOIN sets t ON t.clique_id = b.clique_id AND t.node = s.node) SELECT DISTINCT cut_id FROM set_cuts WHERE cut_id NOT IN (FROM m) UNION ALL SELECT 10 + cut_id FROM (SELECT DISTINCT cut_id FROM set_cuts WHERE clique_id < 100)")
def teeth_disjoint(spark, d):
    links = fixture(spark, d, "set_cuts")
    return pool.teeth_disjoint(links.unionByName(links.filter("clique_id < 100").withColumn("cut_id", 10 + F.col("cut_id"))), fixture(spark, d, "sets"))


@query("pure_combs", "WITH h AS (SELECT r_regionkey AS cut_id, s_suppkey AS node, s_nationkey AS tooth, s_suppkey % 7 = r_regionkey AS inside FROM region, nation, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey), t AS (SELECT cut_id, tooth, count(*) AS n, count(*) FILTER (WHERE inside) AS k FROM h GROUP BY 1, 2 HAVING count(*) FILTER (WHERE inside) > 0) SELECT CAST(cut_id AS BIGINT) AS cut_id FROM t GROUP BY 1 HAVING bool_and(k < n)")
def pure_combs(spark, d):
    # A cut's handle with those of its nations' cliques that meet it.
    members = fixture(spark, d, "sets")
    handle = fixture(spark, d, "set_cuts").filter("clique_id >= 100")
    of_handle = handle.join(members, "clique_id").select("cut_id", "node")
    teeth = fixture(spark, d, "set_cuts").filter("clique_id < 100").join(members, "clique_id").join(of_handle, ["cut_id", "node"]).select("cut_id", "clique_id").distinct()
    return pool.pure_combs(handle.withColumn("handle", F.lit(True)).unionByName(teeth.withColumn("handle", F.lit(False))), members)


def _blossom_sql(table: str, below: float, least: float, choose: str) -> str:
    return f"""WITH RECURSIVE {sql(table)[5:]}, fe AS (SELECT i AS a, j AS b FROM {table} WHERE x < {below} UNION SELECT j, i FROM {table} WHERE x < {below}), r AS (SELECT a AS node, a AS c FROM fe UNION SELECT fe.b, r.c FROM r JOIN fe ON fe.a = r.node),
    l AS (SELECT node, min(c) AS cut_id FROM r GROUP BY node), h AS (SELECT cut_id, node, count(*) OVER (PARTITION BY cut_id) AS h FROM l QUALIFY h >= 3),
    e AS (SELECT i, j, x, p.cut_id AS ci, q.cut_id AS cj FROM {table} LEFT JOIN h p ON p.node = i LEFT JOIN h q ON q.node = j),
    b AS (SELECT ci AS cut_id, i AS inner_, j AS outer_, x FROM e WHERE x >= {least} AND ci IS NOT NULL AND ci IS DISTINCT FROM cj UNION ALL SELECT cj, j, i, x FROM e WHERE x >= {least} AND cj IS NOT NULL AND ci IS DISTINCT FROM cj),
    {choose},
    nh AS (SELECT cut_id, node FROM h WHERE cut_id IN (SELECT cut_id FROM t) AND (cut_id, node) NOT IN (SELECT (cut_id, inner_) FROM t GROUP BY cut_id, inner_ HAVING count(*) > 1) UNION SELECT cut_id, outer_ FROM t GROUP BY cut_id, outer_ HAVING count(*) > 1),
    nt AS (SELECT * FROM t WHERE ((cut_id, inner_) IN (SELECT (cut_id, node) FROM nh)) <> ((cut_id, outer_) IN (SELECT (cut_id, node) FROM nh))),
    z AS (SELECT cut_id, (SELECT count(*) FROM nh WHERE nh.cut_id = k.cut_id) AS n_handle, (SELECT count(*) FROM nt WHERE nt.cut_id = k.cut_id) AS n_teeth FROM (SELECT DISTINCT cut_id FROM t) k)
    SELECT cut_id, CAST(3 * (n_teeth + 1) - 2 AS INT) AS rhs, n_handle, n_teeth FROM z WHERE n_handle >= 3 AND n_teeth % 2 = 1"""


def _blossom_rows(found: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    heads, roles, members = found
    teeth = roles.filter("not handle").groupBy("cut_id").agg(F.count("*").alias("n_teeth"))
    handle = roles.filter("handle").join(members, "clique_id").groupBy("cut_id").agg(F.count("*").alias("n_handle"))
    return heads.join(handle, "cut_id").join(teeth, "cut_id").select("cut_id", "rhs", "n_handle", "n_teeth")


@query("fast_blossoms", _blossom_sql("chain", 0.99, 0.99, "t AS (SELECT cut_id, inner_, outer_ FROM b QUALIFY count(*) OVER (PARTITION BY cut_id) % 2 = 1)"))
def fast_blossoms(spark, d):
    return _blossom_rows(pool.fast_blossoms(fixture(spark, d, "chain")))


@query(
    "gh_blossoms",
    _blossom_sql(
        "ladder", 0.7, 0.7,
        "g AS (SELECT ci AS cut_id, sum(x) AS z FROM e WHERE ci = cj GROUP BY 1), o AS (SELECT b.*, row_number() OVER w AS n, sum(x) OVER w AS zx FROM b WINDOW w AS (PARTITION BY cut_id ORDER BY x DESC, least(inner_, outer_), greatest(inner_, outer_))), y AS (SELECT o.cut_id, min(n) AS n FROM o LEFT JOIN g USING (cut_id) JOIN (SELECT DISTINCT cut_id, h FROM h) USING (cut_id) WHERE n % 2 = 1 AND round(coalesce(z, 0) + zx, 9) > h + (n - 1) / 2 + 0.01 GROUP BY 1), t AS (SELECT o.cut_id, inner_, outer_ FROM o JOIN y ON y.cut_id = o.cut_id AND o.n <= y.n)",
    ),
)
def gh_blossoms(spark, d):
    return _blossom_rows(pool.gh_blossoms(fixture(spark, d, "ladder")))


@query("classify_cuts", f"{sql('set_cuts', 'members')} SELECT DISTINCT cut_id, 'other' AS kind FROM set_cuts UNION ALL SELECT DISTINCT 100 + clique_id, 'subtour' FROM members")
def classify_cuts(spark, d):
    links, single = fixture(spark, d, "set_cuts"), fixture(spark, d, "members").select((100 + F.col("clique_id")).alias("cut_id"), "clique_id").distinct()
    heads = links.select("cut_id").distinct().withColumn("rhs", F.lit(4)).unionByName(single.select("cut_id").withColumn("rhs", F.lit(2))).withColumn("sense", F.lit("G"))
    return pool.classify_cuts(heads, links.unionByName(single), fixture(spark, d, "sets"), load_table(spark, d, "supplier").count())


#: The chain has no cycle: each of its edges is a block, and every node with several edges is a cut node.
@query("blocks", f"{sql('chain')} SELECT node, count(*) AS n_blocks FROM (SELECT i AS node FROM chain WHERE x < 0.99 UNION ALL SELECT j FROM chain WHERE x < 0.99) GROUP BY node HAVING count(*) > 1")
def blocks(spark, d):
    return pool.blocks(fixture(spark, d, "chain"))[1]


#: Two edges at a node are of one block if their other ends are connected without it.
@query(
    "blocks_of_loops",
    f"WITH RECURSIVE {sql('loops')[5:]}, both_ AS (SELECT i AS u, j AS v, i, j FROM loops UNION ALL SELECT j, i, i, j FROM loops), reach AS (SELECT u AS gone, v AS start, v AS node FROM both_ UNION SELECT r.gone, r.start, b.v FROM reach r JOIN both_ b ON b.u = r.node AND b.v <> r.gone), "
    "near AS (SELECT a.i, a.j, b.i AS i2, b.j AS j2 FROM reach r JOIN both_ a ON a.u = r.gone AND a.v = r.start JOIN both_ b ON b.u = r.gone AND b.v = r.node), same AS (SELECT * FROM near UNION SELECT s.i, s.j, n.i2, n.j2 FROM same s JOIN near n ON n.i = s.i2 AND n.j = s.j2) "
    "SELECT i, j, min((i2, j2))[1] AS block_i, min((i2, j2))[2] AS block_j FROM same GROUP BY i, j",
)
def blocks_of_loops(spark, d):
    found = pool.blocks(fixture(spark, d, "loops"))[0]
    first = found.groupBy("component", "block").agg(F.min(F.struct("i", "j")).alias("e")).select("component", "block", F.col("e.i").alias("block_i"), F.col("e.j").alias("block_j"))
    return found.join(first, ["component", "block"]).select("i", "j", "block_i", "block_j")


_SPANS = f"{sql('loops')}, v AS (SELECT i AS v FROM loops UNION SELECT j FROM loops), d AS (SELECT a.v AS a, b.v AS b, coalesce(sum(x), 0) AS delta FROM v a JOIN v b ON b.v > a.v LEFT JOIN loops ON (i BETWEEN a.v AND b.v) <> (j BETWEEN a.v AND b.v) GROUP BY a.v, b.v)"


@query("all_segment_cuts_unbounded", f"{_SPANS} SELECT a, b, round(delta, 6) AS delta FROM d WHERE delta <= 1")
def all_segment_cuts_unbounded(spark, d):
    return pool.all_segment_cuts(fixture(spark, d, "loops"), None, 1.0).withColumn("delta", F.round("delta", 6))


@query("segment_cuts_unbounded", f"{_SPANS} SELECT * FROM (SELECT a, arg_min(b, (round(delta, 9), b)) AS b, round(min(delta), 9) AS delta FROM d GROUP BY a) WHERE delta < 1.9999")
def segment_cuts_unbounded(spark, d):
    return pool.segment_cuts(fixture(spark, d, "loops"))


# --- pricing

_LENGTHS = f"{sql('xedges', 'node_pi')}, p AS (SELECT i, j, x, len % 20 AS len, CAST(len % 20 - 2 * a.pi - b.pi AS DOUBLE) AS rc FROM xedges JOIN node_pi a ON a.id = i JOIN node_pi b ON b.id = j)"


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Edges with a reduced cost of small integers."""
    pi = fixture(spark, d, "node_pi")
    rows = fixture(spark, d, "xedges").join(pi.select(F.col("id").alias("i"), F.col("pi").alias("a")), "i").join(pi.select(F.col("id").alias("j"), F.col("pi").alias("b")), "j")
    return rows.select("i", "j", "x", (F.col("len") % 20).alias("len"), (F.col("len") % 20 - 2 * F.col("a") - F.col("b")).cast("double").alias("rc"))


@query("pricing_candidates", f"{_LENGTHS} SELECT p.i, p.j, p.len FROM p JOIN node_pi a ON a.id = i JOIN node_pi b ON b.id = j WHERE len - a.pi - b.pi < 0.0001")
def pricing_candidates(spark, d):
    return pricing.pricing_candidates(priced(spark, d).select("i", "j", "len"), fixture(spark, d, "node_pi").withColumnRenamed("pi", "est"))


@query("pricing_candidates_complete", f"{sql('customers')} SELECT a.id AS i, b.id AS j, {euc('a', 'b')} AS len FROM customers a JOIN customers b ON a.id < b.id WHERE {euc('a', 'b')} - (a.id % 9) * 10.0 - (b.id % 9) * 10.0 < 0.0001")
def pricing_candidates_complete(spark, d):
    nodes = fixture(spark, d, "customers")
    return pricing.pricing_candidates_complete(nodes, nodes.select("id", (F.col("id") % 9 * 10.0).alias("est")), "EUC_2D")


#: One dual that reaches all nodes, and a few uneven ones.
_UNEVEN = "CASE WHEN id = 0 THEN 30000.0 WHEN id % 97 = 5 THEN 700.0 ELSE (id % 9) * 10.0 - 20.0 END"


@query("pricing_candidates_uneven", f"{sql('customers')}, c AS (SELECT *, {_UNEVEN} AS est FROM customers) SELECT a.id AS i, b.id AS j, {euc('a', 'b')} AS len FROM c a JOIN c b ON a.id < b.id WHERE {euc('a', 'b')} - a.est - b.est < 0.0001")
def pricing_candidates_uneven(spark, d):
    nodes = fixture(spark, d, "customers")
    return pricing.pricing_candidates_complete(nodes, nodes.select("id", F.expr(_UNEVEN).cast("double").alias("est")), "EUC_2D")


@query("negative_edges", f"{_LENGTHS} SELECT i, j, len, rc FROM p WHERE (i + j) % 2 = 1 AND rc < -0.00001 ORDER BY rc, i, j LIMIT 20000")
def negative_edges(spark, d):
    rows = priced(spark, d).drop("x")
    return pricing.negative_edges(rows, rows.filter("(i + j) % 2 = 0"))


@query("penalty", f"{_LENGTHS} SELECT sum(least(rc, 0)) AS penalty FROM p")
def penalty(spark, d):
    return pricing.penalty(priced(spark, d))


@query("dual_bound", f"{_LENGTHS}, c AS ({sql('cuts', 'cut_pi')} SELECT sum(pi * rhs) AS s FROM cut_pi JOIN cuts USING (cut_id)), t AS (SELECT 2 * (SELECT sum(pi) FROM node_pi) + (SELECT s FROM c) + sum(CASE WHEN rc < 0 THEN rc ELSE 0 END) + sum(CASE WHEN (i + j) % 50 = 0 AND rc > 0 THEN rc ELSE 0 END) + sum(CASE WHEN (i + j) % 50 = 1 AND rc > 0 THEN rc ELSE 0 END) - sum(CASE WHEN (i + j) % 50 = 2 AND rc < 0 THEN rc ELSE 0 END) AS bound FROM p) SELECT CAST(bound AS DOUBLE) AS bound, bound > -100001 AS prunable, false AS infeasible FROM t")
def dual_bound(spark, d):
    rows = materialize(priced(spark, d), "priced")
    kind = (F.col("i") + F.col("j")) % 50
    branched = rows.filter(kind.isin(1, 2)).select("i", "j", F.when(kind == 1, 1).otherwise(0).alias("rhs"))
    return pricing.dual_bound(fixture(spark, d, "node_pi"), fixture(spark, d, "cut_pi"), fixture(spark, d, "cuts"), rows, rows.filter(kind == 0), branched, -100000)


@query("eliminate_edges", f"{_LENGTHS} SELECT i, j, len, rc, CASE WHEN (i + j) % 50 < 2 THEN 'held' WHEN rc < -4 AND (i + j) % 3 = 0 THEN 'fixed' ELSE 'kept' END AS fate FROM p WHERE rc <= 4 OR (i + j) % 50 < 2")
def eliminate_edges(spark, d):
    rows = priced(spark, d).drop("x")
    some = lambda k: rows.filter(f"(i + j) % 50 = {k}")
    return pricing.eliminate_edges(rows, 105, 100, rows.filter("(i + j) % 3 = 0"), some(0), some(1))


@query("check_integral", f"{_SETS} SELECT true AS integral, true AS connected, true AS is_tour, CAST(sum(len) AS BIGINT) AS value FROM e WHERE set_id = 1")
def check_integral(spark, d):
    e = edge_sets(spark, d).filter("set_id = 1")
    return pricing.check_integral(e.withColumn("x", F.lit(1.0)), e, load_table(spark, d, "supplier").count())


@query("fractional_edges", f"{sql('xedges')} SELECT i, j, x FROM xedges WHERE x > 0.0001 AND x < 0.9999")
def fractional_edges(spark, d):
    return pricing.fractional_edges(fixture(spark, d, "xedges")).select("i", "j", "x")


@query("most_fractional_edge", f"{sql('xedges')} SELECT i, j, x FROM xedges WHERE x > 0.0001 AND x < 0.9999 AND i % 3 <> 0 ORDER BY abs(x - 0.5), i, j LIMIT 1")
def most_fractional_edge(spark, d):
    rows = fixture(spark, d, "xedges")
    return pricing.most_fractional_edge(rows, rows.filter("i % 3 = 0")).select("i", "j", "x")


@query("subdivision_bound", "SELECT CAST(sum(b) FILTER (WHERE b >= 0) AS DOUBLE) AS bound, count(*) FILTER (WHERE b >= 0) AS n FROM (SELECT round(s_acctbal) AS b FROM supplier)")
def subdivision_bound(spark, d):
    return pricing.subdivision_bound(load_table(spark, d, "supplier").select(F.round("s_acctbal").cast("double").alias("bound")))


@query("reduced_cost_graph", f"{_LENGTHS}, b AS (SELECT i AS id, j AS nbr, len, rc FROM p UNION ALL SELECT j, i, len, rc FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rc, len, nbr) AS r FROM b) SELECT DISTINCT least(id, nbr) AS i, greatest(id, nbr) AS j, len, rc FROM k WHERE r <= 2")
def reduced_cost_graph(spark, d):
    return pricing.reduced_cost_nearest_graph(priced(spark, d), 2)


# --- streams of the events, a few files a batch

def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    rows.repartition(6, "arrival").write.parquet(path := shared_path(spark, "arrivals"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _first(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a stream of ``rows`` leaves of each key, whichever batch it comes in."""
    found, checkpoint = shared_path(spark, "first"), shared_path(spark, "stream")
    streams.append_first(_stream(spark, rows), found, checkpoint, keys).awaitTermination()
    return streams.stored(spark, found, rows.schema, keys)


_RESULTS = "WITH r AS (SELECT CAST(event_id % 300 AS BIGINT) AS id, CAST(event_id % 7 AS DOUBLE) AS rtime, CAST(round(value) - 20 AS DOUBLE) AS bound, CAST(event_id AS BIGINT) AS arrival FROM events), f AS (SELECT id, arg_min(rtime, arrival) AS rtime, arg_min(bound, arrival) AS bound FROM r GROUP BY id)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events").select((F.col("event_id") % 300).cast("long").alias("id"), (F.col("event_id") % 7).cast("double").alias("rtime"), (F.round("value") - 20).cast("double").alias("bound"), F.col("event_id").cast("long").alias("arrival"))


@query("stream_region_totals", f"{_RESULTS} SELECT count(*) AS n_done, count(*) FILTER (WHERE bound < 0) AS n_failed, sum(CASE WHEN bound >= 0 THEN bound ELSE 0 END) AS bound, sum(rtime) AS rtime FROM f")
def stream_region_totals(spark, d):
    return streams.region_totals(_first(spark, _results(spark, d), ["id"]))


@query("stream_running_totals", f"{_RESULTS} SELECT CAST(count(*) AS DOUBLE) AS n_done, CAST(count(*) FILTER (WHERE bound < 0) AS DOUBLE) AS n_failed, sum(CASE WHEN bound >= 0 THEN bound ELSE 0 END) AS bound, sum(rtime) AS rtime FROM f")
def stream_running_totals(spark, d):
    """Totals kept by the state store, batch after batch."""
    path, checkpoint = shared_path(spark, "totals"), shared_path(spark, "stream")
    changes = streams.first_changes(streams.region_values(_stream(spark, _results(spark, d))), ["id"], ["n_done", "n_failed", "bound", "rtime"])
    streams.keep_totals(changes, path, checkpoint).awaitTermination()
    return streams.running_totals(spark, path)


@query("stream_new_keys", "SELECT DISTINCT CAST(event_id % 300 AS BIGINT) AS id, CAST(event_id % 300 % 7 AS BIGINT) AS kind FROM events")
def stream_new_keys(spark, d):
    rows = _results(spark, d).select("id", (F.col("id") % 7).alias("kind"), "arrival")
    path, checkpoint = shared_path(spark, "keys"), shared_path(spark, "stream")
    streams.new_keys(_stream(spark, rows).select("id", "kind"), path, checkpoint, ["id", "kind"]).awaitTermination()
    return spark.read.parquet(path)


@query("stream_segment_gains", f"{_RESULTS}, s AS (SELECT id AS seg_id, 40 + id % 9 AS origlen FROM f), g AS (SELECT greatest(origlen - CAST(bound AS BIGINT), 0) AS g FROM f JOIN s ON seg_id = id) SELECT count(*) AS n_done, CAST(sum(g) AS BIGINT) AS gain, CAST(100000 - sum(g) AS BIGINT) AS len FROM g")
def stream_segment_gains(spark, d):
    rows = _first(spark, _results(spark, d), ["id"]).select("id", F.col("bound").cast("long").alias("newlen"))
    return streams.segment_gains(rows, rows.select(F.col("id").alias("seg_id"), (40 + F.col("id") % 9).alias("origlen")), 100000)


@query("stream_incumbent", "SELECT CAST(min(round(value)) AS BIGINT) AS len, CAST(arg_min(event_id, (round(value), event_id)) AS BIGINT) AS arrival FROM events")
def stream_incumbent(spark, d):
    rows = load_table(spark, d, "events").select(F.col("event_id").cast("long").alias("arrival"), F.round("value").cast("long").alias("len"))
    return streams.run_to_table(streams.incumbent(_stream(spark, rows)), f"incumbent_{uuid.uuid4().hex}")


@query("stream_new_cuts", "WITH c AS (SELECT 'G' AS sense, CAST(2 + event_id % 2 AS INT) AS rhs, CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS arrival FROM events) SELECT sense, rhs, key, min(arrival) AS arrival FROM c GROUP BY 1, 2, 3")
def stream_new_cuts(spark, d):
    rows = load_table(spark, d, "events").select(F.lit("G").alias("sense"), (2 + F.col("event_id") % 2).cast("int").alias("rhs"), F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("arrival"))
    return _first(spark, rows, ["sense", "rhs", "key"])
