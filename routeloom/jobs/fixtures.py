"""The given tables in the shapes of the operators: points, edges with x, tours, cliques, cuts, duals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import load_table

SQL = {
    "suppliers": "SELECT s_suppkey AS id, CAST(round(s_acctbal) AS DOUBLE) AS x, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS y FROM supplier",
    "customers": "SELECT c_custkey AS id, CAST(round(c_acctbal) AS DOUBLE) AS x, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS y FROM customer",
    "lines": "SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(100000000 + l_partkey AS BIGINT) AS j, CAST(round(l_extendedprice) AS BIGINT) AS len, round(10 * l_discount, 1) AS x, CAST(l_linenumber AS BIGINT) AS set_id FROM lineitem",
    "xedges": "SELECT i, j, max(x) AS x, max(len) AS len FROM lines GROUP BY i, j",
    "points": "SELECT event_id AS id, CAST((event_id * 7919) % 1009 AS DOUBLE) AS x, CAST(round(value) AS DOUBLE) AS y FROM events",
    "tours": "SELECT CAST(user_id AS BIGINT) AS tour_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS node FROM events",
    "members": "SELECT CAST(s_nationkey AS BIGINT) AS clique_id, CAST(s_suppkey AS BIGINT) AS node FROM supplier",
    "cut_cliques": "SELECT CAST(n_regionkey AS BIGINT) AS cut_id, CAST(n_nationkey AS BIGINT) AS clique_id FROM nation",
    "cuts": "SELECT cut_id, CAST(2 * count(*) AS INT) AS rhs FROM cut_cliques GROUP BY cut_id",
    "cut_pi": "SELECT cut_id, cut_id - 1.5 AS pi FROM cuts",
    "sets": "SELECT CAST(s_nationkey AS BIGINT) AS clique_id, CAST(s_suppkey AS BIGINT) AS node FROM supplier UNION ALL SELECT 100 + s_suppkey % 7, s_suppkey FROM supplier",
    "set_cuts": "SELECT CAST(n_regionkey AS BIGINT) AS cut_id, CAST(n_nationkey AS BIGINT) AS clique_id FROM nation UNION ALL SELECT r_regionkey, 100 + r_regionkey FROM region",
    "chain": "SELECT CAST(c_custkey AS BIGINT) AS i, CAST(c_custkey + 1 + c_nationkey % 5 AS BIGINT) AS j, CAST((1 + c_custkey % 4) / 4.0 AS DOUBLE) AS x FROM customer",
    "ladder": "SELECT CAST(c_custkey AS BIGINT) AS i, CAST(c_custkey + k AS BIGINT) AS j, CASE WHEN c_custkey % 10 + k < 10 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS x FROM customer, (SELECT unnest([1, 2, 3]) AS k) WHERE c_custkey % 10 + k < 10 OR k = 1",
    "loops": "SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_suppkey + k AS BIGINT) AS j, CASE WHEN s_suppkey % 3 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS x FROM supplier, (SELECT unnest([1, 3, 9]) AS k) WHERE (k = 1 AND s_suppkey % 13 <> 12) OR (k = 3 AND s_suppkey % 7 = 2) OR (k = 9 AND s_suppkey % 26 = 20)",
    "short_paths": "SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_suppkey + 1 AS BIGINT) AS j FROM supplier WHERE s_suppkey % 5 IN (0, 3) AND s_suppkey + 1 < (SELECT count(*) FROM supplier)",
    "space": "SELECT s_suppkey AS id, CAST(round(s_acctbal) AS DOUBLE) AS x, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS y, CAST((s_suppkey * 104729) % 9973 AS DOUBLE) AS z FROM supplier",
    "node_pi": "SELECT id, CAST(id % 7 AS DOUBLE) AS pi FROM (SELECT i AS id FROM xedges UNION SELECT j FROM xedges)",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the mapped tables."""
    load = lambda t: load_table(spark, sf_dir, t)
    if name in ("suppliers", "customers"):
        c = name[0]
        key = f"{c}_{'supp' if c == 's' else 'cust'}key"
        return load(name[:-1]).select(F.col(key).cast("long").alias("id"), F.round(f"{c}_acctbal").cast("double").alias("x"), ((F.col(key) * 7919) % 10007).cast("double").alias("y"))
    if name == "lines":
        return load("lineitem").select(
            F.col("l_suppkey").cast("long").alias("i"), (F.col("l_partkey").cast("long") + 100000000).alias("j"), F.round("l_extendedprice").cast("long").alias("len"), F.round(10 * F.col("l_discount"), 1).alias("x"), F.col("l_linenumber").cast("long").alias("set_id")
        )
    if name == "xedges":
        return fixture(spark, sf_dir, "lines").groupBy("i", "j").agg(F.max("x").alias("x"), F.max("len").alias("len"))
    if name == "points":
        return load("events").select(F.col("event_id").cast("long").alias("id"), ((F.col("event_id") * 7919) % 1009).cast("double").alias("x"), F.round("value").cast("double").alias("y"))
    if name == "tours":
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return load("events").select(F.col("user_id").cast("long").alias("tour_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_id").cast("long").alias("node"))
    if name == "members":
        return load("supplier").select(F.col("s_nationkey").cast("long").alias("clique_id"), F.col("s_suppkey").cast("long").alias("node"))
    if name == "cut_cliques":
        return load("nation").select(F.col("n_regionkey").cast("long").alias("cut_id"), F.col("n_nationkey").cast("long").alias("clique_id"))
    if name == "cuts":
        return fixture(spark, sf_dir, "cut_cliques").groupBy("cut_id").agg((2 * F.count("*")).cast("int").alias("rhs"))
    if name == "sets":
        return fixture(spark, sf_dir, "members").unionByName(load("supplier").select((100 + F.col("s_suppkey") % 7).cast("long").alias("clique_id"), F.col("s_suppkey").cast("long").alias("node")))
    if name == "set_cuts":
        return fixture(spark, sf_dir, "cut_cliques").unionByName(load("region").select(F.col("r_regionkey").cast("long").alias("cut_id"), (100 + F.col("r_regionkey")).cast("long").alias("clique_id")))
    if name == "chain":
        return load("customer").select(F.col("c_custkey").cast("long").alias("i"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 5).cast("long").alias("j"), ((1 + F.col("c_custkey") % 4) / 4.0).cast("double").alias("x"))
    if name == "ladder":
        inside = F.col("c_custkey") % 10 + F.col("k") < 10
        rows = load("customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).filter(inside | (F.col("k") == 1))
        return rows.select(F.col("c_custkey").cast("long").alias("i"), (F.col("c_custkey") + F.col("k")).cast("long").alias("j"), F.when(inside, 0.6).otherwise(0.9).alias("x"))
    if name == "loops":
        k, near = F.col("k"), F.col("s_suppkey")
        rows = load("supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(3), F.lit(9))).alias("k"))
        rows = rows.filter(((k == 1) & (near % 13 != 12)) | ((k == 3) & (near % 7 == 2)) | ((k == 9) & (near % 26 == 20)))
        return rows.select(near.cast("long").alias("i"), (near + k).cast("long").alias("j"), F.when(near % 3 == 0, 0.25).otherwise(0.5).alias("x"))
    if name == "short_paths":
        n = load("supplier").count()
        return load("supplier").filter((F.col("s_suppkey") % 5).isin(0, 3) & (F.col("s_suppkey") + 1 < n)).select(F.col("s_suppkey").cast("long").alias("i"), (F.col("s_suppkey") + 1).cast("long").alias("j"))
    if name == "space":
        return fixture(spark, sf_dir, "suppliers").withColumn("z", ((F.col("id") * 104729) % 9973).cast("double"))
    if name == "cut_pi":
        return fixture(spark, sf_dir, "cuts").select("cut_id", (F.col("cut_id") - 1.5).cast("double").alias("pi"))
    if name == "node_pi":
        return fixture(spark, sf_dir, "xedges").select(F.explode(F.array("i", "j")).alias("id")).distinct().select("id", (F.col("id") % 7).cast("double").alias("pi"))
    raise KeyError(name)


def sql(*names: str) -> str:
    """A WITH clause that defines the named tables and those they stand on."""
    needs = {"xedges": ["lines"], "cuts": ["cut_cliques"], "cut_pi": ["cut_cliques", "cuts"], "node_pi": ["lines", "xedges"]}
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*needs.get(n, []), n] if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
