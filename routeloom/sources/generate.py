"""Random instances from hashes of ids and a seed: the same rows however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import edge_lengths, oriented
from ..jobs.session import materialize
from ..operators.ranking import ranked
from ..operators.tours import tour_length


def _below(limit: int, *parts) -> Column:
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(limit).cast("long"))


def random_points(spark: SparkSession, n: int, grid: int, seed: int, dups: bool = True, dims: str = "xy") -> DataFrame:
    """id, x, y (and z with ``dims`` xyz): integers in [0, grid); without ``dups`` all points differ."""
    def draw(count: int) -> DataFrame:
        return spark.range(count).select("id", *[_below(grid, F.col("id"), seed, k).cast("double").alias(c) for k, c in enumerate(dims)])

    if dups:
        return draw(n)
    cells = grid ** len(dims)
    if n > cells // 2:
        raise ValueError(f"{n} different points on {cells} places: at most half of them can be taken")
    once = draw(2 * n + 64).groupBy(*dims).agg(F.min("id").alias("id"))
    return ranked(once, ["id"], name="rank").filter(F.col("rank") < n).select(F.col("rank").alias("id"), *dims)


def random_geo(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, x in [-90, 90), y in [-180, 180)."""
    part = lambda k: _below(10**9, F.col("id"), seed, k) / 1e9
    return spark.range(n).select("id", (part(0) * 180 - 90).alias("x"), (part(1) * 360 - 180).alias("y"))


def random_matrix(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """i, j, len of all pairs i < j with lengths in [0, 10 n)."""
    pairs = spark.range(max(n - 1, 0)).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("j"))
    return pairs.select("i", "j", _below(10 * n, F.col("i"), F.col("j"), seed).alias("len"))


def random_edges(spark: SparkSession, n: int, m: int, maxlen: int, seed: int) -> DataFrame:
    """i, j, len: m different edges without loops, lengths in [0, maxlen)."""
    most = n * (n - 1) // 2
    if m > most:
        raise ValueError(f"{m} edges on {n} nodes")
    if 4 * m > most:
        rows = random_matrix(spark, n, seed).select("i", "j", F.xxhash64("i", "j", F.lit(seed)).alias("key"))
    else:
        drawn = spark.range(2 * m + 64).select(_below(n, F.col("id"), seed, 0).alias("i"), _below(n, F.col("id"), seed, 1).alias("j"), F.col("id").alias("key"))
        rows = oriented(drawn).groupBy("i", "j").agg(F.min("key").alias("key"))
    return ranked(rows, ["key", "i", "j"], name="rank").filter(F.col("rank") < m).select("i", "j", _below(maxlen, F.col("i"), F.col("j"), seed, 2).alias("len"))


def random_edges_of(nodes: DataFrame, m: int, norm: str, seed: int) -> DataFrame:
    """i, j, len: m different edges between ``nodes`` (ids 0 to n - 1), lengths by the norm."""
    drawn = random_edges(nodes.sparkSession, nodes.count(), m, 1, seed)
    return edge_lengths(drawn, nodes, norm)


def random_weights(spark: SparkSession, n: int, limit: int, seed: int) -> DataFrame:
    """id, w in [0, limit)."""
    return spark.range(n).select("id", _below(limit, F.col("id"), seed).cast("double").alias("w"))


def random_tour(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """tour_id, pos, node: the nodes in the order of a hash."""
    rows = spark.range(n).select(F.col("id").alias("node"), F.xxhash64("id", F.lit(seed)).alias("key"))
    return ranked(rows, ["key", "node"], name="pos").select(F.lit(0).cast("long").alias("tour_id"), "pos", "node")


def random_tour_of(nodes: DataFrame, norm: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """A tour of ``nodes`` (ids 0 to n - 1) in the order of a hash, and its length (tour_id, len)."""
    tour = materialize(random_tour(nodes.sparkSession, nodes.count(), seed), "random-tour")
    return tour, tour_length(tour, nodes, norm)
