"""Which sets or multisets are equal: keys bring candidates together, their parts decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize


def equal_classes(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """item, first: for each item of ``keys`` (item, key) the smallest one with the same parts (item, part; repeats count).

    Equal items must have equal keys; the reverse isn't taken for granted. Of the items of a key all
    are compared part by part with the smallest one; those that differ, which takes a collision
    of the keys, go on to a round of their own with the smallest of them.
    """
    counted = materialize(parts.groupBy("item", "part").agg(F.count("*").alias("n")), "parts")
    sizes = counted.groupBy("item").agg(F.count("*").alias("size"))
    open_, found = materialize(keys.select("item", "key").join(sizes, "item", "left").select("item", "key", F.coalesce("size", F.lit(0)).alias("size")), "items"), None
    while True:
        first = open_.groupBy("key").agg(F.min(F.struct("item", "size")).alias("first"))
        pairs = materialize(open_.join(first, "key").select("item", "key", "size", F.col("first.item").alias("first"), F.col("first.size").alias("first_size")), "pairs")
        others = pairs.filter("item != first and size = first_size").select("item", "first")
        shared = others.join(counted, "item").join(counted.withColumnRenamed("item", "first"), ["first", "part", "n"]).groupBy("item").agg(F.count("*").alias("shared"))
        judged = materialize(pairs.join(shared, "item", "left").withColumn("equal", (F.col("item") == F.col("first")) | ((F.col("size") == F.col("first_size")) & (F.coalesce("shared", F.lit(0)) == F.col("size")))), "judged")
        same = judged.filter("equal").select("item", "first")
        found = same if found is None else found.unionByName(same)
        open_ = judged.filter("not equal").select("item", "key", "size")
        if not open_.take(1):
            return found
