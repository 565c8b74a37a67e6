"""Streams of worker results: what has arrived first, and running totals over it.

Two ways, by what a reader needs:

* Running totals. Spark's state store holds the first result of each key; a batch gives the changes
  that it makes to the totals, and the totals after it are those before it plus these changes,
  written under the batch's number, so a batch that runs again replaces what it wrote. A batch
  costs what its own rows cost, however long the stream has run.
* The results themselves. A micro-batch is reduced to the first result of each key (by arrival), keys
  that are known already go, and the rest is appended under the batch's number. Nothing is held
  in memory, but each batch reads the table's keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def first_rows(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The row of each key that arrived first; equal arrivals are told apart by the other columns."""
    others = [c for c in rows.columns if c not in (*keys, arrival)]
    return rows.groupBy(*keys).agg(F.min(F.struct(arrival, *others)).alias("_e")).select(*keys, "_e.*").select(*rows.columns)


def stored(spark: SparkSession, path: str, schema: StructType, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The first row of each key that a stream has brought below ``path`` so far."""
    return first_rows(_appended(spark, path, schema), keys, arrival)


def _appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def append_first(stream: DataFrame, path: str, checkpoint: str, keys: list[str], arrival: str = "arrival") -> StreamingQuery:
    """Start a query that appends the first row of each key to the table below ``path``; it ends when all that is there has been read.

    A row is only appended if its key is new or has come with a later arrival so far.
    """
    schema = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_rows(batch, keys, arrival)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            # A batch that runs again doesn't count what it wrote before.
            others = _appended(spark, path, schema).filter(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            known = others.groupBy(*keys).agg(F.min(arrival).alias("_known"))
            fresh = fresh.join(known, keys, "left").filter(F.col("_known").isNull() | (F.col(arrival) < F.col("_known"))).select(*schema.names)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_changes(stream: DataFrame, keys: list[str], values: list[str], arrival: str = "arrival") -> DataFrame:
    """What each batch of ``stream`` changes in the sums of ``values`` over the first row of each key, a row for each key that it changes.

    A key's first row is that of the smallest arrival (ties: the smallest values), whichever batch
    brings it: one that comes late takes the place of the one that counted before. Values are
    doubles; null counts as 0, and rows without an arrival are left out. The state store holds one
    row for each key.
    """
    columns = [arrival, *values]

    def changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        new = old
        for frame in frames:
            best = min(frame[columns].itertuples(index=False, name=None))
            new = best if new is None or best < new else new
        if new != old:
            state.update(new)
            yield pd.DataFrame([[b - (old[k] if old else 0.0) for k, b in enumerate(new) if k]], columns=values)

    rows = stream.filter(F.col(arrival).isNotNull()).select(*keys, F.col(arrival).cast("long").alias(arrival), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values])
    sums = ", ".join(f"`{c}` double" for c in values)
    return rows.groupBy(*keys).applyInPandasWithState(changes, sums, f"`{arrival}` long, {sums}", "append", GroupStateTimeout.NoTimeout)


def keep_totals(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the running sums of all columns of ``changes`` below ``path``; it ends when all that is there has been read.

    The totals after batch n stand in ``batch=n``; only those of the batch before are read for them.
    """
    columns = changes.columns

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = batch.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
        if (before := _last_batch(spark, path, number)) is not None:
            sums = spark.read.parquet(f"{path}/batch={before}").select(*columns).unionByName(sums).agg(*[F.sum(c).alias(c) for c in columns])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_batch(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The largest number of a batch (below a number) that has finished writing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def done(number: int) -> bool:
        return files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}/_SUCCESS"))

    if below is not None and below > 0 and done(below - 1):
        return below - 1
    if not files.exists(folder):
        return None
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    numbers = [int(n[6:]) for n in names if n.startswith("batch=") and (below is None or int(n[6:]) < below)]
    return max((n for n in numbers if done(n)), default=None)


def running_totals(spark: SparkSession, path: str) -> DataFrame | None:
    """One row: the totals after the last batch that :func:`keep_totals` has written below ``path``; none before the first."""
    last = _last_batch(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/batch={last}")


def region_values(results: DataFrame) -> DataFrame:
    """``results(id, rtime, bound, arrival)`` with what each adds to n_done, n_failed, bound and rtime: a negative bound is a failure and its id is done."""
    ok = F.col("bound") >= 0
    return results.select("id", "arrival", F.lit(1.0).alias("n_done"), F.when(ok, 0.0).otherwise(1.0).alias("n_failed"), F.when(ok, F.col("bound")).otherwise(0.0).alias("bound"), "rtime")


def segment_values(results: DataFrame, segments: DataFrame) -> DataFrame:
    """``results(id, newlen, arrival)`` with what each adds to n_done and gain; a segment that isn't shorter gains nothing, unknown ids are left out."""
    joined = results.join(segments.select(F.col("seg_id").alias("id"), "origlen"), "id")
    return joined.select("id", "arrival", F.lit(1.0).alias("n_done"), F.greatest(F.col("origlen") - F.col("newlen"), F.lit(0)).cast("double").alias("gain"))


def new_keys(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append the rows whose ``keys`` the state store doesn't know yet below ``path``, one of each; it ends when all that is there has been read."""
    return stream.dropDuplicates(keys).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def region_totals(results: DataFrame) -> DataFrame:
    """n_done, n_failed, bound, rtime over first ``results(id, rtime, bound)``: a negative bound is a failure and its id is done."""
    ok = F.col("bound") >= 0
    return results.agg(F.count("*").alias("n_done"), F.count_if(~ok).alias("n_failed"), F.sum(F.when(ok, F.col("bound")).otherwise(0.0)).alias("bound"), F.sum("rtime").alias("rtime"))


def remaining(results: DataFrame, regions: DataFrame) -> DataFrame:
    """part_id of the regions without a result."""
    return regions.select("part_id").join(results.select(F.col("id").alias("part_id")), "part_id", "left_anti")


def segment_gains(results: DataFrame, segments: DataFrame, tour_length: int = 0) -> DataFrame:
    """n_done, gain and the tour's length less that, over first ``results(id, newlen)``; a segment that isn't shorter gains nothing."""
    joined = results.join(segments.select(F.col("seg_id").alias("id"), "origlen"), "id")
    gain = F.greatest(F.col("origlen") - F.col("newlen"), F.lit(0))
    return joined.agg(F.count("*").alias("n_done"), F.coalesce(F.sum(gain), F.lit(0)).alias("gain")).select("n_done", "gain", (F.lit(tour_length) - F.col("gain")).alias("len"))


def incumbent(tours: DataFrame) -> DataFrame:
    """The shortest of ``tours(arrival, len)``, a stream or a table; the first to arrive wins ties."""
    return tours.agg(F.min(F.struct("len", "arrival")).alias("best")).select("best.len", "best.arrival")


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that is there; its last state as a table of this session."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def pool_cuts(stream: DataFrame, path: str, checkpoint: str, key: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append arriving ``cuts(sense, rhs, key, arrival)`` to the pool below ``path``, each content once."""
    return append_first(key(stream), path, checkpoint, ["sense", "rhs", "key"])
