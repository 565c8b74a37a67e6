"""Session helpers that every job shares: tables in, tables out, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a finished write; its rows are in the written table by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once: whole texts are long, and workers share an executor's memory.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_table(df: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    """Write ``<folder>/<name>.parquet``."""
    df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (unit tests) a temporary one is
    set; on a cluster that would be another folder on each machine, so ``ValueError`` is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="routeloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"


#: Joins shuffle unless ``F.broadcast`` says otherwise, and a task takes few compressed bytes: Spark goes by the size
#: of Parquet and shuffle files, of which a broadcast table in the driver or a task's hash table is many times as large.
_TASKS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "8m"}
#: Shuffles start with as many partitions as the session says or with one for so many bytes of the tables' files; what is small is put together.
_PARTS, _PART_BYTES = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 2 << 20


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


@contextmanager
def small_tasks(spark: SparkSession, folder: str | None = None):
    """Within it, memory of the driver and of a task doesn't grow with the tables, which are below ``folder``."""
    found = folder_bytes(spark, folder) if folder else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found // _PART_BYTES))
    with ExitStack() as stack:
        for key, value in {**_TASKS, _PARTS: str(parts)}.items():
            stack.enter_context(_setting(spark, key, value))
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared folder and read it back.

    This cuts the lineage at a table that survives the loss of any executor, and its rows
    are computed once however often they are used.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with _setting(spark, _CLEANUP, "true"), _setting(spark, _BATCH, _BATCH_ROWS):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables from :func:`materialize` that no later step reads, to keep long jobs' disk use down.

    Call it only once everything that was derived from them is written itself.
    """
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if "/tables/" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
