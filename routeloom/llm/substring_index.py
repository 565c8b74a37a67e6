"""Substring deduplication over an incremental, log-structured fingerprint index.

The index is a set of immutable runs, each a Parquet table sorted by fingerprint. A fingerprint
is the hash of an anchor (see :mod:`.anchors`) of the windows that were seen, with the hash of
the words of its stretch of windows and where it stood first. A new batch is merge-joined with
all runs by fingerprint. Stretches of equal fingerprint and equal hash of all their words, 128 bits
together, count as equal and are settled at once; where the hashes differ, their windows are taken
from the texts and compared by digests of their words. An index that outlives a job keeps the texts of its batches beside its runs
for that. The batch itself is a run, sorted where it was read; it joins the index once it has been
compared. Once there are many, runs are compacted to one, in which equal stretches are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.session import materialize, release, shared_path
from .anchors import runs
from .common import WORD_HASHES, expand, text_bytes
from .suffix_dedup import keyed

_RUN = "did long, rid long, lo long, n int, key long, content long"
_TEXT = "did long, rid long, text string"
_MANIFEST = "version long, runs array<string>, texts array<string>"
_STEP_WORDS = 200_000


def _run_rows(window: int, gram: int):
    def flush(held: list) -> pa.RecordBatch:
        words = [w for x in held for w in x[3]]
        sizes = np.array([len(x[3]) for x in held], np.int64)
        ends = np.cumsum(sizes)
        symbols = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
        lo, hi, _, key = runs(symbols, ends, window, gram)
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        digest = xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(joined[a:b]) for a, b in zip(starts[lo].tolist(), stops[hi + window - 1].tolist())), np.uint64, len(lo))
        piece = np.searchsorted(ends, lo, side="right")
        shift = np.array([x[2] for x in held], np.int64)[piece] - (ends - sizes)[piece]
        did, rid = (np.array([x[k] for x in held], np.int64)[piece] for k in (0, 1))
        columns = [did, rid, lo + shift, (hi - lo + 1).astype(np.int32), key, content.view(np.int64)]
        return pa.record_batch(columns, names=["did", "rid", "lo", "n", "key", "content"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for did, rid, text in zip(batch.column("did").to_pylist(), batch.column("rid").to_pylist(), text_bytes(batch.column("text"))):
                words = text.split()
                for base in range(0, max(0, len(words) - window + 1), _STEP_WORDS):
                    held.append((did, rid, base, words[base : base + _STEP_WORDS + window - 1]))
                    size += len(held[-1][3])
                    if size >= _STEP_WORDS:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return rows


def _window_rows(window: int):
    """Digests of the windows of the stretches listed for each document; place -1 for one without a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            absent = batch.column("text").is_null().to_pylist()
            for did, rid, text, listed, gone in zip(batch.column("did").to_pylist(), batch.column("rid").to_pylist(), text_bytes(batch.column("text")), batch.column("listed").to_pylist(), absent):
                if gone:
                    yield pa.record_batch([pa.array([x], pa.int64()) for x in (did, rid, -1, 0, 0)], names=["did", "rid", "lo", "a", "b"])
                    continue
                words = text.split()
                joined = b" ".join(words)
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate(([0], stops[:-1] + 1))
                at = np.unique(expand(np.array([r["lo"] for r in listed], np.int64), np.array([r["n"] for r in listed], np.int64)))
                halves = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts[at].tolist(), stops[at + window - 1].tolist())]), np.int64)
                yield pa.record_batch([np.full(len(at), did), np.full(len(at), rid), at, halves[::2].copy(), halves[1::2].copy()], names=["did", "rid", "lo", "a", "b"])

    return rows


class SubstringIndex:
    """Runs of a fingerprint index below ``path``; a manifest table lists the current ones."""

    def __init__(self, spark: SparkSession, path: str, window: int = 20, gram: int = 4, max_runs: int = 8):
        self.spark, self.path, self.window, self.gram, self.max_runs = spark, path, window, min(gram, window), max_runs
        self.runs: list[str] = []
        self.texts: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SubstringIndex:
        """The index that earlier jobs left at ``path``."""
        index = cls(spark, path, **options)
        last = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        index.runs, index.texts = list(last["runs"]), list(last["texts"] or [])
        return index

    def _commit(self, runs_: list[str], texts: list[str], version: int) -> None:
        self.spark.createDataFrame([(version, runs_, texts)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.runs, self.texts = runs_, texts

    def _version(self) -> int:
        return 1 + max([0, *(int(r.rsplit("-", 1)[1]) for r in self.runs)])

    def _write(self, rows: DataFrame, version: int) -> str:
        # A version that isn't in the manifest is what a job that ended early left.
        path = f"{self.path}/run-{version:08d}"
        rows.select(*[x.split()[0] for x in _RUN.split(", ")]).sortWithinPartitions("key", "content").write.mode("overwrite").parquet(path)
        return path

    def history(self) -> DataFrame:
        """All runs' rows."""
        parts = [self.spark.read.schema(_RUN).parquet(r) for r in self.runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _RUN)

    @staticmethod
    def _first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "content").agg(F.min(F.struct("did", "rid", "lo", "n")).alias("rep"))

    def _kept(self, batch: DataFrame, version: int) -> tuple[str, DataFrame]:
        """Write the batch's texts; its path, and the texts of all batches that were kept."""
        path = f"{self.path}/text-{version:08d}"
        batch.select("did", "rid", "text").write.mode("overwrite").parquet(path)
        return path, self.spark.read.schema(_TEXT).parquet(*self.texts, path)

    def add(self, batch: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Windows of ``batch`` (from :func:`keyed`) that stood earlier, as did, rid, lo, n.

        ``corpus``: the texts behind the index and the batch, from which windows are verified.
        Without it the index keeps the batch's texts and verifies windows from all that it kept.
        If a document of the index has to be compared whose text is in neither, ``ValueError``
        is raised and the index stays as it was.
        A batch's documents come after those of earlier batches in (did, rid) order. The batch
        is a run of the index afterwards.
        """
        version, history, kept = self._version(), self.history(), self.texts
        if corpus is None:
            path, corpus = self._kept(batch, version)
            kept = [*kept, path]
        run = self._write(batch.mapInArrow(_run_rows(self.window, self.gram), _RUN), version)
        members = self.spark.read.schema(_RUN).parquet(run)
        counts = members.select("key", F.lit(1).alias("new")).unionByName(history.select("key", F.lit(0).alias("new")))
        shared = counts.groupBy("key").agg(F.count("*").alias("m"), F.max("new").alias("new")).filter("m > 1 and new = 1").select("key")
        mine = materialize(members.join(shared, "key"), "batch-shared")
        past = history.join(shared, "key") if self.runs else history
        classes = materialize(self._first(mine.unionByName(past)), "batch-classes")
        copies = mine.join(classes, ["key", "content"]).filter("did != rep.did or rid != rep.rid or lo != rep.lo").select("did", "rid", "lo", "n")
        mixed = classes.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
        listed = classes.join(mixed, "key").select("rep.*").groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "n")).alias("listed"))
        texts = listed.join(corpus, ["did", "rid"], "left")
        windows = materialize(texts.mapInArrow(_window_rows(self.window), "did long, rid long, lo long, a long, b long"), "batch-windows")
        missing = windows.filter("lo < 0").count() if self.runs else 0
        if missing:
            raise ValueError(f"the texts of {missing} documents of the index are needed and neither kept nor in corpus")
        firsts = windows.groupBy("a", "b").agg(F.min(F.struct("did", "rid", "lo")).alias("rep"), F.count("*").alias("m")).filter("m > 1").drop("m")
        later = windows.join(firsts, ["a", "b"]).filter("did != rep.did or rid != rep.rid or lo != rep.lo")
        found = materialize(copies.unionByName(later.select("did", "rid", "lo", F.lit(1).alias("n"))), "hits")
        self._commit([*self.runs, run], kept, version)
        release(mine, classes, windows)
        if len(self.runs) > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs to one; each fingerprint and stretch keeps its first place."""
        version = self._version()
        self._commit([self._write(self._first(self.history()).select("key", "content", "rep.*"), version)], self.texts, version)


def _result_rows(window: int, texts_out: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
            if texts_out:
                out["kept"] = []
            for did, text, listed in zip(batch.column("did").to_pylist(), text_bytes(batch.column("text")), batch.column("listed").to_pylist()):
                words = text.split()
                kept = words
                if listed:
                    gone = np.zeros(len(words) + 1, np.int64)
                    lo = np.array([r["lo"] for r in listed], np.int64)
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, lo + np.array([r["n"] for r in listed], np.int64) - 1 + window, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    kept = [words[k] for k in stay.tolist()]
                joined = b" ".join(kept)
                row = [None if did == -(2**63) else did, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()]
                for column, value in zip(out.values(), row):
                    column.append(value)
            kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return rows


def substring_dedup(docs: DataFrame, window: int = 20, batches: int = 2, index: SubstringIndex | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove each word of a window of ``window`` words that also starts earlier.

    Documents are added to an index in ``batches`` ranges of ids. By default that is a new one;
    an ``index`` of earlier calls, whose documents come first, keeps the texts that it is given, so
    calls with parts of a table give what one call with all of it does. Returns
    doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and, with
    ``texts``, ``kept``. Null texts have no words, null ids come first; rows that repeat an id
    are ordered by a hash of their texts, and those with the same text too are one document.
    No rows in, no rows out; other columns are ignored.
    """
    rows, lasting = keyed(docs, id_col, text_col), index is not None
    index = index or SubstringIndex(docs.sparkSession, shared_path(docs.sparkSession, "substring-index"), window, max_runs=1)
    if index.window != window:
        raise ValueError(f"the index has windows of {index.window} words")
    edges = rows.select(F.percentile_approx("did", [k / batches for k in range(1, batches)]).alias("e")).first()["e"] if batches > 1 else []
    edges = sorted(set(edges or []))
    found = None
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows if low is None else rows.filter(F.col("did") > low)
        part = part if high is None else part.filter(F.col("did") <= high)
        corpus = rows if high is None else rows.filter(F.col("did") <= high)
        hits = index.add(part, None if lasting else corpus)
        found = hits if found is None else found.unionByName(hits)
    hits = found.groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "n")).alias("listed"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return rows.join(hits, ["did", "rid"], "left").select("did", "text", "listed").mapInArrow(_result_rows(window, texts), schema)
