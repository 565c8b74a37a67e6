"""Token ids in Re-Pair compressed shards, in document order.

A shard is a row of a Parquet table: the ids of consecutive documents under a grammar of their
own, the grammar's rules with their expansion lengths, and each document's id and length. A
document is read back by expanding only its shard, or only the symbols that it touches.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, steps, text_bytes
from .grammar import compress, decode_range, decompress
from .segments import SegmentEncoder

#: Ids in a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 20

#: Text bytes in a range of documents that one task encodes, and most ranges.
RANGE_BYTES, MAX_RANGES = 1 << 24, 50_000

SHARD = "part int, no int, first_did long, first_rid long, n_docs long, n_tokens long, first_symbol int, wide boolean, dids binary, sizes binary, rules binary, rule_sizes binary, seq binary"


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer drops white space, so that words are encoded apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._load_model(path)
        self.tails = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("", ".", ",")}
        self.memory = SegmentEncoder(self._encode, 1_500_000, 10_000_000)

    def _load_model(self, path: str) -> None:
        """The vocabulary's own model, for words that the normaliser and pre-tokenizer leave as they are."""
        from tokenizers import models, pre_tokenizers

        with open(path) as file:
            spec = json.load(file)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        self.model = None
        if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and spec["model"]["type"] == "BPE":
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
            self.model = models.BPE(vocab=spec["model"]["vocab"], merges=merges, end_of_word_suffix=spec["model"]["end_of_word_suffix"], cache_capacity=0)
            alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
            own = [c for c in alphabet if ord(c) < 256]
            rest = iter(c for c in alphabet if ord(c) >= 256)  # stand, in order, for the bytes that have no character
            self.letters = {b: chr(b) if chr(b) in own else next(rest) for b in range(256)}

    @staticmethod
    def _one_word(x: str) -> bool:
        return x.isalpha() and (x.isascii() or (x == x.lower() and unicodedata.is_normalized("NFC", x)))

    def _encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of new segments. ASCII case doesn't matter, and a full stop or comma after a letter is a token of its own."""
        parts, bases = [], {}
        for x in segments:
            tail = x[-1:] if x[-1:] in (".", ",") and x[-2:-1].lower()[-1:].isalpha() else ""
            base = x[: len(x) - len(tail)]
            base = base.lower() if base.isascii() and "<" not in base else base
            parts.append((base, tail))
            if base not in bases:
                bases[base] = self.memory.known(base)
        if self.model:
            bases |= {x: [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.letters))] for x, found in bases.items() if found is None and self._one_word(x)}
        new = [x for x, found in bases.items() if found is None]
        bases |= {x: e.ids for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        return [[*bases[base], *self.tails[tail]] for base, tail in parts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        segments: list[str] = []
        ends = []
        for text in texts:
            segments += text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            ends.append(len(segments))
        ids, counts = self.memory.ids(segments)
        return np.split(ids, np.concatenate(([0], np.cumsum(counts)))[np.array(ends, np.int64)][:-1])


@lru_cache(2)
def load_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _shard_rows(path: str, end_id: int, shard_ids: int):
    def shard(held: list, first_symbol: int, no: int) -> pa.RecordBatch:
        sizes = np.array([len(x[2]) for x in held], np.int64)
        ends = np.zeros(int(sizes.sum()), bool)
        ends[np.cumsum(sizes) - 1] = True
        seq, rules, rule_sizes = compress(np.concatenate([x[2] for x in held]), ends, first_symbol)
        wide = first_symbol + len(rules) > 1 << 16
        row = {
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "no": pa.array([no], pa.int32()),
            "first_did": pa.array([held[0][0]], pa.int64()),
            "first_rid": pa.array([held[0][1]], pa.int64()),
            "n_docs": pa.array([len(held)], pa.int64()),
            "n_tokens": pa.array([len(ends)], pa.int64()),
            "first_symbol": pa.array([first_symbol], pa.int32()),
            "wide": [wide],
            "dids": pa.array([np.array([x[0] for x in held], "<i8").tobytes()], pa.binary()),
            "sizes": pa.array([sizes.astype("<u4").tobytes()], pa.binary()),
            "rules": pa.array([rules.astype("<u4").tobytes()], pa.binary()),
            "rule_sizes": pa.array([rule_sizes.astype("<u4").tobytes()], pa.binary()),
            "seq": pa.array([seq.astype("<u4" if wide else "<u2").tobytes()], pa.binary()),
        }
        return pa.record_batch(row)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        gc.disable()  # millions of small lists, none in a cycle
        first_symbol = max(tokenizer.size, end_id + 1)
        held, size, no = [], 0, 0
        for batch in steps(batches, limit=STEP_BYTES // 2):
            texts = [x.decode() for x in text_bytes(batch.column("text"))]
            for did, rid, ids in zip(batch.column("did").to_pylist(), batch.column("rid").to_pylist(), tokenizer.encode(texts)):
                if held and size + len(ids) >= shard_ids:
                    yield shard(held, first_symbol, no)
                    held, size, no = [], 0, no + 1
                held.append((did, rid, np.append(ids, np.int32(end_id))))
                size += len(ids) + 1
        if held:
            yield shard(held, first_symbol, no)

    return rows


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards of all documents in ascending id order (see ``SHARD``), ready to be written.

    ``part`` is the range of ids that a shard is from, ``no`` its place in that; together they
    give the order of all shards.

    A null text counts as empty and gives the end id alone. Null ids come first. Rows that
    share an id are ordered by a hash of their texts; each is a document. Other columns are
    ignored. No rows in, no shards out.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).cast("string").alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-total // RANGE_BYTES)))
    ordered = rows.repartitionByRange(n, "did", "rid").sortWithinPartitions("did", "rid")
    return ordered.mapInArrow(_shard_rows(tokenizer_path, end_id, shard_ids), SHARD)


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, **options) -> None:
    token_shards(docs, tokenizer_path, end_id, **options).write.parquet(path)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seq = np.frombuffer(row["seq"], "<u4" if row["wide"] else "<u2")
    return seq, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_sizes"], "<u4")


def _document_rows(with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                seq, rules, rule_sizes = _opened(row)
                ids = decompress(seq, rules, row["first_symbol"], rule_sizes).astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != row["n_tokens"] or ends[-1] != len(ids):
                    raise ValueError("a shard doesn't expand to the length that it states")
                raw = memoryview(ids.tobytes())
                out = {
                    "doc_id": pa.array([None if x == -(2**63) else x for x in np.frombuffer(row["dids"], "<i8").tolist()], pa.int64()),
                    "start": row["start"] + ends - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array(np.split(ids.astype(np.int32), ends[:-1]), pa.list_(pa.int32()))
                yield pa.record_batch(out)

    return rows


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of written shards: doc_id, start (ids before it), n_tokens, ids_crc32 and ids."""
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "no", "n_tokens")
    # As many rows as there were ranges; the shards of a range are summed up apart from the others.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(bases, "part").select("part", "no", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))
    return shards.join(starts, ["part", "no"]).mapInArrow(_document_rows(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_tokens(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document; of its shard only the symbols that it touches are expanded.

    The shards that may hold it are found by their narrow columns: the last one that begins with a
    smaller id, and those that begin with this one. ``KeyError`` if no document has the id,
    ``ValueError`` if several have.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    order = [F.desc("part"), F.desc("no")]
    below = shards.filter(F.col("first_did") < doc_id).select("part", "no").orderBy(*order).limit(1).collect()
    same = shards.filter(F.col("first_did") == doc_id).select("part", "no").orderBy(*order).limit(2).collect()
    found: list[list[int]] = []
    for part, no in (tuple(r) for r in [*below, *same]):
        row = shards.filter((F.col("part") == part) & (F.col("no") == no)).first().asDict()
        dids = np.frombuffer(row["dids"], "<i8")
        ends = np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64))
        first, last = np.searchsorted(dids, doc_id), np.searchsorted(dids, doc_id, side="right")
        for at in range(int(first), min(int(last), int(first) + 2)):
            found.append(decode_range(*_opened(row), row["first_symbol"], int(ends[at - 1]) if at else 0, int(ends[at])).tolist())
    if not found:
        raise KeyError(doc_id)
    if len(found) > 1:
        raise ValueError(f"several documents have the id {doc_id}")
    return found[0]
