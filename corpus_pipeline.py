"""A corpus from raw documents: quality, near-duplicates, repeated strings, benchmark leaks, token ids.

Every stage takes documents with any columns besides doc_id and text, in any order, and none at
all. Rows with a null id are documents of their own; rows that repeat an id and a text are judged
together, and near-duplicate removal leaves one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.jobs.session import load_table, materialize
from routeloom.llm.decontaminate import drop_leaks
from routeloom.llm.pieces import encode_pieces
from routeloom.llm.quality import keep_good
from routeloom.llm.near_dedup import near_distinct
from routeloom.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    return keep_good(docs, load_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; null texts are one group."""
    return near_distinct(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of strings of 200 bytes or more: passages of 50 words are about 300 bytes.

    The first copy in the order of ids stays; a null text stays null.
    """
    return remove_repeats(docs, min_bytes=200).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none."""
    return drop_leaks(docs, load_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, byte offsets and digests of what is left; a null text has no ids."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: Hashing, walks and tokenizers are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
