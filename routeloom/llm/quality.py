"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio, natively in Spark.

Word unigrams and bigrams are hashed into a fixed number of buckets. The corpus multinomial is
counted over all documents, the target multinomial over half of all trusted ones; a document's
score is the mean over its n-grams of ``ln(p_target / p_corpus)``. Documents under a threshold,
which is taken from the scores of all of the other half, go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize
from ..operators.ranking import ranked
from .common import named, row_key

BUCKETS = 1 << 16

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"array_remove(split(t, r'{_SPACE}'), '')"

#: 64-bit hashes of all 5-word windows; then the words that windows seen twice cover.
_REPEATS = f"""
transform(array(transform({_WORDS}, w -> xxhash64(w))), a ->
  if(size(a) < 5, 0L, transform(array(transform(sequence(0, size(a) - 5), i -> xxhash64(a[i], a[i+1], a[i+2], a[i+3], a[i+4]))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
        transform(array(sort_array(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
          aggregate(p, struct(0L as n, -5 as last), (c, i) -> struct(c.n + least(5, i - c.last) as n, i as last), c -> c.n)
        )[0]
      )[0]
    )
  )[0])
)[0]
"""


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, rid and the counts of each text; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    lines = r"filter(split(t, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"
    return rows.select(
        "doc_id",
        "rid",
        F.expr(f"cast(size({_WORDS}) as bigint)").alias("n_words"),
        F.expr(f"cast(char_length(array_join({_WORDS}, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(t, r'[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(f"cast(size({lines}) - size(array_distinct({lines})) as bigint)").alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )


def _grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.col(text_col)).alias("rid"), F.expr(_WORDS.replace("(t,", f"(coalesce(cast(`{text_col}` as string), ''),")).alias("w")
    )
    buckets = f"""concat(
      transform(w, x -> cast(xxhash64(x) & {BUCKETS - 1} as int)),
      zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (x, y) -> cast(xxhash64(x, y) & {BUCKETS - 1} as int)))"""
    return rows.select("did", "rid", F.explode(F.expr(buckets)).alias("bucket"))


def _trusted(labels: DataFrame) -> DataFrame:
    """did, part: all documents labelled good, halved by a hash; part 0 makes the target, part 1 the threshold."""
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.min("quality").alias("q")).filter("q = 1")
    return good.select("did", F.pmod(F.xxhash64("did", F.lit(1)), F.lit(2)).cast("int").alias("part"))


def likelihood_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5) -> DataFrame:
    """bucket, ratio: smoothed ``ln(p_target / p_corpus)``; at most ``BUCKETS`` rows, which are written."""
    target = trusted.filter("part = 0").select("did").hint("shuffle_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col)).join(target, "did", "left_semi")
    good = _grams(texts, "did", text_col).groupBy("bucket").agg(F.count("*").alias("good"))
    raw = _grams(docs, id_col, text_col).groupBy("bucket").agg(F.count("*").alias("raw"))
    counts = materialize(raw.join(good, "bucket", "left").select("bucket", "raw", F.coalesce("good", F.lit(0)).alias("good")), "bucket-counts")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    p_good = (F.col("good") + prior) / ((good or 0) + prior * BUCKETS)
    p_raw = (F.col("raw") + prior) / ((raw or 0) + prior * BUCKETS)
    return counts.select("bucket", (F.log(p_good / p_raw) if good else F.lit(0.0)).alias("ratio"))


def _quantiles(rows: DataFrame, value: str, order: list[str], fractions: list[float]) -> list[float | None]:
    """Exact quantiles of all rows, between two ranks in proportion; no task holds them all."""
    rows = materialize(rows, "quantile-rows")
    n = rows.count()
    if not n:
        return [None] * len(fractions)
    at = [f * (n - 1) for f in fractions]
    wanted = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    found = {r["rank"]: r[value] for r in ranked(rows, [value, *order]).filter(F.col("rank").isin(wanted)).collect()}  # two rows a fraction
    return [found[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * found[math.floor(x)] + (x - math.floor(x)) * found[math.ceil(x)] for x in at]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", below: float = 0.001, margin: float = 0.5) -> DataFrame:
    """Counts, score and verdict for each row of ``docs``.

    ``labels`` (doc_id, quality): documents with quality 1 (in all their rows) are trusted.
    The threshold is the ``below`` quantile of the scores of all trusted documents that didn't
    make the target multinomial, less ``margin`` times the distance from there to their median.
    Returns doc_id, rid, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed and kept. Null texts count as empty and fail; without trusted documents the
    score is 0 and the base rules decide. Repeated rows get equal verdicts.
    """
    trusted = materialize(_trusted(labels), "trusted")
    ratios = likelihood_ratios(docs, trusted, id_col, text_col)
    grams = _grams(docs, id_col, text_col).join(F.broadcast(ratios), "bucket")  # BUCKETS rows at most
    scores = materialize(grams.groupBy("did", "rid").agg((F.sum("ratio") / F.count("*")).alias("score")), "scores")
    held_out = scores.join(trusted.filter("part = 1").select("did"), "did", "left_semi")
    low, mid = _quantiles(held_out, "score", ["did", "rid"], [below, 0.5])
    threshold = float("-inf") if low is None else low - margin * (mid - low)
    counts = text_counts(docs, id_col, text_col).withColumn("did", F.coalesce("doc_id", F.lit(-(2**63))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.join(scores, ["did", "rid"], "left").select(
        "doc_id", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("score", F.lit(0.0)).alias("score"), failed.alias("base_failed"), (~failed & (F.coalesce("score", F.lit(0.0)) >= F.lit(threshold))).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep (see :func:`quality_scores`), all columns as they are, whatever their names.

    Rows with a null or empty text go; rows that repeat an id and a text stay or go together.
    """
    kept = quality_scores(docs, labels, id_col, text_col, **options).filter("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), "rid").distinct()
    source, back = named(docs)
    rows = source.select("*", *row_key(back[id_col], back[text_col]))
    return rows.join(kept, ["did", "rid"], "left_semi").select(*[F.col(c).alias(name) for name, c in back.items()])
