"""The queries of this subpackage, each an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..jobs.session import load_table, shared_path
from .collocations import collocations
from .decontaminate import leaks
from .licenses import scan_licenses
from .minhash import minhash_components
from .pieces import encode_pieces
from .quality import quality_scores
from .sharding import shard_documents
from .simhash import simhash_components
from .spelling import spelling_variants
from .substring_index import substring_dedup
from .suffix_dedup import suffix_array_dedup
from .token_shards import read_token_shards, write_token_shards
from .urls import judge_urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that strings of 400 bytes with another copy cover, and (n_repeated) those that strings of 250 bytes with an earlier copy cover; null texts are empty."""
    return suffix_array_dedup(load_table(spark, sf_dir, "documents"), 400, keep="none", report=250, texts=False)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text of ``documents`` and what they decode to, as digests; null texts are empty."""
    return encode_pieces(load_table(spark, sf_dir, "documents"), PIECES, digests=True)


def op3_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of each url of ``pages``; null urls have no host and no path."""
    return judge_urls(load_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in each text of ``documents``; null texts have no words."""
    return scan_licenses(load_table(spark, sf_dir, "documents"))


def op5_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` left without windows of 20 words that stood earlier; null texts have no words."""
    return substring_dedup(load_table(spark, sf_dir, "documents"), window=20, texts=False)


def op6_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of each text of ``documents``, and the component that links of two bits reach; null texts have fingerprint zero."""
    return simhash_components(load_table(spark, sf_dir, "documents"), words=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts of ``documents`` hold items of ``benchmark``, a fifth of an item's words being edited at most; null texts hold none."""
    return leaks(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark")).drop("rid")


def op8_likelihood_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules, score and verdict of each text of ``documents``, against those that ``labels`` trust; null texts fail."""
    found = quality_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written to Re-Pair shards in the order of ids, and read back: place, length and checksum of each; null texts have the end id alone."""
    path = shared_path(spark, "token-shards")
    write_token_shards(load_table(spark, sf_dir, "documents"), path, WORDS, end_id=2)
    return read_token_shards(spark, path, with_ids=False)


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in eight shards of the smallest largest size, equal texts together; null texts have size one."""
    return shard_documents(load_table(spark, sf_dir, "documents"), 8)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, one run in 31 having lost a letter, with near words, forms and roots; null texts have no words."""
    return spelling_variants(load_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to five words of each language of ``documents``; null texts are empty, a null language is ``und``."""
    return collocations(load_table(spark, sf_dir, "documents"))


def op13_minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of two-word shingles have a similarity of 0.8; null and empty texts are linked with nothing."""
    return minhash_components(load_table(spark, sf_dir, "documents"))


#: All windows of all documents, each compared as a whole string.
_SUBSTRINGS = r"""
WITH listed AS (SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''), 1) AS p FROM documents),
windows AS (SELECT doc_id, p, word, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM listed WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
seen AS (SELECT doc_id, p, word, n = 20 AND row_number() OVER (PARTITION BY n, s ORDER BY doc_id, p) > 1 AS again FROM windows),
covered AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM seen),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS words FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Checksums are summed bit by bit over the table of their polynomial; near words share a word with a code point less.
_SPELLING = rf"""
WITH RECURSIVE bits AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(id || ':' || run)) + 1, 2), lambda k: ('0x' || substr(hex(encode(id || ':' || run)), k, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM counted, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM words GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
cuts AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM vocabulary)),
longer AS (SELECT DISTINCT c.word AS word, v.word AS near, v.n AS near_n, c.n AS n FROM cuts c JOIN vocabulary v ON c.rest = v.word),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word UNION ALL SELECT word, near, near_n FROM longer UNION ALL SELECT near, word, n FROM longer),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT v.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN best b ON b.word = v.word),
chains AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON e.word = f.word"""

#: Phrases of all lengths from every word on, and their cuts.
_COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?
-]') AS parts, row_number() OVER () AS doc FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(unnest(parts), '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
phrases AS (SELECT lang, k, array_to_string(w[p : p + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM listed), range(1, 6) t(k) WHERE p + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS a FROM phrases GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND d.a >= c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS before, array_to_string(w[cut + 1 : k], ' ') AS after FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = before JOIN counts y ON y.lang = c.lang AND y.phrase = after JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM weakest QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

#: All pairs of texts that share a shingle, and what their links reach.
_SHINGLES = rf"""
WITH RECURSIVE listed AS (SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split_regex({_LOWER}, '[ 	-]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM listed),
classes AS (SELECT min(doc) AS class, min(doc_id) AS first, list_sort(s) AS s, list(doc) AS docs FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
shingles AS (SELECT class, len(s) AS size, unnest(s) AS shingle FROM classes),
links AS (SELECT a.class AS i, b.class AS j FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class <> b.class GROUP BY a.class, b.class, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
reach AS (SELECT class AS i, class AS j FROM classes UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j),
least AS (SELECT i, min(first) AS component_id FROM reach JOIN classes ON class = j GROUP BY i),
placed AS (SELECT unnest(docs) AS doc, component_id FROM classes JOIN least ON i = class)
SELECT s.doc_id, len(s) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept FROM sets s LEFT JOIN placed p ON p.doc = s.doc"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_url_regression": op3_url_regression,
        "op4_license_scan": op4_license_scan,
        "op5_substring_index": op5_substring_index,
        "op6_simhash_bk_tree": op6_simhash_bk_tree,
        "op7_benchmark_leaks": op7_benchmark_leaks,
        "op8_likelihood_quality": op8_likelihood_quality,
        "op9_token_shards": op9_token_shards,
        "op10_minimax_shards": op10_minimax_shards,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_collocations": op12_collocations,
        "op13_minhash_sketch": op13_minhash_sketch,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_index": _SUBSTRINGS, "op11_spelling_variants": _SPELLING, "op12_collocations": _COLLOCATIONS, "op13_minhash_sketch": _SHINGLES}
