"""URL filter: list rules, and logistic regression on hashed character n-grams of host and path.

The model is trained from a small table of labelled urls. The one that comes with the library is put
together from words of sites that a corpus of prose has no use for (gambling, adult, pills, loans,
pirated software) and of sites that it wants, and of invented names; the rules have no part in it,
so the model says something of urls that they don't name. Another table can be given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host with its subdomains, and a prefix of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

FEATURES = 1 << 13
#: Labelled urls to train on, at most.
TRAINED = 4000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-case) and path; both empty if there is no ``://`` or no url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams (3 to 5) of host and path, each once."""
    found = []
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode()
        found += [xxhash.xxh32_intdigest(data[k : k + n], n * 2 + (kind == "p")) % FEATURES for n in (3, 4, 5) for k in range(len(data) - n + 1)]
    return np.unique(np.array(found, np.int64))


def train(rows: list[tuple[str, str, bool]], rounds: int = 300, rate: float = 20.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression that predicts blocking; full-batch gradient steps."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not rows or len({x[2] for x in rows}) < 2:
        return weights, -1.0 if not rows or not rows[0][2] else 1.0
    found = [features(h, p) for h, p, _ in rows]
    row, column = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in found])
    wanted = np.array([x[2] for x in rows], float)
    for _ in range(rounds):
        score = np.bincount(row, weights[column], len(found)) * scale + bias
        error = (1 / (1 + np.exp(-score)) - wanted) / len(found)
        weights -= rate * (np.bincount(column, (error * scale)[row], FEATURES) + decay * weights)
        bias -= rate * error.sum()
    return weights, float(bias)


#: What names of sites are made of: words of unwanted ones, of wanted ones, and syllables of invented names.
UNWANTED = ("adult", "bet", "bonus", "cam", "casino", "cheap", "crack", "dating", "escort", "gamble", "jackpot", "keygen", "loan", "nude", "payday", "pills", "poker", "porn", "replica", "roulette", "sex", "slots", "torrent", "viagra", "warez", "xxx")
WANTED = ("archive", "art", "blog", "books", "city", "docs", "film", "forum", "garden", "health", "history", "journal", "library", "museum", "music", "news", "notes", "recipes", "school", "science", "sports", "story", "travel", "university", "weather", "wiki")
SYLLABLES = ("an", "ber", "con", "er", "ing", "ka", "lo", "mi", "on", "ra", "sh", "st", "ter", "th", "tion", "ve")
ENDINGS = ("24", "4u", "best", "club", "free", "hub", "live", "now", "online", "shop", "win", "x")


def labelled_table(rows: int = TRAINED) -> list[tuple[str, str, bool]]:
    """host, path, blocked of ``rows`` made-up urls, a third of each kind; a row follows from its number."""
    found = []
    for k in range(rows):
        seed = xxhash.xxh64_intdigest(b"%d" % k)

        def pick(words: tuple[str, ...], n: int) -> str:
            return words[xxhash.xxh32_intdigest(b"%d" % seed, n) % len(words)]

        kind = k % 3
        words = (UNWANTED, WANTED, SYLLABLES)[kind]
        name = pick(words, 1) + (pick(("-", ""), 2) + pick(ENDINGS if kind == 0 or seed % 5 == 0 else words, 3) if kind < 2 else pick(words, 4) + pick(words, 5) * (seed % 2))
        host = f"{pick(('', '', 'www.', 'm.', 'blog.', 'shop.'), 6)}{name}.{pick(('com', 'net', 'org', 'info', 'example.com', 'example.net', 'example.org', 'co.uk', 'de'), 7)}"
        path = f"/{pick(('en', 'de', 'fr', 'es', 'page', 'article', ''), 8)}/{seed % 10_000}{pick(('', '/', '.html'), 9)}"
        found.append((host, path, kind == 0))
    return found


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every url: the longest fitting rule's, else the model's.

    ``labelled`` (host, path, blocked): the training table, of which at most ``TRAINED`` rows
    are used; by default :func:`labelled_table`. Returns page_id, host, path, rule, verdict and
    block_probability. A null url, or one without ``://``, has an empty host and path; there is
    nothing to judge, so it is allowed, with a probability of 0. Without two kinds of labels the
    model allows, unless all are blocked.
    Repeated rows and null ids come back as they are; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    sample = labelled_table() if labelled is None else [tuple(r) for r in labelled.select("host", "path", "blocked").orderBy(F.xxhash64("host", "path"), "host", "path").limit(TRAINED).collect()]
    weights, bias = train(sample)

    @F.pandas_udf("double")
    def probability(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            found = [features(h, p) for h, p in zip(hosts, paths)]
            yield pd.Series([1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))) for x in found], dtype=float)

    blocked = F.create_map(*[F.lit(x) for r in rules for x in r])
    named = (F.col("host") != "") | (F.col("path") != "")
    scored = rows.withColumn("block_probability", F.when(named, probability("host", "path")).otherwise(0.0))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(blocked[F.col("rule")], F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability")
