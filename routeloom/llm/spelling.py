"""Spelling variants: words one edit apart, found with search schemes on bidirectional FM-indexes.

Two words that differ by one inserted, deleted or replaced code point agree, as far as the shorter
one's halves go, in the first half or in the second one. So the vocabulary is dealt to groups of
words that share a half (of the length of the shorter word of a pair); groups that are too large
are dealt again by halves of what is left between the parts that they share, until they fit. A
task packs whole groups, builds one index over their delimited words, and searches it with each
group's shorter words as patterns:

* The index holds the rotations of every delimited word in order, once of the words and once of
  the reversed words. A pattern's interval of ranks is kept in both, so it can be extended by a
  code point on either side.
* The scheme of a group with a common first half matches that half exactly and extends to the
  right, one error being allowed up to the last part that is shared; that of a second half extends
  to the left. An interval that is closed by delimiters on both sides is the rank of a word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize
from .common import expand, named
from .near_dedup import _roots

_RUNS = re.compile("[a-zÀ-ÿ]+")
_SPLIT = re.compile("[^a-zÀ-ÿ]")
#: Bytes of a run up to which its checksum comes from tables; longer ones are summed one by one.
_SHORT = 64
_HELD, _STEP = 300_000, 1 << 20


class _Runs(dict):
    """Numbers of the distinct runs at hand, with what their checksums and lengths are."""

    def __init__(self):
        self.words, self.sums, self.sizes, self.points = [], [], [], []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self.words)
        raw = word.encode()
        self.words.append(word)
        self.sizes.append(len(raw))
        self.points.append(len(word))
        # A checksum is linear: crc(prefix + run) = crc(prefix + zeros) ^ crc(run) ^ crc(zeros).
        self.sums.append(zlib.crc32(raw) ^ zlib.crc32(bytes(len(raw))) if len(raw) <= _SHORT else 0)
        return k


def _parts(text: str) -> Iterator[str]:
    """A text in steps of about a million letters, cut where no run is."""
    start = 0
    while len(text) - start > _STEP:
        end = _SPLIT.search(text, start + _STEP)
        if not end:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:]


def _variant_rows(every: int, least: int):
    """word, n: what runs become once one in ``every`` has lost a code point; those of ``least`` code points."""

    def flush(runs: _Runs, counts: np.ndarray, changed: dict[str, int]) -> pa.RecordBatch:
        words = [w for w, p, n in zip(runs.words, runs.points, counts.tolist()) if n and p >= least]
        sums = [n for p, n in zip(runs.points, counts.tolist()) if n and p >= least]
        return pa.record_batch([pa.array(words + list(changed), pa.string()), pa.array(sums + list(changed.values()), pa.int64())], names=["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts, changed = _Runs(), np.zeros(0, np.int64), {}
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                prefix = b":" if doc is None else b"%d:" % doc
                zeros = [zlib.crc32(prefix)]
                for _ in range(_SHORT):
                    zeros.append(zlib.crc32(b"\0", zeros[-1]))
                shifted = np.array(zeros, np.uint32)
                for part in _parts((raw or b"").lower().decode("utf-8", "replace")):
                    found = np.array(list(map(runs.__getitem__, _RUNS.findall(part))), np.int64)
                    if not len(found):
                        continue
                    present, back = np.unique(found, return_inverse=True)
                    present_list = present.tolist()
                    sizes, points = (np.array([x[k] for k in present_list], np.int64) for x in (runs.sizes, runs.points))
                    sums = shifted[np.minimum(sizes, _SHORT)] ^ np.array([runs.sums[k] for k in present_list], np.uint32)
                    for x in np.flatnonzero(sizes > _SHORT).tolist():
                        sums[x] = zlib.crc32(runs.words[present_list[x]].encode(), zeros[0])
                    hit = sums % every == 0
                    many = np.bincount(back)
                    if len(counts) < len(runs):
                        counts = np.concatenate([counts, np.zeros(max(len(runs), 2 * len(counts)) - len(counts), np.int64)])
                    counts[present[~hit]] += many[~hit]
                    for x in np.flatnonzero(hit).tolist():
                        if points[x] > least:
                            at, word = int(sums[x]) % int(points[x]), runs.words[present_list[x]]
                            word = word[:at] + word[at + 1 :]
                            changed[word] = changed.get(word, 0) + int(many[x])
                    if len(runs) + len(changed) > _HELD:
                        yield flush(runs, counts, changed)
                        runs, counts, changed = _Runs(), np.zeros(0, np.int64), {}
        if runs:
            yield flush(runs, counts, changed)

    return rows


def variant_vocabulary(docs: DataFrame, every: int = 31, least: int = 7, occurrences: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: letter runs of ``docs``, one in ``every`` (by the checksum of ``<id>:<run>``) without one code point.

    Runs are maximal in ``[A-Za-zÀ-ÿ]``, only A-Z are lower-cased. Words have ``least`` code points
    and ``occurrences`` in all texts. Null texts have no run; a null id is the empty string.
    """
    source, back = named(docs)
    texts = source.select(F.col(back[id_col]).cast("long").alias("doc_id"), F.col(back[text_col]).cast("string").alias("text"))
    rows = texts.mapInArrow(_variant_rows(every, least), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class _Order:
    """Ranks of the rotations of delimited words, and how often each symbol comes before a rank."""

    def __init__(self, codes: np.ndarray, after: np.ndarray, symbols: int):
        n = len(codes)
        # Ranks by the first symbols of each rotation; every step doubles how many count.
        rank, step = codes.copy(), after
        while True:
            _, rank = np.unique(rank * (n + 1) + rank[step], return_inverse=True)
            if int(rank.max()) == n - 1:
                break
            step = step[step]
        before = np.empty(n, np.int64)
        before[after] = np.arange(n)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        last = np.zeros((n + 1, symbols), np.uint16 if n < 1 << 16 else np.int32)
        last[np.arange(1, n + 1), codes[before[order]]] = 1
        self.occ = np.cumsum(last, axis=0, dtype=last.dtype)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))[:-1]


class FMIndex:
    """Bidirectional index of distinct words; code 0 is the delimiter. ``words`` are sorted."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        flat = np.zeros(len(points) + len(words), np.int64)
        flat[np.arange(len(points)) + np.repeat(np.arange(1, len(words) + 1), self.lengths)] = codes + 1
        self.flat, self.starts = flat, starts + 1
        after = np.arange(1, len(flat) + 1)
        after[starts + self.lengths] = starts
        turned = np.zeros_like(flat)
        turned[np.arange(len(points)) + np.repeat(np.arange(1, len(words) + 1), self.lengths)] = flat[expand(starts + 1, self.lengths)][self._turn()]
        self.symbols = len(self.alphabet) + 1
        self.forward, self.backward = _Order(flat, after, self.symbols), _Order(turned, after, self.symbols)

    def _turn(self) -> np.ndarray:
        """Places of all code points with each word reversed."""
        ends = np.cumsum(self.lengths)
        return np.repeat(ends - 1, self.lengths) - (np.arange(ends[-1]) - np.repeat(ends - self.lengths, self.lengths))

    def extend(self, right: bool, low: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray):
        """Intervals (first rank in the order that is extended, in the other one, size) with ``c`` added, and which ones aren't empty."""
        order = self.backward if right else self.forward
        first, last = order.occ[low, c].astype(np.int64), order.occ[low + size, c].astype(np.int64)
        alive = np.flatnonzero(last > first)
        low, size_, c, first, last = low[alive], size[alive], c[alive], first[alive], last[alive]
        inside = order.occ[low + size_].astype(np.int32) - order.occ[low]
        inside[np.arange(self.symbols)[None, :] >= c[:, None]] = 0
        return alive, order.start[c] + first, other[alive] + inside.sum(axis=1), last - first

    def children(self, right: bool, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        """All extensions by a symbol other than the delimiter: of which interval, symbol, and the intervals."""
        order = self.backward if right else self.forward
        first = order.occ[low].astype(np.int32)
        inside = order.occ[low + size].astype(np.int32) - first
        smaller = np.cumsum(inside, axis=1) - inside
        at, c = np.nonzero(inside[:, 1:])
        c += 1
        return at, c, order.start[c] + first[at, c], other[at] + smaller[at, c], inside[at, c].astype(np.int64)

    def search(self, right: bool, patterns: np.ndarray, from_: np.ndarray, to: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) pairs with one replaced or inserted code point after ``from_`` and before ``to`` code points.

        ``patterns`` are numbers of words; both bounds count from the side where a search begins.
        ``same`` numbers the patterns that agree up to ``from_``, which are matched together.
        """
        lengths, starts = self.lengths[patterns], self.starts[patterns]

        def symbol(p: np.ndarray, k: np.ndarray) -> np.ndarray:
            return self.flat[starts[p] + (k if right else lengths[p] - 1 - k)]

        _, heads, group = np.unique(same, return_index=True, return_inverse=True)
        low, other, size = (np.zeros(len(heads), np.int64) for _ in range(3))
        size += len(self.words)
        for k in range(int(from_[heads].max())):
            on = np.flatnonzero(from_[heads] > k)
            alive, *moved = self.extend(right, low[on], other[on], size[on], symbol(heads[on], np.full(len(on), k)))
            low[on[alive]], other[on[alive]], size[on[alive]] = moved
        p, k = np.arange(len(patterns)), from_.copy()
        low, other, size = low[group], other[group], size[group]
        wrong = np.zeros(len(p), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(p):
            ended = np.flatnonzero(wrong & (k == lengths[p]))
            if len(ended):
                alive, own, there, _ = self.extend(right, low[ended], other[ended], size[ended], np.zeros(len(ended), np.int64))
                # The order of the words themselves: a word's rotation from its delimiter on has the rank of the word.
                found.append((p[ended[alive]], there if right else own))
            states = []
            on = np.flatnonzero((k < lengths[p]) & (wrong | (k < to[p])))
            if len(on):
                alive, *moved = self.extend(right, low[on], other[on], size[on], symbol(p[on], k[on]))
                on = on[alive]
                states.append((p[on], k[on] + 1, wrong[on], *moved))
            clean = np.flatnonzero(~wrong)
            if len(clean):
                at, c, *moved = self.children(right, low[clean], other[clean], size[clean])
                at = clean[at]
                inside = k[at] < to[p[at]]
                another = np.ones(len(at), bool)
                another[inside] = c[inside] != symbol(p[at[inside]], k[at[inside]])
                for chosen, more in ((inside & another, 1), (another, 0)):  # replaced, inserted
                    states.append((p[at[chosen]], k[at[chosen]] + more, np.ones(int(chosen.sum()), bool), *(x[chosen] for x in moved)))
            if not states:
                break
            p, k, wrong, low, other, size = (np.concatenate(x) for x in zip(*states))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return patterns[np.concatenate([a for a, _ in found])], np.concatenate([b for _, b in found])


#: Symbols of the words that one index holds, unless a single group has more.
_PACK = 60_000
_NEAR = "word string, near string, n long, near_n long"


def _search_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words in groups (s, a, b, p, q) whose rows stand together."""

    def pairs(held: dict[str, int], asked: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
        index = FMIndex(sorted(held))
        number = {w: k for k, w in enumerate(index.words)}
        a, b = [], []
        for right in (True, False):
            mine = [(number[w], x, y, g) for w, x, y, g in asked if (x >= y) == right]
            if mine:
                patterns, x, y, group = np.array(mine, np.int64).T
                length = index.lengths[patterns]
                found = index.search(right, patterns, *((x, length - y) if right else (y, length - x)), group)
                a.append(found[0])
                b.append(found[1])
        one, two = np.concatenate(a), np.concatenate(b)
        longer = index.lengths[two] > index.lengths[one]  # the other way round only a shorter word is asked for
        both = np.unique(np.stack([np.concatenate([one, two[longer]]), np.concatenate([two, one[longer]])], 1), axis=0)
        words, counts = pa.array(index.words, pa.string()), pa.array([held[w] for w in index.words], pa.int64())
        at = [pa.array(both[:, k]) for k in (0, 1)]
        return pa.record_batch([words.take(at[0]), words.take(at[1]), counts.take(at[0]), counts.take(at[1])], names=["word", "near", "n", "near_n"])

    held, asked, group, last, symbols = {}, [], 0, None, 0
    for batch in batches:
        for s, a, b, p, q, word, n in zip(*(batch.column(x).to_pylist() for x in ("s", "a", "b", "p", "q", "word", "n"))):
            if (s, a, b, p, q) != last:
                if symbols > _PACK and asked:
                    yield pairs(held, asked)
                    held, asked, symbols = {}, [], 0
                last, group = (s, a, b, p, q), group + 1
            if word not in held:
                held[word] = n
                symbols += len(word) + 1
            if len(word) == s:
                asked.append((word, a, b, group))
    if asked:
        yield pairs(held, asked)


def near_words(vocabulary: DataFrame, least: int, max_group: int = 4000) -> DataFrame:
    """word, near, n, near_n: all ordered pairs of different words of ``vocabulary`` (word, n) that are one edit apart.

    Words have ``least`` code points or more. A group of over ``max_group`` words is dealt again,
    unless two code points or fewer are left open in it, which bounds it by the alphabet.
    """
    level = vocabulary.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("s")).filter(F.col("s") >= least)
    level, found = level.select("*", F.lit(0).alias("a"), F.lit(0).alias("b")), None
    while True:
        half = F.floor((F.col("s") - F.col("a") - F.col("b")) / 2).cast("int")
        rest = F.col("s") - F.col("a") - F.col("b") - half
        level = level.select("word", "n", "s", F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b")))).alias("x"))
        level = level.select("word", "n", "s", "x.a", "x.b").distinct().withColumn("p", F.expr("left(word, a)")).withColumn("q", F.expr("right(word, b)"))
        key = ["s", "a", "b", "p", "q"]
        sizes = level.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1")
        level = materialize(level.join(sizes, key), "word-groups")
        small = (F.col("m") <= max_group) | (F.col("s") - F.col("a") - F.col("b") <= 2)
        dealt = level.filter(small).select(*key, "word", "n").repartition(*key).sortWithinPartitions(*key, "word")
        pairs = materialize(dealt.mapInArrow(_search_rows, _NEAR), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        level = level.filter(~small).select("word", "n", "s", "a", "b")
        if not level.take(1):
            return found.distinct()


def spelling_variants(docs: DataFrame, every: int = 31, least: int = 7, occurrences: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of :func:`variant_vocabulary`.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    ``form``: the near word of the largest n (ties: the smallest one in code-point order) if that n is
    ``ratio`` times the word's or more, else null; ``form_n``: its n. ``root``: where forms lead to in
    the end, the word itself if nowhere. ``n_near``: how many near words there are. Texts may be null,
    empty or repeated (each row counts), columns have any names; no words in, no rows out.
    """
    words = materialize(variant_vocabulary(docs, every, least, occurrences, id_col, text_col), "vocabulary")
    near = near_words(words, least)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    rows = words.join(best, "word", "left").withColumn("fits", F.col("near_n") >= ratio * F.col("n"))
    rows = materialize(rows.select("word", F.when(F.col("fits"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form is not null").select(F.col("word").alias("rid"), F.col("form").alias("lead")))
    found = rows.join(roots.select(F.col("rid").alias("word"), F.col("component").alias("root")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
