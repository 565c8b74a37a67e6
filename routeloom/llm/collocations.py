"""Phrase collocations: pair tiles with direct addresses, frequent pairs ranked again as symbols.

Words are symbols. Frequent ones are ranked by their counts, and a pair of symbols (phrase of k - 1
words, word after it) is counted as a cell of a table of ranks x ranks that is cut into tiles:

* Ranks below ``dense`` have direct addresses. A tile of them in which many pairs of a block of
  text fall is an array that ``numpy.bincount`` adds to; it leaves a task once, at its end.
* All other pairs are sparse: sorted coordinates and their counts, one list for each block. Phrases
  of three words and more, whose parts are frequent, come back in most blocks: their lists are
  added up over a task's blocks before they leave it.

Partial counts are added up by Spark. Pairs that reach the threshold are ranked again and are the
symbols of the next round, whose pairs are phrases of one word more. A round only counts pairs of
which both parts may be frequent: that is told by bitmaps of the frequent phrases' hashes, which
err to one side, so no frequent phrase is missed; what they let pass in vain the threshold drops.

What goes to all tasks is bounded: ``dense`` ranked phrases and ``2 ** filter_bits`` bits a round.
Inside a block phrases are told apart by symbol numbers, between blocks by the 64-bit hashes of
their words; all words' hashes are compared first, and salted anew if two words share one, so
they stand for the words exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..jobs.session import materialize
from .common import mix

_UPPER = bytes(range(65, 91))
#: Lower-cases A-Z; the signs that end a piece become line feeds.
_TABLE = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r", _UPPER.lower() + b"\n" * 9)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Ends a piece; no word holds the sign.
_END = b" . "
#: Bytes of a block: what one task counts at a time.
_BLOCK = 1 << 22
#: Rows of counts that a task holds to add them up.
_HELD = 1 << 19
#: Where the bits of a hash begin that place it in a bitmap.
_PROBES = 0, 32
_ROWS = "lang string, phrase string, n long, h long"


class _Block:
    """Words of some texts of one language as symbol numbers; a sign that ends a piece is the symbol of ``.``."""

    def __init__(self, lang: str, parts: list[bytes], salt: int):
        self.lang = lang
        flat = pa.compute.ascii_split_whitespace(pa.array([_END.join(parts).strip()], pa.string())).flatten()
        coded = flat.filter(pa.compute.not_equal(flat, "")).dictionary_encode()
        self.words, self.symbols = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seed = xxhash.xxh3_64_intdigest(lang.encode(), salt)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words.cast(pa.binary()).to_pylist()], np.uint64)
        self.end = self.words.index(".").as_py()
        ends = np.append(np.flatnonzero(self.symbols == self.end), len(self.symbols))
        places = np.arange(len(self.symbols))
        #: How many words are left in the piece from each one on; none at a sign.
        self.left = ends[np.searchsorted(ends, places)] - places


def _blocks(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[_Block]:
    """Blocks of about ``_BLOCK`` bytes; a text that is longer is cut at the end of a piece."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for part in _cut((text or b"").translate(_TABLE)):
                held[lang].append(part.replace(b"\n", _END))
                sizes[lang] += len(part)
                full = [lang] if sizes[lang] >= _BLOCK else list(held) if sum(sizes.values()) >= 4 * _BLOCK else []
                for one in full:
                    del sizes[one]
                    yield _Block(one, held.pop(one), salt)
    for lang, parts in held.items():
        yield _Block(lang, parts, salt)


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about ``_BLOCK`` bytes that end at line feeds; a longer piece stays whole."""
    start = 0
    while len(text) - start > _BLOCK:
        end = text.find(b"\n", start + _BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _word_rows(salt: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, salt):
            own = np.flatnonzero(np.arange(len(block.hashes)) != block.end)
            counts = np.bincount(block.symbols, minlength=len(block.hashes))[own]
            columns = [pa.array([block.lang] * len(own), pa.string()), block.words.take(pa.array(own)), pa.array(counts, pa.int64()), block.hashes[own].view(np.int64)]
            yield pa.record_batch(columns, names=["lang", "phrase", "n", "h"])

    return rows


def _names(k: int) -> list[str]:
    return [f"w{j}" for j in range(1, k + 1)]


def _phrase_batch(words: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Counts of phrases given by the hashes of their words."""
    return pa.record_batch([*(w.view(np.int64) for w in words), counts.astype(np.int64)], names=[*_names(len(words)), "n"])


def _passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a bitmap holds: both of their bits are set."""
    held, out = np.frombuffer(bits, np.uint8), np.ones(len(hashes), bool)
    for shift in _PROBES:
        at = hashes >> np.uint64(shift) & np.uint64(8 * len(bits) - 1)
        out &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


class _Sums:
    """Counts of phrases over the blocks of a task, at most about ``least`` + a block's rows at a time."""

    def __init__(self, least: int):
        self.least, self.held, self.n = least, [], 0

    def add(self, words: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append([*words, counts.astype(np.int64)])
        self.n += len(counts)
        if self.n >= self.least:
            self._merge()
            if 2 * self.n >= self.least:
                yield from self.rows()

    def _merge(self) -> None:
        *words, counts = (np.concatenate(c) for c in zip(*self.held))
        order = np.argsort(_phrase_hash(words), kind="stable")
        words, counts = [w[order] for w in words], counts[order]
        # Phrases are told apart by all words: two of one hash stay two, at worst in more rows.
        new = np.ones(len(counts), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        first = np.flatnonzero(new)
        self.held, self.n = [[*(w[first] for w in words), np.add.reduceat(counts, first)]], len(first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All that is held, and nothing is any more."""
        if self.n:
            self._merge()
            *words, counts = self.held[0]
            self.held, self.n = [], 0
            for x in range(0, len(counts), 1 << 16):
                yield _phrase_batch([w[x : x + (1 << 16)] for w in words], counts[x : x + (1 << 16)])


@dataclass
class _Tiles:
    """Dense tiles of a task: ``counts[row, column]`` is an array of ``side`` x ``side`` cells."""

    side: int
    counts: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count the pairs that fall into dense tiles; which ones those are."""
        done = np.zeros(len(a), bool)
        tile = (a // self.side) << 32 | b // self.side
        for key, n in zip(*(x.tolist() for x in np.unique(tile, return_counts=True))):
            at = key >> 32, key & 0xFFFFFFFF
            # An array pays once its cells are used about as often as they are many.
            if at in self.counts or n >= self.side * self.side // 16:
                mine = tile == key
                held = self.counts.setdefault(at, np.zeros(self.side * self.side, np.int64))
                held += np.bincount(a[mine] % self.side * self.side + b[mine] % self.side, minlength=len(held))
                done |= mine
        return done

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for (row, column), held in self.counts.items():
            cells = np.flatnonzero(held)
            yield row * self.side + cells // self.side, column * self.side + cells % self.side, held[cells]


def _step(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of what stands before its last word, and of that word."""
    return mix(hashes * _GOLDEN + words)


def _phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    out = words[0]
    for w in words[1:]:
        out = _step(out, w)
    return out


def _with_hash(k: int):
    """Adds ``h``, the hash of phrases of ``k`` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in _names(k)]
            yield batch.append_column("h", pa.array(_phrase_hash(words).view(np.int64)))

    return rows


def _pair_rows(k: int, ranks: list[np.ndarray], filters, side: int, salt: int):
    """Counts of phrases of ``k`` words; ``ranks``: the hashes of the words of frequent words and of frequent phrases of k - 1 words, a row for each rank; ``filters``: of all shorter phrases."""
    hashes_of = [_phrase_hash(list(found.T)) for found in ranks]
    rank = [{tuple(row): n for n, row in enumerate(found.tolist())} for found in ranks]

    def rank_of(which: int, words: list[np.ndarray]) -> np.ndarray:
        """Ranks (-1: none) of symbols given by their words' hashes."""
        out = np.full(len(words[0]), -1, np.int64)
        some = np.flatnonzero(np.isin(_phrase_hash(words), hashes_of[which]))
        out[some] = [rank[which].get(x, -1) for x in zip(*(w[some].tolist() for w in words))]
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tiles, sums = filters.value, _Tiles(side), _Sums(_HELD)
        for block in _blocks(batches, salt):
            symbols, hashes_at = block.symbols, block.hashes[block.symbols]
            frequent = _passes(bits[0], block.hashes)
            if block.end is not None:
                frequent[block.end] = False
            place, sym, hashes = np.flatnonzero(frequent[symbols]), symbols, hashes_at
            # place: where phrases of j words stand that may be frequent; sym, hashes: of the phrase at each word
            for j in range(2, k + 1):
                here = np.zeros(len(symbols) + 1, bool)
                here[place] = True
                place = place[(block.left[place] >= j) & here[place + 1]]
                if j < k:
                    _, unique = np.unique(sym[place] << 32 | symbols[place + j - 1], return_inverse=True)
                    step = _step(hashes[place], hashes_at[place + j - 1])
                    sym, hashes = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.uint64)
                    sym[place], hashes[place] = unique, step
                    place = place[_passes(bits[j - 1], step)]
            if not len(place):
                continue
            lefts, first, inverse = np.unique(sym[place], return_index=True, return_inverse=True)
            a = rank_of(len(ranks) - 1, [hashes_at[place[first] + j] for j in range(k - 1)])[inverse]
            b = rank_of(0, [block.hashes])[symbols[place + k - 1]]
            ranked = np.flatnonzero((a >= 0) & (b >= 0))
            sparse = np.ones(len(place), bool)
            sparse[ranked[tiles.add(a[ranked], b[ranked])]] = False
            place = place[sparse]
            _, first, counts = np.unique(sym[place] << 32 | symbols[place + k - 1], return_index=True, return_counts=True)
            at = place[first]
            if k == 2:  # pairs of words seldom come back in another block
                for x in range(0, len(at), 1 << 16):
                    yield _phrase_batch([hashes_at[at[x : x + (1 << 16)] + j] for j in range(k)], counts[x : x + (1 << 16)])
            elif len(at):
                yield from sums.add([hashes_at[at + j] for j in range(k)], counts)
        for a, b, counts in tiles.rows():
            words = [*ranks[-1][a].T, ranks[0][b, 0]]
            if k == 2:
                yield _phrase_batch(words, counts)
            elif len(a):
                yield from sums.add(words, counts)
        yield from sums.rows()

    return rows


def _bitmap(frequent: DataFrame, bits: int) -> bytes:
    """2 ** ``bits`` bits, of which each frequent phrase's hash sets two; made in pieces of 4 KiB by Spark."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    at = F.col("at")
    both = frequent.select(F.explode(F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND((1 << bits) - 1) for shift in _PROBES])).alias("at"))
    pieces = both.groupBy(F.shiftright(at, 15).alias("piece")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << 15) - 1)).alias("bits"))
    for piece, held in pieces.collect():  # 2 ** (bits - 15) rows at most
        out[piece << 12 : (piece << 12) + len(held)] = np.frombuffer(held, np.uint8)
    return out.tobytes()


def phrase_counts(docs: DataFrame, least: int, longest: int, dense: int = 2048, side: int = 512, filter_bits: int = 24) -> tuple[DataFrame, list[DataFrame]]:
    """All words' counts (lang, phrase, n, h), and by length the phrases (lang, phrase, n) that occur ``least`` times; ``docs``: lang, text."""
    spark = docs.sparkSession
    salt = 0
    while True:
        words = docs.mapInArrow(_word_rows(salt), _ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
        words = materialize(words, "words")
        if not words.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").take(1):
            break
        salt += 1
    kept = materialize(words.filter(F.col("n") >= least), "frequent-words")
    names = {c: kept.select(F.col("h").alias(c), "lang", F.col("phrase").alias(f"_{c}")) for c in _names(longest)}

    def top(found: DataFrame, k: int) -> np.ndarray:
        """The words' hashes of the ``dense`` most frequent phrases."""
        rows = found.orderBy(F.desc("n"), *_names(k)).limit(dense).select(*_names(k)).collect()
        return np.array([tuple(r) for r in rows], np.int64).reshape(-1, k).view(np.uint64)

    level = kept.select(F.col("h").alias("w1"), "n")
    first = latest = top(level, 1)
    bits, frequent = [_bitmap(kept, filter_bits)], [kept.select("lang", "phrase", "n")]
    for k in range(2, longest + 1):
        held = spark.sparkContext.broadcast(bits)
        rows = docs.mapInArrow(_pair_rows(k, [first] if k == 2 else [first, latest], held, side, salt), ", ".join(f"{c} long" for c in [*_names(k), "n"]))
        level = materialize(rows.groupBy(*_names(k)).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")
        held.unpersist()
        named_ = level
        for c in _names(k):
            # A word's hash tells its language too.
            named_ = named_.join(names[c] if c == "w1" else names[c].drop("lang"), c)
        frequent.append(materialize(named_.select("lang", F.concat_ws(" ", *[f"_{c}" for c in _names(k)]).alias("phrase"), "n"), "phrases"))
        latest = top(level, k)
        if not len(latest):
            break
        hashed = level.select(*_names(k)).mapInArrow(_with_hash(k), ", ".join(f"{c} long" for c in [*_names(k), "h"]))
        bits = [*bits, _bitmap(hashed, filter_bits)]
    return words, frequent


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, dense: int = 2048, side: int = 512, filter_bits: int = 24, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their weakest cut.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at
    spaces and tabs; null texts have none, a null language is ``und``. ``n``: words of the language;
    ``a``: occurrences of a phrase of 2 to ``longest`` words inside pieces, ``least`` or more. A cut
    after k words has ``l`` and ``r`` occurrences of its parts and the score floor(1000 * a * n /
    (l * r)), exact in 38 digits; the smallest one counts, at the smallest k. Phrases inside a
    longer candidate with as many occurrences are dropped. Order: score and ``a`` from above, then
    the phrase. Repeated rows count each time; other columns don't matter; no rows in, no rows out.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    words, frequent = phrase_counts(texts, least, longest, dense, side, filter_bits)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = frequent[0].select("lang", "phrase", F.lit(1).alias("words"), "n")
    for k, more in enumerate(frequent[1:], 2):
        counts = counts.unionByName(more.withColumn("words", F.lit(k)))
    candidates = counts.filter("words > 1").withColumnRenamed("n", "a").withColumn("list", F.split("phrase", " "))

    def span(start, n) -> F.Column:
        return F.array_join(F.slice("list", start, n), " ")

    inner = candidates.filter("words > 2").select("lang", "a", "words", "list", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inner = inner.select("lang", "a", "list", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("start"))
    above = inner.select("lang", span(F.col("start"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    left = candidates.join(above, ["lang", "phrase"], "left").filter("above is null or above < a")
    cuts = left.select("lang", "phrase", "a", "words", "list", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("before"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("after"))
    for end, name in (("before", "l"), ("after", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(end), F.col("n").alias(name)), ["lang", end])
    wide = "CAST({} AS DECIMAL(19,0))"
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(f"({wide.format('1000 * a')} * {wide.format('total')}) div ({wide.format('l')} * {wide.format('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("s")).select("lang", "phrase", "s.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # No language's candidates meet in one task: the best ones of each of 64 parts are ranked again.
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    last = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
