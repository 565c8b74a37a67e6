"""Near-duplicate removal at a Jaccard similarity, with SimHash BK-trees in MinHash shards.

At a similarity of 0.8 fingerprints differ in far more bits than parts of them can be matched
on, so the trees are sharded by MinHash bands of the word shingles instead:

1. Every text tries one leader, the smallest text hash that shares a band with it, and is linked
   to it if the exact Jaccard similarity of their shingle sets is reached. A group of copies of
   any size collapses to one component in this step, at one row a text.
2. Only bands that still hold several components go on. Texts that such bands connect are one
   shard, in which a text stands once, however many bands brought it there. A shard's
   fingerprints form a BK-tree; a search follows only edges within the radius, and only texts of
   other components are verified, so a shard makes fewer links than it has components.
3. The texts of shards that are too large for one tree are dealt again by an exact prefix filter:
   two sets that reach the similarity share a shingle among the rarest ones of both, so only
   texts that are linked by shared prefix shingles stay together, and a text without such a
   partner leaves. Texts that have no more than a common block in common part here, at one row a
   shingle.
4. What is still too large is freed of the texts that no other component can reach (by the
   triangle inequality of the Jaccard distance, from a leader), then dealt to blocks: each
   block's tree is searched by each block's texts, as tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize, release
from ..operators.components import component_labels
from .common import WORD_HASHES, mix, named, text_bytes

#: MinHash bands and values in each: two texts at a similarity of 0.8 share no band with a chance of 1e-5.
BANDS, ROWS = 16, 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_SLICE = 1 << 14
#: What products of a similarity and a size may be off.
_ROUNDING = 1e-9


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; ASCII letters count as lower-case.

    A text with fewer words is one shingle.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(WORD_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(words, len(codes))
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _GOLDEN + codes[k : k + n])
    return np.unique(out)


def simhash(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        counts += np.unpackbits(hashes[k : k + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(hashes)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` MinHash values."""
    lows = np.full(len(_FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), _SLICE):
        lows = np.minimum(lows, (hashes[k : k + _SLICE, None] * _FACTORS).min(axis=0))
    bands, key = lows.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * _GOLDEN + bands[:, k])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingle hashes, each sorted and without repeats."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


_SIGNED = "rid long, fp long, size long, keys array<long>"


def simhash_signature(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Fingerprint and band keys of a set of shingle hashes."""
    return simhash(hashes), band_keys(hashes)


def _signature_rows(words: int, sign: Callable[[np.ndarray], tuple[int, np.ndarray]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rid, text in zip(batch.column("rid").to_pylist(), text_bytes(batch.column("text"))):
                hashes = shingle_hashes(text, words)
                if len(hashes):
                    fp, keys = sign(hashes)
                    found.append((rid, fp, 8 * len(hashes), keys))
            rids, prints, sizes, keys = ([x[k] for x in found] for k in range(4))
            columns = [pa.array(rids, pa.int64()), np.array(prints, np.uint64).view(np.int64), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["rid", "fp", "size", "keys"])

    return rows


def _shingle_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_hashes(x, words).tobytes() for x in text_bytes(batch.column("text"))], pa.binary())
            yield pa.record_batch([batch.column("rid"), batch.column("fp"), sets], names=["rid", "fp", "shingles"])

    return rows


Point = tuple[int, int, bytes]


def tree_links(points: list[Point], searching: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Verified links between components, of the (component, fingerprint, shingles) points of one shard.

    The points enter a BK-tree one by one, each being searched before it is added; the last
    ``searching`` ones are only searched. Of a search's finds those are verified that aren't of the
    same component by then.
    """
    sizes = np.array([len(p[2]) // 8 for p in points], np.int64)
    codes = np.unique(np.frombuffer(b"".join(p[2] for p in points), np.uint64), return_inverse=True)[1]
    starts, held = np.cumsum(sizes) - sizes, np.zeros(int(codes.max()) + 1, bool)
    at: dict[int, list[int]] = {}
    children: dict[int, dict[int, int]] = {}
    parent = {p[0]: p[0] for p in points}
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    top: list[int] = []
    for n, (component, fp, _) in enumerate(points):
        fp &= 0xFFFFFFFFFFFFFFFF
        todo, found = [*top], []
        while todo:
            node = todo.pop()
            apart = (node ^ fp).bit_count()
            if apart <= radius:
                found += at[node]
            todo += [child for edge, child in children[node].items() if apart - radius <= edge <= apart + radius]
        own = root(component)
        found = [k for k in found if root(points[k][0]) != own]
        if found:
            mine = codes[starts[n] : starts[n] + sizes[n]]
            held[mine] = True
            shared = np.add.reduceat(held[codes], starts, dtype=np.int64)[found]
            held[mine] = False
            for k in np.flatnonzero(shared + _ROUNDING >= similarity * (sizes[found] + sizes[n] - shared)).tolist():
                a, b = root(component), root(points[found[k]][0])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((component, points[found[k]][0]))
        if n >= len(points) - searching:
            continue
        if fp in at:
            at[fp].append(n)
            continue
        at[fp], children[fp] = [n], {}
        if not top:
            top.append(fp)
            continue
        node = top[0]
        while (next_ := children[node].get(apart := (node ^ fp).bit_count())) is not None:
            node = next_
        children[node][apart] = fp
    return out


_LINK = "i long, j long"
_MEMBER = ("component", "fp", "shingles")
_SHARD = ("part", "a", "b")
#: Finds the links of one shard: its points, and how many of the last ones only search.
Finder = Callable[[list[Point], int], list[tuple[int, int]]]


def tree_finder(radius: int, similarity: float) -> Finder:
    return lambda points, searching: tree_links(points, searching, radius, similarity)


def _link_rows(finder: Finder):
    """Rows of a shard (part, a, b) stand together; ``side`` 0 makes its index, side 1 searches it."""

    def links(points: list[Point], searching: int) -> pa.RecordBatch:
        found = finder(points, searching)
        return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["i", "j"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, searching = None, [], 0
        for batch in batches:
            for *now, side, component, fp, raw in zip(*(batch.column(x).to_pylist() for x in (*_SHARD, "side", *_MEMBER))):
                if now != shard:
                    if shard:
                        yield links(points, searching)
                    shard, points, searching = now, [], 0
                points.append((component, fp, raw))
                searching += side
        if shard:
            yield links(points, searching)

    return rows


def _compared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, rid, lead and the similarity of a text to its leader."""
    for batch in (b.slice(k, 200) for b in batches for k in range(0, max(1, b.num_rows), 200)):
        pairs = zip(batch.column("shingles").to_pylist(), batch.column("lead_shingles").to_pylist())
        like = pa.array([jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs], pa.float64())
        yield pa.record_batch([*(batch.column(x) for x in ("key", "rid", "lead")), like], names=["key", "rid", "lead", "similarity"])


def _with_leaders(rows: DataFrame, known: DataFrame) -> DataFrame:
    """key, rid, lead, similarity for ``rows`` (key, rid, lead)."""
    rows = materialize(rows.select("key", "rid", "lead"), "tries")
    own = materialize(rows.join(known.select("rid", "shingles"), "rid"), "tries")
    both = own.join(known.select(F.col("rid").alias("lead"), F.col("shingles").alias("lead_shingles")), "lead")
    found = materialize(both.select("key", "rid", "lead", "shingles", "lead_shingles").mapInArrow(_compared_rows, "key long, rid long, lead long, similarity double"), "compared")
    release(rows, own)
    return found


def _roots(parents: DataFrame) -> DataFrame:
    """rid, component: the end of each chain of ``parents`` (rid, lead); every step doubles its reach."""
    now = materialize(parents.select("rid", F.col("lead").alias("component")), "roots")
    while True:
        on = now.select(F.col("rid").alias("component"), F.col("component").alias("_to"))
        moved = materialize(now.join(on, "component", "left").select("rid", F.coalesce("_to", "component").alias("component"), F.col("_to").isNotNull().alias("moved")), "roots")
        now = moved.select("rid", "component")
        if not moved.filter("moved").take(1):
            return now


def near_components(
    texts: DataFrame,
    words: int,
    similarity: float,
    radius: int,
    max_tree: int = 200,
    max_bytes: int = 1 << 25,
    max_block: int | None = None,
    sign: Callable[[np.ndarray], tuple[int, np.ndarray]] = simhash_signature,
    finder: Finder | None = None,
) -> DataFrame:
    """rid, component for the texts (``texts``: rid, text) that have near-duplicates.

    ``sign`` gives a set of shingle hashes its fingerprint and band keys, ``finder`` links the
    texts of a shard (a BK-tree of the ``radius``, if none is given). Shards of up to ``max_tree``
    texts and ``max_bytes`` of shingle hashes go to one task as they are; blocks
    of larger ones hold ``max_block`` texts (five times as many).
    """
    max_block, finder = max_block or 5 * max_tree, finder or tree_finder(radius, similarity)
    signed = materialize(texts.mapInArrow(_signature_rows(words, sign), _SIGNED), "signatures")
    shards = signed.select("rid", "size", F.explode("keys").alias("key")).distinct()
    busy = materialize(shards.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("lead")).filter("n > 1"), "busy")
    level = materialize(shards.join(busy, "key").select("key", "rid", "lead", "size"), "shards")
    wanted = materialize(level.groupBy("rid").agg(F.min("lead").alias("lead")).withColumn("key", F.lit(0).cast("long")), "leaders")
    # One row of each text that shares a band; only these texts' shingles are kept.
    prints = materialize(signed.join(wanted.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("fp").alias("fp")), "fingerprints")
    first = materialize(texts.join(prints.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text")), "shared-texts")
    known = materialize(first.join(prints, "rid").mapInArrow(_shingle_rows(words), "rid long, fp long, shingles binary"), "shingle-sets")
    release(signed, busy, first, prints)
    linked = _with_leaders(wanted.filter("rid != lead"), known).filter(F.col("similarity") >= similarity)
    roots = _roots(linked)

    placed = materialize(level.join(roots, "rid", "left").select("key", "rid", "size", F.coalesce("component", "rid").alias("component")), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rid").alias("lead")).filter("low != high").select("key", "lead")
    left = materialize(placed.join(open_, "key").select("rid", "component", "size", "lead"), "open-shards")
    # Texts that open bands connect are one shard.
    parts = component_labels(left.filter("rid != lead"), "rid", "lead").select(F.col("node").alias("rid"), F.col("component").alias("part"))
    sharded = left.select("rid", "component", "size").distinct().join(parts, "rid")
    sizes = materialize(sharded.groupBy("part").agg(_load(max_tree, max_bytes).alias("blocks")), "shard-sizes")
    sharded = materialize(sharded.join(sizes, "part"), "sharded")
    small, large = sharded.filter("blocks = 1").select("part", *[F.lit(0).alias(c) for c in ("a", "b", "side")], "rid", "component"), sharded.filter("blocks > 1")
    members = small.unionByName(_blocks(_parts(large, known, similarity), known, similarity, max_block, max_bytes)) if large.take(1) else small
    rows = materialize(members, "members").join(known, "rid")
    dealt = rows.select(*_SHARD, "side", *_MEMBER, "rid").repartition(*_SHARD).sortWithinPartitions(*_SHARD, "side", "rid")
    links = materialize(dealt.drop("rid").mapInArrow(_link_rows(finder), _LINK), "tree-links")
    merged = materialize(component_labels(links), "merged")
    release(level, wanted, known, placed, left, sharded, links)
    heads = roots.select("component").unionByName(merged.select(F.col("node").alias("component"))).distinct()
    every = roots.unionByName(heads.select(F.col("component").alias("rid"), "component"))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return every.join(moved, "component", "left").select("rid", F.coalesce("_to", "component").alias("component"))


def _load(most: int, max_bytes: int):
    """Into how many blocks a group of texts goes, by its rows and its sum of sizes."""
    return F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("size") / max_bytes)).cast("int")


#: Counters of the shingles' frequencies: what is collected of them is no more than that.
_COUNTERS = 1 << 20


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in (b.slice(k, 50) for b in batches for k in range(0, b.num_rows, 50)):
        yield from zip(batch.column("rid").to_pylist(), (np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()))


def _counter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's shingles fall to each counter, of those that get several: the rare ones are most, and need no count."""
    counts = np.zeros(_COUNTERS, np.int64)
    for _, hashes in _sets(batches):
        np.add.at(counts, (hashes % np.uint64(_COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(counts > 1)
    yield pa.record_batch([at, counts[at]], names=["counter", "n"])


def _prefix_rows(counts: np.ndarray, similarity: float):
    """rid, shingle: the first shingles of each text in the order of (counter, hash)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, hashes in _sets(batches):
            often = counts[(hashes % np.uint64(_COUNTERS)).astype(np.int64)]
            first = np.lexsort((hashes, often))[: len(hashes) - int(np.ceil(similarity * len(hashes) - _ROUNDING)) + 1]
            yield pa.record_batch([np.full(len(first), rid, np.int64), hashes[first].view(np.int64)], names=["rid", "shingle"])

    return rows


def _parts(shards: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """part, rid, component, size: the texts of large shards, by what prefix shingles connect.

    Two sets of m and n shingles that reach the similarity share one of the first m - ceil(similarity *
    m) + 1 and n - ceil(similarity * n) + 1 in any common order. Here those come first that few of
    these texts hold, as a table of counters says, to which each task adds the counters that it met
    more than once. Common shingles are met again in any task, so they are last; what the
    table misses of rare ones only moves them in the order, which is the same for all texts.
    """
    texts = shards.select("rid", "component", "size")
    own = materialize(known.join(texts, "rid", "left_semi").select("rid", "shingles"), "large-sets")
    counts = np.zeros(_COUNTERS, np.int64)
    # A row for each counter at most: 16 MB as columns, 500 MB as Python's rows.
    met = own.mapInArrow(_counter_rows, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts[met["counter"].to_numpy()] = met["n"].to_numpy()
    held = own.sparkSession.sparkContext.broadcast(counts)
    prefix = materialize(own.mapInArrow(lambda batches: _prefix_rows(held.value, similarity)(batches), "rid long, shingle long"), "prefixes")
    held.unpersist()
    first = prefix.groupBy("shingle").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).filter("first != last")
    edges = prefix.join(first, "shingle").select("rid", "first").filter("rid != first").distinct()
    parts = materialize(component_labels(edges, "rid", "first").select(F.col("node").alias("rid"), F.col("component").alias("part")), "parts")
    split = texts.join(parts, "rid").select("part", "rid", "component", "size")
    open_ = split.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("part")
    found = materialize(split.join(open_, "part"), "split-shards")
    release(own, prefix)
    return found


def _blocks(parts: DataFrame, known: DataFrame, similarity: float, most: int, max_bytes: int) -> DataFrame:
    """part, a, b, side, rid, component: ``parts`` (part, rid, component, size) as pairs of blocks; those of one block have no other.

    A text stays out of a part of several blocks if it is too near the leader to be linked to a
    text of another component than the leader's, all of which are further away.
    """
    sizes = materialize(parts.groupBy("part").agg(_load(most, max_bytes).alias("blocks"), F.min(F.struct("rid", "component")).alias("lead")), "part-sizes")
    level = materialize(parts.join(sizes.select("part", "blocks", F.col("lead.rid").alias("lead"), F.col("lead.component").alias("first")), "part"), "sized")
    large = level.filter("blocks > 1")
    near = _with_leaders(large.select(F.col("part").alias("key"), "rid", "lead"), known).select("rid", "similarity")
    judged = large.join(near, "rid").withColumn("other", F.col("component") != F.col("first"))
    nearest = judged.groupBy("part").agg(F.max(F.when(F.col("other"), F.col("similarity"))).alias("nearest"))
    judged = judged.join(nearest, "part").filter(F.col("other") | (F.col("similarity") <= F.col("nearest") + (1 - similarity + _ROUNDING)))
    columns = ["part", "rid", "component", "size"]
    judged = materialize(level.filter("blocks = 1").select(*columns).unionByName(judged.select(*columns)), "reached")
    counts = materialize(judged.groupBy("part").agg(_load(most, max_bytes).alias("blocks")), "blocks")
    dealt = judged.join(counts, "part").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("part", "rid", "component", "block", others.alias("opposite"))
    return pairs.select("part", F.least("block", "opposite").alias("a"), F.greatest("block", "opposite").alias("b"), (F.col("block") > F.col("opposite")).cast("int").alias("side"), "rid", "component")


def near_distinct(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each group of near-duplicates, all columns as they are.

    Texts are linked when the Jaccard similarity of their sets of ``words``-word shingles reaches
    ``similarity`` (shingles are compared by 64-bit hashes); groups are the components of the
    links. Pairs are found that share a MinHash band and whose fingerprints differ in ``radius``
    bits at most: at a similarity of 0.8 they differ in 10 of 64 on average, and 32 are what
    unrelated texts differ in. The smallest id stays (nulls come last), then the smallest text
    hash. Equal texts are one group, null texts too, as are texts without a word that are equal. A
    row that repeats id and text goes with its copy. No rows in, no rows out. Columns may have
    any names.
    """
    source, back = named(docs)
    key = [F.coalesce(F.col(back[id_col]).cast("long"), F.lit(2**63 - 1)).alias("did"), F.xxhash64(back[text_col]).alias("rid")]
    texts = source.select(key[1], F.col(back[text_col]).cast("string").alias("text"))
    labels = near_components(texts, words, similarity, radius)
    rows = materialize(source.select(*key).groupBy("rid").agg(F.min("did").alias("did"), F.count("*").alias("copies")), "texts")
    grouped = rows.join(labels, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    stay = grouped.groupBy("component").agg(F.min(F.struct("did", "rid", "copies")).alias("x")).select("x.*")
    kept = source.select("*", *key).join(stay, ["did", "rid"])
    # Rows with the same id and text are told apart only where there are any.
    once = kept.filter("copies = 1").unionByName(kept.filter("copies > 1").dropDuplicates(["did", "rid"]))
    return once.select(*[F.col(c).alias(name) for name, c in back.items()])
