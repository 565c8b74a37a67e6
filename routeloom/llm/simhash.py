"""SimHash near-duplicates, linked through BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree on at least one of ``radius + 1``
parts of their bits, so each distinct fingerprint goes to one shard for each part, keyed by the
part's bits. A shard's fingerprints form a BK-tree (a child hangs under its parent by their
Hamming distance), and a search follows only the edges whose distance lies within the radius of
the one to the node at hand. A shard that is too large for a tree is dealt out again by the
parts of the bits that its key leaves open; that ends, as fewer open bits hold fewer
fingerprints. Copies share a fingerprint, which stands once in any tree.

Shard trees aren't broadcast: there are as many fingerprints as different texts, so together the
trees grow with the corpus. A shard's fingerprints and those that may match them come to one task
instead, which builds the tree and searches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize
from ..operators.components import component_labels
from .common import text_bytes

_BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of a text's word shingles; ASCII letters count as lower-case."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(found))
    digest, n = xxhash.xxh64_intdigest, len(found) - width + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), "<u8", n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _BITS_AT_ONCE):
        counts += np.unpackbits(hashes[k : k + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > n))


def _fingerprint_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), found], names=["doc_id", "rid", "fp"])

    return rows


def tree_links(points: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect all points within the radius of each other (a spanning forest).

    Points enter a BK-tree one by one; each is searched before it is added.
    """
    children: dict[int, dict[int, int]] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    top = None
    for point in points:
        if point in parent:
            continue
        parent[point] = point
        children[point] = {}
        if top is None:
            top = point
            continue
        todo = [top]
        while todo:
            node = todo.pop()
            apart = (node ^ point).bit_count()
            if apart <= radius and root(node) != root(point):
                parent[root(point)] = root(node)
                yield node, point
            todo += [child for edge, child in children[node].items() if apart - radius <= edge <= apart + radius]
        node = top
        while (next_ := children[node].get(apart := (node ^ point).bit_count())) is not None:
            node = next_
        children[node][apart] = point


def _tree_rows(radius: int):
    def links(points: list[int]) -> list[tuple[int, int]]:
        return [(a, b) for a, b in tree_links([x & 0xFFFFFFFFFFFFFFFF for x in points], radius)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for mask, value, fp in zip(*(batch.column(x).to_pylist() for x in ("mask", "value", "fp"))):
                if (mask, value) != key:
                    out += links(held)
                    key, held = (mask, value), []
                held.append(fp)
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        out += links(held)
        if out:
            yield _link_batch(out)

    return rows


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).view(np.int64)
    return pa.record_batch([pairs[:, 0].copy(), pairs[:, 1].copy()], names=["i", "j"])


def _parts(open_bits: list[int], n: int) -> list[int]:
    """Bit masks of ``n`` even parts of the given bit positions."""
    cuts = [len(open_bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in open_bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int, max_tree: int = 2000) -> DataFrame:
    """Links (i, j) that connect exactly the fingerprints reachable within ``radius`` bits."""
    # A bit from each byte in turn: neighbouring bits don't all fall into one part.
    masks = {0: _parts([8 * k + b for b in range(8) for k in range(8)], radius + 1)}
    level = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    found: DataFrame | None = None
    while masks:
        children = F.create_map(*[x for m, parts in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | p)) for p in parts]))])
        level = level.select("fp", F.explode(children[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = level.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        level = materialize(level.join(sizes, ["mask", "value"]), "shards")
        shards = level.filter(F.col("n") <= max_tree).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        links = materialize(shards.select("mask", "value", "fp").mapInArrow(_tree_rows(radius), "i long, j long"), "links")
        found = links if found is None else found.unionByName(links)
        level = level.filter(F.col("n") > max_tree).select("fp", "mask")
        hot = [r[0] & 0xFFFFFFFFFFFFFFFF for r in level.select("mask").distinct().collect()]  # (radius + 1) ** depth at most
        masks = {m: _parts([b for b in range(64) if not m >> b & 1], radius + 1) for m in hot}
    return found


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and the component that its links reach.

    Returns doc_id, rid (hash of the text), fingerprint (16 hex digits) and component_id, the
    smallest doc_id reachable through links between fingerprints that differ in ``radius`` bits
    or fewer. Texts with fewer words than ``words`` are one shingle; null and wordless texts
    have fingerprint zero and are linked like any other. Null ids keep their row and don't name
    a component unless it has no other id. Repeated rows come back as they are.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(source.mapInArrow(_fingerprint_rows(words), "doc_id long, rid long, fp long"), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = component_labels(near_links(prints, radius))
    linked = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = linked.join(firsts, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "rid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
