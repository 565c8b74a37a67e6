"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit verification.

Texts are sequences of words. A CGK walk goes over a window of words from its start on: each step
emits the word at hand, and a random bit of that step and word says whether the walk moves on. Two
walks with the same bits fall into step again behind an edit, so edits become differences of few
places (edit distance becomes Hamming distance). Each repetition samples a few places of a walk as
a key. All windows of an item (from each of its words to its end) give the index its keys; a
document's windows, from each of its words on, look theirs up, and a hit puts the item at a place
of the document. As most of an item's words start a window without an edit nearby, few repetitions
reach the target recall, which the tests measure at all allowed edits. Items too short for that are
indexed by their ``edits + 1`` parts, one of which is unchanged.

Each place that the index proposes is verified: a bit-parallel pass gives the least edits between
the item and any substring there, and an exact table the best place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, mix, named, row_key, steps, text_bytes

#: ASCII characters other than letters and digits separate words.
_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: Items in one broadcast block; more items take more passes over the documents.
BLOCK_ITEMS = 20_000

#: Independent walks, their steps, and the places that are sampled from each; one key each.
WALKS, STEPS, SAMPLES = 16, 8, ((0, 2, 4, 7), (0, 3, 5, 7))
#: A key has to hold this many changes of the word.
LEAST_MOVES = 3
#: Windows start at this share of an item's words, the rarest ones.
STARTS = 0.6
#: Items of fewer words, and those of which fewer than this share of all keys can be used (they repeat few words), are indexed by their parts.
SHORT, LEAST_KEYS = 12, 0.4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22

_LEAK = "doc_id long, rid long, item_id long, start long, end long, distance int, similarity double"


def item_words(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation."""
    return (text or "").lower().encode().translate(_TABLE).split()


class ItemBlock:
    """The items of one block with an index of their parts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        found = [(i, item_words(t)) for i, t in items]
        found = [(i, w) for i, w in found if w]
        self.ids = [i for i, _ in found]
        names = sorted({w for _, ws in found for w in ws})
        self.codes = {w: k + 1 for k, w in enumerate(names)}
        self.items = [np.array([self.codes[w] for w in ws], np.int64) for _, ws in found]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self._masks: dict[int, dict[int, int]] = {}
        # Bits of each walk, step and word; one is the place of unknown words, zero that of a text's end.
        words = np.arange(len(names) + 2, dtype=np.uint64)
        self.moves = [[(mix(words * _GOLDEN + np.uint64(w * STEPS + t + 1)) >> np.uint64(63)).astype(np.int32) for t in range(STEPS)] for w in range(WALKS)]
        # Windows start at the words of an item that are rarest among all items.
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.items]), minlength=len(names) + 1)
        self.starts = [np.sort(np.argsort(counts[x], kind="stable")[: math.ceil(STARTS * len(x))]) for x in self.items]
        by_parts = self._index_windows()
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for k, (words, edits) in enumerate(zip(self.items, self.edits.tolist())):
            if k in by_parts:
                cuts = [len(words) * p // (edits + 1) for p in range(edits + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    parts.setdefault(b - a, []).append((self._gram(words[a:b]), k, a))
        self.parts = {}
        for size, rows in parts.items():
            rows.sort()
            self.parts[size] = tuple(np.array(x, np.uint64 if n == 0 else np.int64) for n, x in enumerate(zip(*rows)))

    def _keys(self, stream: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each repetition the keys of the windows from ``starts`` on, and which of them are whole."""
        padded = np.concatenate((stream, np.full(STEPS, -1))).astype(np.int32) + 1
        sampled = {t for places in SAMPLES for t in places}
        for w, moves in enumerate(self.moves):
            at, seen = starts.astype(np.int32), {}
            for t in range(STEPS):
                word = padded[at]
                if t in sampled:
                    seen[t] = word
                # A walk stays at a text's end.
                at = at + np.where(word > 0, moves[t][word], 0)
            for r, places in enumerate(SAMPLES):
                key, whole, moved = np.full(len(starts), w * len(SAMPLES) + r + 1, np.uint64), np.ones(len(starts), bool), np.zeros(len(starts), np.int8)
                for last, t in zip((None, *places), places):
                    key = (key + seen[t].astype(np.uint64)) * _GOLDEN
                    key ^= key >> np.uint64(29)
                    whole &= seen[t] > 1
                    if last is not None:
                        moved += seen[t] != seen[last]
                yield key, whole & (moved >= LEAST_MOVES)

    def _index_windows(self) -> set[int]:
        """Make the index of windows; the items that have too few keys for it."""
        long_ = [k for k in range(len(self.items)) if self.sizes[k] >= SHORT]
        stream = np.concatenate([np.zeros(0, np.int64), *(np.append(self.items[k], -1) for k in long_)])
        begin = np.cumsum([0, *(self.sizes[k] + 1 for k in long_)])
        starts = np.concatenate([np.zeros(0, np.int64), *(b + self.starts[k] for b, k in zip(begin.tolist(), long_))])
        item = np.repeat(np.array(long_, np.int64), [len(self.starts[k]) for k in long_])
        offset = np.concatenate([np.zeros(0, np.int64), *(self.starts[k] for k in long_)])
        rows = [(key[whole], item[whole], offset[whole]) for key, whole in self._keys(stream, starts)]
        keys, items, offsets = (np.concatenate(x) for x in zip(*rows))
        # Windows that reach over their item's end have no key; the rest should have one in each repetition.
        counts = np.bincount(items, minlength=len(self.items))
        wanted = np.bincount(item, minlength=len(self.items)) * len(rows) * LEAST_KEYS
        enough = (counts >= wanted) & (self.sizes >= SHORT)
        own = enough[items]
        keys, items, offsets = keys[own], items[own], offsets[own]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_items, self.key_offsets = keys[order], items[order], offsets[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[keys >> np.uint64(64 - _FILTER_BITS)] = True
        # Words that windows start at; the last place stands for a text's end.
        self.opens = np.zeros(len(self.codes) + 2, bool)
        self.opens[stream[starts[enough[item]]]] = True
        return set(np.flatnonzero(~enough).tolist())

    @staticmethod
    def _gram(words: np.ndarray) -> int:
        total = 0
        for w in words.tolist():
            total = (total * 0x100000001B3 + w) & 0xFFFFFFFFFFFFFFFF
        return total

    def masks(self, item: int) -> dict[int, int]:
        """For each word of an item the bits of its places."""
        found = self._masks.get(item)
        if found is None:
            found = self._masks[item] = {}
            for n, word in enumerate(self.items[item].tolist()):
                found[word] = found.get(word, 0) | 1 << n
        return found

    def candidates(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(document, item, where the item would start) for each hit of the index, in one text stream."""
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        found = []

        def hit(hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray, values: np.ndarray, at: np.ndarray) -> None:
            low, high = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
            rows, at = expand(low, high - low), np.repeat(at, high - low)
            found.append(np.column_stack((np.searchsorted(ends, at, side="right"), items[rows], at - offsets[rows])))

        if len(self.keys):
            starts = np.flatnonzero(self.opens[codes])  # -1, a text's end, is the last place
            for key, whole in self._keys(codes, starts):
                near = np.flatnonzero(whole & self.filter[key >> np.uint64(64 - _FILTER_BITS)])
                hit(self.keys, self.key_items, self.key_offsets, key[near], starts[near])
        for size, (hashes, items, offsets) in self.parts.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(codes) >= size else known[:0]
            values = np.zeros(len(at), np.uint64)
            for k in range(size):
                values = values * np.uint64(0x100000001B3) + codes[at + k].astype(np.uint64)
            hit(hashes, items, offsets, values, at)
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def least_edits(masks: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """Least word edits between an item of ``size`` words and any substring of ``text``, and the first end of such a one.

    Columns of the edit table are kept as the bits of their differences (Myers).
    """
    full, high = (1 << size) - 1, 1 << size - 1
    up, down, now, best, end = full, 0, size, size, 0
    for k, word in enumerate(text, 1):
        same = masks.get(word, 0)
        side = same | down
        same = ((same & up) + up ^ up) | same
        more, less = (down | ~(same | up)) & full, up & same
        if more & high:
            now += 1
        elif less & high:
            now -= 1
            if now < best:
                best, end = now, k
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(side | more)) & full, more & side
    return best, end


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any substring of ``text``: (edits, start, end)."""
    item_, text_ = item.tolist(), text.tolist()
    row = [(0, k) for k in range(len(text_) + 1)]
    for n, word in enumerate(item_, 1):
        last, row = row, [(n, 0)]
        for k, other in enumerate(text_):
            row.append(min((last[k][0] + (word != other), last[k][1]), (last[k + 1][0] + 1, last[k + 1][1]), (row[k][0] + 1, row[k][1])))
    edits, start, end = min((e, s, k) for k, (e, s) in enumerate(row))
    return edits, start, end


def _leak_rows(block: ItemBlock):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = [x.decode().lower().encode().translate(_TABLE).split() for x in text_bytes(batch.column("text"))]
            stream = np.concatenate([np.zeros(0, np.int64), *(np.append(np.fromiter(map(block.codes.get, w, repeat(0)), np.int64, len(w)), -1) for w in words)])
            ends = np.cumsum([len(w) + 1 for w in words])
            leaks: dict[tuple[int, int], tuple] = {}
            for d, i, low, high in _regions(block, stream, ends):
                row = _verified(block, i, stream[low:high])
                if row:
                    first = int(ends[d]) - len(words[d]) - 1
                    row = (row[0], low + row[1] - first, low + row[2] - first)
                    leaks[d, i] = min(leaks.get((d, i), row), row)
            if leaks:
                ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
                keys = sorted(leaks)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([ids[d] for d, _ in keys], pa.int64()),
                        "rid": pa.array([rids[d] for d, _ in keys], pa.int64()),
                        "item_id": pa.array([block.ids[i] for _, i in keys], pa.int64()),
                        "start": pa.array([leaks[k][1] for k in keys], pa.int64()),
                        "end": pa.array([leaks[k][2] for k in keys], pa.int64()),
                        "distance": pa.array([leaks[k][0] for k in keys], pa.int32()),
                        "similarity": pa.array([1 - leaks[k][0] / float(block.sizes[k[1]]) for k in keys], pa.float64()),
                    }
                )

    return rows


def _regions(block: ItemBlock, stream: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, low, high): all parts of the stream that may hold an item; those that overlap are one."""
    doc, item, start = block.candidates(stream, ends).T
    low = np.maximum(start - block.edits[item], np.concatenate(([0], ends))[doc])
    high = np.minimum(start + block.sizes[item] + block.edits[item], ends[doc] - 1)
    # Rows are in the order of document, item and start, so both borders rise inside an item.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    yield from zip(doc[first].tolist(), item[first].tolist(), low[first].tolist(), high[last].tolist())


def _verified(block: ItemBlock, item: int, text: np.ndarray) -> tuple[int, int, int] | None:
    """The best place of an item in ``text`` as (edits, start, end), if it is within the allowed edits."""
    size = int(block.sizes[item])
    edits, end = least_edits(block.masks(item), size, text.tolist())
    if edits > block.edits[item]:
        return None
    # A place as good that starts no later ends at most 2 * edits words later.
    low = max(0, end - size - edits)
    edits, a, b = best_place(block.items[item], text[low : end + 2 * edits])
    return edits, low + a, low + b


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where documents hold benchmark items, at most ``1 - similarity`` of an item's words being edited.

    Returns a row for each document and item that it holds: doc_id, rid (hash of the text),
    item_id, start and end (words of the best place), distance (word edits) and similarity.
    Words are runs of letters and digits in lower case. Items and texts that are null or have no
    word match nothing; null ids and repeated rows come back as they are; other columns are
    ignored. The items are broadcast in blocks of ``BLOCK_ITEMS``; each takes one pass over the
    documents, without a shuffle. The index is probabilistic: at all allowed edits it proposes
    over 99 in 100 places; what it proposes is verified exactly.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rid"), F.col(text_col).cast("string").alias("text"))
    held, found = [], None

    def matched() -> DataFrame:
        part = rows.mapInArrow(_leak_rows(ItemBlock(held, similarity)), _LEAK)
        return part if found is None else found.unionByName(part)

    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) >= BLOCK_ITEMS:
            found, held = matched(), []
    return matched() if held or found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see :func:`leaks`), all columns as they are, whatever their names.

    Rows with a null text stay; rows that repeat an id and a text go or stay together.
    """
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), "rid").distinct()
    source, back = named(docs)
    rows = source.select("*", *row_key(back[id_col], back[text_col]))
    return rows.join(bad, ["did", "rid"], "left_anti").select(*[F.col(c).alias(name) for name, c in back.items()])
