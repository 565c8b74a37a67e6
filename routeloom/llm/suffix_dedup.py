"""Suffix-array deduplication of repeated byte strings.

For each place of each text the longest factor that also starts elsewhere is found, up to a
depth, as far as it is at least as long as the shortest string asked for:

1. Each text gives its anchor runs (:mod:`.anchors`); only anchors whose hash repeats go on.
2. Runs with equal bytes (by 128-bit digest) are one class: its members repeat each other,
   whatever their number, and only the first of a class goes on. Copies cost one row each.
3. Classes that share an anchor are brought together with their bytes. A task sorts the suffixes
   that it holds (by prefix doubling, up to the depth) and reads from the suffix array, for each
   place, the longest previous factor: of the suffixes that start earlier in the corpus the
   longest common prefix is with the previous or the next smaller position in suffix order. The
   longest factor that stands anywhere else is a neighbour's in suffix order.
4. An anchor whose classes have more bytes than ``max_group`` isn't given to one task. Its windows are
   compared by 128-bit digest in ordinary aggregations, which Spark spreads.

A *wish* is a length and which copies to find: ``first`` leaves the first (previous factors),
``none`` leaves no copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.session import materialize, release
from .anchors import runs
from .common import STEP_BYTES, mix, named, row_key, text_bytes

_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A longer text is looked at in pieces that overlap by one window.
_PIECE = 1 << 22
#: Bytes for one suffix array; a group of classes larger than this has an array of its own.
_ARRAY_BYTES = 1 << 18

_RUN = "did long, rid long, lo long, n int, size int, key long, content long, content2 long"
_HIT = "did long, rid long, lo long, n int, wish int"

Wish = tuple[int, str]


def _pieces(text: bytes, window: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text in which other windows start, each with the ``depth`` bytes from its last window's start on."""
    if len(text) <= _PIECE:
        yield 0, text
        return
    for base in range(0, len(text) - window + 1, _PIECE):
        yield base, text[base : base + _PIECE + depth - 1]


def _run_rows(window: int, depth: int, gram: int):
    def flush(held: list) -> pa.RecordBatch:
        joined = b"".join(x[3] for x in held)
        sizes = np.array([len(x[3]) for x in held], np.int64)
        ends = np.cumsum(sizes)
        lo, hi, _, key = runs(_SYMBOL[np.frombuffer(joined, np.uint8)], ends, window, gram)
        piece = np.searchsorted(ends, lo, side="right")
        # Of a part of a longer text, only windows that start in it are its own.
        mine = lo - (ends - sizes)[piece] < _PIECE
        lo, hi, key, piece = lo[mine], hi[mine], key[mine], piece[mine]
        hi = np.minimum(hi, (ends - sizes)[piece] + _PIECE - 1)
        stop = np.minimum(hi + depth, ends[piece])
        view, digest = memoryview(joined), xxhash.xxh3_128_digest
        content = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(lo.tolist(), stop.tolist())]), np.int64)
        shift = np.array([x[2] for x in held], np.int64)[piece] - (ends - sizes)[piece]
        did, rid = (np.array([x[k] for x in held], np.int64)[piece] for k in (0, 1))
        columns = [did, rid, lo + shift, (hi - lo + 1).astype(np.int32), (stop - lo).astype(np.int32), key, content[::2].copy(), content[1::2].copy()]
        return pa.record_batch(columns, names=[x.split()[0] for x in _RUN.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, rids = batch.column("did").to_pylist(), batch.column("rid").to_pylist()
            for did, rid, text in zip(ids, rids, text_bytes(batch.column("text"))):
                if len(text) < window:
                    continue
                for base, piece in _pieces(text, window, depth):
                    held.append((did, rid, base, piece))
                    size += len(piece)
                    if size >= STEP_BYTES:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return rows


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents' row keys and texts."""
    return docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs listed for each document."""
    for batch in batches:
        out: list = []
        size = 0
        for did, rid, text, listed in zip(batch.column("did").to_pylist(), batch.column("rid").to_pylist(), text_bytes(batch.column("text")), batch.column("listed").to_pylist()):
            for r in listed:
                piece = text[r["lo"] : r["lo"] + r["size"]]
                out.append((r["key"], r["classes"], did, rid, r["lo"], r["n"], piece))
                size += len(piece)
            if size > STEP_BYTES:
                yield _piece_batch(out)
                out, size = [], 0
        if out:
            yield _piece_batch(out)


_PIECE_ROW = "key long, classes long, did long, rid long, lo long, n int, piece binary"


def _piece_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _PIECE_ROW.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _order(high: np.ndarray, low: np.ndarray | None, top: int) -> np.ndarray:
    """The order of (high, low) pairs below ``top``; where key and place fit 64 bits they are sorted as one number."""
    n, bits = len(high), max(1, (len(high) - 1).bit_length())
    key = high.astype(np.uint64)
    if low is not None:
        width = max(1, (top - 1).bit_length())
        key = (key << np.uint64(width)) | low.astype(np.uint64)
        top = 1 << 2 * width
    if (top - 1).bit_length() + bits > 64:
        return np.argsort(key, kind="stable")
    key = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def prefix_ranks(symbols: np.ndarray, depth: int, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, ranks) at growing lengths up to ``depth``: the rank of a suffix's first symbols (prefix doubling).

    Equal prefixes have equal ranks, and ranks are in lexicographic order. Symbols are 0 to 256;
    past the end zeros follow. The last ranks are those of the ``starts``; a level ranks only the
    places that the next one is made of, the others are zero.
    """
    n, lengths = len(symbols), [min(5, depth)]
    while lengths[-1] < depth:
        lengths.append(min(2 * lengths[-1], depth))
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    masks = [wanted.copy()]
    for step in (b - a for a, b in zip(lengths[-2::-1], lengths[::-1])):
        wanted[step:] |= wanted[:-step].copy()
        masks.append(wanted.copy())
    padded = np.concatenate((symbols, np.zeros(lengths[0], symbols.dtype)))
    at = np.flatnonzero(masks.pop())
    high = np.zeros(len(at), np.uint64)
    for k in range(lengths[0]):
        high = high * np.uint64(257) + padded[at + k]
    levels: list[tuple[int, np.ndarray]] = []
    low, top = None, 257 ** lengths[0]
    for k, length in enumerate(lengths):
        order = _order(high, low, top)
        fresh = high[order][1:] != high[order][:-1]
        if low is not None:
            fresh |= low[order][1:] != low[order][:-1]
        rank = np.zeros(n + depth, np.uint32)
        rank[at[order]] = np.concatenate(([0], np.cumsum(fresh, dtype=np.uint32)))
        levels.append((length, rank))
        if masks:
            at = np.flatnonzero(masks.pop())
            high, low, top = rank[at], rank[at + lengths[k + 1] - length], n
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes ``a[i]`` and ``b[i]``, up to the last level's length."""
    n, depth = len(symbols), levels[-1][0]
    out = np.where(levels[-1][1][a] == levels[-1][1][b], depth, 0)
    open_ = np.flatnonzero(out == 0)
    p, q, length = a[open_], b[open_], np.zeros(len(open_), np.int64)
    for size, rank in levels[-2::-1]:
        # Were the sum not below the depth, the prefixes would be equal up to there.
        ok = (p + length < n) & (q + length < n) & (length + size < depth)
        ok[ok] = rank[(p + length)[ok]] == rank[(q + length)[ok]]
        length += np.where(ok, size, 0)
    for _ in range(min(5, depth)):  # what is left is shorter than the first level
        ok = (p + length < n) & (q + length < n)
        ok[ok] = symbols[(p + length)[ok]] == symbols[(q + length)[ok]]
        length += np.where(ok, 1, 0)
        p, q, length, open_ = _closed(out, ok, p, q, length, open_)
    out[open_] = length
    return np.minimum(out, depth)


def _closed(out: np.ndarray, ok: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    out[at[~ok]] = length[~ok]
    return p[ok], q[ok], length[ok], at[ok]


def nearest_smaller(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each slot of a suffix array the common prefix with the previous slot of a smaller place, 0 if there is none.

    ``places``: corpus positions in suffix order; ``common[k]``: common prefix of slots k - 1 and
    k. All slots between a slot and its pointer are larger, so a pointer may take over the one
    of the slot it points to; the stretch behind it doubles each time.
    """
    to, least = np.arange(len(places)) - 1, common.copy()
    open_ = np.flatnonzero((to >= 0) & (places[np.maximum(to, 0)] > places))
    while len(open_):
        at = to[open_]
        least[open_] = np.minimum(least[open_], least[at])
        to[open_] = to[at]
        open_ = open_[to[open_] >= 0]
        open_ = open_[places[to[open_]] > places[open_]]
    return np.where(to >= 0, least, 0)


def longest_factors(pieces: list[bytes], counts: np.ndarray, corpus_order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first ``counts[i]`` places of each piece: the longest previous factor, and the longest factor elsewhere.

    ``corpus_order``: the order of the pieces in the corpus; they don't overlap in places.
    Lengths are cut at ``depth`` and at a piece's end. All places of the first piece come before
    those of the next.
    """
    # A separator, 0, between the pieces: no text symbol equals it.
    sizes = np.array([len(x) + 1 for x in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[begin + sizes - 1] = 0
    piece = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[piece] + inner
    levels = prefix_ranks(symbols, depth, start)
    # Corpus positions, and the suffix array of the places (ties in the order of the corpus).
    rank_in_corpus = np.empty(len(piece), np.int64)
    rank_in_corpus[np.lexsort((inner, corpus_order[piece]))] = np.arange(len(piece))
    n = len(piece)
    order = _order(levels[-1][1][start], rank_in_corpus, max(n, len(symbols)))
    suffix, places = start[order], rank_in_corpus[order]
    common = np.zeros(n + 1, np.int64)
    common[1:n] = common_prefixes(levels, symbols, suffix[:-1], suffix[1:])
    rest = (sizes[piece] - 1 - inner)[order]
    before = nearest_smaller(places, common[:n])
    after = nearest_smaller(places[::-1], np.concatenate(([0], common[1:n][::-1])))[::-1] if n else before
    previous, elsewhere = np.empty(n, np.int64), np.empty(n, np.int64)
    previous[order] = np.minimum(np.maximum(before, after), rest)
    elsewhere[order] = np.minimum(np.maximum(common[:n], common[1:]), rest)
    return previous, elsewhere


def _stretches(hit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, first place and length of each stretch of flags; one that goes on in the next piece is cut there."""
    inside = hit.copy()
    inside[1:] &= hit[:-1]
    inside[:1] = False
    cuts = bounds[:-1]
    inside[cuts[cuts < len(hit)]] = False
    first = np.flatnonzero(hit & ~inside)
    last = np.flatnonzero(hit & ~np.append(inside[1:], False))
    piece = np.searchsorted(bounds, first, side="right")
    return piece, first, last - first + 1


def _suffix_rows(wishes: list[Wish]):
    depth = max(n for n, _ in wishes)

    def solve(held: list) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(held)), key=lambda k: held[k][1:4])
        corpus_order = np.empty(len(held), np.int64)
        corpus_order[order] = np.arange(len(held))
        counts = np.array([x[4] for x in held], np.int64)
        previous, elsewhere = longest_factors([x[5] for x in held], counts, corpus_order, depth)
        bounds = np.cumsum(counts)
        for wish, (length, keep) in enumerate(wishes):
            piece, at, n = _stretches((previous if keep == "first" else elsewhere) >= length, bounds)
            columns = [np.array([x[k] for x in held], np.int64)[piece] for k in (1, 2, 3)]
            columns[2] = columns[2] + at - (bounds - counts)[piece]
            yield pa.record_batch([*columns, n.astype(np.int32), np.full(len(n), wish, np.int32)], names=["did", "rid", "lo", "n", "wish"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            names = ("key", "did", "rid", "lo", "n", "piece")
            for row in zip(*(batch.column(x).to_pylist() for x in names)):
                if row[0] != key and size >= _ARRAY_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                key = row[0]
                if held and held[-1][:4] == row[:4]:
                    continue  # a repeated row of the same document, which was settled by its class
                held.append(row)
                size += len(row[5])
        if held:
            yield from solve(held)

    return rows


def _window_rows(wishes: list[Wish]):
    """Rows with the digest of each window of each wish, for anchors with very many classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for did, rid, lo, n, piece in zip(*(batch.column(x).to_pylist() for x in ("did", "rid", "lo", "n", "piece"))):
                view = memoryview(piece)
                for wish, (length, _) in enumerate(wishes):
                    m = min(n, len(piece) - length + 1)
                    if m > 0:
                        halves = np.frombuffer(b"".join([digest(view[k : k + length]) for k in range(m)]), np.int64)
                        columns = [np.full(m, did), np.full(m, rid), lo + np.arange(m), np.full(m, wish, np.int32), halves[::2].copy(), halves[1::2].copy()]
                        yield pa.record_batch(columns, names=["did", "rid", "lo", "wish", "a", "b"])

    return rows


def repeated_windows(docs: DataFrame, wishes: list[Wish], gram: int = 32, max_group: int = 1 << 22) -> DataFrame:
    """Stretches ``lo .. lo + n - 1`` of starts of repeated strings, for ``docs`` from :func:`keyed`; ``wish``: of which wish."""
    if not wishes or any(keep not in ("first", "none") or n < 1 for n, keep in wishes):
        raise ValueError(f"wishes are lengths from 1 on with first or none, not {wishes!r}")
    window, depth = min(n for n, _ in wishes), max(n for n, _ in wishes)
    # Rows that repeat an id and a text give the same runs; they are copies only if none is to be kept.
    rows = docs.select("did", "rid", "text")
    members = materialize(rows.mapInArrow(_run_rows(window, depth, min(gram, window)), _RUN), "runs")
    content = ["content", "content2"]
    shared = members.groupBy("key").agg(F.count("*").alias("m"), *[(F.min(c) != F.max(c)).alias(f"by_{c}") for c in content]).filter("m > 1")
    # Written first, so that the join's two sides are plain shuffles, whose hot keys Spark splits.
    shared = materialize(shared.select("key", (F.col("by_content") | F.col("by_content2")).alias("mixed")), "shared-anchors")
    found, members = members, materialize(members.join(shared, "key"), "shared-runs")
    release(found, shared)
    classes = materialize(
        members.groupBy("key", *content).agg(F.min(F.struct("did", "rid", "lo", "n", "size")).alias("rep"), F.count("*").alias("m"), F.first("mixed").alias("mixed")), "classes"
    )
    again = materialize(classes.filter("m > 1").select("key", *content, "rep"), "repeated-runs")
    copies = members.join(again, ["key", *content])
    later = F.expr("did != rep.did or rid != rep.rid or lo != rep.lo")
    parts = [
        (copies.filter(later) if keep == "first" else copies).select("did", "rid", "lo", F.least("n", F.col("size") - (length - 1)).alias("n"), F.lit(wish).alias("wish")).filter("n > 0")
        for wish, (length, keep) in enumerate(wishes)
    ]

    sizes = materialize(classes.filter("mixed").groupBy("key").agg(F.sum("rep.size").alias("classes")), "class-sizes")
    listed = (
        classes.filter("mixed")
        .join(sizes, "key")
        .select("key", "classes", "rep.*")
        .groupBy("did", "rid")
        .agg(F.collect_list(F.struct("key", "classes", "lo", "n", "size")).alias("listed"))
    )  # classes: the bytes of all classes of an anchor
    pieces = materialize(rows.join(listed, ["did", "rid"]).mapInArrow(_cut_runs, _PIECE_ROW), "pieces")
    dealt = pieces.filter(F.col("classes") <= max_group).repartition("key").sortWithinPartitions("key", "did", "rid", "lo")
    parts.append(materialize(dealt.mapInArrow(_suffix_rows(wishes), _HIT), "factors"))
    windows = pieces.filter(F.col("classes") > max_group).mapInArrow(_window_rows(wishes), "did long, rid long, lo long, wish int, a long, b long")
    groups = windows.groupBy("a", "b", "wish").agg(F.min(F.struct("did", "rid", "lo")).alias("rep"), F.count("*").alias("m")).filter("m > 1")
    firsts = [w for w, (_, keep) in enumerate(wishes) if keep == "first"]
    common = windows.join(groups, ["a", "b", "wish"]).filter(later | ~F.col("wish").isin(firsts))
    parts.append(common.select("did", "rid", "lo", F.lit(1).alias("n"), "wish"))
    hits = materialize(reduce(DataFrame.unionByName, parts), "repeated-windows")
    release(members, classes, again, sizes, pieces)
    return hits


def _spans(listed: list, window: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, n in sorted((r["lo"], r["n"]) for r in listed or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], lo + n - 1 + window)
        else:
            out.append([lo, lo + n - 1 + window])
    return [(a, b) for a, b in out]


def _cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _result_rows(window: int, report: int, texts_out: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.column("did").to_pylist(), text_bytes(batch.column("text")), batch.column("listed").to_pylist()
            spans = [_spans([r for r in x or () if not r["wish"]], window) for x in lists]
            kept = [_cut_text(t, s) if s else t for t, s in zip(texts, spans)]
            out = {
                "doc_id": pa.array([None if x == -(2**63) else x for x in ids], pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            }
            if report:
                out["n_repeated"] = pa.array([sum(b - a for a, b in _spans([r for r in x or () if r["wish"]], report)) for x in lists], pa.int64())
            if texts_out:
                out["kept"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                out["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch(out)

    return rows


def suffix_array_dedup(docs: DataFrame, min_bytes: int = 400, keep: str = "first", report: int = 0, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove each byte of a string of ``min_bytes`` bytes that also starts elsewhere.

    ``keep``: ``first`` leaves the first copy (in the order of ids), ``none`` leaves none.
    Returns per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with
    ``report`` also n_repeated, the bytes covered by strings of ``report`` bytes that start
    earlier, too (the longest previous factors at a second length); with ``texts`` ``kept`` (what
    is left; a character cut in half at a span's end is dropped) and ``spans``. Null texts count
    as empty; texts shorter than ``min_bytes`` stay whole; other columns of ``docs`` are ignored.
    A null id comes back as null. Rows that repeat an id with the same text are separate copies
    under ``none`` and one document under ``first``. No rows in, no rows out.
    """
    rows = keyed(docs, id_col, text_col)
    wishes = [(min_bytes, keep), *[(report, "first")] * bool(report)]
    hits = repeated_windows(rows, wishes).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "n", "wish")).alias("listed"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(report) + ", kept string, spans array<struct<start: long, end: long>>" * texts
    return rows.join(hits, ["did", "rid"], "left").select("did", "text", "listed").mapInArrow(_result_rows(min_bytes, report, texts), schema)


def _text_rows(window: int, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut_text(t, _spans(x, window)).decode("utf-8", "ignore") if x else None for t, x in zip(text_bytes(batch.column(text)), batch.column("listed").to_pylist())]
            cut = pa.compute.coalesce(pa.array(texts, pa.string()), batch.column(text))
            names = [c for c in batch.schema.names if c != "listed"]
            yield pa.record_batch([cut if c == text else batch.column(c) for c in names], names=names)

    return rows


def remove_repeats(docs: DataFrame, min_bytes: int = 400, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the texts without their repeated strings (see :func:`suffix_array_dedup`).

    A text of which nothing is left comes back empty, a null one as null. Columns may have any names.
    """
    hits = repeated_windows(keyed(docs, id_col, text_col), [(min_bytes, keep)]).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "n")).alias("listed"))
    source, back = named(docs)
    text = back[text_col]
    rows = source.withColumn(text, F.col(text).cast("string"))
    rows = rows.select("*", *row_key(back[id_col], text))
    joined = rows.join(hits, ["did", "rid"], "left").select(*back.values(), "listed")
    out = joined.mapInArrow(_text_rows(min_bytes, text), rows.select(*back.values()).schema)
    return out.select(*[F.col(c).alias(name) for name, c in back.items()])
