"""Re-Pair grammars over integer sequences, in rounds that replace many frequent pairs at once."""

from __future__ import annotations

import numpy as np

from .common import expand


def _left_to_right(match: np.ndarray) -> np.ndarray:
    """Of overlapping matches (at i and i + 1) every second one from the left."""
    at = np.arange(len(match))
    begins = match & ~np.concatenate(([False], match[:-1]))
    return match & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0)


#: Buckets in which pairs are counted before any is looked at closely.
_BITS = 18
#: A grammar's symbols fit 16 bits, unless the ids themselves don't.
NARROW = 1 << 16


def _frequent(code: np.ndarray, free: np.ndarray, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of about the ``pairs`` most frequent pairs, in the order of the pairs, and where each pair's places begin.

    No pair occurs more often than its bucket is hit, so all pairs that occur as often as the
    fullest ``pairs`` buckets are among these buckets' places, and only those are sorted, by the
    bits of their hash that a place leaves free. A pair that another one with the same bits tears
    apart counts as several.
    """
    hashes = code * np.uint64(0x9E3779B97F4A7C15)
    bucket = (hashes >> np.uint64(64 - _BITS)).astype(np.int32)
    place = np.uint64((1 << max(1, len(code).bit_length())) - 1)
    hits = np.bincount(bucket[free], minlength=1 << _BITS)
    often = int(np.partition(hits, -pairs)[-pairs])
    while True:
        often = max(often, least)
        at = np.flatnonzero(free & (hits >= often)[bucket])
        at = (np.sort((hashes[at] & ~place) | at.astype(np.uint64)) & place).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], code[at][1:] != code[at][:-1]))) if len(at) else at
        counts = np.diff(np.append(edges, len(at)))
        if (counts >= often).any() or often == least:
            keep = counts >= often
            return at[np.repeat(keep, counts)], np.cumsum(counts[keep]) - counts[keep]
        often //= 2


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int, pairs: int = 4096, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs by new symbols, round by round.

    ``ends``: True at the last id of each document; no pair reaches over it. Each round gives
    the most frequent adjacent pairs (at least ``least`` times) a symbol, about as many as half of
    the symbols that are left, or ``pairs``; a pair of which overlapping pairs leave fewer than
    half of ``least`` waits. Rounds go on until no pair is
    replaced or the 16-bit symbols are used up (where ``first_symbol`` leaves any, else 2^31).
    Returns the sequence, the rules (left, right; rule k makes symbol ``first_symbol + k``) and
    how many ids each rule expands to.
    """
    seq, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    sizes = np.ones(first_symbol, np.int64)
    limit = NARROW if first_symbol < NARROW else 1 << 31
    while len(seq) > 1:
        code = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        left = limit - len(sizes)
        at, begins = _frequent(code, ~ends[:-1], min(max(pairs, left // 2), 1 << _BITS), least)
        if not len(at) or not left:
            break
        counts = np.diff(np.append(begins, len(at)))
        pair = np.full(len(code), -1, np.int32)
        pair[at] = np.repeat(np.arange(len(begins)), counts)
        taken = _left_to_right(pair >= 0)
        uses = np.bincount(pair[taken], minlength=len(begins))
        chosen = np.flatnonzero(2 * uses >= least)
        chosen = np.sort(chosen[np.argsort(-uses[chosen], kind="stable")[:left]])
        if not len(chosen):
            break
        place = np.full(len(begins), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        where = np.flatnonzero(taken)
        where = where[place[pair[where]] >= 0]
        made = code[at[begins[chosen]]]
        made = np.column_stack((made >> np.uint64(32), made & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        rules.append(made)
        seq[where] = len(sizes) + place[pair[where]]
        sizes = np.concatenate((sizes, sizes[made].sum(axis=1)))
        ends[where] = ends[where + 1]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        seq, ends = seq[stay], ends[stay]
    return seq, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), sizes[first_symbol:].astype(np.uint32)


def _unfold(seq: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Replace symbols by their pairs until only ids are left."""
    seq = seq.astype(np.uint32)
    while len(seq) and len(rules):
        open_ = seq >= first_symbol
        if not open_.any():
            break
        widths = np.where(open_, 2, 1)
        at = np.cumsum(widths) - widths
        out = np.repeat(seq, widths)
        made = rules[seq[open_].astype(np.int64) - first_symbol]
        out[at[open_]], out[at[open_] + 1] = made[:, 0], made[:, 1]
        seq = out
    return seq


def decompress(seq: np.ndarray, rules: np.ndarray, first_symbol: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that ``seq`` stands for; with the rules' ``sizes`` each rule is unfolded once, if that is less than the sequence."""
    if sizes is None or not len(rules) or int(sizes.sum(dtype=np.int64)) > 2 * len(seq):
        return _unfold(seq, rules, first_symbol)
    flat = _unfold(np.arange(first_symbol, first_symbol + len(rules)), rules, first_symbol)
    seq = seq.astype(np.int64)
    open_ = seq >= first_symbol
    counts = np.ones(len(seq), np.int64)
    counts[open_] = sizes[seq[open_] - first_symbol]
    # Ids stand before the unfolded rules in one table.
    starts = seq.copy()
    starts[open_] = first_symbol + (np.cumsum(sizes, dtype=np.int64) - sizes)[seq[open_] - first_symbol]
    return np.concatenate((np.arange(first_symbol, dtype=np.uint32), flat))[expand(starts, counts)]


def decode_range(seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first_symbol: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start .. stop - 1``; only the symbols that reach into that range are expanded."""
    own = np.ones(len(seq), np.int64)
    open_ = seq >= first_symbol
    own[open_] = sizes[seq[open_].astype(np.int64) - first_symbol]
    ends = np.cumsum(own)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    if stop <= start:
        return np.zeros(0, np.uint32)
    base = int(ends[a - 1]) if a else 0
    return decompress(seq[a:b], rules, first_symbol)[start - base : stop - base]
