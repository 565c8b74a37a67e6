"""Anchors: a sparse choice of positions on which equal windows always agree.

Each window of ``window`` symbols chooses the smallest hash among its ``gram``-symbol
substrings (the leftmost one if several are equal). Equal windows choose the same substring at
the same offset, so a window can only repeat where the hash of its anchor repeats. Neighbouring
windows mostly share an anchor and form a *run*; a table of runs is about ``2 / (window - gram)``
of the text in rows, which is what is shuffled in place of all windows.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _BASE if kind == "base" else _INVERSE, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Scrambled polynomial hash of ``symbols[i : i + gram]`` for each i (uint64 symbols)."""
    n = len(symbols)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * _power("base", n), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _power("inverse", n - gram + 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def runs(symbols: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of several texts laid end to end.

    ``symbols``: uint64, all texts; ``ends``: for each text where it ends. Returns first and
    last window start of each run, its anchor's position and its anchor's 64-bit hash.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return none, none, none, none
    hashes = gram_hashes(symbols, gram)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (_sliding_min(order, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(chosen), bool)  # windows that end in the text they start in
    for end in ends.tolist():
        inside[max(0, end - window + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none
    anchor = chosen[at]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return at[first], at[last], anchor[first], hashes[anchor[first]].view(np.int64)
