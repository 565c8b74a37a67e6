"""A path made shorter in one task, by moves between near nodes; memory grows with its nodes alone.

Each node has a list of its nearest ones. A node is looked at again only after an edge at it
has changed, and once more with all others when none is left, until nothing changes. Moves turn a stretch of the path round (2-opt) or take one node to another place
(2.5-opt); the ends of the path stay where they are.
"""

from __future__ import annotations

import numpy as np

from ..functions.norms import ARRAY_NORMS

#: Nodes whose neighbours are searched at a time.
_CHUNK = 2048
#: Nodes of which all pairs are compared at once.
_ALL = 64


def nearest_lists(x: np.ndarray, y: np.ndarray, k: int, norm: str) -> list[list[int]]:
    """Up to ``k`` nearest others of each point by the norm, nearest first, ties by number; from square cells of few points."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return [[] for _ in range(n)]
    if n <= _ALL:
        d = ARRAY_NORMS[norm](x[:, None] - x, y[:, None] - y).astype(np.float64)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1, kind="stable")[:, :k].tolist()
    side = max(float(np.ptp(x)), float(np.ptp(y)), 1e-9) / max(1.0, np.sqrt(n / (k + 1)))
    cx, cy = ((v - v.min()) // side for v in (x, y))
    wide = int(cy.max()) + 1
    cell = (cx * wide + cy).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    held = cell[order]
    out: list[list[int]] = [[]] * n
    todo, reach = np.arange(n), 1
    while len(todo):
        again = []
        for part in np.split(todo, range(_CHUNK, len(todo), _CHUNK)):
            for a in part.tolist():
                rows = np.arange(max(0, int(cx[a]) - reach), int(cx[a]) + reach + 1) * wide
                low, high = max(0, int(cy[a]) - reach), min(wide - 1, int(cy[a]) + reach)
                first, last = np.searchsorted(held, rows + low), np.searchsorted(held, rows + high, side="right")
                near = np.concatenate([order[p:q] for p, q in zip(first.tolist(), last.tolist())])
                near = near[near != a]
                d = ARRAY_NORMS[norm](x[near] - x[a], y[near] - y[a])
                best = np.lexsort((near, d))[:k]
                # Nodes further away than the cells reach are further than this in a coordinate.
                if len(near) < n - 1 and (len(best) < k or d[best[-1]] > ARRAY_NORMS[norm](np.array([reach * side]), np.array([0.0]))[0]):
                    again.append(a)
                else:
                    out[a] = near[best].tolist()
        todo, reach = np.array(again, np.int64), 2 * reach
    return out


def shorter_path(x: np.ndarray, y: np.ndarray, norm: str, k: int = 10) -> np.ndarray:
    """An order of the points 0..n-1, the first and the last in place, that no move between near nodes makes shorter.

    A move is a 2-opt or 2.5-opt move that makes an edge from a node to one of its ``k`` nearest.
    """
    n = len(x)
    at = np.arange(n)
    if n < 4:
        return at
    near, place = nearest_lists(x, y, k, norm), np.arange(n)
    px, py, measure = x.tolist(), y.tolist(), _scalar(norm)

    def d(a: int, b: int) -> int:
        return measure(px[a] - px[b], py[a] - py[b])

    def turn(p: int, q: int) -> None:
        at[p : q + 1] = at[p : q + 1][::-1].copy()
        place[at[p : q + 1]] = np.arange(p, q + 1)

    def shift(p: int, q: int) -> None:
        """The node at p goes to q; those between move up."""
        node = at[p]
        if p < q:
            at[p:q] = at[p + 1 : q + 1].copy()
        else:
            at[q + 1 : p + 1] = at[q:p].copy()
        at[q] = node
        low, high = min(p, q), max(p, q)
        place[at[low : high + 1]] = np.arange(low, high + 1)

    def move(a: int) -> list[int] | None:
        """Make the first shortening move at ``a``; the nodes of which an edge has changed."""
        p = int(place[a])
        for step in (1, -1):
            if not 0 <= p + step < n:
                continue
            b = int(at[p + step])
            ab = d(a, b)
            for c in near[a]:
                ac = d(a, c)
                if ac >= ab:
                    break
                q = int(place[c])
                if not 0 <= q + step < n:
                    continue
                e = int(at[q + step])
                if ab + d(c, e) - ac - d(b, e) > 0:
                    low, high = min(p, q), max(p, q)
                    turn(low + 1, high) if step == 1 else turn(low, high - 1)
                    return [a, b, c, e]
        if 0 < p < n - 1:
            b, e = int(at[p - 1]), int(at[p + 1])
            away = d(b, a) + d(a, e) - d(b, e)
            for c in near[a]:
                ac, q = d(a, c), int(place[c])
                for step in (1, -1):  # between c and the node after or before it
                    if not 0 <= q + step < n:
                        continue
                    f = int(at[q + step])
                    if f != a and away - ac - d(a, f) + d(c, f) > 0:
                        low = min(q, q + step)
                        shift(p, low if p < low else low + 1)
                        return [a, b, e, c, f]
        return None

    moved = True
    while moved:  # a last look at all nodes, as an edge far away may have become worth a move
        queue, waiting, moved = list(range(n - 1, -1, -1)), [True] * n, False
        while queue:
            a = queue.pop()
            waiting[a] = False
            while (changed := move(a)) is not None:
                moved = True
                for c in changed:
                    if c != a and not waiting[c]:
                        waiting[c] = True
                        queue.append(c)
    return at


def _scalar(norm: str):
    """The norm of one pair, as Python numbers."""
    whole = ARRAY_NORMS[norm]
    fast = {"EUC_2D": lambda u, v: int((u * u + v * v) ** 0.5 + 0.5)}
    return fast.get(norm, lambda u, v: int(whole(np.array([u]), np.array([v]))[0]))
