"""Rounds and plans that don't depend on a table's size: linking, fragments, blocks, segment cuts, pricing on layered grids."""

import random
from collections import Counter

import pytest


def points(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "id long, x double, y double")


def length(a, b):
    return int(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 + 0.5)


def scan(rows, paths, rule):
    """The links of the sequential rules, as pairs."""
    n = len(rows)
    degree, part = Counter(v for e in paths for v in e), list(range(n))

    def join(a, b):
        old, new = part[a], part[b]
        degree[a] += 1
        degree[b] += 1
        for k in range(n):
            part[k] = new if part[k] == old else part[k]

    for a, b in paths:
        degree[a] -= 1
        degree[b] -= 1
        join(a, b)
    out = []
    while len(set(part)) > 1:
        free = [k for k in range(n) if degree[k] < 2]
        if rule == "lowest":
            a = free[0]
            b = next(k for k in free if part[k] != part[a])
        else:
            _, a, b = min((length(rows[a], rows[b]), a, b) for a in free for b in free if a < b and part[a] != part[b])
        join(a, b)
        out.append((min(a, b), max(a, b)))
    ends = [k for k in range(n) if degree[k] < 2]
    return sorted(out + ([tuple(ends)] if len(ends) == 2 else []))


def some_paths(rng, n):
    order = rng.sample(range(n), n)
    return [tuple(sorted(order[k : k + 2])) for k in range(n - 1) if rng.random() < 0.45]


@pytest.mark.parametrize("n, shape", [(1, "none"), (2, "none"), (17, "paths"), (18, "neighbours"), (26, "none")])
def test_links_are_those_of_the_scan_at_any_size(spark, n, shape):
    from routeloom.operators.construct import is_tour, link_fragments

    rng = random.Random(n)
    rows = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
    # Neighbouring ids on one path are what the lowest rule has to step over.
    paths = {"paths": some_paths(rng, n), "none": [], "neighbours": [(k, k + 1) for k in range(0, n - 1, 2)]}[shape]
    taken = spark.createDataFrame([(a, b, length(rows[a], rows[b])) for a, b in paths], "i long, j long, len long")
    for rule, local in (("lowest", 2000), ("nearest", 2000), ("nearest", 0))[: 3 if shape == "paths" else 2]:
        links = link_fragments(points(spark, rows), taken, "EUC_2D", rule, local).collect()
        assert sorted((r["i"], r["j"]) for r in links) == scan(rows, paths, rule), (rule, local)
        assert all(r["len"] == length(rows[r["i"]], rows[r["j"]]) for r in links)
    if n > 2:
        assert is_tour(taken.select("i", "j").unionByName(spark.createDataFrame([(r["i"], r["j"]) for r in links], "i long, j long")), n)


@pytest.mark.parametrize("rows", [[(0, 0), (1, 0), (1, 10), (0, 11)], None])
def test_fragments_of_rounds_close_no_cycle(spark, rows):
    """Two short edges far apart whose ends are each other's nearest: the rounds mustn't close the square."""
    from routeloom.operators.construct import greedy_fragments

    rng = random.Random(11)
    rows = rows or [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    n = len(rows)
    e = spark.createDataFrame([(a, b, length(rows[a], rows[b])) for a in range(n) for b in range(a + 1, n)], "i long, j long, len long")
    taken = [sorted((r["i"], r["j"]) for r in greedy_fragments(e, local=k).collect()) for k in (50_000, 0)]
    degree, part, wanted = Counter(), list(range(n)), []
    for _, a, b in sorted((length(rows[a], rows[b]), a, b) for a in range(n) for b in range(a + 1, n)):
        if degree[a] < 2 and degree[b] < 2 and part[a] != part[b]:
            part = [part[b] if x == part[a] else x for x in part]
            degree[a] += 1
            degree[b] += 1
            wanted.append((a, b))
    assert taken[0] == taken[1] == sorted(wanted) and len(wanted) == n - 1


def test_edges_that_are_no_tour_are_an_error(spark):
    from routeloom.operators import tours

    def frame(pairs):
        return spark.createDataFrame([(7, a, b) for a, b in pairs], "tour_id long, i long, j long")

    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    old = tours.LOCAL_TOUR
    try:
        for tours.LOCAL_TOUR in (old, 0):
            for bad in (two, [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (0, 2), (2, 3)]):
                with pytest.raises(Exception, match="tour 7"):
                    tours.edges_to_tour(frame(bad)).collect()
            both = frame([(0, 1), (1, 2), (0, 2)]).unionByName(spark.createDataFrame([(8, 3, 4), (8, 4, 3)], "tour_id long, i long, j long"))
            assert sorted(map(tuple, tours.edges_to_tour(both).collect())) == [(7, 0, 0), (7, 1, 1), (7, 2, 2), (8, 0, 3), (8, 1, 4)]
    finally:
        tours.LOCAL_TOUR = old


def blocks_of(edges):
    """Blocks as sets of edges: two edges at a node are of one block if their other ends stay connected without it."""
    parent = {e: e for e in edges}

    def root(e):
        while parent[e] != e:
            e = parent[e]
        return e

    for v in {x for e in edges for x in e}:
        at = [e for e in edges if v in e]
        for e in at:
            seen, todo = {v}, [e[0] if e[1] == v else e[1]]
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen.add(u)
                    todo += [b if a == u else a for a, b in edges if u in (a, b)]
            for f in at:
                if (f[0] if f[1] == v else f[1]) in seen:
                    parent[root(e)] = root(f)
    out = {}
    for e in edges:
        out.setdefault(root(e), set()).add(e)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("n, m, seed", [(14, 16, 1), (30, 36, 2), (25, 60, 3), (9, 0, 5)])
def test_blocks_of_any_graph(spark, n, m, seed):
    from routeloom.operators import components
    from routeloom.operators.blocks import edge_blocks

    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | ({(0, k) for k in range(1, n, 3)} if seed == 2 else set()))
    old = components.LOCAL_EDGES
    components.LOCAL_EDGES = 0 if seed == 1 else old
    try:
        rows = edge_blocks(spark.createDataFrame(edges, "i long, j long"), local=0 if seed < 3 else 50_000).collect()
    finally:
        components.LOCAL_EDGES = old
    found = {}
    for r in rows:
        found.setdefault((r["component"], r["block"]), []).append((r["i"], r["j"]))
    assert sorted(map(sorted, found.values())) == blocks_of(edges)


def test_a_long_path_and_a_hub(spark):
    from routeloom.operators.pool import blocks

    x = spark.createDataFrame([(k, k + 1, 0.5) for k in range(300)] + [(1000, 1001 + k, 0.5) for k in range(200)] + [(1001, 1002, 0.5), (0, 300, 0.5), (3, 3, 0.5), (5, 6, 1.0)], "i long, j long, x double")
    found, cut = blocks(x)
    sizes = Counter(r["block"] for r in found.collect())
    assert sorted(sizes.values()) == [1] * 198 + [3, 301] and {r["node"]: r["n_blocks"] for r in cut.collect()} == {1000: 199}


@pytest.mark.parametrize("long_edges", [False, True])
def test_segment_cuts_without_a_bound(spark, long_edges, monkeypatch):
    from routeloom.operators import segments

    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "_FAN", 1)
    rng = random.Random(5)
    ids = sorted(rng.sample(range(200), 30))  # gaps in the ids
    edges = {}
    for k in range(len(ids)):
        for _ in range(2):
            other = rng.randrange(len(ids)) if long_edges and rng.random() < 0.4 else min(len(ids) - 1, k + rng.choice([1, 1, 1, 2, 5]))
            if other != k:
                edges[ids[min(k, other)], ids[max(k, other)]] = rng.choice([0.25, 0.5, 0.1, 1.0])
    x = spark.createDataFrame([(j, i, w) if rng.random() < 0.3 else (i, j, w) for (i, j), w in edges.items()] + [(ids[0], ids[0], 1.0)], "i long, j long, x double")
    ids = sorted({v for e in edges for v in e})

    def delta(a, b):
        return round(sum(w for (i, j), w in edges.items() if (a <= i <= b) != (a <= j <= b)), 6)

    ones = Counter(v for e, w in edges.items() if w == 1.0 for v in e)
    ones[ids[0]] += 2  # the loop counts at both of its ends
    for bound in (None, 7):
        pairs = [(a, b) for p, a in enumerate(ids) for b in ids[p + 1 : None if bound is None else p + bound]]
        every = {(r["a"], r["b"]): round(r["delta"], 6) for r in segments.all_segment_cuts(x, bound, 1.5).collect()}
        assert every == {e: delta(*e) for e in pairs if delta(*e) <= 1.5 + 1e-9} and every
        best = {}
        for a, b in pairs:
            if ones[a] < 2 and ones[b] < 2 and delta(a, b) < best.get(a, (1.9999, 0))[0]:
                best[a] = delta(a, b), b
        found = {r["a"]: (round(r["delta"], 6), r["b"]) for r in segments.segment_cuts(x, bound).collect()}
        assert found == best and found
    assert {(r["a"], r["b"]) for r in segments.interval_deltas(x, 4).collect()} == {(a, b) for p, a in enumerate(ids) for b in ids[p + 1 : p + 4]}
    for rows in (segments.all_segment_cuts(x.limit(0), None, 1.0), segments.segment_cuts(x.limit(0)), segments.segment_cuts(x.limit(0), 5)):
        assert rows.count() == 0


def test_pricing_with_one_large_dual(spark):
    from routeloom.operators.pricing import near_enough_pairs, pricing_candidates_complete

    rng = random.Random(9)
    rows = [(rng.randrange(10_000), rng.randrange(10_000)) for _ in range(600)]
    est = [20_000.0 if k == 7 else rng.choice([-5.0, 0.0, 3.0, 60.0, 200.0]) for k in range(600)]
    nodes, duals = points(spark, rows), spark.createDataFrame(list(enumerate(est)), "id long, est double")
    wanted = {(a, b, length(rows[a], rows[b])) for a in range(600) for b in range(a + 1, 600) if length(rows[a], rows[b]) - est[a] - est[b] < 1e-4}
    found = pricing_candidates_complete(nodes, duals, "EUC_2D").collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert near_enough_pairs(nodes, duals, "EUC_2D").count() < 4 * len(wanted) < 600 * 599 / 20
    for norm in ("MAX_2D", "MAN_2D", "CEIL_2D", "ATT"):
        pairs = near_enough_pairs(nodes, duals, norm)
        assert pairs.select("i", "j").distinct().count() == pairs.count() and pairs.filter("i >= j").count() == 0
    assert pricing_candidates_complete(nodes.limit(0), duals, "EUC_2D").count() == 0
    with pytest.raises(ValueError):
        near_enough_pairs(nodes, duals, "GEO")
