"""Spelling variants, collocations and sketch near-duplicates against brute force on small fixtures."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, word string, n long, rid int, phrase string, h int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "y", 3, 4) for i, t, lang in rows], SCHEMA)


def typed(rng, n):
    stems = ["organisation", "organization", "neighbour", "ÉlevéÀ", "programme", "behaviour", "colourful", "straße"]
    return " ".join(rng.choice(stems).upper() if rng.random() < 0.2 else rng.choice(stems) + rng.choice(["", "s", "ly", "-x", "1"]) for _ in range(n))


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form = {}
    out = {}
    for w, n in words.items():
        others = sorted((v for v in words if near(v, w)), key=lambda v: (-words[v], v))
        best = others[0] if others and words[others[0]] >= 10 * n else None
        form[w] = best
        out[w] = [best, n, len(others), words[best] if best else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return out


@pytest.mark.parametrize("group", [4000, 4])
def test_spelling_variants(spark, group, monkeypatch):
    from routeloom.llm import spelling

    rng = random.Random(3)
    rows = [(k, typed(rng, 60), "en") for k in range(60)]
    rows += [(None, typed(rng, 400), None), (7, None, "en"), (8, "", "en"), (9, "... 12 §", "en"), (3, rows[3][1], "en"), (61, "ab" * 90 + " " + "ab" * 90 + "\n" + "ba" * 3000 + "," + "ba" * 3000, "en")]
    grouped = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda v, least: grouped(v, least, group))
    found = {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in spelling.spelling_variants(frame(spark, rows)).collect()}
    assert found == variants(rows)
    assert any(x[0] for x in found.values()) and any(x[3] > 3 for x in found.values())
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None, None)])).count() == 0


def test_index_finds_all_pairs_of_either_half():
    from routeloom.llm.spelling import FMIndex

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    index = FMIndex(words)
    for right in (True, False):
        halves = [w[: len(w) // 2] if right else w[len(w) // 2 :] for w in words]
        _, same = np.unique([f"{len(w)} {h}" for w, h in zip(words, halves)], return_inverse=True)
        a, b = index.search(right, np.arange(len(words)), np.array([len(h) for h in halves]), index.lengths.copy(), same)
        wanted = {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if len(v) >= len(w) and near(v, w) and (v.startswith(halves[i]) if right else v.endswith(halves[i]))}
        assert set(zip(a.tolist(), b.tolist())) == wanted and len(wanted) > 50


def best_phrases(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[p : p + k]) for p in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        found = {p for p, n in f.items() if n >= least and len(p) > 1}
        scored = []
        for p in found:
            if any(len(q) > len(p) and f[q] >= f[p] and any(q[s : s + len(p)] == p for s in range(len(q))) for q in found):
                continue
            cut = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-cut[0], -f[p], " ".join(p), f[p[: cut[1]]], f[p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2].encode()))[:top], 1):
            out[lang, rank] = (p, -a, left, right, totals[lang], -s)
    return out


@pytest.mark.parametrize("dense, side, bits", [(2048, 512, 24), (6, 2, 15), (1, 1, 15)])
def test_collocations(spark, dense, side, bits, monkeypatch):
    from routeloom.llm import collocations as module

    rng = random.Random(4)
    words = ["New", "york", "city", "of", "the", "éclair", "a-b", "\x00z", "nul x"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(300)), rng.choice(["en", "fr", None, "und"])) for k in range(30)]
    rows += [(1, None, "en"), (2, "", "en"), (3, " .,\n ", "de"), (1, rows[1][1], rows[1][2]), (4, "Once In A Blue Moon. " * 40, "fr"), (None, "one two " * 900, "en")]
    monkeypatch.setattr(module, "_BLOCK", 1000)
    found = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in module.collocations(frame(spark, rows), 20, 5, 60, dense, side, bits).collect()}
    assert found == best_phrases(rows, 20, 5, 60)
    assert max(len(x[0].split(" ")) for x in found.values()) == 5
    assert module.collocations(frame(spark, [])).count() == 0


def components(rows):
    sets = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    found = []
    for k, (i, _, _) in enumerate(rows):
        c = min(least[root(k)], default=None) if sets[k] else i
        found.append((i, len(sets[k]), c, i == c))
    return Counter(found)


@pytest.mark.parametrize("tree", [200, 3])
def test_sketch_components(spark, tree, monkeypatch):
    from routeloom.llm import minhash

    rng = random.Random(6)
    block, rows = [f"block{k}" for k in range(60)], []
    for family in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 11, 40, 200]))]
        for copy in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append((len(rows) + 10, " ".join(words), "en"))
    rows += [(len(rows) + 10 + k, " ".join(block + [f"own{k}x{n}" for n in range(28)]), "en") for k in range(20)]  # a common block only
    rows += [(5, None, "en"), (6, "", "en"), (7, " \n", "en"), (8, "one", "en"), (9, "ONE", "en"), (None, "one", None), (10, rows[0][1].upper(), "en"), (None, "alone here", "en"), (None, None, None)]
    nearest = minhash.near_components
    monkeypatch.setattr(minhash, "near_components", lambda *a, **k: nearest(*a, max_tree=tree, **k))
    found = minhash.minhash_components(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["doc_id"] == r["component_id"]) for r in found) == components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert minhash.minhash_components(frame(spark, [])).count() == 0


def test_sketch_coordinates_agree_as_sets_do():
    from routeloom.llm.minhash import BINS, sketch

    rng = np.random.default_rng(1)
    for n in (1, 3, 10, 60, 400, 3000):
        apart = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(pool[:n]), np.unique(pool[n // 4 :])
            apart.append((sketch(a) == sketch(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert len(sketch(a)) == BINS and abs(np.mean(apart)) < 0.03 and np.std(apart) < 0.06


def test_counters_leave_out_what_a_task_meets_once():
    """Rows of the shingles' counters don't grow with the rare shingles of many near copies; prefixes keep one order without them."""
    import pyarrow as pa

    from routeloom.llm.near_dedup import _COUNTERS, _counter_rows, _prefix_rows

    shared, sets = np.arange(10, 30, dtype=np.uint64), []
    for k in range(40):
        sets.append(np.sort(np.append(shared, np.arange(100 + 5 * k, 105 + 5 * k, dtype=np.uint64))))
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rid", "shingles"])
    found = pa.Table.from_batches(list(_counter_rows(iter([batch])))).to_pydict()
    assert found == {"counter": shared.tolist(), "n": [40] * 20}
    counts = np.zeros(_COUNTERS, np.int64)
    counts[found["counter"]] = found["n"]
    rows = pa.Table.from_batches(list(_prefix_rows(counts, 0.8)(iter([batch])))).to_pydict()
    assert Counter(rows["rid"]) == dict.fromkeys(range(40), 6)  # 25 - 20 + 1: one more than the rare ones
    assert rows["shingle"].count(10) == 40


def test_phrase_counts_of_a_task_are_added_up():
    from routeloom.llm import collocations

    rng = np.random.default_rng(1)
    for least in (1, 500, 1 << 20):
        sums, want, out, made = collocations._Sums(least), {}, {}, 0
        for _ in range(40):
            words = [rng.integers(0, 6, 50).astype(np.uint64) for _ in range(3)]
            counts = rng.integers(1, 9, 50)
            for *key, n in zip(*words, counts):
                want[tuple(key)] = want.get(tuple(key), 0) + int(n)
            batches = [*sums.add(words, counts)]
            made += sum(b.num_rows for b in batches)
            for row in (r for b in batches for r in zip(*b.to_pydict().values())):
                out[row[:3]] = out.get(row[:3], 0) + row[3]
        rest = [*sums.rows()]
        assert not [*sums.rows()]
        for row in (r for b in rest for r in zip(*b.to_pydict().values())):
            out[row[:3]] = out.get(row[:3], 0) + row[3]
        assert out == want
        # Of 2,000 rows a task that may hold them all gives one for each phrase.
        assert least < 1 << 20 or made + sum(b.num_rows for b in rest) == len(want) <= 216


def test_bitmaps_of_frequent_phrases_let_little_else_pass(spark):
    from pyspark.sql import functions as F

    from routeloom.llm import collocations

    rows = spark.range(60_000).select(F.xxhash64("id").alias("h"))
    hashes = np.array([r["h"] for r in rows.collect()], np.int64).view(np.uint64)
    held, other = hashes[:4_000], hashes[4_000:]
    bits = collocations._bitmap(spark.createDataFrame([(int(h),) for h in held.view(np.int64)], "h long"), 17)
    assert len(bits) == 1 << 14 and collocations._passes(bits, held).all()
    assert collocations._passes(bits, other).mean() < 0.01  # by one bit alone: 0.03
