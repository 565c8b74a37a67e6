"""The pipeline's stages against brute-force versions, each on its own input."""

import math
import re
from collections import Counter, defaultdict

import xxhash

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
BUCKETS = 1 << 16


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(word, seed=42):
    return xxhash.xxh64_intdigest(word.encode(), seed)


def long_hash(value, seed):
    return signed(xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed))


def grams(text):
    words = SPACE.findall(text)
    return [word_hash(w) % BUCKETS for w in words] + [word_hash(b, word_hash(a)) % BUCKETS for a, b in zip(words, words[1:])]


def kept_by_quality(docs, labels):
    good = sorted((i for i in {r[0] for r in labels} if min(q for j, q in labels if j == i) == 1), key=lambda i: (long_hash(i, 42), i))
    part = {i: xxhash.xxh64_intdigest((1).to_bytes(4, "little"), long_hash(i, 42) & (1 << 64) - 1) % 2 for i in good}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams(t))
        if part.get(i) == 0:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = {b: math.log(((target[b] + 0.5) / (m + 0.5 * BUCKETS)) / ((raw[b] + 0.5) / (n + 0.5 * BUCKETS))) for b in raw}
    score = {i: sum(ratio[b] for b in grams(t)) / len(grams(t)) for i, t in docs.items() if grams(t)}
    held = sorted(score[i] for i in good if part[i] == 1 and i in score)

    def quantile(p):
        at = p * (len(held) - 1)
        low = int(at)
        return held[low] + (at - low) * (held[min(low + 1, len(held) - 1)] - held[low])

    limit = quantile(0.001) - 0.5 * (quantile(0.5) - quantile(0.001))
    out = set()
    for i, t in docs.items():
        words = SPACE.findall(t)
        count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + d for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for d in range(5)}
        if len(words) >= 10 and 100 * len(covered) <= 20 * len(words) and score[i] >= limit:
            out.add(i)
    return out


def test_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    stages = {name: fn for name, fn in corpus_pipeline.STAGES}

    def ran(name, df):
        out = stages[name](spark, df, SF)
        assert out.columns == df.columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    df, left = ran("quality rules", table)
    assert set(left) == kept_by_quality(docs, labels)

    def shingles(t):
        w = SPACE.findall(t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, groups = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                groups[y] = x
    df, left2 = ran("SimHash near-dedup", df)
    assert set(left2) == {root(i) for i in groups}

    seen, want = defaultdict(set), {}
    for i in sorted(left2):
        raw = left2[i].encode()
        gone = bytearray(len(raw))
        own = set()
        for k in range(len(raw) - 199):
            w = raw[k : k + 200]
            if w in seen or w in own:
                gone[k : k + 200] = b"\1" * 200
            own.add(w)
        for w in own:
            seen[w].add(i)
        want[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    df, left3 = ran("suffix-array dedup", df)
    assert left3 == want

    def edits(item, words):
        row = [0] * (len(words) + 1)
        for n, w in enumerate(item, 1):
            last, row = row, [n]
            for k, o in enumerate(words):
                row.append(min(last[k] + (w != o), last[k + 1] + 1, row[k] + 1))
        return min(row)

    clean = set()
    for i, t in left3.items():
        words = re.findall(r"[^\W_]+", t.lower())
        held = set(words)
        if not any(len(held & set(x)) >= 0.5 * len(set(x)) and edits(x, words) <= int(0.2 * len(x) + 1e-9) for x in items if x):
            clean.add(i)
    df, left4 = ran("benchmark decontamination", df)
    assert set(left4) == clean
    rows = stages["SentencePiece encoding"](spark, df, SF)
    assert {r["doc_id"] for r in rows.collect()} == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == clean
