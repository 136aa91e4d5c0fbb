import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import common
from recollect.llm import near_dup as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def documents(seed, n_groups=12, n=140):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    seeds = [[rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(n_groups)]
    rows = []
    for i in range(n):
        w = list(rng.choice(seeds[: 2 + i % n_groups]))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "École"), (n + 4, "école")]


@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(spark, block):
    rows = documents(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = N.near_duplicates(df, N.Params(block=block)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = [(None, t), (5, t), (5, t), (None, "other words are here now"), (4, t + " more")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, cls long, sig string")
    out = [(r.doc_id, r.component_id) for r in N.near_duplicates(df.select("doc_id", "text")).collect()]
    assert sorted(out, key=str) == [(4, 4), (5, 4), (5, 4), (None, 4), (None, None)]
    kept = N.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [4, None] and kept[0].sig == "x"


NAMES = ["cls", "sig", "_id", "_hash", "_spans", "_copies", "_copy", "_score", "n_shingles", "row", "h1", "no", "comp"]


def test_columns_and_rows_of_the_caller(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(3, t, 1), (3, t, 2), (3, t, 2), (9, t, 3), (4, None, 4), (4, "", 5), (4, None, 4), (None, " ", 6), (None, t + " x", 7), (None, "no id", 8), (None, "no id", 8), (None, "no id", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").select("doc_id", "text", *(F.col("n").alias(c) for c in NAMES), F.create_map(F.lit("k"), "n").alias("a map"))
    found = N.near_duplicates(df)
    assert found.columns == [c for c in df.columns if c not in ("text", "n_shingles")] + ["n_shingles", "component_id"]
    assert sorted(((r.doc_id, r.cls, r.component_id) for r in found.collect()), key=str) == sorted(((i, n, 3 if t in (x or "") else i) for i, x, n in rows), key=str)
    kept = N.keep_one(df)
    assert kept.dtypes == df.dtypes
    got = kept.collect()
    assert sorted((r.no for r in got)) == [1, 2, 4, 5, 6, 8, 9] and all(r[c] == r.no and r["a map"] == {"k": r.no} for r in got for c in NAMES)


def test_hot_keys_and_components(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    rows = documents(5, 4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str) == brute(rows)


def prefix_join(sets, num=75, den=100):
    """All pairs of linked sets: shingles in order of rarity, by those that a linked pair must share one of."""
    count = Counter(x for s in sets for x in s)
    by, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (count[x], x))
        for x in order[: len(s) - -(-len(s) * num // den) + 1]:
            for j in by[x]:
                if (j, i) not in pairs and len(sets[j] & s) * den >= len(sets[j] | s) * num:
                    pairs.add((j, i))
            by[x].append(i)
    return pairs


def test_no_link_is_missed(spark):
    """All documents of sf0.1 against an exact join by prefixes: the components are the same, so recall is 1."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = [frozenset(map(hash, shingles(t))) for _, t in rows]
    distinct = list({s for s in sets if s})
    place, root = {s: k for k, s in enumerate(distinct)}, list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = prefix_join(distinct)
    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s:
            k = find(place[s])
            least[k] = min(i, least.get(k, i))
    want = sorted((i, len(s), least[find(place[s])] if s else i) for (i, _), s in zip(rows, sets, strict=True))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == want and len(links) > 100


def test_the_threshold_is_guaranteed():
    p = N.Params()
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, p.size, np.uint16)
    for _ in range(200):
        b = a.copy()
        b[rng.choice(p.size, p.limit, replace=False)] ^= 1
        same = (a == b).reshape(p.chunks, p.symbols).sum(1)
        assert same.max() >= p.symbols - p.errors  # a chunk that agrees but for the allowed errors


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.keep_one(df).count() == 0
