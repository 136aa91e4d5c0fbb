import random

import numpy as np
import pytest

from recollect.llm import ngram_join as J
from recollect.llm.near_dup import shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


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
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def documents(seed, n=170):
    """Near copies at all distances, copies, a passage that many documents hold, chains, odd texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    seeds = [[rng.choice(words) for _ in range(rng.choice([3, 4, 6, 40, 120, 200]))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(seeds[: 2 + i % 12]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = passage + w[: rng.choice([1, 3, 8, 20])]
        text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    chain = [rng.choice(words) for _ in range(100)]
    for k in range(12):  # each is linked with its neighbours alone
        rows.append((n + k, " ".join(chain[6 * k :] + [f"n{k}x{j}" for j in range(6 * k)])))
    return rows + [(n + 20, None), (n + 21, ""), (n + 22, " \t\n"), (n + 23, "École"), (n + 24, "école"), (n + 25, "one"), (n + 26, "ONE")]


def found(spark, rows, p=J.Params()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similar(df, p).collect()), key=str)


@pytest.mark.parametrize("params", [{}, {"block": 3, "chunk": 200, "least_buckets": 3}, {"crowd": 3, "seen": 2, "chunk": 3000}])
def test_against_brute_force(spark, monkeypatch, params):
    monkeypatch.setattr(J, "CROWDS", 1000)
    rows = documents(len(params))
    want = brute(rows)
    assert len({r[2] for r in want}) < len(want) - 20
    assert found(spark, rows, J.Params(**params)) == want


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (None, text), (5, text + " x"), (5, "other words of five"), (2, "other words of five"), (None, "lone words are here now"), (5, text + " x")] * 3
    assert found(spark, rows) == brute(rows)


def test_very_long_text(spark):
    words = [f"w{k * 7919 % 100003}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-300], *("z" * k for k in range(1, 301))])), (3, " ".join(words[:40_000]))]
    assert found(spark, rows) == brute(rows)


def test_names_and_empty_table(spark):
    df = spark.sql("SELECT 4L doc_id, 'a b c d e' body, 1 text, 2 `no`, 3 hub, 'q' cls, 9 n_shingles, 7 `a.b`, 8 chunk, 6 idx")
    out = J.similar(df, text="body")
    assert out.columns == ["doc_id", "text", "no", "hub", "cls", "a.b", "chunk", "idx", "n_shingles", "component_id"]
    assert [tuple(r) for r in out.collect()] == [(4, 1, 2, 3, "q", 7, 8, 6, 2, 4)]
    assert J.similar(df.limit(0), text="body").collect() == []


def test_the_prefix_holds_a_shared_shingle():
    """Sizes of prefixes and of the intersection that a link needs, against all sizes."""
    p = J.Params()
    for n in range(1, 120):
        least = -(-85 * n // 100)
        assert p.prefix(np.array([n]))[0] == n - least + 1
        for m in range(1, 120):
            want = next((c for c in range(min(n, m) + 1) if 100 * c >= 85 * (n + m - c)), None)
            assert want is None or p.needed(np.array([n + m]))[0] == want


def test_filters_keep_all_links():
    """In one cell, every linked pair of two components is a candidate, and far pairs aren't."""
    import pyarrow as pa

    p = J.Params()
    texts = [t for _, t in documents(9) if t and t.split()]
    h, starts = shingle_sets(texts, p)
    sets = [h[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    many = dict(zip(*np.unique(h, return_counts=True), strict=True))
    rows = []
    for k, s in enumerate(sets):
        shared = sorted((x for x in s.tolist() if many[x] > 1), key=lambda x: (many[x], x))
        single = len(s) - len(shared)
        hist = np.bincount([x >> 59 for x in shared], minlength=p.parts).astype(np.uint32)
        rows.append({"n": len(s), "single": single, "prefix": [x - 2**63 for x in shared[: max(0, int(p.prefix(np.array([len(s)]))[0]) - single)]], "hist": hist.tobytes(), "comp": k, "hubs": [1]})
    schema = pa.schema([("n", pa.int64()), ("single", pa.int64()), ("prefix", pa.list_(pa.int64())), ("hist", pa.binary()), ("comp", pa.int64()), ("hubs", pa.list_(pa.int64()))])
    t = pa.Table.from_pylist(rows, schema=schema)
    near = J.candidates(t, t, 1, p)
    linked = np.array([[a != b and 100 * len(x & y) >= 85 * len(x | y) for b, y in enumerate(map(set, sets))] for a, x in enumerate(map(set, sets))])
    assert linked.any() and not (linked & ~near).any() and near.sum() < 3 * linked.sum()
    assert not J.candidates(t, t, 2, p).any()
