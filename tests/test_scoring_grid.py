"""The scoring grid: clusters that bounds decide, cells of small corpora, popular targets."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from recollect.operators import joins, scoring

QUERY = "run_id string, session_id long, turn int, target_index long, vector array<double>"


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def heaps(seed, n=320, heaps_=16, wide=0.02, size=12):
    """Items in tight heaps."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(heaps_)]
    return [(i, unit([x + rng.gauss(0, wide) for x in middles[i % heaps_]])) for i in range(n)]


def queries(items, seed, n=90):
    rng = random.Random(seed)
    out = []
    for s in range(n):
        target = 5 if s % 3 == 0 else rng.randrange(len(items))
        near = items[(target + s % 4 // 3) % len(items)][1]  # some are after an item of another heap
        out.append(("r", s, 0, target, unit([x + rng.gauss(0, 0.05) for x in near])))
    return out


def order(q, items):
    score = {i: round(sum(a * b for a, b in zip(q, unit(v), strict=True)) * 1e9) for i, v in items}
    return sorted(score, key=lambda i: (-score[i], i))


def check(spark, items, asked, k):
    corpus, q = spark.createDataFrame(items, "corpus_idx long, vector array<double>"), spark.createDataFrame(asked, QUERY)
    scored = scoring.scores(q, corpus, k)
    want = {s: order(v, items) for _, s, _, _, v in asked}
    assert {r.session_id: r["rank"] for r in scoring.target_ranks(scored).collect()} == {s: want[s].index(t) for _, s, _, t, _ in asked}
    found = {}
    for r in scoring.top_k(scored, k).orderBy("position").collect():
        found.setdefault(r.session_id, []).append(r.corpus_idx)
    assert found == ({s: o[:k] for s, o in want.items()} if k else {})
    return scored


def test_most_cells_are_decided_by_bounds(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS", 20)
    items = heaps(1)
    asked = queries(items, 2)
    for k in (0, 3):
        check(spark, items, asked, k)
    corpus = spark.createDataFrame(items, "corpus_idx long, vector array<double>")
    placed, clusters = scoring.clustered(corpus, len(items))
    assert len(clusters.centres) == 16 and clusters.sizes.sum() == len(items)
    q = scoring.opened(scoring.with_own(spark.createDataFrame(asked, QUERY), placed), clusters, 3)
    cells = q.agg(F.sum(F.size("open"))).first()[0]
    assert 0 < cells < len(asked) * 16 / 2
    assert q.where("sure > 0").count() > 0  # some clusters lie above a query's own score, and are counted whole


def test_bounds_never_cut_off_an_item(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = scoring.fitted(x[:100], 20)
    at, far = scoring.nearest(x, centres)
    radii = np.array([far[at == c].max(initial=0) for c in range(20)])
    clusters = scoring.Clusters(centres, radii, np.bincount(at, minlength=20), x[:100])
    q = x[:60]
    own = np.rint((q * x[200:260]).sum(1) * scoring.SCALE).astype(np.int64)
    sure, open_, least = clusters.decided(q, own, 4)
    s = np.rint(q @ x.T * scoring.SCALE).astype(np.int64)
    for i in range(len(q)):
        closed = ~open_[i][at]
        assert (closed & (s[i] > own[i])).sum() == sure[i] and not (closed & (s[i] == own[i])).any()
        best = np.argsort(-s[i], kind="stable")[:4]
        assert open_[i][at[best]].all() and least[i] * scoring.SCALE <= s[i][best[-1]] + 1


def test_a_small_corpus_keeps_several_tasks_busy(spark):
    items = heaps(3, 100)
    scored = check(spark, items, queries(items, 4, 400), 5)
    assert sum(f.endswith(".parquet") for f in scored.inputFiles()) >= 1
    cells = scored.where("size(top) > 0").withColumn("file", F.col("_metadata.file_name")).groupBy("file").count().collect()
    assert len(cells) > 2


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS", 16)
    monkeypatch.setattr(scoring, "CENTRES", 2)
    monkeypatch.setattr(scoring, "SAMPLE", 30)
    items = heaps(6, 130)
    check(spark, items, queries(items, 7, 70), 6)
    check(spark, items[:1] + [(9, items[3][1])], [("r", 1, 0, 9, items[3][1])], 5)


def test_no_queries_and_no_items(spark):
    items, none = heaps(8, 12), spark.createDataFrame([], QUERY)
    corpus = spark.createDataFrame(items, "corpus_idx long, vector array<double>")
    assert scoring.target_ranks(scoring.scores(none, corpus, 3)).collect() == []
    assert scoring.target_ranks(scoring.scores(spark.createDataFrame(queries(items, 9, 3)[:0], QUERY), corpus.limit(0), 3)).collect() == []


def test_rows_meet_facts_whatever_the_keys_sizes(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST", 10)
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, 4, 5, None, 99])) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "i int, k long")
    facts = spark.createDataFrame([(k, k * 10, f"f{k}") for k in range(6)], "k long, x long, y string")
    got = sorted(tuple(r) for r in joins.met(df, facts, "k").collect())
    assert got == sorted((i, k, k * 10, f"f{k}") for i, k in rows if k in range(6))
