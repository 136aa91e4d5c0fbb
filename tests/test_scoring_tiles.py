"""The product in single precision, tile by tile: what it leaves undecided is scored in doubles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scoring_grid import QUERY, heaps, order, queries

from recollect.operators import scoring
from recollect.plans import retrieval
from recollect.sources import fixtures

SF = "/root/testdata/sf0.001"


def plain(q, x, idx, own, target, k):
    s = np.array([[round(sum(a * b for a, b in zip(v, w, strict=True)) * scoring.SCALE) for w in x] for v in q])
    greater = [sum(o != t and c > m for o, c in zip(idx, r, strict=True)) for r, m, t in zip(s, own, target, strict=True)]
    before = [sum(c == m and o < t for o, c in zip(idx, r, strict=True)) for r, m, t in zip(s, own, target, strict=True)]
    return greater, before, [sorted((-c, o) for c, o in zip(r, idx, strict=True))[:k] for r in s.tolist()]


@pytest.mark.parametrize(("k", "told"), [(0, False), (4, False), (4, True), (50, False)])
def test_scores_too_near_for_single_precision(monkeypatch, k, told):
    monkeypatch.setattr(scoring, "TILE_QUERIES", 5)
    monkeypatch.setattr(scoring, "TILE_ITEMS", 16)
    monkeypatch.setattr(scoring, "PAIRS", 7)
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    middles = unit(rng.normal(size=(3, 8)))
    x = unit(middles[rng.integers(0, 3, 43)] + rng.choice([0, 1e-9, 3e-9, 1e-7], size=(43, 1)) * rng.normal(size=(43, 8)))
    x[7], x[30] = x[21], x[21]
    idx = rng.permutation(100)[:43]
    target = rng.integers(0, 43, 18)
    q = unit(x[target] + 0.01 * rng.normal(size=(18, 8)))
    own = [round(sum(a * b for a, b in zip(v, x[t], strict=True)) * scoring.SCALE) for v, t in zip(q, target, strict=True)]
    greater, before, top = plain(q, x, idx.tolist(), own, idx[target].tolist(), k)
    least = [-t[-1][0] / scoring.SCALE if told else -np.inf if k else np.inf for t in top]
    asked = pa.table({"runs": [["r"]] * 18, "session_id": range(18), "turn": pa.array([0] * 18, pa.int32()), "target_index": idx[target], "own": own, "least": least, "vector": q.tolist()})
    got = scoring.block_scores(asked, pa.table({"corpus_idx": idx, "vector": x.tolist()}), k).to_pydict()
    assert got["greater"] == greater and got["before"] == before
    assert [[(r["minus"], r["corpus_idx"]) for r in t] for t in got["top"]] == top
    assert len({*map(round, own)}) > 5 and any(before) and any(greater)


@pytest.mark.parametrize("items_", [20, 1000])
def test_a_query_of_several_runs_is_scored_once(spark, monkeypatch, items_):
    monkeypatch.setattr(scoring, "ITEMS", items_)
    items = heaps(1)
    asked = queries(items, 2, 30)
    runs = [(r, *q[1:]) for q in asked for r in ("a", "b")] + [("c", *q[1:4], asked[0][4]) for q in asked]
    corpus, sizes = spark.createDataFrame(items, "corpus_idx long, vector array<double>"), []
    at_rest = scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, what: (sizes.append(df.count()) if what == "open-queries" else None, at_rest(df, what))[1])
    scored = scoring.scores(spark.createDataFrame(runs, QUERY), corpus, 3)
    assert sizes == [59]  # of 90; in c, one has the vector that a and b have
    assert scored.count() == scored.select(*scoring.KEYS).distinct().count() == 90
    want = {(r, s): order(v, items) for r, s, _, _, v in runs}
    assert {(r.run_id, r.session_id): r["rank"] for r in scoring.target_ranks(scored).collect()} == {(r, s): want[r, s].index(t) for r, s, _, t, _ in runs}
    lists = scoring.top_k(scored, 3).groupBy("run_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("position", "corpus_idx"))).alias("x")).collect()
    assert {(r.run_id, r.session_id): [e.corpus_idx for e in r.x] for r in lists} == {k: o[:3] for k, o in want.items()}


@pytest.mark.parametrize("width", [8, 24, 64, 136, 512])
def test_places_of_any_width(width):
    rng = np.random.default_rng(width)
    for share in (0, 0.001, 0.2, 1):
        mask = rng.random((37, width)) < share
        found = list(zip(*scoring.places(mask), strict=True))
        assert sorted(found) == list(zip(*np.nonzero(mask), strict=True))


def test_the_bound_of_the_best_rises_from_tile_to_tile(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:2400] = x[:400]  # ties
    q, own = x[:20], np.full(20, 200_000_000)
    rows = {"runs": [["r"]] * 20, "session_id": range(20), "turn": pa.array([0] * 20, pa.int32()), "target_index": [0] * 20, "own": own, "least": [-np.inf] * 10 + [0.3] * 10, "vector": q.tolist()}
    found, rescored = [], []
    monkeypatch.setattr(scoring, "TILE_ITEMS", 64)
    exact = scoring.exact
    monkeypatch.setattr(scoring, "exact", lambda q_, x_, row, column: (rescored.append(len(row)), exact(q_, x_, row, column))[1])
    kept, at_once = scoring.likely, []
    monkeypatch.setattr(scoring, "likely", lambda found_, *a: (at_once.append(sum(len(f[0]) for f in found_)), kept(found_, *a))[1])
    for tighten in (1 << 30, 0, 2):
        monkeypatch.setattr(scoring, "TIGHTEN", tighten)
        at_once.clear()
        found.append((scoring.block_scores(pa.table(rows), pa.table({"corpus_idx": np.arange(4000), "vector": x.tolist()}), 5), max(at_once)))
    _, before, top = plain(q, x, list(range(4000)), own, [0] * 20, 5)
    for table, _ in found:
        assert [[(r["minus"], r["corpus_idx"]) for r in t] for t in table["top"].to_pylist()] == top
    assert found[2][1] < found[0][1] / 5  # all that lay above the first bound would be kept and sorted at the end


def test_ranks_alone_need_no_lists(spark, monkeypatch):
    asked, real = [], scoring.scores
    monkeypatch.setattr(scoring, "scores", lambda q, corpus, k: (asked.append(k), real(q, corpus, k))[1])
    fixtures.forget()
    alone = sorted(map(tuple, retrieval.ranks(spark, SF).collect()))
    assert asked == [0]
    fixtures.forget()
    retrieval.tops(spark, SF)
    assert sorted(map(tuple, retrieval.ranks(spark, SF).collect())) == alone
    assert asked == [0, retrieval.TOP_K]
    fixtures.forget()


def test_one_run_is_scored_alone(spark, monkeypatch):
    asked, real = [], scoring.scores
    monkeypatch.setattr(scoring, "scores", lambda q, corpus, k: (asked.append(sorted(r.run_id for r in q.select("run_id").distinct().collect())), real(q, corpus, k))[1])
    fixtures.forget()
    alone = {m: sorted(map(tuple, retrieval.ranks_of(spark, SF, m).collect())) for m in ("h0", "persistent")}
    assert asked == [["h0"], ["persistent"]]
    retrieval.ranks(spark, SF)
    for m, rows in alone.items():
        assert rows and rows == sorted(map(tuple, retrieval.ranks_of(spark, SF, m).collect()))
    assert len(asked) == 3
    fixtures.forget()


def test_native_cells_hold_several_packs(spark, monkeypatch):
    for name, size in (("NATIVE_QUERIES", 4), ("NATIVE_ITEMS", 8), ("NATIVE_CELL_QUERIES", 16), ("NATIVE_CELL_ITEMS", 40)):
        monkeypatch.setattr(scoring, name, size)
    items = heaps(4, 100)
    asked = queries(items, 5, 45)
    found = scoring.native_ranks(spark.createDataFrame(asked, QUERY), spark.createDataFrame(items, "corpus_idx long, vector array<double>")).collect()
    assert sorted((r.session_id, r["rank"]) for r in found) == [(s, order(v, items).index(t)) for _, s, _, t, v in asked]
