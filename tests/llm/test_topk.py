import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import topk
from recollect.llm.queries import ORACLE_SQL


def brute(rows, k):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in kept:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in kept if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    v = df.select("id", topk.quantized(F.col("embedding")).alias("vector"))
    return [tuple(r) for r in topk.top_k(v.where("id % 50 = 0"), v, k).collect()]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(220)]  # many ties
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf"), 0.0]), (350, [0.25, 0.5]), (351, [])]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_fewer_candidates_and_none(spark):
    assert set(found(spark, [(0, [1.0]), (1, [2.0])])) == {(0, 1, 1, 131072)}
    assert found(spark, [(0, [1.0])]) == [] and found(spark, [(1, [1.0])]) == []


def test_rows_that_stand_twice(spark):
    assert sorted(found(spark, [(0, [1.0]), (0, [1.0]), (7, [2.0]), (7, [2.0])])) == [(0, 1, 7, 131072), (0, 2, 7, 131072)]


def test_ids_null_large_and_repeated_like_sql(spark):
    big = 50 * (2**53 // 50) + 50  # odd neighbours of it are no doubles
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [3.0, 0.5]), (8, [0.25, 2.0]), (None, [9.0, 9.0]), (big, [1.0, 1.0]), (big + 1, [4.0, 4.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(ORACLE_SQL["op2_topk"]).fetchall()
    assert len(want) == 10 and sorted(found(spark, rows)) == sorted(want)


def test_clashing_names_wide_scores_and_empty_tables(spark):
    rows = [(0, [2**31, 5]), (1, [2**31, -7]), (2, [3, 2**40]), (3, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, vector array<long>, cb int").withColumns({"qb": F.lit("x"), "score": F.lit(0), "a map": F.create_map(F.lit(1), F.lit(2))})
    got = sorted(tuple(r) for r in topk.top_k(df.where("id = 0"), df, 3).collect())
    assert got == [(0, 1, 1, 2**62 - 35), (0, 2, 2, 3 * 2**31 + 5 * 2**40), (0, 3, 3, 0)]
    none = df.limit(0)
    assert topk.top_k(none, none).count() == topk.top_k(df, none).count() == topk.top_k(none, df).count() == 0


@pytest.mark.parametrize("dense", [0.0, 0.5, 1.0])
def test_columns_and_scattered_postings_agree(monkeypatch, dense):
    """Terms of all densities, by whole columns alone, by both, and by scattered postings alone."""
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(3)
    share = rng.random(24)
    q, c = (np.where(rng.random((n, 24)) < share, rng.integers(-300, 300, (n, 24)), 0) for n in (70, 400))
    q_ids, c_ids = np.arange(70) * 5, np.arange(400)
    row, there, score = topk.block_top(q_ids, q, c_ids, c, 6)
    s = q @ c.T
    for i in range(70):
        want = sorted((-int(s[i, j]), j) for j in range(400) if c_ids[j] != q_ids[i])[:6]
        assert [(-int(x), int(j)) for j, x in zip(there[row == i], score[row == i], strict=True)] == want
