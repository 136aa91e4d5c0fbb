"""Ranks by column functions: bounds from planes of bits, scores in generated code, odd vectors."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import scalars as S
from recollect.operators import scoring

QUERY = "run_id string, session_id long, turn int, target_index long, vector array<double>"
ITEM = "corpus_idx long, vector array<double>"


def vectors(seed, n, wide):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(n)]


def unit(v):
    length = max(math.sqrt(sum(x * x for x in v)), 1e-12)
    return [x / length for x in v]


def plain(asked, items):
    """Ranks as SQL has them; a pair with a null, or of two lengths, has no score."""

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        x = 0.0
        for p, q in zip(a, b, strict=True):
            x += p * q
        return math.copysign(math.floor(abs(x * 1e9) + 0.5), x)

    have = {i: unit(v) if v is not None and None not in v else None for i, v in items}
    out = {}
    for _, s, _, t, v in asked:
        own = score(v, have[t])
        mine = {i: score(v, w) for i, w in have.items() if i != t}
        out[s] = 0 if own is None else sum(c is not None and (c > own or (c == own and i < t)) for i, c in mine.items())
    return out


def ranks(spark, asked, items):
    return {r.session_id: r["rank"] for r in scoring.native_ranks(spark.createDataFrame(asked, QUERY), spark.createDataFrame(items, ITEM)).collect()}


@pytest.mark.parametrize("wide", [1, 64, 70])
def test_ranks_of_any_width(spark, wide):
    items = list(enumerate(vectors(wide, 120, wide)))
    items += [(120 + i, items[i][1]) for i in range(15)]  # ties
    asked = [("r", s, 0, (s * 37) % 135, unit(v)) for s, v in enumerate(vectors(-wide, 40, wide))]
    asked += [("r", 40 + i, 0, i, unit(items[i][1])) for i in range(10)]
    assert ranks(spark, asked, items) == plain(asked, items)


@pytest.mark.parametrize("mixed", [False, True])
def test_vectors_without_a_score_are_ahead_of_none(spark, mixed):
    items = list(enumerate(vectors(7, 60, 5)))
    items[3], items[8], items[9] = (3, None), (8, [1.0, None, 0.0, 2.0, 1.0]), (9, [0.0] * 5)
    if mixed:
        items[11], items[12] = (11, [1.0, 2.0]), (12, [2.0, 1.0, 3.0])
    asked = [("r", s, 0, s, unit(v)) for s, v in enumerate(vectors(8, 13, 5))]
    assert ranks(spark, asked, items) == plain(asked, items)


def test_components_that_are_not_finite_are_refused(spark):
    items = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0])]
    with pytest.raises(ValueError, match="not finite"):
        ranks(spark, [("r", 0, 0, 0, [1.0, 0.0])], items)


@pytest.mark.parametrize("wide,bits", [(3, 5), (64, 5), (70, 1), (130, 3)])
def test_planes_bound_scores(spark, wide, bits):
    rows = [unit(v) for v in vectors(wide, 30, wide)] + [[0.0] * wide, [1.0] + [0.0] * (wide - 1)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, vector array<double>").withColumn("code", scoring.coded(F.col("vector"), wide, bits))
    a, b = df.select("i", F.col("vector").alias("v"), F.col("code").alias("c")), df.select(F.col("i").alias("j"), F.col("vector").alias("w"), F.col("code").alias("d"))
    score, far = scoring.bounded(lambda n: F.col("c")[n], lambda n: F.col("d")[n], wide, bits)
    found = a.crossJoin(b).select(score.alias("score"), far.alias("far"), S.dot(F.col("v"), F.col("w")).alias("true")).collect()
    assert len(found) == len(rows) ** 2
    assert all(abs(r.score - r.true) <= r.far for r in found)
    assert bits < 5 or sorted(r.far for r in found)[len(found) // 2] < 0.2


def test_the_least_double_that_rounds_to_a_number(spark):
    at = [-1_000_000_000, -123_456_789, -3, -2, -1, 0, 1, 2, 3, 123_456_789, 1_000_000_000]
    for r in spark.createDataFrame([(n,) for n in at], "n long").select("n", scoring.rounded_from(F.col("n")).alias("x")).collect():
        below = spark.range(1).select(F.round(F.lit(r.x)).cast("long").alias("at"), F.round(F.lit(math.nextafter(r.x, -math.inf))).cast("long").alias("below")).first()
        assert (below["at"], below.below) == (r.n, r.n - 1)


def test_pairs_are_scored_in_code_that_the_jvm_compiles(spark, monkeypatch):
    sizes, real = [], scoring.written

    def written(df, what):
        if what == "native-ranks":
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator()
            while code.hasNext():
                stage = code.next()
                top = re.match(r"\*\((\d+)\) HashAggregate", stage._1())
                if top and f"*({top[1]}) SortMergeJoin" in stage._1():  # one stage from the join to the counts
                    sizes.append(stage._3().maxMethodCodeSize())
            spark.conf.unset("spark.sql.adaptive.enabled")
        return real(df, what)

    monkeypatch.setattr(scoring, "written", written)
    items = list(enumerate(vectors(1, 20, scoring.NATIVE_WIDE)))
    before = {k: spark.conf.get(k) for k in scoring.NATIVE_CONF}
    ranks(spark, [("r", 0, 0, 4, unit(items[4][1]))], items)
    assert len(sizes) == 1 and 0 < sizes[0] < 8000
    assert {k: spark.conf.get(k) for k in scoring.NATIVE_CONF} == before
