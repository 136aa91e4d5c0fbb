"""Retrieval operators against plain versions, on small worlds of our own making."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recollect.config import MemoryConfig
from recollect.functions import scalars as S
from recollect.operators import embed, joins, memory, metrics, provenance, scoring, stats
from recollect.sources import tables

CONCEPTS = ["striped", "wooden handle", "night sky", "two dogs", "neon sign"]
SIZE = 7


def unit(v):
    n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
    return [x / n for x in v]


class World:
    """A corpus of 45 items, six sessions of four to six turns, negatives and positives under several surface forms."""

    def __init__(self, seed):
        rng = random.Random(seed)
        vector = lambda: [rng.uniform(-1, 1) for _ in range(SIZE)]
        self.corpus = [(i, vector()) for i in range(45)]
        self.states = [(s, t, f"talk {s} {t}", 7 * s + 1, vector()) for s in range(6) for t in range(4 + s % 3)]
        surfaces = [f(c) for c in CONCEPTS for f in (str, str.title, str.upper)]
        self.vocabulary = [(x, vector()) for x in surfaces]
        self.beliefs = []
        for s, t, *_ in self.states:
            for polarity in ("negative", "positive"):
                for i in range(rng.randrange(3)):
                    self.beliefs.append((s, t, polarity, i, rng.choice(["", " "]) + rng.choice(surfaces) + "  ", rng.choice([0.4, 0.6, 0.9])))

    def frames(self, spark):
        return (
            spark.createDataFrame(self.corpus, "corpus_idx long, vector array<double>"),
            spark.createDataFrame(self.states, "session_id long, turn int, query_text string, target_index long, query_vector array<double>"),
            spark.createDataFrame(self.beliefs, "session_id long, feedback_turn int, polarity string, idx int, attribute string, confidence double"),
            spark.createDataFrame(self.vocabulary, "text string, vector array<double>"),
        )

    def query(self, method, session, turn, vector, config):
        """The corrected query of a state, straight from the rules."""
        vectors, kept = dict(self.vocabulary), {}
        told = sorted(b for b in self.beliefs if b[0] == session and b[2] == "negative" and (b[1] + 1 == turn if method == "current" else b[1] + 1 <= turn))
        for _, t, _, _, text, confidence in told if method != "h0" else []:
            key = text.strip().lower()
            kept[key] = (max(confidence, kept.get(key, (0,))[0]), t + 1, text.strip())
        q = unit(vector)
        if not kept:
            return q
        total = [0.0] * SIZE
        for confidence, at, surface in kept.values():
            w = confidence / (1 + config.recency_decay * (turn - at))
            total = [a + w * x for a, x in zip(total, unit(vectors[surface]), strict=True)]
        return unit([a - config.negative_weight * b for a, b in zip(q, unit(total), strict=True)])

    def order(self, q):
        score = {i: round(sum(a * b for a, b in zip(q, unit(v), strict=True)) * 1e9) for i, v in self.corpus}
        return sorted(score, key=lambda i: (-score[i], i))


@pytest.mark.parametrize("seed", [3, 4])
def test_ranks_and_lists_of_three_methods(spark, monkeypatch, seed):
    monkeypatch.setattr(scoring, "ITEMS", 11)
    monkeypatch.setattr(scoring, "QUERIES", 9)
    monkeypatch.setattr(memory, "BROADCAST_COMPONENTS", 0 if seed == 3 else 1000)
    monkeypatch.setattr(joins, "LEAST", 5)
    world, config = World(seed), MemoryConfig(negative_weight=0.6, recency_decay=0.3)
    corpus, states, beliefs, vocabulary = world.frames(spark)
    runs = [memory.queries(states, beliefs, vocabulary, config, m) for m in ("h0", "current", "persistent")]
    scored = scoring.scores(runs[0].unionByName(runs[1]).unionByName(runs[2]), corpus, 6)
    ranks = {(r.run_id, r.session_id, r.turn): r["rank"] for r in scoring.target_ranks(scored).collect()}
    lists = {}
    for r in scoring.top_k(scored, 6).orderBy("position").collect():
        lists.setdefault((r.run_id, r.session_id, r.turn), []).append(r.corpus_idx)
    want = {(m, s, t): world.order(world.query(m, s, t, v, config)) for m in ("h0", "current", "persistent") for s, t, _, _, v in world.states}
    target = {s: g for s, _, _, g, _ in world.states}
    assert ranks == {k: o.index(target[k[1]]) for k, o in want.items()}
    assert lists == {k: o[:6] for k, o in want.items()}
    assert any(ranks["h0", s, t] != ranks["persistent", s, t] for s, t, *_ in world.states)
    native = scoring.native_ranks(runs[2], corpus).collect()
    assert {(r.run_id, r.session_id, r.turn): r["rank"] for r in native} == {k: v for k, v in ranks.items() if k[0] == "persistent"}


def test_states_without_negatives_stay_as_they_are(spark):
    corpus, states, beliefs, vocabulary = World(5).frames(spark)
    host = {(r.session_id, r.turn): r.vector for r in memory.queries(states, None, None, MemoryConfig(), "h0").collect()}
    for b in (beliefs.withColumn("polarity", F.lit("positive")), beliefs.limit(0)):
        got = memory.queries(states, b, vocabulary, MemoryConfig(), "persistent").collect()
        assert {(r.session_id, r.turn): r.vector for r in got} == host


@pytest.mark.parametrize("most", [0, 1000])
def test_a_concept_without_a_vector_is_refused(spark, monkeypatch, most):
    monkeypatch.setattr(memory, "BROADCAST_COMPONENTS", most)
    corpus, states, beliefs, vocabulary = World(6).frames(spark)
    with pytest.raises(PySparkException, match="no vector for"):
        memory.queries(states, beliefs, vocabulary.where("text NOT LIKE 'W%'"), MemoryConfig(), "persistent").collect()
    with pytest.raises(PySparkException, match="no vector for talk"):
        tables.reencode_sessions(states, vocabulary).collect()
    with pytest.raises(KeyError):
        embed.lookup(spark.createDataFrame([("unheard of",)], "text string"), vocabulary)


def test_ties_go_to_the_lower_index(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS", 4)
    same = [0.0, 2.0, 0.0]
    corpus = spark.createDataFrame([(i, same if i % 3 else [5.0, 0.0, 1.0]) for i in range(11)], "corpus_idx long, vector array<double>")
    goals = [1, 5, 10, 6]
    q = spark.createDataFrame([("r", s, 0, t, [0.0, 1.0, 0.0]) for s, t in enumerate(goals)], "run_id string, session_id long, turn int, target_index long, vector array<double>")
    order = [i for i in range(11) if i % 3] + [0, 3, 6, 9]
    scored = scoring.scores(q, corpus, 5)
    for found in (scoring.target_ranks(scored), scoring.native_ranks(q, corpus)):
        assert {r.session_id: r["rank"] for r in found.collect()} == {s: order.index(t) for s, t in enumerate(goals)}
    assert [r.corpus_idx for r in scoring.top_k(scored, 5).where("session_id = 2").orderBy("position").collect()] == order[:5]


def rank_table(spark, rows):
    return spark.createDataFrame(rows, "run_id string, session_id long, turn int, rank long")


def quantile(values, q):
    x = sorted(values)
    at = q * (len(x) - 1)
    low = math.floor(at)
    return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def test_bootstrap_like_its_rule(spark):
    rng = random.Random(1)
    units = [(g, 5 * i, rng.uniform(-1, 1), float(rng.randint(1, 4))) for g, n in (("a", 21), ("b", 1), ("c", 8)) for i in range(n)]
    got = {r.g: r for r in stats.bootstrap(spark.createDataFrame(units, "g string, session_id long, s double, c double"), "g", 120, 9, 0.9, 10.0).collect()}
    for g in "abc":
        own = [u[2:] for u in units if u[0] == g]
        ratio = lambda xs: 10 * sum(s for s, _ in xs) / sum(c for _, c in xs)
        means = []
        for b in range(120):
            drawn = []
            for place in range(len(own)):
                h = hashlib.md5(f"9:{b}:{place // 4}".encode()).hexdigest()
                drawn.append(own[int(h[8 * (place % 4) :][:8], 16) % len(own)])
            means.append(ratio(drawn))
        assert abs(got[g].delta - ratio(own)) < 1e-9
        assert abs(got[g].ci_low - quantile(means, 0.05)) < 1e-9 and abs(got[g].ci_high - quantile(means, 0.95)) < 1e-9


@pytest.mark.parametrize("block", [65_536, 7])
def test_bootstrap_by_counts(spark, monkeypatch, block):
    """Beyond a number of units: as many draws in each replicate as units, and the distribution of single draws."""
    monkeypatch.setattr(stats, "BLOCK", block)
    rng = random.Random(4)
    units = [(g, i, float(rng.choice([-1, 0, 0, 1]) if g == "few" else rng.gauss(1, 2)), float(rng.choice([1, 1, 3]))) for g, n in (("few", 400), ("many", 150), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(units, "g string, session_id long, s double, c double")
    ratios = lambda df: df.select("g", "replicate", (F.col("s") / F.col("c")).alias("m")).collect()
    drawn = ratios(stats.counted_sums(df, "g", 1000, 3))
    assert len({(r.g, r.replicate) for r in drawn}) == 3000
    for g in ("few", "many"):
        s, c = (np.array([u[k] for u in units if u[0] == g]) for k in (2, 3))
        ratio, m = s.sum() / c.sum(), np.array([r.m for r in drawn if r.g == g])
        spread = np.sqrt(((s - ratio * c) ** 2).sum()) / c.sum()  # of a ratio of sums, to first order
        assert abs(m.mean() - ratio) < 0.15 * spread and 0.9 < m.std() / spread < 1.1
    again = ratios(stats.counted_sums(df.repartition(7), "g", 1000, 3))
    assert {(r.g, r.replicate): round(r.m, 9) for r in again} == {(r.g, r.replicate): round(r.m, 9) for r in drawn}
    monkeypatch.setattr(stats, "DRAWN", 10)
    few = {r.g: r for r in stats.bootstrap(df, "g", 1000, 3, 0.9, 1.0).collect()}
    monkeypatch.setattr(stats, "DRAWN", 1000)
    for r in stats.bootstrap(df, "g", 1000, 3, 0.9, 1.0).collect():
        assert abs(few[r.g].delta - r.delta) < 1e-9 and abs(few[r.g].ci_low - r.ci_low) < 0.15 * (r.ci_high - r.ci_low + 1e-9) and abs(few[r.g].ci_high - r.ci_high) < 0.15 * (r.ci_high - r.ci_low + 1e-9)


def test_replicates_have_as_many_draws_as_units(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 5)
    df = spark.createDataFrame([("g", i, float(i), 1.0) for i in range(60)], "g string, session_id long, s double, c double")
    sums = stats.counted_sums(df, "g", 250, 5).collect()
    assert {r.c for r in sums} == {60.0} and len({r.s for r in sums}) > 100 and len(sums) == 250


def test_holm_like_its_rule(spark):
    rng = random.Random(2)
    for n in (1, 6):
        p = [round(rng.choice([0.002, 0.02, 0.2]) * rng.randint(1, 5), 4) for _ in range(n)]
        order, worst, want = sorted(range(n), key=lambda k: (p[k], k)), 0.0, {}
        for place, k in enumerate(order):
            worst = max(worst, min(1.0, (n - place) * p[k]))
            want[k] = worst
        got = stats.holm(spark.createDataFrame(list(enumerate(p)), "turn int, p double")).collect()
        assert all(abs(r.p_holm - want[r.turn]) < 1e-12 for r in got) and len(got) == n


def test_inputs_that_statistics_refuse(spark):
    r = rank_table(spark, [(run, s, t, 3) for run in "xy" for s in range(4) for t in range(2)])
    for bad in (lambda: stats.recall_delta(r, "x", "y", samples=99), lambda: stats.recall_delta(r, "x", "y", k=0), lambda: stats.bootstrap(r.selectExpr("run_id g", "session_id", "1D s", "1D c"), "g", 100, 1, confidence=1.0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PySparkException, match="0 or more"):
        stats.paired(r.withColumn("rank", F.col("rank") - 4), "x", "y").collect()
    for p in (-0.1, 1.5, float("nan"), None):
        with pytest.raises(PySparkException, match="p-values"):
            stats.holm(spark.createDataFrame([(1, p)], "turn int, p double")).collect()


def test_mcnemar_is_exact(spark):
    cases = [(0, 0), (0, 4), (7, 2), (55, 31), (180, 240)]
    rows = [(t, lost + gained, min(lost, gained)) for t, (lost, gained) in enumerate(cases)]
    df = spark.createDataFrame(rows, "t int, n long, m long").withColumn("p", stats.binomial_tail(F.col("n"), F.col("m")))
    for r in df.collect():
        want = 1.0 if r.n == 0 else min(1.0, 2 * sum(math.comb(r.n, k) for k in range(r.m + 1)) / 2**r.n)
        assert abs(r.p - want) < 1e-9 * max(want, 1e-300) + 1e-15


def test_integrals(spark):
    r = rank_table(spark, [("one", 3, 0, 4), ("one", 8, 0, 30), ("two", 3, 0, 12), ("two", 3, 1, 40), ("two", 3, 2, 2)])
    got = {x.run_id: x.bri for x in metrics.summary(r).collect()}
    assert abs(got["one"] - (math.log(5) + math.log(31)) / 2) < 1e-12
    assert abs(got["two"] - ((math.log(13) + math.log(13)) / 2 + (math.log(13) + math.log(3)) / 2) / 2) < 1e-12


def test_scalars(spark):
    df = spark.createDataFrame([("\tBlue \x1f Door ", "Semi-dark: 9!"), (None, None)], "a string, b string")
    r = df.select(S.canonical(F.col("a")).alias("a"), S.lexical(F.col("b")).alias("b")).collect()
    assert tuple(r[0]) == ("blue door", "semi-dark 9 ") and tuple(r[1]) == (None, None)


def test_the_gate(spark):
    rows = [(run, s, t, s + t, 11 * s) for run in ("base", "twin", "bare", "short") for s in (2, 5, 6) for t in range(3) if not (run == "short" and s == 6)]
    r = spark.createDataFrame(rows, "run_id string, session_id long, turn int, rank long, target_index long")
    runs = spark.createDataFrame([("base", "f"), ("twin", "f"), ("bare", " "), ("short", "g")], "run_id string, pairing_fp string")
    assert provenance.gate(runs, r, "base", "twin") == "verified"
    assert provenance.verify_pairing(runs, r, "base", "short").first().reasons == ["rank_shape_mismatch", "pairing_fingerprint_mismatch", "session_ids_mismatch", "target_indices_mismatch"]
    moved = r.withColumn("target_index", F.when((F.col("run_id") == "twin") & (F.col("session_id") == 5), 56).otherwise(F.col("target_index")))
    with pytest.raises(ValueError, match="target_indices_mismatch"):
        stats.compare(moved, "base", "twin", samples=100, runs=runs)
    for known in (runs, None):
        with pytest.raises(ValueError, match="missing_pairing_fingerprint"):
            stats.compare(r, "base", "bare", samples=100, runs=known)
    got = stats.compare(r, "base", "bare", k=3, samples=100, runs=runs, allow_unverified=True).collect()
    assert [x.pairing for x in got] == ["legacy_unverified"] * 3 and {x.turn: x.delta for x in got} == {0: 0.0, 1: 0.0, 2: 0.0}


def test_fingerprints_tell_contents_apart(spark):
    corpus, states, _, _ = World(7).frames(spark)
    fp = lambda s, c: provenance.pairing_fingerprint(s, c).first()[0]
    own = fp(states, corpus)
    assert own == fp(states.repartition(7), corpus.orderBy(F.desc("corpus_idx")))
    near = corpus.withColumn("vector", F.when(F.col("corpus_idx") == 9, F.transform("vector", lambda x: x + 1e-12)).otherwise(F.col("vector")))
    assert len({own, fp(states, near), fp(states, corpus.unionByName(corpus.limit(1))), fp(states.where("turn > 0"), corpus), fp(states, corpus.limit(0))}) == 5


def test_rank_tables_must_be_matrices(spark):
    states = spark.createDataFrame([(s, t, s) for s in (1, 4) for t in range(2)], "session_id long, turn int, target_index long")
    ranks = rank_table(spark, [("m", s, t, 0) for s in (1, 4) for t in range(2)])
    assert scoring.rank_table(ranks, states).count() == 4
    for r, s in ((ranks.limit(3), states), (ranks.unionByName(ranks), states), (ranks, states.limit(3)), (ranks, states.withColumn("target_index", F.nullif("target_index", F.lit(4))))):
        with pytest.raises(ValueError):
            scoring.rank_table(r, s)


def test_files(spark, tmp_path):
    spark.createDataFrame([(8, 2, 30), (8, 2, 41)], "session_id long, turn int, final_rank long").write.json(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.read_traces(spark, str(tmp_path / "t"))
    assert tables.write_csv(spark.range(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    ranks = rank_table(spark, [(m, s, 0, 9) for m in "pq" for s in range(6)])
    tables.write_ranks(ranks, str(tmp_path / "r"))
    assert sorted(map(str, tables.read_ranks(spark, str(tmp_path / "r")).select(ranks.columns).collect())) == sorted(map(str, ranks.collect()))
    for bad in (ranks.unionByName(ranks.limit(1)), ranks.withColumn("rank", F.lit(-2).cast("long")), ranks.where("NOT (run_id = 'q' AND session_id = 3)")):
        with pytest.raises(ValueError):
            tables.write_ranks(bad, str(tmp_path / "bad"))
    item = "struct<dialog_id:bigint,turn:int,negative_index:int,negative_attribute:string,actionable_negative:boolean>"
    spark.createDataFrame([([(1, 0, None, "fur", True), (1, 0, 0, "fog", False)],)], f"items array<{item}>").write.json(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="twice"):
        tables.read_structured(spark, str(tmp_path / "s"))


def test_missing_texts_get_a_default(spark):
    s = spark.createDataFrame([(4, 9, [[0.5], [0.1], [3.0]], ["a", None]), (6, 2, [[2.0]], None)], "session_id long, target_index long, query_vectors array<array<double>>, query_texts array<string>")
    assert sorted((r.session_id, r.turn, r.query_text) for r in tables.turns_of_sessions(s).collect()) == [(4, 0, "a"), (4, 1, tables.DEFAULT_TEXT), (4, 2, tables.DEFAULT_TEXT), (6, 0, tables.DEFAULT_TEXT)]


def test_a_run_of_many_sessions_is_verified_in_parts(spark, monkeypatch):
    from recollect.operators import joins

    monkeypatch.setattr(joins, "LEAST", 16)
    sessions = spark.range(500).select(F.col("id").alias("session_id"), (F.col("id") * 3).alias("target_index"))
    rows = sessions.crossJoin(spark.createDataFrame([("hot", 0), ("hot", 1), ("same", 0), ("same", 1), ("moved", 0), ("moved", 1), ("part", 0), ("part", 1)], "run_id string, turn int"))
    rows = rows.withColumn("target_index", F.when((F.col("run_id") == "moved") & (F.col("session_id") == 77), -1).otherwise(F.col("target_index"))).where("run_id <> 'part' OR session_id < 499")
    runs = spark.createDataFrame([(x, "f") for x in ("hot", "same", "moved", "part")], "run_id string, pairing_fp string")
    pairs = spark.createDataFrame([("hot", x) for x in ("same", "moved", "part", "absent")] + [("same", "hot")], "baseline string, candidate string")
    got = {(r.baseline, r.candidate): r.reasons for r in provenance.verify_pairings(runs, rows, pairs).collect()}
    assert got == {
        ("hot", "same"): [], ("same", "hot"): [], ("hot", "moved"): ["target_indices_mismatch"], ("hot", "part"): ["rank_shape_mismatch", "session_ids_mismatch", "target_indices_mismatch"],
        ("hot", "absent"): ["rank_shape_mismatch", "missing_pairing_fingerprint", "session_ids_mismatch", "target_indices_mismatch"],
    }
