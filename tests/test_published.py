"""Publishing, the encoder cache, digests of files, and points that meet intervals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import analysis, intervals, memory
from recollect.sources import files, published


def ranks(spark, runs="ab", sessions=5, turns=3):
    return spark.createDataFrame([(m, s, t, 7 + s, (s * 3 + t * 5 + ord(m)) % 17) for m in runs for s in range(sessions) for t in range(turns)], "run_id string, session_id long, turn int, target_index long, rank long")


def records(spark, runs="ab"):
    return spark.createDataFrame([(m, "p", f"e-{m}") for m in runs], "run_id string, pairing_fp string, evaluation_fp string")


def test_a_failed_run_leaves_the_former_archive(spark, tmp_path):
    p = str(tmp_path / "runs")
    assert published.latest(spark, p) is None
    with pytest.raises(ValueError, match="nothing is published"):
        published.read(spark, p, "ranks")
    first = published.publish_runs(ranks(spark, "a"), records(spark), p)
    r = ranks(spark)
    bad = {
        "negative": r.withColumn("rank", F.col("rank") - 17), "twice": r.unionByName(r.limit(1)), "ragged": r.where("NOT (run_id = 'b' AND session_id = 1)"), "no target": r.withColumn("target_index", F.nullif("target_index", F.lit(8))),
        "two targets": r.withColumn("target_index", F.col("target_index") + F.col("turn")), "no record": r.withColumn("run_id", F.concat("run_id", F.lit("x"))),
    }
    for rows in bad.values():
        with pytest.raises(ValueError, match="no rank archives"):
            published.publish_runs(rows, records(spark), p)
    staged = published.stage_runs(r, records(spark), p)  # a run that dies here has published nothing
    assert published.latest(spark, p) == first and published.read(spark, p, "ranks").count() == 15
    assert published.commit(spark, staged).seq == 2
    assert sorted(map(tuple, published.read(spark, p, "ranks").select(r.columns).collect())) == sorted(map(tuple, r.collect()))
    m = {x.run_id: x for x in published.read(spark, p, "metrics").collect()}
    assert set(m) == {"a", "b"} and m["a"].evaluation_fp == "e-a" and m["b"].num_dialogues == 5 and m["b"].provenance_status == "emitted_by_evaluator"


def test_what_is_not_written_as_it_is_is_not_staged(spark, tmp_path, monkeypatch):
    proofs = iter([(3, "x"), (2, "y")])
    monkeypatch.setattr(published, "proof", lambda df: next(proofs))
    with pytest.raises(ValueError, match="2 rows for 3"):
        published.stage(str(tmp_path), {"t": spark.range(3)})
    assert published.latest(spark, str(tmp_path)) is None


def test_the_cache_encodes_what_it_lacks(spark, tmp_path):
    p, seen = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return [[float(len(x)), 1.0] for x in texts]

    texts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "text string")
    got = published.vectors(texts("a", "bb", "a", None), encoder, "length", 2, p)
    assert sorted(map(tuple, got.collect())) == [("a", [1.0, 1.0]), ("bb", [2.0, 1.0])] and seen.value == 2
    got = published.vectors(texts("bb", "ccc"), encoder, "length", 2, p)
    assert sorted(r.text for r in got.collect()) == ["bb", "ccc"] and seen.value == 3
    assert published.read(spark, p, "vectors").count() == 3
    before = published.latest(spark, p)
    with pytest.raises(ValueError, match="no vectors of 3"):
        published.vectors(texts("a"), encoder, "length", 3, p)
    assert published.latest(spark, p) == before
    assert published.vectors(texts("a"), lambda xs: [[0.0, 0.0] for _ in xs], "zero", 2, p).first().vector == [0.0, 0.0]
    assert published.read(spark, p, "vectors").count() == 1


def test_digests_of_files(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d / "sub").mkdir(parents=True)
        (tmp_path / d / "a.bin").write_bytes(b"\x00\xff" * 9)
        (tmp_path / d / "sub" / "b.bin").write_bytes(b"0")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.digests(spark, str(tmp_path / "x")).collect()}
    assert got == {"a.bin": (18, hashlib.sha256(b"\x00\xff" * 9).hexdigest()), "b.bin": (1, hashlib.sha256(b"0").hexdigest())}
    tree = lambda d: tuple(files.tree(files.digests(spark, str(tmp_path / d)), str(tmp_path / d)).first())
    assert tree("x") == tree("y")
    (tmp_path / "y" / "sub" / "b.bin").write_bytes(b"1")
    assert tree("x") != tree("y")
    with pytest.raises(ValueError, match="beyond 10 bytes"):
        files.digests(spark, str(tmp_path / "x"), most=10)


@pytest.mark.parametrize("least", [0, -3, 5])
def test_points_meet_intervals(spark, least):
    rng = random.Random(least)
    spans = [(k % 4, n, a, None if rng.random() < 0.2 else a + rng.choice([-1, 0, 0, 1, 2, 5, 40])) for n in range(150) for k in [rng.randrange(9)] for a in [rng.randrange(-5, 30)]]
    points = [(k, t) for k in range(5) for t in range(least, 23)]
    got = intervals.stabbed(spark.createDataFrame(points, "k long, t int"), spark.createDataFrame(spans, "k long, n int, lo int, hi int"), "k", "t", "lo", "hi").select("k", "t", "n").collect()
    want = [(k, t, n) for k, t in points for j, n, lo, hi in spans if j == k and lo <= t and (hi is None or t <= hi)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_long_session_makes_rows_in_proportion(spark):
    """20000 turns with an event each, of 40 concepts, of which ten states are asked for."""
    n = 20_000
    events = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("int").alias("turn"), F.lit(0).alias("idx"), F.concat(F.lit("C"), F.col("id") % 40).alias("attribute"), F.concat(F.lit("c"), F.col("id") % 40).alias("concept"), ((F.col("id") % 7) / 10.0).alias("confidence"))
    asked = [(1, t) for t in (0, 1, 39, 40, 777, 5_000, 12_345, 16_384, 19_998, n - 1)]
    states = spark.createDataFrame(asked, "session_id long, turn int")
    v = memory.versions(events)
    cells = v.select(F.size(intervals.cells_of_range(F.col("updated").cast("long"), F.least(F.coalesce("until", F.lit(n - 1)), F.lit(n - 1)).cast("long"), 15)).alias("c")).agg(F.count("*"), F.sum("c")).first()
    assert cells[0] == n and cells[1] < 12 * n
    got = {(r.turn, r.concept): (r.updated, r.created, round(r.confidence, 1)) for r in memory.memory(states, events).collect()}
    want = {}
    for _, t in asked:
        for c in range(40):
            told = [x for x in range(c, t + 1, 40)]
            if told:
                want[t, f"c{c}"] = (told[-1], told[0], round(max((x % 7) / 10.0 for x in told), 1))
    assert got == want


def test_grouping_sets_tell_nulls_from_totals(spark):
    items = spark.createDataFrame([(1, 0, 0, "a", True, "X"), (1, 0, 1, "b", None, None), (1, 1, 0, "c", False, "X"), (2, 0, 0, "d", True, None)], "session_id long, feedback_turn int, idx int, negative_attribute string, actionable boolean, sem_type string")
    patches = spark.createDataFrame([(1, 0, 1, "Y", False), (2, 0, 0, None, True)], "session_id long, feedback_turn int, idx int, new_type string, dropped boolean")
    got = analysis.patch_manifest(items, patches)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("kept_type", "X", 2), ("kept_type", "Y", 1), ("dropped_type", None, 1), ("kept_actionable", "true", 1), ("kept_actionable", "false", 1), ("kept_actionable", None, 1)], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
