"""The streaming memory: restarts, late turns, expiry, and a beginning from the batch memory."""

import time

from pyspark.sql import functions as F

from recollect.config import MemoryConfig
from recollect.operators import memory
from recollect.streaming.live_memory import as_initial, live_memory

TURNS = "session_id long, turn int, negatives array<struct<idx:int,concept:string,attribute:string,confidence:double>>"


def told(*names, confidence=0.5):
    return [(i, n.lower(), n, confidence) for i, n in enumerate(names)]


def run(spark, folder, rows, config=MemoryConfig(), **more):
    """One more wave of turns, and all that the stream has told so far."""
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(TURNS).parquet(f"{folder}/in")
    q = live_memory(stream, config, **more).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_waves_late_turns_and_a_cap(spark, tmp_path):
    config = MemoryConfig(max_concepts=2)
    run(spark, tmp_path, [(1, 1, told("Fur")), (1, 0, []), (2, 3, told("Fog"))], config)
    got = run(spark, tmp_path, [(1, 2, told("Sea", "FUR", confidence=0.9)), (1, 1, told("Owl")), (2, 3, []), (2, 4, []), (2, 4, told("Ice"))], config)
    want = [(1, 1, "fur", "Fur", 0.5, 1, 1, False), (1, 2, "fur", "FUR", 0.9, 1, 2, False), (1, 2, "sea", "Sea", 0.9, 2, 2, False), (2, 3, "fog", "Fog", 0.5, 3, 3, False), (2, 4, "fog", "Fog", 0.5, 3, 3, False)]
    refused = [(1, 1, "owl", "Owl", 0.5, None, None, True), (2, 3, None, None, None, None, None, True), (2, 4, "ice", "Ice", 0.5, None, None, True)]
    assert got == sorted(want + refused, key=str)
    got = run(spark, tmp_path, [(1, 5, told("Ash"))], config)  # one too many: of those updated last, the one that came in last stays
    assert [r[2:7] for r in got if r[:2] == (1, 5)] == [("ash", "Ash", 0.5, 5, 5), ("sea", "Sea", 0.9, 2, 2)]


def test_silent_sessions_are_forgotten(spark, tmp_path, request):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.unset(key))
    run(spark, tmp_path, [(1, 4, told("Fur"))], forget_after_ms=500)
    time.sleep(1)
    run(spark, tmp_path, [(2, 0, told("Fog"))], forget_after_ms=500)
    got = run(spark, tmp_path, [(1, 0, told("Sea"))], forget_after_ms=600_000)
    assert (1, 0, "sea", "Sea", 0.5, 0, 0, False) in got and not any(r[7] for r in got) and not any(r[:3] == (1, 0, "fur") for r in got)


def test_it_goes_on_from_the_batch_memory(spark, tmp_path):
    states = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in range(3)], "session_id long, turn int")
    events = spark.createDataFrame([(1, 1, 0, "Fur", "fur", 0.4), (1, 2, 0, "Fog", "fog", 0.8), (2, 0, 0, "Ice", "ice", 0.6)], "session_id long, turn int, idx int, attribute string, concept string, confidence double")
    begin = as_initial(states, memory.folded_memory(states, events, None, MemoryConfig()))
    assert {(r.session_id, r.turn, r.concept) for r in begin.collect()} == {(1, 2, "fur"), (1, 2, "fog"), (2, 2, "ice"), (3, 2, None)}
    got = run(spark, tmp_path, [(1, 3, told("FOG")), (2, 2, []), (3, 3, told("Ash")), (9, 0, told("Owl"))], initial=begin)
    want = [(1, 3, "fur", "Fur", 0.4, 1, 1, False), (1, 3, "fog", "FOG", 0.8, 2, 3, False), (2, 2, None, None, None, None, None, True), (3, 3, "ash", "Ash", 0.5, 3, 3, False), (9, 0, "owl", "Owl", 0.5, 0, 0, False)]
    assert got == sorted(want, key=str)


def test_the_stream_like_the_batch(spark, tmp_path):
    rows = [(s, t, told(*[f"C{(s * 7 + t * k) % 5}" for k in range((s + t) % 4)], confidence=0.3 + t / 10)) for s in range(12) for t in range(6)]
    for k in range(3):
        got = run(spark, tmp_path, [r for r in rows if r[1] // 2 == k], MemoryConfig(max_concepts=3))
    df = spark.createDataFrame(rows, TURNS)
    events = df.select("session_id", "turn", F.inline("negatives"))
    want = memory.folded_memory(df.select("session_id", "turn"), events, None, MemoryConfig(max_concepts=3)).select("session_id", "turn", "concept", "surface", "confidence", "created", "updated")
    assert [r[:7] for r in got] == sorted(map(tuple, want.collect()), key=str)
