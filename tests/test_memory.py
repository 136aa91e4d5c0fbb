import math
import random

import pytest

from recollect.config import MemoryConfig, RetrievalConfig, load_config
from recollect.operators import memory as M


def fold(events, turns, cap):
    """The memory after each turn, straight from its rules."""
    out, kept = [], []
    for t in turns:
        now = sorted(e for e in events if e[0] == t)
        for _, _, concept, confidence in now:
            old = next((k for k in kept if k["c"] == concept), None)
            if old:
                old.update(conf=max(old["conf"], confidence), updated=t)
            else:
                kept.append({"c": concept, "conf": confidence, "created": t, "updated": t})
        while now and len(kept) > cap:
            kept.remove(min(kept, key=lambda k: k["updated"]))  # the first of the least is the first that came in
        out += [(t, k["c"], k["conf"], k["created"], k["updated"]) for k in kept]
    return out


@pytest.mark.parametrize("cap", [2, 3, 50])
def test_capped_memory_like_a_fold(spark, cap):
    rng = random.Random(cap)
    events, states = [], []
    for s in range(40):
        states += [(s, t) for t in range(6)]
        for t in range(1, 6):
            events += [(s, t, i, f"c{rng.randrange(6)}", f"c{rng.randrange(6)}", rng.choice([0.5, 0.7, 0.9])) for i in range(rng.randrange(4))]
    events = [(s, t, i, c, c, conf) for s, t, i, c, _, conf in events]
    e = spark.createDataFrame(events, "session_id long, turn int, idx int, attribute string, concept string, confidence double")
    got = M.capped_memory(spark.createDataFrame(states, "session_id long, turn int"), e, MemoryConfig(max_concepts=cap)).collect()
    want = {(s, *r) for s in range(40) for r in fold([(t, i, c, conf) for s2, t, i, c, _, conf in events if s2 == s], range(6), cap)}
    assert {(r.session_id, r.turn, r.concept, r.confidence, r.created, r.updated) for r in got} == want


def plain_fold(events, turns, config):
    """The memory after each turn, one belief after another; (turn, key, name, surface, polarity, confidence, created, updated, overrides) and the turns' counts."""
    kept, rows, counts = [], [], {}
    for t in turns:
        added = changed = overridden = evicted = 0
        now = [e for p in ("positive", "negative") for e in sorted((e for e in events if e[0] == t and e[6] == p), key=lambda e: e[1])]
        for _, _, concept, surface, confidence, vector, polarity in now:
            old = next((k for k in kept if k["key"] == concept), None)
            if old is None and config.semantic_merge and kept:
                like = [sum(a * b for a, b in zip(k["vector"], vector, strict=True)) for k in kept]
                if max(like) >= config.semantic_merge_threshold:
                    old = kept[like.index(max(like))]
            if old is None:
                kept.append({"key": concept, "name": surface, "surface": surface, "polarity": polarity, "conf": confidence, "created": t, "updated": t, "n": 0, "vector": vector})
                added += 1
            elif old["polarity"] == polarity:
                old.update(surface=surface, conf=max(old["conf"], confidence), updated=t, vector=vector)
                changed += 1
            else:
                old.update(surface=surface, conf=min(1.0, max(old["conf"], confidence) + config.override_boost), updated=t, vector=vector, polarity=polarity, n=old["n"] + 1)
                overridden += 1
        while now and len(kept) > config.max_concepts:
            kept.remove(min(kept, key=lambda k: k["updated"]))  # the first of the least is the first that came in
            evicted += 1
        rows += [(t, k["key"], k["name"], k["surface"], k["polarity"], round(k["conf"], 9), k["created"], k["updated"], k["n"]) for k in kept]
        if kept:
            counts[t] = (added, changed, overridden, evicted)
    return rows, counts


@pytest.mark.parametrize("config", [MemoryConfig(), MemoryConfig(max_concepts=2), MemoryConfig(semantic_merge=True, semantic_merge_threshold=0.8, max_concepts=4)])
def test_folded_memory_like_a_plain_fold(spark, config):
    rng = random.Random(11)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    vectors = {f"{f}{k}": unit([rng.uniform(-1, 1) for _ in range(3)]) for k in range(5) for f in ("c", "C")}
    states = [(s, t) for s in range(25) for t in range(6)]
    events = [(s, t, i, x.lower(), x, rng.choice([0.5, 0.75, 0.95]), p) for s, t in states for p in ("positive", "negative") for i in range(rng.randrange(3)) for x in [rng.choice(list(vectors))]]
    e = spark.createDataFrame(events, "session_id long, turn int, idx int, concept string, attribute string, confidence double, polarity string").repartition(5)
    v = spark.createDataFrame(list(vectors.items()), "text string, vector array<double>")
    s = spark.createDataFrame(states, "session_id long, turn int")
    got = M.folded_memory(s, e, v, config)
    plain = {i: plain_fold([(t, n, c, x, f, vectors[x], p) for j, t, n, c, x, f, p in events if j == i], range(6), config) for i in range(25)}
    rows = {(r.session_id, r.turn, r.concept, r.name, r.surface, r.polarity, round(r.confidence, 9), r.created, r.updated, r.overrides) for r in got.collect()}
    assert rows == {(i, *r) for i, (rs, _) in plain.items() for r in rs}
    stats = {(r.session_id, r.turn): tuple(r)[2:] for r in M.turn_stats(got).collect()}
    assert stats == {(i, t): c for i, (_, cs) in plain.items() for t, c in cs.items()}
    log = M.override_log(got).groupBy("session_id", "turn").count().collect()
    assert {(r.session_id, r.turn): r["count"] for r in log} == {k: c[2] for k, c in stats.items() if c[2]}
    sizes = {(r.session_id, r.turn): tuple(r)[2:] for r in M.diagnostics(s, got).collect()}
    for i, t in states:
        own = [r for r in plain[i][0] if r[0] == t]
        assert sizes[i, t] == (len(own), sum(r[4] == "positive" for r in own), sum(r[4] == "negative" for r in own), sum(r[8] for r in own))


def test_config():
    assert RetrievalConfig().memory.negative_weight == 0.275
    assert load_config({"memory": {"max_concepts": 3, "positive_weight": 0.55}, "top_k": 10}).memory.max_concepts == 3
    for bad in ({"memory": {"negative_weight": -1}}, {"top_k": 0}, {"memory": {"max_concepts": 0}}, {"unknown": 1}):
        with pytest.raises(ValueError):
            load_config(bad)
