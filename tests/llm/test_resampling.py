import hashlib
import math
import random
import re
import zlib

import numpy as np

from recollect.llm import resampling as R

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORD, low)
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10_000


def brute(docs, target, percent=5, least=20):
    count = lambda texts: np.bincount([bucket(x) for t in texts for x in features(t)[1]], minlength=10_000) if texts else np.zeros(10_000, int)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000.0 * math.log((float(b) + 1) * (float(s.sum()) + 10_000) / ((float(a) + 1) * (float(t.sum()) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(y)] for y in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(fit) // 100
    return [(*r, k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r, None) for r in rows if r[1] < least]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "BETA", "naïve", "語語", "x9", "it's", "a_b", "ß" * 40, "q" * 70, "r" * 9000, " ", "e-mail"] + [f"w{k}" for k in range(300)]
    return [rng.choice([" ", "\n", "--"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 200]))) for _ in range(n)]


def test_against_brute_force(spark):
    docs = [*enumerate(texts(1, 240)), (900, None), (901, ""), (None, "w1 " * 30), (None, "w2 " * 30)] + [(7, "w5 w6 w7 " * 12)] * 30
    target = texts(2, 12) + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = R.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), R.Params(percent=30)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, brute(docs, target, 30)))


def test_empty_tables_and_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, none).collect() == []
    docs = [(k, "one two three " * 9) for k in range(25)]
    df = spark.createDataFrame([(*r, "z", 5, 6) for r in docs], "doc_id long, text string, data string, rank int, bucket int")
    got = R.resampled(df, none)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute(docs, [])))


def test_long_words_and_shifts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 127, 128, 129, 1000, 70_001, 1 << 20):
        a, b = rng.bytes(5), bytes(size)
        joined = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
        assert int(joined[0]) == zlib.crc32(a + b)


def test_planes_are_exact():
    rng = np.random.default_rng(4)
    gain = rng.integers(-20_000, 20_000, R.BUCKETS)
    doc = np.sort(rng.integers(0, 40, 30_000))
    at = np.where(rng.random(30_000) < 0.3, 17, rng.integers(0, R.BUCKETS, 30_000))  # one bucket of many
    want = np.zeros(41, np.int64)
    np.add.at(want, doc, gain[at])
    assert (R.plane_weights(at, doc, 41, R.gain_planes(gain)) == want).all()
    assert (R.plane_weights(at[:0], doc[:0], 2, R.gain_planes(gain)) == 0).all() and R.gain_planes(np.zeros(R.BUCKETS, np.int64)) == []


def test_ranks_over_ranges(spark):
    """Many rows of one score and id among others, ranked over several partitions."""
    rows = [(k % 50, 30, 87, 5, k % 7) for k in range(400)] + [(3, 30, 87, 5, 3)] * 500 + [(1, 5, 12, 5, 99)] * 9
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = R.ranked(df, R.Params(percent=50)).collect()
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r.rank) == [(k + 1, r[0], r[4]) for k, r in enumerate(fit[: len(fit) // 2])]
    assert len(got) == len(rows)
