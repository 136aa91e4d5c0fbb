import math
import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import quality as Q
from recollect.llm import toxicity as X
from recollect.llm.features import labelled_sample

WORDS = ["the", "river", "stone", "walks", "over", "quiet", "hill", "morning", "light", "garden"]
RUDE = ["idiot", "scum", "moron"]


def corpus(n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        bad, rude = i % 4 == 1, i % 5 == 2
        if rude:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        rows.append((i, " ".join(x + "$$$" if bad else x for x in w), int(not bad), int(rude)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], 0.5) for r in rows] + [(None, None, 0.5), (-1, "", 0.5), (0, rows[0][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 0, 1), (5, None, None), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    p = Q.Params(bits=14, sample_per_label=100)
    model = Q.fit(docs, labels, p)
    out = Q.classify(docs, model, p).withColumn("held", Q.held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id in truth]
    assert held and all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    again = Q.fit(docs.repartition(3), labels, p)
    assert (again[0] == model[0]).all() and again[1] == model[1]


def test_held_out_labels_do_not_matter(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    p = Q.Params(bits=12, epochs=1)
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (Q.fit(docs, labels, p)[0] == Q.fit(docs, turned, p)[0]).all()


def test_toxicity(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    model = X.fit(docs, labels, X.Params(sample_per_label=60))
    assert (model[1][1:] >= model[1][:-1]).all()
    out = X.grade(docs, model).collect()
    truth = {r[0]: r[3] for r in rows}
    assert len(out) == len(rows) + 3 and all(0 <= r.severity <= X.GRADES for r in out)
    assert sum(r.toxic == bool(truth[r.doc_id]) for r in out if r.doc_id in truth) >= 0.95 * len(rows)
    assert not any(r.toxic for r in out if not r.text)


def test_texts_without_evidence_are_not_told_toxic(spark):
    """Even where a third of the rows are toxic."""
    rows = [(i, t, 1, x) for i, t, _, x in corpus() if x or i % 4 in (0, 1)]  # with marks of bad quality on both sides
    docs, labels = frames(spark, rows)
    out = X.grade(docs, X.fit(docs, labels)).collect()
    assert 0.3 < sum(r[3] for r in rows) / len(rows) < 0.45 and not any(r.toxic for r in out if not r.text or not any(x in r.text for x in RUDE))


def test_without_labels(spark):
    docs, labels = frames(spark, corpus(8))
    none = labels.limit(0)
    assert {r.score > 0.99 for r in Q.classify(docs, Q.fit(docs, none)).collect()} == {True}
    assert {r.toxic for r in X.grade(docs, X.fit(docs, none)).collect()} == {False}
    assert Q.classify(docs.limit(0), Q.fit(docs, none)).count() == 0


def test_scores_follow_the_shares_of_all_labels(spark):
    docs, labels = frames(spark, corpus(960))
    known = labels.where("doc_id >= 0 AND doc_id < 960").where(~Q.held_out())
    good, bad = known.where("quality = 1").count(), known.where("quality = 0").count()
    empty = lambda model, p: float(Q.mean_scores([""], *model, p)[0, 0])
    few, all_ = Q.Params(bits=12, sample_per_label=100), Q.Params(bits=12)
    texts, y, stands = labelled_sample(docs, labels, "quality", 100, ~Q.held_out())
    assert stands == ((bad + 0) / 100, (good + 1) / 100) and sum(y) in (99, 100)  # a label of a document that isn't there counts
    raw = Q.train(texts, y, p=few)
    assert abs(Q.fit(docs, labels, few)[1] - raw[1] - math.log((good + 1) / bad)) < 1e-9
    assert empty(Q.fit(docs, labels, few), few) > 0.6 and empty(raw, few) < 0.6
    assert labelled_sample(docs, labels, "quality", 5000)[2] == (1.0, 1.0)

    chance = lambda cap: float(X.severities([""], *X.fit(docs, labels, X.Params(sample_per_label=cap)), X.Params())[0, 1])
    texts, y, stands = labelled_sample(docs, labels, "toxic", 100)
    plain = X.train(texts, y, p=X.Params())
    assert abs(chance(100) - chance(5000)) < abs(float(X.severities([""], *plain, X.Params())[0, 1]) - chance(5000)) / 2


def test_the_sample_is_bounded_before_it_is_collected(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    plain = labelled_sample(docs, labels, "toxic", 5000)
    again = docs.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("zz "), F.col("id").cast("string")).alias("text"), F.lit(0.5).alias("score")))
    assert labelled_sample(again, labels, "toxic", 5000) == plain  # of an id's texts the least
    long = docs.withColumn("text", F.when(F.col("doc_id") == 8, F.repeat(F.lit("long "), 50_000)).otherwise(F.col("text")))
    texts, y, stands = labelled_sample(long, labels, "toxic", 5000, None, 16_000)
    for k in (0, 1):
        mine = [x for x, l in zip(texts, y) if l == k]
        have = sum(r[3] == k for r in rows)
        assert max(map(len, mine)) <= 1000 and 8_000 < sum(map(len, mine)) <= 16_000 and set(mine) <= set(plain[0])
        assert abs(stands[k] * len(mine) - have) < 1e-6 or k == 0 and abs(stands[k] * len(mine) - have) <= 2


def test_the_cut_is_chosen_on_unseen_rows(spark):
    docs, labels = frames(spark, corpus(600))
    model, p = X.tuned(docs, labels, X.Params(epochs=60))
    assert p.threshold in p.thresholds and p.evidence in p.evidences
    assert (model[0] == X.fit(docs, labels, X.Params(epochs=60))[0]).all()
    turned = labels.withColumn("toxic", F.when(Q.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.tuned(docs, turned, X.Params(epochs=60))[1] == p
    # labels that words don't tell: a dear miss lowers the cut, a cheap one raises it
    rng = random.Random(1)
    texts = [rng.choice(["scum walks", "scum hill", "quiet hill", "quiet stone"]) for _ in range(800)]
    y = [int("scum" in t and rng.random() < 0.35) for t in texts]
    dear, cheap = (X.cross_validated(texts, y, p=X.Params(epochs=80, miss=m)).threshold for m in (9.0, 1.0))
    assert dear < 0.35 and dear < cheap
    assert X.cross_validated([], []) == X.Params() == X.cross_validated(["a"], [1])


def test_training_follows_the_derivatives():
    """Slopes of the ordinal likelihood by differences, and the softmax loss that falls."""
    rng = np.random.default_rng(4)
    cut = np.array([-0.4, 0.3, 1.1])

    def loss(z, g):
        up = np.concatenate([[1.0], X.sigmoid(z - cut), [0.0]])
        return -np.log(up[g] - up[g + 1])

    for _ in range(50):
        z, g = rng.normal(), int(rng.integers(0, 4))
        up = X.sigmoid(z - cut)
        full = np.concatenate([[1.0], up, [0.0]])
        slope = sum(up[k] * (1 - up[k]) / (full[g] - full[g + 1]) * (1 if g > k else -1) for k in (g - 1, g) if 0 <= k < 3)
        assert abs((loss(z + 1e-5, g) - loss(z - 1e-5, g)) / 2e-5 + slope) < 1e-5
    rows = corpus(200)
    texts, quality_, toxic = [r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])

    def softmax_loss(epochs):
        p = Q.Params(bits=14, epochs=epochs)
        s = Q.mean_scores(texts, *Q.train(texts, quality_.tolist(), p=p), p)[:, 0]
        return -np.log(np.clip(np.where(quality_ == 1, s, 1 - s), 1e-12, 1)).mean()

    few, more = softmax_loss(1), softmax_loss(8)
    assert more < few

    def ordinal_loss(epochs):
        p = X.Params(epochs=epochs)
        s = X.severities(texts, *X.train(texts, toxic.tolist(), p=p), p)[:, 1]
        return -np.log(np.clip(np.where(toxic == 1, s, 1 - s), 1e-12, 1)).mean()

    assert ordinal_loss(200) < ordinal_loss(40) < ordinal_loss(5)


def test_long_and_repeated_rows_and_clashing_names(spark):
    docs, labels = frames(spark, corpus())
    long = spark.createDataFrame([(900, "scum hill " * 60_000, 0.1), (900, "scum hill " * 60_000, 0.1), (901, None, 0.2)], "doc_id long, text string, score double")
    odd = docs.unionByName(long).withColumns({c: F.col("doc_id") for c in ("order", "label", "severity", "p_toxic", "toxic", "n", "taken")})
    p = Q.Params(bits=14, sample_per_label=100)
    model = Q.fit(odd, labels, p)
    out = {}
    for r in Q.classify(odd, model, p).collect():
        out.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in out.values())
    assert abs(out["scum hill " * 60_000].pop() - Q.mean_scores(["scum hill " * 60_000], *model, p)[0, 0]) < 1e-12
    m = X.fit(odd, labels)
    got = X.grade(odd, m).where("doc_id >= 900").select("doc_id", "severity", "toxic").collect()
    short = X.severities(["scum hill"], *m, X.Params())[0, 0]  # presence only: length adds nothing
    assert [abs(r.severity - short) < 1e-9 and r.toxic for r in got if r.doc_id == 900] == [True, True] and [r.toxic for r in got if r.doc_id == 901] == [False]


def test_the_driver_gets_the_model_and_none_of_the_texts(spark):
    rows = [(r[0], r[1] + " " + f"stone{r[0]} " * 8_000, *r[2:]) for r in corpus(160)]
    docs, labels = (x.cache() for x in frames(spark, rows))
    docs.count(), labels.count()
    p = Q.Params(bits=12, epochs=1)
    tracemalloc.start()
    try:
        weights, bias = Q.fit(docs, labels, p)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    texts, y, stands = labelled_sample(docs, labels, "quality", p.sample_per_label, ~Q.held_out(), p.sample_characters)
    assert sum(map(len, texts)) > 8 * most
    plain = Q.train(texts, y, stands, p)
    assert (weights == plain[0]).all() and bias == plain[1]
