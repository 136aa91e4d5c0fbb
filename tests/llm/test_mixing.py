import re

from pyspark.sql import functions as F

from recollect.llm import mixing as M


def targets(sizes):
    """Repeated resharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(spark, rows, p=M.Params(block=16, group=8)):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").select("doc_id", "source", M.words(F.col("text")).alias("size"))
    out = M.mix(df, p).collect()
    assert sorted(((r.doc_id, r.size) for r in out), key=str) == sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, _, t in rows), key=str)
    source = {i: s for i, s, _ in rows}
    sizes, taken = {}, {}
    for r in out:
        s = source[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5
    return out


def test_targets_and_limits(spark):
    rows = [(i, ["hot", "a", None, "é", "z", "Z"][0 if i % 3 == 0 else i % 6], "w " * (i * 7 % 53)) for i in range(400)]
    a, b = check(spark, rows), check(spark, rows[::-1])
    assert sorted(a) == sorted(b)  # reruns agree


def test_edges(spark):
    check(spark, [(1, "a", "one"), (2, "b", None), (3, None, "")])
    check(spark, [(1, "a", None)])
    check(spark, [(1, "only", "x " * 1000)])
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    twice = check(spark, [(7, "a", "x y z")] * 2)
    assert [r.taken for r in twice] and len(twice) == 2


def test_documents_of_the_mix(spark):
    rows = [(i, "x " * 10, f"s{i % 2}", i) for i in range(60)] + [(0, "x " * 10, "s0", 0)]
    names = ["size", "_id", "_hash", "_copies", "_copy", "key", "row", "taken"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").select("doc_id", "text", "source", *(F.col("n").alias(c) for c in names), F.array("n").alias("an array"))
    df = df.unionByName(df.where("doc_id = 3").withColumn("row", F.lit(-1).cast("long")))
    out = M.mixed(df)
    assert out.schema == df.schema and not out.exceptAll(df).exceptAll(df).count()  # each row as it was, twice at most
    out = out.where("row >= 0")
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(v for k, v in counts.items() if k) <= 2 and abs(out.count() - 91) <= 3
