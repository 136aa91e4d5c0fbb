"""Rows that stand thousands of times: each comes out as often as it came in, and none gathers in one task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.llm import common, mixing, near_dup, secrets


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 8)


def rows(spark):
    hot = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("user: someone password: abcdefghijklmnop 10.0.0.1").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("row"))
    varied = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("login=bob token=abcdef123 and more words").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").cast("int").alias("row"))
    plain = spark.range(40).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("plain words of row number "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("source"), F.lit(0).alias("row"))
    none = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(2).alias("row"))
    return hot.unionByName(varied).unionByName(plain).unionByName(none).repartition(5)


def test_meet(spark):
    df = common.nested(rows(spark))
    facts = df.where("row.row <> 0").select("h1", "h2", F.col("row.text").alias("fact")).distinct()
    hot = common.hash_counts(df)
    assert hot.count() == 3 and {r.parts > 1 for r in hot.collect()} == {True}
    plain = lambda how: Counter(map(str, df.join(facts, ["h1", "h2"], how).select("row", "h1", "h2", "fact").collect()))
    for how in ("inner", "left"):
        got = common.meet(df, facts, hot, how)
        assert Counter(map(str, got.collect())) == plain(how)
    alike = common.meet(df, facts, hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [h1" in alike  # rows alike in all columns are one before they are dealt


def test_secrets(spark):
    df = rows(spark)
    found = secrets.scan(df)
    assert found.count() == df.count()
    by = Counter((r.id, secrets_text(r.spans)) for r in found.collect())
    assert by[(None, "weak_id:0:13,assign:14:40,endpoint:41:49")] == 600 and sum(n for (i, _), n in by.items() if i == 5) == 300 and len([1 for i, _ in by if i == 5]) == 1
    out = secrets.redact(df)
    assert out.dtypes == df.dtypes
    want = {"user: someone password: abcdefghijklmnop 10.0.0.1": "[REDACTED] [REDACTED] [REDACTED]", "login=bob token=abcdef123 and more words": "[REDACTED] [REDACTED] and more words"}
    assert Counter(map(tuple, out.collect())) == Counter((r.doc_id, want.get(r.text, r.text), r.source, r.row) for r in df.collect())


def secrets_text(spans):
    return ",".join(f"{secrets.KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def test_mixing(spark):
    df = rows(spark)
    sizes = df.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    out = mixing.mix(sizes, mixing.Params(block=16, group=8)).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, r["size"]) for r in sizes.collect()) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    by_source = Counter()
    for r in out:
        by_source[(r.source_size, r.target)] += r.taken
    groups = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(groups.values()), abs=len(groups))
    again = mixing.mix(sizes.repartition(3), mixing.Params(block=16, group=8)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    copies = mixing.mixed(df)
    assert copies.dtypes == df.dtypes
    each = Counter(map(tuple, copies.collect()))
    have = Counter(map(tuple, df.collect()))
    assert set(each) <= set(have) and all(n <= 2 * have[k] and n % have[k] == 0 for k, n in each.items())


def test_near_dup(spark):
    out = near_dup.keep_one(rows(spark))
    got = Counter(map(tuple, out.collect()))
    assert max(got.values()) == 1
    assert sum(k[0] == 5 for k in got) == 300 and sum(k[0] is None and k[1] is not None for k in got) == 1 and sum(k[1] is None for k in got) == 1
