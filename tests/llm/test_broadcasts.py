"""How many tables one query broadcasts: each takes megabytes of the driver's memory at once, however few its rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.llm import common, mixing


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"), F.col("id").alias("x"))
    facts = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 7).alias("fact"))
    want = Counter(map(tuple, df.join(facts, "k", how).select("k", "x", "fact").collect()))
    cold = common.spread_join(df, facts, "k", facts.where("k < 0").select("k"), how)
    assert Counter(map(tuple, cold.collect())) == want and broadcasts(cold) == 0
    hot = common.spread_join(df, facts, "k", facts.where("k IN (1, 3)").select("k"), how)
    assert Counter(map(tuple, hot.collect())) == want and broadcasts(hot) > 0


def test_mix(spark):
    """What is used several times is at rest; else each use would broadcast its sources anew, all at once."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 9).alias("size"))
    assert broadcasts(mixing.mix(docs, mixing.Params(block=16, group=8))) <= 2
