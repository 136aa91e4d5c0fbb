"""Queries against their SQL over tables made to hold what the smallest given ones happen not to."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import plain

import __spark_entry__ as entry

TABLES = ("conversations", "embeddings")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sessions of two to five turns; texts of many lengths, so that most turns tell of something."""
    to = tmp_path_factory.mktemp("own")
    talk = spark.range(40).select(F.col("id").alias("conv_id"), F.explode(F.expr("sequence(0, (id div 5) % 4 + 1)")).alias("turn"))
    text = F.repeat(F.lit("a"), (F.col("conv_id") * 3 + F.col("turn") * 5 + 5).cast("int"))
    talk.select("conv_id", "turn", F.lit("user").alias("role"), text.alias("text")).write.parquet(str(to / "conversations.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(str(to / "embeddings.parquet"))
    return str(to)


def both(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = entry.queries()[name](spark, folder), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return plain(got.collect(), got.columns), plain(want.fetchall(), columns)


def test_a_turn_that_is_not_there_is_not_refused(spark, folder):
    got, want = both(spark, folder, "d16b_live_from_batch")
    assert got == want and any(True in r for r in got)
