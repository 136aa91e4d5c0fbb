"""Joins of many rows with a small fact for each key, whatever the keys' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than LEAST, and more than one in MOST of all, meets its fact by broadcast: there are at most MOST of them.
LEAST, MOST = 1024, 4096


def met(rows: DataFrame, facts: DataFrame, key: str, missing: Column | None = None) -> DataFrame:
    """rows with the columns of facts, which has a row for each key; rows without one fall away, or, with `missing`, raise its text.

    Keys that many rows share are broadcast with their facts, for all others both sides are dealt by key. rows must be at rest, as it is read twice.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    often = counts.where(F.col("_n") > max(LEAST, total // MOST)).select(key)
    near = F.broadcast(often.join(facts, key))
    others = [c for c in facts.columns if c != key]
    early = rows.join(near.select(F.col(key).alias("_key"), F.struct(*others).alias("_near")), F.col(key) == F.col("_key"), "left").drop("_key")
    # rows that have met theirs are dealt by all that they hold, and meet nothing more
    salt = F.when(F.col("_near").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).otherwise(0).alias("_salt")
    late = early.select("*", salt).join(facts.select(F.col(key).alias("_key"), F.struct(*others).alias("_far"), F.lit(0).cast("long").alias("_none")).hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_none")), "left")
    fact = F.coalesce("_near", "_far")
    if missing is None:
        late = late.where(fact.isNotNull())
    else:
        fact = F.when(fact.isNull(), F.raise_error(missing).cast(near.select(F.struct(*others).alias("x")).schema["x"].dataType)).otherwise(fact)
    return late.select(*rows.columns, fact.alias("_fact")).select(*rows.columns, *(F.col(f"_fact.{c}").alias(c) for c in others))
