"""Retrieval metrics over long rank tables (run_id, session_id, turn, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def progress(ranks: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """hit, any hit so far, best rank so far, and the trapezoid of ln(best + 1) with the turn before (null at the first)."""
    session = W.partitionBy(*(by or ["run_id"]), "session_id").orderBy("turn")
    run = session.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranks.withColumns({"hit": S.hit(F.col("rank"), k), "best": F.min("rank").over(run)})
    out = out.withColumn("hit_so_far", F.max("hit").over(run)).withColumn("ln", F.log(F.col("best") + F.lit(1.0)))
    return out.withColumn("trapezoid", (F.col("ln") + F.lag("ln").over(session)) / 2)


def per_turn(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Recall and cumulative hits in percent, by run and turn."""
    return progress(ranks, k).groupBy("run_id", "turn").agg((100 * F.avg("hit")).alias("recall"), (100 * F.avg("hit_so_far")).alias("cumulative"))


def session_bri(ranks: DataFrame) -> DataFrame:
    """The best-rank integral of each session: the mean trapezoid, or ln(rank + 1) of a single turn."""
    return progress(ranks).groupBy("run_id", "session_id").agg(F.coalesce(F.avg("trapezoid"), F.max("ln")).alias("bri"))


#: What counts as final where sessions have unlike numbers of turns: each session's own last turn, or the last turn of the longest sessions alone.
OWN, LONGEST = "own", "longest"


def at_last(rows: DataFrame, by: list[str], final: str = OWN, **values: Column) -> DataFrame:
    """(by, session_id, values) at each session's last turn; final = LONGEST: of the sessions alone that reach the last turn of all."""
    last = rows.groupBy(*by, "session_id").agg(F.max("turn").alias("_turn"), *(F.max_by(v, "turn").alias(n) for n, v in values.items()))
    if final == LONGEST:
        last = last.withColumn("_most", F.max("_turn").over(W.partitionBy(*by))).where("_turn = _most").drop("_most")
    elif final != OWN:
        raise ValueError(f"final is {OWN} or {LONGEST}")
    return last.drop("_turn")


def summary(ranks: DataFrame, k: int = 10, by: tuple[str, ...] = ("run_id",), final: str = OWN) -> DataFrame:
    """A row for each run: mean recall of feedback turns, last recall and cumulative hits, integral, sizes. `by` names what a run is."""
    by = list(by)
    p = progress(ranks, k, by)
    by_turn = p.groupBy(*by, "turn").agg(F.avg("hit").alias("recall"), F.count("*").alias("n"), F.sum("trapezoid").alias("t"), F.count("trapezoid").alias("nt"), F.avg("ln").alias("ln"))
    out = by_turn.groupBy(*by).agg(
        (100 * F.avg(F.when(F.col("turn") >= 1, F.col("recall")))).alias("average_feedback_recall"),
        F.when(F.sum("nt") > 0, F.sum("t") / F.sum("nt")).otherwise(F.max("ln")).alias("bri"),
        F.max("n").alias("num_dialogues"),
        F.count("*").alias("num_rounds"),
    )
    last = at_last(p, by, final, hit=F.col("hit"), hit_so_far=F.col("hit_so_far")).groupBy(*by).agg((100 * F.avg("hit")).alias("final_recall"), (100 * F.avg("hit_so_far")).alias("final_cumulative"))
    return out.join(last.hint("merge"), by).select(*by, "average_feedback_recall", "final_recall", "final_cumulative", "bri", "num_dialogues", "num_rounds")
