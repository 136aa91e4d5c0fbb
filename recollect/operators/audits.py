"""Audits of run archives, traces and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checks import LEAST_NORM, all_of, key, violations

#: The statuses of archives.
STATUSES = ["emitted_by_evaluator", "rehydrated_from_declared_inputs"]
SCALARS = ["pairing_fp", "evaluation_fp", "status", "metadata_json"]
META = "map<string,string>"


def archives(runs: DataFrame, ranks: DataFrame) -> DataFrame:
    """What is wrong with each run's record and ranks."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    meta = F.from_json("metadata_json", META)
    of = lambda name: F.get_json_object("metadata_json", f"$.{name}")
    r = runs.withColumn("meta", meta).withColumn("method", F.coalesce(of("method"), of("evaluation_payload.method")))
    ok = F.col("meta").isNotNull()
    differs = lambda name, c: ok & ~of(name).eqNullSafe(F.col(c))
    reasons = {f"invalid_{c}": blank(c) for c in SCALARS}
    reasons |= {
        "unknown_status": ~blank("status") & ~F.col("status").isin(STATUSES),
        "metadata_not_an_object": ~blank("metadata_json") & ~ok,
        "metadata_status_differs": differs("provenance_status", "status"),
        "metadata_pairing_differs": differs("pairing_fingerprint", "pairing_fp"),
        "metadata_evaluation_differs": differs("evaluation_fingerprint", "evaluation_fp"),
        "no_pairing_payload": ok & of("pairing_payload").isNull(),
        "no_evaluation_payload": ok & of("evaluation_payload").isNull(),
        "payload_pairing_differs": ok & of("evaluation_payload").isNotNull() & ~of("evaluation_payload.pairing_fingerprint").eqNullSafe(F.col("pairing_fp")),
        "no_model_revision": ok & (F.col("status") == STATUSES[0]) & (F.coalesce("method", F.lit("h0")) != "h0") & blank(F.coalesce(of("model_revision"), of("evaluation_payload.model_revision"))),
    }
    g = ranks.groupBy("run_id").agg(F.min("rank").alias("least"), F.count("*").alias("n"), F.count_distinct("session_id").alias("s"), F.count_distinct("turn").alias("t"), F.count_distinct("session_id", "turn").alias("d"))
    shape = violations(g, "archive", F.col("run_id"), {"negative_rank": F.col("least") < 0, "not_rectangular": F.col("d") != F.col("s") * F.col("t"), "session_twice": F.col("n") != F.col("d")})
    unranked = runs.join(ranks.select("run_id").distinct().hint("merge"), "run_id", "left_anti").select(F.lit("archive").alias("check"), F.col("run_id").alias("key"), F.lit("no_ranks").alias("reason"))
    return all_of(violations(r, "archive", F.col("run_id"), reasons), shape, unranked)


def archive_totals(runs: DataFrame, found: DataFrame) -> DataFrame:
    bad = found.select(F.col("key").alias("run_id")).distinct().withColumn("bad", F.lit(1))
    return runs.join(bad.hint("merge"), "run_id", "left").agg(F.count("*").alias("archives"), F.count("bad").alias("failures"))


def triplet_shape(ranks: DataFrame, runs: list[str], sessions: int, turns: int) -> DataFrame:
    g = ranks.where(F.col("run_id").isin(runs)).groupBy("run_id").agg(F.count_distinct("session_id").alias("s"), F.count_distinct("turn").alias("t"))
    return violations(g, "shape", F.col("run_id"), {"sessions": F.col("s") != sessions, "turns": F.col("t") != turns})


def trace_keys(traces: DataFrame, runs: list[str], expected: int) -> DataFrame:
    """Turns that some but not all of the runs have traces of, and runs with another number of traces than expected."""
    own = traces.where(F.col("run_id").isin(runs))
    lone = own.groupBy("session_id", "turn").agg(F.count_distinct("run_id").alias("n")).where(F.col("n") < len(runs)).select(F.lit("trace_keys").alias("check"), key("session_id", "turn").alias("key"), F.lit("not_in_all_runs").alias("reason"))
    sizes = own.groupBy("run_id").count().where(F.col("count") != expected).select(F.lit("trace_keys").alias("check"), F.col("run_id").alias("key"), F.lit("other_number_of_traces").alias("reason"))
    return lone.unionByName(sizes)


def first_turn_equal(ranks: DataFrame) -> DataFrame:
    g = ranks.where("turn = 0").groupBy("session_id").agg(F.count_distinct("rank").alias("n")).where("n > 1")
    return g.select(F.lit("first_turn").alias("check"), key("session_id").alias("key"), F.lit("runs_differ").alias("reason"))


def no_op(ranks: DataFrame, sizes: DataFrame, run: str) -> DataFrame:
    """States of a run without a remembered negative whose rank isn't h0's."""
    h0 = ranks.where("run_id = 'h0'").select("session_id", "turn", F.col("rank").alias("h"))
    own = ranks.where(F.col("run_id") == run).select("session_id", "turn", "rank")
    bad = own.join(sizes.where("negative = 0").hint("merge"), ["session_id", "turn"]).join(h0.hint("merge"), ["session_id", "turn"]).where("rank <> h")
    return bad.select(F.lit(f"no_op_{run}").alias("check"), key("session_id", "turn").alias("key"), F.lit("rank_differs_from_h0").alias("reason"))


def no_op_lists(tops: DataFrame, sizes: DataFrame, run: str) -> DataFrame:
    """The same for the items at the top, as lists."""
    lists = tops.groupBy("run_id", "session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("position", "corpus_idx"))).alias("list"))
    one = lambda r, name: lists.where(F.col("run_id") == r).select("session_id", "turn", F.col("list").alias(name))
    bad = one(run, "a").join(one("h0", "h").hint("merge"), ["session_id", "turn"]).join(sizes.where("negative = 0").hint("merge"), ["session_id", "turn"]).where("a <> h")
    return bad.select(F.lit(f"no_op_list_{run}").alias("check"), key("session_id", "turn").alias("key"), F.lit("list_differs_from_h0").alias("reason"))


def clean_guard(clean: DataFrame, ranks: DataFrame) -> DataFrame:
    """History-only states where `current` isn't h0."""
    one = lambda r, name: ranks.where(F.col("run_id") == r).select("session_id", "turn", F.col("rank").alias(name))
    bad = clean.select("session_id", "turn").join(one("h0", "h").hint("merge"), ["session_id", "turn"]).join(one("current", "c").hint("merge"), ["session_id", "turn"]).where("h <> c")
    return bad.select(F.lit("clean_guard").alias("check"), key("session_id", "turn").alias("key"), F.lit("current_differs_from_h0").alias("reason"))


def session_summary(states: DataFrame) -> DataFrame:
    per = states.groupBy("session_id").agg(F.count("*").alias("t"), F.min("target_index").alias("target"), F.min(F.size("query_vector")).alias("d0"), F.max(F.size("query_vector")).alias("d1"), F.count_if(F.coalesce("query_text", F.lit("")) == "").alias("no_text"))
    return per.agg(
        F.count("*").alias("sessions"), F.min("t").alias("least_turns"), F.max("t").alias("most_turns"), F.min("d0").alias("least_dimension"), F.max("d1").alias("most_dimension"),
        F.sum("no_text").alias("texts_missing"), F.min("target").alias("least_target"), F.max("target").alias("most_target"), (F.max("session_id") - F.min("session_id") + 1 == F.count("*")).alias("contiguous_ids"),
    )


def corpus_summary(corpus: DataFrame) -> DataFrame:
    v = F.col("vector")
    return corpus.agg(F.count("*").alias("rows"), F.min(F.size(v)).alias("least_dimension"), F.max(F.size(v)).alias("most_dimension"), F.count_if(~S.finite(v)).alias("not_finite"))


def corpus_checks(corpus: DataFrame) -> DataFrame:
    """An encoded corpus: rows numbered in order, vectors finite and not zero, and their lengths."""
    n = S.norm(F.col("vector"))
    return corpus.agg((F.max("corpus_idx") == F.count("*") - 1).alias("numbered"), (F.count_distinct("corpus_idx") == F.count("*")).alias("unique"), F.count_if(n <= LEAST_NORM).alias("zero"), F.min(n).alias("least_norm"), F.avg(n).alias("mean_norm"), F.max(n).alias("most_norm"))


def belief_summary(beliefs: DataFrame) -> DataFrame:
    """Totals of exploded artifacts; id_mismatches counts dialogues and turns that don't stand at their own number's place."""
    places = [F.col(a) != F.col(b) for a, b in (("session_id", "position"), ("feedback_turn", "turn_position")) if b in beliefs.columns]
    dialog, turn = [*places, F.lit(False), F.lit(False)][:2]
    return beliefs.agg(F.count_distinct(F.when(dialog, F.col("session_id"))).alias("dialog_mismatches"), F.count_distinct(F.when(turn, F.struct("session_id", "feedback_turn"))).alias("turn_mismatches"), F.count_distinct("session_id").alias("dialogs"), F.count_if(F.col("polarity") == "negative").alias("negatives"), F.count_if(F.col("polarity") == "positive").alias("positives"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("most_confidence"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two backbones have the same sessions, targets and texts."""
    one = lambda df, t, x: df.select("session_id", "turn", F.col("target_index").alias(t), F.col("query_text").alias(x))
    both = one(a, "ta", "xa").join(one(b, "tb", "xb").hint("merge"), ["session_id", "turn"], "full")
    return both.agg(F.bool_and(F.col("ta").isNotNull() & F.col("tb").isNotNull()).alias("same_turns"), F.bool_and(F.coalesce(F.col("ta") == F.col("tb"), F.lit(True))).alias("same_targets"), F.bool_and(F.coalesce(F.col("xa") == F.col("xb"), F.lit(True))).alias("same_texts"))


def lineage(sessions: DataFrame, corpus: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, passed) of each check of two one-row summaries, and overall."""
    both = sessions.withColumn("one", F.lit(1)).join(corpus.select(F.col("rows").alias("corpus_rows"), "not_finite").withColumn("one", F.lit(1)).hint("broadcast"), "one")  # one row
    tests = {"sessions": F.col("sessions") == expected["sessions"], "turns": (F.col("least_turns") == expected["turns"]) & (F.col("most_turns") == expected["turns"]), "targets_in_corpus": F.col("most_target") < F.col("corpus_rows"), "corpus_finite": F.col("not_finite") == 0, "contiguous_ids": F.col("contiguous_ids")}
    overall = F.lit(True)
    for t in tests.values():
        overall = overall & t
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), t.alias("passed")) for n, t in (tests | {"overall": overall}).items()))
    return both.select(F.inline(pairs))
