"""Checks that return violations, as rows (check, key, reason); an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The types of structured negatives.
TYPES = ["EXISTENCE", "ATTRIBUTE", "RELATION", "GLOBAL"]
LEAST_NORM = 1e-8


def key(*columns: str) -> Column:
    return F.concat_ws(":", *columns)


def violations(df: DataFrame, check: str, key_: Column, reasons: dict[str, Column]) -> DataFrame:
    """A row for each reason whose condition holds; a null condition doesn't hold."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))
    return df.select(F.lit(check).alias("check"), key_.alias("key"), F.explode(found).alias("reason"))


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("check", "reason").agg(F.count("*").alias("n"))


def beliefs(df: DataFrame) -> DataFrame:
    """fact_type is checked where the table has it."""
    c = F.col("confidence")
    reasons = {"empty_attribute": F.coalesce(F.trim("attribute") == "", F.lit(True)), "confidence_out_of_range": F.coalesce(F.isnan(c) | ~c.between(0, 1), F.lit(True))}
    if "fact_type" in df.columns:
        reasons["empty_fact_type"] = F.coalesce(F.trim("fact_type") == "", F.lit(True))
    return violations(df, "belief", key("session_id", "feedback_turn", "polarity", "idx"), reasons)


def bundles(df: DataFrame) -> DataFrame:
    """question and answer are checked where the table has them."""
    reasons = {"negative_turn": F.col("feedback_turn") < 0, "unknown_polarity": ~F.col("polarity").isin("positive", "negative")}
    reasons |= {f"no_{c}": F.col(c).isNull() for c in ("question", "answer") if c in df.columns}
    return violations(df, "bundle", key("session_id", "feedback_turn"), reasons)


def configs(df: DataFrame) -> DataFrame:
    """Configurations (as tables.read_configs gives them) with values that the operators refuse."""
    least = {"negative_weight": 0, "recency_decay": 0, "override_boost": 0, "max_concepts": 1, "top_k": 1}
    reasons = {f"{c}_below_{n}": F.coalesce(F.isnan(F.col(c).cast("double")) | (F.col(c) < n), F.lit(True)) for c, n in least.items()}
    reasons["semantic_merge_threshold_out_of_range"] = ~((F.col("semantic_merge_threshold") > 0) & (F.col("semantic_merge_threshold") <= 1))
    return violations(df, "config", key("config_id"), reasons)


def vectors(df: DataFrame, check: str, key_: Column, vector: str, size: int | None = None) -> DataFrame:
    v = F.col(vector)
    return violations(df, check, key_, {"not_finite": ~S.finite(v), "zero_norm": S.finite(v) & (S.norm(v) <= LEAST_NORM), "missing": v.isNull(), **({"wrong_dimension": F.size(v) != size} if size else {})})


def turns(states: DataFrame) -> DataFrame:
    k = key("session_id", "turn")
    return all_of(violations(states, "turn", k, {"negative_turn": F.col("turn") < 0, "nothing_to_encode": F.col("query_vector").isNull() & (F.coalesce(F.trim("query_text"), F.lit("")) == "")}), vectors(states.where("query_vector IS NOT NULL"), "turn", k, "query_vector"))


def sessions(states: DataFrame) -> DataFrame:
    g = states.groupBy("session_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"), F.count_distinct("turn").alias("d"), F.min("target_index").alias("target"))
    return violations(g, "session", key("session_id"), {"turns_not_contiguous": (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("n") != F.col("d")), "negative_target": F.col("target") < 0})


def corpus(df: DataFrame, top_k: int) -> DataFrame:
    v = F.col("vector")
    g = df.agg(F.count("*").alias("n"), F.count_distinct(F.size(v)).alias("sizes"), F.count_if(~S.finite(v)).alias("odd"), F.count_if(S.finite(v) & (S.norm(v) <= LEAST_NORM)).alias("zero"))
    return violations(g, "corpus", F.lit("corpus"), {"fewer_rows_than_top_k": F.col("n") < top_k, "several_dimensions": F.col("sizes") > 1, "not_finite": F.col("odd") > 0, "zero_norm": F.col("zero") > 0})


def queries(states: DataFrame, dimension: int) -> DataFrame:
    return vectors(states, "query", key("session_id", "turn"), "query_vector", dimension)


def concepts(events: DataFrame, vocabulary: DataFrame, dimension: int) -> DataFrame:
    missing = events.select(F.trim("attribute").alias("text")).distinct().join(vocabulary.select("text").hint("merge"), "text", "left_anti")
    return all_of(missing.select(F.lit("concept").alias("check"), F.col("text").alias("key"), F.lit("no_vector").alias("reason")), vectors(vocabulary, "concept", F.col("text"), "vector", dimension))


def encoder_dimension(vocabulary: DataFrame, corpus_: DataFrame) -> DataFrame:
    """Dimensions of the vocabulary that the corpus doesn't have."""
    d = lambda df: df.select(F.size("vector").cast("string").alias("key")).distinct()
    return d(vocabulary).join(d(corpus_).hint("merge"), "key", "left_anti").select(F.lit("encoder").alias("check"), "key", F.lit("dimension_not_in_corpus").alias("reason"))


def header(artifact: DataFrame) -> DataFrame:
    return violations(artifact, "header", F.lit("artifact"), {"wrong_version": F.coalesce(F.col("schema_version") != 2, F.lit(True)), "not_complete": F.coalesce(F.col("status") != "complete", F.lit(True)), "quality_not_passed": ~F.coalesce(F.col("quality.passed"), F.lit(False)), "no_provenance": F.col("provenance").isNull()})


def file_order(beliefs_: DataFrame) -> DataFrame:
    """Dialogue ids and turns that differ from their places in the artifact."""
    return violations(beliefs_, "order", key("position", "turn_position", "polarity", "idx"), {"dialog_id": F.col("session_id") != F.col("position"), "turn": F.col("feedback_turn") != F.col("turn_position")})


def conflicts_in_turn(beliefs_: DataFrame) -> DataFrame:
    """Concepts that one turn has in both polarities."""
    g = beliefs_.groupBy("session_id", "feedback_turn", S.canonical(F.col("attribute")).alias("concept")).agg(F.count_distinct("polarity").alias("n")).where("n > 1")
    return g.select(F.lit("conflict_in_turn").alias("check"), key("session_id", "feedback_turn", "concept").alias("key"), F.lit("both_polarities").alias("reason"))


def conflicts_with_memory(beliefs_: DataFrame) -> DataFrame:
    """Beliefs whose concept an earlier turn had in the other polarity: the first such turns are found by running minima."""
    ev = beliefs_.select("session_id", "feedback_turn", "polarity", "idx", S.canonical(F.col("attribute")).alias("concept"))
    by = W.partitionBy("session_id", "concept")
    first = lambda p: F.min(F.when(F.col("polarity") == p, F.col("feedback_turn"))).over(by)
    found = ev.withColumns({"n": first("negative"), "p": first("positive")}).where("CASE polarity WHEN 'positive' THEN n WHEN 'negative' THEN p END < feedback_turn")
    return found.select(F.lit("conflict_with_memory").alias("check"), key("session_id", "feedback_turn", "polarity", "idx").alias("key"), F.lit("other_polarity_remembered").alias("reason"))


def structured_matches(beliefs_: DataFrame, structured: DataFrame) -> DataFrame:
    """Negatives without a structured record, or with one of another text."""
    n = beliefs_.where("polarity = 'negative'").select("session_id", "feedback_turn", "idx", "attribute")
    both = n.join(structured.select("session_id", "feedback_turn", "idx", "negative_attribute").hint("merge"), ["session_id", "feedback_turn", "idx"], "left")
    return violations(both, "structured", S.item_key(F.col("session_id"), F.col("feedback_turn"), F.col("idx")), {"no_record": F.col("negative_attribute").isNull(), "other_text": S.canonical(F.col("attribute")) != S.canonical(F.col("negative_attribute"))})


def structured_types(structured: DataFrame) -> DataFrame:
    t = F.upper(F.trim("sem_type"))
    return violations(structured, "structured_type", S.item_key(F.col("session_id"), F.col("feedback_turn"), F.col("idx")), {"actionable_missing": F.col("actionable").isNull(), "unknown_type": ~t.isin(TYPES)})


def unique_items(structured: DataFrame) -> DataFrame:
    g = structured.groupBy("session_id", "feedback_turn", "idx").count().where("count > 1")
    return g.select(F.lit("structured_key").alias("check"), S.item_key(F.col("session_id"), F.col("feedback_turn"), F.col("idx")).alias("key"), F.lit("stands_twice").alias("reason"))


def rank_matrix(ranks: DataFrame) -> DataFrame:
    """Turns that lack sessions which other turns of the run have, and negative ranks."""
    g = ranks.groupBy("run_id", "turn").agg(F.count("*").alias("n"), F.min("rank").alias("least"))
    g = g.withColumn("most", F.max("n").over(W.partitionBy("run_id")))
    return violations(g, "ranks", key("run_id", "turn"), {"not_rectangular": F.col("n") != F.col("most"), "negative_rank": F.col("least") < 0})


def coverage(states: DataFrame, beliefs_: DataFrame) -> DataFrame:
    """Feedback states whose dialogue turn has no beliefs."""
    known = beliefs_.select("session_id", (F.col("feedback_turn") + 1).alias("turn")).distinct()
    return states.where("turn > 0").join(known.hint("merge"), ["session_id", "turn"], "left_anti").select(F.lit("coverage").alias("check"), key("session_id", "turn").alias("key"), F.lit("no_bundle").alias("reason"))


def targets(states: DataFrame, corpus_: DataFrame) -> DataFrame:
    out = states.select("session_id", F.col("target_index").alias("corpus_idx")).distinct().join(corpus_.select("corpus_idx").hint("merge"), "corpus_idx", "left_anti")
    return out.select(F.lit("target").alias("check"), key("session_id").alias("key"), F.lit("not_in_corpus").alias("reason"))


def expected_sizes(states: DataFrame, n_sessions: int, n_turns: int) -> DataFrame:
    g = states.groupBy("session_id").agg(F.count("*").alias("t"))
    odd = g.where(F.col("t") != n_turns).select(F.lit("size").alias("check"), key("session_id").alias("key"), F.lit("other_number_of_turns").alias("reason"))
    total = g.agg(F.count("*").alias("n")).where(F.col("n") != n_sessions).select(F.lit("size").alias("check"), F.lit("sessions").alias("key"), F.lit("other_number_of_sessions").alias("reason"))
    return odd.unionByName(total)
