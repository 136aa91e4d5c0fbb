"""Analyses of beliefs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import metrics, stats
from .intervals import stabbed

#: The groups of history-only states.
GROUPS = ["ALL_CLEAN_HISTORY_ONLY", "AGE_1", "AGE_2_3", "AGE_4_PLUS", "MEM_1", "MEM_2_3", "MEM_4_PLUS"]
POLARITIES = ["positive", "negative"]


def each(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def belief_stats(dialogs: DataFrame, beliefs: DataFrame, sure: float = 0.7) -> DataFrame:
    """A row for each polarity: totals, and mean, median and maximum by dialogue, counting dialogues without any."""
    own = beliefs.groupBy("session_id", "polarity").agg(F.count("*").alias("n"), F.count_distinct(S.lexical(F.col("attribute"))).alias("u"), F.count_if(F.col("confidence") >= sure).alias("sure"))
    both = each(dialogs.select("session_id"), "polarity", POLARITIES).join(own.hint("merge"), ["session_id", "polarity"], "left").fillna(0, ["n", "u", "sure"])
    return both.groupBy("polarity").agg(
        F.sum("n").alias("total"), F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") > 0).alias("with_any"),
        F.count_if(F.col("n") == 0).alias("with_none"), F.avg("u").alias("mean_unique"), F.coalesce(F.sum("sure") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("sure_fraction"),
    )


def beliefs_by_turn(beliefs: DataFrame, turns: int) -> DataFrame:
    grid = each(each(beliefs.sparkSession.range(1).select(), "feedback_turn", list(range(turns))), "polarity", POLARITIES)
    counts = beliefs.groupBy("feedback_turn", "polarity").agg(F.count("*").alias("n"))
    return grid.join(counts.hint("merge"), ["feedback_turn", "polarity"], "left").select("feedback_turn", "polarity", F.coalesce("n", F.lit(0)).alias("n"))


def top_attributes(beliefs: DataFrame, k: int = 30) -> DataFrame:
    """The most frequent attributes of each polarity, ties by first appearance."""
    place = F.struct("session_id", "feedback_turn", "idx")
    counts = beliefs.groupBy("polarity", S.lexical(F.col("attribute")).alias("attribute")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    rank = F.row_number().over(W.partitionBy("polarity").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("polarity", "rank", "attribute", "n")


def contradictions(beliefs: DataFrame) -> DataFrame:
    """Attributes that a dialogue has in both polarities, with the turns of each."""
    turns = lambda p: F.array_sort(F.collect_set(F.when(F.col("polarity") == p, F.col("feedback_turn"))))
    found = beliefs.groupBy("session_id", S.lexical(F.col("attribute")).alias("attribute")).agg(turns("positive").alias("positive_turns"), turns("negative").alias("negative_turns"))
    return found.where("size(positive_turns) > 0 AND size(negative_turns) > 0")


def densities(dialogs: DataFrame, beliefs: DataFrame) -> DataFrame:
    own = beliefs.groupBy("session_id").agg(F.count_if(F.col("polarity") == "negative").alias("negatives"), F.count_if(F.col("polarity") == "positive").alias("positives"), F.count_distinct(F.when(F.col("polarity") == "negative", S.lexical(F.col("attribute")))).alias("unique_negatives"))
    out = dialogs.select("session_id").join(own.hint("merge"), "session_id", "left").fillna(0, ["negatives", "positives", "unique_negatives"])
    return out.withColumn("density", S.density(F.col("negatives"))).withColumn("negative_fraction", S.negative_fraction(F.col("negatives"), F.col("negatives") + F.col("positives")))


def session_gains(ranks: DataFrame, baseline: str, candidate: str, k: int = 10) -> DataFrame:
    """The gain in recall of each session, in percent points: mean over feedback turns, and at the last turn."""
    d = stats.differences(stats.paired(ranks, baseline, candidate), k)
    return d.groupBy("session_id").agg((100 * F.avg(F.when(F.col("turn") >= 1, F.col("d")))).alias("average_gain"), (100 * F.max_by("d", "turn")).alias("final_gain"))


def gains_by_turn(ranks: DataFrame, baseline: str, candidate: str, k: int = 10) -> DataFrame:
    r = metrics.per_turn(ranks.where(F.col("run_id").isin(baseline, candidate)), k).where("turn >= 1")
    one = lambda run, name: r.where(F.col("run_id") == run).select("turn", F.col("recall").alias(name))
    return one(baseline, "baseline").join(one(candidate, "candidate").hint("merge"), "turn").withColumn("gain", F.col("candidate") - F.col("baseline"))


def gains_by_density(gains: DataFrame, density: DataFrame) -> DataFrame:
    return gains.join(density.select("session_id", "density").hint("merge"), "session_id").groupBy("density").agg(F.count("*").alias("sessions"), F.avg("average_gain").alias("average_gain"), F.avg("final_gain").alias("final_gain"))


def concept_events(beliefs: DataFrame, structured: DataFrame) -> DataFrame:
    """Positives (kind 0) and negatives (kind 1; actionable or not) by concept, at their retrieval turns."""
    flags = structured.select("session_id", "feedback_turn", "idx", "actionable", F.lit("negative").alias("polarity"))
    ev = beliefs.join(flags.hint("merge"), ["session_id", "feedback_turn", "idx", "polarity"], "left")
    return ev.select("session_id", (F.col("feedback_turn") + 1).alias("turn"), (F.col("polarity") == "negative").cast("int").alias("kind"), "idx", S.canonical(F.col("attribute")).alias("concept"), F.coalesce("actionable", F.lit(False)).alias("actionable"))


def clean_states(states: DataFrame, events: DataFrame) -> DataFrame:
    """States without a negative of their own but with active ones from before.

    A concept is active if the last of its positives and actionable negatives is a negative; within a turn positives come first.
    It is so from that negative's turn until the next that tells of it.
    """
    s = states.where("turn >= 1").select("session_id", "turn")
    quiet = s.join(events.where("kind = 1").select("session_id", "turn").distinct().hint("merge"), ["session_id", "turn"], "left_anti")
    by = W.partitionBy("session_id", "concept").orderBy("turn", "kind", "idx")
    told = events.where("kind = 0 OR actionable").select("session_id", "concept", "kind", F.col("turn").alias("at"), F.lead("turn").over(by).alias("next"))
    active = told.where("kind = 1 AND (next IS NULL OR next > at)").withColumn("until", F.col("next") - 1).drop("kind", "next")
    last = stabbed(quiet, active, "session_id", "turn", "at", "until")
    age = F.col("turn") - F.col("at")
    return last.groupBy("session_id", "turn").agg(F.count("*").alias("memory_size"), F.min(age).alias("latest_age"), F.max(age).alias("oldest_age"), F.array_sort(F.collect_set("concept")).alias("concepts"))


def event_counters(events: DataFrame) -> DataFrame:
    told = events.where("kind = 0 OR actionable")
    by = W.partitionBy("session_id", "concept").orderBy("turn", "kind", "idx")
    told = told.withColumn("was", F.lag("kind").over(by)).withColumn("negatives_before", F.sum("kind").over(by.rowsBetween(W.unboundedPreceding, -1)))
    moved = told.agg(F.count_if((F.col("kind") == 0) & (F.col("was") == 1)).alias("invalidations"), F.count_if((F.col("kind") == 1) & (F.col("was") == 0) & (F.col("negatives_before") > 0)).alias("reactivations"))
    counts = events.agg(F.count_if(F.col("kind") == 1).alias("negative_events"), F.count_if((F.col("kind") == 1) & F.col("actionable")).alias("actionable_events"), F.count_if((F.col("kind") == 1) & ~F.col("actionable")).alias("other_events"))
    # two rows of totals
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(moved.withColumn("one", F.lit(1))), "one").drop("one")


def grouped(clean: DataFrame) -> DataFrame:
    """clean with a row for each of its overlapping groups."""
    age, size = F.col("latest_age"), F.col("memory_size")
    inside: list[Column] = [F.lit(True), age == 1, age.between(2, 3), age >= 4, size == 1, size.between(2, 3), size >= 4]
    names = F.array_compact(F.array(*(F.when(c, F.lit(g)) for c, g in zip(inside, GROUPS, strict=True))))
    return clean.withColumn("group", F.explode(names))


def group_sizes(clean: DataFrame) -> DataFrame:
    names = each(clean.sparkSession.range(1).select(), "group", GROUPS)
    return names.join(grouped(clean).groupBy("group").agg(F.count("*").alias("states"), F.count_distinct("session_id").alias("dialogs")).hint("merge"), "group", "left").fillna(0)


def group_recalls(clean: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """Recall of each run on each group's states; empty groups stay, without a recall."""
    hits = grouped(clean).join(ranks.hint("merge"), ["session_id", "turn"]).groupBy("group").pivot("run_id", ["h0", "current", "persistent"]).agg(100 * F.avg(S.hit(F.col("rank"), k)))
    return group_sizes(clean).join(hits.hint("merge"), "group", "left")


def group_deltas(clean: DataFrame, ranks: DataFrame, baseline: str, candidate: str, k: int = 10, samples: int = 20_000, seed: int = 20260829) -> DataFrame:
    """The candidate's gain on each group's states, with an interval from resampled dialogues."""
    d = stats.differences(stats.paired(ranks, baseline, candidate), k)
    units = grouped(clean).join(d.hint("merge"), ["session_id", "turn"]).groupBy("group", "session_id").agg(F.sum("d").alias("s"), F.count("*").cast("double").alias("c"))
    names = each(clean.sparkSession.range(1).select(), "group", GROUPS)
    return names.join(stats.bootstrap(units, "group", samples, seed).hint("merge"), "group", "left")


def by_setting(ranks: DataFrame, k: int = 10, final: str = metrics.OWN) -> DataFrame:
    """ranks with a column setting: the final recall of each method in each setting, side by side; what is missing stays null."""
    last = metrics.at_last(ranks.withColumn("hit", S.hit(F.col("rank"), k)), ["setting", "run_id"], final, hit=F.col("hit"))
    return last.groupBy("setting").pivot("run_id", ["h0", "current", "persistent"]).agg(100 * F.avg("hit"))


def setting_deltas(ranks: DataFrame, baseline: str, candidate: str, k: int = 10, samples: int = 20_000, seed: int = 20260829, final: str = metrics.OWN) -> DataFrame:
    one = lambda run, name: ranks.where(F.col("run_id") == run).select("setting", "session_id", "turn", F.col("rank").alias(name))
    pairs = one(baseline, "b").join(one(candidate, "c").hint("merge"), ["setting", "session_id", "turn"])
    return stats.final_delta(pairs, "setting", k, samples, seed, final)


def text_report(ranks: DataFrame, host: DataFrame, baseline: str, k: int = 10, samples: int = 20_000, seed: int = 20260829, final: str = metrics.OWN) -> DataFrame:
    """A row for each text run: its summary, its final gain over the baseline run with an interval, and where its ranks differ from the host's."""
    text, own = ranks.select("run_id", "session_id", "turn", "rank"), host.select("session_id", "turn", F.col("rank").alias("h"))
    against = text.join(own.hint("merge"), ["session_id", "turn"]).groupBy("run_id").agg(F.count_if(F.col("rank") != F.col("h")).alias("differing"), F.count_if((F.col("rank") < k) != (F.col("h") < k)).alias("hit_changes"))
    base = text.where(F.col("run_id") == baseline).select("session_id", "turn", F.col("rank").alias("b"))
    gains = stats.final_delta(text.withColumnRenamed("rank", "c").join(base.hint("merge"), ["session_id", "turn"]), "run_id", k, samples, seed, final)
    return metrics.summary(text, k, final=final).join(gains.hint("merge"), "run_id").join(against.hint("merge"), "run_id")


def patch(structured: DataFrame, patches: DataFrame) -> DataFrame:
    """structured with types replaced, and rows dropped, as patches (session_id, feedback_turn, idx, new_type, dropped) say."""
    both = structured.join(patches.hint("merge"), ["session_id", "feedback_turn", "idx"], "left").where("NOT coalesce(dropped, false)")
    return both.withColumn("sem_type", F.coalesce("new_type", "sem_type")).select(structured.columns)


def untyped(structured: DataFrame) -> DataFrame:
    """(session_id, feedback_turn, idx) of actionable items without a type; after patching there should be none."""
    return structured.where("actionable AND sem_type IS NULL").select("session_id", "feedback_turn", "idx")


def finalized(structured: DataFrame, patches: DataFrame) -> DataFrame:
    """The patched items; raises if a patch matches none, or an actionable item is left without a type."""
    out = patch(structured, patches)
    for what, rows in (("patches without an item", unmatched_patches(structured, patches)), ("actionable items without a type", untyped(out))):
        if bad := rows.select("session_id", "feedback_turn", "idx").limit(5).collect():
            raise ValueError(f"{what}: {sorted(map(tuple, bad))}")
    return out


def unmatched_patches(structured: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches that would change nothing; there should be none."""
    return patches.join(structured.hint("merge"), ["session_id", "feedback_turn", "idx"], "left_anti")


def patch_manifest(structured: DataFrame, patches: DataFrame) -> DataFrame:
    """(what, value, n): rows kept by type, rows dropped by type, rows kept by actionability. One scan, in grouping sets."""
    both = structured.join(patches.hint("merge"), ["session_id", "feedback_turn", "idx"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))
    both = both.select("dropped", F.when(~F.col("dropped"), F.coalesce("new_type", "sem_type")).otherwise(F.col("sem_type")).alias("type"), F.col("actionable").cast("string").alias("actionable"))
    by = [[F.col("dropped"), F.col("type")], [F.col("dropped"), F.col("actionable")]]
    counts = both.groupingSets(by, "dropped", "type", "actionable").agg(F.grouping("type").alias("of_actionable"), F.count("*").alias("n"))
    what = F.when(F.col("of_actionable") == 0, F.when(F.col("dropped"), "dropped_type").otherwise("kept_type")).when(~F.col("dropped"), "kept_actionable")
    return counts.select(what.alias("what"), F.when(F.col("of_actionable") == 0, F.col("type")).otherwise(F.col("actionable")).alias("value"), "n").where("what IS NOT NULL")
