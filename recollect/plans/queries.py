"""The registered queries, by the inventory's ids."""

from __future__ import annotations

from functools import reduce

from ..sources import files, published
from .retrieval import *  # noqa: F403
from .retrieval import K2, KF, KI, LEXICAL, CLUSTER_SAMPLES, CLUSTER_SEED, METHODS, MODES, ORACLE_SQL, QUERIES, SAMPLES, SEED, SUMMARY, TOP_K, CANON, CONFIG, F, MemoryConfig, S, SparkSession, DataFrame, W, uuid, ablation, analysis, audits, bootstrap_sql, bucketed, fingerprinted, shaken, broken_beliefs, broken_ranks, broken_states, broken_structured, checks, clean, concept_events, dialogs, as_initial, embed, encoded, events, fx, live_memory, mem, memory, metrics, provenance, query, ranks, ranks_of, runs, scored, scoring, settings, shared_dir, sizes, stats, tables, text_ranks, tops, unit_sql, violations_sql, weight_sql, written

FIRST = "list_sum(v) AS"


def path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def first3(v: str):
    """A vector as three of its components, and a sum that all of them are in, for comparing."""
    every = F.aggregate(F.transform(v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return [*(F.round(F.get(v, F.lit(k)), 9).alias(f"{v}_{k}") for k in range(3)), F.round(every, 6).alias(f"{v}_all")]


def first3_sql(v: str, name: str) -> str:
    return ", ".join(f"round({v}[{k + 1}], 9) {name}_{k}" for k in range(3)) + f", round(list_sum(list_transform({v}, lambda x, k: x * k)), 6) {name}_all"


# ---- A: sources and sinks

query("a1_corpus", "SELECT corpus_idx, len(vector) AS size, " + first3_sql("vector", "vector") + " FROM corpus")(lambda spark, sf: fx.corpus(spark, sf).select("corpus_idx", F.size("vector").cast("long").alias("size"), *first3("vector")))


@query("a2_sessions", f"SELECT session_id, turn, coalesce(query_text, '{tables.DEFAULT_TEXT}') query_text, target_index, {first3_sql('query_vector', 'query_vector')} FROM states")
def a2(spark, sf):
    p = path(spark, "sessions")
    tables.sessions_of_turns(fx.states(spark, sf)).write.parquet(p)
    return tables.turns_of_sessions(spark.read.parquet(p)).select("session_id", "turn", "query_text", "target_index", *first3("query_vector"))


@query("a3_beliefs", "SELECT session_id, feedback_turn, polarity, idx, trim(attribute) attribute, round(confidence, 6) confidence, CASE WHEN idx = 1 THEN 'colour' ELSE 'unknown' END fact_type FROM beliefs")
def a3(spark, sf):
    p = path(spark, "beliefs-json")
    tables.write_beliefs(fx.beliefs(spark, sf).withColumn("fact_type", F.when(F.col("idx") == 1, "colour")), p)
    return tables.read_beliefs(spark, p).select("session_id", "feedback_turn", "polarity", "idx", "attribute", F.round("confidence", 6).alias("confidence"), "fact_type")


@query("a4_structured", "SELECT session_id, feedback_turn, idx, negative_attribute, actionable, sem_type FROM structured")
def a4(spark, sf):
    p = path(spark, "structured-json")
    item = F.struct(F.col("session_id").alias("dialog_id"), F.col("feedback_turn").alias("turn"), F.col("idx").alias("negative_index"), "negative_attribute", F.col("actionable").alias("actionable_negative"), F.struct(F.lower("sem_type").alias("type")).alias("typing"))
    fx.structured(spark, sf).select(F.array(item).alias("items")).write.json(p)
    return tables.read_structured(spark, p).select("session_id", "feedback_turn", "idx", "negative_attribute", "actionable", "sem_type")


CONFIGS = """(SELECT session_id config_id, coalesce(CASE WHEN session_id % 3 <> 0 THEN (session_id % 7 - 1) / 10.0::DOUBLE END, 0.275::DOUBLE) negative_weight, 0.10::DOUBLE recency_decay, 0.15::DOUBLE override_boost, (session_id % 5)::DOUBLE max_concepts,
  CASE WHEN session_id % 4 = 1 THEN 1.5::DOUBLE ELSE 0.85::DOUBLE END semantic_merge_threshold, session_id % 2 = 0 semantic_merge, coalesce(CASE WHEN session_id % 4 <> 0 THEN session_id % 6 END, 1000) top_k FROM (SELECT DISTINCT session_id FROM states))"""


def configs(spark, sf) -> DataFrame:
    """A configuration for each session, some values left out, some bad."""
    p, i = path(spark, "configs"), F.col("session_id")
    memory_ = F.struct(
        F.when(i % 3 != 0, (i % 7 - 1) / F.lit(10.0)).alias("negative_weight"), (i % 5).alias("max_concepts"), F.when(i % 4 == 1, 1.5).alias("semantic_merge_threshold"), F.when(i % 2 == 0, F.lit(True)).alias("semantic_merge")
    )
    dialogs(spark, sf).select(i.alias("config_id"), memory_.alias("memory"), F.when(i % 4 != 0, i % 6).alias("top_k")).write.json(p)
    return tables.read_configs(spark, p)


query("a5_configs", f"SELECT * REPLACE (round(negative_weight, 6) AS negative_weight) FROM {CONFIGS}")(lambda spark, sf: configs(spark, sf).withColumn("negative_weight", F.round("negative_weight", 6)))


# lines with seeded faults: what is malformed is told, with its reason, and what lies beside it is kept


def seeded(lines: DataFrame, spark, what: str, faults: dict[int, str]) -> str:
    """Lines (value, k), changed by the expressions of their k, as a text file."""
    p, out = path(spark, what), F.col("value")
    for k, change in faults.items():
        out = F.when(F.col("k") == k, F.expr(change)).otherwise(out)
    lines.select(out.alias("value")).write.text(p)
    return p


def told(read, keys: list[str]) -> DataFrame:
    return read.faults.select(*keys, "reason").unionByName(read.rows.select(*keys, F.lit("kept").alias("reason")))


TORN = "substring(value, 1, length(value) div 2)"
DIALOGS = "(SELECT DISTINCT session_id FROM beliefs)"


@query(
    "a3b_malformed_beliefs",
    f"""SELECT NULL::BIGINT session_id, NULL::INT feedback_turn, NULL::VARCHAR polarity, NULL::INT idx, CASE session_id % 13 WHEN 0 THEN 'not_json' WHEN 2 THEN 'dialogs_not_a_list' ELSE 'not_an_object' END reason FROM {DIALOGS} WHERE session_id % 13 IN (0, 2, 7)
  UNION ALL SELECT session_id, NULL, NULL, NULL, 'dialog_id_not_a_whole_number' FROM {DIALOGS} WHERE session_id % 13 = 6
  UNION ALL SELECT DISTINCT session_id, feedback_turn, NULL, NULL, 'question_not_a_text' FROM beliefs WHERE session_id % 13 = 3
  UNION ALL SELECT session_id, feedback_turn, polarity, idx, CASE session_id % 13 WHEN 1 THEN 'confidence_not_a_number' WHEN 4 THEN 'attribute_not_a_text' WHEN 5 THEN 'confidence_out_of_range' ELSE 'kept' END FROM beliefs WHERE session_id % 13 NOT IN (0, 2, 3, 6, 7)""",
)
def a3b(spark, sf):
    p = path(spark, "beliefs-json")
    tables.write_beliefs(fx.beliefs(spark, sf), p)
    lines = spark.read.text(p).withColumn("k", F.get_json_object("value", "$.dialogs[0].dialog_id").cast("long") % 13)
    bad = {
        0: TORN, 1: r"regexp_replace(value, '\"confidence\":[0-9.]+', '\"confidence\":\"high\"')", 2: r"regexp_replace(value, '\"dialogs\":.*$', '\"dialogs\":null}')", 3: r"replace(value, '\"question\":\"\"', '\"question\":7')",
        4: r"regexp_replace(value, '\"attribute\":\"[^\"]*\"', '\"attribute\":5')", 5: r"regexp_replace(value, '\"confidence\":[0-9.]+', '\"confidence\":1.5')", 6: r"regexp_replace(value, '\"dialog_id\":([0-9]+)', '\"dialog_id\":\"$1\"')", 7: "'[1, 2]'",
    }
    return told(tables.strict.beliefs(spark, seeded(lines, spark, "beliefs-bad", bad)), ["session_id", "feedback_turn", "polarity", "idx"])


@query(
    "a4b_malformed_structured",
    """SELECT CASE WHEN k <> 0 THEN session_id END session_id, CASE WHEN k <> 0 THEN feedback_turn END feedback_turn, CASE WHEN k <> 0 THEN idx END idx,
  CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'dialog_id_not_a_whole_number' WHEN 2 THEN 'actionable_negative_not_a_flag' WHEN 3 THEN 'stands_twice' WHEN 4 THEN 'typing_not_an_object' ELSE 'kept' END reason
  FROM (SELECT *, (session_id + 2 * feedback_turn + idx) % 9 k FROM structured), range(2) r(n) WHERE n = 0 OR k = 3""",
)
def a4b(spark, sf):
    item = F.struct(F.col("session_id").alias("dialog_id"), F.col("feedback_turn").alias("turn"), F.col("idx").alias("negative_index"), "negative_attribute", F.col("actionable").alias("actionable_negative"), F.struct(F.lower("sem_type").alias("type")).alias("typing"))
    k = (F.col("session_id") + 2 * F.col("feedback_turn") + F.col("idx")) % 9
    lines = fx.structured(spark, sf).select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"), k.alias("k"))
    bad = {0: TORN, 1: r"regexp_replace(value, '\"dialog_id\":([0-9]+)', '\"dialog_id\":\"$1\"')", 2: r"regexp_replace(value, '\"actionable_negative\":[a-z]+,', '')", 4: r"regexp_replace(value, '\"typing\":[{][^}]*[}]', '\"typing\":\"global\"')"}
    return told(tables.strict.structured(spark, seeded(lines.unionByName(lines.where("k = 3")), spark, "structured-bad", bad)), ["session_id", "feedback_turn", "idx"])


@query(
    "a5b_malformed_configs",
    """SELECT CASE WHEN k <> 0 THEN config_id END config_id, CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'unknown_setting_momentum' WHEN 2 THEN 'top_k_not_a_whole_number' WHEN 3 THEN 'memory_not_an_object' WHEN 4 THEN 'memory.max_concepts_not_a_whole_number' ELSE 'kept' END reason
  FROM (SELECT DISTINCT session_id config_id, session_id % 7 k FROM states)""",
)
def a5b(spark, sf):
    memory_ = F.struct((F.col("session_id") % 5).alias("max_concepts"), (F.col("session_id") % 2 == 0).alias("semantic_merge"))
    lines = dialogs(spark, sf).select(F.to_json(F.struct(F.col("session_id").alias("config_id"), memory_.alias("memory"), F.lit(7).alias("top_k"))).alias("value"), (F.col("session_id") % 7).alias("k"))
    bad = {0: TORN, 1: r"replace(value, '\"memory\":{', '\"memory\":{\"momentum\":1,')", 2: r"replace(value, '\"top_k\":7', '\"top_k\":\"many\"')", 3: r"regexp_replace(value, '\"memory\":[{][^}]*[}]', '\"memory\":[1]')", 4: r"regexp_replace(value, '\"max_concepts\":[0-9]+', '\"max_concepts\":2.5')"}
    return told(tables.strict.configs(spark, seeded(lines, spark, "configs-bad", bad)), ["config_id"])


@query(
    "a11b_malformed_traces",
    """SELECT CASE WHEN k <> 0 THEN session_id END session_id, CASE WHEN k <> 0 THEN turn END turn,
  CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'session_id_not_a_whole_number' WHEN 2 THEN 'final_rank_not_a_whole_number' WHEN 3 THEN 'top_k_holds_no_whole_number' WHEN 4 THEN 'stands_twice' ELSE 'kept' END reason
  FROM (SELECT *, (session_id + turn) % 8 k FROM states), range(2) r(n) WHERE n = 0 OR k = 4""",
)
def a11b(spark, sf):
    one = F.to_json(F.struct("session_id", "turn", F.col("target_index").alias("final_rank"), F.array("target_index", F.lit(3)).alias("top_k"), F.lit(1).alias("mem_negative")))
    lines = fx.states(spark, sf).select(one.alias("value"), ((F.col("session_id") + F.col("turn")) % 8).alias("k"))
    bad = {0: TORN, 1: r"regexp_replace(value, '\"session_id\":([0-9]+)', '\"session_id\":\"$1\"')", 2: r"regexp_replace(value, '\"final_rank\":[0-9]+', '\"final_rank\":null')", 3: r"replace(value, ',3]', ',\"3\"]')"}
    return told(tables.strict.traces(spark, seeded(lines.unionByName(lines.where("k = 4")), spark, "traces-bad", bad)), ["session_id", "turn"])


@query("a6_rank_archive", "SELECT run_id, session_id, turn, rank FROM ranks")
def a6(spark, sf):
    p = path(spark, "ranks-old")
    r = ranks(spark, sf)
    r.where("run_id = 'h0'").withColumnRenamed("rank", "ranks_per_round").write.parquet(f"{p}/part=old")
    r.where("run_id <> 'h0'").write.parquet(f"{p}/part=new")
    return tables.read_ranks(spark, p).select("run_id", "session_id", "turn", "rank")


@query("a7_rank_sink", "SELECT session_id, turn, rank FROM ranks WHERE run_id = 'persistent'")
def a7(spark, sf):
    p = path(spark, "ranks-by-run")
    tables.write_ranks(ranks(spark, sf), p)
    return tables.read_ranks(spark, p).where("run_id = 'persistent'").select("session_id", "turn", "rank")


def with_targets(spark, sf) -> DataFrame:
    return ranks(spark, sf).join(fx.states(spark, sf).select("session_id", "turn", "target_index").hint("merge"), ["session_id", "turn"])


@query(
    "a7b_published_runs",
    f"SELECT step, run_id, (SELECT count(*) FROM ranks r WHERE r.run_id = s.run_id) states, round(final_recall, 6) final_recall, round(bri, 6) bri, true AS paired FROM ({SUMMARY}) s, (SELECT unnest(['first', 'torn', 'refused', 'second']) step) WHERE step = 'second' OR run_id = 'h0'",
)
def a7b(spark, sf):
    """A version; one that is written but never published; one that is refused; the next version. Readers see the first until the last."""
    p, all_, records = path(spark, "published"), with_targets(spark, sf), paired_runs(spark, sf).withColumn("evaluation_fp", F.col("run_id"))
    seen = []

    def look(step: str) -> None:
        r, m = published.read(spark, p, "ranks"), published.read(spark, p, "metrics")
        both = m.join(r.groupBy("run_id").agg(F.count("*").alias("states")).hint("merge"), "run_id").join(records.select("run_id", F.col("pairing_fp").alias("own")).hint("merge"), "run_id")
        seen.append(both.select(F.lit(step).alias("step"), "run_id", "states", "final_recall", "bri", (F.col("pairing_fp") == F.col("own")).alias("paired")))

    published.publish_runs(all_.where("run_id = 'h0'"), records, p)
    look("first")
    published.stage_runs(all_, records, p)
    look("torn")
    try:
        published.publish_runs(all_.withColumn("rank", F.when(F.col("run_id") == "h0", -1).otherwise(F.col("rank"))), records, p)
    except ValueError:
        look("refused")
    published.publish_runs(all_, records, p)
    look("second")
    return round_all(reduce(DataFrame.unionByName, seen))


@query("a8_upgrade", "SELECT run_id, session_id, turn, rank, 'rehydrated_from_declared_inputs' provenance_status FROM ranks")
def a8(spark, sf):
    p = path(spark, "ranks-legacy")
    ranks(spark, sf).withColumnRenamed("rank", "ranks_per_round").write.parquet(f"{p}-old")
    return tables.upgrade_ranks(spark, f"{p}-old", f"{p}-new").select("run_id", "session_id", "turn", "rank", "provenance_status")


@query("a9_csv", "SELECT run_id, turn, round(recall, 6) recall FROM per_turn")
def a9(spark, sf):
    p = path(spark, "csv")
    tables.write_csv(metrics.per_turn(ranks(spark, sf)).select("run_id", "turn", F.round("recall", 6).alias("recall")), p)
    return spark.read.schema("run_id string, turn int, recall double").csv(p, header=True)


@query("a10_report", "SELECT run_id, turn, round(cumulative, 6) cumulative FROM per_turn")
def a10(spark, sf):
    p = path(spark, "report")
    tables.write_report(metrics.per_turn(ranks(spark, sf)).select("run_id", "turn", F.round("cumulative", 6).alias("cumulative")), p)
    return spark.read.schema("run_id string, turn int, cumulative double").json(p)


@query("a11_traces", "SELECT r.session_id, r.turn, r.rank final_rank, s.negative mem_negative, (SELECT string_agg(corpus_idx, ',' ORDER BY position) FROM tops t WHERE t.run_id = 'persistent' AND t.session_id = r.session_id AND t.turn = r.turn) top_k FROM ranks r JOIN sizes s USING (session_id, turn) WHERE run_id = 'persistent'")
def a11(spark, sf):
    p = path(spark, "traces")
    lists = tops(spark, sf).where("run_id = 'persistent'").groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("position", "corpus_idx"))).alias("t")).select("session_id", "turn", F.col("t.corpus_idx").alias("top_k"))
    both = ranks(spark, sf).where("run_id = 'persistent'").join(sizes(spark, sf), ["session_id", "turn"]).join(lists, ["session_id", "turn"])
    both.select("session_id", "turn", F.col("rank").alias("final_rank"), "top_k", F.col("negative").cast("int").alias("mem_negative")).write.json(p)
    return tables.read_traces(spark, p).withColumn("top_k", F.array_join(F.col("top_k").cast("array<string>"), ","))


@query("a12_reencoded_sessions", f"SELECT s.session_id, s.turn, s.query_text, s.target_index, {first3_sql('c.vector', 'query_vector')} FROM states s JOIN corpus c ON c.corpus_idx = (length(s.query_text) * 131 + 7) % (SELECT count(*) FROM corpus)")
def a12(spark, sf):
    s = fx.states(spark, sf)
    v = encoded(spark, sf, s.select(F.col("query_text").alias("text")))
    return tables.turns_of_sessions(tables.reencode_sessions(s, v)).select("session_id", "turn", "query_text", "target_index", *first3("query_vector"))


query("a13_still_to_encode", "SELECT DISTINCT query_text AS text FROM states WHERE query_text NOT IN (SELECT query_text FROM states WHERE turn = 0)")(
    lambda spark, sf: tables.still_to_encode(fx.states(spark, sf).select(F.col("query_text").alias("text")), fx.states(spark, sf).where("turn = 0").select(F.col("query_text").alias("text")))
)


TEXTS0, TEXTS = "(SELECT count(DISTINCT query_text) FROM states WHERE turn = 0)", "(SELECT count(DISTINCT query_text) FROM states)"


@query("a13b_encoder_cache", f"SELECT unnest(['cold', 'warm', 'again', 'other_size']) run, unnest([{TEXTS0}, {TEXTS}, {TEXTS}, {TEXTS0}]) asked, unnest([{TEXTS0}, {TEXTS} - {TEXTS0}, 0, {TEXTS0}]) encoded, unnest([(SELECT sum(length(t)) FROM (SELECT DISTINCT query_text t FROM states WHERE turn = 0)), (SELECT sum(length(t)) FROM (SELECT DISTINCT query_text t FROM states)), (SELECT sum(length(t)) FROM (SELECT DISTINCT query_text t FROM states)), (SELECT sum(length(t)) FROM (SELECT DISTINCT query_text t FROM states WHERE turn = 0))])::DOUBLE total")
def a13b(spark, sf):
    """A cold cache; one that lacks some texts; one that has all; one of another dimension, which is ignored."""
    p, s = path(spark, "vectors"), fx.states(spark, sf).select("turn", F.col("query_text").alias("text"))
    out = []
    for run, rows, size in (("cold", s.where("turn = 0"), 3), ("warm", s, 3), ("again", s, 3), ("other_size", s.where("turn = 0"), 4)):
        before = published.latest(spark, p)
        v = written(published.vectors(rows, lambda texts, n=size: [[float(len(t)), *[0.5] * (n - 1)] for t in texts], "by length", size, p), "found")
        after = published.latest(spark, p)
        encoded = 0 if before is not None and after.id == before.id else after.rows["vectors"]
        out.append(v.agg(F.count("*").alias("asked"), F.lit(encoded).cast("long").alias("encoded"), F.sum(F.col("vector")[0]).alias("total")).select(F.lit(run).alias("run"), "*"))
    return reduce(DataFrame.unionByName, out)


@query("a14_archives", "SELECT run_id, count(*) AS n FROM ranks GROUP BY run_id")
def a14(spark, sf):
    p = path(spark, "archives")
    tables.write_ranks(ranks(spark, sf), f"{p}/deep/er")
    found = tables.find_archives(spark, p, f"{p}/deep").select(F.regexp_extract("path", "run_id=([a-z0-9]+)", 1).alias("run_id")).distinct()
    return found.join(tables.read_ranks(spark, f"{p}/deep/er"), "run_id").groupBy("run_id").agg(F.count("*").alias("n"))


query("a15_subset", "SELECT session_id, turn, target_index FROM states WHERE session_id % 3 = 0")(lambda spark, sf: tables.subset(fx.states(spark, sf), dialogs(spark, sf).where("session_id % 3 = 0")).select("session_id", "turn", "target_index"))
query("a16_named_runs", "SELECT 'x-' || run_id run_id, session_id, turn, rank FROM ranks")(lambda spark, sf: tables.named_runs({f"x-{m}": ranks(spark, sf).where(F.col("run_id") == m) for m in METHODS}).select("run_id", "session_id", "turn", "rank"))

# ---- B: checks

query("b1_beliefs", violations_sql("belief", "broken_beliefs", f"{KF} || ':' || polarity || ':' || idx", {"empty_attribute": "trim(attribute) = ''", "confidence_out_of_range": "NOT confidence BETWEEN 0 AND 1", "empty_fact_type": "session_id % 7 = 2"}))(
    lambda spark, sf: checks.beliefs(broken_beliefs(spark, sf).withColumn("fact_type", F.when(F.col("session_id") % 7 == 2, " ").otherwise("unknown")))
)
query("b2_bundles", violations_sql("bundle", "broken_beliefs", KF, {"unknown_polarity": "polarity NOT IN ('positive', 'negative')", "no_answer": "session_id % 6 = 5"}) + " UNION ALL SELECT 'bundle', session_id || ':' || (feedback_turn - 9), 'negative_turn' FROM broken_beliefs WHERE feedback_turn < 9 AND session_id % 31 = 3")(
    lambda spark, sf: checks.bundles(broken_beliefs(spark, sf).withColumns({"question": F.lit("q"), "answer": F.when(F.col("session_id") % 6 != 5, "a")})).unionByName(checks.bundles(fx.beliefs(spark, sf).where("session_id % 31 = 3").withColumn("feedback_turn", F.col("feedback_turn") - 9)))
)
query("b3_turns", violations_sql("turn", "broken_states", K2, {"nothing_to_encode": "query_vector IS NULL AND trim(query_text) = ''", "zero_norm": "query_vector IS NOT NULL AND sqrt(list_inner_product(query_vector, query_vector)) <= 1e-8"}))(lambda spark, sf: checks.turns(broken_states(spark, sf)))
query(
    "b4_sessions",
    violations_sql("session", "(SELECT session_id, min(turn) lo, max(turn) hi, count(*) n, min(target_index) t FROM broken_states GROUP BY ALL)", "session_id::VARCHAR", {"turns_not_contiguous": "lo <> 0 OR hi <> n - 1", "negative_target": "t < 0"}),
)(lambda spark, sf: checks.sessions(broken_states(spark, sf)))
BROKEN_CORPUS = "CASE WHEN corpus_idx % 100 = 7 THEN transform(vector, x -> x * 0) WHEN corpus_idx % 100 = 8 THEN slice(vector, 1, 3) WHEN corpus_idx % 100 = 9 THEN transform(vector, x -> double('NaN')) ELSE vector END"
query("b5_corpus", "SELECT 'corpus' AS \"check\", 'corpus' AS key, reason FROM (SELECT count(*) n, max(corpus_idx) m FROM corpus), (SELECT unnest(['fewer_rows_than_top_k', 'several_dimensions', 'not_finite', 'zero_norm']) reason) WHERE CASE reason WHEN 'fewer_rows_than_top_k' THEN n < 1000000 WHEN 'zero_norm' THEN m >= 7 WHEN 'several_dimensions' THEN m >= 8 ELSE m >= 9 END")(
    lambda spark, sf: checks.corpus(fx.corpus(spark, sf).withColumn("vector", F.expr(BROKEN_CORPUS)), 1_000_000)
)
query(
    "b6_queries",
    violations_sql("query", "broken_states", K2, {"missing": "query_vector IS NULL", "wrong_dimension": "len(query_vector) <> 64", "zero_norm": "query_vector IS NOT NULL AND sqrt(list_inner_product(query_vector, query_vector)) <= 1e-8"}),
)(lambda spark, sf: checks.queries(broken_states(spark, sf), 64))
query("b7_concepts", "SELECT DISTINCT 'concept' AS \"check\", attribute AS key, 'no_vector' reason FROM ev WHERE NOT (attribute LIKE 'C%')")(lambda spark, sf: checks.concepts(events(spark, sf), fx.vocabulary(spark, sf).where("text LIKE 'C%'"), 64))
query("b8_encoder_dimension", "SELECT DISTINCT 'encoder' AS \"check\", len(vector[1:3])::VARCHAR AS key, 'dimension_not_in_corpus' reason FROM vocab")(lambda spark, sf: checks.encoder_dimension(fx.vocabulary(spark, sf).withColumn("vector", F.slice("vector", 1, 3)), fx.corpus(spark, sf)))


def artifact(spark, sf, version: int, status: str, passed: bool | None) -> DataFrame:
    """A belief artifact of all dialogues as one row a dialogue, with the given header."""
    p = path(spark, "artifact")
    tables.write_beliefs(fx.beliefs(spark, sf), p)
    a = spark.read.schema(tables.BELIEFS_JSON).json(p)
    return a.withColumns({"schema_version": F.lit(version), "status": F.lit(status), "quality": F.struct(F.lit(passed).alias("passed"))})


HEADERS = "(SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 1 ELSE 2 END version, CASE WHEN session_id % 5 = 0 THEN 'running' ELSE 'complete' END status, session_id % 4 <> 0 passed FROM (SELECT DISTINCT session_id FROM beliefs))"
query("b9_header", violations_sql("header", HEADERS, "'artifact'", {"wrong_version": "version <> 2", "not_complete": "status <> 'complete'", "quality_not_passed": "NOT passed", "no_provenance": "session_id % 2 = 0"}))(
    lambda spark, sf: checks.header(
        artifact(spark, sf, 2, "complete", True).withColumn("i", F.col("dialogs")[0]["dialog_id"]).withColumns({
            "schema_version": F.when(F.col("i") % 3 == 0, 1).otherwise(2), "status": F.when(F.col("i") % 5 == 0, "running").otherwise("complete"), "quality": F.struct((F.col("i") % 4 != 0).alias("passed")),
            "provenance": F.when(F.col("i") % 2 != 0, F.create_map(F.lit("by"), F.lit("x"))),
        })
    )
)


@query("b10_file_order", "SELECT 'order' AS \"check\", 0 || ':' || t || ':' || polarity || ':' || idx AS key, reason FROM (SELECT session_id, feedback_turn, polarity, idx, dense_rank() OVER (PARTITION BY session_id ORDER BY feedback_turn) - 1 t FROM beliefs), (SELECT unnest(['dialog_id', 'turn']) reason) WHERE CASE reason WHEN 'turn' THEN feedback_turn <> t ELSE session_id <> 0 END")
def b10(spark, sf):
    return checks.file_order(tables.explode_beliefs(artifact(spark, sf, 2, "complete", True)))


query(
    "b11_conflicts_in_turn",
    "SELECT 'conflict_in_turn' AS \"check\", session_id || ':' || t || ':' || concept AS key, 'both_polarities' reason FROM (SELECT session_id, 0 t, " + CANON.format("attribute") + " concept FROM beliefs GROUP BY ALL HAVING count(DISTINCT polarity) > 1)",
)(lambda spark, sf: checks.conflicts_in_turn(fx.beliefs(spark, sf).withColumn("feedback_turn", F.lit(0))))
query(
    "b12_rank_matrix",
    violations_sql("ranks", "(SELECT *, max(n) OVER (PARTITION BY run_id) most FROM (SELECT run_id, turn, count(*) n, min(rank) least FROM broken_ranks GROUP BY ALL))", "run_id || ':' || turn", {"not_rectangular": "n <> most", "negative_rank": "least < 0"}),
)(lambda spark, sf: checks.rank_matrix(broken_ranks(spark, sf)))


query(
    "b13_configs",
    violations_sql("config", CONFIGS, "config_id::VARCHAR", {"negative_weight_below_0": "negative_weight < 0", "max_concepts_below_1": "max_concepts < 1", "top_k_below_1": "top_k < 1", "semantic_merge_threshold_out_of_range": "semantic_merge_threshold > 1"}),
)(lambda spark, sf: checks.configs(configs(spark, sf)))
query(
    "b14_conflicts_with_memory",
    f"SELECT 'conflict_with_memory' AS \"check\", p.session_id || ':' || p.feedback_turn || ':' || p.polarity || ':' || p.idx AS key, 'other_polarity_remembered' reason FROM beliefs p WHERE EXISTS (SELECT 1 FROM beliefs n WHERE n.session_id = p.session_id AND n.polarity <> p.polarity AND n.feedback_turn < p.feedback_turn AND {CANON.format('n.attribute')} = {CANON.format('p.attribute')})",
)(lambda spark, sf: checks.conflicts_with_memory(fx.beliefs(spark, sf)))


query(
    "b15_structured_matches",
    f"SELECT 'structured' AS \"check\", b.session_id || ':' || b.feedback_turn || ':' || b.idx AS key, CASE WHEN s.session_id IS NULL THEN 'no_record' ELSE 'other_text' END reason FROM beliefs b LEFT JOIN broken_structured s ON s.session_id = b.session_id AND s.feedback_turn = b.feedback_turn AND s.idx = b.idx WHERE b.polarity = 'negative' AND (s.session_id IS NULL OR {CANON.format('s.negative_attribute')} <> {CANON.format('b.attribute')})",
)(lambda spark, sf: checks.structured_matches(fx.beliefs(spark, sf), broken_structured(spark, sf)))
query("b16_structured_types", violations_sql("structured_type", "broken_structured", KI, {"actionable_missing": "actionable IS NULL", "unknown_type": "upper(trim(sem_type)) NOT IN ('EXISTENCE', 'ATTRIBUTE', 'RELATION', 'GLOBAL')"}))(lambda spark, sf: checks.structured_types(broken_structured(spark, sf)))
query("b16b_unique_items", f"SELECT 'structured_key' AS \"check\", {KI} AS key, 'stands_twice' reason FROM broken_structured GROUP BY session_id, feedback_turn, idx HAVING count(*) > 1")(lambda spark, sf: checks.unique_items(broken_structured(spark, sf)))
query("b17_coverage", "SELECT 'coverage' AS \"check\", session_id || ':' || turn AS key, 'no_bundle' reason FROM states s WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM beliefs b WHERE b.session_id = s.session_id AND b.feedback_turn + 1 = s.turn)")(lambda spark, sf: checks.coverage(fx.states(spark, sf), fx.beliefs(spark, sf)))
query("b18_targets", "SELECT DISTINCT 'target' AS \"check\", session_id::VARCHAR AS key, 'not_in_corpus' reason FROM broken_states WHERE target_index < 0")(lambda spark, sf: checks.targets(broken_states(spark, sf), fx.corpus(spark, sf)))
query("b19_expected_sizes", "SELECT 'size' AS \"check\", session_id::VARCHAR AS key, 'other_number_of_turns' reason FROM broken_states GROUP BY session_id HAVING count(*) <> 4 UNION ALL SELECT 'size', 'sessions', 'other_number_of_sessions'")(lambda spark, sf: checks.expected_sizes(broken_states(spark, sf), 2064, 4))

# ---- C: scalar functions, over the texts of the tables

query("c1_canonical", "SELECT conv_id, turn, " + CANON.format("coalesce(text, '')") + " AS text FROM conversations")(lambda spark, sf: spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", S.canonical(F.coalesce("text", F.lit(""))).alias("text")))
query("c2_lexical", "SELECT conv_id, turn, " + LEXICAL.format("text") + " AS text FROM conversations")(lambda spark, sf: spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", S.lexical(F.col("text")).alias("text")))
query("c3_density", "SELECT conv_id, CASE WHEN n <= 1 THEN '0-1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' ELSE '6+' END density FROM (SELECT conv_id, count(*) n FROM conversations GROUP BY ALL)")(
    lambda spark, sf: spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(S.density(F.count("*")).alias("density"))
)
query("c4_unit", f"SELECT corpus_idx, {first3_sql('u', 'u')} FROM (SELECT corpus_idx, {unit_sql('vector')} u FROM corpus)")(lambda spark, sf: fx.corpus(spark, sf).withColumn("u", S.unit(F.col("vector"))).select("corpus_idx", *first3("u")))
query("c5_dot", "SELECT s.session_id, s.turn, round(list_inner_product(s.query_vector, c.vector), 9) score FROM states s JOIN corpus c ON c.corpus_idx = s.target_index")(
    lambda spark, sf: fx.states(spark, sf).join(fx.corpus(spark, sf), F.col("target_index") == F.col("corpus_idx")).select("session_id", "turn", F.round(S.dot(F.col("query_vector"), F.col("vector")), 9).alias("score"))
)
query("c6_weights", " UNION ALL ".join(f"SELECT '{m}' AS mode, session_id, turn, concept, round({weight_sql(m)}, 9) weight FROM mem" for m in MODES))(
    lambda spark, sf: mem(spark, sf).select("session_id", "turn", "concept", F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), F.round(S.memory_weight(m, F.col("confidence"), F.col("age"), CONFIG.recency_decay), 9).alias("weight")) for m in MODES))))
)
query("c7_item_key", f"SELECT {KI} AS item FROM structured")(lambda spark, sf: fx.structured(spark, sf).select(S.item_key(F.col("session_id"), F.col("feedback_turn"), F.col("idx")).alias("item")))
query("c8_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")(lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha")))


def line_files(df: DataFrame, spark, what: str, *order: str) -> str:
    """A text file for each bucket, its lines (value) in order."""
    p = path(spark, what)
    df.repartition("bucket").sortWithinPartitions("bucket", *order).select("bucket", "value").write.partitionBy("bucket").text(p)
    return p


def bucket_of():
    return F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long").alias("bucket")


@query("c8b_file_digests", "SELECT session_id // 10 bucket, strlen(string_agg(session_id || ':' || turn || ':' || query_text || chr(10), '' ORDER BY session_id, turn)) AS length, sha256(string_agg(session_id || ':' || turn || ':' || query_text || chr(10), '' ORDER BY session_id, turn)) AS sha256 FROM states GROUP BY ALL")
def c8b(spark, sf):
    s = fx.states(spark, sf).select("session_id", "turn", F.expr("session_id div 10").alias("bucket"), F.concat_ws(":", "session_id", "turn", "query_text").alias("value"))
    return files.digests(spark, line_files(s, spark, "lines", "session_id", "turn"), pattern="part-*").select(bucket_of(), "length", "sha256")


query("c9_stable_hash", "SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS sha FROM documents")(lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", S.digest(F.col("doc_id"), F.col("lang")).alias("sha")))
query("c10_fractions", "SELECT s.session_id, count(b.polarity) total, coalesce(round(count(*) FILTER (b.polarity = 'negative') / nullif(count(b.polarity), 0), 9), 0) negative_fraction FROM (SELECT DISTINCT session_id FROM states) s LEFT JOIN beliefs b USING (session_id) GROUP BY ALL")(
    lambda spark, sf: dialogs(spark, sf).join(fx.beliefs(spark, sf), "session_id", "left").groupBy("session_id").agg(F.count("polarity").alias("total"), F.round(S.negative_fraction(F.count_if(F.col("polarity") == "negative"), F.count("polarity")), 9).alias("negative_fraction"))
)
query("c11_rank_gain", "SELECT b.session_id, b.turn, b.rank - c.rank gain FROM ranks b JOIN ranks c USING (session_id, turn) WHERE b.run_id = 'h0' AND c.run_id = 'persistent'")(lambda spark, sf: stats.paired(ranks(spark, sf), "h0", "persistent").select("session_id", "turn", S.rank_gain(F.col("b"), F.col("c")).alias("gain")))
query("c12_exclusion_text", "SELECT session_id, turn, text, has_memory FROM texts")(lambda spark, sf: memory.exclusion_texts(fx.states(spark, sf), mem(spark, sf)))
query("c13_hits", "SELECT run_id, session_id, turn, (rank < 10)::INT::DOUBLE hit FROM ranks")(lambda spark, sf: ranks(spark, sf).select("run_id", "session_id", "turn", S.hit(F.col("rank"), 10).alias("hit")))

# ---- D: memory, scoring, ranking

query("d1_bundle_at", "SELECT s.session_id, s.turn, b.polarity, b.idx, b.attribute, round(b.confidence, 6) confidence FROM states s LEFT JOIN beliefs b ON b.session_id = s.session_id AND b.feedback_turn + 1 = s.turn")(
    lambda spark, sf: memory.bundle_at(fx.states(spark, sf), fx.beliefs(spark, sf)).withColumn("confidence", F.round("confidence", 6))
)
query("d2_concept_vectors", f"SELECT session_id, turn, idx, {first3_sql('u', 'vector')} FROM (SELECT e.*, {unit_sql('v.vector')} u FROM ev e JOIN vocab v ON v.text = e.attribute)")(lambda spark, sf: embed.lookup(events(spark, sf), fx.vocabulary(spark, sf), "attribute").select("session_id", "turn", "idx", *first3("vector")))


@query("d3_first_seen", "SELECT attribute, row_number() OVER (ORDER BY min(session_id * 1000000 + turn * 1000 + idx)) - 1 AS place FROM ev GROUP BY attribute")
def d3(spark, sf):
    first = events(spark, sf).groupBy("attribute").agg(F.min(F.struct("session_id", "turn", "idx")).alias("first")).select(F.lit("all").alias("family"), "attribute", "first.*")
    return stats.in_order(first, "family", by=("session_id", "turn", "idx")).select("attribute", F.col("no").cast("long").alias("place"))


MEM = "session_id, turn, concept, surface, round(confidence, 6) confidence, created, updated"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("session_id", "turn", "concept", "surface", F.round("confidence", 6).alias("confidence"), "created", "updated")


query("d4_persistent_memory", f"SELECT {MEM} FROM mem")(lambda spark, sf: rounded(mem(spark, sf)))
query("d5_current_memory", f"SELECT {MEM} FROM memc")(lambda spark, sf: rounded(mem(spark, sf, memory.CURRENT)))
query("d6_capped_memory", f"SELECT {MEM} FROM capped")(lambda spark, sf: rounded(memory.capped_memory(fx.states(spark, sf), events(spark, sf), MemoryConfig(max_concepts=3))))
query("d6b_uncapped_fold", f"SELECT {MEM} FROM mem")(lambda spark, sf: rounded(memory.folded_memory(fx.states(spark, sf), events(spark, sf), None, CONFIG)))
query("d7_add_stats", "SELECT session_id, turn, count(*) FILTER (n = 1) added, count(*) FILTER (n > 1) updated, 0::BIGINT overridden, 0::BIGINT evicted FROM (SELECT *, row_number() OVER (PARTITION BY session_id, concept ORDER BY turn, idx) n FROM ev) GROUP BY ALL")(lambda spark, sf: memory.add_stats(events(spark, sf)))
query("d8_semantic_merge", f"SELECT {MEM} FROM merged")(lambda spark, sf: rounded(memory.folded_memory(fx.states(spark, sf), events(spark, sf), fx.vocabulary(spark, sf), MemoryConfig(semantic_merge=True, semantic_merge_threshold=0.2))))


def both_polarities(spark, sf, config: MemoryConfig = CONFIG) -> DataFrame:
    both = fx.beliefs(spark, sf).select("session_id", (F.col("feedback_turn") + 1).alias("turn"), "idx", F.trim("attribute").alias("attribute"), S.canonical(F.col("attribute")).alias("concept"), "confidence", "polarity")
    return memory.folded_memory(fx.states(spark, sf), both, None, config)


SMALL = MemoryConfig(max_concepts=3)
query("d7b_turn_stats", "SELECT DISTINCT session_id, turn, added::BIGINT added, changed::BIGINT updated, overridden::BIGINT overridden, evicted::BIGINT evicted FROM turned3")(lambda spark, sf: memory.turn_stats(both_polarities(spark, sf, SMALL)))
query("d9_override", "SELECT * EXCLUDE (matched) REPLACE (round(confidence, 6) AS confidence) FROM turned")(lambda spark, sf: both_polarities(spark, sf).drop("matched").withColumn("confidence", F.round("confidence", 6)))
query("d9b_override_log", """SELECT session_id, turn, n, x.concept, x."from", x."to" FROM (SELECT session_id, turn, unnest(matched) x, (generate_subscripts(matched, 1) - 1)::INT n FROM (SELECT DISTINCT session_id, turn, matched FROM turned))""")(lambda spark, sf: memory.override_log(both_polarities(spark, sf)))
query("d17b_diagnostics", "SELECT s.session_id, s.turn, count(m.concept) size, count(*) FILTER (m.polarity = 'positive') positive, count(*) FILTER (m.polarity = 'negative') negative, coalesce(sum(m.overrides), 0)::BIGINT overrides FROM states s LEFT JOIN turned m USING (session_id, turn) GROUP BY ALL")(lambda spark, sf: memory.diagnostics(fx.states(spark, sf), both_polarities(spark, sf)))
query("d10_weights", f"SELECT session_id, turn, concept, age, round({weight_sql('full')}, 9) weight FROM mem")(lambda spark, sf: memory.weighted(mem(spark, sf), "full", CONFIG.recency_decay).select("session_id", "turn", "concept", "age", F.round("weight", 9).alias("weight")))
query("d11_corrected", f"SELECT session_id, turn, {first3_sql('v', 'vector')} FROM qmem")(lambda spark, sf: memory.queries(fx.states(spark, sf), fx.beliefs(spark, sf), fx.vocabulary(spark, sf), CONFIG, "persistent").select("session_id", "turn", *first3("vector")))
for _id, _method in (("d12_h0_ranks", "h0"), ("d13_persistent_ranks", "persistent"), ("d13b_current_ranks", "current")):

    def _one(spark, sf, method=_method):
        q = memory.queries(fx.states(spark, sf), fx.beliefs(spark, sf), fx.vocabulary(spark, sf), CONFIG, method)
        return scoring.target_ranks(scoring.scores(q, fx.corpus(spark, sf), 0)).select("session_id", "turn", "rank")

    query(_id, f"SELECT session_id, turn, rank FROM ranks WHERE run_id = '{_method}'")(_one)
query("d14_native_ranks", "SELECT session_id, turn, rank FROM ranks WHERE run_id = 'h0'")(lambda spark, sf: scoring.native_ranks(memory.queries(fx.states(spark, sf), None, None, CONFIG, "h0"), fx.corpus(spark, sf)).select("session_id", "turn", "rank"))
query("d15_top_k", "SELECT run_id, session_id, turn, position, corpus_idx FROM tops")(lambda spark, sf: scoring.top_k(scored(spark, sf), TOP_K))


EVENTS = "array<struct<idx:int,concept:string,attribute:string,confidence:double>>"


def spoken(spark, sf) -> DataFrame:
    """Turns as a stream has them: each with its negatives."""
    ev = events(spark, sf).groupBy("session_id", "turn").agg(F.collect_list(F.struct("idx", "concept", "attribute", "confidence")).alias("negatives"))
    rows = fx.states(spark, sf).select("session_id", "turn").join(ev.hint("merge"), ["session_id", "turn"], "left")
    return rows.withColumn("negatives", F.coalesce(F.col("negatives").cast(EVENTS), F.array().cast(EVENTS)))


def streamed(spark, waves: list[DataFrame], config: MemoryConfig, initial: DataFrame | None = None) -> DataFrame:
    """Waves of turns, each in its own files; the stream goes on from its checkpoint after each."""
    p = path(spark, "live")
    for wave in waves:
        wave.write.mode("append").parquet(f"{p}/in")
        stream = spark.readStream.schema(wave.schema).parquet(f"{p}/in")
        q = live_memory(stream, config, initial=initial).writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{p}/out")


@query("d16_live_memory", f"SELECT {MEM} FROM mem")
def d16(spark, sf):
    """Turns arrive in three waves."""
    rows = spoken(spark, sf)
    return rounded(streamed(spark, [rows.where(w) for w in ("turn < 2", "turn BETWEEN 2 AND 3", "turn > 3")], CONFIG).where("NOT late"))


@query("d16b_live_from_batch", f"SELECT {MEM}, false late FROM mem WHERE turn > 2 UNION ALL SELECT session_id, turn, concept, attribute, round(confidence, 6), NULL, NULL, true FROM ev SEMI JOIN states USING (session_id, turn) WHERE turn = 2 AND session_id % 5 = 0 UNION ALL SELECT session_id, turn, NULL, NULL, NULL, NULL, NULL, true FROM states s WHERE turn = 2 AND session_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.session_id = s.session_id AND e.turn = s.turn)")
def d16b(spark, sf):
    """The stream begins from the batch memory after turn 2; some turns 2 come once more, and are refused."""
    rows, before = spoken(spark, sf), fx.states(spark, sf).where("turn <= 2")
    initial = written(as_initial(before, memory.folded_memory(before, events(spark, sf), None, CONFIG)), "initial")
    waves = [rows.where("turn = 3"), rows.where("turn > 3 OR turn = 2 AND session_id % 5 = 0")]
    out = streamed(spark, waves, CONFIG, initial)
    return out.select("session_id", "turn", "concept", "surface", F.round("confidence", 6).alias("confidence"), "created", "updated", "late")


query("d17_diagnostics", "SELECT session_id, turn, size, positive, negative, overrides FROM sizes")(sizes)
query("d18_text_persistent", "SELECT session_id, turn, rank FROM text_ranks WHERE run_id = 'text_persistent'")(lambda spark, sf: text_ranks(spark, sf).where("run_id = 'text_persistent'").select("session_id", "turn", "rank"))
query("d19_reencoded", "SELECT run_id, session_id, turn, rank FROM text_ranks WHERE run_id LIKE 'reencode%'")(lambda spark, sf: text_ranks(spark, sf).where("run_id LIKE 'reencode%'").select("run_id", "session_id", "turn", "rank"))
query("d20_ablation", "SELECT run_id, session_id, turn, rank FROM ablation")(lambda spark, sf: ablation(spark, sf))
query("d21_rank_table", "SELECT run_id, session_id, turn, rank FROM ranks")(lambda spark, sf: scoring.rank_table(ranks(spark, fx.Cut(sf)), fx.states(spark, fx.Cut(sf))))

# ---- E: metrics


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


query("e1_recall", "SELECT run_id, turn, round(recall, 6) recall FROM per_turn")(lambda spark, sf: round_all(metrics.per_turn(ranks(spark, sf)).drop("cumulative")))
query("e2_cumulative", "SELECT run_id, turn, round(cumulative, 6) cumulative FROM per_turn")(lambda spark, sf: round_all(metrics.per_turn(ranks(spark, sf)).drop("recall")))
query("e3_best", "SELECT run_id, session_id, turn, best FROM progress")(lambda spark, sf: metrics.progress(ranks(spark, sf)).select("run_id", "session_id", "turn", "best"))
query("e4_bri", "SELECT run_id, round(avg(trapezoid), 6) bri FROM progress GROUP BY run_id")(lambda spark, sf: round_all(metrics.summary(ranks(spark, sf)).select("run_id", "bri")))
query("e5_sizes", "SELECT run_id, count(DISTINCT session_id) num_dialogues, count(DISTINCT turn) num_rounds FROM ranks GROUP BY run_id")(lambda spark, sf: metrics.summary(ranks(spark, sf)).select("run_id", "num_dialogues", "num_rounds"))
query("e6_session_bri", "SELECT run_id, session_id, round(bri, 6) bri FROM bri")(lambda spark, sf: round_all(metrics.session_bri(ranks(spark, sf))))
ROUNDED_SUMMARY = f"SELECT run_id, round(average_feedback_recall, 6) average_feedback_recall, round(final_recall, 6) final_recall, round(final_cumulative, 6) final_cumulative, round(bri, 6) bri, num_dialogues, num_rounds FROM ({SUMMARY})"
query("e7_summary", ROUNDED_SUMMARY)(lambda spark, sf: round_all(metrics.summary(ranks(spark, sf))))

# ---- F: paired statistics


def paired_runs(spark, sf) -> DataFrame:
    """Records of the three runs, under the fingerprint of what they share."""
    return provenance.pairing_fingerprint(fx.states(spark, sf), fx.corpus(spark, sf)).select(F.explode(F.array(*map(F.lit, METHODS))).alias("run_id"), "pairing_fp")



DELTA = "round(delta, 6) delta, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high"
TURN_UNITS = "SELECT turn, session_id, d AS s, 1.0::DOUBLE AS c FROM pairs"
query("f1_recall_delta", f"SELECT turn, {DELTA} FROM ({bootstrap_sql(TURN_UNITS, 'turn', SAMPLES, SEED)})")(lambda spark, sf: round_all(stats.recall_delta(ranks(spark, sf), "h0", "persistent", 10, SAMPLES, SEED)))
BRI_UNITS = "SELECT 'all' AS metric, b.session_id, c.bri - b.bri AS s, 1.0::DOUBLE AS c FROM bri b JOIN bri c USING (session_id) WHERE b.run_id = 'h0' AND c.run_id = 'persistent'"
query("f2_bri_delta", f"SELECT metric, {DELTA} FROM ({bootstrap_sql(BRI_UNITS, 'metric', SAMPLES, SEED, 1.0)})")(lambda spark, sf: round_all(stats.bri_delta(ranks(spark, sf), "h0", "persistent", SAMPLES, SEED)))
MCNEMAR = """SELECT turn, lost, gained, lost + gained discordant, CASE WHEN lost + gained = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(lost, gained) + 1),
  lambda k: exp(lgamma(lost + gained + 1.0) - lgamma(k + 1.0) - lgamma(lost + gained - k + 1.0) - (lost + gained) * ln(2.0))))) END p
  FROM (SELECT turn, count(*) FILTER (b < 10 AND c >= 10) lost, count(*) FILTER (b >= 10 AND c < 10) gained FROM pairs GROUP BY turn)"""
query("f3_mcnemar", f"SELECT turn, lost, gained, discordant, round(p, 6) p FROM ({MCNEMAR})")(lambda spark, sf: round_all(stats.mcnemar(stats.paired(ranks(spark, sf), "h0", "persistent"))))
HOLM = f"SELECT turn, max(step) OVER (ORDER BY p, turn) p_holm FROM (SELECT turn, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, turn) + 1) * p) step FROM (SELECT turn, round(p, 9) p FROM ({MCNEMAR})) WHERE turn >= 1)"
query("f4_holm", f"SELECT turn, round(p_holm, 6) p_holm FROM ({HOLM})")(lambda spark, sf: round_all(stats.holm(stats.mcnemar(stats.paired(ranks(spark, sf), "h0", "persistent")).where("turn >= 1").withColumn("p", F.round("p", 9))).select("turn", "p_holm")))
query(
    "f5_compare",
    f"SELECT d.turn, {DELTA}, lost, gained, discordant, round(p, 6) p, round(p_holm, 6) p_holm, 'verified' pairing FROM ({bootstrap_sql(TURN_UNITS, 'turn', SAMPLES, SEED)}) d JOIN ({MCNEMAR}) m ON m.turn = d.turn LEFT JOIN ({HOLM}) h ON h.turn = d.turn",
)(lambda spark, sf: round_all(stats.compare(ranks(spark, sf), "h0", "persistent", 10, SAMPLES, SEED, paired_runs(spark, sf))))
LAST_UNITS = "SELECT 'own' AS final, session_id, arg_max(d, turn) AS s, 1.0::DOUBLE AS c FROM pairs GROUP BY session_id"
query("f6_final_delta", f"SELECT final, {DELTA} FROM ({bootstrap_sql(LAST_UNITS, 'final', CLUSTER_SAMPLES, CLUSTER_SEED)})")(
    lambda spark, sf: round_all(stats.final_delta(stats.paired(ranks(spark, sf), "h0", "persistent").withColumn("final", F.lit(metrics.OWN)), "final", 10, CLUSTER_SAMPLES, CLUSTER_SEED))
)
LONGEST_UNITS = "SELECT 'longest' AS final, session_id, d AS s, 1.0::DOUBLE AS c FROM pairs WHERE turn = (SELECT max(turn) FROM pairs)"
query("f6b_longest_delta", f"SELECT final, {DELTA} FROM ({bootstrap_sql(LONGEST_UNITS, 'final', CLUSTER_SAMPLES, CLUSTER_SEED)})")(
    lambda spark, sf: round_all(stats.final_delta(stats.paired(ranks(spark, sf), "h0", "persistent").withColumn("final", F.lit(metrics.LONGEST)), "final", 10, CLUSTER_SAMPLES, CLUSTER_SEED, metrics.LONGEST))
)
CLUSTER_UNITS = "SELECT 'all' AS \"group\", session_id, sum(d) AS s, count(*)::DOUBLE AS c FROM pairs JOIN clean USING (session_id, turn) GROUP BY session_id"
query("f7_cluster", f"SELECT \"group\", {DELTA} FROM ({bootstrap_sql(CLUSTER_UNITS, 'group', CLUSTER_SAMPLES, CLUSTER_SEED)})")(
    lambda spark, sf: round_all(stats.bootstrap(clean(spark, sf).join(stats.differences(stats.paired(ranks(spark, sf), "h0", "persistent")).hint("merge"), ["session_id", "turn"]).groupBy(F.lit("all").alias("group"), "session_id").agg(F.sum("d").alias("s"), F.count("*").cast("double").alias("c")), "group", CLUSTER_SAMPLES, CLUSTER_SEED))
)
query("f8_rank_differences", "SELECT count(*) compared, count(*) FILTER (b <> c) differing, coalesce(max(abs(b - c)), 0)::BIGINT max_difference, count(*) FILTER ((b < 10) <> (c < 10)) hit_changes FROM pairs")(lambda spark, sf: stats.rank_differences(ranks(spark, sf), "h0", "persistent"))

# ---- G: analyses

query(
    "g1_belief_stats",
    f"""SELECT polarity, sum(n)::BIGINT total, round(avg(n), 6) mean, median(n) AS median, max(n) most, count(*) FILTER (n > 0) with_any, count(*) FILTER (n = 0) with_none, round(avg(u), 6) mean_unique, round(coalesce(sum(sure) / nullif(sum(n), 0), 0), 6) sure_fraction
  FROM (SELECT s.session_id, p.polarity, count(b.idx) n, count(DISTINCT {LEXICAL.format('b.attribute')}) u, count(*) FILTER (b.confidence >= 0.7::DOUBLE) sure FROM (SELECT DISTINCT session_id FROM states) s CROSS JOIN (SELECT unnest(['positive', 'negative']) polarity) p
  LEFT JOIN beliefs b ON b.session_id = s.session_id AND b.polarity = p.polarity GROUP BY ALL) GROUP BY polarity""",
)(lambda spark, sf: round_all(analysis.belief_stats(dialogs(spark, sf), fx.beliefs(spark, sf))))
query("g2_beliefs_by_turn", "SELECT t::INT feedback_turn, p.polarity, count(b.idx) n FROM range(5) r(t) CROSS JOIN (SELECT unnest(['positive', 'negative']) polarity) p LEFT JOIN beliefs b ON b.feedback_turn = t AND b.polarity = p.polarity GROUP BY ALL")(lambda spark, sf: analysis.beliefs_by_turn(fx.beliefs(spark, sf), 5))
query("g3_top_attributes", f"SELECT * FROM (SELECT polarity, (row_number() OVER (PARTITION BY polarity ORDER BY count(*) DESC, min(session_id * 1000000 + feedback_turn * 1000 + idx)))::INT AS rank, {LEXICAL.format('attribute')} attribute, count(*) n FROM beliefs GROUP BY polarity, {LEXICAL.format('attribute')}) WHERE rank <= 30")(
    lambda spark, sf: analysis.top_attributes(fx.beliefs(spark, sf))
)
query("g4_contradictions", f"SELECT session_id, attribute, array_to_string(list_sort(list(DISTINCT t) FILTER (p = 'positive')), ',') positive_turns, array_to_string(list_sort(list(DISTINCT t) FILTER (p = 'negative')), ',') negative_turns FROM (SELECT session_id, {LEXICAL.format('attribute')} attribute, feedback_turn t, polarity p FROM beliefs) GROUP BY ALL HAVING count(DISTINCT p) = 2")(
    lambda spark, sf: analysis.contradictions(fx.beliefs(spark, sf)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("positive_turns", "negative_turns")})
)
DENSITY = f"""SELECT session_id, neg negatives, pos positives, u unique_negatives, CASE WHEN neg <= 1 THEN '0-1' WHEN neg <= 3 THEN '2-3' WHEN neg <= 5 THEN '4-5' ELSE '6+' END density, coalesce(neg / nullif(neg + pos, 0), 0) negative_fraction
  FROM (SELECT s.session_id, count(*) FILTER (b.polarity = 'negative') neg, count(*) FILTER (b.polarity = 'positive') pos, count(DISTINCT {LEXICAL.format('b.attribute')}) FILTER (b.polarity = 'negative') u FROM (SELECT DISTINCT session_id FROM states) s LEFT JOIN beliefs b USING (session_id) GROUP BY ALL)"""
query("g5_density", f"SELECT * REPLACE (round(negative_fraction, 6) AS negative_fraction) FROM ({DENSITY})")(lambda spark, sf: round_all(analysis.densities(dialogs(spark, sf), fx.beliefs(spark, sf))))
GAINS = "SELECT session_id, 100 * avg(d) FILTER (turn >= 1) average_gain, 100 * arg_max(d, turn) final_gain FROM pairs GROUP BY session_id"
query("g6_session_gains", f"SELECT session_id, round(average_gain, 6) average_gain, final_gain FROM ({GAINS})")(lambda spark, sf: round_all(analysis.session_gains(ranks(spark, sf), "h0", "persistent")))
query("g7_gains_by_turn", "SELECT b.turn, round(b.recall, 6) baseline, round(c.recall, 6) candidate, round(c.recall - b.recall, 6) gain FROM per_turn b JOIN per_turn c USING (turn) WHERE b.run_id = 'h0' AND c.run_id = 'persistent' AND b.turn >= 1")(lambda spark, sf: round_all(analysis.gains_by_turn(ranks(spark, sf), "h0", "persistent")))
query("g8_gains_by_density", f"SELECT density, count(*) sessions, round(avg(average_gain), 6) average_gain, round(avg(final_gain), 6) final_gain FROM ({GAINS}) JOIN ({DENSITY}) USING (session_id) GROUP BY density")(
    lambda spark, sf: round_all(analysis.gains_by_density(analysis.session_gains(ranks(spark, sf), "h0", "persistent"), analysis.densities(dialogs(spark, sf), fx.beliefs(spark, sf))))
)
query("g9_clean_states", "SELECT session_id, turn, memory_size, latest_age, oldest_age, array_to_string(concepts, ',') concepts FROM clean")(lambda spark, sf: clean(spark, sf).withColumn("concepts", F.array_join("concepts", ",")))
query(
    "g10_event_counters",
    """SELECT count(*) FILTER (kind = 1) negative_events, count(*) FILTER (kind = 1 AND actionable) actionable_events, count(*) FILTER (kind = 1 AND NOT actionable) other_events,
  (SELECT count(*) FROM (SELECT kind, lag(kind) OVER w was FROM told WHERE kind = 0 OR actionable WINDOW w AS (PARTITION BY session_id, concept ORDER BY turn, kind, idx)) WHERE kind = 0 AND was = 1) invalidations,
  (SELECT count(*) FROM (SELECT kind, lag(kind) OVER w was, sum(kind) OVER w n FROM told WHERE kind = 0 OR actionable WINDOW w AS (PARTITION BY session_id, concept ORDER BY turn, kind, idx)) WHERE kind = 1 AND was = 0 AND n > 1) reactivations FROM told""",
)(lambda spark, sf: analysis.event_counters(concept_events(spark, sf)))
query("g11_groups", 'SELECT g."group", count(c.session_id) states, count(DISTINCT c.session_id) dialogs FROM groups g LEFT JOIN grouped c USING ("group") GROUP BY ALL')(lambda spark, sf: analysis.group_sizes(clean(spark, sf)))
query(
    "g12_group_recalls",
    'SELECT g."group", count(DISTINCT (c.session_id, c.turn)) FILTER (c.session_id IS NOT NULL) states, count(DISTINCT c.session_id) dialogs, '
    + ", ".join(f"round(100 * avg((r.rank < 10)::INT) FILTER (r.run_id = '{m}'), 6) AS {m}" for m in METHODS)
    + ' FROM groups g LEFT JOIN grouped c USING ("group") LEFT JOIN ranks r USING (session_id, turn) GROUP BY ALL',
)(lambda spark, sf: round_all(analysis.group_recalls(clean(spark, sf), ranks(spark, sf))))
GROUP_UNITS = 'SELECT "group", session_id, sum(d) AS s, count(*)::DOUBLE AS c FROM grouped JOIN pairs USING (session_id, turn) GROUP BY ALL'
query("g12b_group_deltas", f'SELECT g."group", {DELTA} FROM groups g LEFT JOIN ({bootstrap_sql(GROUP_UNITS, "group", CLUSTER_SAMPLES, CLUSTER_SEED)}) USING ("group")')(lambda spark, sf: round_all(analysis.group_deltas(clean(spark, sf), ranks(spark, sf), "h0", "persistent", 10, CLUSTER_SAMPLES, CLUSTER_SEED)))
SETTING_LAST = "(SELECT setting, run_id, session_id, arg_max((rank < 10)::INT, turn) hit FROM settings GROUP BY ALL)"
query("g13_settings", "SELECT setting, " + ", ".join(f"round(100 * avg(hit) FILTER (run_id = '{m}'), 6) AS {m}" for m in METHODS) + f" FROM {SETTING_LAST} GROUP BY setting")(lambda spark, sf: round_all(analysis.by_setting(settings(spark, sf))))
SETTING_UNITS = "SELECT setting, session_id, arg_max((c.rank < 10)::INT::DOUBLE - (b.rank < 10)::INT::DOUBLE, b.turn) AS s, 1.0::DOUBLE AS c FROM settings b JOIN settings c USING (setting, session_id, turn) WHERE b.run_id = 'current' AND c.run_id = 'persistent' GROUP BY ALL"
query("g13b_setting_deltas", f"SELECT setting, {DELTA} FROM ({bootstrap_sql(SETTING_UNITS, 'setting', CLUSTER_SAMPLES, CLUSTER_SEED)})")(lambda spark, sf: round_all(analysis.setting_deltas(settings(spark, sf), "current", "persistent", 10, CLUSTER_SAMPLES, CLUSTER_SEED)))
query(
    "g13c_setting_summaries",
    """SELECT setting, run_id, round(average_feedback_recall, 6) average_feedback_recall, round(final_recall, 6) final_recall, round(final_cumulative, 6) final_cumulative, round(bri, 6) bri, num_dialogues, num_rounds FROM
  (SELECT setting, run_id, avg(r) FILTER (turn >= 1) average_feedback_recall, count(*) num_rounds FROM (SELECT setting, run_id, turn, 100 * avg(hit) r FROM progress JOIN settings USING (run_id, session_id, turn) GROUP BY ALL) GROUP BY ALL) JOIN
  (SELECT 's' || session_id % 4 setting, run_id, 100 * avg(hit) final_recall, 100 * avg(hit_so_far) final_cumulative, count(*) num_dialogues FROM at_last GROUP BY ALL) USING (setting, run_id) JOIN
  (SELECT 's' || session_id % 4 setting, run_id, avg(trapezoid) bri FROM progress GROUP BY ALL) USING (setting, run_id)""",
)(lambda spark, sf: round_all(metrics.summary(settings(spark, sf), by=("setting", "run_id"))))
query("g14_named_summary", ROUNDED_SUMMARY.replace("SELECT run_id, round", "SELECT 'host-' || run_id run_id, round", 1))(lambda spark, sf: round_all(metrics.summary(tables.named_runs({f"host-{m}": ranks(spark, sf).where(F.col("run_id") == m) for m in METHODS}))))
query(
    "g15_ablation_report",
    "SELECT a.run_id, round(100 * avg((a.rank < 10)::INT) FILTER (a.turn >= 1), 6) average_feedback_recall, count(*) FILTER (a.rank <> r.rank) differing, max(abs(a.rank - r.rank))::BIGINT max_difference FROM ablation a JOIN ranks r USING (session_id, turn) WHERE r.run_id = 'persistent' GROUP BY a.run_id",
)(
    lambda spark, sf: round_all(
        ablation(spark, sf).join(ranks_of(spark, sf, "persistent").select("session_id", "turn", F.col("rank").alias("frozen")), ["session_id", "turn"]).groupBy("run_id")
        .agg((100 * F.avg(F.when(F.col("turn") >= 1, S.hit(F.col("rank"), 10)))).alias("average_feedback_recall"), F.count_if(F.col("rank") != F.col("frozen")).alias("differing"), F.max(F.abs(F.col("rank") - F.col("frozen"))).alias("max_difference"))
    )
)
TEXT_UNITS = "SELECT t.run_id, t.session_id, arg_max((t.rank < 10)::INT::DOUBLE - (b.rank < 10)::INT::DOUBLE, t.turn) AS s, 1.0::DOUBLE AS c FROM text_ranks t JOIN text_ranks b ON b.run_id = 'reencode_h0' AND b.session_id = t.session_id AND b.turn = t.turn GROUP BY ALL"
query(
    "g16_text_report",
    f"""SELECT run_id, round(average_feedback_recall, 6) average_feedback_recall, round(final_recall, 6) final_recall, round(final_cumulative, 6) final_cumulative, round(bri, 6) bri, num_dialogues, num_rounds, {DELTA}, differing, hit_changes
  FROM ({SUMMARY.replace("at_last", "text_last").replace("progress", "text_progress").replace("per_turn", "text_per_turn")}) JOIN ({bootstrap_sql(TEXT_UNITS, 'run_id', CLUSTER_SAMPLES, CLUSTER_SEED)}) USING (run_id)
  JOIN (SELECT t.run_id, count(*) FILTER (t.rank <> h.rank) differing, count(*) FILTER ((t.rank < 10) <> (h.rank < 10)) hit_changes FROM text_ranks t JOIN ranks h USING (session_id, turn) WHERE h.run_id = 'h0' GROUP BY t.run_id) USING (run_id)""",
)(lambda spark, sf: round_all(analysis.text_report(text_ranks(spark, sf), ranks_of(spark, sf, "h0"), "reencode_h0", 10, CLUSTER_SAMPLES, CLUSTER_SEED)))


def patches(spark, sf) -> DataFrame:
    k = fx.structured(spark, sf).where("(session_id + idx) % 13 = 0 OR session_id % 29 = 0")
    return k.select("session_id", "feedback_turn", "idx", F.when((F.col("session_id") + F.col("idx")) % 13 == 0, "GLOBAL").alias("new_type"), (F.col("session_id") % 29 == 0).alias("dropped"))


PATCHED = "SELECT session_id, feedback_turn, idx, negative_attribute, actionable, CASE WHEN (session_id + idx) % 13 = 0 THEN 'GLOBAL' ELSE sem_type END sem_type FROM structured WHERE session_id % 29 <> 0"
query("g17_patched", PATCHED)(lambda spark, sf: analysis.finalized(fx.structured(spark, sf), patches(spark, sf)))
query("g17c_untyped", "SELECT session_id, feedback_turn, idx FROM structured WHERE actionable AND sem_type = 'GLOBAL' AND (session_id + idx) % 13 <> 0 AND session_id % 29 <> 0")(
    lambda spark, sf: analysis.untyped(analysis.patch(fx.structured(spark, sf).withColumn("sem_type", F.nullif("sem_type", F.lit("GLOBAL"))), patches(spark, sf)))
)
query("g17b_unmatched_patches", "SELECT session_id, feedback_turn, idx FROM structured WHERE session_id % 29 = 0")(lambda spark, sf: analysis.unmatched_patches(fx.structured(spark, sf).where("session_id % 29 <> 0"), patches(spark, sf)).select("session_id", "feedback_turn", "idx"))
query(
    "g18_manifest",
    f"SELECT 'kept_type' what, sem_type AS value, count(*) n FROM ({PATCHED}) GROUP BY ALL UNION ALL SELECT 'dropped_type', sem_type, count(*) FROM structured WHERE session_id % 29 = 0 GROUP BY ALL UNION ALL SELECT 'kept_actionable', actionable::VARCHAR, count(*) FROM ({PATCHED}) GROUP BY ALL",
)(lambda spark, sf: analysis.patch_manifest(fx.structured(spark, sf), patches(spark, sf)))

# ---- H: audits


def broken_traces(spark, sf) -> DataFrame:
    return ranks(spark, sf).where("NOT (run_id = 'current' AND session_id % 25 = 0 AND turn = 2)")


ARCHIVE = """SELECT 'archive' AS "check", run_id AS key, unnest(CASE bucket % 5 WHEN 1 THEN ['payload_pairing_differs'] WHEN 2 THEN ['invalid_pairing_fp', 'unknown_status', 'metadata_status_differs', 'metadata_pairing_differs', 'payload_pairing_differs']
    WHEN 3 THEN ['metadata_not_an_object'] WHEN 4 THEN CASE WHEN method <> 'h0' THEN ['no_model_revision'] ELSE [] END ELSE [] END) reason FROM run_rows UNION ALL
  SELECT 'archive', key, r FROM (SELECT run_id || '-' || session_id // 10 key, min(rank) least, count(*) n, count(DISTINCT session_id) * count(DISTINCT turn) full_ FROM broken_ranks GROUP BY ALL), (SELECT unnest(['negative_rank', 'not_rectangular']) r)
  WHERE CASE r WHEN 'negative_rank' THEN least < 0 ELSE n <> full_ END"""
query("h1_archives", ARCHIVE)(lambda spark, sf: audits.archives(runs(spark, sf), bucketed(broken_ranks(spark, sf))))
query("h2_archive_totals", f"SELECT (SELECT count(*) FROM run_rows) archives, count(DISTINCT key) failures FROM ({ARCHIVE})")(lambda spark, sf: audits.archive_totals(runs(spark, sf), audits.archives(runs(spark, sf), bucketed(broken_ranks(spark, sf)))))
query("h3_triplet_shape", violations_sql("shape", "(SELECT run_id, count(DISTINCT session_id) s, count(DISTINCT turn) t FROM ranks GROUP BY ALL)", "run_id", {"sessions": "s <> 2064", "turns": "t <> 4"}))(lambda spark, sf: audits.triplet_shape(ranks(spark, sf), list(METHODS), 2064, 4))
query(
    "h4_trace_keys",
    "SELECT 'trace_keys' AS \"check\", session_id || ':' || turn AS key, 'not_in_all_runs' reason FROM ranks WHERE session_id % 25 = 0 AND turn = 2 GROUP BY session_id, turn UNION ALL SELECT 'trace_keys', run_id, 'other_number_of_traces' FROM ranks WHERE NOT (run_id = 'current' AND session_id % 25 = 0 AND turn = 2) GROUP BY run_id HAVING count(*) <> 2000",
)(lambda spark, sf: audits.trace_keys(broken_traces(spark, sf), list(METHODS), 2000))
query("h5_first_turn", "SELECT 'first_turn' AS \"check\", session_id::VARCHAR AS key, 'runs_differ' reason FROM shaken WHERE turn = 0 GROUP BY session_id HAVING count(DISTINCT rank) > 1")(lambda spark, sf: audits.first_turn_equal(shaken(spark, sf)))
NO_OP = "SELECT '{0}' AS \"check\", r.session_id || ':' || r.turn AS key, 'rank_differs_from_h0' reason FROM {1} r JOIN {3} h USING (session_id, turn) JOIN sizes s USING (session_id, turn) WHERE r.run_id = '{2}' AND h.run_id = 'h0' AND s.negative = 0 AND r.rank <> h.rank"
query("h6_no_op", NO_OP.format("no_op_persistent", "shaken", "persistent", "shaken"))(lambda spark, sf: audits.no_op(shaken(spark, sf), sizes(spark, sf), "persistent"))
query("h6b_no_op_reencoded", NO_OP.format("no_op_reencode_h0", "text_ranks", "reencode_h0", "ranks"))(lambda spark, sf: audits.no_op(ranks_of(spark, sf, "h0").unionByName(text_ranks(spark, sf)), sizes(spark, sf), "reencode_h0"))
query("h7_no_op_lists", "SELECT 'no_op_list_persistent' AS \"check\", a.session_id || ':' || a.turn AS key, 'list_differs_from_h0' reason FROM tops a JOIN tops h USING (session_id, turn, position) JOIN sizes s USING (session_id, turn) WHERE a.run_id = 'persistent' AND h.run_id = 'h0' AND s.negative = 0 AND a.corpus_idx - (CASE WHEN position = 1 AND a.session_id % 4 = 1 THEN 1 ELSE 0 END) <> h.corpus_idx GROUP BY a.session_id, a.turn")(
    lambda spark, sf: audits.no_op_lists(tops(spark, sf).withColumn("corpus_idx", F.col("corpus_idx") - F.expr("run_id = 'persistent' AND position = 1 AND session_id % 4 = 1").cast("long")), sizes(spark, sf), "persistent")
)
query("h8_clean_guard", "SELECT 'clean_guard' AS \"check\", session_id || ':' || turn AS key, 'current_differs_from_h0' reason FROM clean JOIN shaken h USING (session_id, turn) JOIN shaken c USING (session_id, turn) WHERE h.run_id = 'h0' AND c.run_id = 'current' AND h.rank <> c.rank")(lambda spark, sf: audits.clean_guard(clean(spark, sf), shaken(spark, sf)))
SESSIONS = """SELECT count(*) sessions, min(t) least_turns, max(t) most_turns, min(d0) least_dimension, max(d1) most_dimension, sum(x)::BIGINT texts_missing, min(g) least_target, max(g) most_target, max(session_id) - min(session_id) + 1 = count(*) contiguous_ids
  FROM (SELECT session_id, count(*) t, min(target_index) g, min(len(query_vector)) d0, max(len(query_vector)) d1, count(*) FILTER (coalesce(query_text, '') = '') x FROM {0} GROUP BY ALL)"""
NO_TEXTS = "(SELECT * REPLACE (CASE WHEN session_id % 8 = 3 AND turn = 1 THEN '' ELSE query_text END AS query_text, CASE WHEN session_id % 8 = 5 AND turn = 0 THEN query_vector[1:7] ELSE query_vector END AS query_vector) FROM states)"
query("h9_session_summary", SESSIONS.format(NO_TEXTS))(
    lambda spark, sf: audits.session_summary(fx.states(spark, sf).withColumns({"query_text": F.when(F.expr("session_id % 8 = 3 AND turn = 1"), "").otherwise(F.col("query_text")), "query_vector": F.when(F.expr("session_id % 8 = 5 AND turn = 0"), F.slice("query_vector", 1, 7)).otherwise(F.col("query_vector"))}))
)
query("h10_corpus_summary", "SELECT count(*) AS rows, least(min(len(vector)), CASE WHEN max(corpus_idx) >= 8 THEN 3 ELSE 1000000 END) least_dimension, max(len(vector)) most_dimension, count(*) FILTER (corpus_idx % 100 = 9) not_finite FROM corpus")(
    lambda spark, sf: audits.corpus_summary(fx.corpus(spark, sf).withColumn("vector", F.expr(BROKEN_CORPUS))).withColumn("least_dimension", F.col("least_dimension").cast("long"))
)
query(
    "h11_belief_summary",
    """SELECT count(DISTINCT session_id) dialogs, count(*) FILTER (polarity = 'negative') negatives, count(*) FILTER (polarity = 'positive') positives, round(min(confidence), 6) least_confidence, round(max(confidence), 6) most_confidence,
  count(DISTINCT session_id) FILTER (session_id <> 0) dialog_mismatches, count(DISTINCT (session_id, feedback_turn)) FILTER (feedback_turn <> t) turn_mismatches FROM (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY feedback_turn) - 1 t FROM beliefs)""",
)(lambda spark, sf: round_all(audits.belief_summary(tables.explode_beliefs(artifact(spark, sf, 2, "complete", True)))))
OTHER_STATES = "(SELECT session_id, turn, target_index + (CASE WHEN session_id % 50 = 8 THEN 1 ELSE 0 END) target_index, CASE WHEN session_id % 10 = 3 THEN 'other' ELSE query_text END query_text FROM states WHERE NOT (session_id % 6 = 1 AND turn = 0))"
query(
    "h12_alignment",
    f"SELECT bool_and(a.session_id IS NOT NULL AND b.session_id IS NOT NULL) same_turns, bool_and(coalesce(a.target_index = b.target_index, true)) same_targets, bool_and(coalesce(a.query_text = b.query_text, true)) same_texts FROM states a FULL JOIN {OTHER_STATES} b ON a.session_id = b.session_id AND a.turn = b.turn",
)(
    lambda spark, sf: audits.alignment(
        fx.states(spark, sf),
        fx.states(spark, sf).where("NOT (session_id % 6 = 1 AND turn = 0)").withColumns({"query_text": F.when(F.col("session_id") % 10 == 3, "other").otherwise(F.col("query_text")), "target_index": F.col("target_index") + F.expr("session_id % 50 = 8").cast("long")}),
    )
)
query(
    "h13_lineage",
    f"""SELECT name, CASE name WHEN 'sessions' THEN a WHEN 'turns' THEN b WHEN 'targets_in_corpus' THEN c WHEN 'corpus_finite' THEN d WHEN 'contiguous_ids' THEN e ELSE a AND b AND c AND d AND e END passed FROM
  (SELECT sessions = 2064 a, least_turns = {fx.TURNS} AND most_turns = {fx.TURNS} b, most_target < (SELECT count(*) FROM corpus) c, (SELECT count(*) FILTER (len(list_filter(vector, lambda x: NOT isfinite(x))) > 0) = 0 FROM corpus) d, contiguous_ids e FROM ({SESSIONS.format("states")})),
  (SELECT unnest(['sessions', 'turns', 'targets_in_corpus', 'corpus_finite', 'contiguous_ids', 'overall']) AS name)""",
)(lambda spark, sf: audits.lineage(audits.session_summary(fx.states(spark, sf)), audits.corpus_summary(fx.corpus(spark, sf)), {"sessions": 2064, "turns": fx.TURNS}))
query("h14_corpus_checks", "SELECT max(corpus_idx) = count(*) - 1 AS numbered, count(DISTINCT corpus_idx) = count(*) AS \"unique\", count(*) FILTER (n <= 1e-8) zero, round(min(n), 6) least_norm, round(avg(n), 6) mean_norm, round(max(n), 6) most_norm FROM (SELECT corpus_idx, sqrt(list_inner_product(vector, vector)) n FROM corpus)")(lambda spark, sf: round_all(audits.corpus_checks(fx.corpus(spark, sf))))

# ---- I: provenance

query("i1_identity", "SELECT count(DISTINCT session_id) sessions, count(DISTINCT turn) turns, min(len(query_vector)) dimension, count(DISTINCT (session_id, target_index)) AS rows FROM states")(lambda spark, sf: provenance.identity(fx.states(spark, sf)).drop("digest"))


def same_sql(a: str, b: str) -> str:
    return f"((SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))) + (SELECT count(*) FROM (({b}) EXCEPT ALL ({a}))) = 0)"


_S, _C = "SELECT session_id, turn, target_index, query_vector FROM states", "SELECT corpus_idx, vector FROM corpus"
_OTHERS = {"again": (_S, _C), "other_corpus": (_S, _C + " WHERE corpus_idx <> 3"), "other_targets": (_S.replace("target_index", "target_index + 1"), _C), "other_order": (_S, _C + " WHERE corpus_idx % 2 = 1 UNION ALL " + _C + " WHERE corpus_idx % 2 = 0"), "copies": (_S, _C + " UNION ALL " + _C + " WHERE corpus_idx = 5")}


@query("i2_pairing", " UNION ALL ".join(f"SELECT '{k}' what, {same_sql(_S, s)} AND {same_sql(_C, c)} AS same" for k, (s, c) in _OTHERS.items()))
def i2(spark, sf):
    s, c = fx.states(spark, sf), fx.corpus(spark, sf)
    other = {
        "again": (s, c), "other_order": (s.repartition(5), c.where("corpus_idx % 2 = 1").unionByName(c.where("corpus_idx % 2 = 0"))), "other_corpus": (s, c.where("corpus_idx <> 3")), "copies": (s, c.unionByName(c.where("corpus_idx = 5"))),
        "other_targets": (s.withColumn("target_index", F.col("target_index") + 1), c),
    }
    found = [provenance.pairing_fingerprint(*x).select(F.lit(k).alias("what"), "pairing_fp") for k, x in other.items()]
    return provenance.beside(reduce(DataFrame.unionByName, found), provenance.pairing_fingerprint(s, c).withColumnRenamed("pairing_fp", "own")).select("what", (F.col("pairing_fp") == F.col("own")).alias("same"))


_QUOTED = "CASE WHEN method = 'h0' THEN 'null' ELSE '\"{0}\"' END"
query(
    "i3_evaluation",
    f"""SELECT run_id, pairing, sha256('{{"adapter":' || {_QUOTED.format("a")} || ',"method":"' || method || '","pairing":"' || pairing || '","revision":' || {_QUOTED.format("r1")} || ',"rho":"0.1"}}') AS evaluation FROM run_rows""",
)(lambda spark, sf: fingerprinted(spark, sf).select("run_id", "pairing", "evaluation"))


_MAYBE = "coalesce('\"' || {0} || '\"', 'null')"
query(
    "i3b_evaluation_of_files",
    f"""SELECT run_id, sha256('{{{{"adapter":' || {_QUOTED.format("a")} || ',"beliefs":' || {_MAYBE.format("b.sha")} || ',"config":"' || sha256('{{{{"rho":0.1}}}}' || chr(10)) || '","method":"' || method || '","pairing":"' || pairing || '","revision":' || CASE WHEN method = 'h0' THEN 'null' WHEN bucket % 2 = 0 THEN '"r1"' ELSE '"model-a"' END || '}}}}') AS evaluation
  FROM run_rows LEFT JOIN (SELECT session_id // 10 bucket, sha256(string_agg(session_id || ':' || feedback_turn || ':' || polarity || ':' || idx || ':' || attribute || chr(10), '' ORDER BY session_id, feedback_turn, polarity, idx)) sha FROM beliefs GROUP BY ALL) b USING (bucket)""".replace("{{", "{").replace("}}", "}"),
)(lambda spark, sf: evaluated(spark, sf))


def evaluated(spark, sf) -> DataFrame:
    """Evaluations by the digests of their belief and config files, and the revision that the adapter declares, or else its model."""
    b = fx.beliefs(spark, sf)
    lines = b.select("session_id", "feedback_turn", "polarity", "idx", F.expr("session_id div 10").alias("bucket"), F.concat_ws(":", "session_id", "feedback_turn", "polarity", "idx", "attribute").alias("value"))
    told = files.digests(spark, line_files(lines, spark, "belief-lines", "session_id", "feedback_turn", "polarity", "idx"), pattern="part-*").select(bucket_of(), F.col("sha256").alias("beliefs"))
    p = path(spark, "config")
    spark.range(1).select(F.lit('{"rho":0.1}').alias("value")).write.text(p)
    config = files.digests(spark, p, pattern="part-*").select(F.col("sha256").alias("config"))
    runs_ = provenance.beside(fingerprinted(spark, sf).join(told.hint("merge"), "bucket", "left"), config)
    revision = provenance.declared_revision(F.col("method"), F.when(F.col("bucket") % 2 == 0, "r1"), F.lit("model-a"))
    return runs_.select("run_id", provenance.evaluation_fingerprint(F.col("pairing"), F.col("method"), {"beliefs": F.col("beliefs"), "config": F.col("config")}, F.lit("a"), revision).alias("evaluation"))


def verified(spark, sf) -> DataFrame:
    """Each ten sessions' runs of other methods against h0's; sessions, turns and targets of some are moved."""
    targets = fx.states(spark, sf).select("session_id", "target_index").distinct()
    r = ranks(spark, sf).join(targets.hint("merge"), "session_id").where("NOT (run_id = 'current' AND (session_id % 40 = 20 OR session_id % 70 < 10 AND turn = 3))")
    r = bucketed(r.withColumn("target_index", F.col("target_index") + F.expr("run_id = 'persistent' AND session_id % 30 = 7").cast("long")))
    pairs = fx.states(spark, sf).select(F.expr("session_id div 10").alias("b")).distinct().select("b", F.explode(F.array(F.lit("current"), F.lit("persistent"))).alias("m"))
    return provenance.verify_pairings(runs(spark, sf), r, pairs.select(F.concat_ws("-", F.lit("h0"), "b").alias("baseline"), F.concat_ws("-", "m", "b").alias("candidate")))


VERIFIED = """(WITH rk AS (SELECT run_id || '-' || session_id // 10 run_id, session_id, turn, target_index + (CASE WHEN run_id = 'persistent' AND session_id % 30 = 7 THEN 1 ELSE 0 END) target_index FROM ranks JOIN (SELECT DISTINCT session_id, target_index FROM states) USING (session_id)
    WHERE NOT (run_id = 'current' AND (session_id % 40 = 20 OR session_id % 70 < 10 AND turn = 3))),
  ky AS (SELECT DISTINCT run_id, session_id, target_index FROM rk), sh AS (SELECT run_id, count(DISTINCT session_id) s, count(DISTINCT turn) t FROM rk GROUP BY ALL),
  fp AS (SELECT run_id, CASE WHEN bucket % 5 <> 2 THEN pairing END fp FROM run_rows),
  lo AS (SELECT b.bucket, b.run_id AS candidate, count(*) FILTER (x.session_id IS NULL OR y.session_id IS NULL) lone_ids, count(*) FILTER (x.target_index IS DISTINCT FROM y.target_index) lone
    FROM (SELECT * FROM run_rows WHERE method <> 'h0') b JOIN (SELECT DISTINCT session_id FROM states) e ON e.session_id // 10 = b.bucket
    LEFT JOIN ky x ON x.run_id = 'h0-' || b.bucket AND x.session_id = e.session_id LEFT JOIN ky y ON y.run_id = b.run_id AND y.session_id = e.session_id GROUP BY ALL)
  SELECT 'h0-' || lo.bucket AS baseline, candidate, array_to_string(list_filter([CASE WHEN a.s IS DISTINCT FROM c.s OR a.t IS DISTINCT FROM c.t THEN 'rank_shape_mismatch' END, CASE WHEN fa.fp IS NULL OR fc.fp IS NULL THEN 'missing_pairing_fingerprint' END,
    CASE WHEN fa.fp <> fc.fp THEN 'pairing_fingerprint_mismatch' END, CASE WHEN lone_ids > 0 THEN 'session_ids_mismatch' END, CASE WHEN lone > 0 THEN 'target_indices_mismatch' END], lambda x: x IS NOT NULL), ',') reasons
  FROM lo LEFT JOIN sh a ON a.run_id = 'h0-' || lo.bucket LEFT JOIN sh c ON c.run_id = candidate LEFT JOIN fp fa ON fa.run_id = 'h0-' || lo.bucket LEFT JOIN fp fc ON fc.run_id = candidate)"""
query("i4_verify_pairing", f"SELECT baseline, candidate, reasons = '' AS verified, reasons FROM {VERIFIED}")(lambda spark, sf: verified(spark, sf).withColumn("reasons", F.array_join("reasons", ",")))
query("i5_gate", f"SELECT baseline, candidate, CASE WHEN reasons = '' THEN 'verified' ELSE 'refused' END AS status, CASE WHEN reasons = '' THEN 'verified' ELSE 'legacy_unverified' END AS if_allowed FROM {VERIFIED}")(
    lambda spark, sf: provenance.statuses(provenance.statuses(verified(spark, sf), True).withColumnRenamed("status", "if_allowed")).select("baseline", "candidate", "status", "if_allowed")
)


# ---- J: encoders


@query("j1_embed", f"SELECT DISTINCT query_text AS text, length(query_text)::DOUBLE vector_0, 1.0::DOUBLE vector_1, 0.0::DOUBLE vector_2, length(query_text) + 2.0::DOUBLE vector_all FROM states")
def j1(spark, sf):
    return embed.embed(fx.states(spark, sf), lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts], "query_text").select("text", *first3("vector"))


# ---- the same over sessions of one length, as the reference's rank matrices are

CUT = [
    "a2_sessions", "a3_beliefs", "a6_rank_archive", "b1_beliefs", "b4_sessions", "b17_coverage", "d4_persistent_memory", "d5_current_memory", "d10_weights", "d11_corrected", "d12_h0_ranks", "d13_persistent_ranks", "d15_top_k",
    "d17_diagnostics", "d20_ablation", "e1_recall", "e2_cumulative", "e4_bri", "e7_summary", "f1_recall_delta", "f2_bri_delta", "f3_mcnemar", "f4_holm", "g1_belief_stats", "g4_contradictions", "g6_session_gains", "g9_clean_states",
    "g11_groups", "g12_group_recalls", "h6_no_op", "h8_clean_guard", "h9_session_summary",
]


def cut_sql(sql: str) -> str:
    for table, text in fx.CUT_SQL.items():
        sql = sql.replace(f"{table} AS ({fx.SQL[table]})", f"{table} AS ({text})")
    return sql


def cut(name: str) -> None:
    """Registers a query once more, on a Cut folder."""
    QUERIES[f"{name}_cut"] = lambda spark, sf: QUERIES[name](spark, fx.Cut(sf))
    ORACLE_SQL[f"{name}_cut"] = cut_sql(ORACLE_SQL[name])


for _name in CUT:
    cut(_name)
ORACLE_SQL["d21_rank_table"] = cut_sql(ORACLE_SQL["d21_rank_table"])
