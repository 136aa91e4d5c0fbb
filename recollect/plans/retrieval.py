"""One query for each retrieval operator over the fixture tables, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..functions import scalars as S
from ..operators import analysis, audits, checks, embed, memory, metrics, provenance, scoring, stats
from ..sources import fixtures as fx
from ..sources import tables
from ..sources.tables import shared_dir, written
from ..streaming.live_memory import as_initial, live_memory

CONFIG = MemoryConfig()
TOP_K = 10
#: Samples and seeds of the paired and of the cluster bootstrap.
SAMPLES, SEED, CLUSTER_SAMPLES, CLUSTER_SEED = 10_000, 42, 20_000, 20260829
MODES = ("uniform", "confidence", "recency", "full")
METHODS = ("h0", "current", "persistent")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return add


# ---- tables that many queries start from


def _scored(spark: SparkSession, sf: str, k: int = TOP_K, methods: tuple[str, ...] = METHODS) -> DataFrame:
    s, b, v = fx.states(spark, sf), fx.beliefs(spark, sf), fx.vocabulary(spark, sf)
    q = reduce(DataFrame.unionByName, [memory.queries(s, b, v, CONFIG, m) for m in methods])
    return scoring.scores(q, fx.corpus(spark, sf), k)


scored = fx.once("scored", _scored)


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Of the scores with lists, if they are there. Ranks alone need no lists, which cost more."""
    found = fx.made("scored", spark, sf)
    return scoring.target_ranks(_scored(spark, sf, 0) if found is None else found)


ranks = fx.once("ranks", _ranks)
_alone = {m: fx.once(f"ranks-{m}", lambda spark, sf, m=m: scoring.target_ranks(_scored(spark, sf, 0, (m,)))) for m in METHODS}


def ranks_of(spark: SparkSession, sf: str, method: str) -> DataFrame:
    """The ranks of one run, which is scored alone, unless those of all are there."""
    all_there = any(fx.made(name, spark, sf) is not None for name in ("ranks", "scored"))
    return ranks(spark, sf).where(F.col("run_id") == method) if all_there else _alone[method](spark, sf)


tops = fx.once("tops", lambda spark, sf: scoring.top_k(scored(spark, sf), TOP_K))
ablation = fx.once("ablation", lambda spark, sf: scoring.target_ranks(scoring.scores(memory.ablation_queries(fx.states(spark, sf), fx.beliefs(spark, sf), fx.vocabulary(spark, sf), CONFIG, MODES), fx.corpus(spark, sf), 0)))


def dialogs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.states(spark, sf).select("session_id").distinct()


def events(spark: SparkSession, sf: str) -> DataFrame:
    return memory.negative_events(fx.beliefs(spark, sf))


def mem(spark: SparkSession, sf: str, kind: str = memory.PERSISTENT) -> DataFrame:
    return memory.memory(fx.states(spark, sf), events(spark, sf), kind)


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return memory.diagnostics(fx.states(spark, sf), mem(spark, sf))


def concept_events(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.concept_events(fx.beliefs(spark, sf), fx.structured(spark, sf))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.clean_states(fx.states(spark, sf), concept_events(spark, sf))


def encoded(spark: SparkSession, sf: str, texts: DataFrame) -> DataFrame:
    """Stands for an encoder: each text gets the vector of a corpus row by its length."""
    n = fx.corpus(spark, sf).count()
    at = (F.char_length("text").cast("long") * 131 + 7) % n
    return texts.select("text").distinct().withColumn("corpus_idx", at).join(fx.corpus(spark, sf).hint("merge"), "corpus_idx").select("text", "vector")


def _text_ranks(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.states(spark, sf)
    base = s.select("session_id", "turn", F.trim("query_text").alias("text"), F.lit(False).alias("has_memory"))
    told = memory.exclusion_texts(s, mem(spark, sf))
    v = encoded(spark, sf, base.select("text").unionByName(told.select("text")))
    runs = {"text_persistent": memory.text_queries(s, told, v), "reencode_h0": memory.text_queries(s, base, v, False), "reencode_persistent": memory.text_queries(s, told, v, False)}
    return scoring.target_ranks(scoring.scores(tables.named_runs(runs), fx.corpus(spark, sf), 0))


text_ranks = fx.once("text-ranks", _text_ranks)


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Four settings of the matrix: disjoint parts of the sessions."""
    return ranks(spark, sf).withColumn("setting", F.concat(F.lit("s"), F.col("session_id") % 4))


def broken_beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Beliefs with seeded faults."""
    b = fx.beliefs(spark, sf)
    b = b.withColumn("confidence", F.when(F.col("session_id") % 17 == 0, F.lit(1.5)).otherwise(F.col("confidence")))
    b = b.withColumn("attribute", F.when(F.col("session_id") % 19 == 0, F.lit("  ")).otherwise(F.col("attribute")))
    return b.withColumn("polarity", F.when(F.col("session_id") % 23 == 0, F.lit("neutral")).otherwise(F.col("polarity")))


def broken_states(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.states(spark, sf).where("NOT (session_id % 7 = 0 AND turn = 1)")
    zero = F.transform("query_vector", lambda x: x * 0)
    short = F.slice("query_vector", 1, 3)
    return s.withColumns({
        "query_vector": F.when(F.col("session_id") % 11 == 0, zero).when(F.col("session_id") % 13 == 0, short).when(F.col("session_id") % 5 == 0, F.lit(None)).otherwise(F.col("query_vector")),
        "query_text": F.when(F.col("session_id") % 10 == 0, F.lit(" ")).otherwise(F.col("query_text")),
        "target_index": F.when(F.col("session_id") % 9 == 0, F.lit(-1).cast("long")).otherwise(F.col("target_index")),
    })


def broken_structured(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.structured(spark, sf)
    t = t.withColumn("negative_attribute", F.when(F.col("session_id") % 6 == 0, F.lit("other")).otherwise(F.col("negative_attribute"))).where("session_id % 8 <> 0")
    t = t.withColumn("sem_type", F.when(F.col("session_id") % 10 == 1, F.lit("unheard of")).otherwise(F.col("sem_type"))).withColumn("actionable", F.when(F.col("session_id") % 12 != 1, F.col("actionable")))
    return t.unionByName(t.where("session_id % 9 = 1"))


def broken_ranks(spark: SparkSession, sf: str) -> DataFrame:
    r = ranks(spark, sf).where("NOT (run_id = 'current' AND turn = 2 AND session_id % 4 = 0)")
    return r.withColumn("rank", F.when((F.col("run_id") == "h0") & (F.col("session_id") % 30 == 1), F.lit(-1).cast("long")).otherwise(F.col("rank")))


BUCKET = "session_id div 10"


def bucketed(ranks_: DataFrame) -> DataFrame:
    """ranks of many runs: one for each method and ten sessions."""
    return ranks_.withColumn("run_id", F.concat_ws("-", "run_id", F.expr(BUCKET)))


def fingerprinted(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, bucket, method, pairing, evaluation): these runs' fingerprints, from their sessions and targets."""
    own = fx.states(spark, sf).select("session_id", "target_index").distinct().groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("session_id") * 31 + F.col("target_index")).alias("t"))
    own = own.select("bucket", F.sha2(F.concat_ws(":", "bucket", "n", "t"), 256).alias("pairing"), F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    evaluation = provenance.evaluation_fingerprint(F.col("pairing"), F.col("method"), {"rho": F.lit("0.1")}, F.lit("a"), F.lit("r1"))
    return own.select(F.concat_ws("-", "method", "bucket").alias("run_id"), "bucket", "method", "pairing", evaluation.alias("evaluation"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Records of these runs, with a fault by bucket: 1 another pairing in the payload, 2 no fingerprint and an unknown status, 3 no metadata, 4 no revision."""
    fault, one = F.col("bucket") % 5, fingerprinted(spark, sf)
    status = "emitted_by_evaluator"
    payload = F.struct(F.when(fault == 1, "other").otherwise(F.col("pairing")).alias("pairing_fingerprint"))
    meta = F.to_json(F.struct(F.lit(status).alias("provenance_status"), F.col("pairing").alias("pairing_fingerprint"), F.col("evaluation").alias("evaluation_fingerprint"), "method", F.struct("bucket").alias("pairing_payload"), payload.alias("evaluation_payload"), F.when(fault != 4, "r1").alias("model_revision")))
    return one.select(
        "run_id", F.when(fault == 2, "").otherwise(F.col("pairing")).alias("pairing_fp"), F.col("evaluation").alias("evaluation_fp"), F.when(fault == 2, "made_up").otherwise(status).alias("status"),
        F.when(fault == 3, "not json").otherwise(meta).alias("metadata_json"),
    )


def shaken(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks that break what must hold: a first turn, a state without memory, a history-only state."""
    hit = F.expr("(run_id = 'current' AND (turn = 0 AND session_id % 9 = 4 OR turn > 0 AND session_id % 3 = 0)) OR (run_id = 'persistent' AND (session_id + turn) % 5 = 0)")
    return ranks(spark, sf).withColumn("rank", F.col("rank") + hit.cast("long"))


# ---- the same tables in SQL


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


CANON = r"trim(regexp_replace(lower({0}), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
LEXICAL = r"regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')"


def corrected_sql(mem_: str, key: str = "session_id, turn", states: str = "states") -> tuple[str, str]:
    agg = f"""SELECT {key}, list(x ORDER BY pos) a FROM (SELECT {key}, pos, sum(weight * x) x FROM (
  SELECT {key}, weight, unnest({unit_sql("v.vector")}) x, unnest(range(1, len(v.vector) + 1)) pos FROM {mem_} m JOIN vocab v ON v.text = m.surface) GROUP BY ALL) GROUP BY ALL"""
    columns, moved = "s.*", f"list_transform(range(1, len(uq) + 1), lambda k: uq[k] - {CONFIG.negative_weight}::DOUBLE * ua[k])"
    out = f"""SELECT * EXCLUDE (z), {unit_sql("z")} v FROM (SELECT * EXCLUDE (uq, ua), {moved} z FROM (
  SELECT {columns}, {unit_sql("s.query_vector")} uq, {unit_sql("g.a")} ua FROM {states} s JOIN agg_{mem_} g USING ({key}) WHERE list_inner_product(g.a, g.a) > 0))
  UNION ALL SELECT {columns}, {unit_sql("s.query_vector")} v FROM {states} s WHERE ({key}) NOT IN (SELECT ({key}) FROM agg_{mem_} WHERE list_inner_product(a, a) > 0)"""
    return agg, out


def weight_sql(mode: str) -> str:
    recency = f"(1.0::DOUBLE / (1.0::DOUBLE + {CONFIG.recency_decay}::DOUBLE * greatest(0, age)))"
    return {"uniform": "1.0::DOUBLE", "confidence": "confidence", "recency": recency, "full": f"confidence * {recency}"}[mode]


def memory_sql(condition: str) -> str:
    return f"""SELECT s.session_id, s.turn, e.concept, arg_max(e.attribute, e.turn * 1000 + e.idx) surface, max(e.confidence) confidence, min(e.turn) created, max(e.turn) updated,
  s.turn - max(e.turn) age, min(e.turn * 1000 + e.idx) ord FROM states s JOIN ev e ON e.session_id = s.session_id AND e.turn {condition} s.turn GROUP BY s.session_id, s.turn, e.concept"""


def scored_sql(queries: str) -> str:
    return f"SELECT q.run_id, q.session_id, q.turn, q.target_index, c.corpus_idx, round(list_inner_product(q.v, c.v) * 1e9)::BIGINT s FROM {queries} q, cn c"


def ranks_sql(scored_: str) -> str:
    return f"""SELECT run_id, session_id, turn, (count(*) FILTER (s > own AND corpus_idx <> target_index) + count(*) FILTER (s = own AND corpus_idx < target_index))::BIGINT AS rank
  FROM (SELECT *, max(s) FILTER (corpus_idx = target_index) OVER (PARTITION BY run_id, session_id, turn) own FROM {scored_}) GROUP BY ALL"""


def encoded_sql(texts: str) -> str:
    return f"SELECT t.text, c.vector FROM (SELECT DISTINCT text FROM {texts}) t JOIN corpus c ON c.corpus_idx = (length(t.text) * 131 + 7) % (SELECT count(*) FROM corpus)"


def fold_sql(name: str, events: str, cap: int, threshold: float | None = None) -> dict[str, str]:
    """Tables of an ordered fold over (session_id, turn, idx, polarity, concept, surface, confidence, vector) events: its memory after each turn of a state is `name`."""
    entry = "STRUCT(concept VARCHAR, \"name\" VARCHAR, surface VARCHAR, polarity VARCHAR, confidence DOUBLE, created INT, updated INT, overrides INT, vector DOUBLE[])"
    near = "0" if threshold is None else f"(CASE WHEN list_max(list_transform(entries, lambda x: list_inner_product(x.vector, vector))) >= {threshold} THEN -list_max(list_transform(entries, lambda x, i: {{'a': list_inner_product(x.vector, vector), 'b': -i}})).b ELSE 0 END)"
    place = f"coalesce(nullif(coalesce(list_position(list_transform(entries, lambda x: x.concept), concept), 0), 0), {near}, 0)"
    stronger = f"greatest(old.confidence, confidence) + CASE WHEN old.polarity <> polarity THEN {CONFIG.override_boost} ELSE 0 END"
    fresh = f"struct_pack(concept := concept, \"name\" := surface, surface := surface, polarity := polarity, confidence := confidence, created := turn, updated := turn, overrides := 0::INT, vector := vector)::{entry}"
    changed = f"struct_pack(concept := old.concept, \"name\" := old.name, surface := surface, polarity := polarity, confidence := CASE WHEN old.polarity <> polarity THEN least(1.0, {stronger}) ELSE {stronger} END, created := old.created, updated := turn, overrides := old.overrides + (old.polarity <> polarity)::INT, vector := vector)::{entry}"
    capped = f"list_filter(entries, lambda x, i: len(list_filter(entries, lambda y, j: y.updated > x.updated OR (y.updated = x.updated AND j > i))) < {cap})"
    return {
        f"{name}_steps": f"""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, ends, polarity DESC, idx) n FROM (
  SELECT e.session_id, e.turn, false ends, e.polarity, e.idx, e.concept, e.surface, e.confidence, e.vector FROM ({events}) e SEMI JOIN states s ON s.session_id = e.session_id AND s.turn = e.turn
  UNION ALL SELECT session_id, turn, true, NULL, NULL, NULL, NULL, NULL, NULL FROM states)""",
        f"{name}_fold": f"""SELECT session_id, 0::BIGINT n, 0 turn, true ends, []::{entry}[] entries, 0 added, 0 changed, 0 overridden, 0 evicted, []::STRUCT(concept VARCHAR, "from" VARCHAR, "to" VARCHAR)[] matched FROM (SELECT DISTINCT session_id FROM states)
  UNION ALL SELECT session_id, n, turn, ends, CASE WHEN ends THEN kept WHEN p = 0 THEN list_append(entries, {fresh}) ELSE list_transform(entries, lambda x, i: CASE WHEN i = p THEN {changed} ELSE x END) END,
    added + (NOT ends AND p = 0)::INT, changed + (NOT ends AND p > 0 AND old.polarity = polarity)::INT, overridden + (NOT ends AND p > 0 AND old.polarity <> polarity)::INT, CASE WHEN ends THEN len(entries) - len(kept) ELSE 0 END,
    CASE WHEN NOT ends AND p > 0 AND old.polarity <> polarity THEN list_append(matched, struct_pack(concept := old.concept, "from" := old.polarity, "to" := polarity)) ELSE matched END
  FROM (SELECT *, entries[p] AS old, CASE WHEN ends AND told THEN {capped} ELSE entries END kept FROM (SELECT *, CASE WHEN ends THEN 0 ELSE {place} END p FROM (
    SELECT e.*, r.entries, NOT r.ends told, CASE WHEN r.ends THEN 0 ELSE r.added END added, CASE WHEN r.ends THEN 0 ELSE r.changed END changed, CASE WHEN r.ends THEN 0 ELSE r.overridden END overridden, CASE WHEN r.ends THEN [] ELSE r.matched END matched
    FROM {name}_fold r JOIN {name}_steps e ON e.session_id = r.session_id AND e.n = r.n + 1)))""",
        name: f"""SELECT session_id, turn, x.concept, x.name, x.surface, x.polarity, x.confidence, x.created, x.updated, (i - 1)::INT AS position, x.overrides, added, changed, overridden, evicted::INT evicted, matched
  FROM (SELECT session_id, turn, unnest(entries) x, generate_subscripts(entries, 1) i, added, changed, overridden, evicted, matched FROM {name}_fold WHERE ends AND n > 0)""",
    }


SQL = dict(fx.SQL)
SQL["ev"] = f"SELECT session_id, feedback_turn + 1 turn, idx, trim(attribute) attribute, {CANON.format('attribute')} concept, confidence FROM beliefs WHERE polarity = 'negative'"
SQL["mem"], SQL["memc"] = memory_sql("<="), memory_sql("=")
NEGATIVES = "SELECT *, 'negative' polarity, attribute surface, NULL::DOUBLE[] vector FROM ev"
SQL |= fold_sql("capped", NEGATIVES, 3)
SQL |= fold_sql("merged", f"SELECT ev.*, 'negative' polarity, attribute surface, {unit_sql('v.vector')} vector FROM ev JOIN vocab v ON v.text = ev.attribute", CONFIG.max_concepts, 0.2)
BOTH = f"SELECT session_id, feedback_turn + 1 turn, idx, trim(attribute) surface, {CANON.format('attribute')} concept, confidence, polarity, NULL::DOUBLE[] vector FROM beliefs"
SQL |= fold_sql("turned", BOTH, CONFIG.max_concepts) | fold_sql("turned3", BOTH, 3)
for _m in ("mem", "memc"):
    SQL[f"w{_m}"] = f"SELECT *, {weight_sql('full')} weight FROM {_m}"
    SQL[f"agg_w{_m}"], SQL[f"q{_m}"] = corrected_sql(f"w{_m}")
SQL["cn"] = f"SELECT corpus_idx, {unit_sql('vector')} v FROM corpus"
SQL["qs"] = f"""SELECT 'h0' run_id, session_id, turn, target_index, {unit_sql("query_vector")} v FROM states UNION ALL SELECT 'current', session_id, turn, target_index, v FROM qmemc
  UNION ALL SELECT 'persistent', session_id, turn, target_index, v FROM qmem"""
SQL["sc"] = scored_sql("qs")
SQL["ranks"] = ranks_sql("sc")
SQL["tops"] = f"SELECT run_id, session_id, turn, n::INT AS position, corpus_idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id, session_id, turn ORDER BY s DESC, corpus_idx) - 1 n FROM sc) WHERE n < {TOP_K}"
SQL["wmodes"] = " UNION ALL ".join(f"SELECT '{m}' run_id, session_id, turn, surface, {weight_sql(m)} weight FROM mem" for m in MODES)
SQL["mstates"] = f"SELECT s.*, run_id FROM states s, (SELECT unnest({list(MODES)}) run_id)"
SQL["agg_wmodes"], SQL["qmodes"] = corrected_sql("wmodes", "run_id, session_id, turn", "mstates")
SQL["scmodes"] = scored_sql("qmodes")
SQL["ablation"] = ranks_sql("scmodes")
SQL["progress"] = """SELECT *, (ln_ + lag(ln_) OVER w) / 2 trapezoid FROM (SELECT *, (rank < 10)::INT::DOUBLE hit, min(rank) OVER w best, max((rank < 10)::INT::DOUBLE) OVER w hit_so_far, ln(min(rank) OVER w + 1.0::DOUBLE) ln_
  FROM ranks WINDOW w AS (PARTITION BY run_id, session_id ORDER BY turn)) WINDOW w AS (PARTITION BY run_id, session_id ORDER BY turn)"""
SQL["per_turn"] = "SELECT run_id, turn, 100 * avg(hit) recall, 100 * avg(hit_so_far) cumulative FROM progress GROUP BY ALL"
SQL["bri"] = "SELECT run_id, session_id, coalesce(avg(trapezoid), max(ln_)) bri FROM progress GROUP BY ALL"
SQL["at_last"] = "SELECT run_id, session_id, arg_max(hit, turn) hit, arg_max(hit_so_far, turn) hit_so_far FROM progress GROUP BY ALL"
SUMMARY = """SELECT run_id, avg(recall) FILTER (turn >= 1) average_feedback_recall, (SELECT 100 * avg(hit) FROM at_last p WHERE p.run_id = t.run_id) final_recall, (SELECT 100 * avg(hit_so_far) FROM at_last p WHERE p.run_id = t.run_id) final_cumulative,
  (SELECT avg(trapezoid) FROM progress p WHERE p.run_id = t.run_id) bri, (SELECT count(DISTINCT session_id) FROM progress p WHERE p.run_id = t.run_id) num_dialogues, count(*) num_rounds FROM per_turn t GROUP BY run_id"""
SQL["pairs"] = "SELECT b.session_id, b.turn, b.rank b, c.rank c, (c.rank < 10)::INT::DOUBLE - (b.rank < 10)::INT::DOUBLE d FROM ranks b JOIN ranks c USING (session_id, turn) WHERE b.run_id = 'h0' AND c.run_id = 'persistent'"
SQL["told"] = f"""SELECT b.session_id, b.feedback_turn + 1 turn, (b.polarity = 'negative')::INT kind, b.idx, {CANON.format('b.attribute')} concept, coalesce(s.actionable AND b.polarity = 'negative', false) actionable
  FROM beliefs b LEFT JOIN structured s ON s.session_id = b.session_id AND s.feedback_turn = b.feedback_turn AND s.idx = b.idx"""
SQL["clean"] = """SELECT session_id, turn, count(*) memory_size, min(turn - last_turn) latest_age, max(turn - last_turn) oldest_age, list_sort(list(DISTINCT concept)) concepts FROM (
  SELECT s.session_id, s.turn, e.concept, arg_max(e.kind, e.turn * 10000 + e.kind * 1000 + e.idx) kind, max(e.turn) last_turn FROM states s JOIN told e ON e.session_id = s.session_id AND e.turn <= s.turn AND (e.kind = 0 OR e.actionable)
  WHERE s.turn >= 1 AND NOT EXISTS (SELECT 1 FROM told n WHERE n.session_id = s.session_id AND n.turn = s.turn AND n.kind = 1) GROUP BY ALL) WHERE kind = 1 GROUP BY session_id, turn"""
_inside = ["true", "latest_age = 1", "latest_age BETWEEN 2 AND 3", "latest_age >= 4", "memory_size = 1", "memory_size BETWEEN 2 AND 3", "memory_size >= 4"]
SQL["grouped"] = " UNION ALL ".join(f"SELECT *, '{g}' AS \"group\" FROM clean WHERE {c}" for g, c in zip(analysis.GROUPS, _inside, strict=True))
SQL["groups"] = f"SELECT unnest({analysis.GROUPS}) AS \"group\""
SQL["texts"] = f"""SELECT s.session_id, s.turn, CASE WHEN m.c IS NULL THEN trim(s.query_text) ELSE trim(s.query_text) || '{S.EXCLUSION}' || array_to_string(m.c, '; ') || '.' END AS text, m.c IS NOT NULL has_memory
  FROM states s LEFT JOIN (SELECT session_id, turn, list(surface ORDER BY ord) c FROM mem GROUP BY ALL) m USING (session_id, turn)"""
SQL["base_texts"] = "SELECT session_id, turn, trim(query_text) AS text, false has_memory FROM states"
SQL["all_texts"] = "SELECT text FROM texts UNION ALL SELECT text FROM base_texts"
SQL["encoded"] = encoded_sql("all_texts")
SQL["tq"] = f"""SELECT 'text_persistent' run_id, s.session_id, s.turn, s.target_index, {unit_sql("coalesce(CASE WHEN t.has_memory THEN e.vector END, s.query_vector)")} v FROM states s JOIN texts t USING (session_id, turn) JOIN encoded e ON e.text = t.text
  UNION ALL SELECT 'reencode_h0', s.session_id, s.turn, s.target_index, {unit_sql("e.vector")} FROM states s JOIN base_texts t USING (session_id, turn) JOIN encoded e ON e.text = t.text
  UNION ALL SELECT 'reencode_persistent', s.session_id, s.turn, s.target_index, {unit_sql("e.vector")} FROM states s JOIN texts t USING (session_id, turn) JOIN encoded e ON e.text = t.text"""
SQL["sctext"] = scored_sql("tq")
SQL["text_ranks"] = ranks_sql("sctext")
SQL["text_progress"] = SQL["progress"].replace("FROM ranks", "FROM text_ranks")
for _t in ("per_turn", "at_last"):
    SQL[f"text_{_t.removeprefix('at_')}"] = SQL[_t].replace("FROM progress", "FROM text_progress")
SQL["settings"] = "SELECT *, 's' || session_id % 4 setting FROM ranks"
SQL["broken_beliefs"] = """SELECT session_id, feedback_turn, idx, CASE WHEN session_id % 23 = 0 THEN 'neutral' ELSE polarity END polarity, CASE WHEN session_id % 19 = 0 THEN '  ' ELSE attribute END attribute,
  CASE WHEN session_id % 17 = 0 THEN 1.5 ELSE confidence END confidence FROM beliefs"""
SQL["broken_states"] = """SELECT session_id, turn, CASE WHEN session_id % 10 = 0 THEN ' ' ELSE query_text END query_text, CASE WHEN session_id % 9 = 0 THEN -1 ELSE target_index END target_index,
  CASE WHEN session_id % 11 = 0 THEN list_transform(query_vector, lambda x: x * 0) WHEN session_id % 13 = 0 THEN query_vector[1:3] WHEN session_id % 5 = 0 THEN NULL ELSE query_vector END query_vector
  FROM states WHERE NOT (session_id % 7 = 0 AND turn = 1)"""
SQL["broken_one"] = """SELECT session_id, feedback_turn, idx, CASE WHEN session_id % 6 = 0 THEN 'other' ELSE negative_attribute END negative_attribute, CASE WHEN session_id % 12 <> 1 THEN actionable END actionable,
  CASE WHEN session_id % 10 = 1 THEN 'unheard of' ELSE sem_type END sem_type FROM structured WHERE session_id % 8 <> 0"""
SQL["broken_structured"] = "SELECT * FROM broken_one UNION ALL SELECT * FROM broken_one WHERE session_id % 9 = 1"
SQL["broken_ranks"] = "SELECT run_id, session_id, turn, CASE WHEN run_id = 'h0' AND session_id % 30 = 1 THEN -1 ELSE rank END AS rank FROM ranks WHERE NOT (run_id = 'current' AND turn = 2 AND session_id % 4 = 0)"
SQL["sizes"] = "SELECT s.session_id, s.turn, count(m.concept) size, 0::BIGINT positive, count(m.concept) negative, 0::BIGINT overrides FROM states s LEFT JOIN mem m USING (session_id, turn) GROUP BY ALL"
SQL["run_rows"] = f"""SELECT m || '-' || bucket run_id, bucket, m method, sha256(bucket || ':' || n || ':' || t) pairing FROM
  (SELECT session_id // 10 bucket, count(*) n, sum(session_id * 31 + target_index) t FROM (SELECT DISTINCT session_id, target_index FROM states) GROUP BY ALL), (SELECT unnest({list(METHODS)}) m)"""
SQL["shaken"] = """SELECT run_id, session_id, turn, rank + (CASE WHEN run_id = 'current' AND (turn = 0 AND session_id % 9 = 4 OR turn > 0 AND session_id % 3 = 0) OR run_id = 'persistent' AND (session_id + turn) % 5 = 0 THEN 1 ELSE 0 END) AS rank FROM ranks"""


def with_tables(sql: str) -> str:
    """sql after those of the tables that it reaches."""
    import re

    needed, look = set(), [sql]
    while look:
        for name in set(re.findall(r"\b\w+\b", look.pop())) & set(SQL) - needed:
            needed.add(name)
            look.append(SQL[name])
    return ("WITH RECURSIVE " if any(n.endswith("_fold") for n in needed) else "WITH ") + ",\n".join(f"{n} AS ({t})" for n, t in SQL.items() if n in needed) + "\n" + sql if needed else sql


def bootstrap_sql(units: str, group: str, samples: int, seed: int, scale: float = 100.0) -> str:
    """units: a query of (group, session_id, s, c)."""
    return f"""SELECT g."{group}", g.delta, quantile_cont(m.m, 0.025) ci_low, quantile_cont(m.m, 0.975) ci_high FROM
 (SELECT "{group}", count(*) n, {scale}::DOUBLE * sum(s) / sum(c) delta FROM ({units}) GROUP BY ALL) g JOIN
 (SELECT d."{group}", replicate, {scale}::DOUBLE * sum(u.s) / sum(u.c) m FROM
   (SELECT "{group}", replicate, ('0x' || substr(md5('{seed}:' || replicate || ':' || place // 4), 1 + 8 * (place % 4), 8))::BIGINT % n AS no FROM (SELECT "{group}", n, unnest(range(n)) place FROM (SELECT "{group}", count(*) n FROM ({units}) GROUP BY ALL)), range({samples}) r(replicate)) d
   JOIN (SELECT *, row_number() OVER (PARTITION BY "{group}" ORDER BY session_id) - 1 no FROM ({units})) u ON u."{group}" = d."{group}" AND u.no = d.no GROUP BY ALL) m ON m."{group}" = g."{group}" GROUP BY ALL"""


def violations_sql(check: str, source: str, key: str, reasons: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{check}' AS \"check\", {key} AS key, '{r}' reason FROM {source} WHERE {c}" for r, c in reasons.items())


K2 = "session_id || ':' || turn"
KF = "session_id || ':' || feedback_turn"
KI = f"{KF} || ':' || idx"
