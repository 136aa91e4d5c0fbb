"""Readers and writers of the retrieval tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import strict

BELIEF = "struct<attribute:string,confidence:double,fact_type:string>"
BELIEFS_JSON = f"schema_version int, status string, provenance map<string,string>, quality struct<passed:boolean>, dialogs array<struct<dialog_id:bigint,turns:array<struct<turn:int,question:string,answer:string,positives:array<{BELIEF}>,negatives:array<{BELIEF}>>>>>"
#: What stands for missing texts, confidences and kinds of facts.
DEFAULT_TEXT = "precomputed query"
DEFAULT_CONFIDENCE = 0.7
DEFAULT_FACT_TYPE = "unknown"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """corpus_idx, vector (doubles)."""
    return spark.read.parquet(path).select(F.col(id_).alias("corpus_idx"), F.col(vector).cast("array<double>").alias("vector"))


def turns_of_sessions(sessions: DataFrame) -> DataFrame:
    """Rows of (session_id, target_index, query_vectors, query_texts) to one row a turn; missing texts get a default."""
    return sessions.select("session_id", "target_index", "query_texts", F.posexplode("query_vectors").alias("turn", "query_vector")).select(
        "session_id", "turn", F.coalesce(F.get("query_texts", F.col("turn")), F.lit(DEFAULT_TEXT)).alias("query_text"), "target_index", F.col("query_vector").cast("array<double>").alias("query_vector")
    )


def sessions_of_turns(states: DataFrame) -> DataFrame:
    """The other way: one row a session, turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "query_text", "query_vector")))
    out = states.groupBy("session_id", "target_index").agg(turns.alias("t"))
    return out.select("session_id", "target_index", F.col("t.query_vector").alias("query_vectors"), F.col("t.query_text").alias("query_texts"))


def explode_beliefs(artifact: DataFrame) -> DataFrame:
    """A belief artifact to (position, dialog_id, turn_position, session_id, feedback_turn, polarity, idx, attribute, confidence, fact_type)."""
    dialogs = artifact.select(F.posexplode("dialogs").alias("position", "d"))
    turns = dialogs.select("position", F.col("d.dialog_id").alias("session_id"), F.posexplode("d.turns").alias("turn_position", "t"))
    one = lambda polarity, field: turns.select("position", "session_id", "turn_position", F.col("t.turn").alias("feedback_turn"), F.lit(polarity).alias("polarity"), F.posexplode(F.col(f"t.{field}")).alias("idx", "b"))
    both = one("positive", "positives").unionByName(one("negative", "negatives"))
    return both.select("position", "session_id", "turn_position", "feedback_turn", "polarity", "idx", F.trim("b.attribute").alias("attribute"), F.coalesce("b.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), F.coalesce("b.fact_type", F.lit(DEFAULT_FACT_TYPE)).alias("fact_type"))


def read_beliefs(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Artifacts, one a line; one_a_file: one a file, over several lines. Malformed input raises; strict.beliefs tells its faults."""
    return strict.beliefs(spark, path, one_a_file).or_raise()


def read_structured(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Items of artifacts, one artifact a line (or a file). Malformed input, and an item that stands twice, raise; strict.structured tells the faults."""
    return strict.structured(spark, path, one_a_file).or_raise()


def read_configs(spark: SparkSession, path: str, one_a_file: bool = False) -> DataFrame:
    """Configurations, one JSON object a line; what one leaves out has its default. Malformed ones raise; checks.configs tells which have bad values."""
    return strict.configs(spark, path, one_a_file).or_raise()


def write_beliefs(beliefs: DataFrame, path: str) -> None:
    """(session_id, feedback_turn, polarity, idx, attribute, confidence, and fact_type if it is there) to artifacts of one dialogue, one JSON object a line."""
    kind = F.col("fact_type") if "fact_type" in beliefs.columns else F.lit(DEFAULT_FACT_TYPE)
    beliefs = beliefs.withColumn("fact_type", kind)
    own = lambda polarity: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("polarity", "idx", "attribute", "confidence", "fact_type"))), lambda b: b["polarity"] == polarity), lambda b: F.struct(b["attribute"].alias("attribute"), b["confidence"].alias("confidence"), b["fact_type"].alias("fact_type")))
    turns = beliefs.groupBy("session_id", "feedback_turn").agg(own("positive").alias("positives"), own("negative").alias("negatives"))
    turn = F.struct(F.col("feedback_turn").alias("turn"), F.lit("").alias("question"), F.lit("").alias("answer"), "positives", "negatives")
    dialogs = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(F.struct(F.col("session_id").alias("dialog_id"), "turns").alias("d"))
    # one artifact a dialog: readers explode whatever number of them
    dialogs.select(F.lit(2).alias("schema_version"), F.lit("complete").alias("status"), F.struct(F.lit(True).alias("passed")).alias("quality"), F.array("d").alias("dialogs")).write.json(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A rank archive; archives of an older kind hold the column ranks_per_round instead of rank, or lack other columns."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    old = [F.col(c) for c in ("rank", "ranks_per_round") if c in df.columns]
    missing = [F.lit(None).cast("string").alias(c) for c in ("run_id", "pairing_fp", "evaluation_fp") if c not in df.columns]
    return df.select(*(c for c in df.columns if c not in ("rank", "ranks_per_round")), F.coalesce(*old).alias("rank"), *missing)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """By run, so that readers of one run read no other; a run is dealt over the partitions by session.

    Refuses what is no rank archive: a state that stands twice in a run, missing or negative ranks, runs of unlike states.
    """
    each = ranks.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("session_id", "turn").alias("d"), F.min(F.coalesce("rank", F.lit(-1))).alias("least"))
    states = ranks.select("session_id", "turn").distinct().count()
    odd = each.where((F.col("n") != F.col("d")) | (F.col("least") < 0) | (F.col("d") != states)).select("run_id").limit(5).collect()
    if odd:
        raise ValueError(f"no rank archives: {sorted(r.run_id for r in odd)}")
    ranks.repartition("run_id", F.xxhash64("session_id")).write.mode("overwrite").partitionBy("run_id").parquet(path)


def upgrade_ranks(spark: SparkSession, old: str, new: str, **facts: str) -> DataFrame:
    """The archive with facts about its origin added, its ranks proven unchanged."""
    before = read_ranks(spark, old).select("session_id", "turn", "rank")
    told = {"provenance_status": "rehydrated_from_declared_inputs", **facts}
    read_ranks(spark, old).withColumns({k: F.lit(v) for k, v in told.items()}).write.parquet(new)
    after = read_ranks(spark, new)
    kept = after.select("session_id", "turn", "rank")
    if not before.exceptAll(kept).isEmpty() or not kept.exceptAll(before).isEmpty():
        raise ValueError("the upgraded archive has other ranks")
    return after


def write_csv(df: DataFrame, path: str) -> bool:
    """Rows with a header; no file if there are none."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Turn traces, one JSON object a line. Malformed ones, and a (session, turn) that stands twice, raise; strict.traces tells the faults."""
    return strict.traces(spark, path).or_raise()


def find_archives(spark: SparkSession, *roots: str) -> DataFrame:
    """Paths of all rank files below the roots, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(roots))
    return files.select("path").distinct()


def subset(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id").distinct().hint("merge"), "session_id", "left_semi")


def named_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Rank tables under names, as one."""
    out = None
    for name, df in runs.items():
        df = df.drop("run_id").withColumn("run_id", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no runs")
    return out


def reencode_sessions(states: DataFrame, vocabulary: DataFrame, encoder: str = "vocabulary") -> DataFrame:
    """Sessions with the same ids, targets and texts, and the texts' vectors from the vocabulary; a text without a vector raises.

    encoder and source_fp tell where the vectors come from: its name, and a hash of the session's texts and former vectors.
    """
    vectors = vocabulary.select(F.col("text").alias("query_text"), F.col("vector").alias("new"))
    both = states.join(vectors.hint("merge"), "query_text", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("query_text"))).cast("array<double>")
    new = both.withColumn("new", F.when(F.col("new").isNull(), missing).otherwise(F.col("new")))
    source = new.groupBy("session_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "query_text", "query_vector")))), 256).alias("source_fp"))
    sessions = sessions_of_turns(new.drop("query_vector").withColumnRenamed("new", "query_vector"))
    return sessions.join(source.hint("merge"), "session_id").withColumn("encoder", F.lit(encoder))


def still_to_encode(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.select("text").distinct().join(cache.select("text").hint("merge"), "text", "left_anti")
