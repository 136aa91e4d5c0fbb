"""Tables that are published whole or not at all.

A version's tables are written under names of their own (staged), read back and proven equal to what was to be written, by number of
rows and content; only then one small manifest is written, and readers take what the latest manifest names. A run that fails at any
point before leaves the former version as it is, and its files are named by nothing. A manifest may name parts of older versions too,
so that a table grows by what is new. Of two that publish at once, the later manifest counts; neither is torn.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, provenance
from ..operators.embed import Encoder, embed

MANIFEST = "seq long, id string, parts map<string,array<string>>, rows map<string,long>, digests map<string,string>, facts map<string,string>"


@dataclass(frozen=True)
class Staged:
    """Tables that are written and proven, but not published."""

    path: str
    id: str
    parts: dict[str, list[str]]
    rows: dict[str, int]
    digests: dict[str, str]
    facts: dict[str, str] = field(default_factory=dict)


def proof(df: DataFrame) -> tuple[int, str]:
    r = provenance.content(df, *sorted(df.columns)).first()
    return r.rows, r.digest


def stage(path: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None, facts: dict[str, str] | None = None, older: dict[str, list[str]] | None = None) -> Staged:
    """Write tables beside what is published, and read them back. by: columns by which a table is dealt to folders; older: parts that go on counting.

    Tables must be at rest, as each is read twice.
    """
    id_, parts, rows, digests = uuid.uuid4().hex, dict(older or {}), {}, {}
    for name, df in tables.items():
        to = f"{path}/data/{name}-{id_}"
        writer = df.repartition(by[name], F.xxhash64(*df.columns)).write.partitionBy(by[name]) if by and name in by else df.write
        writer.parquet(to)
        (rows[name], digests[name]), found = proof(df), proof(read_parts(df.sparkSession, [to]).select(*(F.col(c).cast(t) for c, t in df.dtypes)))
        if found != (rows[name], digests[name]):
            raise ValueError(f"{name} was not written as it is: {found[0]} rows for {rows[name]}")
        parts[name] = [*parts.get(name, []), to]
    return Staged(path, id_, parts, rows, digests, dict(facts or {}))


def commit(spark: SparkSession, staged: Staged) -> Row:
    """Publish what was staged: from now on readers get it."""
    former = latest(spark, staged.path)
    row = ((former.seq if former else 0) + 1, staged.id, staged.parts, staged.rows, staged.digests, staged.facts)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{staged.path}/manifests/{staged.id}")
    return latest(spark, staged.path)


def latest(spark: SparkSession, path: str) -> Row | None:
    """The manifest that counts; None before the first."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifests").orderBy(F.desc("seq"), F.desc("id")).first()
    except AnalysisException:
        return None


def read_parts(spark: SparkSession, parts: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in parts))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A published table."""
    manifest = latest(spark, path)
    if manifest is None:
        raise ValueError(f"nothing is published at {path}")
    return read_parts(spark, manifest.parts[name])


def stage_runs(ranks: DataFrame, runs: DataFrame, path: str, k: int = 10) -> Staged:
    """Ranks (run_id, session_id, turn, target_index, rank) by run, and metrics of each run with its fingerprints (runs: run_id, pairing_fp, evaluation_fp).

    Refused: a state that stands twice in a run, missing or negative ranks, runs of unlike states, states without a target, sessions of
    several targets, runs without a record.
    """
    from .tables import written

    ranks = written(ranks.select("run_id", "session_id", "turn", "target_index", "rank"), "ranks")
    each = ranks.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("session_id", "turn").alias("d"), F.min(F.coalesce("rank", F.lit(-1))).alias("least"), F.min(F.coalesce("target_index", F.lit(-1))).alias("target"))
    states = ranks.select("session_id", "turn").distinct().count()
    odd = each.where((F.col("n") != F.col("d")) | (F.col("least") < 0) | (F.col("target") < 0) | (F.col("d") != states)).select("run_id").limit(5).collect()
    lone = each.join(runs.hint("merge"), "run_id", "left_anti").select("run_id").limit(5).collect()
    torn = ranks.groupBy("session_id").agg(F.count_distinct("target_index").alias("n")).where("n > 1").limit(5).collect()
    if odd or lone or torn:
        raise ValueError(f"no rank archives: runs {sorted(r.run_id for r in odd)}, without a record {sorted(r.run_id for r in lone)}, sessions of several targets {sorted(r.session_id for r in torn)}")
    told = metrics.summary(ranks, k).join(runs.select("run_id", "pairing_fp", "evaluation_fp").hint("merge"), "run_id").withColumn("provenance_status", F.lit("emitted_by_evaluator"))
    return stage(path, {"ranks": ranks, "metrics": written(told, "metrics")}, {"ranks": "run_id"}, {"k": str(k)})


def publish_runs(ranks: DataFrame, runs: DataFrame, path: str, k: int = 10) -> Row:
    return commit(ranks.sparkSession, stage_runs(ranks, runs, path, k))


def vectors(texts: DataFrame, encoder: Encoder, name: str, dimension: int, path: str) -> DataFrame:
    """(text, vector) of the distinct texts, from the cache at path where it has them; what it lacks is encoded and published with it.

    A cache of another encoder (by name) or dimension is ignored, and the new one takes its place. An encoder whose vectors have
    another size raises, and leaves the cache as it is.
    """
    from .tables import written

    spark = texts.sparkSession
    wanted = written(texts.select("text").where("text IS NOT NULL").distinct(), "texts")
    manifest, facts = latest(spark, path), {"encoder": name, "dimension": str(dimension)}
    fits = manifest is not None and {k: manifest.facts.get(k) for k in facts} == facts
    known = read_parts(spark, manifest.parts["vectors"]) if fits else None
    missing = wanted.join(known.select("text").hint("merge"), "text", "left_anti") if fits else wanted
    fresh = written(embed(missing, encoder), "encoded")
    if odd := fresh.where(F.size("vector") != dimension).select("text").limit(1).collect():
        raise ValueError(f"the encoder gives no vectors of {dimension} components: {odd[0].text!r}")
    if not fits or not fresh.isEmpty():
        commit(spark, stage(path, {"vectors": fresh}, facts=facts, older={"vectors": manifest.parts["vectors"]} if fits else None))
    return read(spark, path, "vectors").join(wanted.hint("merge"), "text", "left_semi")
