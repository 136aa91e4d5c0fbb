"""Fingerprints of inputs and runs, and the gate before paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from .joins import met


#: Digests of rows are combined within so many buckets, then over them.
BUCKETS = 4096


def content(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): SHA-256 of a table's keyed rows, whatever their order and partitions; rows that stand twice count.

    A bucket's digest is that of its rows' digests in order; equal rows are one digest with a number, so that no bucket grows with copies.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    each = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    # four levels of 16 bits' worth of order: sums of a digest's parts as exact decimals can't hide a changed row, as each part is hashed with its number
    parts = [F.conv(F.substring(F.sha2(F.concat_ws(":", "h", "n"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = each.groupBy(F.conv(F.substring("h", 1, 3), 16, 10).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)))
    told = F.sha2(F.concat_ws(":", "bucket", "n", *(f"s{k}" for k in range(4))), 256)
    # at most BUCKETS rows
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("bucket", told.alias("d"))))["d"], ""), 256).alias("digest"))


def identity(states: DataFrame) -> DataFrame:
    """Number of sessions, turns, dimensions, and the digest of (session, target) pairs."""
    pairs = content(states.select("session_id", "target_index").distinct(), "session_id", "target_index")
    sizes = states.agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("turn").alias("turns"), F.min(F.size("query_vector")).alias("dimension"))
    return beside(sizes, pairs)


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one."""
    return a.withColumn("one", F.lit(1)).join(F.broadcast(b.withColumn("one", F.lit(1))), "one").drop("one")


def pairing_fingerprint(states: DataFrame, corpus: DataFrame) -> DataFrame:
    """(pairing_fp), one row: equal for runs over the same sessions, targets and corpus."""
    named = lambda df, p: df.toDF(*(p + c for c in df.columns))
    both = beside(named(content(states, "session_id", "turn", "target_index", "query_vector"), "s_"), named(content(corpus, "corpus_idx", "vector"), "c_"))
    return both.select(S.digest(*(F.col(x) for x in sorted(both.columns))).alias("pairing_fp"))


def evaluation_fingerprint(pairing: Column, method: Column, parameters: dict[str, Column], adapter: Column, revision: Column) -> Column:
    """Tells runs apart that share a pairing: by method and parameters; h0 has no adapter."""
    unless_h0 = lambda c: F.when(method != "h0", c)
    facts = {"adapter": unless_h0(adapter), "method": method, "pairing": pairing, "revision": unless_h0(revision), **parameters}
    return S.digest(*(facts[k].cast("string").alias(k) for k in sorted(facts)))


def declared_revision(method: Column, revision: Column, model: Column) -> Column:
    """What an adapter says of its model: its revision, or else the model's id; nothing for h0, which has no adapter."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.when(method != "h0", F.coalesce(told(revision), told(model)))


#: The reasons that a comparison reports.
REASONS = ["rank_shape_mismatch", "missing_pairing_fingerprint", "pairing_fingerprint_mismatch", "session_ids_mismatch", "target_indices_mismatch"]


def verify_pairings(runs: DataFrame, ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(baseline, candidate, verified, reasons) of (baseline, candidate) pairs: whether statistics of the two runs may be paired.

    runs has run_id and pairing_fp; ranks has run_id, session_id, turn and target_index. A run without a record has no fingerprint.
    """
    fp = runs.select("run_id", F.nullif(F.trim("pairing_fp"), F.lit("")).alias("fp"))
    shape = ranks.groupBy("run_id").agg(F.count_distinct("session_id").alias("s"), F.count_distinct("turn").alias("t"))
    facts = shape.join(fp.hint("merge"), "run_id", "left")
    side = lambda name, p: facts.select(F.col("run_id").alias(name), *(F.col(c).alias(p + c) for c in ("s", "t", "fp")))
    # a run of many sessions, or of null id, meets its pairs as one small fact
    keys = written(ranks.select("run_id", "session_id", "target_index").distinct(), "pairing-keys")
    pair = F.struct("baseline", "candidate")
    of_run = lambda name: pairs.groupBy(F.col(name).alias("run_id")).agg(F.collect_set(pair).alias("pairs"))
    of = lambda name: met(keys, of_run(name), "run_id").select(F.explode("pairs").alias("p"), "session_id", "target_index").select("p.*", "session_id", "target_index")
    count = lambda columns, out: (
        of("baseline").select(columns).distinct().withColumn("n", F.lit(1)).unionByName(of("candidate").select(columns).distinct().withColumn("n", F.lit(-1)))
        .groupBy(columns).agg(F.sum("n").alias("n")).where("n <> 0").groupBy("baseline", "candidate").agg(F.count("*").alias(out))
    )
    both = pairs.join(side("baseline", "a").hint("merge"), "baseline", "left").join(side("candidate", "b").hint("merge"), "candidate", "left")
    for columns, out in ((["baseline", "candidate", "session_id"], "lone_ids"), (["baseline", "candidate", "session_id", "target_index"], "lone")):
        both = both.join(count(columns, out).hint("merge"), ["baseline", "candidate"], "left")
    holds = [
        ~(F.col("as").eqNullSafe(F.col("bs")) & F.col("at").eqNullSafe(F.col("bt"))),
        F.col("afp").isNull() | F.col("bfp").isNull(),
        F.col("afp") != F.col("bfp"),
        F.col("lone_ids") > 0,
        F.col("lone") > 0,
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in zip(REASONS, holds, strict=True))))
    return both.select("baseline", "candidate", (F.size(reasons) == 0).alias("verified"), reasons.alias("reasons"))


def verify_pairing(runs: DataFrame, ranks: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(verified, reasons) of one pair."""
    pair = runs.sparkSession.range(1).select(F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"))
    own = F.col("run_id").isin(baseline, candidate)
    return verify_pairings(runs.where(own), ranks.where(own), pair).select("verified", "reasons")


def statuses(found: DataFrame, allow_unverified: bool = False) -> DataFrame:
    """found with what the gate says of each pair: verified, legacy_unverified (let pass) or refused."""
    return found.withColumn("status", F.when(F.col("verified"), "verified").otherwise("legacy_unverified" if allow_unverified else "refused"))


def gate(runs: DataFrame, ranks: DataFrame, baseline: str, candidate: str, allow_unverified: bool = False) -> str:
    """Raises before unpaired runs are compared, unless told to let them pass."""
    r = verify_pairing(runs, ranks, baseline, candidate).first()
    if r.verified:
        return "verified"
    if not allow_unverified:
        raise ValueError(f"runs are not paired: {', '.join(r.reasons)}")
    return "legacy_unverified"
