"""Paired statistics of two runs.

A bootstrap makes one row for each group and replicate, never one for a draw. Draws come from a hash of (seed, replicate, place), so
that they can be made anywhere and again: up to DRAWN units, all units go to every task, which draws a range of replicates, and the
draws of a replicate serve all groups. Beyond, units are summed to distinct (s, c) values with counts, and a replicate is a multinomial
draw of these counts, from a counter-based generator keyed by (seed, group, range of replicates, block): the cost follows distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .metrics import OWN, at_last, session_bri
from .provenance import gate

#: Units of all groups up to which single draws are made (16 bytes each, in every task), distinct values of a block beyond, and replicates that are made together.
DRAWN, BLOCK, RANGE = 200_000, 65_536, 100


def checked(rank: Column) -> Column:
    """rank, or an error if it is none."""
    return F.when(rank.isNull() | (rank < 0), F.raise_error(F.lit("ranks must be 0 or more")).cast("long")).otherwise(rank)


def paired(ranks: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(session_id, turn, b, c): ranks of two runs side by side; ranks below 0 are refused."""
    one = lambda run, name: ranks.where(F.col("run_id") == run).select("session_id", "turn", checked(F.col("rank")).alias(name))
    return one(baseline, "b").join(one(candidate, "c").hint("merge"), ["session_id", "turn"])


def differences(pairs: DataFrame, k: int = 10) -> DataFrame:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return pairs.withColumn("d", (F.col("c") < k).cast("double") - (F.col("b") < k).cast("double"))


def draws(seed: int, replicate: int, n: int) -> np.ndarray:
    """32-bit numbers for the places 0 to n - 1, each from a fourth of md5(seed:replicate:place div 4)."""
    return np.frombuffer(b"".join(md5(f"{seed}:{replicate}:{k}".encode(), usedforsecurity=False).digest() for k in range(-(-n // 4))), ">u4")[:n].astype(np.int64)


def in_order(units: DataFrame, group: str, wide: int = 4096, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """units numbered from 0 by `by`, which begins with session_id, within their group: within ranges of ids, and by what the ranges before hold."""
    units = units.withColumn("range", F.floor(F.col("session_id") / wide))
    sizes = units.groupBy(group, "range").agg(F.count("*").alias("m"))
    offsets = sizes.withColumn("base", F.sum("m").over(W.partitionBy(group).orderBy("range")) - F.col("m")).drop("m")
    inside = units.withColumn("in", F.row_number().over(W.partitionBy(group, "range").orderBy(*by)) - 1)
    return inside.join(offsets.hint("merge"), [group, "range"]).withColumn("no", F.col("in") + F.col("base")).drop("in", "base", "range")


def drawn_means(units: DataFrame, group: str, samples: int, seed: int, scale: float) -> DataFrame:
    """(group, replicate, m), draw by draw. units has (group, no, s, c), at most DRAWN of them, which the driver hands to all tasks."""
    table = units.orderBy(group, "no").toArrow()
    names = table[group].to_pylist()
    first = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
    parts = list(zip(first, [*first[1:], len(names)], strict=True))
    s, c = (table[x].to_numpy().astype(float) for x in ("s", "c"))
    most = max((b - a for a, b in parts), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replicates, means = batch.column(0).to_pylist(), []
            for replicate in replicates:
                h = draws(seed, replicate, most)
                for a, b in parts:
                    no = a + h[: b - a] % (b - a)
                    means.append(scale * s[no].sum() / c[no].sum())
            columns = [pa.array([names[a] for a, _ in parts] * len(replicates), table.schema.field(group).type), pa.array(np.repeat(replicates, len(parts)), pa.int64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[group, "replicate", "m"])

    kind = units.schema[group].dataType.simpleString()
    return units.sparkSession.range(samples).mapInArrow(run, f"`{group}` {kind}, replicate long, m double")


def key_of(*parts: object) -> int:
    """128 bits for a generator, from the parts' texts."""
    return int.from_bytes(md5(":".join(map(str, parts)).encode(), usedforsecurity=False).digest(), "big")


def counted_sums(units: DataFrame, group: str, samples: int, seed: int) -> DataFrame:
    """(group, replicate, s, c): sums over a replicate's draws, by multinomial counts of distinct (s, c) values.

    A group's values lie in blocks. How many of a replicate's draws fall to each block is drawn alike in all of its tasks; each task
    then draws the counts of its own block's values, and sends one partial sum a replicate.
    """
    values = units.groupBy(group, "s", "c").agg(F.count("*").alias("n"))
    per = values.groupBy(group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = values.join(per.hint("merge"), group).withColumn("block", F.pmod(F.xxhash64("s", "c"), F.col("blocks")).cast("int")).drop("blocks")
    dealt = written(dealt, "values")
    sizes = dealt.groupBy(group, "block").agg(F.sum("n").alias("n")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("sizes"))  # a row a block
    sent = dealt.join(sizes.hint("merge"), group).groupBy(group, "block").agg(F.array_sort(F.collect_list(F.struct("s", "c", "n"))).alias("v"), F.first("sizes").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c)).slice(row, 1)  # noqa: B023, E731
                name, block = get(group), get("block")[0].as_py()
                sizes_, v = get("sizes")[0].values, get("v")[0].values
                n, own = sizes_.field("n").to_numpy(), v.field("n").to_numpy()
                at = sizes_.field("block").to_pylist().index(block)
                for lo in range(0, samples, RANGE):
                    size = min(RANGE, samples - lo)
                    split = np.random.Generator(np.random.Philox(key=key_of(seed, name[0], lo, "blocks"))).multinomial(n.sum(), n / n.sum(), size)[:, at]
                    k = np.random.Generator(np.random.Philox(key=key_of(seed, name[0], lo, block))).multinomial(split, own / own.sum())
                    columns = [pa.concat_arrays([name] * size), pa.array(np.arange(lo, lo + size)), pa.array(k @ v.field("s").to_numpy()), pa.array(k @ v.field("c").to_numpy())]
                    yield pa.RecordBatch.from_arrays(columns, names=[group, "replicate", "s", "c"])

    kind = units.schema[group].dataType.simpleString()
    return sent.mapInArrow(run, f"`{group}` {kind}, replicate long, s double, c double").groupBy(group, "replicate").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def bootstrap(units: DataFrame, group: str, samples: int, seed: int, confidence: float = 0.95, scale: float = 100.0) -> DataFrame:
    """(group, delta, ci_low, ci_high) from (group, session_id, s, c) units: the ratio of sums, its percentiles over resamples of sessions."""
    if samples < 100:
        raise ValueError("a bootstrap needs 100 samples or more")
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    units = written(units.select(group, "session_id", "s", "c"), "units")
    if units.count() <= DRAWN:
        means = drawn_means(units.withColumn("no", F.row_number().over(W.partitionBy(group).orderBy("session_id")) - 1), group, samples, seed, scale)
    else:
        means = counted_sums(units, group, samples, seed).select(group, "replicate", (scale * F.col("s") / F.col("c")).alias("m"))
    n = units.groupBy(group).agg((scale * F.sum("s") / F.sum("c")).alias("delta"))
    tail = (1 - confidence) / 2
    return n.join(means.groupBy(group).agg(F.expr(f"percentile(m, {tail})").alias("ci_low"), F.expr(f"percentile(m, {1 - tail})").alias("ci_high")).hint("merge"), group, "left").select(group, "delta", "ci_low", "ci_high")


def recall_delta(ranks: DataFrame, baseline: str, candidate: str, k: int = 10, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """(turn, delta, ci_low, ci_high) of recall in percent points."""
    d = differences(paired(ranks, baseline, candidate), k).select("turn", "session_id", F.col("d").alias("s"), F.lit(1.0).alias("c"))
    return bootstrap(d, "turn", samples, seed)


def final_delta(pairs: DataFrame, by: str, k: int = 10, samples: int = 20_000, seed: int = 20260829, final: str = OWN) -> DataFrame:
    """(by, delta, ci_low, ci_high) of recall at the last turn, from (by, session_id, turn, b, c) pairs; final as in metrics."""
    units = at_last(differences(pairs, k), [by], final, s=F.col("d")).withColumn("c", F.lit(1.0))
    return bootstrap(units, by, samples, seed)


def bri_delta(ranks: DataFrame, baseline: str, candidate: str, samples: int = 10_000, seed: int = 42) -> DataFrame:
    bri = session_bri(ranks)
    one = lambda run, name: bri.where(F.col("run_id") == run).select("session_id", F.col("bri").alias(name))
    d = one(baseline, "b").join(one(candidate, "x").hint("merge"), "session_id").select(F.lit("all").alias("metric"), "session_id", (F.col("x") - F.col("b")).alias("s"), F.lit(1.0).alias("c"))
    return bootstrap(d, "metric", samples, seed, scale=1.0)


def binomial_tail(n: Column, most: Column) -> Column:
    """min(1, 2 * P(X <= most)) of n fair coins, summed in logarithms; n = 0 gives 1."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lg"), F.lit(0.0).alias("p"))
    steps = F.sequence(F.lit(0).cast("long"), most.cast("long"))
    done = F.aggregate(steps, start, lambda a, k: F.struct((a["lg"] + F.log((n - k) / (k + 1.0))).alias("lg"), (a["p"] + F.exp(a["lg"])).alias("p")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * done["p"]))


def mcnemar(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(turn, lost, gained, discordant, p): the exact two-sided test on hits."""
    b, c = F.col("b") < k, F.col("c") < k
    counts = pairs.groupBy("turn").agg(F.count_if(b & ~c).alias("lost"), F.count_if(~b & c).alias("gained")).withColumn("discordant", F.col("lost") + F.col("gained"))
    return counts.withColumn("p", binomial_tail(F.col("discordant"), F.least("lost", "gained")))


def holm(pvalues: DataFrame, order: str = "turn") -> DataFrame:
    """pvalues with adjusted p: a family is small, one row a test. A p outside [0, 1] is refused."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    pvalues = pvalues.withColumn("p", F.when(bad, F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(F.col("p")))
    by = W.orderBy("p", order)
    step = F.least(F.lit(1.0), (F.count("*").over(W.partitionBy()) - F.row_number().over(by) + 1) * F.col("p"))
    return pvalues.withColumn("step", step).withColumn("p_holm", F.max("step").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("step")


def compare(ranks: DataFrame, baseline: str, candidate: str, k: int = 10, samples: int = 10_000, seed: int = 42, runs: DataFrame | None = None, allow_unverified: bool = False) -> DataFrame:
    """The report by turn: recall deltas, test, and adjusted p over the feedback turns (null at turn 0), under the pairing's status.

    runs (run_id, pairing_fp) must prove that the two are paired; without proof this raises, unless told to let them pass.
    """
    known = runs if runs is not None else ranks.select("run_id", F.lit(None).cast("string").alias("pairing_fp")).limit(0)
    status = gate(known, ranks if "target_index" in ranks.columns else ranks.withColumn("target_index", F.lit(None).cast("long")), baseline, candidate, allow_unverified)
    pairs = paired(ranks, baseline, candidate)
    tests = mcnemar(pairs, k)
    adjusted = holm(tests.where("turn >= 1")).select("turn", "p_holm")
    deltas = recall_delta(ranks, baseline, candidate, k, samples, seed)
    return deltas.join(tests.hint("merge"), "turn").join(adjusted.hint("merge"), "turn", "left").withColumn("pairing", F.lit(status))


def rank_differences(ranks: DataFrame, baseline: str, candidate: str, k: int = 10) -> DataFrame:
    p = paired(ranks, baseline, candidate)
    return p.agg(F.count("*").alias("compared"), F.count_if(F.col("b") != F.col("c")).alias("differing"), F.coalesce(F.max(F.abs(F.col("b") - F.col("c"))), F.lit(0)).alias("max_difference"), F.count_if((F.col("b") < k) != (F.col("c") < k)).alias("hit_changes"))
