"""Small things that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    """Cut the lineage: write the rows into the shared folder and read them back, with true sizes for the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nested(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, h1, h2): each row as one struct, so that its columns clash with nothing, and 128 bits that stand for its id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(id_, text).alias("h1"), F.xxhash64(text, id_, F.lit(1)).alias("h2"))


#: A key with more rows than LEAST_HOT, and more than one in MOST_HOT of all, is hot.
LEAST_HOT, MOST_HOT = 256, 4096


def hot_keys(counts: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """Keys of too many rows for one task. There are at most MOST_HOT of them, as each has more than rows / MOST_HOT rows: they may be broadcast."""
    return counts.where(F.col(count) > max(LEAST_HOT, rows // MOST_HOT)).select(key)


def spread_join(df: DataFrame, facts: DataFrame, key: str, hot: DataFrame, how: str = "inner", deal: list[str] | None = None) -> DataFrame:
    """df joined with facts, which has one small row a key. Rows of the hot keys, which should be at rest, meet theirs by broadcast.

    In the shuffle for the others, hot rows and rows with a null key are dealt by what else they hold (of `deal`, if given), so that no key gathers many rows.
    Without hot keys nothing is broadcast: a broadcast takes megabytes of the driver's memory, however few its rows.
    """
    own, other = df.columns, [c for c in facts.columns if c != key]
    packed = facts.select(F.col(key).alias("_k"), F.struct(*other).alias("_f"), F.lit(0).alias("_s"))
    any_hot = not hot.isEmpty()
    if any_hot:
        near = packed.join(F.broadcast(hot.select(F.col(key).alias("_k"))), "_k", "left_semi").select("_k", F.col("_f").alias("_near"))
        met = df.join(F.broadcast(near), F.col(key) == F.col("_k"), "left").drop("_k")
    else:
        met = df
    away = F.col("_near").isNotNull() | F.col(key).isNull() if any_hot else F.col(key).isNull()
    met = met.withColumn("_salt", F.when(away, F.pmod(F.xxhash64(*(deal or own)), F.lit(1 << 20)).cast("int") + 1).otherwise(0))
    met = met.join(packed.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    if any_hot:
        met = met.withColumn("_f", F.coalesce("_near", "_f"))
    return (met.where("_f IS NOT NULL") if how == "inner" else met).select(*own, *(F.col(f"_f.{c}").alias(c) for c in other))


def hash_counts(rows: DataFrame) -> DataFrame:
    """(h1, h2, parts) of the keys of too many (h1, h2) rows for one task, and into how many parts each is to be dealt. rows should be at rest.

    There are at most MOST_HOT of them, each of a few numbers: they may be broadcast.
    """
    least = max(LEAST_HOT, rows.count() // MOST_HOT)
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where(F.col("c") > least).select("h1", "h2", F.expr(f"c div {least} + 1").cast("int").alias("parts"))


def meet(keyed: DataFrame, facts: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """keyed, the (row, h1, h2) rows of nested(), each with what facts has of its key (h1, h2), one row a key; how is inner or left.

    hot: the keys of many rows, by hash_counts(). Their rows that are alike in all columns become one with a number before any shuffle,
    and the others are dealt to so many tasks as `parts` says, each with a copy of the key's fact. All rows come out as often as they came in.
    """
    others = [c for c in facts.columns if c not in ("h1", "h2")]
    columns = ["row", "h1", "h2", *others]
    if hot.isEmpty():
        return keyed.join(facts.hint("merge"), ["h1", "h2"], how).select(columns)
    keys = F.broadcast(hot)
    few = keyed.join(keys.select("h1", "h2"), ["h1", "h2"], "left_anti").join(facts.hint("merge"), ["h1", "h2"], how)
    alike = keyed.join(keys, ["h1", "h2"]).groupBy("h1", "h2", "parts", F.sha2(F.to_json("row"), 256).alias("all")).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    alike = alike.withColumn("part", F.pmod(F.xxhash64("all"), F.col("parts")).cast("int"))
    dealt = facts.join(keys, ["h1", "h2"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    many = alike.join(dealt.hint("merge"), ["h1", "h2", "part"], how).withColumn("again", F.explode(F.expr("sequence(1, n)")))
    return few.select(columns).unionByName(many.select(columns))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def running(xs: Column, start: Column, add: Callable[[Column, Column], Column], chunk: int = 64) -> Column:
    """For each place of an array, start plus all elements before it; add is associative. By chunks: of n elements n * chunk / 2 steps, and no copies."""
    fold = lambda part, first: F.aggregate(part, first, add)

    def by_chunks(parts: Column) -> Column:
        return bound(F.transform(parts, lambda c: fold(c, start)), lambda sums: F.flatten(F.transform(parts, lambda c, k: bound(fold(F.slice(sums, 1, k), start), lambda base: F.transform(c, lambda x, i: fold(F.slice(c, 1, i), base))))))

    cut = lambda ys: F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / chunk).cast("int")), lambda k: F.slice(ys, k * chunk + 1, chunk))
    return bound(xs, lambda ys: F.when(F.size(ys) > 0, bound(cut(ys), by_chunks)).otherwise(F.array().cast("array<int>")))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[s:e] for each run, from one prefix sum over the whole buffer."""
    t = mix64((codes.astype(np.uint64) + np.uint64(1)) * GOLD)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(t * powers(BASE, len(codes)), out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * powers(BASE_INV, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def in_chunks(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about `size` characters each; a longer text is a range of its own."""
    begin = total = 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
