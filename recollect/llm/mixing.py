"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are shuffled by a hash and laid end to end, and cut into blocks of BLOCK words. Slots of the
schedule carry golden-ratio points; a point falls into a source's part of the cumulative weights. The r-th slot of a source
takes its block r, and begins anew after its last block. A source gets slots until its target is met, and its last slot is
cut there; where discrepancy leaves it a few slots short, they follow at the schedule's end.

Ranks and word offsets are prefix sums on three levels (within small groups, over groups, over groups of groups), so that a
source with a third of all rows is no one task's.

Null texts have size 0; a null source is a source of its own, the last. Documents of size 0 are never taken. Rows that stand
twice are two documents; among rows alike in key, source and size it is not told which words belong to which. Documents longer
than a block lie in several. Columns of the caller pass through `mixed` whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_counts, meet, nested, written

#: Cells into which the unit interval is cut so that points meet shares in an equi-join.
CELLS = 256
UNIT = 1 << 31
#: The odd number next to UNIT divided by the golden ratio.
STEP = 1327217885
#: Sources up to this many are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by the order of sources, repeating
    share: float = 1.5  # of all words
    most: int = 2  # times a source may be used
    block: int = 2048
    group: int = 1024  # rows of a lowest prefix-sum group
    seed: int = 11


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def before(df: DataFrame, keys: list[str], group: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """For a table of (keys, group): the sum of value over the smaller groups of the same keys, by way of groups of groups."""
    df = df.withColumn("_up", F.expr(f"{group} div {fan}"))
    up = df.groupBy(*keys, "_up").agg(F.sum(value).alias("_v"))
    up = up.withColumn("_base", F.sum("_v").over(W.partitionBy(*keys).orderBy("_up")) - F.col("_v")).drop("_v")
    inner = F.sum(value).over(W.partitionBy(*keys, "_up").orderBy(group)) - F.col(value)
    return df.withColumn("_in", inner).join(up.hint("merge"), [*keys, "_up"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", "_up")


def targets(sizes: DataFrame, p: Params) -> DataFrame:
    """A row for each source: its number, size, target and slots. One row a source passes through a single task here."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, p.weights)), (F.col("source_no") % len(p.weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(p.most)).withColumn("total", F.sum("source_size").over(W.partitionBy()) * p.share)
    by = W.orderBy(F.col("cap") / F.col("w"), "source_no")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", level).withColumn("n", F.row_number().over(by))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w") * (1 + 1e-12), F.col("n"))
    s = s.withColumn("level", F.min_by("level", free).over(W.partitionBy()))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))))
    s = s.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * p.most))
    s = s.withColumn("blocks", F.expr(f"(source_size + {p.block - 1}) div {p.block}")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    s = s.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("slots", (F.col("epochs") * F.col("blocks") + F.expr(f"(rest + {p.block - 1}) div {p.block}")).cast("long"))
    return s.select("source", "source_no", "source_size", "target", "quota", "blocks", "epochs", "rest", "slots")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df.hint("merge")


def schedule(sources: DataFrame, p: Params = Params()) -> DataFrame:
    """(slot, source_no, rank): which source each slot draws from, and how many slots it had before."""
    spark = sources.sparkSession
    n_sources, n = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    to = F.sum("slots").over(W.orderBy("source_no"))
    parts = sources.where("slots > 0").withColumns({"hi": F.floor(to / F.lit(float(max(1, n))) * UNIT), "lo": F.floor((to - F.col("slots")) / F.lit(float(max(1, n))) * UNIT)})
    parts = parts.where("hi > lo").select("source_no", "slots", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {UNIT // CELLS}"), F.expr(f"(hi - 1) div {UNIT // CELLS}"))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id") + p.seed, F.lit(UNIT)) * STEP, F.lit(UNIT)).alias("u"))
    points = points.withColumn("cell", F.expr(f"u div {UNIT // CELLS}"))
    drawn = points.join(bounded(parts, n_sources + CELLS), "cell").where("lo <= u AND u < hi").select("slot", "source_no", "slots", F.expr(f"slot div {p.group}").alias("chunk"))
    drawn = written(drawn, "mix-drawn")  # used three times: else each would broadcast the parts anew, at once, into the driver's memory
    counts = before(drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("c")), ["source_no"], "chunk", "c", "base")
    inner = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("_in", inner).join(counts.select("source_no", "chunk", "base").hint("merge"), ["source_no", "chunk"])
    ranked = ranked.withColumn("rank", F.col("_in") + F.col("base")).where("rank < slots").select("slot", "source_no", "rank")
    got = drawn.groupBy("source_no").agg(F.count("*").alias("got"))
    short = sources.join(got.hint("merge"), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = short.select("source_no", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank"))
    return ranked.unionByName(late.select((F.lit(n) + F.col("rank")).alias("slot"), "source_no", "rank"))


def mix(docs: DataFrame, p: Params = Params(), key: str = "doc_id") -> DataFrame:
    """(key, source, size) rows to (key, size, source_size, target, taken); key may be a struct. docs' sizes should be cheap to read twice."""
    sources = written(targets(docs, p), "mix-sources")
    n_sources, n = sources.count(), docs.count()
    groups = max(1, n // p.group)
    own = docs.select(F.col(key).alias("_key"), "source", "size").join(bounded(sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target"), n_sources), F.col("source").eqNullSafe(F.col("_source")))
    own = own.select("_key", "size", "source_no", "source_size", "target").withColumn("_order", F.xxhash64(F.lit(p.seed), F.col("_key")))
    own = written(own.withColumn("_group", F.expr(f"shiftrightunsigned(_order, 33) * {groups} div {1 << 31}")), "mix-own")  # used three times, as drawn is
    offsets = before(own.groupBy("source_no", "_group").agg(F.sum("size").alias("v")), ["source_no"], "_group", "v", "base").select("source_no", "_group", "base")
    # rows alike in key, source and size are laid as one run, so that an id of many rows is no window's
    runs = own.where("size > 0").groupBy("source_no", "_group", "_order", "_key", "size", "source_size", "target").agg(F.count("*").alias("_n"))
    long = F.col("size") * F.col("_n")
    run = F.sum(long).over(W.partitionBy("source_no", "_group").orderBy(F.shiftrightunsigned("_order", 33), "_order", "_key", "size").rowsBetween(W.unboundedPreceding, 0)) - long
    laid = runs.withColumn("_in", run).join(offsets.hint("merge"), ["source_no", "_group"]).withColumn("_at", F.explode(F.expr("sequence(0, _n - 1)")))
    laid = laid.withColumn("start", F.col("_in") + F.col("base") + F.col("_at") * F.col("size"))
    b = p.block
    pieces = laid.select("_key", "size", "source_no", "source_size", "target", "start", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
    pieces = pieces.withColumns({"lo": F.greatest(F.lit(0), F.col("start") - F.col("block") * b), "hi": F.least(F.lit(b), F.col("start") + F.col("size") - F.col("block") * b)})
    slots = schedule(sources, p).join(bounded(sources.select("source_no", "blocks", "epochs", "rest"), n_sources), "source_no")
    slots = slots.select("source_no", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch"), "epochs", "rest")
    slots = slots.select("source_no", "block", F.when(F.col("epoch") < F.col("epochs"), F.lit(b)).otherwise(F.least(F.lit(b), F.col("rest") - F.col("block") * b)).alias("limit"))
    met = pieces.join(slots.hint("merge"), ["source_no", "block"], "left")
    words_taken = F.greatest(F.lit(0), F.least("hi", "limit") - F.col("lo"))
    taken = met.groupBy("source_no", "start", "_key", "size", "source_size", "target").agg(F.sum(F.coalesce(F.when(F.col("limit").isNotNull(), words_taken), F.lit(0))).cast("long").alias("taken"))
    columns = [F.col("_key").alias(key), "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(own.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs (doc_id, text, source and others), each row as often as the mix takes its words, to the nearest whole number.

    Rows alike in id, text and source share what is taken of them: each stands as often as their mean share says.
    """
    keyed = nested(docs).select("row", F.struct("h1", "h2", F.xxhash64("row.source").alias("h3")).alias("key"))
    sizes = written(keyed.select("key", "row.source", words(F.col("row.text")).alias("size")), "mix-sizes")
    taken = mix(sizes, p, "key").groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = taken.where("size > 0").select("key", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    copies = written(copies, "mix-copies")
    # the source is part of the row, so that a key of (h1, h2) may have several sources
    by_source = keyed.select("row", "key.h1", F.expr("key.h2 ^ key.h3").alias("h2"))
    facts = copies.select("key.h1", F.expr("key.h2 ^ key.h3").alias("h2"), "copies")
    met = meet(by_source, facts, hash_counts(sizes.select("key.h1", F.expr("key.h2 ^ key.h3").alias("h2"))))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
