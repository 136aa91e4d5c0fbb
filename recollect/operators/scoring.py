"""Exact target ranks and top-k of queries over a corpus, in a grid of query groups and corpus blocks, with exact bounds.

Ranks and top-k are additive over blocks of the corpus. Blocks are parts of clusters: items lie with the nearest of at most CENTRES
centres, which are fitted on a bounded sample, and a cluster's radius is measured over all its items. For a query of length 1, all
scores of a cluster lie within its radius of the score of its centre. If they all lie below the query's own score (that of its target)
the cluster adds nothing to the rank, if all lie above it adds its size; unless it may hold one of the k best, the query isn't sent
to it. A lower bound of the k-th best score is the k-th best of the sample, whose items are some of the corpus. Centres, radii, sizes
and sample are bounded, and go to where the queries are, so these decisions need no shuffle.

What is left open is dealt to cells, one for each block and group of queries, whose number follows queries times items; a query
that all of a block's items are above or below of is counted there without being scored; the others meet the block in a matrix product
in a Python worker, which returns counts and a local top-k, so that no (query, item) row is ever made. The product is made in single
precision, tile by tile: its error is bounded, and what it leaves undecided (scores near a query's own, and those that may be among its
best) is scored again in doubles. Scores are compared as whole billionths, ties go to the lower corpus index.

A query that several runs share (a state without memory is the same in all methods) is scored once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..sources.tables import written
from .joins import met

KEYS = ["run_id", "session_id", "turn"]
#: Keys of queries that are scored once for all their runs.
SHARED = ["runs", "session_id", "turn"]
#: Queries of a cell, items of a block, and scores that bounds are found from at once. What is sent is queries * items / ITEMS + items * queries / QUERIES vectors.
QUERIES, ITEMS, SCORES_AT_ONCE = 131_072, 65_536, 1 << 21
#: Queries and items of a tile of scores, which stays in a core's cache; TILE_ITEMS / 8 is at most 255 and whole.
TILE_QUERIES, TILE_ITEMS = 512, 512
#: So many times k new candidates a query, and the bound of the best is found anew from all that a tile's queries have.
TIGHTEN = 2
#: Pairs that are scored in doubles at once.
PAIRS = 1 << 15
#: Items that are one block and may be broadcast.
SINGLE = 4096
#: Items that centres are fitted on, and most centres.
SAMPLE, CENTRES = 4096, 256
SCALE = 1e9
#: More than what rounding moves a bound by.
MARGIN = 1e-7


@dataclass(frozen=True)
class Clusters:
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    sample: np.ndarray

    @property
    def blocks(self) -> list[int]:
        """Blocks of each cluster."""
        return [max(1, -(-int(n) // ITEMS)) for n in self.sizes]

    def decided(self, vectors: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items of clusters that are surely above each query's own score, which clusters are left open, and a lower bound of its k-th best score."""
        there = self.sizes > 0
        least = np.full(len(vectors), np.inf)
        if k:
            s = vectors @ self.sample.T
            least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(vectors), -np.inf)
        middle = vectors @ self.centres.T
        wanted, above, below = within(middle, self.radii, own[:, None], least[:, None])
        return ((above & ~wanted) * self.sizes).sum(1), there & (wanted | ~(above | below)), least


def within(middle: np.ndarray, radius: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether scores within radius of middle may be among the best, and are all above or all below own."""
    high, low = middle + radius + MARGIN, middle - radius - MARGIN
    return high >= least, low * SCALE > own + 1, high * SCALE < own - 1


def fitted(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n centres of the sample, by rounds of nearest centres and means from its first rows on."""
    centres = sample[:n].copy()
    for _ in range(rounds):
        at = nearest(sample, centres)[0]
        for k in range(len(centres)):
            if (at == k).any():
                centres[k] = sample[at == k].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and how far it is."""
    at = (-2 * (x @ centres.T) + (centres**2).sum(1)).argmin(1)
    return at, np.linalg.norm(x - centres[at], axis=1)


def matrix(rows: pa.Table | pa.RecordBatch, name: str, wide: int = 0) -> np.ndarray:
    v = rows[name] if isinstance(rows, pa.Table) else rows.column(rows.schema.get_field_index(name))
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.zeros((0, wide))


def clustered(items: DataFrame, n: int) -> tuple[DataFrame, Clusters]:
    """(corpus_idx, vector, cluster) of n items at rest, and the clusters."""
    picked = items.orderBy(F.xxhash64("corpus_idx"), "corpus_idx").limit(SAMPLE).select("vector").collect()
    sample = np.array([r.vector for r in picked]) if picked else np.zeros((0, 0))
    centres = fitted(sample, min(CENTRES, max(1, -(-n // ITEMS)))) if n else np.zeros((1, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SAMPLE):
                part = batch.slice(lo, SAMPLE)
                at, far = nearest(matrix(part, "vector"), centres)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("corpus_idx", "vector")), pa.array(at, pa.int32()), pa.array(far)], names=["corpus_idx", "vector", "cluster", "far"])

    placed = written(items.select("corpus_idx", "vector").mapInArrow(place, "corpus_idx long, vector array<double>, cluster int, far double"), "items")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # CENTRES rows
        sizes[r.cluster], radii[r.cluster] = r.n, r.far
    return placed.drop("far"), Clusters(centres, radii, sizes, sample)


def own_score() -> Column:
    return F.round(S.dot(F.col("vector"), F.col("t")) * SCALE).cast("long").alias("own")


def with_own(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Queries (of unit vectors) with own, the score of their target; targets that many queries share don't gather them."""
    target = items.select(F.col("corpus_idx").alias("target_index"), F.col("vector").alias("t"))
    keys = [c for c in queries.columns if c not in ("target_index", "vector")]
    return met(written(queries.select(*keys, "target_index", "vector"), "queries"), target, "target_index").select(*keys, "target_index", own_score(), "vector")


def opened(queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """Queries at rest, with sure (items of decided clusters that are above their own score), open (clusters that aren't decided) and least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = matrix(batch, "vector"), batch.column(batch.schema.get_field_index("own")).to_numpy()
            at_once = SCORES_AT_ONCE // SAMPLE
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                sure, open_, least = clusters.decided(vectors[lo : lo + at_once], own[lo : lo + at_once], k)
                counts = np.append(0, open_.sum(1).cumsum())
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.nonzero(open_)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sure), lists, pa.array(least)], names=[*part.schema.names, "sure", "open", "least"])

    more = T.StructType.fromDDL("sure long, open array<int>, least double")
    return written(queries.mapInArrow(run, T.StructType([*queries.schema.fields, *more.fields])), "open-queries")


TOP = "array<struct<minus:bigint,corpus_idx:bigint>>"
SCORES = f"runs array<string>, session_id long, turn int, greater long, before long, top {TOP}"
ROWS = pa.schema([("runs", pa.list_(pa.string())), ("session_id", pa.int64()), ("turn", pa.int32()), ("greater", pa.int64()), ("before", pa.int64()), ("top", pa.list_(pa.struct([("minus", pa.int64()), ("corpus_idx", pa.int64())])))])


def of_cluster(values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)


def exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Scores of pairs in whole billionths, summed in the vectors' order, as own_score sums."""
    out = np.zeros(len(row), np.int64)
    for lo in range(0, len(row) if x.shape[1] else 0, PAIRS):
        at = slice(lo, lo + PAIRS)
        out[at] = np.rint(np.cumsum(q[row[at]] * x[column[at]], axis=1)[:, -1] * SCALE)
    return out


def counted(mask: np.ndarray) -> np.ndarray:
    """How many of each row are set; bytes are added eight at once, which at most 255 sums of 0 and 1 can't overflow."""
    return mask.view(np.uint64).sum(1).view(np.uint8).reshape(len(mask), 8).sum(1).astype(np.int64)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is set, of which there is little: a row's parts are laid over each other, and places looked for where any has one."""
    words = mask.view(np.uint64)
    laid, parts = words, 1
    while parts < 8 and laid.shape[1] % 2 == 0:
        half = laid.shape[1] // 2
        laid, parts = laid[:, :half] | laid[:, half:], parts * 2
    row, word = np.divmod(np.flatnonzero(laid), laid.shape[1])
    there = words.reshape(len(words), parts, -1)[row, :, word]
    which, place = np.divmod(np.flatnonzero(there.view(np.bool_)), parts * 8)
    return row[which], (place // 8 * laid.shape[1] + word[which]) * 8 + place % 8


def tiles(q32: np.ndarray, x32: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of q32 and TILE_ITEMS rows of x32 after each other, in a buffer that is used again; columns from n on, which fill up words, are the least."""
    buffer = np.empty((len(q32), TILE_ITEMS), np.float32)
    for lo in range(0, n, TILE_ITEMS):
        part = x32[lo : lo + TILE_ITEMS]
        s = buffer if len(part) == TILE_ITEMS else np.empty((len(q32), len(part)), np.float32)
        np.matmul(q32, part.T, out=s)
        s[:, n - lo :] = -np.inf
        yield lo, s


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def likely(found: list[Found], n: int, k: int, slack: float) -> tuple[Found, np.ndarray]:
    """What may be among its row's k best of (row, column, score in single precision), rows from 0 to n - 1 in order, and each row's least such score."""
    row, column, near = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(row * 8.0 - near, kind="stable")
    row, column, near = row[order], column[order], near[order]
    starts, counts = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n)
    least = np.full(n, -np.inf)
    full = counts >= k
    least[full] = near[starts[full] + k - 1] - 2 * slack - MARGIN
    may = near >= least[row]
    return (row[may], column[may], near[may]), least


def best_of(found: list[Found], q: np.ndarray, x: np.ndarray, k: int, slack: float) -> Found:
    """(row, column, score) of each row's k best, ties to the lower column, of (row, column, score in single precision) that hold them."""
    (row, column, _), _ = likely(found, len(q), k, slack)
    s = exact(q, x, row, column)
    order = np.lexsort((column, -s, row))
    row, column, s = row[order], column[order], s[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], s[first]


def block_scores(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """Counts and the k best items of one block for each query.

    The product gives scores less a query's own, which vectors have as a component more, so that a tile is compared with one number.
    """
    keys = [queries[c].combine_chunks() for c in SHARED]
    idx = items["corpus_idx"].to_numpy()
    order = np.argsort(idx)
    idx, x = idx[order], matrix(items, "vector")[order]
    q, own, target, least = matrix(queries, "vector"), *(queries[c].to_numpy() for c in ("own", "target_index", "least"))
    centre = x.mean(0)
    wanted, above, below = within(q @ centre, np.linalg.norm(x - centre, axis=1).max(), own, least)
    greater, before = np.where(above & ~wanted, len(idx), 0), np.zeros(len(q), np.int64)
    minus, best, sizes = [], [], np.zeros(len(q), np.int64)
    x32 = np.zeros((-(-len(idx) // 8) * 8, x.shape[1] + 1), np.float32)
    x32[: len(idx), :-1], x32[:, -1] = x, 1
    slack = 2 * (x.shape[1] + 8) * 2.0**-24  # the most that a score of vectors of length 1 less another, and a bound, lose in single precision
    band = np.float32(1 / SCALE + slack)
    ahead = np.maximum(least - own / SCALE - 2 * MARGIN - slack, np.finfo(np.float32).min).astype(np.float32)  # MARGIN twice, as it is rounded
    rows = np.flatnonzero(wanted | ~(above | below))
    for start in range(0, len(rows), TILE_QUERIES):
        at = rows[start : start + TILE_QUERIES]
        mine, over_own, floor = q[at], np.zeros(len(at), np.int64), ahead[at]
        near, found, new = [], [], 0
        for lo, s in tiles(np.column_stack([mine, -own[at] / SCALE]).astype(np.float32), x32, len(idx)):
            over = s > band
            over_own += counted(over)
            odd = over ^ (s >= -band)
            if k:
                if not lo and s.shape[1] > k and not np.isfinite(least[at]).all():
                    floor = np.maximum(floor, np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] - np.float32(2 * slack + MARGIN))
                odd |= s >= floor[:, None]
            row, column = places(odd)
            score = s[row, column]
            undecided = np.abs(score) <= band
            near.append((row[undecided], column[undecided] + lo))
            if k:
                may = score >= floor[row]
                found.append((row[may], column[may] + lo, score[may]))
                new += len(found[-1][0])
                if new > TIGHTEN * k * len(at):
                    kept, reached = likely(found, len(at), k, slack)
                    found, new, floor = [kept], 0, np.maximum(floor, (reached - MARGIN).astype(np.float32))
        row, column = (np.concatenate(part) for part in zip(*near, strict=True))
        s, goal = exact(mine, x, row, column), target[at][row]
        greater[at] = over_own + np.bincount(row[(s > own[at][row]) & (idx[column] != goal)], minlength=len(at))
        before[at] = np.bincount(row[(s == own[at][row]) & (idx[column] < goal)], minlength=len(at))
        if k:
            row, column, s = best_of(found, mine, x, k, slack)
            sizes[at] = np.bincount(row, minlength=len(at))
            minus.append(-s)
            best.append(idx[column])
    none = np.zeros(0, np.int64)
    lists = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *minus])), pa.array(np.concatenate([none, *best]))], names=["minus", "corpus_idx"])
    return pa.table([*keys, pa.array(greater), pa.array(before), pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), lists)], names=ROWS.names)


def scores(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(run_id, session_id, turn, greater, before, top), a row for each query; queries have unit vectors. k may be 0, for ranks alone."""
    spark = queries.sparkSession
    queries = queries.groupBy("session_id", "turn", "target_index", "vector").agg(F.sort_array(F.collect_set("run_id")).alias("runs"))
    items, size = corpus.select("corpus_idx", S.unit(F.col("vector")).alias("vector")), corpus.count()
    if size <= min(ITEMS, SINGLE):
        # one block, to which all queries are sent: nothing is to be decided before, and its vectors may be broadcast
        items, blocks = written(items.withColumn("cluster", F.lit(0)), "items"), [1]
        near = F.broadcast(items.select(F.col("corpus_idx").alias("target_index"), F.col("vector").alias("t")))
        undecided = F.lit(0).cast("long").alias("sure"), F.array(F.lit(0)).alias("open"), F.lit(float("-inf")).alias("least")
        q = written(queries.join(near, "target_index").select(*SHARED, "target_index", own_score(), "vector", *undecided), "open-queries")
    else:
        items, clusters = clustered(items, size)
        q, blocks = opened(with_own(queries, items), clusters, k), clusters.blocks
    n = q.count()
    groups = max(1, -(-n // QUERIES), min(-(-2 * spark.sparkContext.defaultParallelism // sum(blocks)), -(-n // 64)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * groups * sum(blocks), 4 * spark.sparkContext.defaultParallelism))
    cell = ["cluster", "block", "group"]
    sent = q.select(*SHARED, "target_index", "own", "least", "vector", F.explode("open").alias("cluster"), F.pmod(F.xxhash64(*SHARED), F.lit(groups)).alias("group")).withColumn("block", F.explode(F.sequence(F.lit(0), of_cluster(blocks) - 1)))
    kept = items.withColumn("block", F.pmod(F.xxhash64("corpus_idx"), of_cluster(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_scores(a, b, k) if a.num_rows and b.num_rows else ROWS.empty_table()

    met_ = sent.repartition(tasks, *cell).groupBy(*cell).cogroup(kept.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(run, SCORES)
    sure = q.select(*SHARED, F.col("sure").alias("greater"), F.lit(0).cast("long").alias("before"), F.array().cast(TOP).alias("top"))
    top = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    one = met_.unionByName(sure).repartition(tasks, *SHARED).groupBy(*SHARED).agg(F.sum("greater").alias("greater"), F.sum("before").alias("before"), top)
    return written(one.select(F.explode("runs").alias("run_id"), *SHARED[1:], "greater", "before", "top"), "scores")


def target_ranks(scored: DataFrame) -> DataFrame:
    """(run_id, session_id, turn, rank), from 0."""
    return scored.select(*KEYS, (F.col("greater") + F.col("before")).alias("rank"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(run_id, session_id, turn, position, corpus_idx), positions from 0."""
    return scored.select(*KEYS, F.posexplode("top").alias("position", "item")).where(F.col("position") < k).select(*KEYS, "position", "item.corpus_idx")


#: Queries and items that meet in a row of native_ranks, and those of a cell, which its rows are made from. What is sent is queries * items / NATIVE_CELL_ITEMS + items * queries / NATIVE_CELL_QUERIES vectors.
NATIVE_QUERIES, NATIVE_ITEMS = 64, 1024
NATIVE_CELL_QUERIES, NATIVE_CELL_ITEMS = 16_384, 16_384
#: Components of vectors whose true scores are written out in the generated code, which has to stay below the 8000 bytes that the JVM compiles.
NATIVE_WIDE = 64
#: Most pairs of planes that a score is bounded by, beside written out scores and without them, for the same reason.
NATIVE_TERMS = {True: 25, False: 81}
#: The rows of pairs have more fields than Spark makes code for by default, and their loops more variables than the JVM compiles as arguments.
NATIVE_CONF = {"spark.sql.codegen.maxFields": "400", "spark.sql.codegen.splitConsumeFuncByOperator": "false"}


def coded(vector: Column, width: int, bits: int) -> Column:
    """A vector without nulls, filled up to width by zeros, in whole numbers of so many bits each.

    scale and sum lead from whole numbers back to components; far is how far the vector so made lies from the true one at most. A plane
    is one bit of the whole numbers of 64 components.
    """
    top = float(2**bits - 1)
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  once a vector, not once a component
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda k: F.coalesce(F.get(vector, k), F.lit(0.0)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def plane(whole: Column, bit: int, lo: int) -> Column:
        each = F.transform(F.slice(whole, lo + 1, 64), lambda x, k: F.call_function("shiftleft", F.shiftright(x, bit).bitwiseAND(F.lit(1).cast("long")), k))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    def of_whole(v: Column, scale: Column, whole: Column) -> Column:
        apart = F.zip_with(v, whole, lambda x, n: x - scale * (n * F.lit(2 / top) - 1))
        planes = [plane(whole, bit, lo).alias(f"plane{lo // 64}_{bit}") for lo in range(0, max(width, 1), 64) for bit in range(bits)]
        numbers = {"scale": scale, "sum": total(F.transform(whole, lambda n: n.cast("double"))) * F.lit(2 / top), "far": S.norm(apart)}
        return F.struct(*(c.alias(name) for name, c in numbers.items()), *planes)

    def of_scale(v: Column, scale: Column) -> Column:
        return bound(F.transform(v, lambda x: F.floor((x / scale + 1) * F.lit(top / 2) + 0.5)), lambda whole: of_whole(v, scale, whole))

    return bound(filled, lambda v: bound(F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(1e-300)), lambda scale: of_scale(v, scale)))


def rounded_from(n: Column) -> Column:
    """The least double that rounds to the whole number n; halves are rounded away from 0."""
    return F.when(n > 0, n - 0.5).otherwise((n - 0.5) * F.lit(1 - 2.0**-53))  # the factor leads to the next double towards 0


def bounded(one: Callable[[str], Column], other: Callable[[str], Column], width: int, bits: int) -> tuple[Column, Column]:
    """The score of two coded vectors, from the numbers of bits that their planes share, and how far it is from the true one at most, if those have length 1."""
    top, wide = float(2**bits - 1), max(width, 1)
    shared = F.lit(0.0)
    for both in range(2 * bits - 1):
        pairs = [(lo // 64, i, both - i) for lo in range(0, wide, 64) for i in range(bits) if 0 <= both - i < bits]
        counts = [F.bit_count(one(f"plane{c}_{i}").bitwiseAND(other(f"plane{c}_{j}"))).cast("double") for c, i, j in pairs]
        shared = shared + reduce(lambda s, x: s + x, counts) * F.lit(4 / top**2 * 2.0**both)
    score = one("scale") * other("scale") * (shared - (one("sum") + other("sum")) + F.lit(float(wide)))
    return score, one("far") + other("far") + one("far") * other("far") + F.lit(MARGIN)


@contextmanager
def set_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def native_ranks(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same ranks by column functions: packed queries meet packed items in a row, and each query's counts come from its pairs.

    Packs lie in cells, and all of a cell's packs meet each other in a merge join: a pack is sent once a cell, not once a pack that it meets.
    Vectors go with a code in whole numbers of a few bits, from whose planes a pair's score is bounded by counts of bits. A pair that the bound
    leaves open is scored in doubles, by sums written out in generated code or, for wide vectors and those of several lengths, by higher-order
    functions, which take some fifty times as long.
    """
    spark = queries.sparkSession
    items = written(corpus.select("corpus_idx", S.unit(F.col("vector")).alias("vector")), "items")
    q = written(with_own(queries, items), "own-queries")
    # a vector without a score is ahead of none: what lacks one, or a component, is left out
    whole = items.where(F.col("corpus_idx").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    facts = whole.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(~S.finite(F.col("vector"))).alias("odd")).first()
    if facts.odd:
        raise ValueError(f"{facts.odd} vectors of the corpus have components that are not finite")
    m, n, width = q.count(), facts.n, facts.most or 1
    flat = facts.least == facts.most and 0 < width <= NATIVE_WIDE
    bits = max(1, math.isqrt(NATIVE_TERMS[flat] // -(-width // 64)))
    blocks = max(1, -(-n // NATIVE_CELL_ITEMS))
    parts = max(1, -(-m // NATIVE_CELL_QUERIES), min(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-m // NATIVE_QUERIES)))

    def packed(df: DataFrame, by: list[str], size: int, rows: int, cell: str, cells: int) -> DataFrame:
        """Rows in packs of about size, each pack in one of the cells."""
        packs = cells * max(1, -(-rows // (cells * size)))
        df = df.withColumn("code", coded(F.col("vector"), width, bits)).select(*df.columns, "code.*")
        if flat:
            df = df.select("*", *(F.get("vector", F.lit(k)).alias(f"at{k}") for k in range(width))).drop("vector")
        none = {"bigint": F.lit(0).cast("long"), "double": F.lit(0.0)}  # there are no nulls, which Spark is told so
        row = F.struct(*(F.coalesce(c, none[kind]).alias(c) if kind in none and c not in KEYS else F.col(c) for c, kind in df.dtypes))
        return df.groupBy(F.pmod(F.xxhash64(*by), F.lit(packs)).alias("pack")).agg(F.collect_list(row).alias(f"{cell}s")).withColumn(cell, F.pmod("pack", F.lit(cells)).cast("int")).drop("pack")

    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = q.where("own IS NOT NULL AND target_index IS NOT NULL").withColumns({"ties": rounded_from(F.col("own")), "above": rounded_from(F.col("own") + 1)}).drop("own")
    sent = packed(asked, KEYS, NATIVE_QUERIES, m, "part", parts).select("*", each("block", blocks))
    met_ = packed(whole, ["corpus_idx"], NATIVE_ITEMS, n, "block", blocks).select("*", each("part", parts))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * parts * blocks, 32 * spark.sparkContext.defaultParallelism))
    both = sent.repartition(tasks, "block", "part").join(met_.repartition(tasks, "block", "part").hint("merge"), ["block", "part"])
    one = both.select("blocks", F.inline("parts"))
    one = one.select("blocks", *(F.col(c).alias(c if c in KEYS else f"q_{c}") for c in one.columns if c != "blocks"))
    pairs = one.select(*(c for c in one.columns if c != "blocks"), F.inline("blocks"))
    score, far = bounded(lambda c: F.col(f"q_{c}"), F.col, width, bits)
    open_ = pairs.where((F.col("corpus_idx") != F.col("q_target_index")) & ((score + far) * SCALE >= F.col("q_ties")))
    goal = F.when(F.col("corpus_idx") < F.col("q_target_index"), F.col("q_ties")).otherwise(F.col("q_above"))
    if flat:
        ahead = reduce(lambda s, k: s + F.col(f"q_at{k}") * F.col(f"at{k}"), range(width), F.lit(0.0)) * SCALE >= goal
        counted = open_.where(ahead).groupBy(*KEYS).agg(F.count("*").alias("ahead"))
    else:
        sure = (F.size("q_vector") == F.size("vector")) & ((score - far) * SCALE >= F.col("q_above"))
        ahead = S.dot(F.col("q_vector"), F.col("vector")) * SCALE >= goal
        counted = open_.select(*KEYS, F.when(sure, 1).when(ahead, 1).otherwise(0).alias("ahead"))
    ranks = q.select(*KEYS, F.lit(0).cast("long").alias("ahead")).unionByName(counted).groupBy(*KEYS).agg(F.sum("ahead").cast("long").alias("rank"))
    with set_conf(spark, NATIVE_CONF):
        return written(ranks, "native-ranks")


def rank_table(ranks: DataFrame, states: DataFrame) -> DataFrame:
    """The ranks of all runs, proven to be matrices: each run has every state once, all sessions as many turns, and each a target."""
    turns = states.groupBy("session_id").agg(F.count("*").alias("t"), F.count("target_index").alias("g"))
    facts = turns.agg(F.count_distinct("t").alias("lengths"), F.count_if(F.col("g") < F.col("t")).alias("no_target"), F.sum("t").alias("states")).first()
    if facts.lengths != 1 or facts.no_target:
        raise ValueError(f"{facts.lengths} numbers of turns a session, {facts.no_target} sessions without a target")
    lone = ranks.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("session_id", "turn").alias("d"))
    odd = lone.where((F.col("n") != facts.states) | (F.col("d") != facts.states)).select("run_id").limit(5).collect()
    if odd:
        raise ValueError(f"runs without one rank for each state: {sorted(r.run_id for r in odd)}")
    return ranks.select(*KEYS, "rank")
