"""N-gram Jaccard self-join by rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct `words`-word shingles (lower-cased A-Z, words between white space), hashed to 64 bits; equal sets
form a class, and classes alone are joined. All sets are sorted rare-first by one order: how many documents hold the shingle, then
its number. Of n shingles, the first n - ceil(num * n / den) + 1 are the prefix; two linked sets share one of their prefixes. So
classes are joined on prefix shingles that stand in two classes or more, after

* the length filter: the smaller set has num / den of the larger one's size or more;
* the positional filter: from the first shared prefix shingle on, the rest of both sets is long enough;
* the suffix filter: shingles are counted in `parts` parts of the order's numbers (halved five times), and what the parts differ by, with
  the shingles that stand nowhere else, leaves room for the intersection that a link needs.

Candidates that pass are verified exactly on full sets. A prefix shingle's classes are compared with its hub first, the class that
shares most prefix shingles; links to hubs give components, and only members of other components than the hub's go on, against the
hub's neighbourhood, in cells whose side grows with its root. A pair is a candidate once: at the hub of the least number that both have.

Frequencies are counted in one shuffle of packed shingles: a chunk of texts sends 4 bytes a shingle and 2 for its place, dealt to
buckets by the hash's upper half; the lower half stands for the shingle there. Shingles that share a number only look more frequent
and make more candidates; they lose none. Shingles of more than `crowd` documents, found by their counts within chunks, don't gather
in their bucket: they are told to be frequent without being dealt. A bucket's answer, the shingles that stand in several documents,
goes back to the chunk, where each text's prefix is made. Chunks are written before they are dealt, so that a lost executor's work is
redone alike.

Null and empty texts, and those of white space alone, have no set and are linked with nothing. Texts of fewer words have their whole
sequence as their one shingle. Rows that stand twice are one class. A null id is no component's id, unless no document of the
component has one. Texts of any length are taken whole. Columns of the caller pass through whatever their names; those named like a
result give way to it. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, in_chunks, mix64, spread_join, written
from .near_dup import alike, by_cell, cell_links, column, components, confirmed, fixed, in_cells, sets_of, shingle_sets
from .near_dup import Params as Shingles


@dataclass(frozen=True)
class Params(Shingles):
    words: int = 4
    num: int = 85
    den: int = 100
    parts: int = 32  # of the suffix filter; a power of two
    chunk: int = 1 << 20  # characters that are packed together
    bucket: int = 1 << 24  # characters whose shingles meet in a bucket, on average
    least_buckets: int = 256
    crowd: int = 1 << 18  # documents of a shingle, and one in CROWDS of all, beyond which it isn't dealt
    seen: int = 4  # documents of a chunk from which on its count is told

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n + (-self.num * n // self.den) + 1

    def needed(self, both: np.ndarray) -> np.ndarray:
        """Shingles that two sets must share whose sizes sum to `both`."""
        return -(-self.num * both // (self.num + self.den))


CROWDS = 1024


def binaries(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The runs of values that begin at firsts, as a binary column."""
    raw = np.ascontiguousarray(values)
    offsets = np.append(firsts, len(raw)) * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def numbers(column_: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    rows = column_.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which come sorted; a key may lie in several batches."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = column(batch, key).to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and own != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            own = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chunked(docs: DataFrame, buckets: int, p: Params) -> DataFrame:
    """docs without text, with n_shingles, cls (16 bytes of the set's hash; null if empty), chunk and idx; and beside them, for each
    chunk and bucket, the shingles' lower halves, and by idx whose they are; and shingles that several texts of a chunk hold, with their number."""
    taken = [c for c in docs.columns if c != "text"]
    extra = {"n_shingles": T.LongType(), "cls": T.BinaryType(), "chunk": T.LongType(), "idx": T.IntegerType(), "bucket": T.IntegerType(), "docs": T.BinaryType(), "low": T.BinaryType(), "token": T.LongType(), "count": T.LongType()}
    arrow = dict(zip(extra, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True))
    schema = T.StructType([*(T.StructField(docs.schema[c].name, docs.schema[c].dataType) for c in taken), *(T.StructField(n, t) for n, t in extra.items())])

    def rows(kinds: dict[str, pa.DataType], n: int, **there: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([there[c] if c in there else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            kinds = {c: column(batch, c).type for c in taken} | arrow
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            for lo, hi in ((k, min(hi, k + 65536)) for lo, hi in in_chunks(texts, p.chunk) for k in range(lo, hi, 65536)):
                h, starts = shingle_sets(texts[lo:hi], p)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                cls, own = pa.nulls(hi - lo, pa.binary()), np.zeros(hi - lo, bool)
                if len(full):
                    both = np.stack([np.add.reduceat(mix64(h ^ np.uint64(s)), starts[:-1][full]) for s in (1, 2)], 1)
                    place = np.full(hi - lo, -1)
                    place[full] = np.arange(len(full))
                    cls = fixed(both).take(pa.array(place, mask=place < 0))
                    own[full[np.unique(both, axis=0, return_index=True)[1]]] = True  # of equal sets, one is packed
                yield rows(kinds, hi - lo, **{c: column(batch, c).slice(lo, hi - lo) for c in taken}, n_shingles=pa.array(n), cls=cls, chunk=pa.array(np.full(hi - lo, chunk)), idx=pa.array(np.arange(hi - lo, dtype=np.int32)))
                packed = np.repeat(own, n)
                h, of = h[packed], np.repeat(np.arange(hi - lo, dtype=np.uint16), n)[packed]
                if len(h):
                    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 65536 else np.int64)
                    order = np.argsort(bucket, kind="stable")
                    bucket, low = bucket[order].astype(np.int32), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
                    first = np.flatnonzero(np.diff(bucket, prepend=-1))
                    yield rows(kinds, len(first), chunk=pa.array(np.full(len(first), chunk)), bucket=pa.array(bucket[first]), docs=binaries(of[order], first), low=binaries(low, first))
                    token, count = np.unique(bucket.astype(np.int64) << 32 | low, return_counts=True)
                    often = count >= p.seen
                    yield rows(kinds, int(often.sum()), token=pa.array(token[often]), count=pa.array(count[often]))
                chunk += 1

    return docs.mapInArrow(run, schema)


SHARED = "chunk long, bucket int, docs binary, low binary, df binary"


def answer(chunk: np.ndarray, bucket: np.ndarray, docs: np.ndarray, low: np.ndarray, df: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    """The kept shingles of each row that has any."""
    left = np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64)
    first = (np.cumsum(left) - left)[left > 0]
    columns = [pa.array(chunk[left > 0]), pa.array(bucket[left > 0]), *(binaries(x[kept], first) for x in (docs, low, df))]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "docs", "low", "df"])


def shared(packed: DataFrame, crowds: dict[int, int]) -> DataFrame:
    """(chunk, bucket, docs, low, df): the shingles that stand in several packed sets, and in how many. crowds: those that aren't dealt."""
    rows = packed.where("bucket IS NOT NULL").select("chunk", "bucket", "docs", "low")
    known = np.array(sorted(crowds), np.int64)
    sums = np.array([crowds[k] for k in known.tolist()], np.int64)

    def split(few: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, sizes = numbers(column(batch, "low"), np.uint32)
                docs, _ = numbers(column(batch, "docs"), np.uint16)
                chunk, bucket = (column(batch, c).to_numpy() for c in ("chunk", "bucket"))
                if not len(low):
                    continue
                token = np.repeat(bucket, sizes).astype(np.int64) << 32 | low
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                yield answer(chunk, bucket, docs, low, np.minimum(sums[at], 2**32 - 1).astype(np.uint32), sizes, (known[at] == token) != few)

        return run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "bucket"):
            low, sizes = numbers(t["low"], np.uint32)
            docs, _ = numbers(t["docs"], np.uint16)
            order = np.argsort(low)
            first = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
            many = np.diff(np.append(first, len(low)))
            df = np.empty(len(low), np.uint32)
            df[order] = np.repeat(many, many)
            yield answer(t["chunk"].to_numpy(), t["bucket"].to_numpy(), docs, low, df, sizes, df > 1)

    dealt = rows.mapInArrow(split(True), SHARED).drop("df") if crowds else rows
    out = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, SHARED)
    return out.unionByName(rows.mapInArrow(split(False), SHARED)) if crowds else out


def prefixes(found: DataFrame, packed: DataFrame, p: Params) -> DataFrame:
    """(cls, n, single, prefix, hist) of the sets that may have a partner, once or more a class.

    single shingles stand nowhere else and begin the order; prefix holds those of the others that stand in the prefix, rare-first;
    hist counts all others by part.
    """
    facts = packed.where("cls IS NOT NULL").select("chunk", F.lit(None).cast("int").alias("bucket"), *(F.lit(None).cast("binary").alias(c) for c in ("docs", "low", "df")), "idx", F.col("n_shingles").alias("n"), "cls")
    both = found.select("*", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("cls")).unionByName(facts)
    shift = np.uint32(32 - (p.parts - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "chunk"):
            told = t.filter(t["idx"].is_valid())
            t = t.filter(t["bucket"].is_valid())
            if not len(t) or not len(told):
                continue
            idx = told["idx"].to_numpy()
            n = np.zeros(int(idx.max()) + 1, np.int64)
            n[idx] = told["n"].to_numpy()
            low, sizes = numbers(t["low"], np.uint32)
            doc, df = numbers(t["docs"], np.uint16)[0].astype(np.int64), numbers(t["df"], np.uint32)[0]
            count = np.bincount(doc, minlength=len(n))
            may = (count > 0) & (n - count < p.prefix(n))
            here = may[doc]
            if not here.any():
                continue
            doc, df, low, token = doc[here], df[here], low[here], (np.repeat(t["bucket"].to_numpy(), sizes).astype(np.int64) << 32 | low)[here]
            order = np.lexsort((token, df, doc))
            docs = np.flatnonzero(may)
            row = (np.cumsum(may) - 1)[doc]
            hist = np.bincount(row * p.parts + (low >> shift), minlength=len(docs) * p.parts).astype(np.uint32).reshape(-1, p.parts)
            first = np.cumsum(count[docs]) - count[docs]
            at = np.arange(len(order)) - np.repeat(first, count[docs]) + np.repeat((n - count)[docs], count[docs])
            inside = at < np.repeat(p.prefix(n)[docs], count[docs])
            size = np.add.reduceat(inside, first, dtype=np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(token[order][inside]))
            place = np.empty(len(n), np.int64)
            place[idx] = np.arange(len(idx))
            yield pa.RecordBatch.from_arrays([told["cls"].combine_chunks().take(pa.array(place[docs])), pa.array(n[docs]), pa.array((n - count)[docs]), prefix, fixed(hist)], names=["cls", "n", "single", "prefix", "hist"])

    return both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "cls binary, n long, single long, prefix array<long>, hist binary")


class Side:
    """The sets of one side of a comparison."""

    def __init__(self, t: pa.Table | pa.RecordBatch, name: Callable[[str], str] = str):
        get = lambda c: x.combine_chunks() if isinstance(x := t[name(c)], pa.ChunkedArray) else x
        self.n, self.single = get("n").to_numpy(), get("single").to_numpy()
        lists = get("prefix")
        self.sizes = np.asarray(lists.value_lengths())
        self.tokens = np.asarray(lists.flatten())
        self.of = np.repeat(np.arange(len(self.n)), self.sizes)
        at = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.rest = self.n[self.of] - self.single[self.of] - at  # shingles from this one on
        raw = get("hist").to_pylist()
        self.hist = np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), -1).astype(np.int64)


def near_stars(stars: DataFrame, p: Params) -> DataFrame:
    """(hub, no) of the star rows, with the facts of both, that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = Side(batch), Side(batch, lambda c: f"hub_{c}")
            # rows meet their own row alone: shingles are paired by row and number
            key = [np.rec.fromarrays([x.of, x.tokens]) for x in (a, b)]
            _, i, j = np.intersect1d(*key, return_indices=True)
            rest = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(rest, a.of[i], np.minimum(a.rest[i], b.rest[j]))
            both = a.n + b.n
            room = (both - a.single - b.single - np.abs(a.hist - b.hist).sum(1)) // 2
            near = pa.array(np.minimum(rest, room) >= p.needed(both))
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(near) for c in ("hub", "no")], names=["hub", "no"])

    return stars.mapInArrow(run, "hub long, no long")


def groups(values: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Places in `of` by value, for the wanted values."""
    at = np.flatnonzero(np.isin(values, wanted))
    order = at[np.argsort(values[at], kind="stable")]
    first = np.flatnonzero(np.diff(values[order], prepend=values[order[0]] - 1 if len(order) else 0))
    return {int(values[x[0]]): x for x in np.split(order, first[1:])} if len(order) else {}


def partnered(members: DataFrame, p: Params) -> DataFrame:
    """The (hub, no, comp, apart) of members with a candidate of another component; they have m, u, hubs and the facts too."""
    tile = 1024

    def work(rows: pa.Table, columns: pa.Table) -> list:
        if not len(rows) or not len(columns):
            return []
        ra, rb = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        hub = rows["hub"][0].as_py()
        for lo in range(0, len(rows), tile):
            x = rows.slice(lo, tile)
            for at in range(0, len(columns), tile):
                y = columns.slice(at, tile)
                near = candidates(x, y, hub, p)
                ra[lo : lo + tile] |= near.any(1)
                rb[at : at + tile] |= near.any(0)
        found = [t.select(["hub", "no", "comp", "apart"]).filter(pa.array(r)) for t, r in ((rows, ra), (columns, rb)) if r.any()]
        return [x for t in found for x in t.to_batches()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_cell(batches, work):
            yield from found

    return in_cells(members, F.lit(16.0) * F.sqrt("m")).mapInArrow(run, "hub long, no long, comp long, apart boolean").distinct()


def candidates(x: pa.Table, y: pa.Table, hub: int, p: Params) -> np.ndarray:
    """Which rows of x and y are of two components, pass all filters, and have no lesser hub in common."""
    a, b = Side(x), Side(y)
    na, nb = a.n[:, None], b.n
    near = (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()) & (np.minimum(na, nb) * p.den >= np.maximum(na, nb) * p.num)
    if not near.any():
        return near
    twice = na + nb - a.single[:, None] - b.single
    for k in range(p.parts):
        twice -= np.abs(a.hist[:, k][:, None] - b.hist[:, k])
    near &= twice // 2 >= p.needed(na + nb)
    if not near.any():
        return near
    left, right = near.any(1), near.any(0)
    both = np.intersect1d(a.tokens[left[a.of]], b.tokens[right[b.of]])
    ga, gb = groups(a.tokens, a.of, both), groups(b.tokens, b.of, both)
    rest = np.zeros(near.shape, np.int64)
    for t in both.tolist():
        i, j = ga[t], gb[t]
        cell = np.ix_(a.of[i], b.of[j])
        rest[cell] = np.maximum(rest[cell], np.minimum(a.rest[i][:, None], b.rest[j]))
    near &= rest >= p.needed(na + nb)
    if near.any():
        ha, hb = ((np.asarray(v.flatten()), np.repeat(np.arange(len(v)), np.asarray(v.value_lengths()))) for v in (t["hubs"].combine_chunks() for t in (x, y)))
        lesser = np.intersect1d(ha[0][ha[0] < hub], hb[0][hb[0] < hub])
        for h in lesser.tolist():
            near[np.ix_(ha[1][ha[0] == h], hb[1][hb[0] == h])] = False
    return near


def joined(docs: DataFrame, p: Params) -> DataFrame:
    """docs (doc_id, text and others under names of this module's choice) without text, with n_shingles and component_id."""
    own = [c for c in docs.columns if c != "text"]
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    packed = written(chunked(docs, max(p.least_buckets, -(-chars // p.bucket)), p), "chunks")
    rows = packed.where("idx IS NOT NULL").select(*own, "n_shingles", "cls")
    # columns are kept apart from others' nulls by idx; a class is numbered once, as it is written
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("no"), "*"), "classes")
    n_rows, n_classes = rows.count(), classes.count()
    by_id = classes.where("least_id IS NULL").isEmpty() and rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    often = packed.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") > max(p.crowd, n_rows // CROWDS))
    crowds = {r.token: r.n for r in often.collect()}  # at most CROWDS times the shingles of a document, on average

    alive = prefixes(shared(packed, crowds), packed, p)
    alive = alive.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "single", "prefix", "hist"))).where("size(prefix) > 0")
    alive = written(alive.join(classes.select("no", "cls").hint("merge"), "cls").select("no", "n", "single", "prefix", "hist"), "prefixes")
    keys = alive.select("no", F.explode("prefix").alias("key"))
    counts = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key-counts")
    hot = hot_keys(counts, "key", "c", counts.agg(F.sum("c")).first()[0] or 0)
    keys = written(spread_join(keys, counts, "key", hot), "shared-keys")
    weight = keys.groupBy("no").agg(F.sum("c").alias("w"))
    hubs = keys.join(weight.hint("merge"), "no").groupBy("key").agg(F.max_by("no", F.struct("w", "no")).alias("hub"))
    stars = written(spread_join(keys, hubs, "key", hot).select("hub", "no").distinct(), "stars")
    rays = stars.where("hub <> no")
    degrees = written(rays.groupBy("hub").agg(F.count("*").alias("m")), "degrees")
    hot = hot_keys(degrees, "hub", "m", rays.count())

    hub_facts = alive.select(F.col("no").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in ("n", "single", "prefix", "hist")))
    to_hub = spread_join(rays.join(alive.hint("merge"), "no"), hub_facts, "hub", hot).where(alike(F.col("n"), F.col("hub_n"), p))
    to_hub = written(near_stars(to_hub, p), "near-hubs")
    source = docs.select("doc_id", "text")
    sets = sets_of(to_hub.select("no").unionByName(to_hub.select(F.col("hub").alias("no"))).distinct(), classes, source, by_id, p)
    comp = components(confirmed(to_hub, sets, degrees, hot, p).select(F.col("hub").alias("a"), F.col("no").alias("b")))

    placed = rays.join(comp.select(F.col("node").alias("no"), "comp").hint("merge"), "no", "left").withColumn("comp", F.coalesce("comp", "no"))
    placed = spread_join(placed, comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", hot, "left")
    placed = written(placed.select("hub", "no", "comp", (F.col("comp") != F.coalesce("hub_comp", "hub")).alias("apart")), "placed")

    def opened(members: DataFrame) -> DataFrame:
        """members of hubs that may hold a pair of two components, with their numbers m and u."""
        sizes = written(members.groupBy("hub").agg(F.count("*").alias("m"), F.count_if("apart").alias("u")).where("m > 1 AND u > 0"), "open-hubs")
        return spread_join(members, sizes, "hub", hot_keys(sizes, "hub", "m", members.count()))

    # hubs of a set: at most its prefix's shingles
    facts = alive.join(stars.groupBy("no").agg(F.collect_list("hub").alias("hubs")).hint("merge"), "no")
    left = written(partnered(opened(placed).join(facts.hint("merge"), "no"), p), "partnered")
    more_sets = sets_of(left.select("no").distinct().join(sets.select("no").hint("merge"), "no", "left_anti"), classes, source, by_id, p)
    more = written(cell_links(opened(left).join(sets.unionByName(more_sets).hint("merge"), "no"), p), "more-links")
    if not more.isEmpty():
        up = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        nodes = comp.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("comp")))
        comp = written(nodes.join(up.hint("merge"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")

    known = classes.select("no", "cls", "least_id", "copies").join(comp.select(F.col("node").alias("no"), "comp").hint("merge"), "no", "left").withColumn("comp", F.coalesce("comp", "no"))
    known = written(known, "class-components")
    ids = written(known.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("c")), "component-ids")
    of_class = written(spread_join(known, ids.select("comp", "component_id"), "comp", hot_keys(ids, "comp", "c", n_classes)).select("cls", "component_id", "copies"), "classes-done")
    out = spread_join(rows, of_class.select("cls", "component_id"), "cls", hot_keys(of_class, "cls", "copies", n_rows), "left", ["doc_id", "cls"])
    return out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("cls")


def similar(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs without text, with n_shingles and component_id, the least doc_id that links reach. docs has doc_id and text."""
    others = [c for c in docs.columns if c not in (text, "n_shingles", "component_id")]
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "doc_id", F.col(f"`{text}`").alias("text"))
    return joined(slim, p).select("row.*", "n_shingles", "component_id")
