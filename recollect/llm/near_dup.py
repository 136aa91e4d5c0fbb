"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set is its distinct WORDS-word shingles (lower-cased A-Z, words between white space), hashed to 64 bits. Sets
that are equal form a class, and classes alone go on. A signature has CHUNKS x SYMBOLS symbols of 16 bits, each the least
value of one hash function over the set. By the pigeonhole principle, two signatures that differ in less than
CHUNKS x (ERRORS + 1) symbols agree in some chunk up to ERRORS symbols; so each chunk is filed under its hash with every choice
of ERRORS symbols left out, and all such pairs share a key. That number less one is the signature-distance threshold (47 of
96 symbols): no pair under it is missed, and pairs beyond it count as unlinked. A pair of sets at a similarity of exactly 0.75
lies beyond it with a chance of 1.2 in ten million, at 0.8 of 1 in 10**10.

The documents of a key are compared with its hub only, the one that shares most keys; hubs gather neighbourhoods, and every pair
that shares a key shares a hub. Links to hubs are confirmed on full sets, and give components. Of a neighbourhood, only pairs of
two components remain, and so only those members that are not in the hub's component are compared with the others: in a grid
of cells, whose side grows with the root of the neighbourhood, first by signatures, where a cell names only members with a
partner under the threshold; then, for those, exactly on full sets by matrix products. Copies of a hub in any number so take no
pairs; n unlinked members of one hub cost n**1.5 / 16 shipped signatures.

Keys, hubs, classes and components of many rows are joined by spread_join, so that none is one task's. Components are found by
label propagation with pointer jumping, on tables.

Null and empty texts, and those of white space alone, have no set and are linked with nothing. Rows that stand twice are one
class. A null doc_id is no component's id, unless no document of the component has one. Texts of any length are one row each.
Columns of the caller pass through whatever their names; only those named like a result give way to it. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLD, hash_counts, hot_keys, in_chunks, meet, mix64, nested, run_hashes, runs, spread_join, written

#: What a word is made of, as a regular expression.
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Params:
    words: int = 5
    #: Linked if den * intersection >= num * union.
    num: int = 75
    den: int = 100
    chunks: int = 24
    symbols: int = 4  # of a chunk
    errors: int = 1  # symbols of a chunk that may differ
    block: int = 256  # members a side of a cell that are compared on full sets

    @property
    def size(self) -> int:
        return self.chunks * self.symbols

    @property
    def limit(self) -> int:
        """The greatest distance of signatures at which a shared key is sure."""
        return self.chunks * (self.errors + 1) - 1


def factors(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLD + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after another, and where each text's begin (one more entry: the end)."""
    data = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
    codes = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    starts = np.cumsum([0, *(len(x) + 1 for x in data)])
    begin, end = runs((codes != 32) & ((codes < 9) | (codes > 13)))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word, doc = run_hashes(codes, begin, end), np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    f = factors(p.words, 5)
    n = max(0, len(word) - p.words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(p.words):
        h += word[k : k + n] * f[k]
    whole = doc[:n] == doc[p.words - 1 : p.words - 1 + n]
    h, of = mix64(h[whole]), doc[:n][whole]
    few = np.flatnonzero((count > 0) & (count < p.words))
    if len(few):
        first = np.concatenate(([0], np.cumsum(count)))[few]
        short = np.array([np.bitwise_xor.reduce(mix64(word[a : a + c] * f[:c] + np.arange(c, dtype=np.uint64))) + np.uint64(c) for a, c in zip(first, count[few], strict=True)], np.uint64)
        h, of = np.concatenate([h, mix64(short)]), np.concatenate([of, few])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def minhash(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The signatures of non-empty sets that begin at starts."""
    out = np.empty((len(starts), size), np.uint16)
    for k, f in enumerate(factors(size, 77)):
        out[:, k] = mix64(np.minimum.reduceat(h * f + (h >> np.uint64(32)), starts)) & np.uint64(0xFFFF)
    return out


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary column from the rows of a matrix."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * raw.shape[1]).astype(np.int32)), pa.py_buffer(raw)])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column whose values are of one size."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """docs without text, with n_shingles, cls (16 bytes of the set's hash; null if empty) and sig. No shuffle."""
    taken = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in taken), T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            for lo, hi in in_chunks(texts):
                h, starts = shingle_sets(texts[lo:hi], p)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                cls, sig = pa.nulls(hi - lo, pa.binary()), pa.nulls(hi - lo, pa.binary())
                if len(full):
                    at = starts[:-1][full]
                    both = np.stack([np.add.reduceat(mix64(h ^ np.uint64(s)), at) for s in (1, 2)], 1)
                    place = np.full(hi - lo, -1)
                    place[full] = np.arange(len(full))
                    take = pa.array(place, mask=place < 0)
                    cls, sig = fixed(both).take(take), fixed(minhash(h, at, p.size)).take(take)
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(lo, hi - lo) for c in taken), pa.array(n), cls, sig], names=[*taken, "n_shingles", "cls", "sig"])

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, p: Params) -> DataFrame:
    """(no, text) to (no, shingles array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            for lo, hi in in_chunks(texts):
                h, starts = shingle_sets(texts[lo:hi], p)
                yield pa.RecordBatch.from_arrays([column(batch, "no").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h.view(np.int64)))], names=["no", "shingles"])

    return docs.mapInArrow(run, "no long, shingles array<long>")


def chunk_keys(classes: DataFrame, p: Params) -> DataFrame:
    """(key, no): each chunk with each choice of symbols left out."""
    left_out = list(combinations(range(p.symbols), p.errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = matrix(column(batch, "sig"), np.uint16).astype(np.uint64) + np.uint64(1)
            own = column(batch, "no")
            for c in range(p.chunks if len(own) else 0):
                part = sig[:, c * p.symbols : (c + 1) * p.symbols]
                for way, gone in enumerate(left_out):
                    h = np.full(len(own), c * len(left_out) + way + 1, np.uint64)
                    for k in range(p.symbols):
                        if k not in gone:
                            h = mix64(h * GOLD + part[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), own], names=["key", "no"])

    return classes.select("no", "sig").mapInArrow(run, "key long, no long")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of each row of a and each of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k][:, None] != b[:, k]
    return out


def alike(na: Column, nb: Column, p: Params) -> Column:
    """Sets of these sizes may be linked."""
    return F.least(na, nb) * p.den >= F.greatest(na, nb) * p.num


def near_stars(stars: DataFrame, p: Params) -> DataFrame:
    """(hub, no) of the (hub, no, hub_sig, sig) rows within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array((matrix(column(batch, "hub_sig"), np.uint16) != matrix(column(batch, "sig"), np.uint16)).sum(1) <= p.limit)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(near) for c in ("hub", "no")], names=["hub", "no"])

    return stars.mapInArrow(run, "hub long, no long")


def in_cells(members: DataFrame, side: Column) -> DataFrame:
    """Rows of a hub with m members, u of them apart, dealt to the cells of a grid: those apart by rows, all by columns.

    members has hub, no, apart, m and u; side is a cell's greatest height and width. Every pair of a member that is apart and
    another one meets in a cell. Sorted by hub and cell (x, y).
    """
    own = [c for c in members.columns if c not in ("m", "u")]
    members = members.withColumns({"high": F.ceil(F.col("u") / side).cast("int"), "wide": F.ceil(F.col("m") / side).cast("int")})
    place = lambda n: F.pmod(F.xxhash64("no"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = members.where("apart").withColumn("x", place("high")).withColumn("y", every("wide")).withColumn("of_row", F.lit(True))
    columns = members.withColumn("y", place("wide")).withColumn("x", every("high")).withColumn("of_row", F.lit(False))
    both = [*own, "x", "y", "of_row"]
    return rows.select(both).unionByName(columns.select(both)).repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")


def by_cell(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, pa.Table], list]) -> Iterator[list]:
    """work on the rows and the columns of each cell, which come sorted; a cell may lie in several batches."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def done() -> list:
        t = pa.Table.from_batches(held)
        return work(t.filter(t["of_row"]), t.filter(pc.invert(t["of_row"])))

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([column(batch, c).to_numpy() for c in ("hub", "x", "y")], 1)
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and held_key != tuple(k[a]):
                yield done()
                held = []
            held_key = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def partnered(members: DataFrame, p: Params) -> DataFrame:
    """The (hub, no, comp, apart) of members with a partner of another component within the limit; they have m, u, n and sig too."""
    tile = 1024

    def work(rows: pa.Table, columns: pa.Table) -> list:
        a, b = ({"no": t["no"].to_numpy(), "comp": t["comp"].to_numpy(), "n": t["n"].to_numpy(), "sig": matrix(t["sig"].combine_chunks(), np.uint16)} for t in (rows, columns))
        ra, rb = np.zeros(len(a["no"]), bool), np.zeros(len(b["no"]), bool)
        for lo in range(0, len(ra), tile):
            for at in range(0, len(rb), tile):
                x, y = slice(lo, lo + tile), slice(at, at + tile)
                na, nb = a["n"][x][:, None], b["n"][y]
                near = (a["comp"][x][:, None] != b["comp"][y]) & (np.minimum(na, nb) * p.den >= np.maximum(na, nb) * p.num)
                if near.any():
                    near &= apart(a["sig"][x], b["sig"][y]) <= p.limit
                    ra[x] |= near.any(1)
                    rb[y] |= near.any(0)
        found = [t.select(["hub", "no", "comp", "apart"]).filter(pa.array(r)) for t, r in ((rows, ra), (columns, rb)) if r.any()]
        return [x for t in found for x in t.to_batches()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_cell(batches, work):
            yield from found

    side = F.lit(16.0) * F.sqrt("m")
    return in_cells(members, side).mapInArrow(run, "hub long, no long, comp long, apart boolean").distinct()


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of a and each of b, by matrix products over the shingles that stand in both."""
    flat = np.concatenate([*a, *b])
    of = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, at = np.unique(flat, return_inverse=True)
    size = int(at.max()) + 1
    first = of < len(a)
    both = (np.bincount(at[first], minlength=size) > 0) & (np.bincount(at[~first], minlength=size) > 0)
    place = np.cumsum(both) - 1
    shared = both[at]
    at, of = place[at[shared]], of[shared]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((len(a), len(b)), np.float32)
    wide = 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        i, j = np.searchsorted(at, [lo, lo + wide])
        x = np.zeros((len(a) + len(b), wide), np.float32)
        x[of[i:j], at[i:j] - lo] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int64)


def cell_links(members: DataFrame, p: Params) -> DataFrame:
    """(a, b): components to join, from (hub, no, comp, apart, m, u, shingles) rows, compared exactly in cells."""

    def work(rows: pa.Table, columns: pa.Table) -> list:
        if not len(rows) or not len(columns):
            return []
        a, b = ([np.asarray(x.values) for x in t["shingles"]] for t in (rows, columns))
        ca, cb = (t["comp"].to_numpy() for t in (rows, columns))
        na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])
        inter = intersections(a, b)
        i, j = np.nonzero((inter * p.den >= (na + nb - inter) * p.num) & (ca[:, None] != cb))
        return list(set(zip(ca[i].tolist(), cb[j].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_cell(batches, work):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return in_cells(members, F.lit(float(p.block))).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each component, for all nodes of the (a, b) edges."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        told = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        met = labels.join(told.hint("merge"), labels["node"] == told["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond"))
        after = written(met.join(jump.hint("merge"), "to").select("node", "was", F.least("to", "beyond").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("was <> comp").isEmpty():
            return labels


def perhaps_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id's hash is marked by one of ids, which holds all that have such a doc_id and few others.

    The marks are a bitmap of at most 32 MB, whatever the number of ids, so it may be broadcast: long texts that no join needs
    stay out of its shuffle.
    """
    bits = 1 << min(28, max(15, (64 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    marks = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_bucket")
    return near.where(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(docs.columns)


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, by_id: bool, p: Params) -> DataFrame:
    """(no, shingles) of the classes in wanted, from the text of a document of each.

    by_id: each class has a document with an id, and no id stands twice. Else the sets' own hashes tell which text is whose.
    """
    wanted = wanted.join(classes.select("no", "cls", F.col("least_id").alias("doc_id")).hint("merge"), "no")
    if by_id:
        named = written(wanted.select("no", "doc_id"), "wanted")
        texts = perhaps_among(docs, named).join(named.hint("merge"), "doc_id").select("no", "text")
    else:
        own = signatures(docs.select(F.col("text").alias("kept"), "text"), p).select("cls", F.col("kept").alias("text"))
        texts = own.join(wanted.select("cls").hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text"))
        texts = texts.join(wanted.select("cls", "no").hint("merge"), "cls").select("no", "text")
    return written(full_sets(texts, p), "sets")


def confirmed(to_hub: DataFrame, sets: DataFrame, degrees: DataFrame, hot: DataFrame, p: Params) -> DataFrame:
    """The (hub, no) pairs that are linked on full sets. A hub's set is sent once for each p.block of its members."""
    dealt = spread_join(to_hub, degrees, "hub", hot).withColumn("deal", F.pmod(F.xxhash64("no"), F.expr(f"(m - 1) div {p.block} + 1")))
    hub_sets = sets.select(F.col("no").alias("hub"), F.col("shingles").alias("hub_shingles")).join(degrees.hint("merge"), "hub")
    hub_sets = hub_sets.withColumn("deal", F.explode(F.expr(f"sequence(0, (m - 1) div {p.block})"))).drop("m")
    pairs = dealt.drop("m").join(hub_sets.hint("merge"), ["hub", "deal"]).join(sets.hint("merge"), "no")
    inter = F.size(F.array_intersect("hub_shingles", "shingles"))
    return pairs.where(inter * p.den >= (F.size("hub_shingles") + F.size("shingles") - inter) * p.num).select("hub", "no")


def grouped(docs: DataFrame, p: Params) -> DataFrame:
    """docs (doc_id, text and others under names of this module's choice) without text, with n_shingles, component_id and comp.

    comp is a number of the component, null where the text has no set.
    """
    rows = written(signatures(docs, p), "signatures")
    source = docs.select("doc_id", "text")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
    # numbers are made once, as the classes are written
    classes = written(classes.select(F.monotonically_increasing_id().alias("no"), "*"), "classes")
    n_rows, n_classes = rows.count(), classes.count()
    by_id = classes.where("least_id IS NULL").isEmpty() and rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()

    keys = chunk_keys(classes, p)
    counts = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key-counts")
    hot = hot_keys(counts, "key", "c", n_classes * p.size)
    keys = written(spread_join(keys, counts, "key", hot), "shared-keys")
    weight = keys.groupBy("no").agg(F.sum("c").alias("w"))
    hubs = keys.join(weight.hint("merge"), "no").groupBy("key").agg(F.max_by("no", F.struct("w", "no")).alias("hub"))
    stars = written(spread_join(keys, hubs, "key", hot).where("hub <> no").select("hub", "no").distinct(), "stars")
    degrees = written(stars.groupBy("hub").agg(F.count("*").alias("m")), "degrees")
    hot = hot_keys(degrees, "hub", "m", stars.count())

    facts = classes.select("no", "n", "sig")
    hub_facts = facts.select(F.col("no").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))
    to_hub = spread_join(stars.join(facts.hint("merge"), "no"), hub_facts, "hub", hot).where(alike(F.col("n"), F.col("hub_n"), p))
    to_hub = written(near_stars(to_hub.select("hub", "no", "hub_sig", "sig"), p), "near-hubs")
    sets = sets_of(to_hub.select("no").unionByName(to_hub.select(F.col("hub").alias("no"))).distinct(), classes, source, by_id, p)
    sure = confirmed(to_hub, sets, degrees, hot, p)
    comp = components(sure.select(F.col("hub").alias("a"), F.col("no").alias("b")))

    placed = stars.join(comp.select(F.col("node").alias("no"), "comp").hint("merge"), "no", "left").withColumn("comp", F.coalesce("comp", "no"))
    placed = spread_join(placed, comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", hot, "left")
    placed = written(placed.select("hub", "no", "comp", (F.col("comp") != F.coalesce("hub_comp", "hub")).alias("apart")), "placed")

    def opened(members: DataFrame) -> DataFrame:
        """members of hubs that may hold a pair of two components, with their numbers m and u."""
        sizes = written(members.groupBy("hub").agg(F.count("*").alias("m"), F.count_if("apart").alias("u")).where("m > 1 AND u > 0"), "open-hubs")
        return spread_join(members, sizes, "hub", hot_keys(sizes, "hub", "m", members.count()))

    alive = written(partnered(opened(placed).join(facts.hint("merge"), "no"), p), "partnered")
    more_sets = sets_of(alive.select("no").distinct().join(sets.select("no").hint("merge"), "no", "left_anti"), classes, source, by_id, p)
    more = written(cell_links(opened(alive).join(sets.unionByName(more_sets).hint("merge"), "no"), p), "more-links")
    if not more.isEmpty():
        up = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        nodes = comp.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("comp")))
        comp = written(nodes.join(up.hint("merge"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")

    known = classes.select("no", "cls", "least_id", "copies").join(comp.select(F.col("node").alias("no"), "comp").hint("merge"), "no", "left").withColumn("comp", F.coalesce("comp", "no"))
    known = written(known, "class-components")
    ids = written(known.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("c")), "component-ids")
    of_class = spread_join(known, ids.select("comp", "component_id"), "comp", hot_keys(ids, "comp", "c", n_classes)).select("cls", "comp", "component_id", "copies")
    of_class = written(of_class, "classes-done")
    out = spread_join(rows.drop("sig"), of_class.select("cls", "comp", "component_id"), "cls", hot_keys(of_class, "cls", "copies", n_rows), "left", ["doc_id", "cls"])
    return out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("cls")


def near_duplicates(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """docs without text, with n_shingles and component_id, the least doc_id that links reach. docs has doc_id and text."""
    others = [c for c in docs.columns if c not in (text, "n_shingles", "component_id")]
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "doc_id", F.col(f"`{text}`").alias("text"))
    return grouped(slim, p).select("row.*", "n_shingles", "component_id")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one document of each component: that of its id.

    All rows of this document stay that differ in any column; those alike in all stay once. Of a component without any id one
    text stays. Documents without a word are components of their own. Columns pass through whatever their names.
    """
    keyed = nested(docs)
    words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    once = lambda df: df.groupBy("h1", "h2", F.sha2(F.to_json("row"), 256).alias("all")).agg(F.first("row").alias("row")).select("row.*")
    found = grouped(keyed.where(words).select("h1", "h2", "row.doc_id", "row.text"), p)
    found = written(found.select("h1", "h2", "doc_id", "component_id", "comp"), "found")
    alone = found.where("component_id IS NULL").groupBy("comp").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.*")
    kept = found.where("doc_id = component_id").select("h1", "h2").unionByName(found.where("component_id IS NULL").select("h1", "h2").join(alone.hint("merge"), ["h1", "h2"], "left_semi"))
    kept = written(kept.groupBy("h1", "h2").agg(F.count("*").alias("n")), "kept")
    hot = hash_counts(found)
    stay = lambda n: meet(keyed, kept.where(n).select("h1", "h2"), hot)
    out = stay("n = 1").select("row.*")
    if not kept.where("n > 1").isEmpty():
        out = out.unionByName(once(stay("n > 1")))
    bare = keyed.where(~words)
    return out if bare.isEmpty() else out.unionByName(once(bare))
