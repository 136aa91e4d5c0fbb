"""Target-distribution importance resampling with exact weights by bit-sliced aggregation.

Features are runs of 1 to `longest` consecutive words (lower-cased A-Z; digits, letters and all beyond ASCII), hashed by CRC-32 into
BUCKETS buckets. A bucket's gain is the whole-numbered log ratio of its smoothed shares in the target and in all documents. A
document's weight is the sum of its features' gains: its bucket counts are cut into bit planes of BUCKETS bits, one for each power of
two; the gains are cut into planes too, positive and negative ones apart; each AND of two planes is counted by population count and
enters with its power of two. All sums are of whole numbers, so a weight is exact and the same on any machine. With Gumbel noise from
sha256(seed:id) added, the documents of the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Counting sends at most BUCKETS numbers a task; weights need no shuffle. The CRC of a run is made from those of its words by the
linearity of CRCs. Ranks are made by ranges of scores, each a bounded part of the rows; rows alike in id and text share a row with a
number until they are ranked.

Null and empty texts have no features, a weight of 0, and are never drawn unless `least_words` is 0. Ties go to the smaller id, null
ids last; a null id is hashed as no digits. Rows that stand twice are drawn one by one. Texts of any length are counted whole, in
steps of a chunk. An empty target or an empty table has counts of 0. Only the id and the text are looked at, whatever the other columns' names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_chunks, runs, written

BUCKETS = 10_000
#: 64-bit words of a plane.
WIDE = -(-BUCKETS // 64)


@dataclass(frozen=True)
class Params:
    seed: int = 42
    longest: int = 3  # words of a feature
    least_words: int = 20
    percent: int = 5  # of the documents with at least that many words


def byte_steps() -> np.ndarray:
    """What a zero byte makes of each low byte of a CRC."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


STEP = byte_steps()
#: Lengths up to which a shift has tables of its own; longer ones are made of those of SHORT * 2**k.
SHORT = 64


def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables [length, place of the byte, byte]: what `length` zero bytes make of a CRC's bytes; and the same for SHORT * 2**k."""
    x = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [x]
    for _ in range(SHORT):
        x = STEP[x & np.uint32(255)] ^ (x >> np.uint32(8))
        short.append(x)
    long = [x]
    for _ in range(31 - SHORT.bit_length()):
        x = applied(x, x)
        long.append(x)
    return np.stack(short), np.stack(long)


def applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][crc >> np.uint32(8) & np.uint32(255)] ^ table[2][crc >> np.uint32(16) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


SHIFTS, LONG_SHIFTS = shift_tables()
_FLAT = [np.ascontiguousarray(SHIFTS[:, k]).ravel() for k in range(4)]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs after so many zero bytes each."""
    near = (np.minimum(lengths, SHORT) if len(lengths) and lengths.max() > SHORT else lengths) << 8
    out = _FLAT[0][near + (crc & np.uint32(255))] ^ _FLAT[1][near + (crc >> np.uint32(8) & np.uint32(255))] ^ _FLAT[2][near + (crc >> np.uint32(16) & np.uint32(255))] ^ _FLAT[3][near + (crc >> np.uint32(24))]
    far = np.flatnonzero(lengths > SHORT)
    if len(far):
        c, rest = shifted(crc[far], lengths[far] % SHORT), lengths[far] // SHORT
        for k in range(int(rest.max()).bit_length()):
            c = np.where(rest >> k & 1, applied(LONG_SHIFTS[k], c), c)
        out[far] = c
    return out


def word_crcs(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[b:e] for each word: all words byte by byte at once, longest first; those beyond SHORT bytes one by one."""
    size = end - begin
    order = np.argsort(np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    first = int(np.count_nonzero(size > SHORT))
    out = np.empty(len(begin), np.uint32)
    for i in order[:first]:
        out[i] = zlib.crc32(raw[begin[i] : end[i]].tobytes())
    order = order[first:]
    at, sizes = begin[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    still = len(order) - np.searchsorted(sizes[::-1], np.arange(1, SHORT + 1))
    for k in range(SHORT):
        n = int(still[k])
        if not n:
            break
        c = crc[:n]
        crc[:n] = STEP[(c ^ raw[at[:n] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out[order] = ~crc
    return out


def features(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text's number) of each feature, and the words of each text."""
    data = [x.lower() for x in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    starts = np.cumsum([0, *(len(x) + 1 for x in data)])
    begin, end = runs((raw >= 0x80) | (raw >= 0x30) & (raw <= 0x39) | (raw >= 0x61) & (raw <= 0x7A))
    doc = np.searchsorted(starts, begin, "right") - 1
    crc, size = word_crcs(raw, begin, end), end - begin
    led = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    buckets, of, run = [crc], [doc], crc
    for k in range(1, p.longest):
        run = shifted(run[:-1], size[k:] + 1) ^ led[k:]
        buckets.append(run)
        of.append(doc[k:])
    kept = [doc[: len(x)] == y for x, y in zip(buckets, of, strict=True)]
    return np.concatenate([x[k] for x, k in zip(buckets, kept, strict=True)]) % np.uint32(BUCKETS), np.concatenate([y[k] for y, k in zip(of, kept, strict=True)]), np.bincount(doc, minlength=len(texts))


def batches_of(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = batch.column(batch.schema.get_field_index("data")).to_pylist()
    for lo, hi in in_chunks(texts, size):
        yield lo, hi, texts[lo:hi]


def as_bytes(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))


def bucket_counts(df: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, texts in batches_of(batch):
                total += np.bincount(features(texts, p)[0], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return as_bytes(df, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, p: Params = Params(), text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of all BUCKETS buckets: floor(1000 * ln of the ratio of the bucket's smoothed shares in target and docs)."""
    both = bucket_counts(docs, p, text).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, p, target_text).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = (F.sum(c).over(W.partitionBy()).cast("double") for c in ("s", "t"))  # over BUCKETS rows
    ratio = (F.col("t") + 1.0) * (all_s + float(BUCKETS)) / ((F.col("s") + 1.0) * (all_t + float(BUCKETS)))
    return counts.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) for each bit of the gains' magnitudes, positive and negative gains apart."""
    out = []
    for sign in (1, -1):
        size = np.where(gain * sign > 0, np.abs(gain), 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            bits = np.zeros(WIDE * 64, np.uint8)
            bits[: len(gain)] = size >> k & 1
            out.append((sign << k, np.packbits(bits, bitorder="little").view(np.uint64)))
    return out


def plane_weights(bucket: np.ndarray, doc: np.ndarray, n: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights of n documents from their features' buckets."""
    key, count = np.unique(doc * (WIDE * 64) + bucket, return_counts=True)
    out = np.zeros(n, np.int64)
    for k in range(int(count.max(initial=0)).bit_length()):
        of = key[count >> k & 1 == 1]
        place = of >> 6
        new = np.flatnonzero(np.diff(place, prepend=-1))
        words = np.add.reduceat(np.uint64(1) << (of & 63).astype(np.uint64), new)  # no bit stands twice
        at = place[new]
        docs, row = np.unique(at // WIDE, return_inverse=True)
        plane = np.zeros((len(docs), WIDE), np.uint64)
        plane[row, at % WIDE] = words
        for power, gain in planes:
            out[docs] += (power << k) * np.bitwise_count(plane & gain).sum(1, dtype=np.int64)
    return out


def weighted(docs: DataFrame, gain: list[int], p: Params = Params(), id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document. gain has a number for each bucket."""
    planes = gain_planes(np.asarray(gain, np.int64))
    slim = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, texts in batches_of(batch):
                bucket, doc, words = features(texts, p)
                columns = [pa.array(words), pa.array(np.bincount(doc, minlength=hi - lo)), pa.array(plane_weights(bucket, doc, hi - lo, planes))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, p: Params = Params()) -> DataFrame:
    """weights with score: the weight plus 1000 times Gumbel noise from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """rows with rank: 1, 2, 3 and so on by falling score for the drawn documents, else null."""
    own = rows.columns
    alike = rows.groupBy(*own).agg(F.count("*").alias("copies")).withColumn("fit", F.col("n_words") >= p.least_words)
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *(c for c in own if c not in ("score", "doc_id"))]
    # written, as a range's number must not change
    ranges = written(alike.repartitionByRange(F.col("fit").desc(), *by).withColumn("range", F.spark_partition_id()), "ranges")
    fit = F.when(F.col("fit"), F.col("copies")).otherwise(0)
    sizes = ranges.groupBy("range").agg(F.sum(fit).alias("n"))
    # a row for each partition: it may be broadcast
    before = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    drawn = (sizes.agg(F.sum("n")).first()[0] or 0) * p.percent // 100
    place = F.sum(fit).over(W.partitionBy("range").orderBy(*by)) + F.col("before") - F.col("copies")
    each = ranges.join(F.broadcast(before), "range").withColumn("place", place).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*own, F.when(F.col("fit") & (F.col("place") + F.col("k") <= drawn), F.col("place") + F.col("k")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, p: Params = Params(), id_: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document; docs are read twice."""
    gain = [r.gain for r in gains(docs, target, p, text, target_text).orderBy("bucket").collect()]  # BUCKETS numbers
    return ranked(written(scored(weighted(docs, gain, p, id_, text), p), "weights"), p)
