"""Document fingerprints: a quartile bucket digest.

Byte triplets within windows of five bytes are hashed into BUCKETS counters; each counter is encoded by the quartile of all
counters in which it lies (two bits), and the text's length by its logarithm. The difference of two digests is the sum of the
buckets' quartile steps and the steps in length; the likeness is 1 at no difference and 0 at BOUND or more. Texts without a
triplet (less than three bytes) have all-zero buckets. Null texts count as empty. Equal texts have equal fingerprints.

`with_next` puts beside each row the text of the next one in descending order of an id, the first one's beside the last. Rows are
dealt by ranges of ids in one shuffle; each range's first and last rows are written beside its results, and the last row meets
the first of the next range in a join. Ties of the id go by a hash of the text, then by the text, so that an id with any number
of rows, null too, falls into several ranges; null ids come last. Rows that stand twice follow each other. A single row is
its own next. Texts of any length are taken whole. Other columns are not looked at, whatever their names, by edited_rows; they
pass through fingerprints, where one of the result's name gives way. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BUCKETS = 256
#: The triplets of a window of five bytes: offsets from its first byte.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
#: A difference of BOUND or more is no likeness.
BOUND = 256
ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def counters(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for k, (x, y, z) in enumerate(TRIPLETS):
        if len(b) > z:
            n = len(b) - z
            h = (b[x : x + n] * np.uint32(0x9E3779B1)) ^ (b[y : y + n] * np.uint32(0x85EBCA6B) << np.uint32(1)) ^ (b[z : z + n] * np.uint32(0xC2B2AE35)) ^ np.uint32(k * 0x27D4EB2F)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> np.ndarray:
    """BUCKETS quartile steps (0 to 3), then the length's step."""
    c = counters(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    steps = (c[:, None] > q).sum(1)
    return np.append(steps, min(255, round(8 * math.log2(1 + len(data))))).astype(np.uint8)


def packed(d: np.ndarray) -> str:
    """Length step and quartiles in hexadecimal, two bits a bucket."""
    q = d[:-1].reshape(-1, 4)
    return (bytes([d[-1]]) + bytes((q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).tolist())).hex()


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.append(((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel(), raw[0]).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> int:
    d = np.abs(a.astype(np.int64) - b)
    return int(d[:-1].sum() + max(0, d[-1] - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - min(BOUND, difference(a, b)) / BOUND


def with_next(docs: DataFrame, id_: str, text: str, make: Callable[[int | None, str, str], dict], schema: T.StructType) -> DataFrame:
    """make(id, text, next text) is the row of schema for each document."""
    slim = docs.select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    falling = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(*falling).sortWithinPartitions(*falling, "text")
    # a range's first and last rows, as `edge` 0 and 1 of `range`, go with their texts
    edges = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    fields = [*schema, *edges]
    arrow = pa.schema([(f"f{k}", ARROW[f.dataType.simpleString()]) for k, f in enumerate(fields)])
    n = len(schema)

    def row(values: dict | None, edge: tuple = ()) -> dict:
        return {f"f{k}": v for k, v in enumerate([*(values[f.name] for f in schema)] if values else [None] * n)} | {f"f{n + k}": v for k, v in enumerate(edge)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), None
        for batch in batches:
            done = []
            for i, x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "text")), strict=True):
                done.append(row(None, (number, 0, i, x)) if held is None else row(make(*held, x)))
                held = (i, x)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row(None, (number, 1, *held))], schema=arrow)

    found = written(dealt.mapInArrow(run, T.StructType([T.StructField(f"f{k}", f.dataType) for k, f in enumerate(fields)])), "fingerprints")
    named = found.toDF(*(f"f{k}" for k in range(n)), "range", "edge", "id", "text")
    inner = named.where("edge IS NULL").select(*(F.col(f"f{k}").alias(f.name) for k, f in enumerate(schema)))
    # one number a range
    order = W.orderBy("range")
    heads = named.where("edge = 0").select("range").distinct()
    following = heads.select("range", F.coalesce(F.lead("range").over(order), F.min("range").over(W.partitionBy())).alias("next"))
    tails = named.where("edge = 1").select("range", "id", "text").join(following.hint("merge"), "range")
    met = tails.join(named.where("edge = 0").select(F.col("range").alias("next"), F.col("text").alias("head")).hint("merge"), "next").select("id", "text", "head")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(*x) for x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "text", "head")), strict=True)]
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in schema]))

    return inner.unionByName(met.mapInArrow(ends, schema))


def edited_rows(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced from the next document, and both likenesses."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])
    last: list = [None, None]

    def remembered(x: str) -> np.ndarray:
        if last[0] != x:
            last[:] = [x, digest(x.encode())]
        return last[1]

    def make(i: int | None, x: str, following: str) -> dict:
        third = len(x) // 3
        edited = (x[: len(x) - third] + following[:third]).encode()
        a, e = remembered(x), digest(edited)
        n = remembered(following)
        return {"doc_id": i, "n_chars": len(x), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": packed(a), "edited_fingerprint": packed(e), "near_edited": likeness(a, e), "near_next": likeness(a, n)}

    return with_next(docs, id_, text, make, schema)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text. No shuffle."""
    taken = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in taken), T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(digest((x.as_py() or "").encode())) for x in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in taken), pa.array(made, pa.string())], names=[*taken, out])

    return df.mapInArrow(run, schema)
