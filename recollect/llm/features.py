"""Hashed text features in numpy, over a buffer that holds many texts at once, and the bounded sample that classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLD, in_chunks, mix64, run_hashes, runs, written

SPACES = np.zeros(0x110000, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
LETTERS = np.zeros(0x110000, bool)
LETTERS[: 1 << 16] = [chr(i).isalpha() for i in range(1 << 16)]
LETTERS[1 << 16 :] = True


def buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each, and where each begins (one more entry: the end)."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return codes, starts


def subword_features(texts: list[str], bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of words and of character n-grams within words (a space at either end counts), with the text of each; in parts.

    A text's features are its own, whatever texts lie before and after it.

    A word pair of two like words is bucket 0.
    """
    codes, starts = buffer(texts)
    space = SPACES[codes]
    down = np.uint64(64 - bits)
    begin, end = runs(~space)
    if len(begin):
        word, of = run_hashes(codes, begin, end), np.searchsorted(starts, begin, "right") - 1
        yield (word >> down).astype(np.int64), of
        again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
        yield np.zeros(len(again), np.int64), of[again]
    # from here on a line feed stands before each text too; the second sign of an n-gram is a text's own
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    codes = np.concatenate((np.array([10], np.uint32), codes))
    space = SPACES[codes]
    wide = codes.astype(np.uint64) + np.uint64(1)
    for n in sizes:
        if len(codes) < n:
            continue
        ok = np.ones(len(codes) - n + 1, bool)
        for k in range(1, n - 1):
            ok &= ~space[k : len(codes) - n + 1 + k]
        if n == 2:
            ok &= ~(space[:-1] & space[1:])
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ np.where(space[at + k], np.uint64(1), wide[at + k])) * GOLD
            h ^= h >> np.uint64(29)
        yield (mix64(h) >> down).astype(np.int64), doc[at]


def word_features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of lower-cased letter runs, and the text of each; texts may hold what isn't a letter within or around words."""
    codes, starts = buffer([x.lower() for x in texts]) if texts else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
    # lower() may lengthen a text, so that buffer() measures what it gets
    begin, end = runs(LETTERS[codes])
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (run_hashes(codes, begin, end) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(starts, begin, "right") - 1


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_rows(docs: DataFrame, labels: DataFrame, label: str, at_most: int, allowed: Column | None = None, characters: int = 1 << 25) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, text, label) of at most at_most labelled rows of each label, 0 and 1: those of least hash, so that reruns agree.

    The sample of ids is bounded before it meets the documents, so it may be broadcast. A document labelled twice counts with
    its greater label; of the texts that stand under one id the least counts, chosen before anything is collected.

    characters: the sample holds so many of each label at most. Texts of more than a sixteenth of that are not learned from, and where
    the sum is reached, rows of greater hash aren't either. Texts are taken whole or not at all.

    Last, for how many labelled rows a row of the sample stands, by label: taking as many of each hides the shares of the labels. It is
    the inverse of the part of the ids that was sampled, so that labels of absent documents shift nothing, times what `characters` left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(F.lit(True) if allowed is None else allowed)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    ids = [known.where(F.col("label") == k).orderBy("order", "doc_id").limit(at_most).select("doc_id", "label") for k in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    all_ = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids.withColumn("order", F.xxhash64("doc_id"))), "doc_id")
    found = written(found.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")), "sample")
    sizes = sorted((r.label, r.order, r.doc_id, r.n) for r in found.select("label", "order", "doc_id", F.char_length("text").alias("n")).collect())
    taken, sums, stands = [], [0, 0], []
    for k, _, id_, n in sizes:
        if n <= characters // 16:
            sums[k] += n
            if sums[k] <= characters:
                taken.append((id_, k))
    for k in (0, 1):
        here, used = sum(x[0] == k for x in sizes), sum(x[1] == k for x in taken)
        stands.append(max(1.0, all_.get(k, 0) / at_most) * (here / used if used else 1.0))
    rows = found if len(taken) == len(sizes) else found.where(F.col("doc_id").isin([x[0] for x in taken]))
    return rows.select("doc_id", "text", "label"), (stands[0], stands[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int, allowed: Column | None = None, characters: int = 1 << 25) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts and labels of sampled_rows(), by id, in the driver, and what each row stands for."""
    rows, stands = sampled_rows(docs, labels, label, at_most, allowed, characters)
    rows = sorted((r.doc_id, r.text, r.label) for r in rows.collect())
    return [x for _, x, _ in rows], [y for _, _, y in rows], stands


def scored(df: DataFrame, text: str, names: list[str], scores) -> DataFrame:
    """df with double columns: scores(list of texts) gives an array of shape (texts, len(names)). No shuffle."""
    taken = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in taken), *(T.StructField(n, T.DoubleType(), False) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            parts = [scores(texts[lo:hi]) for lo, hi in in_chunks(texts, 1 << 18)]
            out = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in taken), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(names)))], names=[*taken, *names])

    return df.mapInArrow(run, schema)
