"""Fill-in-middle transformation: a text's middle, between two cuts at unit borders, moves behind its prefix and suffix.

A unit is a word with the white space before it, or white space at the text's end. The cuts, and whether and in which form a
text is changed, come from sha256(seed:id) alone, so that any run makes the same ones. Where a cut lies is asked of a Fenwick
tree over fixed blocks of the text's UTF-8 bytes, which stores how many units end and how many code points begin in them: a
binary-lifting descent finds the block in which the wanted unit ends, and what lies before; the border is then found in that
block alone. A text's memory is a small multiple of its bytes. No shuffle: rows stay where they are.

Forms: `plain`, the text as it is (empty texts, texts that hold a mark, and those that the rate leaves out); `psm`, prefix mark,
prefix, suffix mark, suffix, middle mark, middle; `spm`, suffix mark, suffix, prefix mark, prefix, middle mark, middle. As a text
that holds a mark stays plain and no mark overlaps another, `restored` gives back the exact text.

Null texts count as empty. A null id is hashed as no digits. Rows that stand twice are changed alike. Texts of any length are cut
whole. Other columns pass through whatever their names; those named like a result give way to it. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks


@dataclass(frozen=True)
class Params:
    seed: int = 42
    rate: int = 50  # per cent of the texts that are changed
    spm: int = 80  # per cent of these that are in the form spm
    block: int = 1024  # bytes
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("marks must not be empty, overlap, or hold each other")


class Blocks:
    """Fenwick trees over blocks of a text: units that end, and code points that begin, in each."""

    def __init__(self, data: bytes, block: int):
        raw = np.frombuffer(data, np.uint8)
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        self.block, self.ends, self.begins = block, np.empty(len(raw), bool), (raw & 0xC0) != 0x80
        if len(raw):
            self.ends[:-1] = ~white[:-1] & white[1:]
            self.ends[-1] = True  # of a word, or of the white space behind the last one
        self.units, self.chars = self.tree(self.ends), self.tree(self.begins)
        self.n = int(np.count_nonzero(self.ends))

    def tree(self, marks: np.ndarray) -> np.ndarray:
        """Place i holds the sum of the blocks from i & (i - 1) up to i - 1."""
        first = np.arange(0, len(marks), self.block)
        sums = np.zeros(len(first) + 1, np.int64)
        np.cumsum(np.add.reduceat(marks.view(np.int8), first, dtype=np.int64) if len(first) else sums[1:], out=sums[1:])
        i = np.arange(len(sums))
        return sums - sums[i & (i - 1)]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first `units` units."""
        if not units:
            return 0, 0
        at, left, chars = 0, units, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            to = at + step
            if to < len(self.units) and self.units[to] < left:
                at, left, chars = to, left - int(self.units[to]), chars + int(self.chars[to])
            step >>= 1
        lo = at * self.block
        hi = lo + int(np.flatnonzero(self.ends[lo : lo + self.block])[left - 1]) + 1
        return hi, chars + int(np.count_nonzero(self.begins[lo:hi]))


def numbers(seed: int, id_: str) -> list[int]:
    """Four numbers of 32 bits for an id."""
    h = hashlib.sha256(f"{seed}:{id_}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def changed(id_: str, data: bytes, p: Params) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    blocks = Blocks(data, p.block)
    first, second, chance, way = numbers(p.seed, id_)
    marks = [m.encode() for m in (p.prefix, p.suffix, p.middle)]
    if not data or chance % 100 >= p.rate or any(m in data for m in marks):
        return blocks.n, "plain", None, None, data
    a, b = sorted((first % (blocks.n + 1), second % (blocks.n + 1)))
    (at, before), (to, upto) = blocks.cut(a), blocks.cut(b)
    prefix, middle, suffix = marks[0] + data[:at], marks[2] + data[at:to], marks[1] + data[to:]
    form = "spm" if way % 100 < p.spm else "psm"
    return blocks.n, form, before, upto - before, b"".join((suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle))


RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def transformed(docs: DataFrame, p: Params = Params(), id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    others = [c for c in docs.columns if c not in (text, *RESULTS)]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("struct<none:int>")
    slim = docs.select(row.alias("row"), F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    schema = T.StructType([slim.schema["row"], *(T.StructField(n, t) for n, t in RESULTS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, data = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "data"))
            for lo, hi in in_chunks(texts := data.to_pylist(), 1 << 22):
                done = list(zip(*(changed(i, x, p) for i, x in zip(ids[lo : lo + hi - lo].to_pylist(), texts[lo:hi], strict=True)), strict=True))
                columns = [pa.array(done[0], pa.int64()), pa.array(done[1], pa.string()), pa.array(done[2], pa.int64()), pa.array(done[3], pa.int64()), pa.array(done[4], pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), *columns], names=["row", *RESULTS])

    return slim.mapInArrow(run, schema).select(*(["row.*"] if others else []), *RESULTS)


def restored(output: Column, form: Column, p: Params = Params()) -> Column:
    """The text that an output was made from. In the forms with marks, each mark stands once and cuts the output."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in (p.prefix, p.suffix, p.middle)))
    joined = lambda *order: F.concat(*(F.get(parts, F.lit(k)) for k in order))
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
