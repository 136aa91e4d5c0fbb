"""Byte-level BPE encoding and decoding over rank files.

Pieces (matches of the split pattern) of about a megabyte of text are made distinct, sorted into padded numpy matrices by
length, and merged together: in each round every row merges its leftmost pair of least rank, found in a hashed pair table;
the row is compacted, and finished rows leave the matrix.

A piece wider than WINDOW is wrapped: its row goes on over several windows, each with its least rank at hand, so that a round
looks only into windows that hold the row's least rank. In a round such a row merges all its pairs of that rank from the left,
as far as one merge a round would do the same: up to the first that makes a pair of lower rank. Pieces of any length so take
as many rounds as there are ranks in them, not merges.

Null texts count as empty and have no tokens. Every row of the input gives one row, repeated rows too; other columns pass
through and clash with nothing, as the two new columns' names are parameters (a caller's column of such a name gives way).
An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_chunks

#: Columns of a matrix; wider rows are wrapped.
WINDOW = 512
#: Bytes of the wrapped pieces that are merged together.
WRAPPED = 1 << 20
#: A worker forgets its pieces beyond this many; only speed depends on it.
KEEP_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class Ranks:
    """The vocabulary of a rank file (base64 token, rank) with a hashed table of mergeable pairs."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        # Unicode's White_Space, as the libraries for rank files have it, without the separators that Python adds
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        tokens = sorted(self.rank, key=self.rank.get)
        ids = np.array([self.rank[t] for t in tokens], np.int64)
        sizes = np.zeros(int(ids.max()) + 1, np.int64)
        sizes[ids] = [len(t) for t in tokens]
        self.token_bytes, self.token_size = np.frombuffer(b"".join(tokens), np.uint8), sizes
        self.token_start = np.cumsum(sizes) - sizes
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        rank = self.rank
        pairs = [(rank[t[:k]], rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        a, b, r = np.array(pairs, np.int64).T
        self._fill((a << 32) | b, r.astype(np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probes; depth is the longest probe."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        self.keys, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left, self.depth = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.depth += 1
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # the last of those that met here stays
            won = left[self.keys[at[left]] == keys[left]]
            self.found[at[won]] = ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merge, NONE where there is none."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        at, mask = self._slot(keys), (1 << self.bits) - 1
        out = np.where(self.keys[at] == keys, self.found[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.depth - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & mask
            here = self.keys[at[open_]]
            hit = open_[here == keys[open_]]
            out[hit] = self.found[at[hit]]
            open_ = open_[(here != keys[open_]) & (here != -1)]
        return out

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """The tokens of each row of a matrix padded with -1 at its right."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            every = np.arange(len(rows))
            least = rank[every, at] if rank.shape[1] else np.full(len(rows), NONE)
            if (over := least == NONE).any():
                for k in np.flatnonzero(over):
                    out[rows[k]] = ids[k][ids[k] >= 0]
                go = ~over
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            ids[every, at] = least
            width = ids.shape[1] - 1
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            column = np.arange(width - 1)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1) if width > 1 else rank[:, :0]
            for k in (at - 1, at):
                ok = (k >= 0) & (k < width - 1)
                r, c = every[ok], k[ok]
                rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        return out

    def merge_wrapped(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The tokens of pieces that are wider than a matrix, by the same merges."""
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        kept = [self.byte_id[np.frombuffer(p, np.uint8)] for p in pieces]
        while len(rows):
            # each row fills whole windows; a dead or padded place has id -1 and no rank
            wide = np.array([-(-len(x) // WINDOW) for x in kept])
            first = np.concatenate(([0], np.cumsum(wide)))
            ids = np.full(first[-1] * WINDOW, -1, np.int32)
            after, before = np.full(len(ids), -1), np.full(len(ids), -1)
            for x, w in zip(kept, first, strict=False):
                at = np.arange(w * WINDOW, w * WINDOW + len(x))
                ids[at], after[at[:-1]], before[at[1:]] = x, at[1:], at[:-1]
            here = np.flatnonzero(after >= 0)
            rank = np.full(len(ids), NONE, np.int32)
            rank[here] = self.pair_rank(ids[here], ids[after[here]])
            low = rank.reshape(-1, WINDOW).min(1)
            row_of = np.repeat(np.arange(len(rows)), wide)
            alive = size = int((ids >= 0).sum())
            while 2 * alive > size:
                least = np.minimum.reduceat(low, first[:-1])
                windows = np.flatnonzero((low == least[row_of]) & (low < NONE))
                if not len(windows):
                    break
                w, c = np.nonzero(rank.reshape(-1, WINDOW)[windows] == low[windows][:, None])
                alive -= self._merge_all(windows[w] * WINDOW + c, ids, rank, after, before, low, row_of)
            least = np.minimum.reduceat(low, first[:-1])
            left = [ids[a * WINDOW : b * WINDOW] for a, b in zip(first[:-1], first[1:], strict=True)]
            left = [x[x >= 0] for x in left]
            for k in np.flatnonzero(least == NONE):
                out[rows[k]] = left[k]
            go = np.flatnonzero(least < NONE)
            rows, kept = rows[go], [left[k] for k in go]
        return out

    def _merge_all(self, at: np.ndarray, ids: np.ndarray, rank: np.ndarray, after: np.ndarray, before: np.ndarray, low: np.ndarray, row_of: np.ndarray) -> int:
        """Merges the pairs that begin at the places `at`, of one rank a row, from the left; how many it were."""
        # of pairs that overlap, every other one from the left
        chained = np.zeros(len(at), bool)
        chained[1:] = after[at[:-1]] == at[1:]
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        made, right, left = rank[at], after[after[at]], before[at]
        # as one merge a round sees it: what is left of a merge is merged already, what is right of it is not
        merged_left = np.zeros(len(at), bool)
        merged_left[1:] = after[after[at[:-1]]] == at[1:]
        beside = np.where(left >= 0, ids[left], -1)
        beside[1:] = np.where(merged_left[1:], made[:-1], beside[1:])
        lower = np.minimum(self.pair_rank(beside, made), self.pair_rank(made, np.where(right >= 0, ids[right], -1))) < made
        if lower.any():
            row = row_of[at // WINDOW]
            stop = np.full(int(row_of[-1]) + 1, len(at))
            np.minimum.at(stop, row[lower], np.flatnonzero(lower))
            go = np.arange(len(at)) <= stop[row]
            at, made = at[go], made[go]
        gone = after[at]
        right = after[gone]
        ids[at], ids[gone], rank[gone] = made, -1, NONE
        after[at] = right
        before[right[right >= 0]] = at[right >= 0]
        left = before[at]
        for one, two in ((at, after[at]), (left[left >= 0], at[left >= 0])):
            # a place at the left may itself have been merged: its right side is what stands there now
            rank[one] = self.pair_rank(ids[one], np.where(two >= 0, ids[two], -1))
        touched = np.unique(np.concatenate([at, gone, left[left >= 0]]) // WINDOW)
        low[touched] = rank.reshape(-1, WINDOW)[touched].min(1)
        return len(at)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of each piece, by matrices of pieces of like length."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        wrapped: list[int] = []
        for k, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[k] = np.array([r], np.int32)
            elif len(p) > WINDOW:
                wrapped.append(k)
            else:
                by_size.setdefault(-(-len(p) // 4) * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(k)
        for lo, hi in in_chunks([pieces[k] for k in wrapped], WRAPPED):
            for k, x in zip(wrapped[lo:hi], self.merge_wrapped([pieces[k] for k in wrapped[lo:hi]]), strict=True):
                out[k] = x
        for width, found in by_size.items():
            for lo in range(0, len(found), step := max(1, (1 << 18) // width)):
                part = found[lo : lo + step]
                flat = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in part]), np.uint8).reshape(-1, width)
                ids = self.byte_id[flat]
                ids[np.arange(width) >= np.array([len(pieces[k]) for k in part])[:, None]] = -1
                for k, x in zip(part, self.merge_matrix(ids), strict=True):
                    out[k] = x
        return out


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start+size] of each, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Codec:
    """Encodes lists of texts, keeping the tokens of pieces that it has met."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and how many of them each text has."""
        if len(self.index) > KEEP_PIECES:
            self.forget()
        split, index = self.ranks.split, self.index
        parts = [split(x) for x in texts]
        at = list(map(index.get, chain.from_iterable(parts)))
        if None in at:
            new = list({p for p, k in zip(chain.from_iterable(parts), at, strict=True) if k is None})
            tokens = self.ranks.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            size = np.array([len(x) for x in tokens], np.int64)
            start = len(self.flat) + np.cumsum(size) - size
            self.flat, self.start, self.size = np.concatenate([self.flat, *tokens]), np.concatenate([self.start, start]), np.concatenate([self.size, size])
            at = list(map(index.__getitem__, chain.from_iterable(parts)))
        at = np.array(at, np.int64)
        sizes = self.size[at]
        ids = gathered(self.flat, self.start[at], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum([len(own) for own in parts]))).astype(np.int64)
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and how many of them each text has."""
        r = self.ranks
        sizes = r.token_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return gathered(r.token_bytes, r.token_start[ids], sizes), np.diff(ends[bounds])


_codecs: dict = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and rank file, which lies on every machine."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            _codecs[path, pattern] = Codec(Ranks(f.readlines(), pattern))
    return _codecs[path, pattern]


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with its texts' token ids (array<int>) and, unless decoded is None, the bytes that these ids decode to. No shuffle."""
    taken = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([*(df.schema[c] for c in taken), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema.add(decoded, T.BinaryType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for lo, hi in in_chunks(texts):
                tokens, counts = own.encode(texts[lo:hi])
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                out = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in taken]
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.int32())))
                if decoded:
                    data, sizes = own.decode(tokens, counts)
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    out.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]))
                yield pa.RecordBatch.from_arrays(out, names=[*taken, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that each row's ids decode to; null ids decode to nothing."""
    taken = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in taken), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [np.array(x or [], np.int64) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            data = [own.decode(x, np.array([len(x)]))[0].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in taken), pa.array(data, pa.binary())], names=[*taken, decoded])

    return df.mapInArrow(run, schema)
