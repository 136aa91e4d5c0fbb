"""Each registered query on the smallest tables: against its SQL, or against a plain version."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_fingerprint import brute as fingerprints
from test_mixing import targets

import __spark_entry__ as entry
from recollect.llm import mixing, quality, queries, toxicity
from recollect.llm.common import table

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def test_op1(spark):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("peer", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, x in documents(spark):
        ids = peer.encode_ordinary(x or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())))
    assert sorted(tuple(r) for r in entry.queries()["op1_bpe"](spark, SF).collect()) == sorted(want)


def test_op6(spark):
    rows = [(i, (x or "")[:400]) for i, x in documents(spark)]
    got = entry.queries()["op6_fingerprint"](spark, SF)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    short = [r for r in documents(spark) if len(r[1] or "") < 400]
    out = {r.doc_id: r for r in got.collect()}
    plain = {r[0]: r for r in fingerprints(spark, rows)}
    assert len(out) == len(rows) and short and all(out[i].fingerprint == plain[i][3] and out[i].n_chars == plain[i][1] for i, _ in short)


M = (1 << 64) - 1
GOLD, BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def run_hash(word):
    return mix((sum(mix((ord(c) + 1) * GOLD & M) * pow(BASE, k, 1 << 64) for k, c in enumerate(word)) + len(word)) & M)


def subwords(text, bits, sizes):
    """Buckets of one text, from the rule."""
    words = text.split()
    out = [run_hash(w) >> 64 - bits for w in words] + [0] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    padded = "\n" + text + "\n"
    for n in sizes:
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if any(c.isspace() for c in g[1:-1]) or n == 2 and g.isspace():
                continue
            h = n
            for c in g:
                h = (h ^ (1 if c.isspace() else ord(c) + 1)) * GOLD & M
                h ^= h >> 29
            out.append(mix(h) >> 64 - bits)
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op7(spark):
    p = quality.Params()
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights, bias = quality.fit(docs, labels, p)
    got = {r.doc_id: r for r in entry.queries()["op7_quality"](spark, SF).collect()}
    texts = dict(documents(spark))
    for i, x in sorted(texts.items(), key=lambda r: (len(r[1] or ""), r[0]))[:60]:
        buckets = subwords(x or "", p.bits, p.sizes)
        want = 1 / (1 + np.exp(-(bias + (np.mean(weights[buckets].astype(float)) if buckets else 0))))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == (want >= 0.7)
    assert len(got) == len(texts) and all(r.held_out == held(i) for i, r in got.items())
    truth = {r.doc_id: r.quality for r in table(spark, LARGER, "labels").collect()}
    got = {r.doc_id: r for r in entry.queries()["op7_quality"](spark, LARGER).collect()}
    out = [r.predicted == truth[i] for i, r in got.items() if r.held_out and truth.get(i) in (0, 1)]
    assert len(out) > 50 and sum(out) >= 0.9 * len(out)


def test_op9(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    (weights, cuts), p = toxicity.tuned(docs, labels)
    assert p.threshold in p.thresholds and p.evidence in p.evidences
    got = {r.doc_id: r for r in entry.queries()["op9_toxicity"](spark, SF).collect()}
    texts = dict(documents(spark))
    for i, x in sorted(texts.items(), key=lambda r: (len(r[1] or ""), r[0]))[:60]:
        z = sum(float(weights[b]) for b in {run_hash(w) >> 64 - p.bits for w in re.findall(r"[^\W\d_]+", (x or "").lower())})
        up = [1 / (1 + np.exp(-np.clip(z - c, -35, 35))) for c in cuts]
        assert abs(got[i].severity - sum(up)) < 1e-6 and abs(got[i].p_toxic - up[0]) < 1e-6 and got[i].toxic == (up[0] >= 0.5 or up[0] >= p.threshold and z >= np.log(p.evidence))
    assert len(got) == len(texts) and all(r.held_out == held(i) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in table(spark, LARGER, "labels").collect()}
    got = {r.doc_id: r for r in entry.queries()["op9_toxicity"](spark, LARGER).collect()}
    out = [r.toxic == bool(truth[i]) for i, r in got.items() if r.held_out and truth.get(i) in (0, 1)]
    assert len(out) > 50 and sum(out) >= 0.9 * len(out)


def test_op8(spark):
    rows = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in table(spark, SF, "documents").select("doc_id", "source", "text").collect()}
    sizes = {}
    for s, n in rows.values():
        sizes[s] = sizes.get(s, 0) + n
    want, taken = targets(sizes), {}
    got = entry.queries()["op8_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        s, n = rows[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * n
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_schedule_and_blocks(spark):
    """The slots of sources and the words of documents, from the rules, one after another."""
    p = mixing.Params(block=8, group=4)
    rows = [(i, ["a", "b", "c"][min(2, i % 5)], i * 7 % 23) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(p.seed), "doc_id").alias("h")).collect()}
    sources = {r.source: r for r in mixing.targets(df, p).collect()}
    n, bounds, at = sum(r.slots for r in sources.values()), {}, 0
    for s in sorted(sources):
        bounds[s] = (int(at / n * mixing.UNIT), int((at + sources[s].slots) / n * mixing.UNIT))
        at += sources[s].slots
    slots, ranks = [], dict.fromkeys(sources, 0)
    for k in range(n):
        u = (k + p.seed) % mixing.UNIT * mixing.STEP % mixing.UNIT
        s = next(s for s, (lo, hi) in bounds.items() if lo <= u < hi)
        if ranks[s] < sources[s].slots:
            slots.append((k, sources[s].source_no, ranks[s]))
        ranks[s] += 1
    for s, r in sources.items():
        slots += [(n + k, r.source_no, k) for k in range(ranks[s], r.slots)]
    assert sorted(tuple(r) for r in mixing.schedule(mixing.targets(df, p), p).collect()) == sorted(slots)
    counts = {s: sum(x[1] == r.source_no for x in slots) for s, r in sources.items()}
    want = {}
    for s, r in sources.items():
        docs = sorted((i for i, src, size in rows if src == s and size), key=lambda i: ((order[i] & M) >> 33, order[i], i))
        line = [i for i in docs for _ in range(rows[i][2])]
        assert counts[s] == r.slots
        for k in range(r.slots):
            epoch, block = divmod(k, r.blocks)
            limit = p.block if epoch < r.epochs else min(p.block, r.rest - block * p.block)
            for i in line[block * p.block :][: p.block][:limit]:
                want[i] = want.get(i, 0) + 1
    assert {r.doc_id: r.taken for r in mixing.mix(df, p).collect()} == {i: want.get(i, 0) for i, _, _ in rows}
