import bisect
import hashlib
import math
import random

from pyspark.sql import functions as F

from recollect.llm import fingerprint as P

MASK = 0xFFFFFFFF


def digest(data):
    """The digest from its rule, byte by byte: 256 counters of hashed triplets, their quartiles, the length's step."""
    counts = [0] * 256
    for k, (x, y, z) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]):
        for i in range(len(data) - z):
            h = (data[i + x] * 0x9E3779B1 & MASK) ^ (((data[i + y] * 0x85EBCA6B & MASK) << 1) & MASK) ^ (data[i + z] * 0xC2B2AE35 & MASK) ^ (k * 0x27D4EB2F & MASK)
            h ^= h >> 15
            h = h * 0x2C1B3C6D & MASK
            counts[h >> 24] += 1
    quartiles = [sorted(counts)[i] for i in (63, 127, 191)]
    return [bisect.bisect_left(quartiles, c) for c in counts], min(255, round(8 * math.log2(1 + len(data))))


def packed(d):
    return f"{d[1]:02x}" + f"{int(''.join(f'{q:02b}' for q in d[0]), 2):0128x}"


def likeness(a, b):
    apart = sum(abs(x - y) for x, y in zip(a[0], b[0], strict=True)) + max(0, abs(a[1] - b[1]) - 1)
    return 1 - min(256, apart) / 256


def brute(spark, rows):
    """Order: falling id, nulls last, then the text's hash, then the text."""
    hashes = dict(spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        a, b, c = (digest(x.encode()) for x in (t, edited, n))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), packed(a), packed(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in P.edited_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice([i, i * 1000, -i]), "".join(rng.choice("ab é\U0001f642") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(5, None), (5, ""), (5, "same"), (5, "same"), (None, "no id"), (10**15, "x" * 40_000)] + [(77, f"hot {k % 7}") for k in range(90)] + [(None, f"none {k}") for k in range(40)]
    assert got(spark, rows) == brute(spark, rows)


def test_few_rows(spark):
    for rows in ([(1, "alone here")], [(2, "b"), (1, "abcdef")], [(None, None)]):
        assert got(spark, rows) == brute(spark, rows)
    assert P.edited_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest():
    a = P.digest(b"some text of a document " * 9)
    assert (P.unpacked(P.packed(a)) == a).all() and P.likeness(a, a) == 1 and 0 <= P.likeness(a, P.digest(b"")) <= 1
    assert P.packed(P.digest(b"")) == P.packed(P.digest("".encode())) == packed(digest(b""))


def test_column(spark):
    df = spark.createDataFrame([(1, "abc", 9), (2, None, 9)], "doc_id long, text string, fingerprint long").withColumns({"range": F.lit(1), "id": F.lit("x"), "edge": F.lit(2)})
    assert sorted(tuple(r) for r in P.edited_rows(df).collect()) == brute(spark, [(1, "abc"), (2, None)])
    assert {r.doc_id: r.fingerprint for r in P.fingerprints(df).collect()} == {1: P.packed(P.digest(b"abc")), 2: P.packed(P.digest(b""))}
