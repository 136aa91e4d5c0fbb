import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from recollect.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("peer", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(peer):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab b\n\t'sé漢\U0001f642 \x1c\x85\xa0it're") for _ in range(rng.randint(0, 900))) for _ in range(200)]
    texts += ["", "a" * 5000, "ab" * 3000, "é" * 4000, " " * 3000 + "x", "<|endoftext|>"]
    own = bpe.codec(PATH, P.PATTERN)
    ids, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == peer.encode_ordinary(text)
        at += n
    data, sizes = own.decode(ids, counts)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(x.encode()) for x in texts]


def test_long_pieces(peer):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    runs = ["".join(rng.choice(letters) for _ in range(n)) for n in (513, 1023, 1024, 5000, 70_000)] + ["a" * 1_000_000, "the" * 3000 + "a" * 777, "-=" * 3000, "é" * 2000]
    runs += ["".join(rng.choice(letters) for _ in range(1_000_000))]
    own = bpe.codec(PATH, P.PATTERN)
    ids, counts = own.encode(runs)
    at = 0
    for text, n in zip(runs, counts, strict=True):
        assert ids[at : at + n].tolist() == peer.encode_ordinary(text)
        at += n


def one_by_one(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        r, k = min((ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if r == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[x] for x in parts]


def test_wrapped_rows_whatever_the_ranks(monkeypatch):
    """Vocabularies in which a merge may make a pair of lower rank."""
    monkeypatch.setattr(bpe, "WINDOW", 4)
    rng = random.Random(9)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        for _ in range(25):
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        many = [t for t in tokens if len(t) > 1]
        rng.shuffle(many)
        ranks = {t: k for k, t in enumerate([bytes([b]) for b in range(256)] + many)}
        own = bpe.Ranks([base64.b64encode(t) + b" %d" % r for t, r in ranks.items()], ".+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 60))) for _ in range(8)]
        assert [x.tolist() for x in own.encode_pieces(pieces)] == [[ranks[p]] if p in ranks else one_by_one(ranks, p) for p in pieces]


def test_forgetting_pieces_changes_nothing(peer, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_PIECES", 3)
    own = bpe.Codec(bpe.codec(PATH, P.PATTERN).ranks)
    for text in ("one two three four five", "six seven", "one two"):
        assert own.encode([text])[0].tolist() == peer.encode_ordinary(text)


def test_rows(spark, peer):
    rows = [(1, None, "x"), (None, "", "y"), (2, "same text", "z"), (2, "same text", "z"), (3, "long " * 50_000, None), (4, "x" * 20_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_decode(df, PATH, P.PATTERN).collect()  # the column ids clashes and gives way
    assert len(out) == 6
    for r in out:
        assert r.ids == peer.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    again = bpe.decode(bpe.encode_decode(df, PATH, P.PATTERN, decoded=None), PATH, P.PATTERN)
    assert {hashlib.sha256(bytes(r.decoded)).hexdigest() for r in again.collect()} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    wide = df.select("doc_id", "text", F.create_map(F.lit("a"), "doc_id").alias("a map"), F.lit(1).alias("decoded"))
    assert {(r.doc_id, tuple(r["a map"].items())) for r in bpe.encode_decode(wide, PATH, P.PATTERN).collect()} == {(i, (("a", i),)) for i, *_ in rows}
    assert bpe.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0
