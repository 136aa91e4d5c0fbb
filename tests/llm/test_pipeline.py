"""Each stage of the pipeline against a brute-force version, on its own input."""

import base64
import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F
from test_near_dup import brute as components
from test_secrets import all_spans

from recollect.llm import mixing, quality, secrets
from recollect.llm.common import nested, table, written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def redacted(text):
    out, at = [], 0
    for start, _, end in all_spans(text or ""):
        if out and start < at:
            at = max(at, end)
            continue
        out += [text[at:start], secrets.REDACTED]
        at = end
    return text if not out else "".join(out) + text[at:]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "secrets", "mixing", "bpe"]
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        docs = written(stage(spark, docs, SF), f"test-{name}")
        if name != "bpe":
            assert docs.columns == COLUMNS
    seen["end"] = docs.collect()

    p = quality.Params()
    weights, bias = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), p)
    good = quality.mean_scores([r.text or "" for r in seen["quality"]], weights, bias, p)[:, 0] >= p.threshold
    assert sorted(seen["near_dup"]) == sorted(r for r, ok in zip(seen["quality"], good, strict=True) if ok) and 0 < len(seen["near_dup"]) < len(seen["quality"])

    kept = {i for i, _, c in components([(r.doc_id, r.text) for r in seen["near_dup"]]) if i == c}
    assert sorted(seen["secrets"]) == sorted(r for r in seen["near_dup"] if r.doc_id in kept) and len(kept) < len(seen["near_dup"])

    want = [(r.doc_id, t := redacted(r.text), r.lang, r.source, len(t)) for r in seen["secrets"]]
    assert sorted(map(tuple, seen["mixing"])) == sorted(want) and any(secrets.REDACTED in r.text for r in seen["mixing"])

    df = spark.createDataFrame(seen["mixing"], "doc_id long, text string, lang string, source string, n_chars long")
    keyed = nested(df).select(F.struct("h1", "h2", F.xxhash64("row.source").alias("h3")).alias("key"), "row.source", mixing.words(F.col("row.text")).alias("size"))
    ids = {(r.h1, r.h2): r.doc_id for r in nested(df).select("h1", "h2", "row.doc_id").collect()}
    taken = {ids[r.key["h1"], r.key["h2"]]: int(r.taken / r.size + 0.5) for r in mixing.mix(keyed, key="key").collect() if r.size}
    copies = Counter(r.doc_id for r in seen["bpe"])
    assert copies == Counter({i: n for i, n in taken.items() if n}) and max(copies.values()) <= 2 and set(seen["bpe"]) <= set(seen["mixing"])
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(seen["bpe"]) / words(seen["mixing"]) - 1.5) < 0.1

    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    texts = {r.doc_id: r.text for r in seen["bpe"]}
    assert len(seen["end"]) == len(seen["bpe"])
    for r in seen["end"]:
        assert b"".join(ranks[k] for k in r.ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


NAMES = ["_id", "_hash", "_spans", "_copies", "_copy", "_score", "score", "cls", "sig", "n_shingles", "row", "h1", "spans", "key"]


def test_stages_on_odd_rows(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, clashing names; and no rows at all."""
    t = " ".join(f"word{k} and" for k in range(40))
    rows = [(1, t, "en", "a", 5), (1, t, "en", "a", 5), (1, t, "de", "a", 5), (2, t, "en", "a", 5), (None, t + " token=abcdefghijklmnop", None, None, None), (3, None, "en", "b", 7), (4, "", None, "b", 0), (5, " ", "en", None, 1)]
    rows += [(6, "long text goes on " * 20_000, "en", "b", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.coalesce("doc_id", F.lit(-1)) for c in NAMES}).withColumn("a map", F.create_map(F.lit("k"), "n_chars"))
    own = lambda r: all(r[c] == (-1 if r.doc_id is None else r.doc_id) for c in NAMES)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name == "bpe":
                assert len(got) == docs.count()
                continue
            assert out.dtypes == docs.dtypes and all(own(r) for r in got), name
            if name == "near_dup":
                assert sorted((str(r.doc_id), str(r.text)[:9], str(r.lang)) for r in got) == sorted((str(i), str(x)[:9], str(la)) for i, x, la, *_ in {r for r in rows if r[0] not in (2,) and not (r[0] is None and r[1])} if docs is df)
            if name == "secrets":
                assert sorted(str(r.text) for r in got) == sorted(str(r.text).replace("token=abcdefghijklmnop", secrets.REDACTED) for r in docs.collect())
            if name == "mixing":
                assert {r.doc_id for r in got} <= {1, 2, 6, None} and all(r.text and r.text.strip() for r in got)
