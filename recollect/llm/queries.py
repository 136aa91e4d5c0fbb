"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, features, fim, fingerprint, mixing, near_dup, ngram_join, quality, resampling, secrets, topk, toxicity, url_filter
from .common import table, written


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantized(F.col("embedding")).alias("vector"))
    found = topk.top_k(rows.where("id % 50 = 0"), rows, 5)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


#: The host rules of op4's contract (verdict, host, path).
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The pattern rules of the production query: families of junk hosts, banners, and help pages that stay.
PATTERNS = [
    "||casino-*^", "||*.casino-*^", "||adult-*^", "||*.adult-*^", "||cheap-pills.*", "||*.cheap-pills.*", "||free-bets.*", "||*.free-bets.*", "||ads-track.*", "||*.ads-track.*", "||spam-farm.*", "||*.spam-farm.*",
    "||*.top-replica^", "/ad/banner^", "@@||*.example.org/*/help^",
]


def rules(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A table of a few rules; longer lists are read from files."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(names.split(), r, strict=True))) for r in rows))))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, rules(spark, "verdict host path", HOST_RULES), rules(spark, "pattern", [(p,) for p in PATTERNS]))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.Params()
    model = quality.fit(docs, table(spark, sf_dir, "labels"), p)
    return quality.classify(docs, model, p).select("doc_id", features.held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.mix(written(docs, "mix-sizes"), mixing.Params())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.Params()
    model, p = toxicity.tuned(docs, table(spark, sf_dir, "labels"), p)
    return toxicity.grade(docs, model, p).select("doc_id", "severity", "p_toxic", "toxic", features.held_out().alias("held_out"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = chat.format_conversations(rows.unionByName(added))
    turns, learned = chat.read_back(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("loss"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_topk": op2_topk,
    "op3_secrets": op3_secrets,
    "op4_urls": op4_urls,
    "op5_near_dup": op5_near_dup,
    "op6_fingerprint": op6_fingerprint,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_fim": op11_fim,
    "op12_ngram_join": op12_ngram_join,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}


#: Hosts that the patterns block, written out for RE2; every rule is tried on every url.
_OP4_SQL = r"""
WITH r AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') rest,
  coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') low FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM r),
j AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?(casino|adult)-.*([^a-z0-9_.%-]|$)') OR regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?(.*[.])?(casino|adult)-.*([^a-z0-9_.%-]|$)')
    OR regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?(.*[.])?(cheap-pills|free-bets|ads-track|spam-farm)[.]') OR regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?.*[.]top-replica([^a-z0-9_.%-]|$)')
    OR regexp_matches(low, '/ad/banner([^a-z0-9_.%-]|$)') AS junk,
  regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?.*[.]example[.]org/.*/help([^a-z0-9_.%-]|$)') AS stays FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND junk AND NOT stays THEN 'block' ELSE 'allow' END AS verdict FROM j"""


#: The kinds of op3 in their order: patterns for RE2, the group of the value, and what the value or the match must look like.
_OP3_PARTS = [
    (0, r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, ".{12,}"),
    (1, r"AKIA[A-Z0-9]+", 0, ".{18,}"),
    (2, r"[0-9a-f]{16,}", 0, ".*"),
    (3, r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}""", 0, ".*"),
    (3, r"(?:AKIA|ASIA)[A-Z0-9]{8,}", 0, ".{12,17}"),
    (4, r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, ".{6,11}"),
    (4, r"[A-Za-z0-9+/]{40,}", 0, ".{40}"),
    (5, r"https?://[^\x20\x09-\x0D\x22''<>]{4,}", 0, "(?s:.*)"),
    (5, r"[0-9][0-9.]{6,}(?::[0-9]+)?", 0, r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?"),
]


def _op3_sql() -> str:
    """Places from what lies between matches; weak parts by comparing all parts of a text."""
    one = lambda kind, pattern, group, looks: f"""SELECT doc_id, text, {kind} kind, unnest(list_zip(regexp_split_to_array(text, '{pattern}')[:-2], regexp_extract_all(text, '{pattern}', 0), regexp_extract_all(text, '{pattern}', {group}))) m,
  generate_subscripts(regexp_extract_all(text, '{pattern}', 0), 1) n, '{looks}' looks FROM d WHERE regexp_matches(text, '{pattern}')"""  # noqa: E731
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(one(*x) for x in _OP3_PARTS)}),
w AS (SELECT doc_id, text, kind, looks, m[3] AS value, looks AS l, sum(length(m[1]) + length(m[2])) OVER (PARTITION BY doc_id, text, kind, looks ORDER BY n) AS stop, length(m[2]) AS size FROM m),
p AS (SELECT DISTINCT doc_id, text, kind, (stop - size)::BIGINT s, stop::BIGINT e FROM w WHERE regexp_full_match(value, looks)),
near AS (SELECT a.doc_id, a.text, a.kind, a.s, a.e, coalesce(bool_or(b.kind IN (1, 3)), false) has_id, coalesce(bool_or(b.kind IN (0, 2, 4)), false) has_secret FROM p a LEFT JOIN p b
  ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND b.s <= a.e + 256 AND a.s <= b.e + 256 GROUP BY ALL),
k AS (SELECT *, (['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint'])[kind + 1] || ':' || s || ':' || e span FROM near
  WHERE kind < 3 OR kind = 3 AND has_secret OR kind = 4 AND has_id OR kind = 5 AND has_id AND has_secret),
g AS (SELECT doc_id, text, count(*) FILTER (kind = 0) n_assign, count(*) FILTER (kind = 1) n_access, count(*) FILTER (kind = 2) n_hex,
  string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3) base, string_agg(span, ',' ORDER BY s, kind, e) spans FROM k GROUP BY ALL)
SELECT t.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM documents t LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM t.doc_id AND g.text = coalesce(t.text, '')"""


#: op5 by a self-join on shingles, its components by a recursive walk over links of distinct sets.
_OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4])) END s FROM w),
h AS (SELECT doc_id, len(s) n, md5(array_to_string(list_sort(s), chr(10))) cls, s FROM s),
c AS MATERIALIZED (SELECT cls, min(doc_id) least, any_value(n) n, any_value(s) s FROM h WHERE n > 0 GROUP BY cls),
x AS MATERIALIZED (SELECT cls, n, hash(unnest(s)) x FROM c),
i AS (SELECT a.cls a, b.cls b, a.n na, b.n nb, count(*) c FROM x a JOIN x b ON a.x = b.x AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * c >= 75 * (na + nb - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS start, a AS at FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.at),
top AS (SELECT r.start AS cls, min(c.least) component FROM r JOIN c ON c.cls = r.at GROUP BY r.start)
SELECT h.doc_id, h.n AS n_shingles, CASE WHEN h.n = 0 THEN h.doc_id ELSE coalesce(top.component, c.least) END AS component_id,
  h.doc_id = CASE WHEN h.n = 0 THEN h.doc_id ELSE coalesce(top.component, c.least) END AS kept
FROM h LEFT JOIN c ON c.cls = h.cls AND h.n > 0 LEFT JOIN top ON top.cls = h.cls AND h.n > 0"""


#: op12 by a self-join on all shingles, as op5.
_OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3])) END s FROM w),
h AS (SELECT doc_id, len(s) n, md5(array_to_string(list_sort(s), chr(10))) cls, s FROM s),
c AS MATERIALIZED (SELECT cls, min(doc_id) least, any_value(n) n, any_value(s) s FROM h WHERE n > 0 GROUP BY cls),
x AS MATERIALIZED (SELECT cls, n, hash(unnest(s)) x FROM c),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a.cls a, b.cls b, a.n na, b.n nb, count(*) c FROM x a JOIN x b ON a.x = b.x AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL) WHERE 100 * c >= 85 * (na + nb - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS start, a AS at FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.at),
top AS (SELECT r.start AS cls, min(c.least) component FROM r JOIN c ON c.cls = r.at GROUP BY r.start)
SELECT h.doc_id, h.n AS n_shingles, CASE WHEN h.n = 0 THEN h.doc_id ELSE coalesce(top.component, c.least) END AS component_id
FROM h LEFT JOIN c ON c.cls = h.cls AND h.n > 0 LEFT JOIN top ON top.cls = h.cls AND h.n > 0"""


#: op11 by lists of units.
_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) k FROM documents),
h AS (SELECT *, len(w) n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(k, i, 8))::BIGINT) h FROM d),
c AS (SELECT doc_id, text, w, n, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[:a], ''), '') pre, coalesce(array_to_string(w[a + 1:b], ''), '') mid, coalesce(array_to_string(w[b + 1:], ''), '') suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


#: op13 with CRC-32 byte by byte, for each distinct feature once.
_OP13_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
a AS (SELECT 0 kind, doc_id, row_number() OVER () no, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, doc_id, no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM a),
f AS MATERIALIZED (SELECT kind, no, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) x FROM w),
h AS (SELECT x, hex(encode(x)) h FROM (SELECT DISTINCT x FROM f)),
b AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 bucket FROM h, tab),
n AS MATERIALIZED (SELECT kind, no, bucket, count(*) n FROM f JOIN b USING (x) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE t FROM n GROUP BY ALL),
tot AS (SELECT coalesce(sum(s), 0) s, coalesce(sum(t), 0) t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((g.t + 1) * (tot.s + 10000) / ((g.s + 1) * (tot.t + 10000))))::BIGINT gain FROM g, tot),
v AS (SELECT no, sum(n) n, sum(n * gain) weight FROM n JOIN gain USING (bucket) WHERE kind = 0 GROUP BY no),
r AS (SELECT w.doc_id, len(w.w) words, coalesce(v.n, 0)::BIGINT n_features, coalesce(v.weight, 0)::BIGINT weight, (coalesce(v.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT score FROM w LEFT JOIN v USING (no) WHERE w.kind = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) o FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND o <= 5 * (SELECT count(*) FROM r WHERE words >= 20) // 100 THEN o END AS rank FROM o"""


ORACLE_SQL: dict[str, str] = {
    "op13_resampling": _OP13_SQL,
    "op11_fim": _OP11_SQL,
    "op12_ngram_join": _OP12_SQL,
    "op3_secrets": _op3_sql(),
    "op5_near_dup": _OP5_SQL,
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op4_urls": _OP4_SQL,
    "op10_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b')) n_text, length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b')) n_role,
  row_number() OVER w n, lag(role) OVER w was FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN n = 1 OR was <> role THEN 23 + n_role ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
