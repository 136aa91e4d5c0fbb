"""Secret scans with multipart credential linking, with DataFrame functions only.

Base kinds are found by one pattern each, leftmost without overlap: `assign` (a named value of 12 or more characters), `access`
(an access identifier) and `hex` (a run of hexadecimal digits). The method adds weak candidates, too common to report alone:
`weak_id` (a named login, or a shorter access identifier), `weak_secret` (a named value of 6 to 11 characters, or a run of 40
base64 characters) and `endpoint` (a web address or an IPv4 address). Within a scope of SCOPE code points, an identifier
(access, weak_id), a secret (assign, hex, weak_secret) and an endpoint complement each other: a weak identifier is reported
beside a secret, a weak secret beside an identifier, an endpoint beside both. The parts meet in an interval join on
(document, cell of the text), as a semi-join, so that no pairs are made.

Null texts count as empty, and null texts stay null when redacted. Spans are code points, the end exclusive. Rows that stand
twice get their spans twice. Texts of any length and any number of matches are scanned whole. Columns of the caller pass through
redaction whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, hash_counts, meet, nested, running, written

#: The base patterns of the contract, and the least lengths (of the value for `assign`).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Weak candidates: a pattern, and what a whole match must look like, as a run is found with all that belongs to it.
NAMED_ID = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
SHORT_ID = r"(?:AKIA|ASIA)[A-Z0-9]{8,}", r"^.{12,17}$"
WEAK_RUN = r"[A-Za-z0-9+/]{40,}", r"^.{40}$"
WEB = r"https?://[^\x20\x09-\x0D\x22'<>]{4,}"
IPV4 = r"[0-9][0-9.]{6,}(?::[0-9]+)?", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?$"
WEAK_VALUE = 6

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "weak_id"), ("assign", "hex", "weak_secret"), ("endpoint",)
SCOPE, CELL = 256, 1024
SPAN = "array<struct<start:int,kind:int,end:int>>"
REDACTED = "[REDACTED]"


FOUND = "array<struct<start:int,end:int,value:int>>"


def matches(text: Column, pattern: str, value_group: int = 0, whole: str = "") -> Column:
    """(start, end, size of the value) of each match: what lies between matches, and the matches, give the places.

    whole: a match that doesn't look so has no value.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group) if value_group else hits
    size = lambda v: F.when(v.rlike(whole), F.char_length(v)).otherwise(-1) if whole else F.char_length(v)
    sizes = F.zip_with(hits, values, lambda h, v: F.struct(F.char_length(h).alias("n"), size(v).alias("v")))
    both = F.zip_with(F.transform(F.split(text, pattern, -1), F.char_length), sizes, lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["v"].alias("v")))

    def placed(parts: Column) -> Column:
        before = running(F.transform(parts, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))), F.lit(0), lambda a, x: a + x)
        every = F.zip_with(parts, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["v"].alias("value")))
        return F.filter(every, lambda m: m["end"].isNotNull())

    return F.when(text.rlike(pattern), bound(both, placed).cast(FOUND)).otherwise(F.array().cast(FOUND))


def tagged(found: Column, kind: str, low: int = 0, high: int = 2**31 - 1) -> Column:
    kept = F.filter(found, lambda m: (m["value"] >= low) & (m["value"] <= high))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(SPAN)


def found_parts(docs: DataFrame) -> DataFrame:
    """(id, text) rows to (id, h1, h2, base, weak): spans of the base kinds, and weak candidates, each sorted by start and kind."""
    t = F.coalesce("text", F.lit(""))
    # a run that is long enough is found whole by the pattern that asks for its length
    named = docs.withColumn("named", matches(t, ASSIGN, 2))
    base = F.concat(tagged(F.col("named"), "assign", LEAST["assign"]), tagged(matches(t, ACCESS), "access", LEAST["access"]), tagged(matches(t, HEX.replace("+", f"{{{LEAST['hex']},}}")), "hex", LEAST["hex"]))
    weak = F.concat(
        tagged(matches(t, NAMED_ID), "weak_id"),
        tagged(matches(t, SHORT_ID[0], 0, SHORT_ID[1]), "weak_id"),
        tagged(F.col("named"), "weak_secret", WEAK_VALUE, LEAST["assign"] - 1),
        tagged(matches(t, WEAK_RUN[0], 0, WEAK_RUN[1]), "weak_secret"),
        tagged(matches(t, WEB), "endpoint"),
        tagged(matches(t, IPV4[0], 0, IPV4[1]), "endpoint"),
    )
    return named.select("id", "h1", "h2", F.array_sort(base).alias("base"), F.array_sort(weak).alias("weak"))


def linked(parts: DataFrame) -> DataFrame:
    """(h1, h2, base, weak) rows to (h1, h2, more): the weak candidates with their complements in scope."""
    key = ["h1", "h2"]
    every = parts.select(*key, F.explode(F.concat("base", "weak")).alias("p")).select(*key, "p.*")
    of_group = {k: [KINDS.index(x) for x in kinds] for k, kinds in (("id", IDENTIFIERS), ("secret", SECRETS), ("endpoint", ENDPOINTS))}

    def beside(left: DataFrame, other: str) -> DataFrame:
        cells = F.explode(F.sequence(F.expr(f"greatest(start - {SCOPE}, 0) div {CELL}"), F.expr(f"(end + {SCOPE}) div {CELL}")))
        right = every.where(F.col("kind").isin(of_group[other])).select(*(F.col(k).alias(f"r{k}") for k in key), F.col("start").alias("rstart"), F.col("end").alias("rend"), F.explode(F.sequence(F.expr(f"start div {CELL}"), F.expr(f"end div {CELL}"))).alias("rcell"))
        near = (F.col("h1") == F.col("rh1")) & (F.col("h2") == F.col("rh2")) & (F.col("cell") == F.col("rcell")) & (F.col("rstart") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("rend") + SCOPE)
        return left.withColumn("cell", cells).join(right.hint("merge"), near, "left_semi").drop("cell").distinct()

    weak = parts.select(*key, F.explode("weak").alias("p")).select(*key, "p.*")
    of = lambda kind: weak.where(F.col("kind") == KINDS.index(kind))
    kept = [beside(of("weak_id"), "secret"), beside(of("weak_secret"), "id"), beside(beside(of("endpoint"), "id"), "secret")]
    return reduce(DataFrame.unionByName, kept).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).cast(SPAN).alias("more"))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h1, h2, base, spans) of each row: its base spans, and all spans; h1 and h2 are those of common.nested()."""
    keyed = nested(docs.select(id_, text), id_, text).select(F.col(f"row.{id_}").alias("id"), "h1", "h2", F.col(f"row.{text}").alias("text"))
    return spans_of(written(found_parts(keyed), "secret-parts"))


def spans_of(parts: DataFrame) -> DataFrame:
    """scan()'s rows from those of found_parts(). Rows alike in id and text are one with a number while they are linked."""
    once = parts.where("size(weak) > 0").groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("id", "base", "weak")), F.count("*").alias("n"))
    out = once.join(linked(once).hint("merge"), ["h1", "h2"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans")
    out = out.select("id", "h1", "h2", "base", spans, F.explode(F.expr("sequence(1, n)")).alias("again")).drop("again")
    return out.unionByName(parts.where("size(weak) = 0").select("id", "h1", "h2", "base", F.col("base").alias("spans")))


def redacted(text: Column, spans: Column) -> Column:
    """text with each union of overlapping spans replaced by REDACTED; spans are sorted by start."""

    def cut(every: Column) -> Column:
        reached = running(F.transform(every, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        first = F.zip_with(every, reached, lambda s, at: F.when(s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to"))))
        kept = F.transform(F.filter(first, lambda g: g.isNotNull()), lambda g: F.substr(text, g["from"] + 1, g["to"] - g["from"]))
        end = F.array_max(F.transform(every, lambda s: s["end"]))
        return F.array_join(F.concat(kept, F.array(F.substr(text, end + 1, F.char_length(text)))), REDACTED)

    return F.when(F.size(spans) > 0, bound(spans, cut)).otherwise(text)


def redact(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with secrets replaced in their texts."""
    keyed = nested(docs, id_, text)
    parts = written(found_parts(keyed.select(F.col(f"row.{id_}").alias("id"), "h1", "h2", F.col(f"row.{text}").alias("text"))), "secret-parts")
    spans = spans_of(parts).where("size(spans) > 0").select("h1", "h2", "spans").dropDuplicates(["h1", "h2"])
    joined = meet(keyed, spans, hash_counts(parts), "left")
    shown = redacted(F.col(f"row.{text}"), F.coalesce("spans", F.array().cast(SPAN)))
    return joined.select(F.col("row").withField(text, shown).alias("row")).select("row.*")
