"""URL filters: host-and-path rules and pattern rules, all indexed by their rarest literal token.

A host rule fits its host and all subdomains, where the url's path begins with the rule's; of those that fit, the longest wins
(then the first by name). A pattern rule is a text in which `*` stands for anything, `^` for a separator or the end, and a
leading `||` for the start of the host or of one of its parents; `@@` before all makes it an exception. A url that no host
rule fits is blocked if a blocking pattern fits and no exception does.

The literal tokens of a rule are those runs of letters and digits that any match must hold as whole tokens. Each rule is filed
under the one of them that the fewest urls hold; a url's tokens fetch the rules that may fit, and only those are tried. Rules
without such a token are filed under the empty one, which every url has. Rules are tables of any size: tokens and regular
expressions are made by column functions, and the index is broadcast only up to BROADCAST_RULES rules.

Null urls, and urls without `://`, have an empty host and path and fit no host rule; a null url fits no pattern. Each row of
the input gives one row, repeated rows too. Equal urls are judged once; a url of many rows meets its verdict by broadcast.
Urls of any length are judged whole. Columns pass through whatever their names; those named like a result give way to it. Empty
tables of pages or rules are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Beyond so many rules the index is joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000
#: What an anchored pattern begins with, and what a separator is.
HOST_START, SEPARATOR = "^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?", "(?:[^a-z0-9_.%-]|$)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def pattern_body(pattern: Column) -> tuple[Column, Column]:
    """A pattern without its marks, in lower case, and whether it is anchored to a host."""
    bare = F.regexp_replace(pattern, "^@@", "")
    return ascii_lower(F.regexp_replace(bare, r"^\|\|", "")), F.startswith(bare, F.lit("||"))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern, for lower-cased urls."""
    body, anchored = pattern_body(pattern)
    quoted = F.regexp_replace(body, r"([\\.+?(){}\[\]|$])", r"\\$1")
    return F.concat(F.when(anchored, HOST_START).otherwise(""), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR)))


def pattern_tokens(pattern: Column) -> Column:
    """Runs of letters and digits with a literal, a separator or an anchor on either side."""
    body, anchored = pattern_body(pattern)
    marked = F.concat(F.when(anchored, "|").otherwise("*"), body, F.lit("*"))
    return F.array_distinct(F.regexp_extract_all(marked, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), 0))


def host_tokens(host: Column, path: Column) -> Column:
    """Those of the host, and those within the path: its last run may go on in a url."""
    found = [F.regexp_extract_all(ascii_lower(c), F.lit(p), 0) for c, p in ((host, "[a-z0-9]+"), (path, "(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])"))]
    return F.array_distinct(F.concat(*found))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url, the empty one always among them."""
    return F.array_union(F.split(ascii_lower(url), "[^a-z0-9]+"), F.array(F.lit("")))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df.hint("merge")


def rule_index(urls: DataFrame, hosts: DataFrame, patterns: DataFrame) -> tuple[DataFrame, int]:
    """(token, name, host, path, verdict, regex, exception): each rule under its rarest token, a host rule without regex; and their number."""
    none = F.lit(None).cast("string")
    host = hosts.select(F.concat("host", "path").alias("name"), "host", "path", "verdict", none.alias("regex"), F.lit(False).alias("exception"), host_tokens(F.col("host"), F.col("path")).alias("tokens"))
    pattern = F.col("pattern")
    other = patterns.where("pattern IS NOT NULL").select(pattern.alias("name"), none.alias("host"), none.alias("path"), none.alias("verdict"), pattern_regex(pattern).alias("regex"), F.startswith(pattern, F.lit("@@")).alias("exception"), pattern_tokens(pattern).alias("tokens"))
    every = host.unionByName(other).distinct()
    rules = written(every.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))), "url-rules")
    n = rules.count()
    flat = rules.select(*(c for c in rules.columns if c != "tokens"), F.explode("tokens").alias("token"))
    wanted = flat.select("token").distinct()
    counts = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).join(sized(wanted, n), "token").groupBy("token").count()
    own = [c for c in flat.columns if c != "token"]
    ranked = flat.join(counts.hint("merge"), "token", "left").groupBy(*own)
    return ranked.agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token")), n


def judge(pages: DataFrame, hosts: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the host rule's host and path) and verdict. hosts: (verdict, host, path), patterns: (pattern)."""
    kept = [c for c in pages.columns if c == url or c not in ("host", "path", "rule", "verdict")]
    dealt = F.xxhash64(*(F.col(f"`{c}`") for c in pages.columns if "map<" not in pages.schema[c].dataType.simpleString()))
    keyed = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{url}`").alias("url"), dealt.alias("deal"))
    urls = keyed.where("url IS NOT NULL").select("url")
    index, n = rule_index(urls, hosts, patterns)
    index = index.select(*(F.col(c).alias(f"r_{c}") for c in index.columns))
    host, path = host_path(F.col("url"))
    split = urls.select("url", host.alias("host"), path.alias("path"), F.explode(url_tokens(F.col("url"))).alias("token"))
    fetched = split.join(sized(index, n), F.col("token") == F.col("r_token"))
    own = ((F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host"))) & F.startswith("path", F.col("r_path"))
    fits = F.when(F.col("r_regex").isNull(), own & (F.instr("url", "://") > 0)).otherwise(F.regexp_like(ascii_lower(F.col("url")), F.col("r_regex")))
    is_host, exception = F.col("r_regex").isNull(), F.col("r_exception")
    best = F.min(F.when(is_host, F.struct((-F.char_length("r_name")).alias("n"), F.col("r_name").alias("rule"), F.col("r_verdict").alias("said"))))
    found = fetched.where(fits).groupBy("url").agg(best.alias("best"), F.bool_or(~is_host & ~exception).alias("blocked"), F.bool_or(~is_host & exception).alias("excepted"))
    found = found.select("url", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.when(F.col("blocked") & ~F.col("excepted"), "block").otherwise("allow")).alias("verdict"))
    counts = keyed.groupBy("url").agg(F.count("*").alias("c"))
    out = spread_join(keyed, found, "url", hot_keys(counts.where("url IS NOT NULL"), "url", "c", keyed.count()), "left", ["deal"])
    return out.select("row.*", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
