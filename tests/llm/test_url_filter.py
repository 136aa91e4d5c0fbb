import random
import re

import duckdb
from pyspark.sql import functions as F

from recollect.llm import common
from recollect.llm import url_filter as U
from recollect.llm.queries import HOST_RULES, ORACLE_SQL, PATTERNS

URLS = [
    "https://WWW.Casino-win.example.org/en/14?page=2", "http://a.example.net/en/1", "http://a.example.net/de/1", "http://net/", "http://net", "http://xnet/", "https://m.adult-x.example.com/de/5#x",
    "https://m.adult-x.example.com/deu/5#x", "https://cheap-pills.io/help", "https://b.adult-z.example.org/fr/help", "https://b.adult-z.example.org/ff/help", "ftp://x.org/fr/", "no scheme", "", None, "http://a.net?u=/ad/banner",
    "http://q.io/ad/banner", "http://q.io/ad/banners", "https://q.io/é/ad/banner/", "https://İ.net/a", "http://user@h.example.net:80/en/",
]


SIGNS = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}


def regex(pattern):
    body = pattern.removeprefix("@@")
    return ("^[a-z][a-z0-9+.-]*://([^/?#]*[.])?" if body.startswith("||") else "") + "".join(SIGNS.get(c) or re.escape(c) for c in body.removeprefix("||").translate(str.maketrans(U.UPPER, U.LOWER)))


def expected(url, hosts, patterns):
    """Every rule tried on every url."""
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    name = re.match(r"[^/?#]*", rest)[0]
    host, path = name.translate(str.maketrans(U.UPPER, U.LOWER)), re.match(r"[^?#]*", rest[len(name) :])[0]
    fits = [(-len(h + p), h + p, v) for v, h, p in hosts if "://" in (url or "") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *min(fits)[1:]
    low = (url or "").translate(str.maketrans(U.UPPER, U.LOWER))
    hit = lambda exception: url is not None and any(re.search(regex(p), low) for p in patterns if p.startswith("@@") == exception)
    return host, path, None, "block" if hit(False) and not hit(True) else "allow"


def rules(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names.split()))


def judged(spark, df, hosts, patterns):
    return U.judge(df, rules(spark, "verdict host path", hosts), rules(spark, "pattern", [(p,) for p in patterns]))


def test_against_every_rule_on_every_url(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    rows = [(i, u, "extra", "clash") for i, u in enumerate([*URLS, *[URLS[0]] * 9, None, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").withColumns({"row": F.lit(7), "token": F.lit("t"), "r_name": F.create_map(F.lit(1), F.lit(2))})
    out = judged(spark, df, HOST_RULES, PATTERNS)
    assert out.columns == ["page_id", "url", "html", "row", "token", "r_name", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert sorted(r.page_id for r in got) == list(range(len(rows))) and all(r.row == 7 and r.r_name == {1: 2} for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == expected(r.url, HOST_RULES, PATTERNS), r.url


def test_thousands_of_rules(spark, monkeypatch):
    rng = random.Random(8)
    label = lambda: rng.choice(["shop", "x", "news", "a-b", "é", "cdn7", "top"]) + rng.choice(["", "1", "2", "-q"])
    name = lambda: ".".join(label() for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(["en", "De", "a1", "", "ad.x"]) for _ in range(rng.randint(0, 3)))
    hosts = sorted({(rng.choice(["block", "allow"]), name(), path()) for _ in range(2000)})
    hosts = list({h + p: (v, h, p) for v, h, p in hosts}.values())  # one verdict a rule
    patterns = sorted({rng.choice(["", "@@"]) + rng.choice(["", "||"]) + rng.choice(["", "*", "^"]) + label() + rng.choice(["^", "*", "/", ".*", "", "+("]) + rng.choice(["", "en^", "a1"]) for _ in range(400)})
    urls = ["http://" + name().upper() + path() + rng.choice(["", "?q=top", "#en"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (50_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(U, "BROADCAST_RULES", most)
        for r in judged(spark, df, hosts, patterns).collect():
            assert (r.host, r.path, r.rule, r.verdict) == expected(r.url, hosts, patterns), r.url


def test_like_sql(spark):
    rows = list(enumerate(URLS))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(ORACLE_SQL["op4_urls"]).fetchall()
    assert sorted(want) == sorted((i, *expected(u, HOST_RULES, PATTERNS)) for i, u in rows)


def test_tokens_and_rarity(spark):
    p = F.col("pattern")
    found = {r.pattern: sorted(r.t) for r in rules(spark, "pattern", [("||cheap-pills.*",), ("||*.casino-*^",), ("ad*",), ("/ad/banner^",)]).select("pattern", U.pattern_tokens(p).alias("t")).collect()}
    assert found == {"||cheap-pills.*": ["cheap", "pills"], "||*.casino-*^": ["casino"], "ad*": [], "/ad/banner^": ["ad", "banner"]}
    urls = spark.createDataFrame([("http://a.net/en/x",), ("http://b.net/en/",), ("http://c.net/",)], "url string")
    index, n = U.rule_index(urls, rules(spark, "verdict host path", [("block", "net", "/en/x"), ("allow", "é", "/p")]), rules(spark, "pattern", [("ad*",)]))
    assert n == 3 and {r.name: r.token for r in index.collect()} == {"net/en/x": "en", "é/p": "", "ad*": ""}


def test_rules_without_tokens_and_without_rules(spark):
    df = spark.createDataFrame([(1, "http://q.io/xad1")], "page_id long, url string")
    assert [r.verdict for r in judged(spark, df, [], ["ad*1"]).collect()] == ["block"]
    assert [r.verdict for r in judged(spark, df, [], []).collect()] == ["allow"]
    assert judged(spark, df.limit(0), HOST_RULES, PATTERNS).count() == 0
