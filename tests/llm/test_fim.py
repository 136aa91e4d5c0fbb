import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.llm import fim

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plain(i, text, p=fim.Params()):
    """(n, form, prefix, middle, output) by the rule, with a list of units."""
    text = text or ""
    units = re.findall(UNIT, text)
    h = hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= p.rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < p.spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows(seed=1, n=300):
    rng = random.Random(seed)
    parts = ["a", "wörter", "語" * 7, "\t", "\n\n", " ", "\x0b", " ", "🙂", "<", "<S", "S>", "x" * 60, "\\E"]
    out = [(k, "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(80)))) for k in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "x <P> y"), (None, "a b c"), (None, None), (3, "one two three"), (3, "one two three")]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_against_the_rule(spark, block):
    p = fim.Params(block=block, rate=90)
    given = rows()
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    out = fim.transformed(df, p).withColumn("back", fim.restored(F.col("output"), F.col("form"), p)).collect()
    want = [(i, *plain(i, x, p), x or "") for i, x in given]
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert {r.form for r in out} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_descent(block):
    """Every cut of a text, against its list of units."""
    text = "  ab é\t語語語 \n x" * 9 + " "
    units = re.findall(UNIT, text)
    blocks = fim.Blocks(text.encode(), block)
    assert blocks.n == len(units)
    for u in range(len(units) + 1):
        head = "".join(units[:u])
        assert blocks.cut(u) == (len(head.encode()), len(head))


def test_very_long_text(spark):
    text = "lorem ipsum é " * 150_000
    out = fim.transformed(spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string"), fim.Params(rate=100))
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == text for r in got) and [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in sorted(got)] == [plain(k, text, fim.Params(rate=100)) for k in range(4)]


def test_clashing_names_and_empty_tables(spark):
    df = spark.sql("SELECT 5L doc_id, 'a b c' text, 1 row, 2 id, 3 data, 'x' form, 9 n, 7 `a.b`")
    out = fim.transformed(df)
    assert out.columns == ["doc_id", "row", "id", "data", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    (r,) = out.collect()
    assert (r.doc_id, r.row, r.id, r.data, r["a.b"]) == (5, 1, 2, 3, 7) and (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(5, "a b c")
    assert fim.transformed(df.limit(0)).collect() == []
    assert fim.transformed(spark.sql("SELECT 1L AS n, 'q r' AS text"), id_="n").count() == 1


def test_marks():
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "ab", "suffix": "bc"}, {"prefix": "aba"}, {"middle": "x<P>"}):
        with pytest.raises(ValueError, match="marks"):
            fim.Params(**bad)
