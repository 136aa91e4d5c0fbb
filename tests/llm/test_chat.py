import random

from pyspark.sql import functions as F

from recollect.llm import chat as C

BITS = ["<|turn|>", "<|end|>", "\\", "\\l", "[INST]", "</s>", "\n", "é\U0001f642", "word ", "<", "|>", "\\e\\"]


def test_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "a<|text|>b", None]), rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(8))])))
    rows += [(100, 0, "user", "tie"), (100, 0, "assistant", "tie"), (100, None, "system", "first"), (None, 1, "user", "x"), (101, 0, "user", "same"), (101, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = C.format_conversations(df)
    out = {r.conv_id: r for r in out.select("conv_id", C.read_back(out.formatted).alias("turns"), C.learned_text(out.formatted, out.loss).alias("learned")).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        want = [(role, text) for _, role, text in sorted(turns)]
        assert [(x.role, x.text) for x in out[c].turns] == want
        assert out[c].learned == "".join(text for role, text in want if role == "assistant")


def test_merges_adjacent_turns_of_a_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).first().formatted == "<|turn|>user<|text|>a<|more|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert C.format_conversations(df.limit(0)).count() == 0


def test_a_very_long_conversation(spark):
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"[{t}]" * (t % 4)) for t in range(6000)] + [(2, 0, "assistant", "x" * 2_000_000)]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)))
    got = {r.conv_id: r for r in out.select("conv_id", C.read_back(out.formatted).alias("turns"), C.learned_text(out.formatted, out.loss).alias("learned")).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [r[2:] for r in rows[:-1]]
    assert got[1].learned == "".join(r[3] for r in rows[:-1] if r[2] == "assistant") and got[2].learned == rows[-1][3]
