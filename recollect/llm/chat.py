"""Chat formatting, with DataFrame functions only.

The turns of a conversation are collected and sorted, adjacent turns of one role are merged by an array aggregation, and the
messages are concatenated:

    <|turn|>ROLE<|text|>TEXT<|more|>TEXT<|end|>

with <|more|> between merged turns, so that the turns can be read back. Every control string begins with `<` or `[`; in
roles and texts a backslash becomes `\\e`, `<` becomes `\\l` and `[` becomes `\\b`, which undoes without doubt. The loss mask is a
list of (start, end) code points of the formatted text: each assistant text, without marks.

Null texts and roles count as empty; turns sort by (turn, role, text), nulls first; rows that stand twice are two turns. A null
conversation id is a conversation of its own. A conversation must fit into a row, as its output does; the work on it grows with
its length, not with the square of it. Columns other than conv_id, turn, role and text are not looked at, whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, running

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def merged(turns: Column) -> Column:
    """Sorted (turn, role, text) structs to messages (role, texts), adjacent turns of one role in one message."""

    def from_starts(ts: Column, starts: Column) -> Column:
        until = lambda k: F.coalesce(F.get(starts, k + 1), F.size(ts))
        return F.transform(starts, lambda a, k: F.struct(F.get(ts, a)["role"].alias("role"), F.transform(F.slice(ts, a + 1, until(k) - a), lambda x: x["text"]).alias("texts")))

    def of(ts: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, F.greatest(i - 1, F.lit(0)))["role"]))
        return bound(new, lambda starts: from_starts(ts, starts))

    return bound(turns, of)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss): the text and its loss mask."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", one.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    messages = turns.select("conv_id", merged(F.col("turns")).alias("messages"))

    def parts(m: Column) -> Column:
        learned = m["role"] == LEARNED_ROLE
        texts = F.transform(m["texts"], lambda x, i: F.array(F.struct(F.when(i > 0, MORE).otherwise("").alias("s"), F.lit(False).alias("learned")), F.struct(escape(x).alias("s"), learned.alias("learned"))))
        head = F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)).alias("s"), F.lit(False).alias("learned"))
        return F.concat(F.array(head), F.flatten(texts), F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("learned"))))

    out = messages.select("conv_id", F.flatten(F.transform("messages", parts)).alias("parts"))

    def spans(parts_: Column) -> Column:
        at = running(F.transform(parts_, lambda x: F.char_length(x["s"])), F.lit(0), lambda a, x: a + x)
        every = F.zip_with(parts_, at, lambda x, begin: F.when(x["learned"], F.struct(begin.alias("start"), (begin + F.char_length(x["s"])).alias("end"))))
        return F.filter(every, lambda span: span.isNotNull())

    return out.select("conv_id", F.array_join(F.transform("parts", lambda x: x["s"]), "").alias("formatted"), spans(F.col("parts")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    bodies = F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1))

    def turns(body: Column) -> Column:
        sides = F.split(F.substring_index(body, END, 1), r"<\|text\|>", -1)
        return F.transform(F.split(sides[1], r"<\|more\|>", -1), lambda x: F.struct(unescape(sides[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(bodies, turns))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
