"""Readers of JSON artifacts that lose and default nothing.

Records are parsed once into variants and walked level by level (artifact, dialogue, turn, belief); each node is probed for the types
that it must have. A node that fails ends its branch: it becomes a fault, with its reasons, its place in the record and its raw text;
what lies beside it is read on. Rows and faults come from one written table, so a file is parsed once. `or_raise` gives the rows if
there are no faults, and raises with the first of them if there are: what a caller gets who doesn't ask for faults.

Reasons name what a field is not. A missing number or text is a fault where the field is required; only optional fields have defaults.
Blank lines are no records. Numbers written as texts, whole numbers written as fractions, and true or false in place of numbers are faults.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MemoryConfig, RetrievalConfig


@dataclass(frozen=True)
class Checked:
    """What a file holds: rows, and faults (file, record, place, reason, raw, and what is known of the row)."""

    rows: DataFrame
    faults: DataFrame
    what: str

    def or_raise(self) -> DataFrame:
        found = self.faults.orderBy("record", "place", "reason").limit(5).collect()
        if found:
            raise ValueError(f"malformed {self.what}: " + "; ".join(f"{r.reason} at {r.place or 'the top'} of record {r.record} in {r.file}" for r in found))
        return self.rows


def records(spark: SparkSession, path: str, one_a_file: bool) -> DataFrame:
    """(file, record, place, reasons, raw, node): a row for each record; record is the beginning of its SHA-256."""
    text = spark.read.text(path, wholetext=one_a_file).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw")).where(F.trim(F.regexp_replace("raw", r"\s+", " ")) != "")
    node = F.try_parse_json("raw")
    reason = F.when(node.isNull(), "not_json").when(~is_object(node), "not_an_object")
    return text.select("file", F.substring(F.sha2("raw", 256), 1, 16).alias("record"), F.lit("").alias("place"), F.array_compact(F.array(reason)).alias("reasons"), "raw", node.alias("node"))


def is_object(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, F.lit("$"), "map<string,variant>").isNotNull(), F.lit(False))


def child(node: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, F.lit(f"$.{field}"), kind)


def kind_of(node: Column, field: str) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID and so on; null where there is none."""
    return F.schema_of_variant(child(node, field))


LIST, OBJECT, TEXT, WHOLE, NUMBER, FLAG = "a_list", "an_object", "a_text", "a_whole_number", "a_number", "a_flag"


def fails(field: str, kind: str, optional: bool = False) -> Column:
    """The reason why a field of the node isn't of a kind, or null."""
    node, found = F.col("node"), kind_of(F.col("node"), field)
    right = {
        LIST: child(node, field, "array<variant>").isNotNull(), OBJECT: child(node, field, "map<string,variant>").isNotNull(), TEXT: found == "STRING", WHOLE: found == "BIGINT",
        NUMBER: found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL"), FLAG: found == "BOOLEAN",
    }[kind]
    right = F.coalesce(right, F.lit(False))
    if optional:
        right = right | found.isNull()
    return F.when(~right, f"{field}_not_{kind}")


def judged(df: DataFrame, *reasons: Column) -> DataFrame:
    """df, where nodes that have no reason yet get those that hold; they keep their own text then."""
    fresh = F.size("reasons") == 0
    own = F.array_compact(F.array(*reasons))
    out = df.withColumn("_own", F.when(fresh, own).otherwise(F.array().cast("array<string>")))
    raw = F.when((F.size("_own") > 0) & (F.col("place") != ""), F.to_json("node")).otherwise(F.col("raw"))
    return out.withColumns({"raw": raw, "reasons": F.concat("reasons", "_own")}).drop("_own")


def descended(df: DataFrame, items: Column, at: str, place: str) -> DataFrame:
    """A row for each of the items, under its number `at`; faults stay as they are, and a node without items goes."""
    there = F.when(F.size("reasons") == 0, items)
    out = df.select(*(c for c in df.columns if c != "node"), F.posexplode_outer(there).alias(at, "node")).where(F.col(at).isNotNull() | (F.size("reasons") > 0))
    return out.withColumn("place", F.when(F.col(at).isNotNull(), F.concat("place", F.lit(f"{place}["), F.col(at), F.lit("]"))).otherwise(F.col("place")))


def not_an_object() -> Column:
    return F.when(~is_object(F.col("node")), "not_an_object")


def parted(parsed: DataFrame, what: str, keys: list[str]) -> Checked:
    """Rows without and with reasons, of one written table."""
    from .tables import written

    kept = written(parsed.drop("node"), what)
    faults = kept.where("size(reasons) > 0").select("file", "record", "place", F.explode("reasons").alias("reason"), "raw", *keys)
    return Checked(kept.where("size(reasons) = 0").drop("file", "record", "place", "raw", "reasons"), faults, what)


def beliefs(spark: SparkSession, path: str, one_a_file: bool = False) -> Checked:
    """Belief artifacts: rows are (position, turn_position, session_id, feedback_turn, polarity, idx, attribute, confidence, fact_type)."""
    node = F.col("node")
    top = judged(records(spark, path, one_a_file), fails("dialogs", LIST))
    dialogs = judged(descended(top, child(node, "dialogs", "array<variant>"), "position", "dialogs"), not_an_object())
    dialogs = judged(dialogs, fails("dialog_id", WHOLE), fails("turns", LIST)).withColumn("session_id", child(node, "dialog_id", "bigint"))
    turns = judged(descended(dialogs, child(node, "turns", "array<variant>"), "turn_position", ".turns"), not_an_object())
    turns = judged(turns, fails("turn", WHOLE), fails("positives", LIST), fails("negatives", LIST), fails("question", TEXT), fails("answer", TEXT)).withColumn("feedback_turn", child(node, "turn", "int"))
    tagged = lambda field, polarity: F.transform(child(node, field, "array<variant>"), lambda x, i: F.struct(F.lit(polarity).alias("polarity"), i.alias("idx"), x.alias("node")))
    told = turns.select("*", F.explode_outer(F.when(F.size("reasons") == 0, F.concat(tagged("positives", "positive"), tagged("negatives", "negative")))).alias("b")).where("b IS NOT NULL OR size(reasons) > 0")
    told = told.drop("node").select("*", "b.*").drop("b").withColumn("place", F.when(F.col("idx").isNotNull(), F.concat("place", F.lit("."), "polarity", F.lit("s["), "idx", F.lit("]"))).otherwise(F.col("place")))
    told = judged(judged(told, not_an_object()), fails("attribute", TEXT), fails("confidence", NUMBER), fails("fact_type", TEXT, optional=True))
    attribute, confidence, kind = F.trim(child(node, "attribute", "string")), child(node, "confidence", "double"), child(node, "fact_type", "string")
    told = judged(told, F.when(attribute == "", "attribute_empty"), F.when(~confidence.between(0, 1) | F.isnan(confidence), "confidence_out_of_range"), F.when(F.trim(kind) == "", "fact_type_empty"))
    parsed = told.withColumns({"attribute": attribute, "confidence": confidence, "fact_type": F.coalesce(kind, F.lit("unknown"))})
    return parted(parsed, "beliefs", ["session_id", "feedback_turn", "polarity", "idx"])


def repeated(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """parsed, where rows of a key that stands twice get a reason, each of them."""
    from .tables import written

    parsed = written(parsed.drop("node"), "records")
    twice = parsed.where("size(reasons) = 0").groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    both = parsed.join(twice.hint("merge"), keys, "left")
    return both.withColumn("reasons", F.when(F.col("_n").isNotNull(), F.array(F.lit("stands_twice"))).otherwise(F.col("reasons"))).drop("_n")


def structured(spark: SparkSession, path: str, one_a_file: bool = False) -> Checked:
    """Items of structured negatives: (session_id, feedback_turn, idx, negative_attribute, actionable, sem_type, sem_status, eligibility_source)."""
    node = F.col("node")
    top = judged(records(spark, path, one_a_file), fails("items", LIST))
    items = judged(descended(top, child(node, "items", "array<variant>"), "position", "items"), not_an_object())
    items = judged(
        items, fails("dialog_id", WHOLE), fails("turn", WHOLE), fails("negative_index", WHOLE, optional=True), fails("negative_attribute", TEXT), fails("actionable_negative", FLAG), fails("typing", OBJECT, optional=True),
        fails("typing.type", TEXT, optional=True), fails("typing.status", TEXT, optional=True), fails("eligibility_source", TEXT, optional=True),
    )
    parsed = items.withColumns({
        "session_id": child(node, "dialog_id", "bigint"), "feedback_turn": child(node, "turn", "int"), "idx": F.coalesce(child(node, "negative_index", "int"), F.when(F.size("reasons") == 0, 0)), "negative_attribute": child(node, "negative_attribute", "string"),
        "actionable": child(node, "actionable_negative", "boolean"), "sem_type": F.upper(F.trim(child(node, "typing.type", "string"))), "sem_status": child(node, "typing.status", "string"), "eligibility_source": child(node, "eligibility_source", "string"),
    }).drop("position")
    keys = ["session_id", "feedback_turn", "idx"]
    return parted(repeated(parsed, keys), "structured", keys)


def configs(spark: SparkSession, path: str, one_a_file: bool = False) -> Checked:
    """Configurations: (config_id, the memory's settings, top_k); what one leaves out has its default, what no setting is called is a fault."""
    node = F.col("node")
    settings = {f.name: f for f in fields(MemoryConfig)}
    kinds = {n: FLAG if f.type == "bool" else WHOLE if f.type == "int" else NUMBER for n, f in settings.items()}
    unknown = F.filter(F.map_keys(child(node, "memory", "map<string,variant>")), lambda k: ~k.isin(*settings, "positive_weight"))  # that one is known, without effect
    top = judged(records(spark, path, one_a_file), fails("config_id", WHOLE), fails("memory", OBJECT, optional=True), fails("top_k", WHOLE, optional=True))
    top = judged(top, *(fails(f"memory.{n}", k, optional=True) for n, k in kinds.items()), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown_setting_"), F.array_join(F.array_sort(unknown), "_"))))
    value = lambda n: F.coalesce(child(node, f"memory.{n}", "boolean" if kinds[n] == FLAG else "double"), F.lit(settings[n].default if kinds[n] == FLAG else float(settings[n].default)))
    parsed = top.withColumns({"config_id": child(node, "config_id", "bigint")} | {n: value(n) for n in settings} | {"top_k": F.coalesce(child(node, "top_k", "bigint"), F.lit(RetrievalConfig.top_k).cast("long"))})
    return parted(parsed, "configs", ["config_id"])


def traces(spark: SparkSession, path: str) -> Checked:
    """Turn traces, one a line: (session_id, turn, final_rank, top_k, mem_negative)."""
    node = F.col("node")
    top = judged(records(spark, path, False), fails("session_id", WHOLE), fails("turn", WHOLE), fails("final_rank", WHOLE), fails("top_k", LIST), fails("mem_negative", WHOLE, optional=True))
    odd = F.exists(child(node, "top_k", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x) != "BIGINT", F.lit(True)))
    top = judged(top, F.when(odd, "top_k_holds_no_whole_number"))
    parsed = top.withColumns({"session_id": child(node, "session_id", "bigint"), "turn": child(node, "turn", "int"), "final_rank": child(node, "final_rank", "bigint"), "top_k": child(node, "top_k", "array<bigint>"), "mem_negative": child(node, "mem_negative", "int")})
    return parted(repeated(parsed, ["session_id", "turn"]), "traces", ["session_id", "turn"])
