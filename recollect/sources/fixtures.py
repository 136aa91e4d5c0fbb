"""The retrieval tables derived from the driver's tables; SQL has the same in DuckDB's words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import read_corpus, written

#: Turns of a session in a Cut folder.
TURNS = 4
_made: dict[tuple[str, str, bool, str], DataFrame] = {}


class Cut(str):
    """A folder of tables of which sessions of TURNS turns are made: conversations that have as many, cut to them. Rank matrices are rectangular."""


def once(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """make's table, written once a session and input, as many queries start from it. forget() drops what was made, as for changed inputs."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, isinstance(sf_dir, Cut), name)
        if key not in _made:
            _made[key] = written(make(spark, sf_dir), name)
        return _made[key]

    return get


def made(name: str, spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table, if it was made in this session."""
    return _made.get((spark.sparkContext.applicationId, sf_dir, isinstance(sf_dir, Cut), name))


def forget() -> None:
    _made.clear()


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/embeddings.parquet")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations (of a Cut folder: of those with TURNS turns or more), and the corpus row that each conversation is after."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    n = corpus(spark, sf_dir).count()
    if isinstance(sf_dir, Cut):
        rows = rows.join(rows.groupBy("conv_id").count().where(F.col("count") >= TURNS).select("conv_id").hint("merge"), "conv_id")
    return rows.select(F.col("conv_id").alias("session_id"), "turn", "text", F.lit(n).alias("n"), ((F.col("conv_id") * 37 + 11) % n).alias("target_index"))


def _before(sf_dir: str, turn: int):
    return F.col("turn") < turn if isinstance(sf_dir, Cut) else F.lit(True)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _talk(spark, sf_dir).where(_before(sf_dir, TURNS)).withColumn("noise", (F.col("session_id") * 13 + F.col("turn") * 5 + 1) % F.col("n"))
    of = lambda id_, name: corpus(spark, sf_dir).select(F.col("corpus_idx").alias(id_), F.col("vector").alias(name)).hint("merge")
    both = talk.join(of("target_index", "a"), "target_index").join(of("noise", "b"), "noise")
    return both.select("session_id", "turn", F.col("text").alias("query_text"), "target_index", F.zip_with("a", "b", lambda x, y: x + F.lit(4.0) * y).alias("query_vector"))


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _talk(spark, sf_dir).where(_before(sf_dir, TURNS - 1)).withColumn("len", F.char_length("text")).where("len % 4 > 0")
    ev = talk.select("session_id", F.col("turn").alias("feedback_turn"), "len", F.explode(F.expr("sequence(0, len % 4 - 1)")).alias("pos"))
    ev = ev.withColumn("cid", (F.col("session_id") * 7 + F.col("pos") * 5 + F.col("len")) % 12)
    ev = ev.withColumn("polarity", F.when(F.expr("(len div 4 + pos + feedback_turn) % 3 = 0"), "positive").otherwise("negative"))
    negative = ev.where("polarity = 'negative'")
    kept = negative.unionByName(ev.where("polarity = 'positive'").join(negative.select("session_id", "feedback_turn", "cid").distinct().hint("merge"), ["session_id", "feedback_turn", "cid"], "left_anti").select(ev.columns))
    idx = F.row_number().over(W.partitionBy("session_id", "feedback_turn", "polarity").orderBy("pos")) - 1
    return kept.select(
        "session_id", "feedback_turn", "polarity", idx.alias("idx"), F.concat(F.when(F.col("feedback_turn") % 2 == 1, "  Concept  ").otherwise("concept "), F.col("cid")).alias("attribute"),
        (F.lit(0.5) + ((F.col("len") + F.col("pos")) % 6) / F.lit(10.0)).alias("confidence"),
    )


states, beliefs = once("states", _states), once("beliefs", _beliefs)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus(spark, sf_dir).count()
    texts = beliefs(spark, sf_dir).select(F.trim("attribute").alias("text")).distinct()
    cid = F.trim(F.regexp_replace(F.lower("text"), "concept", "")).cast("long")
    at = (cid * 41 + 3 + F.when(F.col("text").startswith("C"), 7).otherwise(0)) % n
    return texts.withColumn("corpus_idx", at).join(corpus(spark, sf_dir).hint("merge"), "corpus_idx").select("text", "vector")


vocabulary = once("vocabulary", _vocabulary)


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*map(F.lit, ("EXISTENCE", "ATTRIBUTE", "RELATION", "GLOBAL")))
    s, t, i = (F.col(c) for c in ("session_id", "feedback_turn", "idx"))
    return beliefs(spark, sf_dir).where("polarity = 'negative'").select("session_id", "feedback_turn", "idx", F.col("attribute").alias("negative_attribute"), ((s + t + i) % 4 != 0).alias("actionable"), F.get(types, ((s + 2 * i + t) % 4).cast("int")).alias("sem_type"))


#: Common table expressions with the same rows.
SQL = {
    "corpus": "SELECT vec_id corpus_idx, embedding::DOUBLE[] vector FROM embeddings",
    "fx_sessions": "SELECT conv_id session_id, (conv_id * 37 + 11) % (SELECT count(*) FROM corpus) target_index FROM conversations GROUP BY conv_id",
    "states": """SELECT c.conv_id session_id, c.turn::INT turn, c.text query_text, s.target_index, list_transform(range(1, len(t.vector) + 1), lambda k: t.vector[k] + 4.0::DOUBLE * n.vector[k]) query_vector
  FROM conversations c JOIN fx_sessions s ON s.session_id = c.conv_id JOIN corpus t ON t.corpus_idx = s.target_index
  JOIN corpus n ON n.corpus_idx = (c.conv_id * 13 + c.turn * 5 + 1) % (SELECT count(*) FROM corpus)""",
    "ev0": """SELECT c.conv_id session_id, c.turn::INT feedback_turn, p::INT pos, length(c.text) len, (c.conv_id * 7 + p * 5 + length(c.text)) % 12 cid
  FROM conversations c JOIN fx_sessions s ON s.session_id = c.conv_id, range(4) r(p) WHERE p < length(c.text) % 4""",
    "ev1": """SELECT *, CASE WHEN (len // 4 + pos + feedback_turn) % 3 = 0 THEN 'positive' ELSE 'negative' END polarity, 0.5::DOUBLE + ((len + pos) % 6) / 10.0::DOUBLE confidence,
  CASE WHEN feedback_turn % 2 = 1 THEN '  Concept  ' ELSE 'concept ' END || cid attribute FROM ev0""",
    "beliefs": """SELECT session_id, feedback_turn, polarity, (row_number() OVER (PARTITION BY session_id, feedback_turn, polarity ORDER BY pos) - 1)::INT idx, attribute, confidence
  FROM ev1 e WHERE polarity = 'negative' OR NOT EXISTS (SELECT 1 FROM ev1 x WHERE x.session_id = e.session_id AND x.feedback_turn = e.feedback_turn AND x.cid = e.cid AND x.polarity = 'negative')""",
    "vocab": """SELECT a.text, v.vector FROM (SELECT DISTINCT trim(attribute) AS text FROM beliefs) a JOIN corpus v
  ON v.corpus_idx = (trim(regexp_replace(lower(a.text), 'concept', ''))::BIGINT * 41 + 3 + CASE WHEN a.text LIKE 'C%' THEN 7 ELSE 0 END) % (SELECT count(*) FROM corpus)""",
    "structured": """SELECT session_id, feedback_turn, idx, attribute negative_attribute, (session_id + feedback_turn + idx) % 4 <> 0 actionable,
  (['EXISTENCE', 'ATTRIBUTE', 'RELATION', 'GLOBAL'])[1 + (session_id + 2 * idx + feedback_turn) % 4] sem_type FROM beliefs WHERE polarity = 'negative'""",
}

#: Those of them that a Cut folder changes.
CUT_SQL = {
    "fx_sessions": SQL["fx_sessions"] + " HAVING count(*) >= 4",
    "states": SQL["states"] + " WHERE c.turn < 4",
    "ev0": SQL["ev0"].replace("WHERE p <", "WHERE c.turn < 3 AND p <"),
}
