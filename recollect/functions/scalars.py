"""Column functions of the retrieval operators; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Fixed value: what goes before excluded concepts.
EXCLUSION = " The target image should not match the following excluded visual evidence: "


def canonical(text: Column) -> Column:
    """Lower case, white space collapsed and stripped: the key of a concept."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def lexical(text: Column) -> Column:
    """Lower case, all but a-z, 0-9 and hyphens to spaces, collapsed; stripped before, not after."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"[^a-z0-9\s-]", " ")
    return F.regexp_replace(kept, r"\s+", " ")


def density(count: Column) -> Column:
    return F.when(count <= 1, "0-1").when(count <= 3, "2-3").when(count <= 5, "4-5").otherwise("6+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v divided by its length, or by 1e-12 if that is greater."""
    # the length is bound once, by a one-element array, not once a component
    return F.flatten(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(v, lambda x: x / n)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def memory_weight(mode: str, confidence: Column, age: Column, decay: float) -> Column:
    recency = F.lit(1.0) / (F.lit(1.0) + F.lit(decay) * F.greatest(F.lit(0), age))
    return {"uniform": F.lit(1.0), "confidence": confidence, "recency": recency, "full": confidence * recency}[mode]


def item_key(session: Column, turn: Column, idx: Column) -> Column:
    return F.concat_ws(":", session, turn, idx)


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def exclusion_text(base: Column, concepts: Column) -> Column:
    return F.concat(F.trim(base), F.lit(EXCLUSION), F.array_join(concepts, "; "), F.lit("."))


def hit(rank: Column, k: int) -> Column:
    return (rank < k).cast("double")


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def negative_fraction(negative: Column, total: Column) -> Column:
    return F.coalesce(negative / F.nullif(total, F.lit(0)), F.lit(0.0))


def rank_gain(reject: Column, accept: Column) -> Column:
    """How many ranks accepting a belief wins; null if either is unknown."""
    return reject - accept
