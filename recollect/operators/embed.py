"""Encoders of texts: a protocol for batches, and a precomputed vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

Encoder = Callable[[list[str]], list[list[float]]]


def embed(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """(text, vector) of the distinct texts; the encoder gets a batch at a time in a Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "vector": encoder(b["text"].tolist())})

    return texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct().mapInPandas(run, "text string, vector array<double>")


def lookup(texts: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """texts with unit vectors from a vocabulary; raises if a text is not in it."""
    missing = texts.select(F.trim(text).alias("text")).distinct().join(vocabulary, "text", "left_anti")
    if (lost := missing.limit(5).collect()) != []:
        raise KeyError(f"no vector for {[r.text for r in lost]}")
    v = vocabulary.select(F.col("text").alias("_text"), S.unit(F.col("vector")).alias("vector"))
    return texts.join(v, F.trim(text) == F.col("_text")).drop("_text")
