"""Digests of files, as Spark reads them from any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import provenance

#: A file is one row while it is hashed; a row holds 2 GB at most.
MOST = (1 << 31) - (1 << 20)


def digests(spark: SparkSession, *paths: str, pattern: str = "*", most: int = MOST) -> DataFrame:
    """(path, length, sha256) of all files below the paths whose name fits; larger ones than `most` bytes raise; hidden and empty ones are left out, as Spark reads neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(paths))
    if large := files.where(F.col("length") > most).select("path").limit(3).collect():
        raise ValueError(f"files beyond {most} bytes: {[r.path for r in large]}")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree(files: DataFrame, root: str) -> DataFrame:
    """(rows, digest): one digest of all files below root, by their places in it, lengths and contents, whatever their order."""
    place = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    inside = files.withColumn("place", F.substring_index(place, root.rstrip("/").rsplit("/", 1)[-1] + "/", -1))
    return provenance.content(inside, "place", "length", "sha256")
