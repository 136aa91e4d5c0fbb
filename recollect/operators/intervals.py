"""Points that meet intervals, by dyadic cells.

A range of whole numbers is cut into at most two cells of each size 2**k, and a point lies in one cell of each size; so a point and an
interval that holds it share exactly one cell, and an equi-join on (key, size, cell) finds them: no range condition is left over,
no key gathers more than what its cells hold, and rows are in proportion to points and intervals times the number of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells_of_range(lo: Column, hi: Column, levels: int) -> Column:
    """The cells (level, cell) that make up lo..hi, both included, for 0 <= lo <= hi < 2**levels."""

    def of(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        first, past = F.ceil(lo / size), F.floor((hi + 1) / size)
        cell = lambda n: F.struct(k.alias("level"), n.cast("long").alias("cell"))
        return F.array_compact(F.array(F.when((first < past) & (first % 2 == 1), cell(first)), F.when((first < past) & (past % 2 == 1), cell(past - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def cells_of_point(at: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(at / F.pow(F.lit(2.0), k)).cast("long").alias("cell")))


def stabbed(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Each point with each span of its key that holds it. A span whose hi is null has no end. Other columns must differ.

    Spans without a point of the table's range, and those that end before they begin, meet nothing.
    """
    least, most = points.agg(F.min(at), F.max(at)).first()
    least, most = (0, 0) if least is None else (least, most)
    levels = max(1, int(most - least).bit_length())
    first, last = F.greatest(F.col(lo), F.lit(least)), F.least(F.coalesce(hi, F.lit(most)), F.lit(most))
    own = spans.where(F.col(lo) <= most).where((first <= last)).withColumn("_cell", F.explode(cells_of_range((first - least).cast("long"), (last - least).cast("long"), levels)))
    asked = points.withColumn("_cell", F.explode(cells_of_point((F.col(at) - least).cast("long"), levels)))
    apart = lambda df: df.select("*", F.col("_cell.level").alias("_level"), F.col("_cell.cell").alias("_place")).drop("_cell")
    return apart(asked).join(apart(own).hint("merge"), [key, "_level", "_place"]).drop("_level", "_place")
