"""Stratifiers: functions that give each cached cell a stratum."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import STOP_WORDS, overlap_bucket, overlap_score
from quillstone.operators.ranks import nearest_ranks

Stratifier = Callable[[DataFrame], DataFrame]


def key(value: Column, bucket: Column) -> Column:
    return F.concat(F.lit("v="), F.coalesce(value, F.lit("null")), F.lit("|"), bucket)


def value_only(cells: DataFrame) -> DataFrame:
    """By cached value alone."""
    return cells.withColumn("stratum", key(F.col("value"), F.lit("all")))


def lexical(terms: Sequence[str], stop: Sequence[str] = STOP_WORDS) -> Stratifier:
    """By cached value and how many of the changed terms the row's text holds."""
    return lambda cells: cells.withColumn("stratum", key(F.col("value"), F.concat(F.lit("o="), overlap_bucket(overlap_score(F.col("text"), terms, stop)))))


def tertiles(score: str, id_col: str = "row_id") -> Stratifier:
    """By cached value and tertile of a score; a cut point belongs to the lower tertile.

    The cut points are the scores at places n/3 and 2n/3 of the whole order, counted over range partitions.
    """

    def run(cells: DataFrame) -> DataFrame:
        # a third is written so that n times it never falls short of the whole number it should be
        cuts = nearest_ranks(cells, score, [("a", 1 / 3 + 1e-15), ("b", 2 / 3 + 1e-15)]).first()
        bucket = F.when(F.col(score) <= F.lit(cuts.a), "low").when(F.col(score) <= F.lit(cuts.b), "mid").otherwise("high")
        return cells.withColumn("stratum", key(F.col("value"), bucket))

    return run


def category(name: str) -> Stratifier:
    """By a category that the cells carry."""
    return lambda cells: cells.withColumn("stratum", key(F.col(name), F.lit("all")))


def single(cells: DataFrame) -> DataFrame:
    return cells.withColumn("stratum", F.lit("all"))


def sizes(cells: DataFrame) -> DataFrame:
    """(stratum, size), largest first."""
    return cells.groupBy("stratum").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "stratum")
