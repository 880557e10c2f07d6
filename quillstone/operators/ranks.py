"""Values at places of a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.tables import running


def nearest_ranks(rows: DataFrame, value: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """One row: for each (name, share) the value at place floor(share * n), from 0, of the order. Values are
    counted over range partitions; no task sorts all rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("m"))
    n = F.broadcast(counts.agg(F.sum("m").alias("n")))
    last = running(counts, [], [F.col(value).asc()], F.col("m"), "before").crossJoin(n)
    return last.agg(*[F.min(F.when(F.col("before") + F.col("m") > F.floor(F.lit(f) * F.col("n")), F.col(value))).alias(name) for name, f in shares])
