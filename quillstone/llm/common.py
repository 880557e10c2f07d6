"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tables import discard, materialize, running, shared_dir, shared_path

__all__ = ["discard", "materialize", "normal_space", "running", "shared_dir", "shared_path", "table", "without", "word_count"]

#: The white space every contract means by ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: results replace clashing inputs."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def normal_space(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def word_count(text: Column) -> Column:
    """Number of ``[^\x20\x09-\x0D]+`` in text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
