"""Reading corpora and writing tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.filters import Catalog


def read_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A CSV file with a header, all strings, under a declared schema; quoted line breaks are part of values."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_labels(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """Released labels: a JSON list of pairs with aligned arrays, as one row for each element."""
    raw = spark.read.option("multiLine", True).json(path)
    others = [c for c in raw.columns if c not in arrays]
    return raw.select(*others, F.posexplode(F.arrays_zip(*arrays)).alias("position", "e")).select(*others, "position", "e.*")


def curate(raw: DataFrame, fields: Catalog, expressions: Mapping[str, Column]) -> DataFrame:
    """The declared fields, each computed from the raw columns; NaN becomes null, a null array empty."""
    cols = []
    for f in fields.values():
        c = expressions.get(f.name, F.col(f"`{f.name}`")).cast(f.spark_type)
        if f.multi:
            c = F.coalesce(c, F.array().cast(f.spark_type))
        elif f.type == "float":
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        cols.append(c.alias(f.name, metadata={"description": f.description, "multi": f.multi}))
    return raw.select(*cols)


def write_table(df: DataFrame, path: str) -> int:
    """Replace a table, and check that it holds as many rows as were read. Not for a path df reads."""
    n = df.count()
    df.write.mode("overwrite").parquet(path)
    there = df.sparkSession.read.parquet(path).count()
    if there != n:
        raise RuntimeError(f"{path} holds {there} of {n} rows")
    return n


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.write.mode("append").parquet(path)
