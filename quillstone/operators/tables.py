"""Tables in the folder that driver and executors share, and running sums that no key's size limits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here if unset.

    Only a local session may go without the setting; on a cluster a missing one is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    at = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quillstone_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The value of the row before, within keys in ascending order, as column name; null for the first.

    As in running(), no key's rows meet in one task: rows are range-partitioned, and the first row of a
    key in a partition takes the value from the end of the partition before it that has the key.
    """
    cols = df.columns
    parts = df.withColumn("__v", value).repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order)
    parts = materialize(parts.withColumn("__p", F.spark_partition_id()), "before")
    by = Window.partitionBy("__p", *keys).orderBy(*order)
    here = parts.withColumn("__lag", F.lag("__v").over(by)).withColumn("__first", F.row_number().over(by) == 1)
    ends = parts.groupBy("__p", *keys).agg(F.max(F.struct(*order, "__v")).alias("__end"))
    earlier = F.lag("__end.__v").over(Window.partitionBy(*keys).orderBy("__p"))
    last = ends.select(F.col("__p").alias("__op"), *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], earlier.alias("__last"))
    same = F.col("__p") == F.col("__op")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return here.join(last, same, "left").select(*cols, F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__lag")).alias(name))


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Exclusive running sum of value within keys in the given order, as column name.

    No key's rows meet in one task: rows are range-partitioned by (keys, order), summed within each
    partition, and shifted by what the same key has in earlier partitions. The per-partition sums are
    one row for each (partition, key) that occurs: partitions plus keys at most. The partitioned rows
    are written once, since range bounds may differ from one evaluation to the next.
    """
    cols = df.columns
    parts = (
        df.withColumn("__v", value.cast("long"))
        .repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order)
        .withColumn("__p", F.spark_partition_id())
    )
    parts = materialize(parts, "running")
    by = Window.partitionBy("__p", *keys)
    here = F.sum("__v").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__v")
    sums = parts.groupBy("__p", *keys).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(
        F.col("__p").alias("__op"), *[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"),
    )
    same = F.col("__p") == F.col("__op")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return parts.withColumn("__h", here).join(offs, same, "left").select(*cols, (F.col("__h") + F.col("__off")).alias(name))
