"""A store of computed cells by column, row and prompt version, as DataFrames.

Versions stand beside one another. Each operation takes tables and returns new ones; Store keeps them in
versioned folders, of which a pointer file names the current one, so a table is never overwritten while
it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tables import running

CELLS = """column_id string, row_id string, prompt_version int, model string, row_content_hash string, status string,
value string, rationale string, error string, attempts long, input_tokens long, output_tokens long, cost_usd double,
latency_ms long, certificate_id string, updated_at timestamp"""
COLUMNS = "id string, table_id string, name string, prompt_template string, prompt_version int, model string, output_spec string, created_at timestamp"
VERSIONS = "column_id string, version int, prompt_template string, model string, created_at timestamp"
LEDGER = "id string, at timestamp, kind string, column_id string, model string, cells long, input_tokens long, output_tokens long, cost_usd double"
CERTIFICATES = """id string, column_id string, from_version int, to_version int, alpha double, delta string, strata string,
reused_count long, recompute_count long, sampled_count long, verification_cost_usd double, created_at timestamp"""
KEY = ["column_id", "row_id", "prompt_version"]
#: Statuses of cells that a model has answered; only these are a cache or a label.
ANSWERED = ("done", "cached")


def create_column(columns: DataFrame, versions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New columns (as in COLUMNS) at version 1, with a first entry in their history."""
    first = new.withColumn("prompt_version", F.lit(1))
    return columns.unionByName(first), versions.unionByName(_history(first))


def _history(columns: DataFrame) -> DataFrame:
    return columns.select(F.col("id").alias("column_id"), F.col("prompt_version").alias("version"), "prompt_template", "model", "created_at")


def edit_column(columns: DataFrame, versions: DataFrame, column_id: str, template: str, model: str | None = None, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The column at its next version; its history grows by one entry. A served model that changes is
    an edit as well, so cells of two models never share a version."""
    this = F.col("id") == column_id
    edited = columns.withColumns({
        "prompt_template": F.when(this, template).otherwise(F.col("prompt_template")),
        "model": F.when(this & F.lit(model is not None), F.lit(model)).otherwise(F.col("model")),
        "prompt_version": F.when(this, F.col("prompt_version") + 1).otherwise(F.col("prompt_version")),
    })
    stamp = F.current_timestamp() if at is None else at
    return edited, versions.unionByName(_history(edited.where(this)).withColumn("created_at", stamp))


def list_columns(columns: DataFrame, table_id: str) -> DataFrame:
    return columns.where(F.col("table_id") == table_id).orderBy("created_at", "id")


def cells_of_version(cells: DataFrame, column_id: str, version: int, ids: DataFrame | None = None) -> DataFrame:
    """Cells of one version, of these row ids only if given; an empty table of ids gives none."""
    out = cells.where((F.col("column_id") == column_id) & (F.col("prompt_version") == version))
    return out if ids is None else out.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def current_cells(cells: DataFrame, columns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Cells at each column's current version."""
    now = columns.select(F.col("id").alias("column_id"), "prompt_version")
    out = cells.join(now, ["column_id", "prompt_version"])
    return out if ids is None else out.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def cache_probe(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """wanted (column_id, prompt_version, model, row_content_hash, ...) with hit_row_id and hit_value of an
    answered cell of the same four, that of the smallest row id; null where there is none."""
    key = ["column_id", "prompt_version", "model", "row_content_hash"]
    hits = cells.where(F.col("status").isin(*ANSWERED)).groupBy(*key).agg(F.min(F.struct("row_id", "value", "rationale")).alias("hit"))
    out = wanted.join(hits, key, "left")
    return out.select(*wanted.columns, F.col("hit.row_id").alias("hit_row_id"), F.col("hit.value").alias("hit_value"), F.col("hit.rationale").alias("hit_rationale"))


def upsert(cells: DataFrame, new: DataFrame) -> DataFrame:
    """cells with new ones merged by key: the latest write's values; attempts, tokens and cost add up.

    Of writes at the same time those of new win. A fresh value has no certificate any more.
    """
    both = cells.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = F.struct("__new", "updated_at", "model", "row_content_hash", "status", "value", "rationale", "error", "latency_ms", "certificate_id")
    out = both.groupBy(*KEY).agg(F.max(latest).alias("w"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("attempts", "input_tokens", "output_tokens", "cost_usd")])
    fresh = (F.col("w.__new") == 1) & (F.col("w.status") != "reused_certified")
    return out.select(*KEY, *[F.col(f"w.{c}").alias(c) for c in ("model", "row_content_hash", "status", "value", "rationale", "error", "latency_ms", "updated_at")], "attempts", "input_tokens", "output_tokens", "cost_usd", F.when(fresh, None).otherwise(F.col("w.certificate_id")).alias("certificate_id")).select(*cells.columns)


def missing_rows(rows: DataFrame, cells: DataFrame, column_id: str, version: int) -> DataFrame:
    """Rows (row_id, ...) that have no cell of this version yet."""
    there = cells.where((F.col("column_id") == column_id) & (F.col("prompt_version") == version)).select("row_id")
    return rows.join(there, "row_id", "left_anti")


def apply_certificate(cells: DataFrame, column_id: str, source: int, target: int, reuse: DataFrame, certificate_id: str) -> DataFrame:
    """The cells to append: answered cells of the source version, of the rows to reuse, at the target
    version, where that has no cell. The model plays no part."""
    old = cells.where((F.col("column_id") == column_id) & (F.col("prompt_version") == source) & F.col("status").isin(*ANSWERED))
    copies = old.join(reuse.select("row_id").distinct(), "row_id", "left_semi").withColumn("prompt_version", F.lit(target).cast("int"))
    new = copies.join(cells.where(F.col("prompt_version") == target), KEY, "left_anti")
    zero = {c: F.lit(0).cast("long") for c in ("attempts", "input_tokens", "output_tokens")}
    return new.withColumns(zero | {"cost_usd": F.lit(0.0), "status": F.lit("reused_certified"), "certificate_id": F.lit(certificate_id)}).select(*cells.columns)


def move_cells(cells: DataFrame, column_id: str, source: int, target: int, model: str) -> DataFrame:
    """cells with those of a model filed under the version that was issued for it, without a certificate;
    cells that the target version has already stay, and the misfiled ones with them."""
    this = (F.col("column_id") == column_id) & (F.col("prompt_version") == source) & (F.col("model") == model)
    there = cells.where((F.col("column_id") == column_id) & (F.col("prompt_version") == target)).select(F.col("row_id").alias("__r"), F.lit(True).alias("__there")).distinct()
    out = cells.join(there, F.col("row_id") == F.col("__r"), "left").withColumn("__move", this & F.col("__there").isNull())
    return out.withColumns({"prompt_version": F.when(F.col("__move"), F.lit(target).cast("int")).otherwise(F.col("prompt_version")), "certificate_id": F.when(~F.col("__move"), F.col("certificate_id"))}).select(*cells.columns)


def ledger_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total"))


def version_state(cells: DataFrame) -> DataFrame:
    """How many cells of each version stand in which state."""
    return cells.groupBy("column_id", "prompt_version").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "cached").alias("cached"),
        F.count_if(F.col("status") == "reused_certified").alias("reused"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def run_windows(ledger: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells written between one run of a column and the run before it: first, last, how many, how many done.

    Each row's number is how many runs of its column come before it, counted over range partitions: a
    cell belongs to the run of the same number, and a column of any size needn't fit a task. Of runs at
    the same time the first by id has the cells.
    """
    runs = ledger.where("kind = 'run' and at is not null").select("column_id", F.col("at").alias("time"), F.lit(1).alias("is_run"), F.col("id").alias("run_id"), F.lit(None).cast("string").alias("status"))
    written = cells.where("updated_at is not null").select("column_id", F.col("updated_at").cast(runs.schema["time"].dataType).alias("time"), F.lit(0).alias("is_run"), F.col("row_id").alias("run_id"), "status")
    numbered = running(runs.unionByName(written), ["column_id"], [F.col("time"), F.col("is_run"), F.col("run_id"), F.col("status")], F.col("is_run"), "k")
    between = numbered.where("is_run = 0").groupBy(F.col("column_id").alias("c"), F.col("k").alias("j")).agg(F.min("time").alias("first_at"), F.max("time").alias("last_at"), F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"))
    out = numbered.where("is_run = 1").join(between, (F.col("column_id") == F.col("c")) & (F.col("k") == F.col("j")), "left")
    return out.select("run_id", "first_at", "last_at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("done", F.lit(0)).alias("done"))


class Store:
    """Tables in a folder: each write makes a new version and moves the pointer to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.path}/{name}/current"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.path}/{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(at)
        self.spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").json(self._pointer(name))
        return self.spark.read.schema(df.schema).parquet(at)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to the current version."""
        if not self.exists(name):
            return self.write(name, df)
        at = self._at(name)
        df.write.mode("append").parquet(at)
        return self.spark.read.parquet(at)

    def _at(self, name: str) -> str:
        return self.spark.read.schema("at string").json(self._pointer(name)).first()[0]

    def exists(self, name: str) -> bool:
        jvm, p = self.spark._jvm, self._pointer(name)
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))
