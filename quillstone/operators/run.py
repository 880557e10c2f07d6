"""Running a computed column: estimate, guard, probe the cache, compute each distinct content once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quillstone.functions.text import bind_text, content_hash, token_estimate
from quillstone.operators.cells import cache_probe

#: US dollars for a million input and output tokens, for models without an entry of their own.
PRICE = (1.0, 4.0)
OUTPUT_TOKENS, CONFIRM_ROWS, CONFIRM_USD, BUDGET_USD, MOST_IDS = 60, 100, 0.5, 50.0, 500


class BudgetExceeded(RuntimeError):
    """A run would take total spending past the cap."""


@dataclass(frozen=True)
class Output:
    """What a column's values may be. kind: text, number, boolean, select, url or json."""

    kind: str = "text"
    min: float | None = None
    max: float | None = None
    options: tuple[str, ...] = ()


def bound(rows: DataFrame, id_col: str, template: str) -> DataFrame:
    """(row_id, text, row_content_hash) of each row."""
    types = dict(rows.dtypes)
    return rows.select(F.col(id_col).cast("string").alias("row_id"), bind_text(template, types).alias("text"), content_hash(template, types).alias("row_content_hash"))


def cost_usd(input_tokens: Column, output_tokens: Column, price: tuple[float, float] = PRICE) -> Column:
    return (input_tokens * F.lit(price[0]) + output_tokens * F.lit(price[1])) / 1e6


def estimate(rows: DataFrame, price: tuple[float, float] = PRICE) -> DataFrame:
    """One row: rows, input_tokens, output_tokens, cost_usd, and whether a user must confirm. rows: text."""
    e = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(token_estimate(F.col("text"))), F.lit(0)).alias("input_tokens"))
    e = e.withColumn("output_tokens", F.col("rows") * OUTPUT_TOKENS)
    e = e.withColumn("cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"), price))
    return e.withColumn("confirm", (F.col("rows") > CONFIRM_ROWS) | (F.col("cost_usd") > CONFIRM_USD))


def guard(estimated: DataFrame, ledger: DataFrame, cap: float = BUDGET_USD) -> None:
    """Raise if what the ledger holds and the estimate together exceed the cap."""
    spent = ledger.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
    more = estimated.first()["cost_usd"]
    if spent + more > cap:
        raise BudgetExceeded(f"{spent:.2f} spent and {more:.2f} estimated exceed {cap:.2f} USD")


def gate(estimated: DataFrame, confirmed: bool, ids: int) -> dict | None:
    """What to answer instead of running: the estimate, where a user must confirm it first; else None."""
    if ids > MOST_IDS:
        raise ValueError(f"{ids} rows at once; at most {MOST_IDS}")
    e = estimated.first().asDict()
    return e if e["confirm"] and not confirmed else None


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = 100, keep: Sequence[str] | None = None) -> DataFrame:
    """df with embedding (array of float), asked for in batches of texts; null texts have none, and empty ones
    are asked for. The other columns pass as they are. keep: columns to return, all by default; texts that
    aren't kept don't come back from Python, which a small heap may not bear."""
    at, kept = df.columns.index(text_col), [df.columns.index(c) for c in (df.columns if keep is None else keep)]
    schema = StructType([*[df.schema.fields[i] for i in kept], StructField("embedding", ArrayType(FloatType()))])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            known, texts, out = f.column(at).is_valid(), f.column(at).drop_null(), []
            for k in range(0, len(texts), batch):
                part = texts.slice(k, batch).to_pylist()
                out += [[float(x) for x in v] for _, v in zip(part, model(part), strict=True)]
            vectors = iter(out)
            yield pa.RecordBatch.from_arrays([*[f.column(i) for i in kept], pa.array([next(vectors) if k else None for k in known.to_pylist()], pa.list_(pa.float32()))], schema.names)

    return df.mapInArrow(run, schema)


def dedupe(work: DataFrame) -> DataFrame:
    """work (row_id, row_content_hash, ...) with computes: true for the smallest row id of each content."""
    first = work.groupBy(F.col("row_content_hash").alias("__h")).agg(F.min("row_id").alias("__first"))
    return work.join(first, F.col("row_content_hash") == F.col("__h")).withColumn("computes", F.col("row_id") == F.col("__first")).drop("__h", "__first")


def valid(spec: Output) -> Column:
    """Whether value, JSON text, is of the declared type."""
    v = F.col("value")
    if spec.kind == "boolean":
        return v.isin("true", "false")
    if spec.kind == "number":
        n = v.try_cast("double")
        ok = n.isNotNull() & ~v.startswith('"')
        if spec.min is not None:
            ok = ok & (n >= spec.min)
        if spec.max is not None:
            ok = ok & (n <= spec.max)
        return F.coalesce(ok, F.lit(False))
    if spec.kind == "select":
        return v.isin(*[json.dumps(o, ensure_ascii=False) for o in spec.options])
    if spec.kind == "json":
        return v.startswith("{")
    return v.startswith('"') & v.endswith('"')


Oracle = Callable[[str], dict]


def compute(work: DataFrame, oracle: Oracle, spec: Output, concurrency: int = 8, price: tuple[float, float] = PRICE) -> DataFrame:
    """work (row_id, text, ...) with status, value, rationale, error, tokens, latency_ms.

    oracle(text) returns value (any JSON value), and may return rationale, input_tokens, output_tokens
    and latency_ms. An exception, or a value of another type, makes an error cell. concurrency: tasks, so
    calls in flight. Spark may run a task again, so an oracle should answer the same call the same way.
    """
    names = [c for c, _ in work.dtypes]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for text in pdf.text:
                try:
                    a = oracle(text)
                    rows.append(("done", json.dumps(a["value"], ensure_ascii=False, separators=(",", ":")), (a.get("rationale") or "")[:500] or None, None, int(a.get("input_tokens", 0)), int(a.get("output_tokens", 0)), int(a.get("latency_ms", 0))))
                except Exception as e:  # noqa: BLE001
                    rows.append(("error", None, None, str(e)[:800], 0, 0, 0))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["status", "value", "rationale", "error", "input_tokens", "output_tokens", "latency_ms"])], axis=1)[[*names, "status", "value", "rationale", "error", "input_tokens", "output_tokens", "latency_ms"]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in work.dtypes)
    out = work.repartition(concurrency, "row_id").mapInPandas(run, f"{kinds}, status string, value string, rationale string, error string, input_tokens long, output_tokens long, latency_ms long")
    wrong = (F.col("status") == "done") & ~F.coalesce(valid(spec), F.lit(False))
    return out.withColumns({"error": F.when(wrong, F.concat(F.lit("not of type " + spec.kind + ": "), F.coalesce("value", F.lit("null")))).otherwise(F.col("error")), "status": F.when(wrong, "error").otherwise(F.col("status")), "value": F.when(wrong, None).otherwise(F.col("value")), "cost_usd": cost_usd(F.col("input_tokens"), F.col("output_tokens"), price)})


def run_column(rows: DataFrame, id_col: str, column: dict, cells: DataFrame, oracle: Oracle, spec: Output, concurrency: int = 8) -> DataFrame:
    """The cells that a run writes. column: id, prompt_template, prompt_version, model.

    Rows whose content a cell of this version and model answers already are copied (`cached`), unless
    that cell is their own; of rows with equal content one is computed (`done` or `error`), the others
    are copies of it. Materialise the result before using it twice: it calls the oracle.
    """
    work = bound(rows, id_col, column["prompt_template"]).withColumns({"column_id": F.lit(column["id"]), "prompt_version": F.lit(column["prompt_version"]).cast("int"), "model": F.lit(column["model"])})
    probed = cache_probe(work, cells)
    keys = ["column_id", "row_id", "prompt_version", "model", "row_content_hash"]
    free = [F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens")] + [F.lit(0.0).alias("cost_usd"), F.lit(None).cast("long").alias("latency_ms")]
    hits = probed.where("hit_row_id is not null and hit_row_id <> row_id").select(*keys, F.lit("cached").alias("status"), F.col("hit_value").alias("value"), F.col("hit_rationale").alias("rationale"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("attempts"), *free)
    new = dedupe(probed.where("hit_row_id is null").select(*keys, "text"))
    answers = compute(new.where("computes"), oracle, spec, concurrency).select(F.col("row_content_hash").alias("h"), F.col("status").alias("s"), "value", "rationale", "error", *[F.col(c).alias(f"own_{c}") for c in ("input_tokens", "output_tokens", "cost_usd", "latency_ms")])
    # every new row, the computing ones among them, takes its content's answer: one pass over the oracle
    own = lambda c, zero: F.when(F.col("computes"), F.col(f"own_{c}")).otherwise(zero).alias(c)
    answered = new.join(answers, F.col("row_content_hash") == F.col("h")).select(
        *keys, F.when(~F.col("computes") & (F.col("s") == "done"), "cached").otherwise(F.col("s")).alias("status"), "value", "rationale", "error", F.col("computes").cast("long").alias("attempts"),
        own("input_tokens", F.lit(0)), own("output_tokens", F.lit(0)), own("cost_usd", F.lit(0.0)), own("latency_ms", F.lit(None)),
    )
    return hits.unionByName(answered)


def ledger_entry(written: DataFrame, entry_id: str, column: dict) -> DataFrame:
    """One `run` entry; it counts computed cells alone."""
    return written.agg(F.count_if(F.col("attempts") > 0).alias("cells"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")).select(F.lit(entry_id).alias("id"), F.current_timestamp().alias("at"), F.lit("run").alias("kind"), F.lit(column["id"]).alias("column_id"), F.lit(column["model"]).alias("model"), "cells", "input_tokens", "output_tokens", "cost_usd")
