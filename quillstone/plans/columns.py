"""Queries of ingestion, templates and computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import rng, text
from quillstone.operators import cells as store
from quillstone.operators import run
from quillstone.plans.registry import query, table

# raw strings: what surveys hold, many times over

RAW = ("", "NA", "N/A", "null", "  ", " 7 ", "3.5", "Less than 1 year", "more than 50 years", "1e400", "NaN", "abc", "a;b; c ;;d", " x ", "-2", "12;")
_RAW_SQL = "WITH raw AS (SELECT e.event_id, r.v FROM events e LEFT JOIN (SELECT unnest([" + ", ".join(f"'{v}'" for v in RAW) + "]) AS v, unnest(range(0, 16)) AS i) r ON e.event_id % 17 = r.i)\n"
_NUM = "CASE WHEN isfinite(try_cast(trim(v) AS DOUBLE)) THEN try_cast(trim(v) AS DOUBLE) END"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw value for each event; every seventeenth has none."""
    values = F.array(*map(F.lit, RAW))
    return table(spark, sf_dir, "events").select("event_id", F.get(values, (F.col("event_id") % 17).cast("int")).alias("v"))


def _normal(name: str, column, sql: str) -> None:
    @query(name, _RAW_SQL + f"SELECT event_id, {sql} AS out FROM raw")
    def run_(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw(spark, sf_dir).select("event_id", column(F.col("v")).alias("out"))


_normal("norm_na", text.norm_na, "CASE WHEN v NOT IN ('', 'NA', 'N/A', 'null') THEN v END")
_normal("norm_multi", lambda c: F.array_join(text.norm_multi(c), "|"), "array_to_string(coalesce(list_filter(list_transform(string_split(CASE WHEN v NOT IN ('', 'NA', 'N/A', 'null') THEN v END, ';'), lambda x: trim(x)), lambda x: x <> ''), []), '|')")
_normal("norm_num", text.norm_num, _NUM)
_normal("norm_years", text.norm_years, f"CASE WHEN regexp_matches(v, '(?i)^less than 1') THEN 0.5 WHEN regexp_matches(v, '(?i)^more than 50') THEN 51.0 ELSE {_NUM} END")
_normal("norm_text", text.norm_text, "nullif(trim(v), '')")

# templates over labelled documents

TEMPLATE = "Source {{ source }}, quality {{quality}}, size {{ n_chars }}: is {{source}} toxic? {{toxic}}"
_DOCS_SQL = "WITH d AS (SELECT doc_id, text, source, quality, n_chars, toxic FROM documents LEFT JOIN labels USING (doc_id))\n"
_BOUND_SQL = "'Source ' || coalesce(source, '(unknown)') || ', quality ' || coalesce(quality::VARCHAR, '(unknown)') || ', size ' || coalesce(n_chars::VARCHAR, '(unknown)') || ': is ' || coalesce(source, '(unknown)') || ' toxic? ' || coalesce(toxic::VARCHAR, '(unknown)')"
_HASH_SQL = """sha256('{"source":' || coalesce('"' || source || '"', 'null') || ',"quality":' || coalesce('"' || quality || '"', 'null') || ',"n_chars":' || coalesce('"' || n_chars || '"', 'null') || ',"toxic":' || coalesce('"' || toxic || '"', 'null') || '}')"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("bind_text", _DOCS_SQL + f"SELECT doc_id, {_BOUND_SQL} AS bound FROM d")
def bind_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    return d.select("doc_id", text.bind_text(TEMPLATE, dict(d.dtypes)).alias("bound"))


@query("content_hash", _DOCS_SQL + f"SELECT doc_id, {_HASH_SQL} AS hash FROM d")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    return d.select("doc_id", text.content_hash(TEMPLATE, dict(d.dtypes)).alias("hash"))


@query("fmt_num", "SELECT c_custkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS shown FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN floor(c_acctbal) ELSE c_acctbal END AS v FROM customer)")
def fmt_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    v = F.when(F.col("c_custkey") % 2 == 0, F.floor("c_acctbal").cast("double")).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", text.fmt_num(v).alias("shown"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS_SQL = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '\{{\{{[^}}]*\}}\}}', ' ', 'g'), '[^a-z0-9+#.]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP_SQL}, w)))"


@query("tokenize", _DOCS_SQL + f"SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS words FROM (SELECT doc_id, {_TOKENS_SQL} AS t FROM d)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labelled(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.sort_array("t"), " ").alias("words"))


OLD_PROMPT = "Is the document about ones and the thing? Answer true or false. {{text}}"
NEW_PROMPT = "Is the document about einer ones or quality, mente and tion? Answer yes or no. {{text}}"
TERMS = tuple(text.prompt_diff(OLD_PROMPT, NEW_PROMPT)["terms"])


@query("overlap_bucket", _DOCS_SQL + f"SELECT doc_id, s AS score, CASE WHEN s = 0 THEN '0' WHEN s <= 2 THEN '1-2' ELSE '3+' END AS bucket FROM (SELECT doc_id, len(list_intersect({_TOKENS_SQL}, [{', '.join(repr(t) for t in TERMS)}])) AS s FROM d)")
def overlap_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labelled(spark, sf_dir).select("doc_id", text.overlap_score(F.col("text"), TERMS).cast("long").alias("score"))
    return s.withColumn("bucket", text.overlap_bucket(F.col("score")))


_TITLE_SQL = r"trim(regexp_replace(regexp_replace(text, '[`*_#>]', '', 'g'), '\s+', ' ', 'g'))"


@query("fallback_title", f"SELECT conv_id, turn, CASE WHEN length(t) > 72 THEN rtrim(substr(t, 1, 69)) || '...' ELSE t END AS title, least(length(text), 8000)::INT AS size FROM (SELECT conv_id, turn, text, {_TITLE_SQL} AS t FROM conversations)")
def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fallback_title(F.col("text")).alias("title"), text.clipped_length(F.col("text")).alias("size"))


@query("cosine", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], o) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(o, o))), 9) AS similarity FROM embeddings CROSS JOIN (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0)")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("o"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("o")), 9).alias("similarity"))




@query("mulberry32", """
WITH s AS (SELECT event_id, ((event_id % 1000 + (1 + event_id % 7)::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM events),
t AS (SELECT event_id, ((xor(a, a >> 15))::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t FROM s),
u AS (SELECT event_id, xor(t, ((t + (xor(t, t >> 7))::HUGEINT * (t | 61) % 4294967296) % 4294967296)::BIGINT) AS t FROM t)
SELECT event_id, xor(t, t >> 14)::DOUBLE / 4294967296 AS draw FROM u""")
def mulberry32(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", rng.mulberry32(F.col("event_id") % 1000, 1 + F.col("event_id") % 7).alias("draw"))


@query("seeded_shuffle")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").cast("string").alias("row_id"))
    return rng.replay_order(c, rng.experiment_seed(1000))


# cells of a column that asks whether an event's value is large: two versions, some rows twice

CELLS_SQL = """
WITH cells AS (
  SELECT 'big' AS column_id, event_id::VARCHAR AS row_id, 1 AS prompt_version, 'model-a' AS model, md5(round(value, 0)::BIGINT::VARCHAR) AS row_content_hash,
         CASE WHEN event_id % 41 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'cached' ELSE 'done' END AS status,
         CASE WHEN event_id % 41 = 0 THEN NULL WHEN value >= 100 THEN 'true' ELSE 'false' END AS value,
         1 + event_id % 3 AS attempts, 160 + event_id % 50 AS input_tokens, event_id % 60 AS output_tokens, (event_id % 60) / 1000000.0 AS cost_usd, event_id % 900 AS latency_ms, ts AS updated_at
  FROM events
  UNION ALL
  SELECT 'big', event_id::VARCHAR, 2, 'model-a', md5(round(value, 0)::BIGINT::VARCHAR), 'done', CASE WHEN value >= 102 THEN 'true' ELSE 'false' END, 1, 160, 60, 0.0004, event_id % 700, ts
  FROM events WHERE event_id % 10 = 0)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    nothing = {c: F.lit(None).cast("string") for c in ("rationale", "error", "certificate_id")}
    same = {"column_id": F.lit("big"), "row_id": i.cast("string"), "model": F.lit("model-a"), "row_content_hash": F.md5(F.round("value", 0).cast("bigint").cast("string")), "updated_at": F.col("at")} | nothing
    v1 = e.withColumns(same | {
        "prompt_version": F.lit(1), "status": F.when(i % 41 == 0, "error").when(i % 5 == 0, "cached").otherwise("done"),
        "value": F.when(i % 41 != 0, F.when(F.col("value") >= 100, "true").otherwise("false")), "attempts": 1 + i % 3, "input_tokens": 160 + i % 50, "output_tokens": i % 60, "cost_usd": (i % 60) / F.lit(1e6), "latency_ms": i % 900,
    })
    v2 = e.where(i % 10 == 0).withColumns(same | {
        "prompt_version": F.lit(2), "status": F.lit("done"), "value": F.when(F.col("value") >= 102, "true").otherwise("false"), "attempts": F.lit(1).cast("long"), "input_tokens": F.lit(160).cast("long"), "output_tokens": F.lit(60).cast("long"), "cost_usd": F.lit(0.0004), "latency_ms": i % 700,
    })
    names = [x.split()[0] for x in store.CELLS.replace("\n", " ").split(",")]
    return v1.select(*names).unionByName(v2.select(*names))


def columns(spark: SparkSession, version: int = 1) -> DataFrame:
    return spark.createDataFrame([("big", "events", "Big", OLD_PROMPT, version, "model-a", '{"kind":"boolean"}', None)], store.COLUMNS)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for every event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.lit("run").alias("kind"), F.lit("big").alias("column_id"), F.lit("model-a").alias("model"), (F.col("event_id") % 71).alias("cells"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), (F.col("event_id") % 71 / 100).alias("cost_usd"))


LEDGER_SQL = "ledger AS (SELECT event_id::VARCHAR AS id, ts AS written, event_id % 71 AS cells, (event_id % 71) / 100 AS cost_usd FROM events)\n"


@query("estimate_run", f"{_DOCS_SQL} SELECT rows, input_tokens, output_tokens, (input_tokens + output_tokens * 4) / 1e6 AS cost_usd, rows > 100 OR (input_tokens + output_tokens * 4) / 1e6 > 0.5 AS confirm FROM (SELECT count(*) AS rows, sum(160 + ceil(length({_BOUND_SQL}) / 4))::BIGINT AS input_tokens, count(*) * 60 AS output_tokens FROM d)")
def estimate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.estimate(run.bound(labelled(spark, sf_dir), "doc_id", TEMPLATE))


@query("ledger_total", "WITH " + LEDGER_SQL + "SELECT round(coalesce(sum(cost_usd), 0), 6) AS total FROM ledger")
def ledger_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ledger_total(ledger(spark, sf_dir)).select(F.round("total", 6).alias("total"))


@query("version_state", CELLS_SQL + "SELECT column_id, prompt_version, count(*) AS n, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'reused_certified') AS reused, count(*) FILTER (status = 'error') AS errors FROM cells GROUP BY ALL")
def version_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.version_state(cells(spark, sf_dir))


@query("avg_by_version", CELLS_SQL + "SELECT prompt_version, count(*) AS n, round(avg(output_tokens), 6) AS tokens, round(avg(latency_ms), 6) AS latency FROM cells WHERE status IN ('done', 'cached') GROUP BY prompt_version")
def avg_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).where(F.col("status").isin(*store.ANSWERED))
    return c.groupBy("prompt_version").agg(F.count("*").alias("n"), F.round(F.avg("output_tokens"), 6).alias("tokens"), F.round(F.avg("latency_ms"), 6).alias("latency"))


@query("writes_by_day", CELLS_SQL + "SELECT strftime(updated_at, '%Y-%m-%d') AS day, count(*) AS n FROM cells WHERE column_id IN ('big') AND prompt_version = 2 GROUP BY day")
def writes_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).join(F.broadcast(columns(spark).where(F.col("name").like("%Big%")).select(F.col("id").alias("column_id"))), "column_id")
    return c.where("prompt_version = 2").groupBy(F.date_format("updated_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("largest_run", "WITH " + LEDGER_SQL + "SELECT id, cells FROM ledger ORDER BY cells DESC, id LIMIT 1")
def largest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ledger(spark, sf_dir).join(F.broadcast(columns(spark).select(F.col("id").alias("column_id"))), "column_id")
    return runs.orderBy(F.col("cells").desc(), "id").limit(1).select("id", "cells")


@query("latency_sum", CELLS_SQL + "SELECT coalesce(sum(latency_ms), 0)::BIGINT AS ms, count(latency_ms) AS n, round(coalesce(sum(latency_ms), 0) / 32 / 3.6e6, 9) AS hours FROM cells WHERE prompt_version = 1")
def latency_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).where("prompt_version = 1").agg(F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("ms"), F.count("latency_ms").alias("n"))
    return c.withColumn("hours", F.round(F.col("ms") / 32 / 3.6e6, 9))


@query("ledger_span", "WITH " + LEDGER_SQL + "SELECT strftime(min(written), '%Y-%m-%d %H:%M') AS first, strftime(max(written), '%Y-%m-%d %H:%M') AS last, (SELECT count(*) FROM ledger WHERE cells > 35) AS large, (SELECT count(*) FROM ledger) AS runs FROM ledger WHERE written < (SELECT max(written) FROM ledger)")
def ledger_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger(spark, sf_dir).createOrReplaceTempView("ledger_span_runs")
    return spark.sql("""
        SELECT date_format(min(at), 'yyyy-MM-dd HH:mm') AS first, date_format(max(at), 'yyyy-MM-dd HH:mm') AS last,
               (SELECT count(*) FROM ledger_span_runs WHERE cells > 35) AS large, (SELECT count(*) FROM ledger_span_runs) AS runs
        FROM ledger_span_runs WHERE at < (SELECT max(at) FROM ledger_span_runs)""")


@query("scalar_subs", "SELECT (SELECT count(*) FROM events WHERE value >= 100) AS large, (SELECT count(DISTINCT user_id) FROM events) AS users")
def scalar_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scalar subqueries in one row."""
    return spark.sql("SELECT (SELECT count(*) FROM {e} WHERE value >= 100) AS large, (SELECT count(DISTINCT user_id) FROM {e}) AS users", e=table(spark, sf_dir, "events"))


@query("substring", "SELECT doc_id, length(substr(text, 1, 4000)) AS n, md5(substr(text, 1, 4000)) AS digest FROM documents")
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts bounded to 4000 characters, as they are before binding: a feature of this query alone."""
    cut = text.bounded(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


@query("run_window", CELLS_SQL + ", " + LEDGER_SQL + """, r AS (SELECT id, written, lag(written) OVER (ORDER BY written, id) AS since FROM ledger)
SELECT r.id AS run_id, floor(epoch(min(updated_at)))::BIGINT AS first_at, floor(epoch(max(updated_at)))::BIGINT AS last_at, count(row_id) AS n, count(*) FILTER (status = 'done') AS done
FROM r LEFT JOIN cells ON updated_at <= written AND (since IS NULL OR updated_at > since) GROUP BY r.id""")
def run_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.run_windows(ledger(spark, sf_dir), cells(spark, sf_dir))
    return out.withColumns({c: F.unix_seconds(c) for c in ("first_at", "last_at")})


@query("cells_current", CELLS_SQL + "SELECT row_id, value FROM cells WHERE prompt_version = 2")
def cells_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.current_cells(cells(spark, sf_dir), columns(spark, 2)).select("row_id", "value")


@query("cells_version", CELLS_SQL + "SELECT row_id, status, value FROM cells WHERE prompt_version = 1 AND row_id IN (SELECT c_custkey::VARCHAR FROM customer)")
def cells_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("row_id"))
    return store.cells_of_version(cells(spark, sf_dir), "big", 1, ids).select("row_id", "status", "value")


@query("cache_probe", CELLS_SQL + """, hits AS (SELECT row_content_hash, arg_min(row_id, row_id) AS hit_row_id, arg_min(value, row_id) AS hit_value FROM cells WHERE prompt_version = 2 AND status IN ('done', 'cached') GROUP BY row_content_hash)
SELECT c.row_id, hit_row_id, hit_value FROM cells c LEFT JOIN hits USING (row_content_hash) WHERE prompt_version = 1""")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    wanted = c.where("prompt_version = 1").select("column_id", "row_id", F.lit(2).alias("prompt_version"), "model", "row_content_hash")
    return store.cache_probe(wanted, c).select("row_id", "hit_row_id", "hit_value")


@query("missing_set", CELLS_SQL + "SELECT row_id FROM cells WHERE prompt_version = 1 AND row_id NOT IN (SELECT row_id FROM cells WHERE prompt_version = 2)")
def missing_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return store.missing_rows(c.where("prompt_version = 1").select("row_id"), c, "big", 2)


@query("cell_upsert", CELLS_SQL + """, new AS (SELECT row_id, 'done' AS status, 'true' AS value, 1 AS attempts, 7 AS input_tokens FROM cells WHERE prompt_version = 1 AND row_id::BIGINT % 3 = 0
  UNION ALL SELECT 'new-' || row_id, 'done', 'true', 1, 7 FROM cells WHERE prompt_version = 1 AND row_id::BIGINT % 100 = 0)
SELECT coalesce(n.row_id, c.row_id) AS row_id, coalesce(n.status, c.status) AS status, CASE WHEN n.row_id IS NOT NULL THEN n.value ELSE c.value END AS value,
       (coalesce(n.attempts, 0) + coalesce(c.attempts, 0))::BIGINT AS attempts, (coalesce(n.input_tokens, 0) + coalesce(c.input_tokens, 0))::BIGINT AS input_tokens
FROM (SELECT * FROM cells WHERE prompt_version = 1) c FULL JOIN new n ON c.row_id = n.row_id""")
def cell_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).where("prompt_version = 1")
    new = c.withColumns({"status": F.lit("done"), "value": F.lit("true"), "attempts": F.lit(1).cast("long"), "input_tokens": F.lit(7).cast("long")})
    i = F.col("row_id").cast("long")
    writes = new.where(i % 3 == 0).unionByName(new.where(i % 100 == 0).withColumn("row_id", F.concat(F.lit("new-"), "row_id")))
    return store.upsert(c, writes).select("row_id", "status", "value", "attempts", "input_tokens")


@query("cert_apply", CELLS_SQL + """SELECT row_id, 2 AS prompt_version, 'reused_certified' AS status, value, 'cert-1' AS certificate_id FROM cells
WHERE prompt_version = 1 AND status IN ('done', 'cached') AND row_id::BIGINT % 4 = 0 AND row_id NOT IN (SELECT row_id FROM cells WHERE prompt_version = 2)""")
def cert_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    reuse = c.where(F.col("row_id").cast("long") % 4 == 0).select("row_id")
    return store.apply_certificate(c, "big", 1, 2, reuse, "cert-1").select("row_id", "prompt_version", "status", "value", "certificate_id")


@query("stamped_by_cert", CELLS_SQL + "SELECT certificate_id, count(*) AS stamped FROM (SELECT CASE WHEN row_id::BIGINT % 3 = 0 THEN 'cert-a' ELSE 'cert-b' END AS certificate_id FROM cells WHERE prompt_version = 1) GROUP BY certificate_id ORDER BY stamped DESC LIMIT 1")
def stamped_by_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).where("prompt_version = 1").withColumn("certificate_id", F.when(F.col("row_id").cast("long") % 3 == 0, "cert-a").otherwise("cert-b"))
    c.createOrReplaceTempView("stamped_cells")
    spark.createDataFrame([("cert-a",), ("cert-b",)], "id string").createOrReplaceTempView("stamped_certificates")
    return spark.sql("SELECT id AS certificate_id, (SELECT count(*) FROM stamped_cells WHERE certificate_id = id) AS stamped FROM stamped_certificates ORDER BY stamped DESC LIMIT 1")


@query("flip_rate_sql", CELLS_SQL + "SELECT sum((a.value <> b.value)::INT)::BIGINT AS flips, count(*) AS n FROM cells a JOIN cells b ON a.column_id = b.column_id AND a.row_id = b.row_id WHERE a.prompt_version = 1 AND b.prompt_version = 2 AND a.status IN ('done', 'cached')")
def flip_rate_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    a = c.where((F.col("prompt_version") == 1) & F.col("status").isin(*store.ANSWERED)).select("column_id", "row_id", F.col("value").alias("a"))
    b = c.where("prompt_version = 2").select("column_id", "row_id", F.col("value").alias("b"))
    return a.join(b, ["column_id", "row_id"]).agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("flips"), F.count("*").alias("n"))


@query("run_dedupe", """WITH w AS (SELECT event_id::VARCHAR AS row_id, md5(round(value, 0)::BIGINT::VARCHAR) AS h FROM events)
SELECT row_id, row_number() OVER (PARTITION BY h ORDER BY row_id) = 1 AS computes FROM w""")
def run_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).where("prompt_version = 1")
    return run.dedupe(c).select("row_id", "computes")


def oracle(text_: str) -> dict:
    """A stand-in for a model: whether the bound text is of even length."""
    return {"value": len(text_) % 2 == 0, "rationale": "by length", "input_tokens": 160 + -(-len(text_) // 4), "output_tokens": 60, "latency_ms": len(text_)}


@query("run_column", _DOCS_SQL + f"""
, b AS (SELECT doc_id::VARCHAR AS row_id, {_BOUND_SQL.replace(', size', ', kind')} AS t0, 'Source ' || coalesce(source, '(unknown)') || ', quality ' || coalesce(quality::VARCHAR, '(unknown)') AS t FROM d),
r AS (SELECT row_id, t, row_number() OVER (PARTITION BY t ORDER BY row_id) AS k FROM b)
SELECT row_id, CASE WHEN k = 1 THEN 'done' ELSE 'cached' END AS status, CASE WHEN length(t) % 2 = 0 THEN 'true' ELSE 'false' END AS value,
       CASE WHEN k = 1 THEN 160 + ceil(length(t) / 4)::BIGINT ELSE 0 END AS input_tokens FROM r""")
def run_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], store.CELLS)
    column = {"id": "even", "prompt_template": "Source {{source}}, quality {{quality}}", "prompt_version": 1, "model": "model-a"}
    out = run.run_column(labelled(spark, sf_dir), "doc_id", column, none, oracle, run.Output("boolean"))
    return out.select("row_id", "status", "value", "input_tokens")


@query("normalize_row", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '|' || user_id::VARCHAR END AS parts FROM events")
def normalize_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text as values: an object's field, and a list, which a third of the rows lack."""
    e = table(spark, sf_dir, "events")
    listed = F.when(F.col("event_id") % 3 != 0, F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")).alias("k"), F.array_join(text.parse_arrays(listed), "|").alias("parts"))


@query("parse_cell", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '12.5' WHEN 2 THEN '\"plain text\"' WHEN 3 THEN '{\"a\":1}' END AS cell FROM events")
def parse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.get(F.array(F.lit("true"), F.lit("12.5"), F.lit("plain text"), F.lit('{"a":1}')), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.parse_cell(stored).alias("cell"))


@query("title_case", f"SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN 'Own title' ELSE CASE WHEN length(t) > 72 THEN rtrim(substr(t, 1, 69)) || '...' ELSE t END END AS title FROM (SELECT conv_id, {_TITLE_SQL} AS t FROM conversations WHERE turn = 0)")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    own = F.when(F.col("conv_id") % 2 == 1, "Own title").otherwise("New chat")
    return c.select("conv_id", text.titled(own, F.col("text")).alias("title"))


@query("snap_version", CELLS_SQL + """SELECT row_id, CASE WHEN prompt_version = 1 AND row_id::BIGINT % 4 = 0 AND row_id NOT IN (SELECT row_id FROM cells WHERE prompt_version = 2) THEN 2 ELSE prompt_version END AS prompt_version FROM cells""")
def snap_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the first version's cells turn out to be another model's."""
    c = cells(spark, sf_dir)
    c = c.withColumn("model", F.when((F.col("prompt_version") == 1) & (F.col("row_id").cast("long") % 4 == 0), "model-b").otherwise(F.col("model")))
    return store.move_cells(c, "big", 1, 2, "model-b").select("row_id", "prompt_version")


@query("sort_by_column", CELLS_SQL + """SELECT id, big, rn FROM (SELECT c_custkey AS id, (v.value = 'true') AS big, row_number() OVER (ORDER BY (v.value = 'true') DESC NULLS LAST, c_custkey) AS rn
FROM customer LEFT JOIN (SELECT row_id, value FROM cells WHERE prompt_version = 1) v ON v.row_id = c_custkey::VARCHAR WHERE v.value IS NOT NULL) WHERE rn <= 60""")
def sort_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page sorted and filtered by a computed column, as by any other field."""
    from quillstone.operators import filters as q
    from quillstone.operators.search import Table

    base = Table(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), q.catalog(q.Field("id", "integer")), "id")
    t = base.with_cells(cells(spark, sf_dir).where("prompt_version = 1"), "big", q.Field("big", "boolean"))
    return t.page(q.FilterSpec((q.Exists("big"),), sort=("big", "desc")), 60).select("id", "big", F.col("rn").cast("long").alias("rn"))


@query("embed", "SELECT doc_id, length(text)::FLOAT AS size, (ascii(substr(text, 1, 1)) % 7)::FLOAT AS first FROM documents")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stand-in for a model: the length, and the first letter, 0 without any."""
    out = run.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda texts: [[len(t), ord(t[0]) % 7 if t else 0] for t in texts], keep=["doc_id"])
    return out.select("doc_id", F.get("embedding", F.lit(0)).alias("size"), F.get("embedding", F.lit(1)).alias("first"))
