"""Queries of the training-data operators, and their SQL where SQL can express them.

Each reads its whole table and returns a row for each of the table's rows; null texts count as empty, an
empty table gives an empty result, further columns are left out, and rows that repeat an id each have a
row of their own. What an operator makes of repeated and null ids is said in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import media, toxicity, warc
from quillstone.llm.bpe import bpe_round_trip
from quillstone.llm.common import materialize, shared_path, table
from quillstone.llm.exact_dedup import exact_dedup
from quillstone.llm.language_id import identify, remainder, train
from quillstone.llm.line_dedup import line_dedup
from quillstone.llm.minhash import near_duplicates
from quillstone.llm.mixing import mix_plan
from quillstone.llm.sharding import assign, slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "op1_line_dedup",
    r"""
    WITH split AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
      FROM documents),
    keyed AS (
      SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM split),
    firsts AS (
      SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10
      GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
      SELECT doc_id, pos, line, coalesce(least <> doc_id, false) AS gone
      FROM keyed LEFT JOIN firsts USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op2_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM n WINDOW g AS (PARTITION BY t)""",
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op5_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
      FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             -- weight over training time: from w0 by slope, with an integral of 1
             [0.5, 1, 1.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w0,
             [1, 0, -1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS slope
      FROM d GROUP BY source),
    f AS (  -- sources in the order in which they reach twice their words, as the level rises
      SELECT 2.0 * source_size / weight AS full_at, sum(weight) OVER () AS all_weights,
             sum(2.0 * source_size) OVER w - 2.0 * source_size AS held, sum(weight) OVER w - weight AS gone,
             1.5 * sum(source_size) OVER () AS words, row_number() OVER w AS k
      FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT arg_min(level, k) AS level
      FROM (SELECT (words - held)::DOUBLE / (all_weights - gone) AS level, full_at, k FROM f) WHERE level <= full_at),
    t AS (SELECT source, source_size, w0, slope, CASE WHEN weight * level >= 2 * source_size THEN 2.0 * source_size ELSE weight * level END::DOUBLE AS target
      FROM s CROSS JOIN l),
    c AS (
      SELECT d.doc_id, size, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id ROWS UNBOUNDED PRECEDING) - size AS before, w0, slope
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (  -- words of each pass, and their middle's share of the source's demand
      SELECT *, greatest(0, least(size, floor(target)::BIGINT - before)) AS words1, greatest(0, least(size, floor(target)::BIGINT - source_size - before)) AS words2,
             (before + words1 / 2) / target AS y1, (before + source_size + words2 / 2) / target AS y2
      FROM c)
    SELECT doc_id, size, source_size, target, (words1 + words2)::BIGINT AS taken,
           CASE WHEN words1 > 0 THEN 2 * y1 / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y1, 0))) END AS position,
           CASE WHEN words2 > 0 THEN 2 * y2 / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y2, 0))) END AS position_again
    FROM p""",
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, position_again: training times of the passes over a document, null where the mix takes nothing."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    plan = plan.withColumn("position", F.get("positions", F.lit(0))).withColumn("position_again", F.get("positions", F.lit(1)))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, even = table(spark, sf_dir, "documents"), {i: 1.0 for i in range(40)}
    both = assign(assign(docs, even), even | {40: 1.0}, name="grown_shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = both.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return slots(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = train(docs.where("not held_out"))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score", "spans")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs.where("not held_out"), labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words", "spans")


@query("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query(
    "op4_warc",
    r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages),
    h AS (SELECT page_id, head, encode(html) AS b, sha1(html) AS s FROM p),
    d AS (SELECT i, ('0x' || substr(s, 1 + 10 * i, 10))::BIGINT AS bits, page_id FROM h CROSS JOIN range(4) t(i)),
    b AS (
      SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((bits >> (35 - 5 * j)) & 31) + 1)::BIGINT, 1), '' ORDER BY i, j) AS digest
      FROM d CROSS JOIN range(8) u(j) GROUP BY page_id)
    SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < head THEN head END AS refers_to
    FROM h JOIN b USING (page_id)""",
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), at)
    out = warc.read(spark, at, with_payload=False)
    return out.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_audio")
def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each embedding is played as a melody; ids divisible by 100 are searched for."""
    rows = table(spark, sf_dir, "embeddings")
    prints = materialize(media.fingerprints(rows, F.col("embedding"), media.melody).select("vec_id", "bits", "sound", "digest"), "prints")
    pairs = materialize(media.align(prints, F.col("vec_id") % 100 == 0, "vec_id"), "alignments")
    best = pairs.groupBy("class_id").agg(F.count("*").alias("n_links"), F.min(F.struct("bit_errors", F.col("query_class").alias("best_query"), F.col("offset").alias("best_offset"))).alias("best"))
    classes = materialize(prints.where("digest is not null").groupBy(F.col("digest").alias("d")).agg(F.min("vec_id").alias("class_id")), "classes")
    named = materialize(classes.join(best, "class_id", "left").select("d", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.best_query", "best.best_offset", F.col("best.bit_errors").alias("best_bit_errors")), "named")
    out = prints.join(named, F.col("digest") == F.col("d"), "left")
    return out.select("vec_id", F.size("bits").alias("n_integers"), F.col("digest").alias("print_digest"), "class_id", "n_links", "best_query", "best_offset", "best_bit_errors")
