"""A corpus from raw documents to token ids, in stages that are written and read again.

Each stage takes any table with the columns of documents and leaves out further ones. An empty table
gives an empty table. Rows with a null id, or that repeat an id, go through all stages by the rules
stated at each of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language_id, mixing
from quillstone.llm.bpe import encode_and_back
from quillstone.llm.common import materialize, table
from quillstone.llm.line_dedup import line_dedup
from quillstone.llm.minhash import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without any letters go.

    Null and empty texts go, texts of any length are read whole, rows that repeat share their fate. If no
    row has a language, all go.
    """
    model = language_id.train(docs.where(language_id.remainder(F.col("doc_id"), 3) != 1))
    found = language_id.identify(docs, model, spans=False)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of smaller id holds; n_chars follows.

    Every row stays, be its text empty or null, and then becomes empty. Rows that repeat an id are one
    document; a null id is greater than any other.
    """
    out = line_dedup(docs)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar to 0.8 or more.

    Rows without words, null texts among them, are near nothing and stay; so do rows with a null id, and
    all rows of an id that stays.
    """
    return near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row for each pass over a document that the mix takes.

    Texts without words are never taken; null sources are one source; rows that repeat id, source and
    text are taken alike. The document at which a source's target is reached comes whole.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the SHA-256 of the bytes that they decode to: those of the text.

    Null and empty texts have no ids; texts of any length are encoded whole.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = docs.withColumn("t", encode_and_back(F.col("text"), path, pattern))
    return out.select("doc_id", "lang", "source", "t.ids", F.size("t.ids").cast("long").alias("n_tokens"), "t.decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near", dedup_near),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the language model; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
