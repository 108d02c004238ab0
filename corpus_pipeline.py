"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, in stages.

Every stage reads what its predecessor wrote and, but for the last one, returns the columns of documents.

Defined results: documents with a null or empty text are in no language and go in the first stage; so do those
without a letter.  A null doc_id is passed on: its lines come last in order, it is no near-duplicate, and it is packed.
Rows that repeat doc_id and text are one document, of which the near_duplicates stage keeps one; of lines and documents
that tie the one with the least doc_id stays.  Very long texts pass as any other.  An empty table of documents or of
benchmark items gives an empty result or takes nothing out.  Further columns of documents are passed on up to the last
stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, langid, line_dedup, odd_minhash, packing
from tidemill.llm.common import scratch_dir, scratch_until_written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents are near-duplicates from a similarity of 0.8; a pair there is missed 5 times in a million.
NEAR = odd_minhash.Tuning(share=(80, 100))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language known from the labelled rows; those without a letter or in none go."""
    return langid.keep_languages(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and documents of which nothing else was left; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    found = found.filter(~F.coalesce(emptied, F.lit(False)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return odd_minhash.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: SQL can't express language ID by suffix automata, nor packing: the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/tidemill-scratch/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch_until_written(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
