"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  Each but the last returns the columns of
`documents`; its result is written as Parquet and read again as the next stage's docs.

Edge cases, of all stages: an empty table gives an empty result with the same columns; columns beyond those of `documents`,
whatever their names, pass through all but the last; a null id is carried along; rows that repeat are judged alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import decontaminated
from millrace.llm.langid import identified
from millrace.llm.ngram_join import keep_first
from millrace.llm.pieces import encoder
from millrace.llm.secrets import redacted
from millrace.llm.session import bounded_batches, ensure_checkpoint_dir

#: SQL for run()'s rows: learned models, retrieval and sampling can't be put in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay; a text that is null or without a letter goes, and a null lang is no reason."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; blank and null texts are nobody's copies and stay."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; without a benchmark, or a text, none does."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts, and n_chars counted again; every document stays, null texts as they are."""
    return redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, lossless, ids) of every document; a null text has null ids and no pieces."""
    bounded_batches(spark)
    coded = docs.select("doc_id", "lang", "source", encoder()(F.col("text").cast("string"), F.col("doc_id").cast("long")).alias("_e"))
    return coded.select("doc_id", "lang", "source", "_e.n_pieces", "_e.lossless", "_e.ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and reread."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:  # nothing reads it any more
                _delete(spark, last)
            last = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
