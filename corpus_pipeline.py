"""Training-data pipeline: rejects toxic and poor documents, near copies and recurring passages, then packs the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever these are beside doc_id and text.

Defined results: an empty table stays empty; repeated rows are scored alike, and one of them stays where near copies go; null
and empty texts are scored like any text and are no copies of anything; a null doc_id stays; a text from which nothing
goes is handed on byte for byte, null as null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import neardup, packing, quality, substrings, toxicity
from glyphlake.llm.workspace import Workspace

TOXIC_FROM = 0.3
GOOD_FROM = 0.7
SHINGLE_WORDS = 5
WINDOW_WORDS = 35


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    score = toxicity.probability_of(toxicity.fit(docs, _labels(spark, sf_dir)), spark)
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    score = quality.probability_of(spark, quality.fit(docs, _labels(spark, sf_dir)))
    return docs.where(score(F.col("text")) >= GOOD_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return neardup.keep_first(docs, SHINGLE_WORDS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that recur and the white space after them; n_chars follows the text."""
    name = substrings.unused(docs, "kept")
    found = substrings.kept(docs, name, WINDOW_WORDS)
    changed = {"text": F.col(f"{name}.text")} | ({"n_chars": F.length(f"{name}.text").cast("long")} if "n_chars" in docs.columns else {})
    return found.withColumns(changed).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_copies", drop_near_copies),
    ("passages", drop_passages),
    ("packing", pack),
]

#: No stage but the last is one that SQL can express; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder for the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.release()
    return STAGES[-1][1](spark, docs, sf_dir)
