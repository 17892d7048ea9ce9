"""Readers of corpus files: tables, page texts, decode seeds, transcriptions, binaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import textfn as X
from glyphlake.sources import pagefiles, schemas


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header; a byte-order mark before it does not matter."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep="\t", quote='"', escape='"', multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def seed(spark: SparkSession, path: str, must_exist: bool = True) -> DataFrame:
    """(font_family, code, text) of a decode table; where it need not exist, a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not must_exist and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "font_family string, code string, text string")
    return spark.read.schema(schemas.SEED).json(path, multiLine=True).select("font_family", F.explode("map").alias("code", "text"))


def page_texts(spark: SparkSession, folder: str, pages: list[int] | None = None) -> DataFrame:
    """(page, text) of files page-NNNN.txt; a list of pages is applied to file names before anything is read."""
    names = "page-*.txt" if pages is None else "page-{" + ",".join(f"{p:04d}" for p in pages) + "}.txt"
    found = spark.read.text(f"{folder}/{names}", wholetext=True)
    return found.select(X.page_number(F.col("_metadata.file_name")).alias("page"), F.col("value").alias("text"))


def page_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) of what sinks.page_texts writes."""
    if pagefiles.is_local(spark, path):
        return pagefiles.read(spark, path).withColumn("page", F.col("page").cast("int"))
    found = spark.read.schema("value string, doc_id string, page int").text(path, wholetext=True)
    return found.select("doc_id", "page", F.col("value").alias("text"))


def transcriptions(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, tag, text) of <page>/<page>_<tag>_original.txt; gold is <page>/<page>_gold.txt with a null tag."""
    found = spark.read.text([f"{folder}/*/*_original.txt", f"{folder}/*/*_gold.txt"], wholetext=True)
    path = F.col("_metadata.file_path")
    page = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract(path, r"([^/]+)\.txt$", 1)
    tag = F.when(stem != F.concat(page, F.lit("_gold")), X.tag_of_run(page, stem))
    return found.select(page.alias("page_id"), tag.alias("tag"), F.col("value").alias("text")).where(stem.startswith(page))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(version, prompt) of prompt files named ..._<version>.txt."""
    found = spark.read.text(f"{folder}/*.txt", wholetext=True)
    return found.select(F.regexp_extract("_metadata.file_name", r"_([^_.]+)\.txt$", 1).alias("version"), F.col("value").alias("prompt"))


def binaries(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size_mb, md5, content) of all files below a folder whose names match, path relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = "/" + re.sub(r"^\w+:", "", folder).strip("/") + "/"
    relative = F.substring_index("path", root, -1)
    return found.select(relative.alias("path"), F.round(F.col("length") / 1e6, 2).alias("size_mb"), F.md5("content").alias("md5"), "content")


def page_range(pages: DataFrame, start: int, end: int, column: str = "page") -> DataFrame:
    """Pages from start to end, both included, counted from 1."""
    return pages.where(F.col(column).between(max(1, start), end))
