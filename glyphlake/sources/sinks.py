"""Writers: columns are checked, appends do not drift, raw outputs are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.textfn import newline_at_end
from glyphlake.sources import pagefiles


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns in the schema's order and types; more columns are left out, a missing one is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def csv(df: DataFrame, path: str, schema: T.StructType, sep: str = ",") -> None:
    _conform(df, schema).write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows that have exactly the log's columns, in any order; a further or missing column is an error, not a drift."""
    if set(df.columns) != set(schema.names):
        raise ValueError(f"columns {sorted(set(df.columns) ^ set(schema.names))} are not those of the log")
    _conform(df, schema).write.mode("append").parquet(path)


def raw_outputs(df: DataFrame, path: str) -> None:
    """Model outputs (page_id, model, version, text), one partition each; writing where there is something already fails."""
    df.write.mode("errorifexists").partitionBy("page_id", "model", "version").parquet(path)


def page_texts(df: DataFrame, path: str) -> None:
    """One text file a page, by document, with a line end at its end."""
    pages = pagefiles.by_page(df.select("doc_id", "page", newline_at_end(F.coalesce("text", F.lit(""))).alias("text")))
    if pagefiles.is_local(df.sparkSession, path):
        return pagefiles.write(pages, path)
    line = F.regexp_replace("text", r"\n\z", "")  # the writer ends it again
    pages.withColumn("text", line).write.mode("overwrite").partitionBy("doc_id", "page").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=True)


def sorted_map(column: str):
    """A map with its keys in order, for output."""
    return F.map_from_entries(F.array_sort(F.map_entries(column)))


def unfinished(wanted: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Extension: the rows of wanted that an output written so far lacks, so that a stopped batch can go on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return wanted
    return wanted.join(spark.read.parquet(path).select(key), key, "left_anti")
