"""Extension: the script census over a stream of documents, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.charclass import class_counts


def windowed_census(docs: DataFrame, event_time: str, text: str = "text", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, end, documents, one sum for each class) of tumbling windows; works on a stream and on a table."""
    counted = docs.withWatermark(event_time, late).withColumns(class_counts(F.col(text)))
    sums = [F.sum(c).alias(c) for c in class_counts(F.col(text))]
    grouped = counted.groupBy(F.window(event_time, window).alias("w")).agg(F.count("*").alias("documents"), *sums)
    return grouped.select("w.start", "w.end", *(c for c in grouped.columns if c != "w"))
