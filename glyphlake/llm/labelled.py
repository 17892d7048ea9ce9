"""Labelled rows: the held-out quarter and the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
CALIBRATION_REMAINDER = 3


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == HELD_OUT_REMAINDER, F.lit(False))


def training_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most bound rows (doc_id, label, calibrate) of labels outside the held-out quarter, chosen by a hash of the id.

    Null ids and labels are left out; of repeated ids the largest label counts. Rows with calibrate set are
    for calibration, the others for fitting.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return sample.withColumn("calibrate", remainder(F.col("doc_id")) == CALIBRATION_REMAINDER)
