"""Numbering rows, of a table or of each group, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.operators.shared import unused, written


def group_index(df: DataFrame, by: list[str], order: list[Column | str], name: str = "index") -> DataFrame:
    """df with a gapless 0-based number within each group in the given order, which must tell a group's rows apart.

    Rows are dealt by range of group and order and sorted within partitions, so that a group of any size is many tasks; what is
    joined with them are the runs of groups in partitions: one for each group and each partition, at most. Null is a group.
    """
    part, at, first, n, base = unused(df, "part", "at", "first", "n", "base")
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = written(dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    runs = written(dealt.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(n)), "runs")
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"key{k}" for k in range(len(by))]
    bases = runs.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(part).alias("in_part"), (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(base))
    on = F.col(part) == F.col("in_part")
    for c, k in zip(by, keys):
        on = on & dealt[c].eqNullSafe(F.col(k))
    return dealt.join(bases, on).withColumn(name, (F.col(at) + F.col(base)).cast("long")).drop(part, at, base, "in_part", *keys)


def global_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """df with a gapless 0-based number in the given order, which must tell rows apart."""
    (every,) = unused(df, "every")
    return group_index(df.withColumn(every, F.lit(0)), [every], order, name).drop(every)
