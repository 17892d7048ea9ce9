"""Lines of a page from positioned glyphs: gaps and islands, runs, nearest hosts and neighbours, all by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators.shared import unused


def by_gaps(df: DataFrame, by: list[str], position: str, gap: float | Column, name: str = "row_id", ties: tuple[str | Column, ...] = ()) -> DataFrame:
    """df with the number, from 0, of the cluster a row is in: a new one starts where a position is more than gap after the one before."""
    order = Window.partitionBy(*by).orderBy(position, *ties)
    start = F.coalesce((F.col(position) - F.lag(position).over(order) > gap).cast("int"), F.lit(0))
    (begin,) = unused(df, "start")
    return df.withColumn(begin, start).withColumn(name, F.sum(begin).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop(begin)


def by_change(df: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str = "run_id") -> DataFrame:
    """df with the number, from 0, of the maximal run of rows with equal value that a row is in."""
    window = Window.partitionBy(*by).orderBy(*order)
    kind, begin = unused(df, "value", "start")
    changed = df.withColumn(kind, value)
    changed = changed.withColumn(begin, F.coalesce((~F.col(kind).eqNullSafe(F.lag(kind).over(window))).cast("int"), F.lit(0)))
    first = F.row_number().over(window) == 1
    changed = changed.withColumn(begin, F.when(first, 0).otherwise(F.col(begin)))
    return changed.withColumn(name, F.sum(begin).over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop(begin, kind)


def neighbour(value: Column, skip: Column, window: Window, ahead: bool) -> Column:
    """The nearest value after (or before) a row that is not to be skipped."""
    frame = window.rowsBetween(1, Window.unboundedFollowing) if ahead else window.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.first if ahead else F.last
    return pick(F.when(~skip, value), ignorenulls=True).over(frame)


def nearest(marks: DataFrame, hosts: DataFrame, by: list[str], distance: Column, mark_key: list[str], order: str) -> DataFrame:
    """Each mark with its nearest host in the same group; ties go to the host that comes first in order.

    An equi-join on the group, of which a page's row bounds the size, then a minimum.
    """
    joined = marks.join(hosts, by).withColumn("_d", distance)
    host = [c for c in hosts.columns if c not in by]
    kept = [c for c in marks.columns if c not in {*by, *mark_key}]
    found = joined.groupBy(*by, *mark_key).agg(F.min_by(F.struct(*host, F.col("_d").alias("distance")), F.struct("_d", order)).alias("_host"), *(F.first(c).alias(c) for c in kept))
    return found.select(*by, *mark_key, *kept, "_host.*")


def nearest_on_axis(rows: DataFrame, by: list[str], position: str, key: str, mark: Column, host: Column) -> DataFrame:
    """(by, key, host, distance): each mark with the host of its group that is nearest in position; ties go to the smaller key.

    On one axis that is the last host up to the mark or the first from it on: two running maxima, no pairs.
    """
    at, up, down = unused(rows, "at", "up", "down")
    found = F.when(host, F.struct(F.col(position).alias("p"), (-F.col(key)).alias("k")))
    back = F.when(host, F.struct((-F.col(position)).alias("p"), (-F.col(key)).alias("k")))
    ahead = Window.partitionBy(*by).orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*by).orderBy(F.desc(position)).rangeBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn(at, mark).withColumn(up, F.max(found).over(ahead)).withColumn(down, F.max(back).over(behind))
    near = F.array_min(F.filter(F.array(F.struct((F.col(position) - F.col(up)["p"]).alias("d"), (-F.col(up)["k"]).alias("h")), F.struct((-F.col(down)["p"] - F.col(position)).alias("d"), (-F.col(down)["k"]).alias("h"))), lambda x: x["d"].isNotNull()))
    return seen.where(F.col(at)).withColumn(up, near).where(F.col(up).isNotNull()).select(*by, key, F.col(up)["h"].alias("host"), F.col(up)["d"].alias("distance"))


def inside_or_edge(x0: Column, x1: Column, host_x0: Column, host_x1: Column) -> Column:
    """0 if a mark's middle is within a host, else how far it is from the host's nearer edge."""
    middle = (x0 + x1) / 2
    return F.when(middle.between(F.least(host_x0, host_x1), F.greatest(host_x0, host_x1)), 0.0).otherwise(F.least(F.abs(middle - host_x0), F.abs(middle - host_x1)))


def between_centres(x0: Column, x1: Column, host_x0: Column, host_x1: Column) -> Column:
    return F.abs((host_x0 + host_x1) / 2 - (x0 + x1) / 2)


def clamp_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, pad: float) -> Column:
    """struct(left, top, right, bottom): a box grown by pad on all sides, within a page."""
    zero = F.lit(0)
    return F.struct(F.greatest(zero, left - pad).alias("left"), F.greatest(zero, top - pad).alias("top"), F.least(width, right + pad).alias("right"), F.least(height, bottom + pad).alias("bottom"))


def area_percent(box: Column, width: Column, height: Column) -> Column:
    return 100.0 * (box["right"] - box["left"]) * (box["bottom"] - box["top"]) / (width * height)


def token_estimate(box: Column) -> Column:
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"]) / 750


def content_box(pixels: DataFrame, by: str, below: int = 245) -> DataFrame:
    """(by, left, top, right, bottom) of the pixels (x, y, value) that are darker than `below`; right and bottom are exclusive."""
    return pixels.where(F.col("value") < below).groupBy(by).agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"))


def spread_halves(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The right and then the left half of a spread, as an array of (half, x0, y0, x1, y1)."""
    middle = x0 + (x1 - x0) / 2
    half = lambda name, a, b: F.struct(F.lit(name).alias("half"), a.alias("x0"), y0.alias("y0"), b.alias("x1"), y1.alias("y1"))
    return F.array(half("a_right", middle, x1), half("b_left", x0, middle))
