"""Regular grids over ranges, and the row of a timeline that stands at each instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_count(start: Column, end: Column, fps: Column) -> Column:
    """Frames of a range: its length times the rate, rounded half up, at least one."""
    return F.greatest(F.lit(1), F.floor((end - start) * fps + 0.5)).cast("int")


def timestamp(start: Column, frame_index: Column, fps: Column) -> Column:
    """The nominal time of a frame."""
    return start + frame_index / fps


def frames(ranges: DataFrame) -> DataFrame:
    """A row for each frame of each range (start_sec, end_sec, fps): frame_index from 0, time."""
    n = frame_count(F.col("start_sec"), F.col("end_sec"), F.col("fps"))
    grid = ranges.withColumn("frame_total", n).withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("frame_total") - 1)))
    return grid.withColumn("timestamp_sec", timestamp(F.col("start_sec"), F.col("frame_index"), F.col("fps")))


def nearest_before(grid: DataFrame, rows: DataFrame, key: str, at: str, time: str, order: str, value: str, stretch: float = 3600.0) -> DataFrame:
    """Add ``value`` of the latest of ``rows`` with the same key and ``time`` before ``at``, of
    the key's first row if there is none.

    A key's time is cut into stretches of ``stretch`` seconds, which are sorted apart; what stands
    last in each is carried into the next ones from a table of one row a stretch, so that a key with
    most of the rows is many tasks' work."""
    kind = rows.schema[value].dataType
    cell = F.floor(F.col("_t") / stretch).alias("_cell")
    g = grid.select(key, F.col(at).alias("_t"), F.lit(None).cast("bigint").alias("_o"), F.lit(0).alias("_side"), F.struct(*grid.columns).alias("_grid"), F.lit(None).cast(kind).alias("_v"))
    r = rows.select(key, F.col(time).alias("_t"), F.col(order).cast("bigint").alias("_o"), F.lit(1).alias("_side"), F.lit(None).cast(g.schema["_grid"].dataType).alias("_grid"), F.col(value).alias("_v"))
    both = g.unionByName(r).select("*", cell)
    of_row = F.when(F.col("_side") == 1, F.struct("_t", "_o"))
    ends = both.groupBy(key, "_cell").agg(F.max_by(F.struct("_v"), of_row).alias("_end"), F.min_by(F.struct("_v"), of_row).alias("_begin"))
    by_cell = Window.partitionBy(key).orderBy("_cell")
    carried = ends.select(
        key, "_cell", F.last("_end", ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_begin", ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"),
    )
    # A row at the very instant is not before it: grid rows sort first.
    w = Window.partitionBy(key, "_cell").orderBy("_t", "_side", "_o")
    last = F.last(F.when(F.col("_side") == 1, F.struct("_v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = both.join(carried, [key, "_cell"]).withColumn("_last", last).where("_side = 0")
    return found.select("_grid.*", F.coalesce("_last", "_before", "_first")["_v"].alias(value))
