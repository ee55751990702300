"""Fixed-size tiles of frames, and their geometry.

``planned`` makes the tiles of a range within the range's row, by arithmetic; ``tiles`` groups the
rows of a table of real frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefmt import cell_label, micro
from .sampling import frame_count, timestamp


def auto_cols(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")


def grid_cols(frames_in_tile: Column, cols: Column, frames_per_tile: Column) -> Column:
    return F.coalesce(cols, auto_cols(F.least(frames_in_tile, frames_per_tile)))


def grid_rows(frames_in_tile: Column, cols: Column) -> Column:
    return F.ceil(frames_in_tile / cols).cast("int")


def fit_cell_width(cols: Column, rows: Column, gap: Column, label_height: Column, aspect: Column, tile_width: Column, tile_height: Column) -> Column:
    """The widest cell with which the grid keeps within the tile, at least 1."""
    across = (tile_width - (cols - 1) * gap) / cols
    down = F.greatest(F.lit(1.0), (tile_height - (rows - 1) * gap) / rows - label_height) / aspect
    return F.greatest(F.lit(1), F.floor(F.least(across, down))).cast("int")


def rounded(value: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(value).cast("int")


def font_size(label_height: Column) -> Column:
    return F.greatest(F.lit(12), F.least(F.lit(24), rounded(label_height * 0.55)))


def label_inset(label_height: Column) -> Column:
    return F.greatest(F.lit(1), rounded(label_height * 0.18))


def chunk(frames: DataFrame) -> DataFrame:
    """Add tile_index, local_index and frames_in_tile from frame_index, frame_total and
    frames_per_tile: arithmetic, without a look at other rows."""
    per = F.col("frames_per_tile")
    tile = F.floor(F.col("frame_index") / per).cast("int")
    return (
        frames.withColumn("tile_index", tile)
        .withColumn("local_index", F.col("frame_index") - F.col("tile_index") * per)
        .withColumn("frames_in_tile", F.least(per, F.col("frame_total") - F.col("tile_index") * per))
    )


def chunk_rows(rows: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Number a key's rows from 0 and cut them into tiles of ``size``."""
    w = Window.partitionBy(*key)
    numbered = rows.withColumn("frame_index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("frame_total", F.count("*").over(w).cast("int"))
    return chunk(numbered.withColumn("frames_per_tile", F.lit(size)))


def with_geometry(cells: DataFrame) -> DataFrame:
    """Add a tile's grid and pixel size and a cell's place and label to chunked frames.

    Needs frames_per_tile, cols, cell_width, gap, label_height, tile_width, tile_height (targets)
    and the source's width and height."""
    c = F.col
    out = cells.withColumn("grid_cols", grid_cols(c("frames_in_tile"), c("cols"), c("frames_per_tile")))
    out = out.withColumn("grid_rows", grid_rows(c("frames_in_tile"), c("grid_cols"))).withColumn("aspect", c("source_height") / c("source_width"))
    fit = fit_cell_width(c("grid_cols"), c("grid_rows"), c("gap"), c("label_height"), c("aspect"), c("tile_width"), c("tile_height"))
    out = out.withColumn("cell_w", F.coalesce("cell_width", fit)).withColumn("cell_h", F.greatest(F.lit(1), rounded(c("cell_w") * c("aspect"))))
    out = out.withColumn("tile_w", c("grid_cols") * c("cell_w") + (c("grid_cols") - 1) * c("gap"))
    out = out.withColumn("tile_h", c("grid_rows") * (c("cell_h") + c("label_height")) + (c("grid_rows") - 1) * c("gap"))
    out = out.withColumn("row", F.floor(c("local_index") / c("grid_cols")).cast("int")).withColumn("col", c("local_index") % c("grid_cols"))
    out = out.withColumn("left", c("col") * (c("cell_w") + c("gap"))).withColumn("top", c("row") * (c("cell_h") + c("label_height") + c("gap")))
    return out.withColumn("label_text", cell_label(c("frame_index"), c("timestamp_sec"))).withColumn("stored_sec", micro(c("timestamp_sec")))


def planned(ranges: DataFrame, with_cells: bool = False) -> DataFrame:
    """Add frame_total, tile_count and ``tiles``, in order, to ranges with bounds, fps, tile options
    and the source's size: one row a range all the way, without a look at other rows."""
    c = F.col
    per, height, gap = c("frames_per_tile"), c("label_height"), c("gap")
    aspect = c("source_height") / c("source_width")
    out = ranges.withColumn("frame_total", frame_count(c("start_sec"), c("end_sec"), c("fps")))
    out = out.withColumn("tile_count", F.ceil(c("frame_total") / per).cast("int"))
    at = lambda k: micro(timestamp(c("start_sec"), k, c("fps")))

    def bounds(index: Column) -> Column:
        first = (index * per).cast("int")
        last = (F.least(c("frame_total"), first + per) - 1).cast("int")
        return F.struct(index.alias("tile_index"), first.alias("start_frame"), last.alias("end_frame"), at(first).alias("start_timestamp_sec"), at(last).alias("end_timestamp_sec"), (last - first + 1).alias("frame_count"))

    def grid(t: Column) -> Column:
        across = grid_cols(t["frame_count"], c("cols"), per)
        return t.withField("grid_cols", across).withField("grid_rows", grid_rows(t["frame_count"], across))

    def cell(t: Column) -> Column:
        wide = F.coalesce(c("cell_width"), fit_cell_width(t["grid_cols"], t["grid_rows"], gap, height, aspect, c("tile_width"), c("tile_height")))
        return t.withField("cell_w", wide).withField("cell_h", F.greatest(F.lit(1), rounded(wide * aspect)))

    def size(t: Column) -> Column:
        wide = t["grid_cols"] * t["cell_w"] + (t["grid_cols"] - 1) * gap
        return t.withField("tile_w", wide).withField("tile_h", t["grid_rows"] * (t["cell_h"] + height) + (t["grid_rows"] - 1) * gap)

    def cells(t: Column) -> Column:
        each = lambda k: F.struct(k.alias("frame_index"), at(k).alias("timestamp_sec"), frame_name(k).alias("filename"), F.floor((k - t["start_frame"]) / t["grid_cols"]).cast("int").alias("row"), ((k - t["start_frame"]) % t["grid_cols"]).alias("col"))
        return t.withField("cells", F.transform(F.sequence(t["start_frame"], t["end_frame"]), each))

    tiles = F.sequence(F.lit(0), c("tile_count") - 1)
    for step in (bounds, grid, cell, size, *([cells] if with_cells else [])):
        tiles = F.transform(tiles, step)
    return out.withColumn("tiles", tiles)


def frame_name(index: Column) -> Column:
    return F.format_string("frame_%06d.jpg", index)


def tiles(cells: DataFrame, key: list[str]) -> DataFrame:
    """One row a tile: bounds, grid, size, and its cells in order."""
    at = "frame_index"
    cell = F.struct(at, F.col("stored_sec").alias("timestamp_sec"), frame_name(F.col(at)).alias("filename"), "row", "col")
    shared = ("grid_cols", "grid_rows", "cell_w", "cell_h", "tile_w", "tile_h")
    return cells.groupBy(*key, "tile_index").agg(
        F.min(at).alias("start_frame"),
        F.max(at).alias("end_frame"),
        F.min_by("stored_sec", at).alias("start_timestamp_sec"),
        F.max_by("stored_sec", at).alias("end_timestamp_sec"),
        F.count("*").cast("int").alias("frame_count"),
        *(F.first(c).alias(c) for c in shared),
        F.array_sort(F.collect_list(cell)).alias("cells"),
    )


def warnings() -> Column:
    """What a range's size calls for: advice on large tiles, and word of the split."""
    many = (F.col("frame_total") > F.col("frames_per_tile")) & ~F.coalesce(F.col("quiet_warnings"), F.lit(False))
    large = F.when(many & (F.col("frames_per_tile") > 16), "large_tiles")
    split = F.when(many, F.concat(F.lit("split_into_"), F.ceil(F.col("frame_total") / F.col("frames_per_tile"))))
    return F.array_compact(F.array(large, split))
