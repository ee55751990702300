"""Tiles as pictures: one task draws a tile from its few frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import pixels

_GEOMETRY = ("grid_cols", "cell_w", "cell_h", "tile_w", "tile_h", "label_height", "gap", "font_size", "label_inset")


def draw_tiles(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, tile_index, content), PNG pictures, from frames with their place, size and label
    (``tiling.with_geometry``, font_size, label_inset and content).  A group has a tile's frames."""
    used = cells.select(*key, "tile_index", "local_index", "label_text", "content", *_GEOMETRY)
    shape = used.select(*key, "tile_index", "content").schema

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("local_index")
        g = {n: table[n][0].as_py() for n in _GEOMETRY}
        pictures = [pixels.opened(x.as_py()) for x in table["content"]]
        tile = pixels.drawn(pictures, table["label_text"].to_pylist(), g["grid_cols"], (g["cell_w"], g["cell_h"]), (g["tile_w"], g["tile_h"]), g["label_height"], g["gap"], g["font_size"], g["label_inset"])
        return pa.table([*(table[c].slice(0, 1) for c in (*key, "tile_index")), pa.array([pixels.png(tile)], pa.binary())], names=[*key, "tile_index", "content"])

    return used.groupBy(*key, "tile_index").applyInArrow(draw, shape)
