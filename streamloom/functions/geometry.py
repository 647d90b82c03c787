"""Geometry as column expressions: letterbox, crop, IoU, polygons, tiles (P-01 P-02 P-09..P-11 P-18 F-09 G-01..G-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letterbox(w: Column, h: Column, net_w: int, net_h: int, tile: bool = False) -> Column:
    """struct(scale, pad_x, pad_y). A whole frame truncates the scaled size before halving what is left; a tile truncates only once."""
    scale = F.least(F.lit(net_w) / w, F.lit(net_h) / h)
    if tile:
        pad = lambda net, v: F.floor((F.lit(net) - v * scale) / 2)
    else:
        pad = lambda net, v: F.floor((F.lit(net) - F.floor(v * scale)) / 2)
    return F.struct(scale.alias("scale"), pad(net_w, w).cast("int").alias("pad_x"), pad(net_h, h).cast("int").alias("pad_y"))


def crop_rect(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """struct(x, y, w, h) in whole pixels: halves round away from zero, then the corner is clamped into the frame and the size to at least 1."""
    cx = F.least(F.greatest(F.round(x), F.lit(0)), frame_w - 1).cast("int")
    cy = F.least(F.greatest(F.round(y), F.lit(0)), frame_h - 1).cast("int")
    cw = F.least(F.greatest(F.round(w), F.lit(1)), frame_w - cx).cast("int")
    ch = F.least(F.greatest(F.round(h), F.lit(1)), frame_h - cy).cast("int")
    return F.struct(cx.alias("x"), cy.alias("y"), cw.alias("w"), ch.alias("h"))


def iou(a, b) -> Column:
    """Of two structs with x, y, w, h; 0 where the union is not positive."""
    iw = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    ih = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    inter = iw * ih
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd ray casting with half-open edges. polygon: array of structs x, y, a column or literal."""
    n = F.size(polygon)
    point = lambda i: F.element_at(polygon, i + 1)

    def cross(inside: Column, i: Column) -> Column:
        a, b = point(i), point(F.pmod(i + n - 1, n))
        crosses = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])
        return inside != F.coalesce(crosses, F.lit(False))

    return F.when(n < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), cross))


def tile_offsets(frame: Column, tile: int, overlap: float) -> Column:
    """Offsets of tiles along one side; the last tile is flush with the end."""
    stride = max(1, tile_stride(tile, overlap))
    k = F.greatest(F.ceil((frame - tile) / F.lit(stride)), F.lit(0))
    at = F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long")), lambda i: F.least(i * F.lit(stride), frame - tile).cast("int"))
    return F.when(frame <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(at))


def tile_stride(tile: int, overlap: float) -> int:
    """In 32-bit floats, the overlap held between 0 and 0.9."""
    import numpy as np

    return int(np.float32(tile) * (np.float32(1) - np.float32(min(max(overlap, 0.0), 0.9))))


def tile_grid(sizes: DataFrame, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """For each distinct (width, height): tile_idx, x, y, w, h; row by row from the top."""
    s = sizes.select("width", "height").distinct()
    rows = s.withColumn("y", F.explode(tile_offsets(F.col("height"), tile, overlap)))
    cells = rows.select("*", F.posexplode(tile_offsets(F.col("width"), tile, overlap)).alias("i", "x"))
    nx = F.size(tile_offsets(F.col("width"), tile, overlap))
    row = F.array_position(tile_offsets(F.col("height"), tile, overlap), F.col("y")) - 1
    return cells.select("width", "height", (row * nx + F.col("i")).cast("int").alias("tile_idx"), "x", "y", F.least("width", F.lit(tile)).alias("w"), F.least("height", F.lit(tile)).alias("h"))


def with_tiles(frames: DataFrame, tile: int = 640, overlap: float = 0.2, full_frame: bool = True) -> DataFrame:
    """Frames (with width, height) times the tiles of their size: adds tile_idx and tile, struct(x, y, w, h); -1 is the whole frame.

    The grid is made once a size and joined back; it has few rows, so the planner broadcasts it and frames do not move.
    """
    grid = tile_grid(frames, tile, overlap).select("width", "height", "tile_idx", F.struct("x", "y", "w", "h").alias("tile"))
    if full_frame:
        whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"))
        grid = grid.unionByName(frames.select("width", "height").distinct().select("width", "height", F.lit(-1).alias("tile_idx"), whole.alias("tile")))
    return frames.join(grid, ["width", "height"])


def tile_count(width: Column, height: Column, tile: int, overlap: float, full_frame: bool = True) -> Column:
    return F.size(tile_offsets(width, tile, overlap)) * F.size(tile_offsets(height, tile, overlap)) + int(full_frame)
