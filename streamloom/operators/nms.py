"""Non-maximum suppression as array folds: no shuffle, no Python (N-02 N-03 U-01 O-01 O-02 J-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.decode import in_order
from ..functions.geometry import iou

CAP = 1024


def suppress(dets: Column, threshold: float = 0.45, cap: int = CAP) -> Column:
    """Greedy, per class: of dets (x, y, w, h, score, cls) in order, those whose IoU with no kept one of their class is over the threshold.

    At most cap candidates are taken, by their place in dets.
    """

    def step(kept: Column, d: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["cls"] == d["cls"]) & (iou(k, d) > threshold))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(d)))

    # A lambda over an array of one element binds a value, which is then evaluated once.
    ordered = F.array(in_order(F.slice(dets, 1, cap)))
    return F.transform(ordered, lambda o: F.aggregate(F.slice(o, 2, cap), F.slice(o, 1, 1), step))[0]


def merge_tiles(full: Column, tiles: Column, merge_iou: float = 0.5, cap: int = CAP) -> Column:
    """Survivors of the full frame and of all tiles (array of arrays), in this order, suppressed once more."""
    return suppress(F.concat(full, F.flatten(tiles)), merge_iou, cap)
