"""A plain second implementation of the tiled-free detector head, row by row, against which `verify` holds the first (N-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import _DETS


def overlap(a, b) -> float:
    w = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0.0)
    h = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0.0)
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def detect(raw, anchors: int, classes: int, lb, src_w: float, src_h: float, score: float, iou: float) -> list[tuple]:
    """(x, y, w, h, score, cls) of the boxes that stay."""
    found = []
    for i in range(anchors):
        best, cls = 0.0, 0
        for c in range(classes):
            s = raw[(4 + c) * anchors + i]
            if s > best:
                best, cls = s, c
        if best < score:
            continue
        cx, cy, w, h = (raw[k * anchors + i] for k in range(4))
        x0, y0 = (cx - w / 2 - lb["pad_x"]) / lb["scale"], (cy - h / 2 - lb["pad_y"]) / lb["scale"]
        x1, y1 = min(x0 + w / lb["scale"], src_w), min(y0 + h / lb["scale"], src_h)
        x0, y0 = max(x0, 0.0), max(y0, 0.0)
        found.append((x0, y0, max(x1 - x0, 0.0), max(y1 - y0, 0.0), best, cls))
    kept: list[tuple] = []
    for d in sorted(found[:1024], key=lambda d: (-d[4], d[5], d[0])):
        if all(k[5] != d[5] or overlap(k, d) <= iou for k in kept):
            kept.append(d)
    return kept


def reference(raw: Column, anchors: int, classes: int, lb: Column, src_w: Column, src_h: Column, score: float, iou: float) -> Column:
    @F.udf(_DETS)
    def run(raw, lb, w, h):
        return None if raw is None else detect(raw, anchors, classes, lb, float(w), float(h), score, iou)

    return run(raw, lb, src_w, src_h)


def agrees(dets: Column, expected: Column, tolerance: float = 0.1) -> Column:
    """Whether both lists have the same detections in the same places: class and score equal, boxes within tolerance."""
    near = lambda a, b: (a["cls"] == b["cls"]) & (a["score"] == b["score"]) & (F.abs(a["x"] - b["x"]) < tolerance) & (F.abs(a["y"] - b["y"]) < tolerance) & (F.abs(a["w"] - b["w"]) < tolerance) & (F.abs(a["h"] - b["h"]) < tolerance)
    return (F.size(dets) == F.size(expected)) & F.forall(F.zip_with(dets, expected, near), lambda ok: F.coalesce(ok, F.lit(False)))
