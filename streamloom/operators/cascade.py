"""Routing detections to secondary models and aligned assembly (F-05..F-08 G-05 J-01 N-05..N-07 P-21 A-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crop_rect


def route(classes=None, min_score: float | None = None, min_size: float | None = None, cls: Column | None = None, score: Column | None = None, rect: Column | None = None) -> Column:
    """The conjunction of the criteria that are set; none set passes all. The size is the smaller side of the clamped crop."""
    ok = F.lit(True)
    if classes:
        ok = ok & (F.col("cls") if cls is None else cls).isin(list(classes))
    if min_score:
        ok = ok & ((F.col("score") if score is None else score) >= min_score)
    if min_size:
        r = F.col("rect") if rect is None else rect
        ok = ok & (F.least(r["w"], r["h"]) >= min_size)
    return ok


def crops(detections: DataFrame) -> DataFrame:
    """Detections (with width, height of their frame) and rect, the pixels a child would see."""
    return detections.withColumn("rect", crop_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height")))


#: What a detection that was not routed to a child has in the child's place (fixed values).
DEFAULTS = {"ctc": "", "argmax_label": 0, "argmax_score": 0.0}


def aligned(detections: DataFrame, child: DataFrame, family: str) -> DataFrame:
    """One row a frame with the child's outputs in the detections' places; child: (stream_id, frame_no, det_idx, text | label, score | vector)."""
    keys = ["stream_id", "frame_no", "det_idx"]
    j = detections.select(keys).join(child.withColumn("_hit", F.lit(True)), keys, "left").withColumn("routed", F.coalesce("_hit", F.lit(False)))
    if family == "ctc":
        j = j.withColumn("text", F.coalesce("text", F.lit("")))
        values = {"texts": "text"}
    elif family == "argmax":
        j = j.withColumn("label", F.coalesce("label", F.lit(0))).withColumn("score", F.coalesce("score", F.lit(0.0)))
        values = {"labels": "label", "label_scores": "score"}
    elif family == "embedding":
        j = j.withColumn("vector", F.coalesce("vector", F.array().cast(dict(child.dtypes)["vector"])))
        values = {"vectors": "vector"}
    else:
        raise ValueError(f"unknown child family {family!r}")
    rows = j.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("det_idx", *values.values(), "routed"))).alias("d"))
    of = lambda v: F.transform("d", lambda s: s[v])
    return rows.select("stream_id", "frame_no", *[of(v).alias(k) for k, v in values.items()], of("routed").alias("routed"))
