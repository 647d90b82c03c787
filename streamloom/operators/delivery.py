"""Result rows to sinks (K-01..K-05 K-10 K-12 K-13 K-14 K-16 J-14 U-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import streamed


def event_line() -> Column:
    """One JSON object a frame. Embeddings and labels are not in it; strings are fully escaped."""
    det = lambda d: F.struct(*[F.round(d[c], 2).alias(c) for c in ("x", "y", "w", "h")], F.round(d["score"], 4).alias("score"), d["cls"].alias("cls"))
    ms = F.struct(*[F.round(F.col(c), 3).alias(n) for n, c in (("pre", "ms_pop_to_ready"), ("queue", "ms_ready_to_take"), ("gpu", "ms_take_to_done"))])
    return F.to_json(
        F.struct(
            F.col("stream_id").alias("stream"), F.col("frame_no").alias("frame"), "pts_us", F.col("batch_seq").alias("batch"),
            F.transform("detections", det).alias("dets"), "texts", ms.alias("ms"), "frame_addr",
        )
    )


def for_sink(results: DataFrame, stream: int | None = None) -> DataFrame:
    return results if stream is None else results.where(F.col("stream_id") == stream)


def dump_lines(detections: DataFrame) -> DataFrame:
    """(stream_id, frame_no, det_idx, line): a header line per frame at det_idx -1, then one line per detection."""
    head = detections.groupBy("stream_id", "frame_no").agg(F.count("*").alias("n"))
    first = head.select("stream_id", "frame_no", F.lit(-1).alias("det_idx"), F.concat_ws(" ", F.lit("F"), "stream_id", "frame_no", "n").alias("line"))
    rest = detections.select("stream_id", "frame_no", "det_idx", F.concat_ws(" ", "stream_id", "frame_no", "cls", "score", "x", "y", "w", "h").alias("line"))
    return first.unionByName(rest)


def digest(rows: DataFrame) -> DataFrame:
    """SHA-256 per stream over the digests of its frames in order, each over the frame's sorted rounded detections.

    A hash over a stream is sequential; frames are digested anywhere, then come sorted in batches, and a stream's task keeps its hash.
    """
    import hashlib

    line = F.concat_ws(",", "det_idx", "cls", F.round("score", 3).cast("decimal(10,3)"), *[F.round(c, 1).cast("decimal(12,1)") for c in ("x", "y", "w", "h")])
    frame = rows.groupBy("stream_id", "frame_no").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("det_idx", line.alias("l")))), lambda s: s["l"])), 256).alias("d"))

    def machine():
        h, n, stream = hashlib.sha256(), 0, None

        def step(rows):
            nonlocal n, stream
            if rows is None:
                return {"stream_id": [stream], "frames": [n], "digest": [h.hexdigest()]}
            stream = rows["stream_id"][0]
            h.update(("\n" * (n > 0) + "\n".join(rows["d"])).encode())
            n += len(rows["d"])

        return step

    return streamed(frame, "stream_id", ["frame_no"], machine, "stream_id int, frames long, digest string")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a missing in b and rows of b that a lacks, with their multiplicities."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))
