"""Latency, throughput and counters over result rows (A-05..A-12 A-18 A-21 A-24 A-25 A-27..A-30 W-01 W-02 P-19 P-20 P-30 F-12 J-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..materialise import cut
from .ordered import RANGE, SPAN, previous, upper_medians


def upper_median(values: str) -> Column:
    """The upper-middle element of a group's values, sorted[n // 2], as the lower median of the descending order.

    Partial maps of counts by value are merged, so it is for values of few kinds (percentages); `ordered.upper_medians` takes any integers.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {values} DESC)")


def end_to_end() -> Column:
    return F.col("ms_pop_to_ready") + F.col("ms_ready_to_take") + F.col("ms_take_to_done")


def per_stream(results: DataFrame) -> DataFrame:
    return results.groupBy("stream_id").agg(F.count("*").alias("inferred"), F.avg(end_to_end()).alias("mean_ms"))


def pts_deltas(packets: DataFrame, span: int = SPAN) -> DataFrame:
    """Valid packets (pts >= 0) with the step from the valid one before them in the stream."""
    p = previous(packets.where("pts_us >= 0"), ["stream_id"], "seq", F.col("pts_us"), "_prior", span)
    return p.withColumn("delta", F.col("pts_us") - F.col("_prior")).drop("_prior", RANGE)


def pts_gaps(packets: DataFrame, span: int = SPAN) -> DataFrame:
    """Per stream how often the pts does not increase, and the upper median of its positive steps. Steps are counted once, then only counts are read."""
    counts = cut(pts_deltas(packets, span).groupBy("stream_id", "delta").agg(F.count("*").alias("n")))
    back = counts.groupBy("stream_id").agg(F.coalesce(F.sum(F.when(F.col("delta") <= 0, F.col("n"))), F.lit(0)).alias("non_monotonic"))
    return back.join(upper_medians(counts.where("delta > 0"), ["stream_id"], "delta", "median_delta", "n"), "stream_id", "left")


def batches(results: DataFrame) -> DataFrame:
    """One row a batch: the batch's GPU time is on each of its rows."""
    return results.groupBy("batch_seq").agg(F.max("batch_size").alias("batch_size"), F.max("ms_take_to_done").alias("gpu_ms"))


def batch_histogram(results: DataFrame) -> DataFrame:
    return batches(results).groupBy("batch_size").agg(F.count("*").alias("batches"))


def split(results: DataFrame) -> DataFrame:
    """Means: waiting per frame, GPU per batch."""
    frames = results.agg(F.avg("ms_pop_to_ready").alias("pre_ms"), F.avg("ms_ready_to_take").alias("queue_ms"))
    return frames.crossJoin(batches(results).agg(F.avg("gpu_ms").alias("gpu_ms")))  # two rows of one


def warmed(results: DataFrame, first: int = 60) -> DataFrame:
    return results.where(F.col("frame_no") >= first)


def warmed_by_time(results: DataFrame, seconds: float = 12.0, at: str = "pts_us") -> DataFrame:
    """Rows of `seconds` or more after the first one of all: one aggregate row, which is broadcast."""
    first = results.agg(F.min(at).alias("_first"))
    return results.join(F.broadcast(first)).where(F.col(at) >= F.col("_first") + int(seconds * 1_000_000)).drop("_first")


def medians(results: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Interpolated medians of columns (name: column) per key, and over all rows with key null. One pass over both groupings."""
    per = results.rollup(key).agg(F.count("*").alias("n"), *[F.median(c).alias(n) for n, c in columns.items()], F.grouping(key).alias("_all"))
    return per.select(key, (F.col("_all") == 1).alias("pooled"), "n", *columns)


def verify_ratio(verified: DataFrame) -> DataFrame:
    """Frames verified, those that passed and their share. verified: rows with verify_ok."""
    v = verified.agg(F.count("verify_ok").alias("verified"), F.count_if("verify_ok").alias("passed"))
    return v.withColumn("share", F.when(F.col("verified") > 0, F.col("passed") / F.col("verified")))


def plates(texts: DataFrame, frame: list[str]) -> DataFrame:
    """Texts read that are not empty, in all and per frame that has any row."""
    per = texts.groupBy(*frame).agg(F.count_if(F.col("text") != "").alias("n"))
    return per.agg(F.sum("n").alias("plates"), F.count("*").alias("frames"), F.avg("n").alias("per_frame"), F.max("n").alias("most"))


def child_gpu_means(results: DataFrame) -> DataFrame:
    """Mean GPU milliseconds of each child over the frames. results: rows with children array<struct<name, ms_gpu>>."""
    c = results.select(F.posexplode("children").alias("layer", "c"))
    return c.groupBy("layer", F.col("c.name").alias("name")).agg(F.count("*").alias("frames"), F.avg("c.ms_gpu").alias("ms_gpu"))


def top_counts(detections: DataFrame, frames: DataFrame, frame: list[str], k: int = 5) -> DataFrame:
    """The k most frequent numbers of detections in a frame, frames without any included; the smaller number first among equals."""
    per = frames.select(*frame).join(detections.groupBy(*frame).agg(F.count("*").alias("n")), frame, "left").select(F.coalesce("n", F.lit(0)).alias("detections"))
    return per.groupBy("detections").agg(F.count("*").alias("frames")).orderBy(F.desc("frames"), "detections").limit(k)


def aggregate_rates(results: DataFrame) -> DataFrame:
    """Rates of the streams added up, and their waiting and GPU times averaged over streams (not rows)."""
    seconds = (F.max("pts_us") - F.min("pts_us")) / 1e6
    per = results.groupBy("stream_id").agg(
        F.when(seconds > 0, F.count("*") / seconds).alias("per_s"), F.avg("ms_pop_to_ready").alias("pre"), F.avg("ms_ready_to_take").alias("queue"), F.avg("ms_take_to_done").alias("gpu")
    )
    return per.agg(F.count("*").alias("streams"), F.sum("per_s").alias("per_s"), *[F.avg(c).alias(f"{c}_ms") for c in ("pre", "queue", "gpu")])


def routed(child: DataFrame, family: str) -> DataFrame:
    """Rows that a child has an answer for, told by the answer: a text or vector that is not empty, a score that is not 0."""
    test = {"ctc": lambda: F.col("text") != "", "embedding": lambda: F.size("vector") > 0, "argmax": lambda: F.col("score") != 0}
    return child.where(test[family]())


def run_counters(status: DataFrame) -> DataFrame:
    """Counters over all sources: (decoded, reconnects, failed, dropped). status: a row a stream."""
    return status.agg(F.sum("decoded").alias("decoded"), F.sum("reconnects").alias("reconnects"), F.count_if("failed").alias("failed"), F.sum("dropped").alias("dropped"))


def first_mode(rows: DataFrame, key: str, value: str, arrival: str) -> DataFrame:
    """A key's most frequent value, the first seen among equals."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(arrival).alias("first_seen"))
    best = c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "first_seen", value)).alias("m"))
    return best.select(key, F.col(f"m.{value}").alias(value), (-F.col("m.neg")).alias("n"))


def verify(expected: DataFrame, actual: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per (stream_id, frame_no): whether both sides have the same detections in the same places: class and score equal, boxes within tolerance."""
    keys = ["stream_id", "frame_no", "rank"]
    a = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in ("x", "y", "w", "h", "score", "cls")], F.lit(1).alias("e"))
    b = actual.select(*keys, "x", "y", "w", "h", "score", "cls", F.lit(1).alias("a"))
    same = (F.col("cls") == F.col("e_cls")) & (F.col("score") == F.col("e_score"))
    for c in ("x", "y", "w", "h"):
        same = same & (F.abs(F.col(c) - F.col(f"e_{c}")) < tolerance)
    j = a.join(b, keys, "full")
    return j.groupBy("stream_id", "frame_no").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("verify_ok"), F.sum("e").alias("reference_dets"))
