"""Sampling of packet streams. Order is always that of seq, never of pts.

F-01 F-02 F-03 S-07 S-09 J-03 T-13: a stream's packets are numbered once for all rules, in two levels (`ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE, carried, inside, numbered, over_ranges


def with_overrides(packets: DataFrame, streams: DataFrame, skip: int = 1, decode: str = "all") -> DataFrame:
    """Adds `skip` and `decode` of each packet's stream; a null override inherits the pipeline's value. streams is a declared list, so it is broadcast."""
    if skip < 1:
        raise ValueError("skip must be at least 1")
    if decode not in ("all", "key"):
        raise ValueError("decode must be 'all' or 'key'")
    s = streams.select(F.col("stream_id").alias("_s"), F.coalesce("skip", F.lit(skip)).alias("skip"), F.coalesce("decode", F.lit(decode)).alias("decode"))
    return packets.join(F.broadcast(s), packets.stream_id == F.col("_s")).drop("_s")


def decoded(packets: DataFrame, key_only: Column | bool = False) -> DataFrame:
    """Packets that are decoded, with frame_no: the 1-based count per stream. Key-only streams drop other packets before the count.

    Ranges of seq are counted first, so a stream's packets are numbered by many tasks.
    """
    only = key_only if isinstance(key_only, Column) else F.lit(key_only)
    return numbered(packets.where(~only | F.col("keyframe")), ["stream_id"], "seq", "frame_no").withColumn("frame_no", F.col("frame_no").cast("int"))


def skip_sample(frames: DataFrame, skip: Column | int) -> DataFrame:
    """Every skip-th frame of a stream, the phase set off by stream_id."""
    if isinstance(skip, int) and skip < 1:
        raise ValueError("skip must be at least 1")
    k = skip if isinstance(skip, Column) else F.lit(skip)
    return frames.where((F.col("frame_no") + F.col("stream_id")) % k == 0)


def max_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first n decoded frames of each stream; 0 is no bound."""
    return frames if n == 0 else frames.where(F.col("frame_no") <= n)


def sampled(packets: DataFrame, streams: DataFrame, skip: int = 1, decode: str = "all", limit: int = 0) -> DataFrame:
    """All rules in their order: overrides, key filter, count, bound, skip."""
    frames = decoded(with_overrides(packets, streams, skip, decode), F.col("decode") == "key")
    return skip_sample(max_frames(frames, limit), F.col("skip"))


def micro_batches(frames: DataFrame, max_batch: int, span_us: int = 60_000_000) -> DataFrame:
    """Adds batch_seq and batch_size: frames in order of arrival, max_batch at a time, the last batch with what is left.

    All frames are ready, so a batch that takes what is ready is full. Frames are counted in ranges of arrival time first.
    """
    d = frames.withColumn(RANGE, F.floor(F.col("arrival_us") / F.lit(span_us)).cast("long"))
    before = [F.coalesce(F.sum("_n").over(over_ranges([])), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all")]
    d = carried(d, [], {"_n": F.count("*")}, lambda _: before)
    nth = F.col("_before") + F.row_number().over(inside([], "arrival_us", "stream_id", "frame_no")) - 1
    d = d.withColumn("_nth", nth).withColumn("batch_seq", F.floor(F.col("_nth") / max_batch).cast("int"))
    return d.withColumn("batch_size", F.least(F.lit(max_batch), F.col("_all") - F.col("batch_seq") * max_batch).cast("int")).drop(RANGE, "_before", "_all", "_nth")
