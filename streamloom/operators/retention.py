"""Packet retention, clips, relay clocks and bounded queues (W-08..W-10 W-12 K-06..K-08 T-05 T-06 J-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE, SPAN, inside, over_ranges, ranged, streamed


def _from_anchor(packets: DataFrame, anchor: DataFrame) -> DataFrame:
    """anchor has a row a stream, so the planner broadcasts it where its measured size allows."""
    return packets.join(anchor, "stream_id")


def retained(packets: DataFrame, seconds: int) -> DataFrame:
    """The ring of each stream: from the last keyframe whose arrival is at or before (newest arrival - seconds); without one, all.

    Two aggregates of a row a stream, the second over keyframes only, and a join back: no ordering of packets is needed.
    """
    newest = packets.groupBy("stream_id").agg(F.max("arrival_us").alias("newest"))
    aged = newest.join(packets.where("keyframe").select(F.col("stream_id").alias("_s"), F.col("seq").alias("_q"), F.col("arrival_us").alias("_a")), F.col("stream_id") == F.col("_s"), "left")
    anchor = aged.groupBy("stream_id").agg(F.max(F.when(F.col("_a") <= F.col("newest") - seconds * 1_000_000, F.col("_q"))).alias("anchor"))
    return _from_anchor(packets, anchor).where(F.col("anchor").isNull() | (F.col("seq") >= F.col("anchor"))).drop("anchor")


def clip(packets: DataFrame, seconds_back: float) -> DataFrame:
    """Packets of each stream's clip. The newest pts is that of the last packet by seq. The clip starts at the last keyframe with
    0 <= pts <= newest - seconds_back, else at the first keyframe; streams without a keyframe give nothing."""
    newest = packets.groupBy("stream_id").agg(F.max_by("pts_us", "seq").alias("newest_pts"))
    keys = packets.where("keyframe").select("stream_id", "seq", "pts_us").join(newest, "stream_id")
    in_time = (F.col("pts_us") >= 0) & (F.col("pts_us") <= F.col("newest_pts") - int(seconds_back * 1_000_000))
    anchor = keys.groupBy("stream_id").agg(F.coalesce(F.max(F.when(in_time, F.col("seq"))), F.min("seq")).alias("anchor"))
    return _from_anchor(packets, anchor).where(F.col("seq") >= F.col("anchor")).drop("anchor")


def since_seq(packets: DataFrame, seq: int) -> DataFrame:
    """Exclusive; 0 is all."""
    return packets.where(F.col("seq") > seq)


def since_pts(packets: DataFrame, pts_us: int) -> DataFrame:
    """Exclusive; below 0 is all."""
    return packets if pts_us < 0 else packets.where(F.col("pts_us") > pts_us)


def relayed(packets: DataFrame, first_delta: int = 33_000, span: int = SPAN) -> DataFrame:
    """(stream_id, seq, pts_us, out_pts_us): the relay clock, which follows the pts and, where that does not increase, goes on by its last step.

    Each step of the clock is the pts' own step where that is positive, else the last such step (first_delta before any), so
    the clock is a running sum of a running last value. A range of packets is summed up by its first and last pts, its
    last positive step, the sum of the steps from its first positive one on, and how many rows come before that.
    The clock starts at the stream's first pts of 0 or more; packets before it keep their pts.
    """
    key = ["stream_id"]
    p = packets.select("stream_id", "seq", "pts_us")
    start = p.where("pts_us >= 0").groupBy("stream_id").agg(F.min("seq").alias("_start"))
    p = p.join(start, "stream_id", "left")
    early = p.where("_start is null or seq < _start").select("stream_id", "seq", "pts_us", F.col("pts_us").alias("out_pts_us"))
    w = inside(key, "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = ranged(p.where("seq >= _start"), "seq", span).withColumn("_raw", F.col("pts_us") - F.lag("pts_us").over(w))
    d = d.withColumn("_step", F.last(F.when(F.col("_raw") > 0, F.col("_raw")), ignorenulls=True).over(so_far))
    sums = {
        "_p0": F.min_by("pts_us", "seq"), "_p1": F.max_by("pts_us", "seq"), "_step1": F.max_by("_step", "seq"),
        "_later": F.coalesce(F.sum("_step"), F.lit(0)), "_lead": F.count_if(F.col("_step").isNull()),
    }

    def folded(per: DataFrame) -> DataFrame:
        before, at = over_ranges(key), Window.partitionBy(*key).orderBy(RANGE)
        jump = F.col("_p0") - F.lag("_p1").over(at)
        x = per.withColumn("_first", F.lag("_p1").over(at).isNull()).withColumn("_own", F.when(jump > 0, jump))
        x = x.withColumn("_known", F.coalesce("_step1", "_own")).withColumn("_held", F.coalesce(F.last("_known", ignorenulls=True).over(before), F.lit(first_delta)))
        x = x.withColumn("_lead_step", F.coalesce("_own", "_held"))
        # The stream's first packet makes no step.
        x = x.withColumn("_total", (F.col("_lead") - F.col("_first").cast("int")) * F.col("_lead_step") + F.col("_later"))
        base = F.first("_p0").over(Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, 0))
        return x.select(*key, RANGE, "_first", "_lead_step", (base + F.coalesce(F.sum("_total").over(before), F.lit(0))).alias("_base"))

    per = d.groupBy(*key, RANGE).agg(*[c.alias(n) for n, c in sums.items()])
    x = d.join(folded(per), [*key, RANGE])
    first = F.col("_first") & F.lag("seq").over(w).isNull()
    step = F.when(first, F.lit(0)).otherwise(F.coalesce("_step", "_lead_step"))
    x = x.withColumn("_move", step).withColumn("out_pts_us", (F.col("_base") + F.sum("_move").over(so_far)).cast("long"))
    return x.select("stream_id", "seq", "pts_us", "out_pts_us").unionByName(early)


def loop_epochs(packets: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds epoch: how often the pts has not increased before this packet of the stream."""
    key = ["stream_id"]
    w = inside(key, "seq")
    d = ranged(packets, "seq", span).withColumn("_wrap", F.coalesce((F.col("pts_us") <= F.lag("pts_us").over(w)).cast("long"), F.lit(0)))
    per = d.groupBy(*key, RANGE).agg(F.min_by("pts_us", "seq").alias("_p0"), F.max_by("pts_us", "seq").alias("_p1"), F.sum("_wrap").alias("_n"))
    # A range's first packet may wrap against the last one of the range before.
    per = per.withColumn("_into", F.coalesce((F.col("_p0") <= F.lag("_p1").over(Window.partitionBy(*key).orderBy(RANGE))).cast("long"), F.lit(0)))
    per = per.select(*key, RANGE, (F.col("_into") + F.coalesce(F.sum(F.col("_n") + F.col("_into")).over(over_ranges(key)), F.lit(0))).alias("_base"))
    return d.join(per, [*key, RANGE]).withColumn("epoch", F.col("_base") + F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_wrap", "_base", RANGE)


def queue_tail(lines: DataFrame, capacity: int = 1024) -> tuple[DataFrame, DataFrame]:
    """A sink's bounded queue after all lines came: what is left per sink, and how many were evicted."""
    nth = F.row_number().over(Window.partitionBy("sink").orderBy(F.col("arrival").desc()))
    left = lines.withColumn("_n", nth).where(F.col("_n") <= capacity).drop("_n")
    dropped = lines.groupBy("sink").agg(F.greatest(F.count("*") - capacity, F.lit(0)).cast("long").alias("dropped"))
    return left, dropped


def drop_oldest(arrivals: DataFrame, polls: DataFrame, capacity: int = 256) -> DataFrame:
    """Which rows of a bounded queue that evicts its oldest reach the consumer: (queue, item, poll); poll is null where the item was evicted and -1
    where it was still held at the end.

    arrivals: (queue, item, at); polls: (queue, at). At one time arrivals come before polls. Sequential per queue, so a queue is
    one task; rows come sorted in batches and what is kept is the queue of at most `capacity` items.
    """
    from collections import deque

    def machine():
        held: deque = deque()
        queue = None

        def step(rows):
            nonlocal queue
            items, out = [], []
            if rows is None:
                items, out = list(held), [-1] * len(held)
                return {"queue": [queue] * len(items), "item": items, "poll": out}
            queue = rows["queue"][0]
            for poll, item, at in zip(rows["is_poll"], rows["item"], rows["at"], strict=True):
                if poll:
                    if held:
                        items.append(held.popleft())
                        out.append(at)
                else:
                    if len(held) >= capacity:
                        items.append(held.popleft())
                        out.append(None)
                    held.append(item)
            return {"queue": [queue] * len(items), "item": items, "poll": out}

        return step

    both = arrivals.select("queue", "item", "at", F.lit(False).alias("is_poll")).unionByName(polls.select("queue", F.lit(-1).cast("long").alias("item"), "at", F.lit(True).alias("is_poll")))
    return streamed(both, "queue", ["at", "is_poll", "item"], machine, "queue int, item long, poll long")


def stamp_join(frames: DataFrame, stamps: DataFrame, within: int = 64) -> DataFrame:
    """Frames with the demux stamp of equal pts among the stream's last `within` packets before them; the latest if there are several."""
    j = frames.join(stamps.select("stream_id", "pts_us", F.col("seq").alias("stamp_seq"), "arrival_us"), ["stream_id", "pts_us"]).where((F.col("stamp_seq") <= F.col("seq")) & (F.col("stamp_seq") > F.col("seq") - within))
    return j.groupBy("stream_id", "seq").agg(F.max("stamp_seq").alias("stamp_seq"), F.max_by("arrival_us", "stamp_seq").alias("arrival_us"))
