"""Frames, packets and model outputs derived from the star-schema tables by integer arithmetic, so other engines can derive the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("pts_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("stream_id", (F.col("user_id") % 16).cast("int"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "stream_id", "pts_us")
    p = numbered(e, ["stream_id"], "event_id", "seq").withColumn("seq", F.col("seq").cast("long"))
    return p.select("event_id", "stream_id", "seq", "pts_us", F.col("pts_us").alias("arrival_us"), (F.col("seq") % 30 == 1).alias("keyframe"), (F.col("event_id") % 997 + 1000).alias("size"))


def shuffled_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose pts goes back at times, as with B-frames."""
    jump = F.expr("case seq % 3 when 1 then 9000000000 when 2 then -9000000000 else 0 end")
    return packets(spark, sf_dir).withColumn("pts_us", F.when(F.col("seq") % 101 == 0, F.lit(-1)).otherwise(F.col("pts_us") + jump))


def streams(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").cast("int").alias("stream_id"), F.expr("case id % 4 when 0 then null else cast(id % 4 + 1 as int) end").alias("skip"), F.expr("case when id % 8 = 7 then 'key' end").alias("decode"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.expr("element_at(array(1280, 1920, 2560, 3840), stream_id % 4 + 1)"), F.expr("element_at(array(720, 1080, 1440, 2160), stream_id % 4 + 1)")
    return packets(spark, sf_dir).select("event_id", "stream_id", F.col("seq").cast("int").alias("frame_no"), "pts_us", w.alias("width"), h.alias("height"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form, up to 6 a frame, some on the frame's edge."""
    f = frames(spark, sf_dir).withColumn("det_idx", F.explode(F.expr("sequence(0, cast(event_id % 6 as int))")))
    e, k = F.col("event_id"), F.col("det_idx")
    return f.select(
        "event_id", "stream_id", "frame_no", "pts_us", "width", "height", "det_idx",
        ((e * 37 + k * 53) % F.col("width") / 2.0 * 2 - 10.5).alias("x"), ((e * 91 + k * 29) % F.col("height") - 20.5).alias("y"),
        (1 + (e + k * 7) % 160).cast("double").alias("w"), (1 + (e * 3 + k) % 160).cast("double").alias("h"),
        (((e * 13 + k * 17) % 1000) / 1000.0).alias("score"), ((e + k) % 4).cast("int").alias("cls"),
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame with 6 overlapping boxes in an array; every 50th frame has none."""
    # The table is one small file, so one task; suppression is work enough for all.
    e = events(spark, sf_dir).select("event_id", "stream_id").repartition(spark.sparkContext.defaultParallelism, "event_id")
    box = "struct(cast((event_id * 37) % 300 + k * 13 as double) as x, cast((event_id * 91) % 300 + k * 9 as double) as y, cast(100 + (event_id + k * 7) % 160 as double) as w, cast(100 + (event_id * 3 + k) % 160 as double) as h, ((event_id * 13 + k * 17) % 1000) / 1000.0d as score, cast((event_id + k) % 2 as int) as cls)"
    return e.withColumn("dets", F.expr(f"transform(case when event_id % 50 = 0 then cast(array() as array<int>) else sequence(0, 5) end, k -> {box})"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with latencies and batches of 8 in event order."""
    return frames(spark, sf_dir).selectExpr(
        "*", "(event_id % 50) / 1000.0d as ms_pop_to_ready", "(event_id % 700) / 1000.0d as ms_ready_to_take", "event_id div 8 as batch_seq",
        "cast(case when event_id % 16 < 8 then 8 else 7 end as int) as batch_size", "1.5d + ((event_id div 8) % 20) / 10.0d as ms_take_to_done",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, stream_id, text): plates read, some of them empty."""
    return events(spark, sf_dir).selectExpr("event_id as arrival", "stream_id", "case when event_id % 11 = 0 then '' else concat('P', cast((event_id * event_id) % 97 as string)) end as text")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity cells from orders, one a (N, decode, skip) key and version."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "cast(1 + o_custkey % 100 as int) as N", "case when o_orderkey % 2 = 0 then 'all' else 'key30' end as decode", "cast(1 + (o_custkey div 100) % 6 as int) as skip",
        "cast(o_orderkey % 3 as int) as version", "o_orderkey", "cast(o_totalprice * 100 as bigint) as cents",
    )
    g = o.groupBy("version", "N", "decode", "skip").agg(F.min("o_orderkey").alias("id"), F.sum("cents").alias("c"), F.count("*").alias("k"))
    return g.selectExpr(
        "version", "N", "decode", "skip", "id", "(c % 1200) / 10.0d as hold_pct", "(c % 9000) / 10.0d as decoded_per_s", "(c % 97) / 10.0d as gpu_ms",
        "cast(c % 101 as int) as nvdec_pct", "cast((c div 7) % 101 as int) as sm_pct", "(c % 170) / 10.0d as pre_ms", "((c div 3) % 170) / 10.0d as queue_ms",
        "(case when decode = 'all' then 30.0d else 1.0d end) / skip as inf_rate", "cast((c div 11) % 8000 as int) as vram_mb",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 16).cast("int").alias("stream_id"), "embedding", "label")
