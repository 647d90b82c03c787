"""Readers (S-04 S-05 S-11..S-16 F-19 J-17 U-06 P-28 P-29 K-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered

CELLS = "N int, decode string, gop int, inf_per_s_per_stream double, skip int, decoded_per_s double, offered_per_s double, hold_pct double, pre_ms double, queue_ms double, gpu_ms double, total_ms double, nvdec_pct int, sm_pct int, vram_mb int, plates int, bottleneck string"


def pts_micros(pts: Column, dts: Column, num: int, den: int) -> Column:
    """pts, else dts, in microseconds; null where both are unknown."""
    return F.floor(F.coalesce(pts, dts) * (num * 1_000_000) / F.lit(den)).cast("long")


def is_keyframe(flags: Column) -> Column:
    return flags.bitwiseAND(1) != 0


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of capacity cells; numbers that do not parse are 0."""
    raw = spark.read.csv(path, header=True)
    kinds = dict(x.split() for x in CELLS.split(", "))
    return raw.select(*[(F.col(c) if kinds.get(c, "string") == "string" else F.coalesce(F.expr(f"try_cast(`{c}` as {kinds[c]})"), F.lit(0).cast(kinds[c]))).alias(c) for c in raw.columns])


def latency_frames(lines: DataFrame) -> DataFrame:
    """Lines (no, value) of a latency log to one row a frame: source, frame_num, frame_ms and the map of component latencies of the lines before it.

    Component lines belong to the next frame line: a running count of frame lines is the group.
    """
    comp = r"Comp name = (\S+).*component_latency= ([0-9.]+)"
    frame = r"Source id = (\d+) Frame_num = (\d+) Frame latency = ([0-9.]+)"
    x = lines.withColumn("is_frame", F.col("value").rlike(frame)).withColumn("is_comp", F.col("value").rlike(comp)).where("is_frame or is_comp")
    before = Window.partitionBy("log").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    g = x.withColumn("g", F.coalesce(F.sum(F.col("is_frame").cast("int")).over(before), F.lit(0)))
    part = lambda p, i: F.regexp_extract("value", p, i)
    return (
        g.groupBy("log", "g")
        .agg(
            F.max(F.when(F.col("is_frame"), part(frame, 1).cast("int"))).alias("source"),
            F.max(F.when(F.col("is_frame"), part(frame, 2).cast("int"))).alias("frame_num"),
            F.max(F.when(F.col("is_frame"), part(frame, 3).cast("double"))).alias("frame_ms"),
            F.sort_array(F.collect_list(F.when(F.col("is_comp"), F.struct(part(comp, 1).alias("name"), part(comp, 2).cast("double").alias("ms"))))).alias("components"),
        )
        .where("frame_num is not null")
    )


def key_values(lines: DataFrame) -> DataFrame:
    """Lines (no, value) "key value ..." to (key, value): short lines are passed over, the last one of a key wins."""
    f = lines.withColumn("p", F.split(F.trim("value"), r"\s+")).where(F.size("p") >= 2)
    return f.groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], "no").alias("value"))


def read_manifest(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A JSON array of cameras in its order; the first n."""
    raw = spark.read.text(path, wholetext=True)
    item = "struct<scenario:string,cam:string,file:string,fps:double,gop:int,frames:int,offset_s:double,slug:string,rtsp_path:string,name:string>"
    rows = raw.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("idx", "c")).select("idx", "c.*").withColumn("gop", F.coalesce("gop", F.lit(30)))
    return rows.where(F.col("idx") < n) if n is not None else rows


def mean_gop(manifest: DataFrame) -> DataFrame:
    """Halves go to the even number."""
    return manifest.agg(F.bround(F.avg(F.coalesce("gop", F.lit(30))), 0).cast("int").alias("gop"))


def frame_rate(text: Column) -> Column:
    """"num/den" to three places (a denominator of 0 counts as 1), else a number, else 0."""
    p = F.split(text, "/")
    num, den = F.expr("1") * p[0].try_cast("double"), p[1].try_cast("double")
    ratio = F.round(num / F.when(den == 0, F.lit(1.0)).otherwise(den), 3)
    return F.coalesce(F.when(F.size(p) == 2, ratio).when(F.size(p) == 1, num), F.lit(0.0))


def replicate(source: DataFrame, n: int) -> DataFrame:
    """The source n times, as streams 0 to n - 1."""
    return source.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def fleet(source: DataFrame, n: int, stagger_us: int = 0, order: str = "seq") -> DataFrame:
    """One clip as n streams: stream k begins k * stagger_us into the clip and goes round. source: (seq, pts_us, arrival_us, ...) of one clip.

    The clip's length is one aggregate row, which is broadcast; each stream's seq counts from 1 again by its own order.
    """
    span = source.agg((F.max("pts_us") - F.min("pts_us") + 1).alias("_span"), F.min("pts_us").alias("_first"))
    copies = source.join(F.broadcast(span)).withColumn("stream_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.pmod(F.col("pts_us") - F.col("_first") - F.col("stream_id") * F.lit(stagger_us), F.col("_span"))
    moved = copies.withColumn("_place", at)
    moved = moved.withColumn("arrival_us", F.col("_first") + F.col("_place")).withColumn("pts_us", F.col("_first") + F.col("_place"))
    return numbered(moved, ["stream_id"], "_place", order, span=1 << 32).drop("_place", "_span", "_first")


def manifest_lines(manifest: DataFrame, scenarios: list[str] | None = None) -> DataFrame:
    """slug, rtsp_path and file joined by tabs, of all rows or of some scenarios whatever their case."""
    rows = manifest if scenarios is None else manifest.where(F.upper("scenario").isin([s.upper() for s in scenarios]))
    return rows.select(F.concat_ws("\t", "slug", "rtsp_path", "file").alias("line"))


def engine_file(model: str, max_batch: int, fp16: bool, arch: str) -> str:
    """Name under which an engine built from a model file is kept."""
    return f"{model.removesuffix('.onnx')}_b1-{max_batch}_{'fp16' if fp16 else 'fp32'}_{arch}.engine"


def upsert(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Rows of new, and those of old whose key is not in new."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def stale(sources: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Sources to convert again: without output, newer than it, or with another keyframe interval."""
    o = outputs.select("slug", F.col("mtime").alias("out_mtime"), F.col("gop").alias("out_gop"))
    j = sources.join(o, "slug", "left")
    if force:
        return j
    return j.where(F.col("out_mtime").isNull() | (F.col("mtime") >= F.col("out_mtime")) | (F.col("gop") != F.col("out_gop")))
