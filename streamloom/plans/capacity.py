"""Capacity planning as a projection over configurations (R-01..R-10, G-03), and for one configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import tile_stride

# Measured constants of the model (fixed values).
PIXELS = {"720p": (1280, 720), "1080p": (1920, 1080), "1440p": (2560, 1440), "4k": (3840, 2160)}
BASE_MS = {"720p": 1.94, "1080p": 2.05, "1440p": 2.06, "4k": 2.09}
TILED_MS = {"pooled": (0.305, 0.4963), "serial": (0.998, 0.4900), "key": (3.185, 0.4820)}
DECODE_PIXELS = 42.5 * 30 * 1280 * 720
MEASURED_DECODED = {"720p": 1276.0, "1080p": 787.0, "1440p": 400.0, "4k": 186.0}
DOMINANT = 0.5
SAHI_KEYS = ("tile", "overlap", "full_frame", "serial")


def tile_count(resolution: str, tile: int, overlap: float = 0.2, full_frame: bool = True) -> int:
    def side(n: int) -> int:
        stride = max(1, tile_stride(tile, overlap))
        return 1 if n <= tile else -(-(n - tile) // stride) + 1

    w, h = PIXELS[resolution]
    return side(w) * side(h) + bool(full_frame)


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def recommend_frame(configs: DataFrame) -> DataFrame:
    """configs: streams, resolution, fps, skip, decode, key_gop, tile (null: no tiling), overlap, full_frame, serial. Adds the model's columns; no shuffle."""
    res, key, tiled = F.col("resolution"), F.col("decode") == "key", F.col("tile").isNotNull()
    w, h = _lookup(res, {k: v[0] for k, v in PIXELS.items()}), _lookup(res, {k: v[1] for k, v in PIXELS.items()})
    held = F.least(F.greatest(F.col("overlap"), F.lit(0.0)), F.lit(0.9)).cast("float")
    stride = F.greatest(F.lit(1), (F.col("tile").cast("float") * (F.lit(1.0).cast("float") - held).cast("float")).cast("float").cast("int"))
    side = lambda n: F.when(n <= F.col("tile"), F.lit(1)).otherwise(F.ceil((n - F.col("tile")) / stride) + 1)
    d = (
        configs.withColumn("tiles", F.when(tiled, side(w) * side(h) + F.col("full_frame").cast("int")).cast("long"))
        .withColumn("regime", F.when(key, F.lit("key")).when(F.col("serial"), F.lit("serial")).otherwise(F.lit("pooled")))
        .withColumn("decode_rate", F.when(key, F.col("fps") / F.col("key_gop")).otherwise(F.col("fps").cast("double")))
    )
    a, b = _lookup(F.col("regime"), {k: v[0] for k, v in TILED_MS.items()}), _lookup(F.col("regime"), {k: v[1] for k, v in TILED_MS.items()})
    d = (
        d.withColumn("gpu_ms", F.when(tiled, a + b * F.col("tiles")).otherwise(_lookup(res, BASE_MS)))
        .withColumn("required_nvdec_fps", F.col("streams") * F.col("decode_rate"))
        .withColumn("required_gpu_fps", F.col("streams") * (F.col("decode_rate") / F.col("skip")))
        .withColumn("gpu_capacity_fps", F.lit(1000.0) / F.col("gpu_ms"))
        .withColumn("nvdec_capacity_fps", F.lit(DECODE_PIXELS) / (w * h))
        .withColumn("gpu_ratio", F.col("required_gpu_fps") / F.col("gpu_capacity_fps"))
        .withColumn("nvdec_ratio", F.col("required_nvdec_fps") / F.col("nvdec_capacity_fps"))
    )
    gpu, dec = F.col("gpu_ratio"), F.col("nvdec_ratio")
    holds = (gpu <= 1) & (dec <= 1)
    binding = F.when(F.greatest(gpu, dec) < DOMINANT, F.lit("none")).when(gpu >= dec, F.lit("gpu-inference")).otherwise(F.lit("nvdec"))
    dials = F.concat_ws(
        " / ",
        F.when(gpu > 1, F.concat(F.lit("raise skip to "), F.ceil(F.col("skip") * gpu).cast("string"))),
        F.when((gpu > 1) & ~key, F.lit('use decode="key"')),
        F.when((gpu > 1) & tiled & (F.col("tile") < 1280), F.lit("use tile 1280")),
        F.when(dec > 1, F.concat(F.lit("cut to <= "), F.greatest(F.lit(1), F.floor(F.col("streams") / dec)).cast("string"), F.lit(' streams or use decode="key"'))),
    )
    headroom = (F.lit(1.0) - F.greatest(gpu, dec)) * 100
    return (
        d.withColumn("holds_realtime", holds)
        .withColumn("binding_resource", binding)
        .withColumn("offered_fps", F.col("fps") / F.greatest(F.lit(1.0), gpu, dec))
        .withColumn("gpu_headroom_pct", (1 - gpu) * 100)
        .withColumn("nvdec_headroom_pct", (1 - dec) * 100)
        .withColumn("suggestion", F.when(holds, F.concat(F.lit("holds with "), F.bround(headroom, 0).cast("int").cast("string"), F.lit("% headroom"))).otherwise(F.concat(F.lit("over capacity: "), dials)))
    )


def mixed_fleet(recommended: DataFrame, *by: str) -> DataFrame:
    """Required rates of homogeneous groups added up per fleet, against the least capacity."""
    return recommended.groupBy(*by).agg(
        F.sum("required_gpu_fps").alias("required_gpu_fps"), F.sum("required_nvdec_fps").alias("required_nvdec_fps"),
        F.sum("gpu_ratio").alias("gpu_ratio"), F.sum("nvdec_ratio").alias("nvdec_ratio"),
    ).withColumn("holds_realtime", (F.col("gpu_ratio") <= 1) & (F.col("nvdec_ratio") <= 1))


@dataclass
class Recommendation:
    predicted_gpu_ms_per_frame: float
    offered_fps: float
    required_gpu_fps: float
    gpu_headroom_pct: float
    binding_resource: str
    holds_realtime: bool
    suggestion: str
    required_nvdec_fps: float
    nvdec_capacity_fps: float
    nvdec_headroom_pct: float
    gpu_capacity_fps: float
    notes: list[str] = field(default_factory=list)


def recommend(spark: SparkSession, streams: int, resolution: str = "720p", fps: float = 30, skip: int = 1, decode: str = "all", key_gop: int = 30, sahi: dict | None = None) -> Recommendation:
    """One configuration, through the same projection."""
    if resolution not in PIXELS:
        raise ValueError(f"unknown resolution {resolution!r}; one of {sorted(PIXELS)}")
    if decode not in ("all", "key"):
        raise ValueError(f"decode must be 'all' or 'key', not {decode!r}")
    if streams < 1 or skip < 1:
        raise ValueError("streams and skip must be at least 1")
    notes = ["The constants were measured on one GPU model; another one needs measurements of its own."]
    if sahi is not None:
        if unknown := sorted(set(sahi) - set(SAHI_KEYS)):
            raise ValueError(f"unknown sahi keys {unknown}; valid are {sorted(SAHI_KEYS)}")
        if "tile" not in sahi:
            raise ValueError("sahi needs a tile size")
        notes.append(f"{tile_count(resolution, int(sahi['tile']), float(sahi.get('overlap', 0.2)), bool(sahi.get('full_frame', True)))} tiles a frame")
    if resolution != "720p":
        notes.append(f"the decode ceiling is scaled by pixels from 720p; {MEASURED_DECODED[resolution]:.0f} a second were measured")
    s = sahi or {}
    row = (streams, resolution, float(fps), skip, decode, key_gop, int(s["tile"]) if s else None, float(s.get("overlap", 0.2)), bool(s.get("full_frame", True)), bool(s.get("serial", False)))
    r = recommend_frame(spark.createDataFrame([row], CONFIG)).first()
    return Recommendation(r.gpu_ms, r.offered_fps, r.required_gpu_fps, r.gpu_headroom_pct, r.binding_resource, r.holds_realtime, r.suggestion, r.required_nvdec_fps, r.nvdec_capacity_fps, r.nvdec_headroom_pct, r.gpu_capacity_fps, notes)


CONFIG = "streams int, resolution string, fps double, skip int, decode string, key_gop int, tile int, overlap double, full_frame boolean, serial boolean"
