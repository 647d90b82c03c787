"""Capacity cells: their grid, their analysis and their files (A-13..A-17 A-19 A-20 J-08..J-11 J-16 P-24 P-25 F-13..F-15 G-06 O-04 O-06 U-02 K-13).

cells: N, decode, skip, hold_pct, decoded_per_s, gpu_ms, nvdec_pct, sm_pct, pre_ms, queue_ms, inf_rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLDS = 95.0
KEY = ["N", "decode", "skip"]


def bottleneck(hold="hold_pct", nvdec="nvdec_pct", sm="sm_pct", pre="pre_ms", queue="queue_ms", note: Column | None = None) -> Column:
    hold, nvdec, sm, pre, queue = (F.col(c) for c in (hold, nvdec, sm, pre, queue))
    ladder = (
        F.when(hold >= HOLDS, F.lit("none(offered-bound)"))
        .when(nvdec >= 80, F.lit("NVDEC"))
        .when(sm >= 80, F.lit("GPU-compute"))
        .when((pre >= 8) & (pre > queue), F.lit("producer-threads"))
        .when(queue >= 8, F.lit("batch-queue"))
        .otherwise(F.lit("mixed/ramp"))
    )
    return ladder if note is None else F.when(note.rlike("(?i)out of memory|oom"), F.lit("VRAM-OOM")).otherwise(ladder)


def census(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("bottleneck").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def max_n_holding(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("hold_pct") >= HOLDS).groupBy("decode", "skip", "inf_rate").agg(F.max("N").alias("max_n"))


def ols(cells: DataFrame) -> DataFrame:
    """gpu_ms = a + b * N * inf_rate over cells that nearly hold; none with 5 points or fewer. One pass of sums."""
    x = F.col("N") * F.col("inf_rate")
    s = cells.where("hold_pct >= 90 and gpu_ms > 0").agg(
        F.count("*").alias("n"), F.regr_slope(F.col("gpu_ms"), x).alias("b"), F.regr_intercept(F.col("gpu_ms"), x).alias("a"),
        F.regr_syy(F.col("gpu_ms"), x).alias("syy"), F.regr_sxy(F.col("gpu_ms"), x).alias("sxy"),
    ).where("n > 5")
    return s.select("n", "a", "b", F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.col("n")).alias("rms"))


def peak_decode(cells: DataFrame, order: str) -> DataFrame:
    """Per decode mode the highest decode rate with its NVDEC load; the first row among equals."""
    best = cells.where("decoded_per_s > 0").groupBy("decode").agg(F.min(F.struct((-F.col("decoded_per_s")).alias("neg"), F.col(order), "nvdec_pct")).alias("m"))
    return best.select("decode", (-F.col("m.neg")).alias("decoded_per_s"), F.col("m.nvdec_pct").alias("nvdec_pct"))


def ceiling(cells: DataFrame, *by: str) -> DataFrame:
    """Per group: the highest N that holds, the latency there, and the next tested N; (0, null, the smallest N) if none holds."""
    holds = F.col("hold_pct") >= HOLDS
    held = cells.groupBy(*by).agg(F.max(F.when(holds, F.struct("N", "gpu_ms"))).alias("m"), F.collect_set("N").alias("grid"))
    top = F.coalesce(F.col("m.N"), F.lit(0))
    return held.select(*by, top.alias("max_n"), F.col("m.gpu_ms").alias("gpu_ms"), F.array_min(F.filter("grid", lambda n: n > top)).alias("next_n"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of both versions with gained or lost."""
    j = new.join(old.select(*KEY, F.col("hold_pct").alias("old_hold")), KEY)
    return j.select(*KEY, "old_hold", F.col("hold_pct").alias("new_hold"), ((F.col("old_hold") < HOLDS) & (F.col("hold_pct") >= HOLDS)).alias("gained"), ((F.col("old_hold") >= HOLDS) & (F.col("hold_pct") < HOLDS)).alias("lost"))


def todo(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of a grid that are not measured yet, without those of less than 0.045 inferences a second."""
    return grid.where("inf_rate >= 0.045").join(done.select(KEY), KEY, "left_anti")


def same_rate(cells: DataFrame) -> DataFrame:
    """Groups of cells with one N and one inference rate by different settings."""
    return cells.groupBy("N", F.round("inf_rate", 3).alias("rate")).agg(F.count("*").alias("settings"), F.max("hold_pct").alias("best_hold")).where("settings >= 2")


#: Decode settings: decoded frames a second at 30 frames a second, and keyframe interval; skips and numbers of streams of the full grid; and
#: of the short grid per resolution and decode setting (fixed values).
DECODE_RATES = {"all": 30.0, "key15": 2.0, "key30": 1.0, "key60": 0.5, "key150": 0.2}
DECODE_GOPS = {"all": 30, "key15": 15, "key30": 30, "key60": 60, "key150": 150}
FULL_N, FULL_SKIPS = (1, 4, 8, 16, 32, 50, 75, 100), (1, 2, 3, 4, 6, 8, 12, 15, 24, 30, 45, 60, 90, 150)
MINI_SKIPS = (1, 2, 3, 6, 15)
MINI_N = {
    "720p": {"all": (1, 8, 16, 32, 50, 75), "key30": (32, 50, 75, 100), "key150": (100,)},
    "1080p": {"all": (1, 8, 16, 32, 50), "key30": (32, 50, 75, 100), "key150": (100,)},
    "1440p": {"all": (1, 8, 16, 32), "key30": (32, 50, 75), "key150": (100,)},
    "4k": {"all": (1, 4, 8, 16), "key30": (16, 32), "key150": (32,)},
}
LEAST_RATE = 0.045
#: Numbers of streams whose groups of equal rates are shown (fixed values).
SHOWN_N = (32, 50, 75, 100)


def _of(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def with_rates(cells: DataFrame) -> DataFrame:
    """Adds gop, inf_rate (decoded rate over skip, four places) and offered_per_s of (N, decode, skip)."""
    rate = _of(DECODE_RATES)[F.col("decode")]
    return cells.withColumn("gop", _of(DECODE_GOPS)[F.col("decode")]).withColumn("inf_rate", F.round(rate / F.col("skip"), 4)).withColumn("offered_per_s", F.round(rate * F.col("N"), 1))


def hold_pct(decoded: Column, offered: Column) -> Column:
    """Decoded as a percentage of offered, one place; 0 where nothing is offered."""
    return F.when(offered > 0, F.round(100 * decoded / offered, 1)).otherwise(F.lit(0.0))


def grid(spark, mode: str = "full", resolution: str = "720p") -> DataFrame:
    """(N, decode, skip, gop, inf_rate, offered_per_s) of a capacity run: full, mini or smoke.

    Cells with less than LEAST_RATE inferences a second are left out; in the mini grid one camera, and decoding of keyframes, only go with skip 1.
    """
    if mode == "smoke":
        numbers, skips = {"all": (8,)}, (1,)
    elif mode == "mini":
        if resolution not in MINI_N:
            raise ValueError(f"unknown resolution {resolution!r}; one of {sorted(MINI_N)}")
        numbers, skips = MINI_N[resolution], MINI_SKIPS
    elif mode == "full":
        numbers, skips = dict.fromkeys(DECODE_RATES, FULL_N), FULL_SKIPS
    else:
        raise ValueError(f"mode must be 'full', 'mini' or 'smoke', not {mode!r}")
    decodes = spark.createDataFrame([(d, list(n)) for d, n in numbers.items()], "decode string, ns array<int>")
    cells = decodes.select(F.explode("ns").alias("N"), "decode").withColumn("skip", F.explode(F.array(*[F.lit(k) for k in skips])))
    cells = with_rates(cells).where(F.col("inf_rate") >= LEAST_RATE)
    if mode == "mini":
        cells = cells.where((F.col("skip") == 1) | ((F.col("N") != 1) & (F.col("decode") == "all")))
    return cells


def in_order(cells: DataFrame) -> DataFrame:
    """Cells by decode setting, then N and skip as numbers, whatever type their columns have."""
    return cells.orderBy("decode", F.col("N").cast("int"), F.col("skip").cast("int"))


def shown_groups(cells: DataFrame, limit: int = 20) -> DataFrame:
    """Groups of cells with one N and inference rate, of SHOWN_N, by N and falling rate; the first `limit`, with the settings by falling decode rate."""
    g = cells.where(F.col("N").isin(*SHOWN_N)).groupBy("N", F.round("inf_rate", 3).alias("rate"))
    setting = F.struct((-F.col("decoded_per_s")).alias("s"), "decode", "nvdec_pct", "hold_pct")
    rows = g.agg(F.count("*").alias("settings"), F.array_sort(F.collect_list(setting)).alias("of")).where("settings >= 2").orderBy("N", F.desc("rate")).limit(limit)
    text = F.transform("of", lambda c: F.concat(c["decode"], F.lit("(nvdec "), c["nvdec_pct"], F.lit("%, hold "), c["hold_pct"], F.lit("%)")))
    return rows.select("N", "rate", "settings", F.array_join(text, " | ").alias("line"))


def append_cells(cells: DataFrame, path: str) -> None:
    """Appends measured cells to the CSV files under path; `sources.files.read_cells` reads them."""
    cells.write.mode("append").option("header", True).csv(path)
