import random

import pytest
from pyspark.sql import functions as F

from streamloom.functions import decode, geometry
from streamloom.operators import consumers, nms, retention
from streamloom.plans import capacity


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def boxes(*rows):
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", r[:4], strict=True)], F.lit(float(r[4])).alias("score"), F.lit(r[5]).alias("cls")) for r in rows])


def test_nms_threshold_and_ties(spark):
    half = boxes((0, 0, 10, 10, 0.9, 0), (0, 0, 10, 5, 0.8, 0))  # IoU exactly 0.5 is kept
    assert len(one(spark, nms.suppress(half, 0.5))) == 2 and len(one(spark, nms.suppress(half, 0.49))) == 1
    tie = one(spark, nms.suppress(boxes((5, 0, 10, 10, 0.5, 1), (3, 0, 10, 10, 0.5, 0), (1, 0, 10, 10, 0.5, 0)), 0.3))
    assert [(d.cls, d.x) for d in tie] == [(0, 1.0), (1, 5.0)]
    assert one(spark, nms.suppress(F.slice(half, 1, 0), 0.5)) == []


def test_heads(spark):
    f = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, decode.argmax(f(-3, -1, -1)))) == (1, -1.0)
    assert tuple(one(spark, decode.argmax(f(1, "nan", 2)))) == (2, 2.0)
    assert one(spark, decode.argmax(f("nan", 5)))["label"] == 0
    assert one(spark, decode.ctc_collapse(F.array(*[F.lit(x) for x in (0, 0, 7, 0, 3, 3, 7, 7, 3)]), 7)) == [0, 0, 3, 3]
    assert one(spark, decode.ctc_text(F.array(F.lit(31), F.lit(41), F.lit(99)))) == "0A?"
    assert len(decode.PLATE_CLASSES) == 68
    assert one(spark, consumers.ema(f(1, 2, 3))) == pytest.approx(1.1475)
    assert one(spark, consumers.ema(f(0, 2))) == 2.0


def test_geometry(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    assert tuple(one(spark, geometry.crop_rect(*lit(2.5, -3.5, 0.2, 900.0, 100, 50)))) == (3, 0, 1, 50)
    assert tuple(one(spark, geometry.letterbox(*lit(1280, 720), 640, 640))) == (0.5, 0, 140)
    grids = {(3840, 2160): {640: 32, 960: 15, 1280: 8}, (640, 640): {640: 1}, (320, 240): {640: 1}, (802, 543): {640: 2}}
    for (w, h), want in grids.items():
        for tile, n in want.items():
            cells = geometry.tile_grid(spark.createDataFrame([(w, h)], "width int, height int"), tile, 0.2).collect()
            assert len(cells) == n and sorted(c.tile_idx for c in cells) == list(range(n))
            assert max(c.x + c.w for c in cells) == w and max(c.y + c.h for c in cells) == h
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert [one(spark, geometry.in_polygon(*lit(x, y), square)) for x, y in ((2.0, 2.0), (0.0, 0.0), (4.0, 2.0), (5.0, 2.0))] == [True, True, False, False]


def test_relay_clock_increases(spark):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 33, 66, 0, 33, 5, 40])], "stream_id int, seq long, pts_us long")
    assert [r.out_pts_us for r in retention.relayed(p).orderBy("seq").collect()] == [0, 33, 66, 99, 132, 165, 200]


def test_retention_without_key_keeps_all(spark):
    p = spark.createDataFrame([(1, i, i * 10**6, i * 10**6, i == 9) for i in range(1, 10)], "stream_id int, seq long, pts_us long, arrival_us long, keyframe boolean")
    assert retention.retained(p, 3).count() == 9
    assert retention.clip(p, 3).count() == 1
    assert retention.clip(p.withColumn("keyframe", F.lit(False)), 3).count() == 0


def test_drop_oldest(spark):
    a = spark.createDataFrame([(0, i, i) for i in range(6)], "queue int, item long, at long")
    p = spark.createDataFrame([(0, 3), (0, 9)], "queue int, at long")
    got = {r["item"]: r.poll for r in retention.drop_oldest(a, p, 2).collect()}
    assert got == {0: None, 1: None, 2: 3, 3: None, 4: 9, 5: -1}


def test_tracker():
    t = consumers.Tracker()
    assert t.frame([(0, 0, 10, 10), (100, 0, 10, 10)], 0) == [(1, 1, False), (2, 1, False)]
    assert t.frame([(101, 0, 10, 10), (1, 0, 10, 10)], 500_000) == [(2, 2, True), (1, 2, True)]
    assert t.frame([(2, 0, 10, 10)], 9_000_000) == [(1, 3, True)]  # a stale track still matches, then the other one goes
    assert [x.id for x in t.tracks] == [1]


def test_recommend(spark):
    r = capacity.recommend(spark, 16, "4k", 30, sahi={"tile": 640})
    assert r.predicted_gpu_ms_per_frame == pytest.approx(16.6829) and not r.holds_realtime and r.suggestion.startswith("over capacity: raise skip to 9") and r.notes
    assert capacity.recommend(spark, 16, "720p", 30, skip=2).holds_realtime
    key = capacity.recommend(spark, 100, "720p", 30, decode="key")
    assert key.holds_realtime and key.binding_resource == "none"
    for bad in ({"resolution": "8k"}, {"decode": "none"}, {"skip": 0}, {"sahi": {"overlap": 0.1}}, {"sahi": {"tile": 640, "x": 1}}):
        with pytest.raises(ValueError):
            capacity.recommend(spark, 1, **bad)
    with pytest.raises(ValueError):
        capacity.recommend(spark, 0)
    assert capacity.tile_count("4k", 640) == 33


@pytest.mark.parametrize("span", [5, 40, 1 << 18])
def test_nearest_against_all_pairs(spark, span):
    """Ranges of time cut anywhere; right rows share times."""
    rng = random.Random(1)
    left, right = ([(rng.randrange(3), i, rng.randrange(300)) for i in range(n)] for n in (400, 120))
    want = []
    for key, i, t in left:
        pairs = [(abs(rt - t), rt, rid) for k, rid, rt in right if k == key]
        near, _, rid = min(pairs)
        want.append((key, i, rid if near <= 1 else max((rt, rid) for _, rt, rid in pairs)[1], near <= 1))
    got = consumers.nearest(spark.createDataFrame(left, "key int, id long, t long"), spark.createDataFrame(right, "key int, rid long, rt long"), 1, span)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_yolo_heads(spark):
    """NaN never wins, no positive score is class 0 with score 0, null heads stay null, wrong lengths fail."""
    nan = float("nan")
    heads = [[50.0, 10, 50, 10, 20, 4, 20, 4, 0.9, nan, 0.2, 0.6], None, [50.0, 10, 50, 10, 20, 4, 20, 4, -1.0, -0.5, -2.0, -0.1]]
    df = spark.createDataFrame([(i, h and [float(v) for v in h]) for i, h in enumerate(heads)], "i int, raw array<double>")
    lb = F.struct(F.lit(0.5).alias("scale"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y"))
    found = lambda t, **k: {r.i: r.d for r in df.select("i", decode.yolo(F.col("raw"), 2, 2, lb, F.lit(110), F.lit(110), t, **k).alias("d")).collect()}
    got = found(0.4, off_x=1000)
    assert [(d.x, d.y, d.w, d.h, d.score, d.cls) for d in got[0]] == [(1080.0, 80.0, 30.0, 30.0, 0.9, 0), (1016.0, 16.0, 8.0, 8.0, 0.6, 1)]
    assert got[1] is None and got[2] == [] and [(d.score, d.cls) for d in found(0.0)[2]] == [(0.0, 0), (0.0, 0)]
    with pytest.raises(Exception, match="12 values|has 15 values"):
        df.select(decode.yolo(F.col("raw"), 3, 1, lb, F.lit(110), F.lit(110)).alias("d")).collect()
