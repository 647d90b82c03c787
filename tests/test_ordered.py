"""Two-level forms against plain folds, with ranges that cut streams anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from streamloom.operators import consumers, latency, ordered, retention


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for s in range(4):
        seqs = sorted(rng.sample(range(1, 400), 60 if s < 3 else 1))
        pts = 0
        for q in seqs:
            pts = rng.choice((pts + rng.randrange(1, 90_000), pts, pts - rng.randrange(200_000), rng.randrange(50), -1))
            out.append((s, q, pts))
    return out


@pytest.fixture(scope="module")
def packets(spark, rows):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "stream_id int, seq long, pts_us long").repartition(3)


def by_stream(rows):
    out: dict = {}
    for s, q, p in sorted(rows):
        out.setdefault(s, []).append((q, p))
    return out


@pytest.mark.parametrize("span", [3, 50, 1 << 18])
def test_numbers_and_neighbours(packets, rows, span):
    got = {(r.stream_id, r.seq): r for r in ordered.neighbours(ordered.numbered(packets, ["stream_id"], "seq", "no", span), ["stream_id"], "seq", span).collect()}
    prior = {(r.stream_id, r.seq): r.p for r in ordered.previous(packets, ["stream_id"], "seq", F.col("pts_us"), "p", span).collect()}
    for s, seen in by_stream(rows).items():
        for i, (q, _) in enumerate(seen):
            r = got[s, q]
            assert (r.no, r.before, r.after) == (i + 1, seen[i - 1][0] if i else None, seen[i + 1][0] if i + 1 < len(seen) else None)
            assert prior[s, q] == (seen[i - 1][1] if i else None)


@pytest.mark.parametrize("span", [3, 50, 1 << 18])
def test_relay_clock_and_epochs(packets, rows, span):
    clock = {(r.stream_id, r.seq): r.out_pts_us for r in retention.relayed(packets, span=span).collect()}
    epochs = {(r.stream_id, r.seq): r.epoch for r in retention.loop_epochs(packets, span).collect()}
    assert len(clock) == len(epochs) == len(rows)
    for s, seen in by_stream(rows).items():
        offset, last, delta, epoch, prior = 0, -1, 33_000, 0, None
        for q, p in seen:
            now = p + offset
            if last >= 0 and now <= last:
                offset = last + delta - p
                now = p + offset
            if last >= 0:
                delta = now - last
            last = now
            epoch += prior is not None and p <= prior
            prior = p
            assert clock[s, q] == now and epochs[s, q] == epoch


@pytest.mark.parametrize("span", [3, 1 << 18])
def test_gaps_and_medians(spark, packets, rows, span):
    got = {r.stream_id: (r.non_monotonic, r.median_delta) for r in latency.pts_gaps(packets, span).collect()}
    for s, seen in by_stream(rows).items():
        valid = [p for _, p in seen if p >= 0]
        steps = [b - a for a, b in zip(valid, valid[1:], strict=False)]
        up = sorted(d for d in steps if d > 0)
        if valid:
            assert got[s] == (sum(d <= 0 for d in steps), up[len(up) // 2] if up else None)
    rng = random.Random(3)
    values = [(k, rng.choice((rng.randrange(-5, 5), rng.randrange(-(10**12), 10**12), 70_000))) for k in (1, 1, 1, 2, 2, None) for _ in range(50)] + [(9, None), (8, 4)]
    df = spark.createDataFrame(values, "k int, v long")
    found = {r.k: r.m for r in ordered.upper_medians(df, ["k"], "v", "m").collect()}
    for k in (1, 2, None, 8):
        own = sorted(v for kk, v in values if kk == k and v is not None)
        assert found[k] == own[len(own) // 2]
    assert 9 not in found


@pytest.mark.parametrize("span", [4, 1 << 18])
def test_zone_events(spark, span):
    rng = random.Random(5)
    frames = [(s, f) for s in range(2) for f in sorted(rng.sample(range(1, 200), 70))]
    hits = [(s, f, z) for s, f in frames for z in ("a", "b") for _ in range(rng.choice((0, 0, 1, 2)))]
    got = consumers.zone_events(spark.createDataFrame(frames, "stream_id int, frame_no int"), spark.createDataFrame(hits, "stream_id int, frame_no int, zone string"), span)
    want = []
    for s in range(2):
        for z in ("a", "b"):
            before, total = 0, 0
            for _, f in (x for x in frames if x[0] == s):
                n = hits.count((s, f, z))
                total += n
                if (n > 0) != (before > 0):
                    want.append((s, z, f, "ENTER" if n else "LEAVE", total))
                before = n
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_last_emas(spark):
    rng = random.Random(6)
    rows = [(k, i, 0.0 if k == 2 or i < 4 or rng.random() < 0.2 else rng.random()) for k in range(3) for i in range(1, 200)]
    got = {r.k: r.ema for r in consumers.last_emas(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v").collect()}
    for k in range(3):
        m = 0.0
        for kk, _, v in rows:
            if kk == k:
                m = v if m == 0 else m * 0.95 + v * 0.05
        assert got[k] == pytest.approx(m, abs=1e-9)


def test_streamed_machines_keep_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).selectExpr("cast(id % 5 as int) as k", "id", "cast(id * 7 % 11 as long) as v").repartition(4)

        def machine():
            total, key = 0, None

            def step(rows):
                nonlocal total, key
                if rows is None:
                    return {"k": [key], "last": [-total]}
                out, key = [], rows["k"][0]
                for v in rows["v"]:
                    total += v
                    out.append(total)
                return {"k": rows["k"], "last": out}

            return step

        got = sorted(tuple(r) for r in ordered.streamed(df, "k", ["id"], machine, "k int, last long").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(5):
        total = 0
        for i in range(k, 300, 5):
            total += i * 7 % 11
            want.append((k, total))
        want.append((k, -total))
    assert got == sorted(want)
