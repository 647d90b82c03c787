"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from streamloom import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def value(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.9g}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(name, spark, sf, duck):
    got = Q.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = [[r[c] for c in cols] for r in got.collect()]
    num = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    assert sorted([value(num(x)) for x in r] for r in rows) == sorted([value(num(r[i])) for i in at] for r in want.fetchall())


def test_whole_streams(spark):
    """The relay clock and the moving mean against their rules, step by step."""
    sf = "/root/testdata/sf0.01"
    ids: dict[int, list[int]] = {}
    for e, u in sorted(duckdb.sql(f"SELECT event_id, user_id FROM '{sf}/events.parquet'").fetchall()):
        ids.setdefault(u % 16, []).append(e)
    relayed, means = {}, {}
    for stream, events in ids.items():
        offset, last, delta, mean = 0, None, 33_000, 0.0
        for seq, e in enumerate(events, 1):
            pts = seq % 40 * 33_000 if seq % 40 < 30 else 5_000
            if last is not None and pts + offset <= last:
                offset = last + delta - pts
            if last is not None:
                delta = pts + offset - last
            last = pts + offset
            relayed[stream, seq] = (pts, last)
            v = (1.5 + e // 8 % 20 / 10.0) / (8 if e % 16 < 8 else 7)
            mean = v if mean == 0 else mean * 0.95 + v * 0.05
        means[stream] = mean
    assert {(r.stream_id, r.seq): (r.pts_us, r.out_pts_us) for r in Q.QUERIES["pts_rebase"](spark, sf).collect()} == relayed
    assert {r.stream_id: r.ema for r in Q.QUERIES["ema_gpu_ms"](spark, sf).collect()} == pytest.approx(means, abs=1e-6)
