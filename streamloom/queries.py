"""Queries over the driver's tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import decode as D
from .functions import geometry as G
from .operators import atlas, cascade, consumers, delivery, latency, nms, retention, sampling
from .plans import capacity
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the fixtures in SQL ---------------------------------------------------------------------------------------------

EV = "ev AS (SELECT event_id, CAST(user_id % 16 AS INTEGER) AS stream_id, epoch_us(ts) AS pts_us, event_type FROM events)"
PK = EV + """, pk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS seq FROM ev),
packets AS (SELECT event_id, stream_id, seq, pts_us, pts_us AS arrival_us, seq % 30 = 1 AS keyframe, event_id % 997 + 1000 AS size FROM pk)"""
SHUF = PK + """, sp AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN -1 ELSE pts_us + CASE seq % 3 WHEN 1 THEN 9000000000 WHEN 2 THEN -9000000000 ELSE 0 END END AS pts_us) FROM packets)"""
ST = "st AS (SELECT CAST(range AS INTEGER) AS stream_id, CASE range % 4 WHEN 0 THEN NULL ELSE CAST(range % 4 + 1 AS INTEGER) END AS skip, CASE WHEN range % 8 = 7 THEN 'key' END AS decode FROM range(16))"
FR = PK + """, frames AS (SELECT event_id, stream_id, CAST(seq AS INTEGER) AS frame_no, pts_us, [1280, 1920, 2560, 3840][stream_id % 4 + 1] AS width, [720, 1080, 1440, 2160][stream_id % 4 + 1] AS height FROM packets)"""
DET = FR + """, det AS (SELECT event_id, stream_id, frame_no, pts_us, width, height, CAST(k AS INTEGER) AS det_idx,
  (event_id * 37 + k * 53) % width - 10.5::DOUBLE AS x, (event_id * 91 + k * 29) % height - 20.5::DOUBLE AS y,
  CAST(1 + (event_id + k * 7) % 160 AS DOUBLE) AS w, CAST(1 + (event_id * 3 + k) % 160 AS DOUBLE) AS h,
  ((event_id * 13 + k * 17) % 1000) / 1000.0::DOUBLE AS score, CAST((event_id + k) % 4 AS INTEGER) AS cls
  FROM (SELECT *, unnest(range(0, event_id % 6 + 1)) AS k FROM frames))"""
CROPS = DET + """, c0 AS (SELECT *, CAST(least(greatest(round(x), 0), width - 1) AS INTEGER) AS rx, CAST(least(greatest(round(y), 0), height - 1) AS INTEGER) AS ry FROM det),
crops AS (SELECT *, CAST(least(greatest(round(w), 1), width - rx) AS INTEGER) AS rw, CAST(least(greatest(round(h), 1), height - ry) AS INTEGER) AS rh FROM c0)"""
RES = FR + """, res AS (SELECT *, (event_id % 50) / 1000.0::DOUBLE AS ms_pop_to_ready, (event_id % 700) / 1000.0::DOUBLE AS ms_ready_to_take, event_id // 8 AS batch_seq,
  CASE WHEN event_id % 16 < 8 THEN 8 ELSE 7 END AS batch_size, 1.5::DOUBLE + ((event_id // 8) % 20) / 10.0::DOUBLE AS ms_take_to_done FROM frames)"""
TX = "tx AS (SELECT event_id AS arrival, CAST(user_id % 16 AS INTEGER) AS stream_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'P' || CAST((event_id * event_id) % 97 AS VARCHAR) END AS text FROM events)"
CE = """o AS (SELECT CAST(1 + o_custkey % 100 AS INTEGER) AS N, CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'key30' END AS decode, CAST(1 + (o_custkey // 100) % 6 AS INTEGER) AS skip,
  CAST(o_orderkey % 3 AS INTEGER) AS version, o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
g AS (SELECT version, N, decode, skip, min(o_orderkey) AS id, CAST(sum(cents) AS BIGINT) AS c FROM o GROUP BY ALL),
cells AS (SELECT version, N, decode, skip, id, (c % 1200) / 10.0::DOUBLE AS hold_pct, (c % 9000) / 10.0::DOUBLE AS decoded_per_s, (c % 97) / 10.0::DOUBLE AS gpu_ms,
  CAST(c % 101 AS INTEGER) AS nvdec_pct, CAST((c // 7) % 101 AS INTEGER) AS sm_pct, (c % 170) / 10.0::DOUBLE AS pre_ms, ((c // 3) % 170) / 10.0::DOUBLE AS queue_ms,
  (CASE WHEN decode = 'all' THEN 30.0::DOUBLE ELSE 1.0::DOUBLE END) / skip AS inf_rate, CAST((c // 11) % 8000 AS INTEGER) AS vram_mb FROM g)"""
VE = "ve AS (SELECT vec_id, CAST(vec_id % 16 AS INTEGER) AS stream_id, embedding, label FROM embeddings)"


def iou_sql(a: str, b: str) -> str:
    i = f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))"
    return f"({i} / ({a}.w * {a}.h + {b}.w * {b}.h - {i}))"


def nms_sql(rows: str, threshold: float, prefix: str = "n", ties: str = "") -> str:
    """CTEs: the kept list of each event by a recursion over ranks. rows: a CTE (event_id, x, y, w, h, score, cls); ties: further columns of the order."""
    p = prefix
    return f"""{p}r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, cls, x{ties}) AS r FROM {rows}),
{p}k AS (SELECT event_id, 1::BIGINT AS r, [{{'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'cls': cls}}] AS kept FROM {p}r WHERE r = 1
  UNION ALL
  SELECT t.event_id, d.r, CASE WHEN len(list_filter(t.kept, lambda q: q.cls = d.cls AND {iou_sql('q', 'd')} > {threshold})) > 0 THEN t.kept
    ELSE list_append(t.kept, {{'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h, 'score': d.score, 'cls': d.cls}}) END
  FROM {p}k t JOIN {p}r d ON d.event_id = t.event_id AND d.r = t.r + 1),
{p}f AS (SELECT event_id, arg_max(kept, r) AS kept FROM {p}k GROUP BY event_id)"""


DENSE = """dn AS (SELECT event_id, k, CAST((event_id * 37) % 300 + k * 13 AS DOUBLE) AS x, CAST((event_id * 91) % 300 + k * 9 AS DOUBLE) AS y, CAST(100 + (event_id + k * 7) % 160 AS DOUBLE) AS w,
  CAST(100 + (event_id * 3 + k) % 160 AS DOUBLE) AS h, ((event_id * 13 + k * 17) % 1000) / 1000.0::DOUBLE AS score, CAST((event_id + k) % 2 AS INTEGER) AS cls
  FROM (SELECT event_id, unnest(range(0, 6)) AS k FROM events WHERE event_id % 50 <> 0))"""


# ---- sampling (F-01..F-03 S-04 S-05 S-07 S-09 J-03 T-13) --------------------------------------------------------------


@query(f"WITH {PK} SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS INTEGER) AS frame_no FROM packets WHERE keyframe")
def keyframe_filter(spark, sf):
    return sampling.decoded(X.packets(spark, sf), True).select("stream_id", "seq", "frame_no")


@query(f"WITH {PK} SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS INTEGER) AS frame_no FROM packets")
def frame_number(spark, sf):
    return sampling.decoded(X.packets(spark, sf)).select("stream_id", "seq", "frame_no")


@query(f"WITH {FR} SELECT stream_id, frame_no FROM frames WHERE (frame_no + stream_id) % 4 = 0")
def skip_sample(spark, sf):
    return sampling.skip_sample(sampling.decoded(X.packets(spark, sf)), 4).select("stream_id", "frame_no")


@query(f"""WITH {PK}, {ST}, d AS (SELECT p.stream_id, seq, coalesce(skip, 5) AS skip, row_number() OVER (PARTITION BY p.stream_id ORDER BY seq) AS frame_no
FROM packets p JOIN st USING (stream_id) WHERE coalesce(decode, 'all') <> 'key' OR keyframe) SELECT stream_id, seq, CAST(frame_no AS INTEGER) AS frame_no FROM d WHERE (frame_no + stream_id) % skip = 0""")
def per_stream_skip(spark, sf):
    return sampling.sampled(X.packets(spark, sf), X.streams(spark), skip=5).select("stream_id", "seq", "frame_no")


@query(f"WITH {FR} SELECT stream_id, frame_no FROM frames WHERE frame_no <= 100")
def max_frames(spark, sf):
    return sampling.max_frames(sampling.decoded(X.packets(spark, sf)), 100).select("stream_id", "frame_no")


@query("SELECT event_id, coalesce(CAST(floor(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 3000 END, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 3000 - 7 END) * 1000000.0 / 90000) AS BIGINT), -1) AS pts_us, (user_id & 1) <> 0 AS keyframe FROM events")
def timestamp_projection(spark, sf):
    e = X.table(spark, sf, "events")
    pts, dts = F.expr("case when event_id % 3 = 0 then null else event_id * 3000 end"), F.expr("case when event_id % 9 = 0 then null else event_id * 3000 - 7 end")
    return e.select("event_id", F.coalesce(files.pts_micros(pts, dts, 1, 90_000), F.lit(-1)).alias("pts_us"), files.is_keyframe(F.col("user_id")).alias("keyframe"))


@query(f"WITH {DET} SELECT stream_id, frame_no, det_idx, score FROM det WHERE score >= 0.4")
def score_filter(spark, sf):
    return X.detections(spark, sf).where("score >= 0.4").select("stream_id", "frame_no", "det_idx", "score")


@query(f"WITH {DET} SELECT stream_id, frame_no, det_idx, cls FROM det WHERE cls IN (2, 3, 5, 7) AND stream_id < 12")
def app_class_filter(spark, sf):
    return X.detections(spark, sf).where(F.col("cls").isin(2, 3, 5, 7) & (F.col("stream_id") < 12)).select("stream_id", "frame_no", "det_idx", "cls")


@query(f"WITH {RES} SELECT stream_id, count(*) AS n, round(avg(ms_take_to_done), 6) AS gpu_ms FROM res WHERE frame_no >= 60 GROUP BY stream_id")
def warmup_discard(spark, sf):
    return latency.warmed(X.results(spark, sf)).groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.avg("ms_take_to_done"), 6).alias("gpu_ms"))


@query(f"WITH {RES} SELECT event_id, stream_id, frame_no FROM res ORDER BY event_id LIMIT 60")
def result_cap(spark, sf):
    return X.results(spark, sf).select("event_id", "stream_id", "frame_no").orderBy("event_id").limit(60)


@query(f"WITH {PK} SELECT copy, stream_id, count(*) AS packets FROM packets, (SELECT CAST(range AS INTEGER) AS copy FROM range(3)) GROUP BY ALL")
def replicated_source(spark, sf):
    return files.replicate(X.packets(spark, sf).select("stream_id"), 3).groupBy("copy", "stream_id").agg(F.count("*").alias("packets"))


# ---- geometry (P-01 P-02 P-09 P-10 G-01..G-05 F-09) -------------------------------------------------------------------

_LB = lambda inner: f"CAST(floor((640 - {inner.format(v='width')}) / 2) AS INTEGER) AS pad_x, CAST(floor((640 - {inner.format(v='height')}) / 2) AS INTEGER) AS pad_y"


@query(f"""WITH {FR}, s AS (SELECT DISTINCT width, height, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS scale FROM frames)
SELECT width, height, round(scale, 9) AS scale, {_LB('floor({v} * scale)')}, CAST(floor((640 - width * scale) / 2) AS INTEGER) AS tile_pad_x, CAST(floor((640 - height * scale) / 2) AS INTEGER) AS tile_pad_y FROM s""")
def letterbox(spark, sf):
    s = X.frames(spark, sf).select("width", "height").distinct()
    w, h = F.col("width"), F.col("height")
    b = s.select("width", "height", G.letterbox(w, h, 640, 640).alias("b"), G.letterbox(w, h, 640, 640, tile=True).alias("t"))
    return b.select("width", "height", F.round("b.scale", 9).alias("scale"), F.col("b.pad_x"), F.col("b.pad_y"), F.col("t.pad_x").alias("tile_pad_x"), F.col("t.pad_y").alias("tile_pad_y"))


@query(f"""WITH {FR}, s AS (SELECT DISTINCT width, height FROM frames),
ox AS (SELECT DISTINCT width, least(i * 512, greatest(width - 640, 0)) AS x FROM s, range(0, 10) t(i) WHERE i * 512 < width - 640 + 512),
oy AS (SELECT DISTINCT height, least(i * 512, greatest(height - 640, 0)) AS y FROM s, range(0, 10) t(i) WHERE i * 512 < height - 640 + 512)
SELECT s.width, s.height, CAST(row_number() OVER (PARTITION BY s.width, s.height ORDER BY y, x) - 1 AS INTEGER) AS tile_idx, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, least(s.width, 640) AS w, least(s.height, 640) AS h
FROM s JOIN ox USING (width) JOIN oy USING (height)""")
def tile_grid(spark, sf):
    return G.tile_grid(X.frames(spark, sf), 640, 0.2)


@query(f"WITH {CROPS} SELECT stream_id, frame_no, det_idx, rx, ry, rw, rh FROM crops")
def crop_rect(spark, sf):
    return cascade.crops(X.detections(spark, sf)).select("stream_id", "frame_no", "det_idx", *[F.col(f"rect.{c}").alias(f"r{c}") for c in "xywh"])


_ZONES = [(s, name, poly) for s in range(16) for name, poly in (("left", [(0, 0), (557, 0), (557, 2200), (0, 2200)]), ("right", [(557, 0), (4000, 0), (4000, 2200), (557, 2200)]), ("bent", [(100, 100), (900, 100), (900, 700), (500, 300), (100, 700)]))]


def zones(spark) -> DataFrame:
    return spark.createDataFrame([(s, n, [(float(x), float(y)) for x, y in p]) for s, n, p in _ZONES], "stream_id int, zone string, polygon array<struct<x:double,y:double>>")


def _edges() -> str:
    rows = []
    for name, poly in (("left", _ZONES[0][2]), ("right", _ZONES[1][2]), ("bent", _ZONES[2][2])):
        for (ax, ay), (bx, by) in zip(poly, [poly[-1], *poly[:-1]], strict=True):
            rows.append(f"('{name}', {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)")
    return ", ".join(rows)


HITS = DET + f""", ed(zone, ax, ay, bx, by2) AS (VALUES {_edges()}),
hits AS (SELECT stream_id, frame_no, det_idx, zone FROM det, ed
  WHERE ((ay > y + h / 2.0) <> (by2 > y + h / 2.0)) AND x + w / 2.0 < (bx - ax) * (y + h / 2.0 - ay) / (by2 - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"WITH {HITS} SELECT stream_id, zone, count(*) AS n FROM hits GROUP BY ALL")
def zone_filter(spark, sf):
    return consumers.zone_hits(X.detections(spark, sf), zones(spark)).groupBy("stream_id", "zone").agg(F.count("*").alias("n"))


@query(f"""WITH {HITS}, per AS (SELECT stream_id, frame_no, zone, count(*) AS inside FROM hits GROUP BY ALL),
s AS (SELECT z.stream_id, z.frame_no, z.zone, coalesce(inside, 0) AS inside FROM (SELECT stream_id, frame_no, zone FROM frames CROSS JOIN (VALUES ('left'), ('right'), ('bent')) v(zone)) z LEFT JOIN per USING (stream_id, frame_no, zone)),
t AS (SELECT *, inside > 0 AS occ, coalesce(lag(inside > 0) OVER w, false) AS before, sum(inside) OVER w AS total FROM s WINDOW w AS (PARTITION BY stream_id, zone ORDER BY frame_no))
SELECT stream_id, zone, frame_no, CASE WHEN occ THEN 'ENTER' ELSE 'LEAVE' END AS event, CAST(total AS BIGINT) AS total FROM t WHERE occ <> before""")
def zone_enter_leave(spark, sf):
    return consumers.zone_events(X.frames(spark, sf), consumers.zone_hits(X.detections(spark, sf), zones(spark)))


# ---- heads (P-06..P-08 P-12..P-17 P-23 W-11) --------------------------------------------------------------------------


@query(f"WITH {VE} SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label, round(list_max(embedding)::DOUBLE, 6) AS score FROM ve")
def argmax_classify(spark, sf):
    a = X.vectors(spark, sf).select("vec_id", D.argmax(F.col("embedding")).alias("a"))
    return a.select("vec_id", F.col("a.label").alias("label"), F.round(F.col("a.score").cast("double"), 6).alias("score"))


@query(f"WITH {VE}, n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) + 1e-9 AS nn FROM ve) SELECT vec_id, round(nn, 6) AS norm, round(embedding[1]::DOUBLE / nn, 6) AS first, round(embedding[64]::DOUBLE / nn, 6) AS last FROM n")
def embedding_norm(spark, sf):
    v = X.vectors(spark, sf).select("vec_id", "embedding", D.l2_normalised(F.col("embedding")).alias("u"))
    norm = F.sqrt(D.dot(F.col("embedding"), F.col("embedding"))) + 1e-9
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


@query(f"""WITH {VE}, s AS (SELECT vec_id, t, list_position(list_transform(range(0, 8), lambda c: embedding[c * 8 + t + 1]), list_max(list_transform(range(0, 8), lambda c: embedding[c * 8 + t + 1]))) - 1 AS b FROM ve, range(0, 8) r(t)),
k AS (SELECT *, lag(b, 1, -1) OVER (PARTITION BY vec_id ORDER BY t) AS p FROM s)
SELECT vec_id, coalesce(string_agg(['<jing>', '<hu>', '<jin>', '<yu>', '<ji>', '<jin2>', '<meng>'][b + 1], '' ORDER BY t) FILTER (WHERE b <> p AND b <> 7), '') AS text FROM k GROUP BY vec_id""")
def ctc_decode(spark, sf):
    steps = X.vectors(spark, sf).select("vec_id", D.ctc_steps(F.col("embedding"), 8, 8).alias("s"))
    return steps.select("vec_id", D.ctc_text(D.ctc_collapse(F.col("s"), 7)).alias("text"))


_CLAMP = "least(greatest({0}, 0), {1})"


def _boxes(src: str, x0: str, y0: str, x1: str, y1: str, extra: str) -> str:
    return f"""b0 AS (SELECT {extra}, score, cls, least(greatest({x0}, 0), 1280) AS ax, least(greatest({y0}, 0), 720) AS ay, least(greatest({x1}, 0), 1280) AS bx, least(greatest({y1}, 0), 720) AS by_ FROM {src}),
bx AS (SELECT {extra}, round(ax, 4) AS x, round(ay, 4) AS y, round(greatest(bx - ax, 0), 4) AS w, round(greatest(by_ - ay, 0), 4) AS h, round(score, 6) AS score, cls FROM b0)"""


def _flat(df: DataFrame, dets: str, least: float) -> DataFrame:
    """Boxes as reported: rounded, and those whose reported score is `least` or more."""
    d = df.select("vec_id", F.posexplode(F.filter(dets, lambda d: F.round(d["score"].cast("double"), 6) >= least)).alias("rank", "d"))
    return d.select("vec_id", "rank", *[F.round(f"d.{c}", 4).alias(c) for c in "xywh"], F.round("d.score", 6).alias("score"), "d.cls")


#: Scores are reported to six places and held against thresholds as reported; decoding leaves out what cannot round up to one.
_HALF = 1e-6


def _lb():
    return F.struct(F.lit(0.5).alias("scale"), F.lit(0).alias("pad_x"), F.lit(140).alias("pad_y"))


@query(f"""WITH {VE}, a AS (SELECT vec_id, CAST(i AS INTEGER) AS i, list_transform(range(0, 4), lambda c: embedding[(c + 4) * 8 + i + 1]::DOUBLE) AS sc, 100 * embedding[i + 1]::DOUBLE AS cx, 100 * embedding[8 + i + 1]::DOUBLE AS cy,
100 * embedding[16 + i + 1]::DOUBLE AS w0, 100 * embedding[24 + i + 1]::DOUBLE AS h0 FROM ve, range(0, 8) r(i)),
m AS (SELECT *, greatest(list_max(sc), 0) AS score, CASE WHEN list_max(sc) > 0 THEN CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) ELSE 0 END AS cls FROM a),
{_boxes('m', '(cx - w0 / 2 - 0) / 0.5', '(cy - h0 / 2 - 140) / 0.5', '(cx - w0 / 2 - 0) / 0.5 + w0 / 0.5', '(cy - h0 / 2 - 140) / 0.5 + h0 / 0.5', 'vec_id, i')}
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INTEGER) AS rank, x, y, w, h, score, cls FROM bx WHERE score >= 0.1""")
def yolo_decode(spark, sf):
    scaled = F.transform(F.col("embedding"), lambda v, i: F.when(i < 32, v.cast("double") * 100).otherwise(v.cast("double")))
    v = X.vectors(spark, sf).select("vec_id", scaled.alias("raw"))
    return _flat(v.select("vec_id", D.yolo(F.col("raw"), 8, 4, _lb(), F.lit(1280), F.lit(720), 0.1 - _HALF).alias("d")), "d", 0.1)


def _e2e_sql(norm: bool) -> str:
    at = lambda k: f"embedding[i * 6 + {k + 1}]::DOUBLE"
    if norm:
        x1, y1, x2, y2 = f"({at(0)} - {at(2)} / 2) * 640", f"({at(1)} - {at(3)} / 2) * 640", f"({at(0)} + {at(2)} / 2) * 640", f"({at(1)} + {at(3)} / 2) * 640"
    else:
        x1, y1, x2, y2 = (f"{at(k)} * 900" for k in range(4))
    return f"""WITH {VE}, m AS (SELECT vec_id, CAST(i AS INTEGER) AS i, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2, {at(4)} AS score, CAST(round({at(5)}) AS INTEGER) AS cls FROM ve, range(0, 10) r(i)),
{_boxes('m', '(x1 - 0) / 0.5', '(y1 - 140) / 0.5', '(x2 - 0) / 0.5', '(y2 - 140) / 0.5', 'vec_id, i')}
SELECT vec_id, x, y, w, h, score, cls FROM bx WHERE score >= 0.05"""


@query(_e2e_sql(False))
def e2e_decode(spark, sf):
    scaled = F.transform(F.col("embedding"), lambda v, i: F.when(i % 6 < 4, v.cast("double") * 900).otherwise(v.cast("double")))
    v = X.vectors(spark, sf).select("vec_id", D.end_to_end(scaled, 10, _lb(), F.lit(1280), F.lit(720), 0.05 - _HALF).alias("d"))
    return _flat(v, "d", 0.05).drop("rank")


@query(_e2e_sql(True))
def rtdetr_decode(spark, sf):
    v = X.vectors(spark, sf).select("vec_id", D.end_to_end(F.col("embedding"), 10, _lb(), F.lit(1280), F.lit(720), 0.05 - _HALF, (640, 640)).alias("d"))
    return _flat(v, "d", 0.05).drop("rank")


@query("SELECT vec_id, CASE label WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 5 THEN 'car' ELSE 'imagenet_' || CAST(label AS VARCHAR) END AS name FROM embeddings")
def label_names(spark, sf):
    names = F.create_map(*[F.lit(x) for x in (0, "cat", 1, "dog", 5, "car")])
    return X.vectors(spark, sf).select("vec_id", F.coalesce(names[F.col("label")], F.concat(F.lit("imagenet_"), F.col("label").cast("string"))).alias("name"))


# ---- suppression (N-02 N-03 U-01 O-01 J-04) ---------------------------------------------------------------------------


def _kept(df: DataFrame, column: str) -> DataFrame:
    d = df.select("event_id", F.posexplode(column).alias("rank", "d"))
    return d.select("event_id", "rank", *[F.col(f"d.{c}") for c in ("x", "y", "w", "h", "score", "cls")])


@query(f"WITH RECURSIVE {DENSE}, {nms_sql('dn', 0.3)}, u AS (SELECT event_id, unnest(kept) AS d, generate_subscripts(kept, 1) AS i FROM nf) SELECT event_id, CAST(i - 1 AS INTEGER) AS rank, d.x AS x, d.y AS y, d.w AS w, d.h AS h, d.score AS score, d.cls AS cls FROM u")
def nms_per_class(spark, sf):
    return _kept(X.dense(spark, sf).select("event_id", nms.suppress(F.col("dets"), 0.3).alias("k")), "k")


@query(f"""WITH RECURSIVE {DENSE}, fu AS (SELECT * FROM dn WHERE k < 2), t1 AS (SELECT * REPLACE (x + 5 AS x) FROM dn WHERE k IN (2, 3)), t2 AS (SELECT * REPLACE (y + 3 AS y) FROM dn WHERE k > 3),
{nms_sql('fu', 0.45, 'a')}, {nms_sql('t1', 0.45, 'b')}, {nms_sql('t2', 0.45, 'c')},
al AS (SELECT event_id, unnest(kept) AS d FROM af UNION ALL SELECT event_id, unnest(kept) FROM bf UNION ALL SELECT event_id, unnest(kept) FROM cf),
fl AS (SELECT event_id, d.x AS x, d.y AS y, d.w AS w, d.h AS h, d.score AS score, d.cls AS cls FROM al), {nms_sql('fl', 0.5, 'm')},
u AS (SELECT event_id, unnest(kept) AS d, generate_subscripts(kept, 1) AS i FROM mf) SELECT event_id, CAST(i - 1 AS INTEGER) AS rank, d.x AS x, d.y AS y, d.w AS w, d.h AS h, d.score AS score, d.cls AS cls FROM u""")
def sahi_merge(spark, sf):
    moved = lambda c, x=0, y=0: F.transform(c, lambda d: d.withField("x", d["x"] + x).withField("y", d["y"] + y))
    d = F.col("dets")
    tiles = F.array(nms.suppress(moved(F.slice(d, 3, 2), x=5)), nms.suppress(moved(F.slice(d, 5, 2), y=3)))
    merged = nms.merge_tiles(nms.suppress(F.slice(d, 1, 2)), tiles, 0.5)
    return _kept(X.dense(spark, sf).where(F.size("dets") > 0).select("event_id", merged.alias("k")), "k")


# ---- routing and assembly (F-05..F-08 F-16 F-17 G-05 J-01 N-05..N-07 A-23 P-21) ---------------------------------------

ROUTED = CROPS + ", ro AS (SELECT * FROM crops WHERE cls IN (1, 2) AND score >= 0.3 AND least(rw, rh) >= 24)"


def _routed(spark, sf):
    d = cascade.crops(X.detections(spark, sf))
    return d, d.where(cascade.route([1, 2], 0.3, 24))


@query(f"WITH {ROUTED} SELECT stream_id, frame_no, det_idx FROM ro")
def select_route(spark, sf):
    return _routed(spark, sf)[1].select("stream_id", "frame_no", "det_idx")


@query(f"""WITH {ROUTED}, t AS (SELECT stream_id, frame_no, det_idx, 'T' || CAST((event_id * 7 + det_idx) % 50 AS VARCHAR) AS text FROM ro)
SELECT d.stream_id, d.frame_no, array_to_string(list(coalesce(t.text, '') ORDER BY d.det_idx), '|') AS texts, count(*) AS slots, count(t.text) AS routed FROM det d LEFT JOIN t USING (stream_id, frame_no, det_idx) GROUP BY ALL""")
def aligned_texts(spark, sf):
    d, r = _routed(spark, sf)
    child = r.select("stream_id", "frame_no", "det_idx", F.concat(F.lit("T"), ((F.col("event_id") * 7 + F.col("det_idx")) % 50).cast("string")).alias("text"))
    a = cascade.aligned(d, child, "ctc")
    return a.select("stream_id", "frame_no", F.array_join("texts", "|").alias("texts"), F.size("texts").cast("long").alias("slots"), F.size(F.filter("routed", lambda x: x)).cast("long").alias("routed"))


@query(f"""WITH {ROUTED}, t AS (SELECT stream_id, frame_no, det_idx, CAST((event_id + det_idx) % 7 AS INTEGER) AS label, 0.5::DOUBLE + det_idx / 10.0::DOUBLE AS sc FROM ro)
SELECT d.stream_id, d.frame_no, array_to_string(list(coalesce(t.label, 0) ORDER BY d.det_idx), '|') AS labels, round(sum(coalesce(t.sc, 0)), 6) AS score FROM det d LEFT JOIN t USING (stream_id, frame_no, det_idx) GROUP BY ALL""")
def aligned_labels(spark, sf):
    d, r = _routed(spark, sf)
    child = r.select("stream_id", "frame_no", "det_idx", ((F.col("event_id") + F.col("det_idx")) % 7).cast("int").alias("label"), (F.lit(0.5) + F.col("det_idx") / 10.0).alias("score"))
    a = cascade.aligned(d, child, "argmax")
    return a.select("stream_id", "frame_no", F.array_join(F.transform("labels", lambda x: x.cast("string")), "|").alias("labels"), F.round(F.aggregate("label_scores", F.lit(0.0), lambda s, x: s + x), 6).alias("score"))


@query(f"WITH {ROUTED} SELECT d.stream_id, count(*) AS detections, count(r.det_idx) AS populated FROM det d LEFT JOIN ro r USING (stream_id, frame_no, det_idx) GROUP BY d.stream_id")
def populated_counts(spark, sf):
    d = cascade.crops(X.detections(spark, sf))
    return d.groupBy("stream_id").agg(F.count("*").alias("detections"), F.count_if(cascade.route([1, 2], 0.3, 24)).alias("populated"))


@query(f"WITH {DET} SELECT stream_id, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT stream_id, frame_no, count(*) AS n FROM det GROUP BY ALL) GROUP BY stream_id")
def detections_per_frame(spark, sf):
    per = X.detections(spark, sf).groupBy("stream_id", "frame_no").agg(F.count("*").alias("n"))
    return per.groupBy("stream_id").agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


# ---- consumers --------------------------------------------------------------------------------------------------------


@query(f"WITH {TX} SELECT text, count(*) AS n, min(arrival) AS first_seen FROM tx WHERE text <> '' GROUP BY text ORDER BY n DESC, first_seen LIMIT 15")
def text_topk(spark, sf):
    return consumers.top_values(X.texts(spark, sf).where("text <> ''"), "text", 15, "arrival")


@query(f"WITH {DET} SELECT cls, count(*) AS n, min(event_id) AS first_seen FROM det GROUP BY cls ORDER BY n DESC, first_seen LIMIT 8")
def class_topk(spark, sf):
    return consumers.top_values(X.detections(spark, sf), "cls", 8, "event_id")


@query(f"WITH {TX} SELECT stream_id, count(DISTINCT text) AS n_texts, count(*) FILTER (WHERE text <> '') AS plates FROM tx GROUP BY stream_id")
def distinct_texts(spark, sf):
    return X.texts(spark, sf).groupBy("stream_id").agg(F.countDistinct("text").alias("n_texts"), F.count_if(F.col("text") != "").alias("plates"))


@query(f"""WITH {VE}, u AS (SELECT vec_id AS arrival, stream_id, list_transform(embedding, lambda v: v::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) + 1e-9)) AS v FROM ve),
p AS (SELECT q.stream_id, q.arrival, g.stream_id AS other, g.arrival AS seen, q.v AS a, g.v AS b FROM u q JOIN u g ON g.stream_id <> q.stream_id AND g.arrival < q.arrival AND g.arrival >= q.arrival - 48 * 16),
n AS (SELECT stream_id, arrival, other, seen, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) AS cosine, row_number() OVER (PARTITION BY arrival, other ORDER BY seen DESC) AS age FROM p),
k AS (SELECT * FROM n WHERE age <= 20), m AS (SELECT *, row_number() OVER (PARTITION BY arrival, other ORDER BY cosine DESC, seen) AS r FROM k)
SELECT stream_id, arrival, other, cosine, seen FROM m WHERE r = 1 AND cosine >= 0.3""")
def reid_top1(spark, sf):
    v = X.vectors(spark, sf).select("stream_id", F.col("vec_id").alias("arrival"), D.l2_normalised(F.col("embedding")).alias("v"))
    return consumers.cross_stream_matches(v, gallery=20, least=0.3, bucket=100)


@query(f"""WITH {RES}, s AS (SELECT stream_id, frame_no, ms_take_to_done / greatest(batch_size, 1) AS v FROM res),
l AS (SELECT stream_id, max(frame_no) AS last, min(frame_no) FILTER (WHERE v > 0) AS seed FROM s GROUP BY stream_id)
SELECT stream_id, round(sum(v * CASE WHEN frame_no = seed THEN 1 ELSE 0.05::DOUBLE END * pow(0.95::DOUBLE, last - frame_no)), 6) AS ema FROM s JOIN l USING (stream_id) WHERE frame_no >= seed GROUP BY stream_id""")
def ema_gpu_ms(spark, sf):
    """Of whole streams; tests hold it against the fold step by step too."""
    v = X.results(spark, sf).withColumn("v", F.col("ms_take_to_done") / F.greatest("batch_size", F.lit(1)))
    return consumers.last_emas(v.select("stream_id", "frame_no", "v"), ["stream_id"], "frame_no", "v").withColumn("ema", F.round("ema", 6))


@query(f"""WITH {PK}, s AS (SELECT stream_id AS key, seq // 500 AS generation, pts_us / 1e6 AS t, seq * 3 AS value FROM packets)
SELECT key, generation, round(t, 6) AS t, round((value - lag(value) OVER w) / greatest(t - lag(t) OVER w, 0.001), 6) AS rate FROM s WINDOW w AS (PARTITION BY key, generation ORDER BY t)""")
def counter_rate(spark, sf):
    s = X.packets(spark, sf).selectExpr("stream_id as key", "seq div 500 as generation", "pts_us / 1e6d as t", "seq * 3 as value")
    return consumers.counter_rates(s).select("key", "generation", F.round("t", 6).alias("t"), F.round("rate", 6).alias("rate"))


@query(f"""WITH {EV}, l AS (SELECT stream_id AS key, event_id AS id, pts_us AS t FROM ev WHERE event_type = 'view'), r AS (SELECT stream_id AS key, event_id AS rid, pts_us AS rt FROM ev WHERE event_type = 'click'),
n AS (SELECT l.key, id, t, rid, rt, row_number() OVER (PARTITION BY id ORDER BY abs(rt - t), rt, rid) AS k FROM l JOIN r USING (key)), w AS (SELECT key, arg_max(rid, rt) AS newest FROM r GROUP BY key)
SELECT n.key, id, CASE WHEN abs(rt - t) <= 600000000 THEN rid ELSE newest END AS rid, abs(rt - t) <= 600000000 AS in_tolerance FROM n JOIN w USING (key) WHERE k = 1""")
def nearest_event(spark, sf):
    e = X.events(spark, sf)
    left = e.where("event_type = 'view'").select(F.col("stream_id").alias("key"), F.col("event_id").alias("id"), F.col("pts_us").alias("t"))
    right = e.where("event_type = 'click'").select(F.col("stream_id").alias("key"), F.col("event_id").alias("rid"), F.col("pts_us").alias("rt"))
    return consumers.nearest(left, right, 600_000_000)


@query()
def tracker(spark, sf):
    """Sequential per stream; tests hold it against a mirror."""
    return consumers.tracked(X.detections(spark, sf).select("stream_id", "frame_no", "pts_us", "det_idx", "x", "y", "w", "h"), max_age_us=600_000_000)


# ---- retention and relay (W-08..W-10 W-12 K-06..K-08 T-05 J-12) -------------------------------------------------------


@query(f"""WITH {PK}, n AS (SELECT stream_id, max(arrival_us) AS m FROM packets GROUP BY stream_id),
a AS (SELECT p.stream_id, max(seq) FILTER (WHERE keyframe AND arrival_us <= m - 864000000000) AS anchor FROM packets p JOIN n USING (stream_id) GROUP BY p.stream_id)
SELECT stream_id, seq FROM packets JOIN a USING (stream_id) WHERE anchor IS NULL OR seq >= anchor""")
def packet_ring_retention(spark, sf):
    return retention.retained(X.packets(spark, sf), 864_000).select("stream_id", "seq")


@query(f"""WITH {SHUF}, n AS (SELECT stream_id, arg_max(pts_us, seq) AS newest FROM sp GROUP BY stream_id),
a AS (SELECT s.stream_id, coalesce(max(seq) FILTER (WHERE keyframe AND pts_us >= 0 AND pts_us <= newest - 432000000000), min(seq) FILTER (WHERE keyframe)) AS anchor FROM sp s JOIN n USING (stream_id) GROUP BY s.stream_id)
SELECT stream_id, seq FROM sp JOIN a USING (stream_id) WHERE seq >= anchor""")
def clip_anchor(spark, sf):
    return retention.clip(X.shuffled_packets(spark, sf), 432_000).select("stream_id", "seq")


@query(f"WITH {PK} SELECT stream_id, seq FROM packets WHERE seq > 300 AND pts_us > 1704500000000000")
def snapshot_since(spark, sf):
    return retention.since_pts(retention.since_seq(X.packets(spark, sf), 300), 1_704_500_000_000_000).select("stream_id", "seq")


@query(f"""WITH {PK}, s AS (SELECT stream_id, seq, CAST(CASE WHEN seq % 40 < 30 THEN (seq % 40) * 33000 ELSE 5000 END AS BIGINT) AS pts_us FROM packets),
d AS (SELECT *, pts_us - lag(pts_us) OVER w AS d, first_value(pts_us) OVER w AS p0 FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
k AS (SELECT *, CASE WHEN d IS NULL THEN 0 ELSE coalesce(last_value(CASE WHEN d > 0 THEN d END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq), 33000) END AS step FROM d)
SELECT stream_id, seq, pts_us, CAST(p0 + sum(step) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS out_pts_us FROM k""")
def pts_rebase(spark, sf):
    """Of whole streams; tests hold it against the clock step by step too."""
    return retention.relayed(X.packets(spark, sf).withColumn("pts_us", F.expr("case when seq % 40 < 30 then (seq % 40) * 33000 else 5000 end").cast("long")))


@query(f"""WITH {SHUF}, m AS (SELECT stream_id, seq, CASE WHEN pts_us <= lag(pts_us) OVER (PARTITION BY stream_id ORDER BY seq) THEN 1 ELSE 0 END AS w FROM sp)
SELECT stream_id, seq, CAST(sum(w) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS epoch FROM m""")
def loop_epochs(spark, sf):
    return retention.loop_epochs(X.shuffled_packets(spark, sf)).select("stream_id", "seq", "epoch")


@query(f"WITH {EV}, l AS (SELECT CAST(stream_id % 4 AS INTEGER) AS sink, event_id AS arrival FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY arrival DESC) AS r, count(*) OVER (PARTITION BY sink) AS c FROM l) SELECT sink, arrival, greatest(c - 200, 0) AS dropped FROM n WHERE r <= 200")
def line_queue_tail(spark, sf):
    left, dropped = retention.queue_tail(X.events(spark, sf).select((F.col("stream_id") % 4).cast("int").alias("sink"), F.col("event_id").alias("arrival")), 200)
    return left.join(dropped, "sink")


@query()
def drop_oldest(spark, sf):
    """Sequential per queue; tests hold it against a mirror."""
    e = X.events(spark, sf).select(F.col("stream_id").alias("queue"), F.col("event_id").alias("item"), F.col("event_id").alias("at"))
    return retention.drop_oldest(e, e.where("item % 3 = 0").select("queue", (F.col("at") + 40).alias("at")), 8)


@query(f"WITH {SHUF} SELECT a.stream_id, a.seq, max(b.seq) AS stamp_seq, arg_max(b.arrival_us, b.seq) AS arrival_us FROM sp a JOIN sp b ON a.stream_id = b.stream_id AND a.pts_us = b.pts_us AND b.seq <= a.seq AND b.seq > a.seq - 64 GROUP BY a.stream_id, a.seq")
def stamp_join(spark, sf):
    p = X.shuffled_packets(spark, sf)
    return retention.stamp_join(p.select("stream_id", "seq", "pts_us"), p)


# ---- latency (A-05..A-12 A-18 A-21 A-25 A-28..A-30 W-01 W-02 P-19 P-20 P-30 J-15) -------------------------------------


@query(f"WITH {RES} SELECT stream_id, count(*) AS inferred, round(avg(ms_pop_to_ready + ms_ready_to_take + ms_take_to_done), 6) AS mean_ms FROM res GROUP BY stream_id")
def per_stream_latency(spark, sf):
    return latency.per_stream(X.results(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"""WITH {SHUF}, d AS (SELECT stream_id, pts_us - lag(pts_us) OVER (PARTITION BY stream_id ORDER BY seq) AS delta FROM sp WHERE pts_us >= 0)
SELECT stream_id, count(*) FILTER (WHERE delta <= 0) AS non_monotonic, (list(delta ORDER BY delta) FILTER (WHERE delta > 0))[count(*) FILTER (WHERE delta > 0) // 2 + 1] AS median_delta FROM d GROUP BY stream_id""")
def pts_gaps(spark, sf):
    return latency.pts_gaps(X.shuffled_packets(spark, sf))


@query(f"WITH {RES}, b AS (SELECT batch_seq, max(batch_size) AS batch_size FROM res GROUP BY batch_seq) SELECT batch_size, count(*) AS batches FROM b GROUP BY batch_size")
def batch_histogram(spark, sf):
    return latency.batch_histogram(X.results(spark, sf))


@query(f"""WITH {RES}, b AS (SELECT batch_seq, max(ms_take_to_done) AS g FROM res GROUP BY batch_seq)
SELECT round(avg(ms_pop_to_ready), 6) AS pre_ms, round(avg(ms_ready_to_take), 6) AS queue_ms, (SELECT round(avg(g), 6) FROM b) AS gpu_ms FROM res""")
def latency_split(spark, sf):
    return latency.split(X.results(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("pre_ms", "queue_ms", "gpu_ms")])


@query(f"WITH {RES} SELECT stream_id, count(*) AS inferred, round(count(*) / ((max(pts_us) - min(pts_us)) / 1e6), 9) AS per_s FROM res WHERE (frame_no + stream_id) % 2 = 0 GROUP BY stream_id")
def throughput(spark, sf):
    r = sampling.skip_sample(X.results(spark, sf), 2)
    return r.groupBy("stream_id").agg(F.count("*").alias("inferred"), F.round(F.count("*") / ((F.max("pts_us") - F.min("pts_us")) / 1e6), 9).alias("per_s"))


@query(f"WITH {RES} SELECT stream_id, round(median(ms_pop_to_ready), 6) AS pre, round(median(ms_ready_to_take), 6) AS queue, round(median(ms_take_to_done), 6) AS gpu FROM res WHERE frame_no >= 60 GROUP BY stream_id")
def latency_medians(spark, sf):
    return latency.warmed(X.results(spark, sf)).groupBy("stream_id").agg(*[F.round(F.median(c), 6).alias(n) for n, c in (("pre", "ms_pop_to_ready"), ("queue", "ms_ready_to_take"), ("gpu", "ms_take_to_done"))])


@query(f"WITH {TX}, c AS (SELECT stream_id, text, count(*) AS n, min(arrival) AS f FROM tx GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, f) AS k FROM c) SELECT stream_id, text, n FROM r WHERE k = 1")
def dominant_value(spark, sf):
    return latency.first_mode(X.texts(spark, sf), "stream_id", "text", "arrival")


@query("SELECT round(count(*) FILTER (WHERE user_id % 16 = 0) / count(*) FILTER (WHERE user_id % 16 = 1), 6) AS ratio FROM events")
def ratio_check(spark, sf):
    s = F.col("stream_id")
    return X.events(spark, sf).agg(F.round(F.count_if(s == 0) / F.count_if(s == 1), 6).alias("ratio"))


@query(f"WITH {EV}, n AS (SELECT stream_id, event_id % 100 AS util, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS k FROM ev) SELECT stream_id, round(avg(util), 6) AS util FROM n WHERE k > 10 GROUP BY stream_id")
def utilisation_mean(spark, sf):
    p = X.packets(spark, sf).where("seq > 10")
    return p.groupBy("stream_id").agg(F.round(F.avg(F.col("event_id") % 100), 6).alias("util"))


@query(f"""WITH {DET}, e AS (SELECT stream_id, frame_no, det_idx AS rank, x, y, w, h, score, cls FROM det), a AS (SELECT stream_id, frame_no, det_idx AS rank, x + CASE WHEN event_id % 7 = 0 THEN 0.25 ELSE 0.0625 END AS x, y, w, h, score, cls FROM det WHERE NOT (event_id % 13 = 0 AND det_idx = 0))
SELECT e.stream_id, e.frame_no, bool_and(coalesce(a.cls = e.cls AND a.score = e.score AND abs(a.x - e.x) < 0.1, false)) AS verify_ok, count(*) AS reference_dets FROM e LEFT JOIN a USING (stream_id, frame_no, rank) GROUP BY e.stream_id, e.frame_no""")
def reference_verify(spark, sf):
    d = X.detections(spark, sf).withColumnRenamed("det_idx", "rank")
    moved = d.where("not (event_id % 13 = 0 and rank = 0)").withColumn("x", F.col("x") + F.when(F.col("event_id") % 7 == 0, 0.25).otherwise(0.0625))
    return latency.verify(d, moved)


@query(f"WITH {RES} SELECT stream_id, frame_no, round(ms_ready_to_take - ms_pop_to_ready, 6) AS infer_ms, round(ms_take_to_done - ms_ready_to_take, 6) AS post_ms FROM res WHERE frame_no % 50 = 0")
def trace_deltas(spark, sf):
    r = X.results(spark, sf).where("frame_no % 50 = 0")
    return r.select("stream_id", "frame_no", F.round(F.col("ms_ready_to_take") - F.col("ms_pop_to_ready"), 6).alias("infer_ms"), F.round(F.col("ms_take_to_done") - F.col("ms_ready_to_take"), 6).alias("post_ms"))


# ---- capacity cells (A-13..A-17 A-19..A-21 J-08..J-11 J-16 P-24 P-25 F-13..F-15 G-06 O-04 O-06 U-02) ------------------

BN = "CASE WHEN hold_pct >= 95 THEN 'none(offered-bound)' WHEN nvdec_pct >= 80 THEN 'NVDEC' WHEN sm_pct >= 80 THEN 'GPU-compute' WHEN pre_ms >= 8 AND pre_ms > queue_ms THEN 'producer-threads' WHEN queue_ms >= 8 THEN 'batch-queue' ELSE 'mixed/ramp' END"


@query(f"WITH {CE} SELECT bottleneck, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {BN} AS bottleneck FROM cells) GROUP BY bottleneck")
def bottleneck_census(spark, sf):
    return atlas.census(X.cells(spark, sf).withColumn("bottleneck", atlas.bottleneck())).withColumn("share", F.round("share", 6))


@query(f"WITH {CE} SELECT decode, skip, round(inf_rate, 4) AS inf_rate, max(N) AS max_n FROM cells WHERE hold_pct >= 95 GROUP BY ALL")
def max_n_holding(spark, sf):
    return atlas.max_n_holding(X.cells(spark, sf).withColumn("inf_rate", F.round("inf_rate", 4)))


@query(f"""WITH {CE}, s AS (SELECT gpu_ms AS yy, N * inf_rate AS xx FROM cells WHERE hold_pct >= 90 AND gpu_ms > 0), f AS (SELECT count(*) AS n, regr_intercept(yy, xx) AS a, regr_slope(yy, xx) AS b FROM s)
SELECT n, round(a, 5) AS a, round(b, 6) AS b, round((SELECT sqrt(avg((yy - f.a - f.b * xx) ^ 2)) FROM s), 5) AS rms FROM f WHERE n > 5""")
def ols_fit(spark, sf):
    return atlas.ols(X.cells(spark, sf)).select("n", F.round("a", 5).alias("a"), F.round("b", 6).alias("b"), F.round("rms", 5).alias("rms"))


@query(f"WITH {CE}, r AS (SELECT *, row_number() OVER (PARTITION BY decode ORDER BY decoded_per_s DESC, id) AS k FROM cells WHERE decoded_per_s > 0) SELECT decode, decoded_per_s, nvdec_pct FROM r WHERE k = 1")
def peak_decode(spark, sf):
    return atlas.peak_decode(X.cells(spark, sf), "id")


@query(f"""WITH {CE}, h AS (SELECT version, decode, coalesce(max(N) FILTER (WHERE hold_pct >= 95), 0) AS max_n FROM cells GROUP BY ALL)
SELECT h.version, h.decode, h.max_n, max(gpu_ms) FILTER (WHERE N = max_n AND hold_pct >= 95) AS gpu_ms, coalesce(min(N) FILTER (WHERE N > max_n), -1) AS next_n FROM h JOIN cells c ON c.version = h.version AND c.decode = h.decode GROUP BY ALL""")
def ceiling(spark, sf):
    return atlas.ceiling(X.cells(spark, sf), "version", "decode").withColumn("next_n", F.coalesce("next_n", F.lit(-1)))


@query(f"WITH {CE} SELECT n.N, n.decode, n.skip, o2.hold_pct AS old_hold, n.hold_pct AS new_hold, o2.hold_pct < 95 AND n.hold_pct >= 95 AS gained, o2.hold_pct >= 95 AND n.hold_pct < 95 AS lost FROM (SELECT * FROM cells WHERE version = 1) n JOIN (SELECT * FROM cells WHERE version = 0) o2 USING (N, decode, skip)")
def atlas_compare(spark, sf):
    c = X.cells(spark, sf)
    return atlas.compare(c.where("version = 0"), c.where("version = 1"))


@query(f"WITH {CE} SELECT a.N, a.decode, a.skip, round(b.gpu_ms / a.gpu_ms, 6) AS ratio FROM cells a JOIN cells b USING (N, decode, skip) WHERE a.version = 0 AND b.version = 2 AND a.hold_pct >= 95 AND b.hold_pct >= 95 AND a.gpu_ms > 0")
def latency_pairs(spark, sf):
    c = X.cells(spark, sf).where("hold_pct >= 95")
    a, b = c.where("version = 0 and gpu_ms > 0"), c.where("version = 2").select("N", "decode", "skip", F.col("gpu_ms").alias("other"))
    return a.join(b, ["N", "decode", "skip"]).select("N", "decode", "skip", F.round(F.col("other") / F.col("gpu_ms"), 6).alias("ratio"))


@query(f"""WITH {CE}, gr AS (SELECT CAST(n.range AS INTEGER) AS N, d AS decode, CAST(s.range AS INTEGER) AS skip, round((CASE WHEN d = 'all' THEN 30.0 ELSE 1.0 END) / s.range, 4) AS inf_rate FROM range(1, 101) n, (VALUES ('all'), ('key30')) v(d), range(1, 31) s)
SELECT N, decode, skip, inf_rate FROM gr WHERE inf_rate >= 0.045 AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.N = gr.N AND c.decode = gr.decode AND c.skip = gr.skip)""")
def resume_grid(spark, sf):
    n = spark.range(1, 101).select(F.col("id").cast("int").alias("N"))
    grid = n.select("N", F.explode(F.array(F.lit("all"), F.lit("key30"))).alias("decode")).select("N", "decode", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("skip"))
    grid = grid.withColumn("inf_rate", F.round(F.when(F.col("decode") == "all", 30.0).otherwise(1.0) / F.col("skip"), 4))
    return atlas.todo(grid, X.cells(spark, sf))


@query(f"WITH {CE} SELECT N, round(inf_rate, 3) AS rate, count(*) AS settings, max(hold_pct) AS best_hold FROM cells GROUP BY ALL HAVING count(*) >= 2")
def same_rate_groups(spark, sf):
    return atlas.same_rate(X.cells(spark, sf))


@query(f"WITH {CE} SELECT version, list(nvdec_pct ORDER BY nvdec_pct)[count(*) // 2 + 1] AS nvdec, list(sm_pct ORDER BY sm_pct)[count(*) // 2 + 1] AS sm, max(vram_mb) AS vram FROM cells GROUP BY version")
def utilisation_medians(spark, sf):
    return X.cells(spark, sf).groupBy("version").agg(latency.upper_median("nvdec_pct").alias("nvdec"), latency.upper_median("sm_pct").alias("sm"), F.max("vram_mb").alias("vram"))


@query(f"WITH {CE} SELECT version, round(inf_rate, 2) AS rate, coalesce(max(N) FILTER (WHERE hold_pct >= 95), 0) AS held_n, min(N) AS tested_n FROM cells GROUP BY ALL")
def system_ceilings(spark, sf):
    c = X.cells(spark, sf)
    return c.groupBy("version", F.round("inf_rate", 2).alias("rate")).agg(F.coalesce(F.max(F.when(F.col("hold_pct") >= 95, F.col("N"))), F.lit(0)).alias("held_n"), F.min("N").alias("tested_n"))


# ---- capacity model (R-01..R-10 G-03) ---------------------------------------------------------------------------------


def _grid(spark):
    c = spark.createDataFrame([(s,) for s in (1, 4, 8, 16, 32, 48, 100)], "streams int")
    for name, values in (("resolution", list(capacity.PIXELS)), ("skip", [1, 2, 4]), ("decode", ["all", "key"]), ("tile", [None, 640, 960, 1280]), ("serial", [False, True])):
        c = c.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return c.withColumn("tile", F.col("tile").cast("int")).withColumn("fps", F.lit(30.0)).withColumn("key_gop", F.lit(30)).withColumn("overlap", F.lit(0.2)).withColumn("full_frame", F.lit(True))


REC = """c AS (SELECT s AS streams, r.resolution, k AS skip, d AS decode, t AS tile, se AS serial, pw, ph, base FROM (VALUES (1), (4), (8), (16), (32), (48), (100)) a(s),
(VALUES ('720p', 1280, 720, 1.94::DOUBLE), ('1080p', 1920, 1080, 2.05::DOUBLE), ('1440p', 2560, 1440, 2.06::DOUBLE), ('4k', 3840, 2160, 2.09::DOUBLE)) r(resolution, pw, ph, base), (VALUES (1), (2), (4)) b(k), (VALUES ('all'), ('key')) e(d), (VALUES (NULL), (640), (960), (1280)) f(t), (VALUES (false), (true)) g(se)),
c1 AS (SELECT *, CASE WHEN tile IS NOT NULL THEN (CASE WHEN pw <= tile THEN 1 ELSE ceil((pw - tile) / (tile * 4 // 5)) + 1 END) * (CASE WHEN ph <= tile THEN 1 ELSE ceil((ph - tile) / (tile * 4 // 5)) + 1 END) + 1 END AS tiles, CASE WHEN decode = 'key' THEN 1.0::DOUBLE ELSE 30.0::DOUBLE END AS rate FROM c),
c2 AS (SELECT *, CASE WHEN tile IS NULL THEN base WHEN decode = 'key' THEN 3.185::DOUBLE + 0.482::DOUBLE * tiles WHEN serial THEN 0.998::DOUBLE + 0.49::DOUBLE * tiles ELSE 0.305::DOUBLE + 0.4963::DOUBLE * tiles END AS gpu_ms FROM c1),
c3 AS (SELECT *, streams * (rate / skip) / (1000.0::DOUBLE / gpu_ms) AS gpu, streams * rate / (42.5::DOUBLE * 30 * 921600 / (pw * ph)) AS dec FROM c2)"""


@query(f"""WITH {REC} SELECT streams, resolution, skip, decode, coalesce(tile, 0) AS tile, serial, coalesce(CAST(tiles AS BIGINT), 0) AS tiles, round(gpu_ms, 6) AS gpu_ms, round(gpu, 6) AS gpu_ratio, round(dec, 6) AS nvdec_ratio, gpu <= 1 AND dec <= 1 AS holds_realtime,
CASE WHEN greatest(gpu, dec) < 0.5 THEN 'none' WHEN gpu >= dec THEN 'gpu-inference' ELSE 'nvdec' END AS binding_resource, round(30.0 / greatest(1, gpu, dec), 6) AS offered_fps,
CASE WHEN gpu <= 1 AND dec <= 1 THEN 'holds with ' || CAST(CAST(round_even((1 - greatest(gpu, dec)) * 100, 0) AS INTEGER) AS VARCHAR) || '% headroom'
ELSE 'over capacity: ' || concat_ws(' / ', CASE WHEN gpu > 1 THEN 'raise skip to ' || CAST(CAST(ceil(skip * gpu) AS BIGINT) AS VARCHAR) END, CASE WHEN gpu > 1 AND decode <> 'key' THEN 'use decode="key"' END, CASE WHEN gpu > 1 AND tile < 1280 THEN 'use tile 1280' END,
CASE WHEN dec > 1 THEN 'cut to <= ' || CAST(CAST(greatest(1, floor(streams / dec)) AS BIGINT) AS VARCHAR) || ' streams or use decode="key"' END) END AS suggestion FROM c3""")
def recommend_grid(spark, sf):
    r = capacity.recommend_frame(_grid(spark))
    cols = ["streams", "resolution", "skip", "decode", F.coalesce("tile", F.lit(0)).alias("tile"), "serial", F.coalesce("tiles", F.lit(0)).alias("tiles"), *[F.round(c, 6).alias(c) for c in ("gpu_ms", "gpu_ratio", "nvdec_ratio")], "holds_realtime", "binding_resource", F.round("offered_fps", 6).alias("offered_fps"), "suggestion"]
    return r.select(*cols)


@query(f"WITH {REC} SELECT resolution, round(sum(gpu), 5) AS gpu_ratio, round(sum(dec), 5) AS nvdec_ratio, sum(gpu) <= 1 AND sum(dec) <= 1 AS holds_realtime FROM c3 WHERE streams <= 4 AND tile IS NULL AND NOT serial GROUP BY resolution")
def recommend_mixed_fleet(spark, sf):
    r = capacity.recommend_frame(_grid(spark).where("streams <= 4 and tile is null and not serial"))
    return capacity.mixed_fleet(r, "resolution").select("resolution", F.round("gpu_ratio", 5).alias("gpu_ratio"), F.round("nvdec_ratio", 5).alias("nvdec_ratio"), "holds_realtime")


# ---- delivery (K-01 K-05 K-10 K-12 K-14 J-14) -------------------------------------------------------------------------


@query(f"""WITH {RES}, l AS (SELECT event_id, stream_id, frame_no FROM res WHERE stream_id = 3) SELECT event_id, stream_id AS stream, frame_no AS frame, r.batch_seq AS batch, round(r.ms_pop_to_ready, 3) AS pre, round(r.ms_take_to_done, 3) AS gpu, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 6 END AS n_dets, 't"' || CAST(event_id % 9 AS VARCHAR) AS text
FROM l JOIN res r USING (event_id, stream_id, frame_no)""")
def event_ndjson(spark, sf):
    """Lines for one sink, parsed again."""
    r = delivery.for_sink(X.results(spark, sf), 3).join(X.dense(spark, sf).select("event_id", F.col("dets").alias("detections")), "event_id")
    r = r.withColumn("texts", F.array(F.concat(F.lit('t"'), (F.col("event_id") % 9).cast("string")))).withColumn("frame_addr", F.hex("event_id"))
    line = r.select("event_id", delivery.event_line().alias("line"))
    kind = "struct<stream:int,frame:int,batch:bigint,dets:array<struct<x:double,cls:int>>,texts:array<string>,ms:struct<pre:double,gpu:double>>"
    p = line.select("event_id", F.from_json("line", kind).alias("j"))
    return p.select("event_id", "j.stream", "j.frame", "j.batch", F.col("j.ms.pre").alias("pre"), F.col("j.ms.gpu").alias("gpu"), F.size("j.dets").alias("n_dets"), F.col("j.texts")[0].alias("text"))


@query(f"""WITH {DET} SELECT stream_id, frame_no, -1 AS det_idx, 'F ' || stream_id || ' ' || frame_no || ' ' || count(*) AS line FROM det GROUP BY stream_id, frame_no UNION ALL
SELECT stream_id, frame_no, det_idx, concat_ws(' ', stream_id, frame_no, cls, score, x, y, w, h) FROM det""")
def detection_dump(spark, sf):
    return delivery.dump_lines(X.detections(spark, sf))


@query(f"""WITH {DET}, l AS (SELECT stream_id, frame_no, det_idx, concat_ws(',', det_idx, cls, CAST(round(score, 3) AS DECIMAL(10, 3)), CAST(round(x, 1) AS DECIMAL(12, 1)), CAST(round(y, 1) AS DECIMAL(12, 1)), CAST(round(w, 1) AS DECIMAL(12, 1)), CAST(round(h, 1) AS DECIMAL(12, 1))) AS s FROM det),
f AS (SELECT stream_id, frame_no, sha256(string_agg(s, chr(10) ORDER BY det_idx)) AS d FROM l GROUP BY ALL) SELECT stream_id, count(*) AS frames, sha256(string_agg(d, chr(10) ORDER BY frame_no)) AS digest FROM f GROUP BY stream_id""")
def determinism_digest(spark, sf):
    return delivery.digest(X.detections(spark, sf))


@query(f"""WITH {TX}, a AS (SELECT stream_id, text FROM tx), b AS (SELECT stream_id, text FROM tx WHERE arrival % 10 <> 0 UNION ALL SELECT stream_id, text FROM tx WHERE arrival % 25 = 0)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_difference(spark, sf):
    t = X.texts(spark, sf)
    c = ["stream_id", "text"]
    return delivery.multiset_difference(t.select(c), t.where("arrival % 10 <> 0").select(c).unionByName(t.where("arrival % 25 = 0").select(c)))


@query(f"WITH {RES} SELECT r.stream_id, r.frame_no, p.size FROM res r JOIN packets p ON p.stream_id = r.stream_id AND p.seq = r.frame_no WHERE (r.frame_no + r.stream_id) % 10 = 0")
def fetch_frame(spark, sf):
    """Frame memory as a join back to the frames' data."""
    r = sampling.skip_sample(X.results(spark, sf), 10).select("stream_id", F.col("frame_no").cast("long").alias("seq"), "frame_no")
    return r.join(X.packets(spark, sf).select("stream_id", "seq", "size"), ["stream_id", "seq"]).select("stream_id", "frame_no", "size")


# ---- manifests, logs, text scans (S-12 S-13 S-15 F-19 J-17 U-06 P-28 P-29 W-13 K-16) ----------------------------------


@query("""WITH n AS (SELECT 's' || CAST(c_custkey % 500 AS VARCHAR) AS slug, max(c_custkey) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), o AS (SELECT 's' || CAST(c_custkey % 500 AS VARCHAR) AS slug, min(c_custkey) AS v FROM customer GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE slug NOT IN (SELECT slug FROM n)""")
def manifest_upsert(spark, sf):
    c = X.table(spark, sf, "customer").withColumn("slug", F.concat(F.lit("s"), (F.col("c_custkey") % 500).cast("string")))
    return files.upsert(c.groupBy("slug").agg(F.min("c_custkey").alias("v")), c.where("c_custkey % 3 = 0").groupBy("slug").agg(F.max("c_custkey").alias("v")))


@query("SELECT s.s_suppkey AS cam, coalesce(p.o, 0.0) AS offset_s, coalesce(p.f, 0) AS frames, p.o IS NULL AS deviation FROM supplier s LEFT JOIN (SELECT p_partkey AS k, p_size / 2.0::DOUBLE AS o, p_size * 30 AS f FROM part WHERE p_partkey % 3 = 0) p ON p.k = s.s_suppkey")
def manifest_join(spark, sf):
    p = X.table(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey as cam", "p_size / 2.0d as o", "p_size * 30 as f")
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cam"))
    return s.join(p, "cam", "left").select("cam", F.coalesce("o", F.lit(0.0)).alias("offset_s"), F.coalesce("f", F.lit(0)).alias("frames"), F.col("o").isNull().alias("deviation"))


@query("WITH s AS (SELECT c_custkey AS slug, c_custkey % 100 AS mtime, 30 AS gop FROM customer), o AS (SELECT c_custkey AS slug, c_custkey % 37 + 40 AS om, CASE WHEN c_custkey % 11 = 0 THEN 60 ELSE 30 END AS og FROM customer WHERE c_custkey % 5 <> 0) SELECT s.slug FROM s LEFT JOIN o USING (slug) WHERE om IS NULL OR mtime >= om OR gop <> og")
def incremental_skip(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"))
    s = c.withColumn("mtime", F.col("slug") % 100).withColumn("gop", F.lit(30))
    o = c.where("slug % 5 <> 0").withColumn("mtime", F.col("slug") % 37 + 40).withColumn("gop", F.when(F.col("slug") % 11 == 0, 60).otherwise(30))
    return files.stale(s, o).select("slug")


@query("SELECT CAST(round_even(avg(coalesce(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 60 END, 30)), 0) AS INTEGER) AS gop FROM supplier")
def mean_gop(spark, sf):
    return files.mean_gop(X.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 60).cast("int").alias("gop")))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN CAST(p_size AS VARCHAR) || '/0' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.5' ELSE 'n/a' END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 29.97::DOUBLE WHEN 1 THEN CAST(split_part(s, '/', 1) AS DOUBLE) WHEN 2 THEN CAST(s AS DOUBLE) ELSE 0.0::DOUBLE END AS fps FROM t""")
def frame_rate_parse(spark, sf):
    s = F.expr("case p_partkey % 4 when 0 then '30000/1001' when 1 then concat(cast(p_size as string), '/0') when 2 then concat(cast(p_size as string), '.5') else 'n/a' end")
    return X.table(spark, sf, "part").select("p_partkey", files.frame_rate(s).alias("fps"))


@query(f"""WITH {EV} SELECT stream_id AS source, CAST(event_id AS INTEGER) AS frame_num, round(event_id % 40 / 10.0, 4) AS frame_ms, CASE WHEN event_id % 2 = 0 THEN round(event_id % 7 / 10.0, 4) ELSE -1.0 END AS decode_ms, round(event_id % 9 / 10.0, 4) AS infer_ms FROM ev""")
def log_pairing(spark, sf):
    """Log lines made from events, then parsed: one or two component lines before each frame line."""
    e = X.events(spark, sf)
    lines = F.array_compact(
        F.array(
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Comp name = decode in_system_timestamp = 1 component_latency= "), ((F.col("event_id") % 7) / 10.0).cast("string"))),
            F.concat(F.lit("Comp name = infer in_system_timestamp = 1 component_latency= "), ((F.col("event_id") % 9) / 10.0).cast("string")),
            F.concat(F.lit("Source id = "), F.col("stream_id").cast("string"), F.lit(" Frame_num = "), F.col("event_id").cast("string"), F.lit(" Frame latency = "), ((F.col("event_id") % 40) / 10.0).cast("string"), F.lit(" (ms)")),
        )
    )
    log = e.select((F.col("event_id") % 8).cast("int").alias("log"), "event_id", F.posexplode(lines).alias("i", "value")).select("log", (F.col("event_id") * 4 + F.col("i")).alias("no"), "value")
    f = files.latency_frames(log)
    part = lambda name: F.coalesce(F.get(F.filter("components", lambda c: c["name"] == name), 0)["ms"], F.lit(-1.0))
    return f.select("source", "frame_num", "frame_ms", part("decode").alias("decode_ms"), part("infer").alias("infer_ms"))


@query("WITH l AS (SELECT s_suppkey, 'c' || CAST(s_suppkey % 30 AS VARCHAR) AS key, CAST(s_suppkey * 2 AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 10 <> 0) SELECT key, arg_max(value, s_suppkey) AS value FROM l GROUP BY key")
def key_value_scan(spark, sf):
    line = F.expr("case when s_suppkey % 10 = 0 then 'short' else concat('  c', cast(s_suppkey % 30 as string), '\t', cast(s_suppkey * 2 as string), ' more') end")
    return files.key_values(X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("no"), line.alias("value")))


# ---- totals and displays (A-03 A-11 A-12 A-18 A-24 A-27 A-28 A-30 F-12 F-15 F-17 G-06 J-02 K-13 K-16 O-04 O-06 O-07 P-25 S-16) ------


@query(f"WITH {VE}, l AS (SELECT vec_id, CASE label WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 5 THEN 'car' ELSE 'imagenet_' || CAST(label AS VARCHAR) END AS name FROM ve) SELECT name, count(*) AS n, min(vec_id) AS first_seen FROM l GROUP BY name ORDER BY n DESC, first_seen LIMIT 10")
def label_topk(spark, sf):
    names = label_names(spark, sf)
    return consumers.top_values(names, "name", 10, "vec_id")


@query(f"WITH {TX}, p AS (SELECT stream_id, arrival // 4 AS frame, count(*) FILTER (WHERE text <> '') AS n FROM tx GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS plates, count(*) AS frames, round(avg(n), 6) AS per_frame, max(n) AS most FROM p")
def plates_read(spark, sf):
    t = X.texts(spark, sf).withColumn("frame", F.expr("arrival div 4"))
    return latency.plates(t, ["stream_id", "frame"]).withColumn("per_frame", F.round("per_frame", 6))


@query(f"""WITH {DET}, e AS (SELECT stream_id, frame_no, det_idx AS rank, x, cls, score FROM det), a AS (SELECT stream_id, frame_no, det_idx AS rank, x + CASE WHEN event_id % 7 = 0 THEN 0.25 ELSE 0.0625 END AS x, cls, score FROM det WHERE NOT (event_id % 13 = 0 AND det_idx = 0)),
v AS (SELECT bool_and(coalesce(a.cls = e.cls AND a.score = e.score AND abs(a.x - e.x) < 0.1, false)) AS ok FROM e LEFT JOIN a USING (stream_id, frame_no, rank) GROUP BY e.stream_id, e.frame_no)
SELECT count(*) AS verified, count(*) FILTER (WHERE ok) AS passed, round(count(*) FILTER (WHERE ok) / count(*), 6) AS share FROM v""")
def verify_share(spark, sf):
    return latency.verify_ratio(reference_verify(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"""WITH {RES}, s AS (SELECT *, ms_pop_to_ready + ms_ready_to_take + ms_take_to_done AS total FROM res WHERE frame_no >= 60)
SELECT stream_id, stream_id IS NULL AS pooled, count(*) AS n, round(median(ms_pop_to_ready), 6) AS decode, round(median(ms_ready_to_take), 6) AS queue, round(median(ms_take_to_done), 6) AS gpu, round(median(total), 6) AS total FROM s GROUP BY GROUPING SETS ((stream_id), ())""")
def pooled_medians(spark, sf):
    r = latency.warmed(X.results(spark, sf)).withColumn("all_ms", latency.end_to_end())
    m = latency.medians(r, "stream_id", {"decode": "ms_pop_to_ready", "queue": "ms_ready_to_take", "gpu": "ms_take_to_done", "total": "all_ms"})
    return m.select("stream_id", "pooled", "n", *[F.round(c, 6).alias(c) for c in ("decode", "queue", "gpu", "total")])


@query(f"""WITH {RES}, c AS (SELECT 0 AS layer, 'read' AS name, (event_id % 31) / 10.0::DOUBLE AS ms FROM res UNION ALL SELECT 1, 'classify', (event_id % 17) / 10.0::DOUBLE FROM res)
SELECT CAST(layer AS INTEGER) AS layer, name, count(*) AS frames, round(avg(ms), 6) AS ms_gpu FROM c GROUP BY ALL""")
def child_gpu_means(spark, sf):
    r = X.results(spark, sf).selectExpr("array(named_struct('name', 'read', 'ms_gpu', (event_id % 31) / 10.0d), named_struct('name', 'classify', 'ms_gpu', (event_id % 17) / 10.0d)) as children")
    return latency.child_gpu_means(r).withColumn("ms_gpu", F.round("ms_gpu", 6))


@query(f"WITH {DET}, p AS (SELECT f.stream_id, f.frame_no, count(d.score) AS n FROM frames f LEFT JOIN (SELECT * FROM det WHERE score >= 0.4) d USING (stream_id, frame_no) GROUP BY ALL) SELECT n AS detections, count(*) AS frames FROM p GROUP BY n ORDER BY frames DESC, n LIMIT 5")
def top_counts(spark, sf):
    return latency.top_counts(X.detections(spark, sf).where("score >= 0.4"), X.frames(spark, sf), ["stream_id", "frame_no"])


@query(f"""WITH {RES}, p AS (SELECT stream_id, count(*) / nullif((max(pts_us) - min(pts_us)) / 1e6, 0) AS per_s, avg(ms_pop_to_ready) AS pre, avg(ms_ready_to_take) AS queue, avg(ms_take_to_done) AS gpu FROM res GROUP BY stream_id)
SELECT count(*) AS streams, round(sum(per_s), 9) AS per_s, round(avg(pre), 6) AS pre_ms, round(avg(queue), 6) AS queue_ms, round(avg(gpu), 6) AS gpu_ms FROM p""")
def aggregate_rates(spark, sf):
    r = latency.aggregate_rates(X.results(spark, sf))
    return r.select("streams", F.round("per_s", 9).alias("per_s"), *[F.round(c, 6).alias(c) for c in ("pre_ms", "queue_ms", "gpu_ms")])


@query(f"WITH {RES} SELECT stream_id, count(*) AS n, round(avg(ms_take_to_done), 6) AS gpu_ms FROM res WHERE pts_us >= (SELECT min(pts_us) FROM res) + 86400000000 GROUP BY stream_id")
def warmup_by_time(spark, sf):
    return latency.warmed_by_time(X.results(spark, sf), 86_400).groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.avg("ms_take_to_done"), 6).alias("gpu_ms"))


@query(f"""WITH {TX}, {VE} SELECT 'ctc' AS family, count(*) FILTER (WHERE text <> '') AS n FROM tx UNION ALL SELECT 'argmax', count(*) FILTER (WHERE label % 3 <> 0) FROM ve UNION ALL SELECT 'embedding', count(*) FILTER (WHERE vec_id % 4 <> 0) FROM ve""")
def routed_test(spark, sf):
    """Answers told from defaults: texts, scores of 0, empty vectors."""
    v = X.vectors(spark, sf)
    scores = v.select(F.when(F.col("label") % 3 == 0, 0.0).otherwise(0.5).alias("score"))
    rows = v.select(F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("vector"))
    parts = [("ctc", X.texts(spark, sf)), ("argmax", scores), ("embedding", rows)]
    out = [latency.routed(d, f).agg(F.count("*").alias("n")).select(F.lit(f).alias("family"), "n") for f, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {CE}, gr AS (SELECT N, round(inf_rate, 3) AS rate, count(*) AS settings, string_agg(decode || '(nvdec ' || nvdec_pct || '%, hold ' || hold_pct || '%)', ' | ' ORDER BY decoded_per_s DESC, decode, nvdec_pct, hold_pct) AS line FROM cells WHERE N IN (32, 50, 75, 100) GROUP BY ALL HAVING count(*) >= 2)
SELECT N, rate, settings, line FROM gr ORDER BY N, rate DESC LIMIT 20""")
def shown_groups(spark, sf):
    return atlas.shown_groups(X.cells(spark, sf))


@query(f"WITH {CE} SELECT CAST(row_number() OVER (ORDER BY decode, N, skip, version) AS INTEGER) AS place, version, N, decode, skip FROM cells ORDER BY place LIMIT 500")
def cells_in_order(spark, sf):
    """Cells with N and skip as texts, as a CSV gives them, in the order of their numbers; the first 500 as a report."""
    c = X.cells(spark, sf).select("version", F.col("N").cast("string"), "decode", F.col("skip").cast("string"))
    first = atlas.in_order(c.repartitionByRange("decode", "N")).orderBy("decode", F.col("N").cast("int"), F.col("skip").cast("int"), "version").limit(500)
    place = F.row_number().over(Window.orderBy("decode", F.col("N").cast("int"), F.col("skip").cast("int"), "version"))
    return first.select(place.alias("place"), "version", F.col("N").cast("int").alias("N"), "decode", F.col("skip").cast("int").alias("skip"))


_FULL = """g AS (SELECT CAST(n AS INTEGER) AS N, d AS decode, CAST(k AS INTEGER) AS skip, gop, round(rate / k, 4) AS inf_rate, round(rate * n, 1) AS offered_per_s FROM (VALUES (1), (4), (8), (16), (32), (50), (75), (100)) a(n),
(VALUES ('all', 30, 30.0::DOUBLE), ('key15', 15, 2.0::DOUBLE), ('key30', 30, 1.0::DOUBLE), ('key60', 60, 0.5::DOUBLE), ('key150', 150, 0.2::DOUBLE)) b(d, gop, rate), (VALUES (1), (2), (3), (4), (6), (8), (12), (15), (24), (30), (45), (60), (90), (150)) c(k))"""


@query(f"WITH {_FULL} SELECT 'full' AS mode, * FROM g WHERE inf_rate >= 0.045 UNION ALL SELECT 'mini', * FROM g WHERE skip IN (1, 2, 3, 6, 15) AND ((decode = 'all' AND N IN (1, 4, 8, 16)) OR (decode = 'key30' AND N IN (16, 32)) OR (decode = 'key150' AND N = 32)) AND (skip = 1 OR (N <> 1 AND decode = 'all'))")
def capacity_grid(spark, sf):
    parts = [atlas.grid(spark, mode, "4k").select(F.lit(mode).alias("mode"), "N", "decode", "skip", "gop", "inf_rate", "offered_per_s") for mode in ("full", "mini")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {VE}, u AS (SELECT vec_id AS arrival, stream_id, list_transform(embedding, lambda v: v::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) + 1e-9)) AS v FROM ve),
p AS (SELECT q.stream_id, q.arrival, g.stream_id AS other, g.arrival AS seen, q.v AS a, g.v AS b FROM u q JOIN u g ON g.stream_id <> q.stream_id AND g.arrival < q.arrival AND g.arrival >= q.arrival - 48 * 16),
n AS (SELECT stream_id, arrival, other, seen, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) AS cosine, row_number() OVER (PARTITION BY arrival, other ORDER BY seen DESC) AS age FROM p),
k AS (SELECT * FROM n WHERE age <= 20), m AS (SELECT *, row_number() OVER (PARTITION BY arrival, other ORDER BY cosine DESC, seen) AS r FROM k)
SELECT stream_id, arrival, other, cosine, seen FROM m WHERE r = 1 AND cosine >= 0.3 ORDER BY arrival, other LIMIT 10""")
def first_matches(spark, sf):
    """The first ten re-identifications by arrival, as a report shows them."""
    return reid_top1(spark, sf).orderBy("arrival", "other").limit(10)


@query(f"""WITH {FR}, s AS (SELECT DISTINCT width, height FROM frames),
ox AS (SELECT DISTINCT width, least(i * 512, greatest(width - 640, 0)) AS x FROM s, range(0, 10) t(i) WHERE i * 512 < width - 640 + 512),
oy AS (SELECT DISTINCT height, least(i * 512, greatest(height - 640, 0)) AS y FROM s, range(0, 10) t(i) WHERE i * 512 < height - 640 + 512)
SELECT stream_id, frame_no, count(*) AS tiles, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM frames JOIN ox USING (width) JOIN oy USING (height) WHERE frame_no % 10 = 0 GROUP BY ALL""")
def frame_tiles(spark, sf):
    """Every tenth frame with the tiles of its size: the grid is made once a size."""
    t = G.with_tiles(X.frames(spark, sf).where("frame_no % 10 = 0"), 640, 0.2, full_frame=False)
    return t.groupBy("stream_id", "frame_no").agg(F.count("*").alias("tiles"), F.sum("tile.x").alias("xs"), F.sum("tile.y").alias("ys"))


@query("SELECT 's' || CAST(c_custkey AS VARCHAR) || chr(9) || 'live/' || CAST(c_custkey AS VARCHAR) || chr(9) || CAST(c_custkey AS VARCHAR) || '.mp4' AS line FROM customer WHERE c_custkey % 3 = 1")
def manifest_tsv(spark, sf):
    k = F.col("c_custkey").cast("string")
    scenario = F.concat(F.lit("s0"), (F.col("c_custkey") % 3).cast("string"))
    m = X.table(spark, sf, "customer").select(F.concat(F.lit("s"), k).alias("slug"), F.concat(F.lit("live/"), k).alias("rtsp_path"), F.concat(k, F.lit(".mp4")).alias("file"), scenario.alias("scenario"))
    return files.manifest_lines(m, ["S01"])


@query(f"""WITH {EV}, c AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, (row_number() OVER (ORDER BY event_id) - 1) * 40000 AS pts FROM ev), s AS (SELECT max(pts) + 1 AS span FROM c),
m AS (SELECT k AS stream_id, seq AS clip_seq, ((pts - k * 1000000) % span + span) % span AS place FROM c, s, range(0, 3) r(k)) SELECT CAST(stream_id AS INTEGER) AS stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY place) AS BIGINT) AS seq, clip_seq, CAST(place AS BIGINT) AS pts_us FROM m""")
def staggered_fleet(spark, sf):
    """One clip as three streams, each a second further into it."""
    from .operators.ordered import numbered

    clip = numbered(X.events(spark, sf).select(F.lit(0).alias("clip"), "event_id"), ["clip"], "event_id", "seq").select("seq", ((F.col("seq") - 1) * 40_000).alias("pts_us"))
    return files.fleet(clip.withColumn("clip_seq", F.col("seq").cast("long")).withColumn("arrival_us", F.col("pts_us")), 3, 1_000_000).select("stream_id", F.col("seq").cast("long").alias("seq"), "clip_seq", "pts_us")


def _tile_model(c):
    """A stand-in for a detector: a head of two anchors and two classes from the frame's number and the tile's place."""
    at = c["data"] * 7 + c["tile"]["x"] * 3 + c["tile"]["y"] * 5 + c["tile"]["w"]
    lit = lambda e: e.cast("double")
    rows = [60 + at % 500, 64 + at % 500, 200 + at % 240, 206 + at % 230, 40 + at % 60, 42 + at % 60, 50 + at % 50, 48 + at % 50]
    return F.array(*map(lit, rows), (at % 10) / 10.0, (at % 7) / 10.0, (at % 9) / 10.0, (at % 11) / 12.0)


def _tiled() -> str:
    """The frames' boxes by tile in SQL: the head above, decoded within its tile and moved to its place."""
    ch = {k: f"(CASE WHEN i = 0 THEN {a} ELSE {b} END)" for k, (a, b) in {"cx": ("60 + pos % 500", "64 + pos % 500"), "cy": ("200 + pos % 240", "206 + pos % 230"), "bw": ("40 + pos % 60", "42 + pos % 60"), "bh": ("50 + pos % 50", "48 + pos % 50"), "s0": ("(pos % 10) / 10.0::DOUBLE", "(pos % 7) / 10.0::DOUBLE"), "s1": ("(pos % 9) / 10.0::DOUBLE", "(pos % 11) / 12.0::DOUBLE")}.items()}
    return f"""fs AS (SELECT event_id, stream_id, frame_no, width, height FROM frames WHERE frame_no % 25 = 0 AND stream_id % 4 = 0),
tl AS (SELECT event_id, width, height, -1 AS tile, 0 AS tx, 0 AS ty, width AS tw, height AS th, 0.5::DOUBLE AS scale, 0 AS px, CAST(floor((640 - floor(height * 0.5::DOUBLE)) / 2) AS INTEGER) AS py FROM fs
  UNION ALL SELECT event_id, width, height, CAST(r.k * 3 + q.k AS INTEGER), least(q.k * 512, 640), least(r.k * 512, 80), 640, 640, 1.0::DOUBLE, 0, 0 FROM fs, (VALUES (0), (1), (2)) q(k), (VALUES (0), (1)) r(k)),
a0 AS (SELECT *, event_id * 7 + tx * 3 + ty * 5 + tw AS pos FROM tl), a1 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in ch.items())} FROM a0, range(0, 2) z(i)),
a2 AS (SELECT *, greatest(s0, s1, 0) AS score, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS cls, (cx - bw / 2.0::DOUBLE - px) / scale AS x0, (cy - bh / 2.0::DOUBLE - py) / scale AS y0 FROM a1),
a3 AS (SELECT *, least(greatest(x0, 0), tw) AS ax, least(greatest(y0, 0), th) AS ay, least(greatest(x0 + bw / scale, 0), tw) AS bx, least(greatest(y0 + bh / scale, 0), th) AS by2 FROM a2 WHERE score >= 0.3),
bt AS (SELECT event_id * 100 + tile + 1 AS event_id, tile, ax + tx AS x, ay + ty AS y, greatest(bx - ax, 0) AS w, greatest(by2 - ay, 0) AS h, score, cls FROM a3)"""


@query(f"""WITH RECURSIVE {FR}, {_tiled()}, {nms_sql('bt', 0.45, 'q', ', y, w, h')}, sv AS (SELECT event_id // 100 AS event_id, unnest(kept) AS d FROM qf),
fl AS (SELECT event_id, d.x AS x, d.y AS y, d.w AS w, d.h AS h, d.score AS score, d.cls AS cls FROM sv), {nms_sql('fl', 0.5, 'm', ', y, w, h')}, u AS (SELECT event_id, unnest(kept) AS d, generate_subscripts(kept, 1) AS i FROM mf)
SELECT f.stream_id, f.frame_no, CAST(i - 1 AS INTEGER) AS rank, round(d.x, 4) AS x, round(d.y, 4) AS y, round(d.w, 4) AS w, round(d.h, 4) AS h, round(d.score, 6) AS score, d.cls AS cls FROM u JOIN fs f USING (event_id)""")
def pipeline_sahi(spark, sf):
    """A compiled pipeline with tiles over the cameras of 1280 by 720, every 25th frame."""
    from .graph import Engine, Layer, Pipeline, Postprocess, Process, Streams

    streams, layer = Streams([f"rtsp://camera/{i}" for i in range(16)]), Layer("detect", sahi={})
    layer.add(Postprocess(layer.add(Engine(layer.add(Process(streams)), _tile_model)), "yolo", score=0.3))
    p = Pipeline(streams, [layer])
    frames = X.frames(spark, sf).where("frame_no % 25 = 0 and stream_id % 4 = 0").withColumn("data", F.col("event_id"))
    d = p.detections(frames, anchors=2, classes=2).select("stream_id", "frame_no", F.posexplode("detections").alias("rank", "d"))
    return d.select("stream_id", "frame_no", "rank", *[F.round(f"d.{c}", 4).alias(c) for c in "xywh"], F.round("d.score", 6).alias("score"), "d.cls")


def sampled_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: which classes are seen how often in the sampled frames of each camera, after suppression."""
    kept = sampling.sampled(X.packets(spark, sf), X.streams(spark)).select("event_id", "stream_id")
    d = X.dense(spark, sf).drop("stream_id").join(kept, "event_id").select("stream_id", F.explode(nms.suppress(F.filter("dets", lambda x: x["score"] >= 0.4), 0.3)).alias("d"))
    return d.groupBy("stream_id", F.col("d.cls").alias("cls")).agg(F.count("*").alias("n"))


query(f"""WITH RECURSIVE {PK}, {ST}, q AS (SELECT p.event_id, p.stream_id, coalesce(skip, 1) AS skip, row_number() OVER (PARTITION BY p.stream_id ORDER BY seq) AS frame_no FROM packets p JOIN st USING (stream_id) WHERE coalesce(decode, 'all') <> 'key' OR keyframe),
kp AS (SELECT event_id, stream_id FROM q WHERE (frame_no + stream_id) % skip = 0), {DENSE}, ds AS (SELECT * FROM dn WHERE score >= 0.4), {nms_sql('ds', 0.3)}, u AS (SELECT event_id, unnest(kept) AS d FROM nf)
SELECT stream_id, d.cls AS cls, count(*) AS n FROM u JOIN kp USING (event_id) GROUP BY ALL""")(sampled_detections)
