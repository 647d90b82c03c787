"""What consumers compute over result rows (F-09 J-05..J-07 J-13 W-03..W-07 A-01..A-04 A-22..A-26 N-10 N-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon
from ..materialise import cut
from .ordered import RANGE, SPAN, carried, inside, neighbours, over_ranges, ranged, streamed


def top_values(rows: DataFrame, column: str, k: int, arrival: str) -> DataFrame:
    """The k most frequent values, the earlier seen first among equals. Partial sums before the shuffle; a heap for the top."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(arrival).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def zone_hits(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Detections in the zones of their stream, by the box's centre. zones (stream_id, zone, polygon) is a declared list and broadcast."""
    cx, cy = F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0
    side = lambda pick, c: pick(F.transform("polygon", lambda p: p[c]))
    bounds = [side(f, c).alias(n) for n, f, c in (("_x0", F.array_min, "x"), ("_x1", F.array_max, "x"), ("_y0", F.array_min, "y"), ("_y1", F.array_max, "y"))]
    z = zones.select(F.col("stream_id").alias("_s"), "zone", "polygon", *bounds)
    # The bounding box first: it is cheap and most pairs end there.
    near = cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))
    j = detections.join(F.broadcast(z), F.col("stream_id") == F.col("_s")).where(near & in_polygon(cx, cy, F.col("polygon")))
    return j.drop("_s", "polygon", "_x0", "_x1", "_y0", "_y1")


def zone_events(frames: DataFrame, hits: DataFrame, span: int = SPAN) -> DataFrame:
    """ENTER and LEAVE of each zone, frame by frame, with the running count of detections in it.

    Only frames with hits are looked at: a zone is entered at a frame with hits if the frame before it in the stream has none, and left at
    the frame after one with hits if that has none. So frames are joined with their neighbours, never with all zones.
    """
    f = neighbours(frames.select("stream_id", "frame_no"), ["stream_id"], "frame_no", span)
    # Hits are costly and what is kept of them is small, so they are found once.
    per = cut(hits.groupBy("stream_id", "zone", "frame_no").agg(F.count("*").alias("inside")).join(f, ["stream_id", "frame_no"]))
    key = ["stream_id", "zone"]
    state = [
        F.last("_last").over(over_ranges(key)).alias("_b"), F.last("_first").over(over_ranges(key, back=True)).alias("_a"),
        F.coalesce(F.sum("_sum").over(over_ranges(key)), F.lit(0)).alias("_s"),
    ]
    per = carried(ranged(per, "frame_no", span), key, {"_first": F.min("frame_no"), "_last": F.max("frame_no"), "_sum": F.sum("inside")}, lambda _: state)
    w = inside(key, "frame_no")
    per = per.withColumn("_hit_before", F.coalesce(F.lag("frame_no").over(w), "_b")).withColumn("_hit_after", F.coalesce(F.lead("frame_no").over(w), "_a"))
    per = per.withColumn("total", F.col("_s") + F.sum("inside").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    enter = F.when(F.col("_hit_before").isNull() | (F.col("_hit_before") < F.col("before")), F.struct(F.col("frame_no").alias("frame_no"), F.lit("ENTER").alias("event")))
    leave = F.when(F.col("after").isNotNull() & (F.col("_hit_after").isNull() | (F.col("_hit_after") > F.col("after"))), F.struct(F.col("after").alias("frame_no"), F.lit("LEAVE").alias("event")))
    found = per.select("stream_id", "zone", F.explode(F.array_compact(F.array(enter, leave))).alias("e"), "total")
    return found.select("stream_id", "zone", "e.frame_no", "e.event", F.col("total").cast("long").alias("total"))


def cross_stream_matches(vectors: DataFrame, gallery: int = 50, least: float = 0.85, bucket: int | None = None) -> DataFrame:
    """Re-identification: for each vector (stream_id, arrival, v: unit vector) and each other stream, the best cosine with that stream's last
    `gallery` vectors before it, if at least `least`.

    A vector is in the gallery of its stream from its own arrival up to that of the stream's gallery-th next one, so the join is a range
    join on arrival; both sides are dealt to ranges of arrival of `bucket` width, a vector to all it lives in.
    """
    w = Window.partitionBy("stream_id").orderBy("arrival")
    lived = vectors.withColumn("until", F.lead("arrival", gallery).over(w))
    width = bucket or 1000
    top = F.floor(F.coalesce("until", F.col("last")) / width)
    ends = vectors.agg(F.max("arrival").alias("last"))
    g = lived.join(F.broadcast(ends)).select(F.col("stream_id").alias("other"), F.col("arrival").alias("seen"), "until", F.col("v").alias("u"), F.explode(F.sequence(F.floor(F.col("arrival") / width), top)).alias("b"))
    q = vectors.withColumn("b", F.floor(F.col("arrival") / width))
    cosine = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    live = (F.col("seen") < F.col("arrival")) & (F.col("until").isNull() | (F.col("until") >= F.col("arrival"))) & (F.col("other") != F.col("stream_id"))
    scored = q.join(g, "b").where(live).select("stream_id", "arrival", "other", "seen", F.round(cosine, 6).alias("cosine"))
    best = scored.groupBy("stream_id", "arrival", "other").agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "seen")).alias("m"))
    return best.select("stream_id", "arrival", "other", (-F.col("m.neg")).alias("cosine"), F.col("m.seen").alias("seen")).where(F.col("cosine") >= least)


def ema(values: Column, alpha: float = 0.05) -> Column:
    """Exponential mean of an array in order; the first value seeds, as does any value that finds the mean at exactly 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: F.when(a == 0, v).otherwise(a * (1 - alpha) + v * alpha))


def last_emas(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(keys, ema): the mean that `ema` has after a key's last row; values are 0 or more, and order counts a key's rows (frame_no).

    With such values the mean is exactly 0 only before the first positive one, which seeds it; from there on it is a weighted sum,
    which partial sums add up like any other.
    """
    seed = rows.where(F.col(value) > 0).groupBy(*keys).agg(F.min(order).alias("_seed"))
    last = rows.groupBy(*keys).agg(F.max(order).alias("_last")).join(seed, keys, "left")
    r = rows.join(last, keys).where(F.col("_seed").isNull() | (F.col(order) >= F.col("_seed")))
    weight = F.pow(F.lit(1 - alpha), F.col("_last") - F.col(order)) * F.when(F.col(order) == F.col("_seed"), 1.0).otherwise(alpha)
    return r.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * weight).alias("ema"))


def counter_rates(samples: DataFrame, value: str = "value") -> DataFrame:
    """Per-second rate between samples (key, generation, t, value) of a counter that restarts with each generation."""
    w = Window.partitionBy("key", "generation").orderBy("t")
    dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(0.001))
    return samples.withColumn("rate", (F.col(value) - F.lag(value).over(w)) / dt)


def nearest(left: DataFrame, right: DataFrame, tolerance: int, span: int = SPAN) -> DataFrame:
    """As-of join: per row of left (key, id, t) the row of right (key, rid, rt) nearest in time if within tolerance, else the newest of the key.

    Equally near: the earlier, then the smaller rid. One union, dealt by key and range of time; ranges are so wide that they hold about
    `span` rows where times are spread evenly. Within a range two running windows, both from the past (a frame that runs to
    the end of a partition takes the square of its rows); the ranges' first and last right rows are carried to the others.
    Rows without key or time are left out.
    """
    u = left.select("key", F.col("t").alias("at"), F.col("id"), F.lit(None).cast("long").alias("rid"), F.lit(1).alias("side")).unionByName(
        right.select("key", F.col("rt").alias("at"), F.lit(None).cast("long").alias("id"), "rid", F.lit(0).alias("side"))
    )
    u = u.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    spread = u.agg(F.min("at").alias("_lo"), F.greatest(F.lit(1.0), (F.max("at") - F.min("at") + 1) * F.lit(float(span)) * F.approx_count_distinct("key") / F.count("*")).alias("_width"))
    u = u.join(F.broadcast(spread)).withColumn(RANGE, F.floor((F.col("at") - F.col("_lo")) / F.col("_width")).cast("long")).drop("_lo", "_width")  # one row
    right_row = F.when(F.col("side") == 0, F.struct(F.col("at").alias("rt"), "rid"))
    # Of right rows at one time the one of the smallest rid, so ids are negated where the largest is taken.
    late = F.when(F.col("side") == 0, F.struct(F.col("at").alias("rt"), (-F.col("rid")).alias("neg")))
    key = ["key"]
    ends = {"_first": F.min(right_row), "_late": F.max(late), "_newest": F.max(right_row)}
    u = carried(
        u, key, ends,
        lambda _: [F.last("_late", ignorenulls=True).over(over_ranges(key)).alias("_before"), F.last("_first", ignorenulls=True).over(over_ranges(key, back=True)).alias("_after"), F.max("_newest").over(Window.partitionBy(*key)).alias("newest")],
    )
    before = F.struct(F.col("_before.rt").alias("rt"), (-F.col("_before.neg")).alias("rid"))
    back = inside(key, "at", "side", F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside(key, F.col("at").desc(), "side", F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = u.withColumn("p", F.coalesce(F.last(right_row, ignorenulls=True).over(back), F.when(F.col("_before").isNotNull(), before)))
    x = x.withColumn("f", F.coalesce(F.last(right_row, ignorenulls=True).over(ahead), F.col("_after"))).where("side = 1")
    dp, df_ = F.col("at") - F.col("p.rt"), F.col("f.rt") - F.col("at")
    near = F.when(F.col("f").isNull() | (dp <= df_), F.col("p")).otherwise(F.col("f"))
    near = F.when(F.col("p").isNull(), F.col("f")).otherwise(near)
    within = F.abs(near["rt"] - F.col("at")) <= tolerance
    return x.select("key", "id", F.when(within, near["rid"]).otherwise(F.col("newest.rid")).alias("rid"), F.coalesce(within, F.lit(False)).alias("in_tolerance"))


class Track:
    __slots__ = ("box", "hits", "id", "seen")

    def __init__(self, id_, box, seen):
        self.id, self.box, self.seen, self.hits = id_, box, seen, 1


def overlap(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


class Tracker:
    """Greedy IoU tracking of one stream: pairs by overlap from high to low (ties: track, then detection order), one to one."""

    def __init__(self, least: float = 0.3, max_age_us: int = 1_500_000, min_hits: int = 2, next_id: int = 1, tracks=()):
        self.least, self.max_age_us, self.min_hits, self.next_id, self.tracks = least, max_age_us, min_hits, next_id, list(tracks)

    def frame(self, boxes, pts_us: int) -> list[tuple[int, int, bool]]:
        """(track id, hits, confirmed) of each box; then drops tracks that were not met for max_age_us."""
        near = [(overlap(t.box, b), i, j) for i, t in enumerate(self.tracks) for j, b in enumerate(boxes)]
        chosen: dict[int, Track] = {}
        taken: set[int] = set()
        for share, i, j in sorted((c for c in near if c[0] >= self.least), key=lambda c: -c[0]):
            if i not in taken and j not in chosen:
                taken.add(i)
                chosen[j] = self.tracks[i]
        out = []
        for j, box in enumerate(boxes):
            t = chosen.get(j)
            if t:
                t.box, t.seen, t.hits = box, pts_us, t.hits + 1
            else:
                t = Track(self.next_id, box, pts_us)
                self.next_id += 1
                self.tracks.append(t)
            out.append((t.id, t.hits, t.hits >= self.min_hits))
        self.tracks = [t for t in self.tracks if pts_us - t.seen <= self.max_age_us]
        return out


TRACKED = "stream_id int, frame_no int, det_idx int, track_id int, hits int, confirmed boolean"


def tracked(detections: DataFrame, **options) -> DataFrame:
    """Track ids of (stream_id, frame_no, pts_us, det_idx, x, y, w, h).

    The rule is sequential, so a stream is one task; its rows come sorted in batches, and what is kept are the live tracks and the frame at hand.
    """

    def machine():
        tracker, held = Tracker(**options), []  # rows of the frame that the last batch may have cut

        def frame(rows: list, out: dict) -> None:
            for (t, hits, ok), r in zip(tracker.frame([r[4:] for r in rows], rows[0][2]), rows, strict=True):
                for n, v in zip(out, (r[0], r[1], r[3], t, hits, ok), strict=True):
                    out[n].append(v)

        def step(rows):
            out: dict = {n.split()[0]: [] for n in TRACKED.split(", ")}
            if rows is not None:
                boxes = ([float(v) for v in rows[c]] for c in "xywh")
                for r in zip(*(rows[c] for c in ("stream_id", "frame_no", "pts_us", "det_idx")), *boxes, strict=True):
                    if held and held[0][1] != r[1]:
                        frame(held, out)
                        held.clear()
                    held.append(r)
            elif held:
                frame(held, out)
            return out

        return step

    cols = detections.select("stream_id", "frame_no", "pts_us", "det_idx", "x", "y", "w", "h")
    return streamed(cols, "stream_id", ["frame_no", "det_idx"], machine, TRACKED)
