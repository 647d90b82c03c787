"""Model heads to values, as column expressions over arrays (P-06..P-08, P-12..P-17, P-23) and an open registry (X-01).

A NaN is never switched to in a scan; a NaN in the first place of a classifier's or a text head's scan stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of the plate reader's head (fixed values): region glyphs, digits, letters, and the blank.
PLATE_CLASSES = (
    "<jing>", "<hu>", "<jin>", "<yu>", "<ji>", "<jin2>", "<meng>", "<liao>", "<ji2>", "<hei>", "<su>", "<zhe>", "<wan>", "<min>", "<gan>", "<lu>",
    "<yu2>", "<e>", "<xiang>", "<yue>", "<gui>", "<qiong>", "<chuan>", "<gui2>", "<yun>", "<zang>", "<shan>", "<gan2>", "<qing>", "<ning>", "<xin>",
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9",
    "A", "B", "C", "D", "E", "F", "G", "H", "J", "K", "L", "M", "N", "P", "Q", "R", "S", "T", "U", "V", "W", "X", "Y", "Z", "I", "O", "-",
)


def _clean(v: Column) -> Column:
    """NaN behind the first place cannot win."""
    return F.transform(v, lambda x, i: F.when((i > 0) & F.isnan(x), F.lit(float("-inf"))).otherwise(x))


def argmax(v: Column) -> Column:
    """struct(label, score): the first of the largest values, the raw logit as its score; a leading NaN stays."""
    clean = _clean(v)
    first_nan = F.isnan(F.element_at(v, 1))
    best = F.when(first_nan, F.element_at(v, 1)).otherwise(F.array_max(clean))
    label = F.when(first_nan, F.lit(0)).otherwise(F.array_position(clean, F.array_max(clean)) - 1)
    return F.struct(label.cast("int").alias("label"), best.alias("score"))


def ctc_steps(logits: Column, classes: int, steps: int) -> Column:
    """Best class at each step of a class-major head."""
    column = lambda t: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.element_at(logits, (c * steps + t + 1).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: argmax(column(t))["label"])


def ctc_collapse(best: Column, blank: int) -> Column:
    """Classes put out: not the blank and not the step before's class, which may be a blank."""
    kept = F.filter(F.transform(best, lambda b, i: F.when((b != blank) & ((i == 0) | (b != F.element_at(best, F.greatest(i, F.lit(1))))), b)), lambda b: b.isNotNull())
    return kept


def ctc_text(classes_out: Column, table=PLATE_CLASSES) -> Column:
    names = F.array(*[F.lit(t) for t in table])
    return F.array_join(F.transform(classes_out, lambda c: F.when((c >= 0) & (c < len(table)), F.element_at(names, c + 1)).otherwise(F.lit("?"))), "")


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + 1e-9))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _box(x0, y0, x1, y1, lb, src_w, src_h, off_x, off_y, score, cls) -> Column:
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    cx0, cy0, cx1, cy1 = clamp(x0, src_w), clamp(y0, src_h), clamp(x1, src_w), clamp(y1, src_h)
    return F.struct(
        (cx0 + off_x).alias("x"), (cy0 + off_y).alias("y"), F.greatest(cx1 - cx0, F.lit(0.0)).alias("w"), F.greatest(cy1 - cy0, F.lit(0.0)).alias("h"),
        score.cast("double").alias("score"), cls.cast("int").alias("cls"),
    )


_DETS = "array<struct<x:double,y:double,w:double,h:double,score:double,cls:int>>"
#: Values of heads that are decoded at once.
_AT_ONCE = 8 << 20


def _decoded(heads, anchors: int, classes: int, threshold: float, place):
    """Offsets and flat columns of the boxes of heads (n, 4 + classes, anchors); place: n rows of scale, pad_x, pad_y, src_w, src_h, off_x, off_y."""
    import numpy as np

    scores = heads[:, 4:, :]
    scores = np.where(np.isnan(scores), 0.0, scores)
    cls = scores.argmax(1)
    best = np.maximum(np.take_along_axis(scores, cls[:, None, :], 1)[:, 0, :], 0.0)
    row, anchor = np.nonzero(best >= threshold)  # boxes are made of what is left only
    best, cls = best[row, anchor], cls[row, anchor]
    cls[best <= 0] = 0
    cx, cy, w, h = (heads[row, k, anchor] for k in range(4))
    scale, pad_x, pad_y, src_w, src_h, off_x, off_y = place[row].T
    x0, y0 = (cx - w / 2 - pad_x) / scale, (cy - h / 2 - pad_y) / scale
    clamp = lambda v, top: np.minimum(np.maximum(v, 0.0), top)
    ax, ay, bx, by = clamp(x0, src_w), clamp(y0, src_h), clamp(x0 + w / scale, src_w), clamp(y0 + h / scale, src_h)
    cols = (ax + off_x, ay + off_y, np.maximum(bx - ax, 0.0), np.maximum(by - ay, 0.0), best, cls.astype(np.int32))
    return np.bincount(row, minlength=len(heads)), cols


def yolo(raw: Column, anchors: int, classes: int, lb: Column, src_w: Column, src_h: Column, threshold: float = 0.4, off_x: Column | int = 0, off_y: Column | int = 0) -> Column:
    """Detections of a channel-major head [4 + classes, anchors]. The class scan starts at (class 0, score 0): if no score is positive, that stays.

    Heads are dense arithmetic (8400 anchors by 84 channels are the rule), so they go to numpy in Arrow batches, whose bytes Spark
    bounds: one argmax, then boxes of the anchors over the threshold only. A null head has null detections; one of
    another length than (4 + classes) * anchors fails.
    """
    size = (4 + classes) * anchors

    @F.arrow_udf(_DETS)
    def decode(head, scale, pad_x, pad_y, w, h, ox, oy):
        import numpy as np
        import pyarrow as pa

        place = np.stack([np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in (scale, pad_x, pad_y, w, h, ox, oy)], 1)
        valid = np.flatnonzero(np.asarray(head.is_valid()))
        if len(valid) and (np.asarray(head.value_lengths().take(pa.array(valid))) != size).any():
            raise ValueError(f"a head of {4 + classes} x {anchors} has {size} values")
        flat = head.flatten().to_numpy(zero_copy_only=False).reshape(len(valid), 4 + classes, anchors)
        counts, parts, step = np.zeros(len(head), np.int64), [], max(1, _AT_ONCE // size)
        for k in range(0, len(valid), step):
            some = valid[k : k + step]
            counts[some], cols = _decoded(flat[k : k + step].astype(np.float64), anchors, classes, threshold, place[some])
            parts.append(cols)
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * 5 + [np.empty(0, np.int32)]
        boxes = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["x", "y", "w", "h", "score", "cls"])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets), boxes)
        return made if len(valid) == len(head) else pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~np.isin(np.arange(len(head)), valid), False)), boxes)

    number = lambda c: F.lit(c) if isinstance(c, (int, float)) else c
    return decode(raw, *[c.cast("double") for c in (lb["scale"], lb["pad_x"], lb["pad_y"], src_w, src_h, number(off_x), number(off_y))])


def end_to_end(raw: Column, rows: int, lb: Column, src_w: Column, src_h: Column, threshold: float = 0.4, normalised: tuple[int, int] | None = None) -> Column:
    """Detections of a head [rows, 6] of (x1, y1, x2, y2, score, class); normalised=(w, h): (cx, cy, w, h) as shares of the net's size. Put out in order of (score desc, class, x)."""
    at = lambda i, k: F.element_at(raw, (i * 6 + k + 1).cast("int")).cast("double")

    def one(i: Column) -> Column:
        a, b, c, d = (at(i, k) for k in range(4))
        if normalised:
            w, h = normalised
            a, b, c, d = (a - c / 2) * w, (b - d / 2) * h, (a + c / 2) * w, (b + d / 2) * h
        un = lambda v, pad: (v - pad) / lb["scale"]
        return _box(un(a, lb["pad_x"]), un(b, lb["pad_y"]), un(c, lb["pad_x"]), un(d, lb["pad_y"]), lb, src_w, src_h, F.lit(0), F.lit(0), at(i, 4), F.round(at(i, 5)))

    return in_order(F.filter(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one), lambda d: d["score"] >= threshold))


def in_order(dets: Column) -> Column:
    """By score from high to low, then class, then x."""
    keyed = F.transform(dets, lambda d: F.struct((-d["score"]).alias("s"), d["cls"].alias("c"), d["x"].alias("x"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda k: k["d"])


FAMILIES: dict[str, Callable] = {"yolo": yolo, "yolo-e2e": end_to_end, "rtdetr": end_to_end, "argmax": argmax, "ctc": ctc_steps, "embedding": lambda v: v}
#: Detectors whose boxes go through suppression.
SUPPRESSED = {"yolo"}


def register_family(name: str, decode: Callable, suppressed: bool = False) -> None:
    """Adds a detector family: decode(raw, anchors, classes, lb, src_w, src_h, threshold, off_x, off_y) gives the array of detections of a head."""
    if name in FAMILIES:
        raise ValueError(f"family {name!r} exists")
    FAMILIES[name] = decode
    if suppressed:
        SUPPRESSED.add(name)


def detections_of(family: str, raw: Column, anchors: int, classes: int, lb: Column, src_w: Column, src_h: Column, threshold: float, net: tuple[int, int], off_x: Column | int = 0, off_y: Column | int = 0) -> Column:
    """Boxes of a detector's head by its family; net: (width, height) of the model's input."""
    if family in ("yolo-e2e", "rtdetr"):
        return end_to_end(raw, anchors, lb, src_w, src_h, threshold, net if family == "rtdetr" else None)
    return FAMILIES[family](raw, anchors, classes, lb, src_w, src_h, threshold, off_x, off_y)
