"""Quality classifier: kernel ridge regression by random Fourier features, with isotonic calibration.

Statistics of the whole text (STATS) are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Ridge scores come from normal equations that every partition sums over its rows; the
driver adds the partial sums and solves. Pool-adjacent-violators on rows that the fit did not see turns scores
into probabilities.

Scale: each text is read once; its statistics (about 100 bytes) are checkpointed, and fitting and scoring use those. The
fit takes a sample of labelled rows of at most about SAMPLE_ROWS (a rate by a hash of doc_id), so the broadcast of sampled
labels, the partial sums and the calibration rows have a fixed bound; a repeated doc_id counts once. Scoring is one pass without a shuffle.

Never an input of a score: labels, lang, source, doc_id.

Defined results: null and empty texts have the statistics of no words and get a score like any other. Without labelled
rows of both classes every score is the share of label 1 (0.5 without any label). A row with a null doc_id counts as
doc_id ''. Repeated rows repeat; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, hold, utf8

SAMPLE_ROWS = 20_000
FEATURES = 384
RIDGE = 1e-3
BANDWIDTH = 1.5
FIT_PARTITIONS = 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STATS = (
    "log_words", "mean_word", "long_words", "distinct", "top_word", "adjacent", "distinct_3", "symbols", "bars", "shouts",
    "upper", "digits", "stops", "commas", "log_lines", "dup_lines", "bare_words", "other_ascii", "non_ascii", "short_words",
)
_UPPER, _DIGITS, _LETTERS = bytes(range(65, 91)), b"0123456789", bytes(range(65, 91)) + bytes(range(97, 123))
_SPACE, _HIGH = b" \t\n\v\f\r", bytes(range(128, 256))
_OTHER = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + b".,")


def statistics(text: bytes) -> list[float]:
    """STATS of one text, each bounded or logarithmic."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(STATS)
    sizes = list(map(len, w))
    chars = sum(sizes)
    less = lambda drop: len(text) - len(text.translate(None, drop))
    distinct: dict[bytes, int] = {}
    for x in w:
        distinct[x] = distinct.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    letters = less(_LETTERS)
    triples = max(1, n - 2)
    return [
        math.log1p(n), chars / n, sum(s > 20 for s in sizes) / n, len(distinct) / n**0.8, max(distinct.values()) / n,
        sum(map(bytes.__eq__, w, w[1:])) / n, len(set(zip(w, w[1:], w[2:]))) / triples if n > 2 else 1.0,
        less(b"#*$%&<>") / n, less(b"|") / n, less(b"!") / n, less(_UPPER) / max(1, letters), less(_DIGITS) / chars,
        less(b".") / n, less(b",") / n, math.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        sum(not x.isalnum() and not x.strip(b".,").isalpha() and x.isascii() for x in distinct) / len(distinct),
        less(_OTHER) / chars, less(_HIGH) / chars, sum(s < 3 for s in sizes) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, and x: the statistics as little-endian float32."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        hold("quality")
        for b in batches:
            x = np.asarray([statistics(t) for t in utf8(b.column("text"))], "<f4").reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x binary")


def fold(column, folds: int):
    """crc32 of doc_id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sampled_labels(labels: DataFrame, column: str, folds: int, held_out: int, rows: int, seed: int) -> DataFrame:
    """(label_id, y) of the training fold, about `rows` of them at most: kept by a hash of doc_id at a rate from the count."""
    train = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    n = train.count()
    rate = min(1.0, rows / max(1, n))
    kept = train if rate == 1.0 else train.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000))
    return kept.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col(column)).cast("int").alias("y"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, len(STATS)).astype(np.float64)


def _partials(df: DataFrame, make) -> np.ndarray:
    """Sum over partitions of the float64 vector that make(x, y) gives for a partition's rows."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = make(_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = [np.frombuffer(r.s) for r in df.select("x", "y").mapInArrow(run, "s binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(0)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), ascending both; for linear interpolation between the blocks' centres."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][2] += c
    k = np.asarray(blocks)
    return k[:, 2] / k[:, 1], k[:, 0] / k[:, 1]


class QualityModel:
    """What a fit leaves: a few tens of KB, whatever the corpus."""

    def __init__(self, mean, scale, w, shift, beta, knots, values):
        self.mean, self.scale, self.w, self.shift, self.beta, self.knots, self.values = mean, scale, w, shift, beta, knots, values

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.shift) * math.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # The calibrated value; a small share of the raw score orders rows within a flat stretch.
        return np.clip(0.98 * np.interp(r, self.knots, self.values) + 0.02 * np.clip(r, 0, 1), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality", seed: int = 7) -> QualityModel | float:
    """A model from a bounded sample, or a constant score."""
    sample = sampled_labels(labels, column, FOLDS, HELD_OUT, SAMPLE_ROWS, seed)
    rows = stats.join(F.broadcast(sample), F.col("doc_id").cast("string") == F.col("label_id").cast("string"))
    rows = rows.groupBy(F.col("label_id").alias("doc_id")).agg(F.min("x").alias("x"), F.max("y").alias("y"))  # one row of a repeated doc_id
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    rows = cut(rows.select("x", "y", part.alias("calibrate")).repartition(FIT_PARTITIONS))
    sums = _partials(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(sums):
        return 0.5
    n, positive, d = sums[0], sums[1], len(STATS)
    if positive in (0, n):
        return float(positive / n)
    mean = sums[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(sums[2 + d :] / n - mean * mean, 1e-8))
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / (BANDWIDTH * math.sqrt(d)), (d, FEATURES))
    model = QualityModel(mean, scale, w, rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def equations(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    normal = _partials(rows.where("not calibrate"), equations)
    if not len(normal):
        return float(positive / n)
    a, b = normal[: size * size].reshape(size, size), normal[size * size : -1]
    model.beta = np.linalg.solve(a + np.eye(size) * RIDGE * normal[-1] / size, b)
    held = rows.where("calibrate").select("x", "y").collect()
    if held:
        x = np.frombuffer(b"".join(r.x for r in held), "<f4").reshape(-1, d).astype(np.float64)
        y = np.asarray([r.y for r in held], float)
        # One row of either class at the ends keeps the curve from 0 to 1 where the sample is small.
        r = model.raw(x)
        model.knots, model.values = isotonic(np.concatenate([r, [min(r.min(), 0.0) - 0.25, max(r.max(), 1.0) + 0.25]]), np.concatenate([y, [0.0, 1.0]]))
    else:
        model.knots, model.values = np.asarray([0.0, 1.0]), np.asarray([0.0, 1.0])
    return model


def score_statistics(stats: DataFrame, model: QualityModel | float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            s = np.full(b.num_rows, model) if isinstance(model, float) else model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = cut(with_statistics(docs))
    return score_statistics(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones, all columns kept; statistics are computed where the text is, so nothing is joined."""
    stats = cut(with_statistics(docs))
    model = fit(stats, labels)
    give_back()
    columns = docs.columns
    schema = docs.schema

    def run(batches):
        hold("quality")
        for b in batches:
            if isinstance(model, float):
                keep = np.full(b.num_rows, model >= THRESHOLD)
            else:
                x = np.asarray([statistics(t) for t in utf8(b.column("text"))], "<f4").reshape(-1, len(STATS)).astype(np.float64)
                keep = model.score(x) >= THRESHOLD
            yield b.filter(pa.array(keep))

    return docs.select(columns).mapInArrow(run, schema)
