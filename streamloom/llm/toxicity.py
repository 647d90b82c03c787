"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three hashed rows: two of the word and one of its first letters, so words share rows
only by accident and word forms share a part. Filters one, two and three words wide are max-pooled over the whole
text; a logistic layer follows. As max pooling only needs each filter's best place, the filters are applied to the
distinct words of a batch once and the responses are gathered and added along the text.

The language is told from the text alone, by frequent words; per language a threshold is set on rows that the training did
not see, and logits are shifted so that it becomes the score of THRESHOLD.

Scale: training takes a sample of at most about SAMPLE_ROWS labelled rows and SAMPLE_WORDS words (in the order of a hash of doc_id, one row of
a doc_id); words are hashed where the texts are, and only hashes (8 bytes a word) come to the driver, a partition at a time. The
model is a table of fixed size (about 13 MB) that is broadcast. Scoring is one pass without a shuffle; a long text is scored in blocks.

Never an input of a score: labels, lang, source, doc_id.

Defined results: null, empty and blank texts pool to nothing and get the score of the layer's bias. Without labelled rows of
both classes every score is the share of label 1 (0 without any). A null doc_id counts as ''. Repeated rows repeat;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hold, utf8
from .quality_model import fold, sampled_labels

SAMPLE_ROWS, SAMPLE_WORDS = 6_000, 6_000_000
#: One in so many sampled rows sets thresholds; a language's own threshold counts as much as the common one with so many rows of its rarer class.
CALIBRATE, OWN_ROWS = 4, 15
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
ROWS, PREFIX_ROWS, DIM = 1 << 18, 1 << 14, 12
FILTERS = ((1, 10), (2, 4), (3, 4))
PREFIX = 4
EPOCHS, STEPS, BATCH, RATE = 8, 750, 64, 0.15
WORDS_AT_ONCE = 500_000
#: Frequent words of four languages (fixed values), to tell the language of a text.
FREQUENT = {
    "en": "the of and to in that is was for it with as be on by this are from",
    "fr": "le les des et la un une du que qui dans est pour par sur pas au",
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine",
    "es": "el los las que y en un una por con para su lo del se al",
}
LANGUAGES = (*FREQUENT, "other")


def word_keys(word: bytes) -> tuple[int, int]:
    """Hashes of a word without outer punctuation, lower-cased, and of its first letters."""
    w = word.decode("utf-8", "replace").strip(".,;:!?\"'()[]{}<>|#*$%&").lower()
    return zlib.crc32(w.encode()), zlib.crc32(b"\0" + w[:PREFIX].encode())


_FREQUENT_KEYS = {lang: frozenset(zlib.crc32(w.encode()) for w in text.split()) for lang, text in FREQUENT.items()}


class _Vocabulary(dict):
    """Word to number, numbers in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the distinct words, n x 2 uint32; number of each word; ends of the texts)."""
    vocabulary = _Vocabulary()
    ids, ends, total = [], [], 0
    for t in texts:
        w = t.split()
        ids.append(np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)))
        total += len(w)
        ends.append(total)
    keys = np.asarray([word_keys(w) for w in vocabulary], np.uint32).reshape(-1, 2)
    return keys, np.concatenate(ids) if ids else np.empty(0, np.int32), np.asarray(ends, np.int64)


def frequent_hits(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many frequent words of each language each text has."""
    table = np.zeros((len(keys), len(FREQUENT)), np.int32)
    for j, known in enumerate(_FREQUENT_KEYS.values()):
        table[:, j] = np.isin(keys[:, 0], np.fromiter(known, np.uint32, len(known)))
    if not len(ids):
        return np.zeros((len(ends), len(FREQUENT)), np.int64)
    # From running sums.
    sums = np.concatenate([np.zeros((1, table.shape[1]), np.int64), np.cumsum(table[ids], 0)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def told(hits: np.ndarray) -> np.ndarray:
    return np.where(hits.max(1) > 0, hits.argmax(1), len(FREQUENT))


def language(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number in LANGUAGES of each text: that of most frequent words, if any."""
    return told(frequent_hits(keys, ids, ends))


class Cnn:
    """Embedding rows, filters and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
        self.prefixes = np.zeros((PREFIX_ROWS, DIM), np.float32)
        self.w = {k: rng.normal(0, 0.4, (k, DIM, n)).astype(np.float32) for k, n in FILTERS}
        self.bias = {k: np.zeros(n, np.float32) for k, n in FILTERS}
        self.out = np.abs(rng.normal(0.3, 0.1, sum(n for _, n in FILTERS))).astype(np.float32)
        self.out_bias = np.float32(-1.5)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = keys[:, 0].astype(np.uint64)
        return (word % ROWS).astype(np.int64), ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64), (keys[:, 1] % PREFIX_ROWS).astype(np.int64)

    def embed(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = self.rows(keys)
        return self.words[a] + self.words[b] + self.prefixes[c]

    def pooled(self, keys, ids, ends, places: bool = False):
        """Largest response of every filter in every text (0 at least), and where."""
        x = self.embed(keys)
        begins = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > begins)
        values, at = [], []
        for k, n in FILTERS:
            best = np.full((len(ends), n), -np.inf, np.float32)
            place = np.zeros((len(ends), n), np.int64)
            parts = [x @ self.w[k][j] for j in range(k)]
            ok = some[ends[some] - begins[some] >= k]
            if len(ok):
                m = len(ids) - k + 1
                r = parts[0][ids[:m]]
                for j in range(1, k):
                    r += parts[j][ids[j : m + j]]
                if k > 1:  # windows across the end of a text
                    for j in range(1, k):
                        e = ends[(ends - j >= 0) & (ends - j < m)] - j
                        r[e] = -np.inf
                if places:
                    for d in ok:
                        block = r[begins[d] : ends[d] - k + 1]
                        p = block.argmax(0)
                        place[d], best[d] = begins[d] + p, block[p, np.arange(n)]
                else:
                    # A text ends where the next begins; windows across ends are -inf.
                    best[ok] = np.maximum.reduceat(r, begins[ok], axis=0) if len(ok) == len(some) else np.stack([r[begins[d] : ends[d] - k + 1].max(0) for d in ok])
            values.append(np.maximum(best + self.bias[k], 0))
            at.append(place)
        return (values, at) if places else values

    def logits(self, keys, ids, ends) -> np.ndarray:
        return np.hstack(self.pooled(keys, ids, ends)) @ self.out + self.out_bias


def train(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray, y: np.ndarray, seed: int = 11) -> Cnn:
    """Adagrad on the logistic loss, classes weighted alike; deterministic."""
    net, rng = Cnn(seed), np.random.default_rng(seed)
    begins = np.concatenate([[0], ends[:-1]])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    squares = {"words": np.full(ROWS, 1e-3, np.float32), "prefixes": np.full(PREFIX_ROWS, 1e-3, np.float32), "out": np.full(len(net.out), 1e-3, np.float32), "out_bias": 1e-3}
    squares |= {("w", k): np.full_like(net.w[k], 1e-3) for k, _ in FILTERS} | {("bias", k): np.full_like(net.bias[k], 1e-3) for k, _ in FILTERS}

    def step(name, value, grad):
        squares[name] += grad * grad
        return value - RATE * grad / np.sqrt(squares[name])

    rounds = max(1, len(y) // BATCH)
    for _ in range(max(EPOCHS, min(40, -(-STEPS // rounds)))):  # small samples are gone through more often
        for chosen in np.array_split(rng.permutation(len(y)), rounds):
            spans = [ids[begins[d] : ends[d]] for d in chosen]
            flat = np.concatenate(spans)
            if not len(flat):
                continue
            used, local = np.unique(flat, return_inverse=True)
            local_ends = np.cumsum([len(s) for s in spans])
            values, at = net.pooled(keys[used], local, local_ends, places=True)
            pooled = np.hstack(values)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = g[:, None] * net.out * (pooled > 0)
            x = net.embed(keys[used])
            dx = np.zeros_like(x)
            col = 0
            for (k, n), place in zip(FILTERS, at, strict=True):
                b = back[:, col : col + n]
                col += n
                dw = np.zeros_like(net.w[k])
                text, f = np.nonzero(b)
                for j in range(k):
                    w = local[np.minimum(place[text, f] + j, len(local) - 1)]
                    np.add.at(dw[j].T, f, b[text, f][:, None] * x[w])
                    np.add.at(dx, w, b[text, f][:, None] * net.w[k][j].T[f])
                net.w[k] = step(("w", k), net.w[k], dw + 1e-4 * net.w[k])
                net.bias[k] = step(("bias", k), net.bias[k], b.sum(0))
            net.out = step("out", net.out, pooled.T @ g + 1e-4 * net.out)
            net.out_bias = step("out_bias", net.out_bias, g.sum())
            moved = np.flatnonzero(np.abs(dx).sum(1))
            rows = net.rows(keys[used[moved]])
            for name, table, r in (("words", net.words, np.concatenate(rows[:2])), ("prefixes", net.prefixes, rows[2])):
                d = np.concatenate([dx[moved]] * (len(r) // max(1, len(moved))))
                np.add.at(squares[name], r, (d * d).sum(1))
                np.add.at(table, r, -RATE * d / np.sqrt(squares[name][r])[:, None])
    return net


def threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """Where precision and recall balance best (F1), in the middle of the gap."""
    order = np.argsort(-logit, kind="stable")
    s, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i]) - 1.0


class ToxicityModel:
    def __init__(self, net: Cnn, cuts: np.ndarray, slope: float):
        self.net, self.cuts, self.slope = net, cuts, slope

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):  # as many texts at once as have WORDS_AT_ONCE words, by bytes
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 6 * WORDS_AT_ONCE):
                size += len(texts[to])
                to += 1
            keys, ids, ends = numbered(texts[at:to])
            if to == at + 1 and len(ids) > WORDS_AT_ONCE:
                logit = self._long(keys, ids)
            else:
                logit = self.net.logits(keys, ids, ends) - self.cuts[language(keys, ids, ends)]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * logit + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30))))
            at = to
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)


    def _long(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """One text in blocks that overlap by the widest filter: maxima of the blocks' maxima, sums of their hits of frequent words."""
        width, best, hits = max(k for k, _ in FILTERS), None, 0
        for a in range(0, len(ids), WORDS_AT_ONCE):
            part = ids[a : a + WORDS_AT_ONCE + width - 1]
            used, local = np.unique(part, return_inverse=True)
            values = np.hstack(self.net.pooled(keys[used], local, np.asarray([len(local)])))
            best = values if best is None else np.maximum(best, values)
            own = len(ids[a : a + WORDS_AT_ONCE])
            hits = hits + frequent_hits(keys[used], local[:own], np.asarray([own]))
        return best @ self.net.out + self.net.out_bias - self.cuts[told(hits)]


def together(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all texts, and each word's place in them; empties `held`, as all this is the driver's memory."""
    packed = np.empty(sum(map(len, held)) // 2, np.uint64)
    at = len(packed)
    while held:
        pairs = held.pop().reshape(-1, 2)
        packed[at - len(pairs) : at] = pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1]
        at -= len(pairs)
    distinct = np.unique(packed)
    ids = np.empty(len(packed), np.int32)
    for a in range(0, len(packed), 1 << 18):
        ids[a : a + (1 << 18)] = np.searchsorted(distinct, packed[a : a + (1 << 18)])
    return np.stack([distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), ids


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", seed: int = 13) -> ToxicityModel | float:
    """Trains on three quarters of the sample and sets the thresholds on the rest."""
    sample = sampled_labels(labels, column, FOLDS, HELD_OUT, SAMPLE_ROWS, seed)

    def run(batches):
        hold("toxicity")
        for b in batches:
            keys = []
            for t in utf8(b.column("text")):
                k, i, _ = numbered([t])
                keys.append(k[i].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(keys, pa.binary())], names=["doc_id", "y", "k"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id").cast("string") == F.col("label_id").cast("string")).select(F.col("label_id").cast("string").alias("doc_id"), "y", "text")
    hashed = rows.mapInArrow(run, "doc_id string, y int, k binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("k").alias("k"))
    y, doc, held, ends, total = [], [], [], [], 0
    for r in hashed.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").toLocalIterator():
        n = len(r.k) // 8
        if total and total + n > SAMPLE_WORDS:
            continue
        y.append(r.y)
        doc.append(r.doc_id)
        held.append(np.frombuffer(r.k, "<u4"))
        total += n
        ends.append(total)
    if not y:
        return 0.0
    y, ends = np.asarray(y, np.int64), np.asarray(ends, np.int64)
    if y.min() == y.max():
        return float(y[0])
    keys, ids = together(held)
    begins = np.concatenate([[0], ends[:-1]])
    calibrate = np.asarray([zlib.crc32(f"{seed}:{d}".encode()) % CALIBRATE == 0 for d in doc])
    if len({*y[calibrate].tolist()}) < 2 or len({*y[~calibrate].tolist()}) < 2:
        calibrate[:] = False  # a class is missing on one side: one set for both

    def part(which):
        chosen = np.flatnonzero(which)
        spans = [ids[begins[d] : ends[d]] for d in chosen]
        return np.concatenate(spans), np.cumsum([len(s) for s in spans]), y[chosen]

    i, e, yy = part(~calibrate)
    net = train(keys, i, e, yy, seed)
    i, e, yy = part(calibrate if calibrate.any() else ~calibrate)
    logit, lang = [], []
    for a in range(0, len(e), 512):
        b0, b1 = (e[a - 1] if a else 0), e[min(a + 512, len(e)) - 1]
        used, local = np.unique(i[b0:b1], return_inverse=True)
        logit.append(net.logits(keys[used], local, e[a : a + 512] - b0))
        lang.append(language(keys[used], local, e[a : a + 512] - b0))
    logit, lang = np.concatenate(logit), np.concatenate(lang)
    overall = threshold(logit, yy)
    cuts = np.full(len(LANGUAGES), overall, np.float32)
    for j in range(len(LANGUAGES)):
        own = lang == j
        rows_own = min(yy[own].sum(), (1 - yy[own]).sum())
        if rows_own:  # the more rows a language has, the more its own threshold counts
            cuts[j] += (threshold(logit[own], yy[own]) - overall) * rows_own / (rows_own + OWN_ROWS)
    spread = float(np.std(logit)) or 1.0
    return ToxicityModel(net, cuts, 2.0 / spread)


_SCORED = "score double"


def scored(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hold("toxicity")
        m = shared.value
        for b in batches:
            s = np.full(b.num_rows, m) if isinstance(m, float) else m.score(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCORED}")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    give_back()  # else the driver keeps the fit's memory over the stages after
    def run(batches):
        hold("toxicity")
        m = shared.value
        for b in batches:
            keep = np.full(b.num_rows, m < THRESHOLD) if isinstance(m, float) else m.score(utf8(b.column("text"))) < THRESHOLD
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
