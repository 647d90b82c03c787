import random
import zlib

import numpy as np
from conftest import documents

from streamloom.llm import quality_model, toxicity

GOOD = "the of and to in that house river garden people walked slowly because morning light was soft with clear water near stones".split()
BAD = ["awfulx", "grimox", "nastiq", "vilerr"]


def corpus(n=700, seed=4):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [rng.choice(GOOD) + rng.choice(("", "", "", ".", ",")) for _ in range(rng.randrange(30, 120))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        if not good:
            w = [x + rng.choice(("$$$", "***", "&&&")) for x in w]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def held(i, folds, k):
    return zlib.crc32(str(i).encode()) % folds == k


def test_quality_held_out(spark):
    rows, labels = corpus()
    got = quality_model.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_toxicity_held_out(spark):
    rows, labels = corpus(seed=6)
    got = toxicity.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == held(r.doc_id, 3, 1) and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_scores_do_not_see_metadata(spark):
    rows, labels = corpus(200)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    other = [(i, t, "zz", f"q{i}") for i, t, *_ in rows]
    for op in (quality_model, toxicity):
        a, b = ({r.doc_id: r.score for r in op.classify(documents(spark, x), l).collect()} for x in (rows, other))
        assert a == b


def test_edges(spark, edge, none, labels):
    nothing = labels.where("false")
    for op, keep in ((quality_model, quality_model.keep_good), (toxicity, toxicity.keep_civil)):
        assert op.classify(edge, labels).count() == edge.count()
        assert op.classify(none, labels).count() == 0
        assert {r.score for r in op.classify(edge, nothing).collect()} == {0.5 if op is quality_model else 0.0}
        assert keep(edge, nothing).count() == edge.count() and keep(edge, nothing).columns == edge.columns
        assert keep(none, labels).count() == 0


def test_isotonic():
    knots, values = quality_model.isotonic(np.asarray([1.0, 2, 3, 4, 5]), np.asarray([0.0, 1, 0, 1, 1]))
    assert list(values) == sorted(values) and list(knots) == sorted(knots)
    assert np.interp(2.5, knots, values) == 0.5


def test_threshold_and_language():
    assert 1 < toxicity.threshold(np.asarray([3.0, 2, 1, 0]), np.asarray([1, 1, 0, 0])) < 2
    keys, ids, ends = toxicity.numbered([b"the cat and the dog", b"der Hund und die Katze", b"", "le chat et les chiens".encode(), b"qq"])
    assert [toxicity.LANGUAGES[i] for i in toxicity.language(keys, ids, ends)] == ["en", "de", "other", "fr", "other"]


def test_long_text_in_blocks(monkeypatch):
    net = toxicity.Cnn(3)
    net.words *= 20
    model = toxicity.ToxicityModel(net, np.asarray([0.1, 0.2, 0.3, 0.4, 0.5], np.float32), 1.0)
    rng = random.Random(2)
    text = " ".join(rng.choice(GOOD + ["der", "une", "zq"]) + rng.choice(("", "x")) for _ in range(1000)).encode()
    whole = model.score([text])
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 37)
    assert np.allclose(model.score([text]), whole, atol=1e-5)


def test_gradients_by_finite_differences(monkeypatch):
    """One training step moves each weight against the slope of the loss."""
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**32, (30, 2)).astype(np.uint32)
    ids, ends, y = rng.integers(0, 30, 60).astype(np.int32), np.asarray([15, 30, 45, 60]), np.asarray([1, 0, 1, 0])
    start = toxicity.Cnn(11)

    def loss(net):
        z = net.logits(keys, ids, ends)
        return np.mean(np.log1p(np.exp(np.where(y == 1, -z, z))))

    for name, spots in (("out", [0, 7, 17]), ("w", [(1, 0, 3, 2), (2, 1, 5, 1), (3, 2, 0, 0)])):
        monkeypatch.setattr(toxicity, "EPOCHS", 1)
        monkeypatch.setattr(toxicity, "STEPS", 1)
        monkeypatch.setattr(toxicity, "RATE", 1e-3)
        moved = toxicity.train(keys, ids, ends, y)
        for spot in spots:
            eps, slopes = 1e-3, []
            for sign in (1, -1):
                net = toxicity.Cnn(11)
                if name == "out":
                    net.out[spot] += sign * eps
                else:
                    net.w[spot[0]][spot[1:]] += sign * eps
                slopes.append(loss(net))
            slope = (slopes[0] - slopes[1]) / (2 * eps)
            change = moved.out[spot] - start.out[spot] if name == "out" else moved.w[spot[0]][spot[1:]] - start.w[spot[0]][spot[1:]]
            assert abs(slope) < 1e-3 or np.sign(change) == -np.sign(slope)


def test_ridge_by_direct_solve(spark):
    """The partition-summed normal equations give what a direct solve over all rows gives."""
    rows, labels = corpus(400)
    docs = documents(spark, rows).repartition(7)
    stats = quality_model.cut(quality_model.with_statistics(docs))
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_model.fit(stats, l)
    sample = {r.label_id: r.y for r in quality_model.sampled_labels(l, "quality", 5, 0, quality_model.SAMPLE_ROWS, 7).collect()}
    from pyspark.sql import functions as F

    fitted = stats.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) != 0).collect()
    x = np.asarray([np.frombuffer(r.x, "<f4") for r in fitted if r.doc_id in sample], float)
    y = np.asarray([sample[r.doc_id] for r in fitted if r.doc_id in sample], float)
    z = model.features(x)
    k = z.shape[1]
    # The same ridge problem as least squares with rows of their own for the penalty.
    penalty = np.sqrt(quality_model.RIDGE * len(y) / k)
    beta = np.linalg.lstsq(np.vstack([z, penalty * np.eye(k)]), np.concatenate([y, np.zeros(k)]), rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ beta, atol=1e-4)


def test_repeated_and_text_ids(spark):
    """A labelled doc_id that is repeated counts once; ids may be texts."""
    rows, labels = corpus(200)
    many = rows + [rows[i] for i in range(20)] * 10
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in quality_model.classify(documents(spark, rows), l).collect()}
    b = {r.doc_id: r.score for r in quality_model.classify(documents(spark, many), l).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    from pyspark.sql import functions as F

    named = documents(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert toxicity.classify(named, l.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).count() == 200


def test_sample_of_words_in_little_memory():
    """The driver numbers the sample's words in about three times their bytes."""
    import tracemalloc

    import numpy as np

    from streamloom.llm import toxicity

    rng = np.random.default_rng(3)
    held = [rng.integers(0, 300, (n, 2), dtype=np.uint32).ravel() for n in (0, 5, 900_000, 1, 600_000)]
    flat = np.concatenate(held).reshape(-1, 2)
    tracemalloc.start()
    keys, ids = toxicity.together(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (keys[ids] == flat).all() and len(np.unique(keys, axis=0)) == len(keys) and not held
    assert peak < 3 * flat.nbytes
