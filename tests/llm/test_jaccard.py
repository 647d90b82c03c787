import random

import pytest
from conftest import EDGE, documents

from streamloom.llm import jaccard


def brute(rows):
    def tokens(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [tokens(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def got(docs, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link_classes(docs, **options).collect())


def near_copies(seed, n=90):
    rng, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(30)]
    bases = [[f"b{b}w{rng.randrange(400)}" for _ in range(rng.choice((4, 12, 60, 150)))] for b in range(6)]
    for i in range(n):
        w = list(rng.choice(bases[: 1 + i % 6]))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        if rng.random() < 0.4:
            w = common + w
        w = w[: rng.choice((len(w), len(w), max(1, len(w) * 4 // 5)))]
        rows.append((i, rng.choice((" ", "\n")).join(w).upper() if rng.random() < 0.2 else " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize("options", [{}, {"group_sets": 12, "hot_least": 3}])
def test_against_brute_force(spark, options):
    rows = near_copies(5) + EDGE
    rows = [(None if r[0] is None else i, *r[1:]) for i, r in enumerate(rows)]
    assert got(documents(spark, rows).repartition(3), **options) == brute(rows)


def test_resolve_is_exact():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        base = rng.sample(range(1000), 40)
        sets = []
        for _ in range(rng.randrange(2, 40)):
            s = set(rng.sample(base, rng.randrange(20, 40))) | set(rng.sample(range(1000), rng.randrange(0, 12)))
            sets.append(np.asarray(sorted(s), np.uint64))
        n = np.asarray([len(s) for s in sets])
        roots = jaccard.resolve(n, sets)
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * both >= 75 * (n[i] + n[j] - both):
                    parent[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                assert (roots[i] == roots[j]) == (find(i) == find(j))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (202, 200)]
    labels = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(101)}) == 1 and len({labels[i] for i in (200, 201, 202)}) == 1 and labels[0] != labels[200]


def test_one_of_each_and_empty(spark, edge, none):
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, 10, None]))
    assert jaccard.link_classes(none).count() == 0 and jaccard.one_of_each(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"link_sets": 7, "group_sets": 12, "hot_least": 3}])
def test_links_against_brute_force(spark, options):
    rows = near_copies(11) + EDGE + near_copies(11)[:20]
    rows = [(None if r[0] is None else i, *r[1:]) for i, r in enumerate(rows)]
    sets = [frozenset(jaccard.shingles((r[1] or "").encode()).tolist()) for r in rows]
    linked = lambda a, b: a and 100 * len(a & b) >= 75 * len(a | b)
    want = sorted((str(r[0]), sum(bool(linked(a, b)) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets, strict=True)))
    found = sorted((str(r.doc_id), r.n_links) for r in jaccard.link_classes(documents(spark, rows).repartition(3), links=True, **options).collect())
    assert found == want and sum(n for _, n in want) > 100


def test_hashes_are_told_in_and_over_parts():
    import numpy as np

    tokens = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    for parts in (16, 1000, 1 << 15, 1 << 16, (1 << 20) + 7, 1 << 22):
        part = jaccard.part_of(tokens, parts)
        assert part.min() >= 0 and part.max() < parts and (np.diff(part) >= 0).all()
        full = jaccard.whole(jaccard.within(tokens, part, parts), part, parts)
        assert (jaccard.part_of(full, parts) == part).all()
        assert len(np.unique(full)) == len(tokens)
        if parts >= 1 << 16:
            assert (full == tokens).all()


def test_a_shingle_in_many_sets_and_parts(spark, monkeypatch):
    """One passage in a hundredth of all sets, and more parts than fit into 16 bits."""
    rows = near_copies(3, 300)
    passage = " ".join(f"p{i}" for i in range(6))
    rows = [(i, f"{t} {passage}" if i % 100 == 7 else t, *r) for i, t, *r in rows]
    assert got(documents(spark, rows).repartition(5), hot_least=2) == brute(rows)
    monkeypatch.setattr(jaccard, "MANY_PARTS", 1 << 17)
    assert got(documents(spark, rows).repartition(2)) == brute(rows)


def _copies_of_one(seed, count):
    """Copies of one text with so many places changed that some link with few others or none."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base, sets = rng.integers(0, 2**63, 300, dtype=np.uint64), []
    for _ in range(count):
        keep = np.ones(300, bool)
        for place in rng.choice(300, rng.integers(0, 13), replace=False):
            keep[max(0, place - 4) : place + 1] = False
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**10, 300 - keep.sum(), dtype=np.uint64)])))
    return np.asarray([len(s) for s in sets]), sets


def test_a_large_group_of_near_copies(monkeypatch):
    """Exact with frequent shingles as bits, and without a Python step for most pairs of sets that do not link."""
    import numpy as np

    n, sets = _copies_of_one(2, 700)
    tokens = np.unique(np.concatenate(sets))
    member = np.stack([np.isin(tokens, s) for s in sets]).astype(np.float32)
    common = (member @ member.T).astype(int)
    linked = 100 * common >= 75 * (n[:, None] + n[None] - common)
    want = np.arange(700)
    while True:
        least = np.where(linked, want[None], 700).min(1)
        if (least == want).all():
            break
        want = least
    steps, plain = [0], jaccard.least_overlap
    monkeypatch.setattr(jaccard, "least_overlap", lambda *a: steps.__setitem__(0, steps[0] + 1) or plain(*a))
    for labels in (None, want // 2):
        steps[0] = 0
        roots = jaccard.resolve(n, sets, labels)
        assert steps[0] < 60 * 700
        if labels is None:
            assert len(np.unique(want)) > 20 and len(np.unique(np.stack([roots, want]), axis=1).T) == len(np.unique(want)) == len(np.unique(roots))


def test_links_of_a_large_class_are_exact():
    import numpy as np
    import pyarrow as pa

    n, sets = _copies_of_one(4, 300)
    common = np.asarray([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    linked = 100 * common >= 75 * (n[:, None] + n[None] - common)
    copies = np.arange(300) % 3 + 1
    whole = {"root": np.zeros(300, "i8"), "low": np.zeros(300, "i8"), "high": np.zeros(300, "i8"), "chunk": np.zeros(300, "i8"), "sid": np.arange(300), "n": n, "copies": copies, "tokens": [s.tobytes() for s in sets]}
    found = jaccard._count_links(pa.table(whole))
    np.fill_diagonal(linked, False)
    assert found["links"].to_pylist() == (linked @ copies)[found["sid"].to_numpy()].tolist()


def test_a_shingle_alone_in_its_part_moves_in_15_bytes():
    """At many parts a set has a shingle or none in a part; its size does not go with each."""
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": [1, 2], "text": [" ".join(f"{d}{i}" for i in range(400)) for d in "ab"]})
    rows = [r for out in jaccard._emit(1 << 15, 5, 16)([batch]) for r in out.to_pylist()]
    parts = [r["payload"] for r in rows if r["kind"] == 0]
    assert sum(map(len, parts)) <= len(parts) * 16 + 15 * 2 * 396
