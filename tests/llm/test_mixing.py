import re

from conftest import EDGE, documents

from streamloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    """Targets by the rule as stated: share by weight, cut at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        rest, total = budget - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_edge_rows(edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE)
    sizes = {}
    for _, text, _, source in EDGE:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target, taken = fill(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge).collect()))


def test_buckets_do_not_change_the_mix(spark):
    docs = documents(spark, [(i, "w " * (i % 37), "en", "abc"[i % 3] if i % 5 else "a") for i in range(600)])
    few = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    many = {(r.doc_id, r.taken) for r in mixing.mix(docs, bucket_rows=7).collect()}
    assert few == many


def test_range_sorted(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 9), "en", "ab"[i % 2]) for i in range(200)])
    times = [r.finish_time for r in mixing.mix(docs).collect()]
    assert times == sorted(times)


def brute_whole(docs, epochs=2):
    """Servings in order of finish time, one after another, until the budget is spent."""
    rows = mixing.queued(docs).collect()
    budget = sum({r.source: r.target for r in rows}.values())
    served = sorted(((r.begin + e * r.source_size + r.size) / r.target, (r.source is not None, r.source or ""), r.begin + e * r.source_size, r.doc_id, r.size) for r in rows for e in range(epochs) if r.size)
    out, words = [], 0
    for *_, doc_id, size in served:
        if 2 * words + size > 2 * budget:
            break
        out.append(doc_id)
        words += size
    return sorted(out), words, budget


def test_whole_servings_in_order_up_to_the_budget(spark):
    docs = documents(spark, [(i, "w " * (i * 7 % 61), "en", None if i % 7 == 0 else "abcd"[i % 4]) for i in range(500)])
    want, words, budget = brute_whole(docs)
    for rows in (7, 20_000):
        got = mixing.whole_servings(docs, range_rows=rows).orderBy("place").collect()
        assert sorted(r.doc_id for r in got) == want and sum(r.size for r in got) == words and abs(words - budget) <= 60
        assert [r.finish_time for r in got] == sorted(r.finish_time for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == want
    # Each source is near its target: within a document of its own.
    rows = mixing.queued(docs).collect()
    size = {r.doc_id: (r.source, r.size) for r in rows}
    for source, target in {r.source: r.target for r in rows}.items():
        assert abs(sum(size[i][1] for i in want if size[i][0] == source) - target) <= 2 * 60


def test_null_ids_are_spread(spark):
    docs = documents(spark, [(None, f"w {i}", "en", "a") for i in range(400)])
    begins = sorted(r.begin for r in mixing.queued(docs, bucket_rows=10).collect())
    assert begins == list(range(0, 800, 2)) and sum(r.taken for r in mixing.mix(docs, bucket_rows=10).collect()) == 1200


def test_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
