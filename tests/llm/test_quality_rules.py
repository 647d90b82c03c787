import collections
import re

from conftest import EDGE, documents

from streamloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in collections.Counter(wins).items() if n > 1}
    covered = {i + k for i, x in enumerate(wins) if x in twice for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c a b c", "a a a a", "a b a b a", "q w e r t y q w e", "l\nl\nl", "a\r\na\r\n", "x y z " * 400 + "end", "#*$ %&| <>"]


def test_measures(spark, edge):
    for docs, texts in ((edge, [r[1] for r in EDGE]), (documents(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)]), TEXTS)):
        got = sorted(tuple(r) for r in Q.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted(map(brute, texts))


def test_policies_and_ablations(edge):
    entries = Q.ledger(edge)
    rows = Q.apply_policy(entries).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.base_failed and r.kept for r in rows)
    for a in Q.ablations(entries).collect():
        mask, bit = Q.mask(Q.POLICIES[a.policy]), Q.mask([a.rule])
        assert a.documents == len(rows)
        assert a.rejected == sum(bool(r.fail_bits & mask) for r in rows)
        assert a.rejected_by_it_alone == sum(r.fail_bits & mask == bit for r in rows)
        assert a.kept_without_it == sum(not r.fail_bits & mask & ~bit for r in rows)


def test_empty(none):
    assert Q.apply_policy(Q.ledger(none)).count() == 0
