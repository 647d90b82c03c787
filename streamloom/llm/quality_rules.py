"""Quality rules as a bitmask ledger (DataFrame operations only).

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit i says that
rule i failed. A policy is a version name and a mask; applying one is a bitwise AND, so policies can change without
reading a text again. Ablations (what would be kept without a rule) come from a histogram of bit patterns, of which
there are at most 2 ** len(RULES), whatever the size of the corpus.

Scale: one pass, no shuffle, no Python. Work per text is linear but for one sort of its 3-word windows, which only
texts with a repeated window need. Windows are compared as 64-bit hashes within one text.

Defined results: null, empty and blank texts have 0 in every measurement and fail MIN_WORDS. Lines without a word are
never duplicates. Texts of fewer than 3 words have no window. Repeated rows are judged one by one; extra columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, words

#: Name, failure condition over the measurements. The position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("min_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines"),
    ("shouting", "10 * n_shouts > 3 * n_words"),
)
BASE = ("min_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": tuple(name for name, _ in RULES),
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")


def mask(rules) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with the columns of MEASURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        "doc_id",
        words(t).alias("w"),
        (F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(t, r"!", -1)) - 1).cast("long").alias("n_shouts"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
    )
    hashed = base.select(
        "doc_id", "n_symbols", "n_shouts", "word_chars",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))
        .otherwise(F.expr("cast(array() as array<bigint>)")).alias("h"),
    )
    sorted_ = hashed.withColumn(
        "s", F.expr("case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x as h, i as i))) end")
    ).drop("h")
    # In the sorted windows, those whose neighbour has the same hash; then the words they cover.
    starts = F.expr(
        """array_sort(transform(filter(transform(s, (x, p) -> struct(x.i as i,
            (p > 0 and s[greatest(p - 1, 0)].h = x.h) or (p < size(s) - 1 and s[least(p + 1, size(s) - 1)].h = x.h) as twice)),
            y -> y.twice), y -> y.i))"""
    )
    marked = sorted_.withColumn("r", F.when(F.col("s").isNotNull(), starts)).drop("s")
    # Each covering window adds 3 words less the overlap with the window before it.
    covered = F.expr("aggregate(r, named_struct('last', -9, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)")
    return marked.select("doc_id", *MEASURES[:5], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_shouts")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, measurements and fail_bits."""
    bits = F.lit(0)
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0))
    return measured(docs, text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept; kept is never true where a base rule failed."""
    m, base = mask(POLICIES[version]), mask(BASE)
    return entries.withColumn("base_failed", F.col("fail_bits").bitwiseAND(base) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(m | base) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents rejected, rejected by this rule alone, and kept if the rule were left out.

    Two levels of sums: bit patterns first (map-side), then the few patterns against the few policies and rules.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = entries.sparkSession.createDataFrame(
        [(version, name, mask(rules), mask([name])) for version, rules in POLICIES.items() for name in rules], "policy string, rule string, mask int, bit int"
    )
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(plan))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("documents"),
            F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_by_it_alone"),
            F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without_it"),
        )
    )
