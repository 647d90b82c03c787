"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source is a queue of its documents in shuffled order, gone through as often as needed; each time a document is put out is
a serving. A serving's virtual finish time is its source's cumulative words up to and with it, divided by the source's
target, so all sources are served at once, each at a rate in proportion to its target. The servings of all sources are
dealt to ranges of finish time, which fair queueing itself makes of equal words; sums of the ranges before and running
sums within give each serving's place in the mix, and the mix ends where the total budget is spent.

Two ways to end it. Whole documents (`mixed_documents`): the first servings by finish time whose words make the budget, the one
across the end if at least half of it fits. By the word (`mix`): all queues stop at the virtual time at which the
budget is spent, and a document in service just then is taken up to that word.

Scale: one pass over the texts leaves rows of (doc_id, source, size), which are checkpointed. Prefix sums have two
levels: sums of (source, bucket), then running sums within a bucket; buckets are ranges of the shuffle key and their
number grows with the rows, so a source that holds a third of all rows is spread over many tasks. Only the table of
sources (a row per source) and that of the ranges of finish time are ever ordered as a whole.

Defined results: null or blank text has size 0 and takes 0 words. A null source is a source of its own, last.
Repeated doc_ids are separate documents; a null doc_id is shuffled by a hash of the row's other columns. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, n_words

#: Weights of the sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
BUCKET_ROWS = 10_000
#: Servings in a range of finish time.
RANGE_ROWS = 20_000
#: Words in a partition of the mix.
PART_WORDS = 3_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, weight and target.

    A target is min(max_epochs * size, level * weight) where level makes the targets add up to the budget: the
    fixed point of sharing by weight and resharing what is over a source's cap. The level comes from one ordered pass:
    the sources that reach their cap are the first by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    caps = (
        per.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("reach", F.col("cap") / F.col("weight"))
    )
    every = Window.partitionBy()
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    tried = (
        caps.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("free"))
    )
    # The first source whose own reach is at or over the level is the first that stays under its cap.
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(every)["level"]
    return tried.withColumn("final", level).select(
        "source", "source_size", "weight",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"),
    )


def queued(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, code, size, source_size, target, begin), a row of docs each; begin: words of its source before it in the queue.

    code: a hash of the text, by which rows that share doc_id and source are told.
    """
    hashable = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64(*hashable).cast("string")))
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("code"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("k")))
    n = sizes.count()
    buckets = max(1, -(-n // bucket_rows)) * 4
    dealt = sizes.withColumn("bucket", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes, weights, budget_share, max_epochs)
    starts = (
        sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    )
    joined = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size", "code").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return joined.select("doc_id", "source", "code", "size", "source_size", "target", begin.alias("begin"))


def _servings(max_epochs: int) -> Column:
    """Of a queued row: its servings as structs (begin, finish_time)."""
    begin = lambda e: F.col("begin") + e * F.col("source_size")
    finish = lambda e: F.when(F.col("target") > 0, (begin(e) + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    return F.array(*[F.struct(begin(F.lit(e)).alias("begin"), finish(F.lit(e)).alias("finish_time")) for e in range(max_epochs)])


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, **options) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source, finish_time), a row of docs each, range-sorted by finish_time.

    taken counts words, with repeats. The targets add up to the total budget, which is spent at virtual time 1: a serving that has finished by
    then is taken whole, one in service up to its source's floor(target) words. finish_time is that of the last serving that was begun.
    """
    rows = queued(docs, max_epochs=max_epochs, **options).withColumn("servings", _servings(max_epochs))
    budget = F.floor(F.col("target"))
    words = lambda s: F.greatest(F.lit(0), F.least(F.col("size"), budget - s["begin"])).cast("long")
    served = lambda s: F.when((s["finish_time"] <= 1.0) & (s["begin"] + F.col("size") <= budget), F.col("size")).otherwise(words(s))
    taken = F.aggregate("servings", F.lit(0).cast("long"), lambda a, s: a + served(s))
    last = F.aggregate("servings", F.element_at("servings", 1)["finish_time"], lambda a, s: F.when(served(s) > 0, s["finish_time"]).otherwise(a))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", last.alias("finish_time")).orderBy("finish_time")


def whole_servings(docs: DataFrame, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS, **options) -> DataFrame:
    """(doc_id, source, code, size, finish_time, place): the servings of whole documents that make the total budget; place: words of the mix before it.

    All servings in order of finish time, cut where their words reach the budget.
    """
    rows = cut(queued(docs, max_epochs=max_epochs, **options).where("size > 0"))
    facts = rows.groupBy("source").agg(F.first("target").alias("target"), F.count("*").alias("n")).agg(F.sum("target").alias("budget"), F.ceil(F.sum("n") * max_epochs / range_rows).alias("ranges"))
    each = rows.withColumn("s", F.explode(_servings(max_epochs))).select("doc_id", "source", "code", "size", "s.begin", "s.finish_time").join(F.broadcast(facts))  # one row
    each = each.withColumn("range", F.floor(F.col("finish_time") * F.col("ranges")).cast("long"))
    sums = each.groupBy("range").agg(F.sum("size").alias("words"))
    before = sums.select(F.col("range").alias("r"), F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("finish_time", "source", "begin", "doc_id", "code").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(before, F.col("range") == F.col("r")).withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # The serving across the end is in if at least half of it fits.
    return placed.where(2 * F.col("place") + F.col("size") <= 2 * F.col("budget")).select("doc_id", "source", "code", "size", "finish_time", "place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is served, whole, with the columns of docs, in order of finish time over the partitions.

    Rows are told by doc_id, source and a hash of the text; the servings of rows alike in all three go round among them.
    """
    doc, source, code, nth, turn, at = (fresh(docs, f"mix_{c}") for c in ("id", "source", "code", "nth", "turn", "at"))
    key = [doc, source, code]
    served = cut(whole_servings(docs, **options).select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("code").alias(code), "size", F.col("finish_time").alias(at)))
    words = served.agg(F.sum("size")).first()[0] or 0
    served = served.drop("size")
    told = docs.withColumn(code + "_", F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(code + "_") == F.col(code))
    rows = told.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col(code + "_").alias(code)).agg(F.count("*").alias(nth))
    several = cut(rows.where(F.col(nth) > 1))
    if several.isEmpty():
        joined = told.join(served, match)
    else:
        same = lambda d: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in d]
        on = same(key)[0] & same(key)[1] & same(key)[2]
        one = served.alias("l").join(several.alias("r"), on, "left_anti")
        many = served.alias("l").join(several.alias("r"), on).select(*[f"l.{c}" for c in served.columns], F.col(f"r.{nth}").alias(turn))
        many = many.withColumn(nth, (F.row_number().over(Window.partitionBy(*key).orderBy(at)) - 1) % F.col(turn)).drop(turn)
        copies = told.join(several.drop(nth), match, "left_semi")
        copies = copies.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", "source", code + "_").orderBy([c for c in docs.columns if c != "text"])) - 1)
        joined = told.join(one, match).select(*docs.columns, at).unionByName(copies.join(many, match & (F.col(turn) == F.col(nth))).select(*docs.columns, at))
    parts = 1 + words // PART_WORDS
    place = F.least(F.lit(parts - 1), F.floor(F.col(at) * parts)).cast("int")
    return joined.select(*docs.columns, at).repartitionById(parts, place).sortWithinPartitions(at).select(docs.columns)
