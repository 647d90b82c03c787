"""Order-dependent values over few, long keys, in two levels.

A camera's packets are one long key, so a window by stream is one task a camera whatever the cluster. Here a key's rows fall
into ranges of their order column of bounded width; each range is summed up to one row, windows over these few rows carry
the state from range to range, and windows within a range do the rest. The large side is shuffled once, by key and range;
the carried rows are few and whether they are broadcast is left to the planner, which sees their measured size.

`streamed` is for rules that are state machines: rows of a key come sorted, in Arrow batches, to one Python generator,
so a task holds a batch and the state and not a key's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of a range of seq or frame_no; both are counts, so a range of a key holds so many rows at most.
SPAN = 1 << 18
RANGE = "_range"


def ranged(df: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    return df.withColumn(RANGE, F.floor(F.col(order) / F.lit(span)).cast("long"))


def inside(keys: list[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def over_ranges(keys: list[str], back: bool = False) -> WindowSpec:
    """Ranges of a key before a range, or after it, the nearest last."""
    order = F.col(RANGE).desc() if back else F.col(RANGE)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, keys: list[str], sums: dict[str, Column], state: Callable[[DataFrame], list[Column]]) -> DataFrame:
    """df (with RANGE) and, on each row, the columns that state makes from the table (keys, RANGE, sums) of ranges."""
    per = df.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in sums.items()])
    return df.join(per.select(*keys, RANGE, *state(per)), [*keys, RANGE])


def numbered(df: DataFrame, keys: list[str], order: str, name: str, span: int = SPAN) -> DataFrame:
    """Adds name, the 1-based number of a row among its key's rows by order."""
    r = carried(ranged(df, order, span), keys, {"_rows": F.count("*")}, lambda _: [F.coalesce(F.sum("_rows").over(over_ranges(keys)), F.lit(0)).alias("_before")])
    nth = F.row_number().over(inside(keys, order)) + F.col("_before")
    return r.withColumn(name, nth).drop(RANGE, "_before")


def previous(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds name, the value of the row before in the key; keeps RANGE, by which the rows are dealt."""
    d = ranged(df, order, span).withColumn("_value", value)
    r = carried(d, keys, {"_last": F.max_by(F.struct("_value"), order)}, lambda _: [F.last("_last", ignorenulls=True).over(over_ranges(keys)).alias("_carry")])
    w = inside(keys, order)
    here = F.lag(F.struct("_value")).over(w)
    return r.withColumn(name, F.coalesce(here, F.col("_carry"))["_value"]).drop("_value", "_carry")


def neighbours(df: DataFrame, keys: list[str], order: str, span: int = SPAN, before: str = "before", after: str = "after") -> DataFrame:
    """Adds the order column's values of the key's rows before and after this one."""
    ends = {"_first": F.min(order), "_last": F.max(order)}
    r = carried(ranged(df, order, span), keys, ends, lambda _: [F.last("_last").over(over_ranges(keys)).alias("_b"), F.last("_first").over(over_ranges(keys, back=True)).alias("_a")])
    w = inside(keys, order)
    return r.withColumn(before, F.coalesce(F.lag(order).over(w), F.col("_b"))).withColumn(after, F.coalesce(F.lead(order).over(w), F.col("_a"))).drop(RANGE, "_b", "_a")


def upper_medians(df: DataFrame, keys: list[str], value: str, name: str, times: str | None = None) -> DataFrame:
    """(keys, name): the upper-middle one of a key's values that are not null, sorted[n // 2]; value is an integer column; times: how often a row counts.

    A radix selection: counts by the value's high part tell the part that holds the middle, counts of that part's values the
    value. A key has few high parts and at most 65,536 values in one, so no list of a key's values is made.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.shiftright(F.col(value).cast("long"), 16).alias("_hi"), F.col(value).alias("_v"), (F.col(times) if times else F.lit(1)).alias("_w"))

    def reached(counts: DataFrame, by: str, target: Column) -> DataFrame:
        """Of each key's ascending values the first at which the running count is over target, and the count before it."""
        run = counts.withColumn("_to", F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
        run = run.withColumn("_rows", F.sum("_n").over(Window.partitionBy(*keys))).where(F.col("_to") > target)
        first = run.groupBy(*keys).agg(F.min(F.struct(by, (F.col("_to") - F.col("_n")).alias("_skip"), "_rows")).alias("m"))
        return first.select(*keys, "m.*")

    middle = F.floor(F.col("_rows") / 2)
    part = reached(v.groupBy(*keys, "_hi").agg(F.sum("_w").alias("_n")), "_hi", middle)
    wanted = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_hi").alias("_part"), (F.floor(F.col("_rows") / 2) - F.col("_skip")).alias("_target"))
    same = F.col("_hi") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    low = v.join(wanted, same).groupBy(*keys, "_v", "_target").agg(F.sum("_w").alias("_n"))
    found = low.withColumn("_to", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    return found.where(F.col("_to") > F.col("_target")).groupBy(*keys).agg(F.min("_v").alias(name))


def streamed(df: DataFrame, key: str, order: list[str], step: Callable[[], Callable], schema: str) -> DataFrame:
    """Runs a state machine over each key's rows in order.

    step() makes a key's machine: a function of a dict of column lists (consecutive rows of the key) to a dict of output
    column lists, called with None once at the key's end (it may return None). Rows come sorted from a spilling sort.
    """
    dealt = df.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = pa_schema(schema)
        machine, now = None, None

        def out(rows: dict | None):
            if rows is not None and len(next(iter(rows.values()))):
                return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in kinds], schema=kinds)
            return None

        for b in batches:
            cols = b.to_pydict()
            keys, at, n = cols[key], 0, b.num_rows
            while at < n:
                k = keys[at]
                if machine is None or k != now:
                    if machine is not None and (rest := out(machine(None))) is not None:
                        yield rest
                    machine, now = step(), k
                to = at + 1
                while to < n and keys[to] == k:
                    to += 1
                if (made := out(machine({c: v[at:to] for c, v in cols.items()}))) is not None:
                    yield made
                at = to
        if machine is not None and (rest := out(machine(None))) is not None:
            yield rest

    return dealt.mapInArrow(run, schema)


def pa_schema(schema: str):
    """Arrow schema of a "name type, ..." string of plain types."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
