"""What the operators of this subpackage share: table access, lineage cuts, words."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..materialise import checkpoint_dir, cut, remove

__all__ = ["GAP", "WORD", "checkpoint_dir", "cut", "fresh", "give_back", "hold", "known_size", "n_words", "remove", "scan_parts", "table", "utf8", "words"]

#: A word is a maximal run without ASCII white space (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without keeping them: pieces between gaps, less the empty ones at either end."""
    t = F.coalesce(text, F.lit(""))
    gap_first = t.rlike(r"\A[\x20\x09-\x0D]").cast("int")
    gap_last = t.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    pieces = F.size(F.split(t, GAP)) - gap_first - gap_last
    return F.when(t.rlike(r"[^\x20\x09-\x0D]"), pieces).otherwise(F.lit(0)).cast("long")


def give_back() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_holder: list = [None, None]


def hold(step: str, drop=None) -> None:
    """Tells that this worker process now works for a step, whose memos `drop` empties.

    Python workers outlive stages, so what another step left is dropped first and its memory goes back to the system. Both functions
    have to be of a module, as a nested function works on copies of a module's memos.
    """
    if _holder[0] != step:
        if _holder[1]:
            _holder[1]()
        _holder[:] = step, drop
        give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null is empty. No decoding takes place."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def known_size(df: DataFrame) -> bool:
    """Whether the optimizer knows a size; for rows that no scan brings it takes one beyond all bounds."""
    return _bytes(df) < 1 << 58


def scan_parts(df: DataFrame, part_bytes: int, least: int = 1, most: int = 100_000) -> int:
    """A number of parts in proportion to the size that the optimizer sees."""
    return max(least, min(most, -(-_bytes(df) // part_bytes)))
