"""Join sides: broadcast only what has been counted small.

A side is broadcast only after it has been measured: one partial aggregate of its row
count and bytes, so each task sends one row. Sides derived row by row from an input are
bounded on that input instead, all in one job, so nothing is computed twice. A summary keyed by a measured category set
and a fixed set of cohorts needs no measure of its own. Otherwise the side is left to the planner: a shuffled
join, which adaptive execution may turn into a broadcast once the shuffle has
measured it, or split when one key is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bounds for broadcast sides: rows, and bytes of the rows' values. A hash relation takes
# several times the bytes, so the byte bound is far below an executor's memory.
BROADCAST_BYTES = 32 << 20
DIMENSION_ROWS = 2_000_000
# Category titles: real taxonomies hold a few thousand; summaries keyed by
# (cohort, category) then stay under a few MB.
TITLE_ROWS = 100_000

JoinSide = Callable[[DataFrame], DataFrame]


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame, by one partial aggregate."""
    size = F.lit(0)
    for f in df.schema.fields:
        wide = F.octet_length(f.name) if isinstance(f.dataType, StringType) else F.octet_length(F.col(f.name).cast("string"))
        size = size + F.coalesce(wide, F.lit(0)) + 8
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n, total


def bounds(sides: dict[str, tuple[DataFrame, Column, Column]]) -> dict[str, tuple[int, int]]:
    """Upper bounds (rows, bytes) of several sides in one job: for each the input it is
    derived from, and how many rows and bytes one row of that input can give."""
    parts = [
        df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size")).select(F.lit(name).alias("side"), "n", "size")
        for name, (df, n, size) in sides.items()
    ]
    return {x["side"]: (x["n"], x["size"]) for x in reduce(DataFrame.unionByName, parts).collect()}


def wide(name: str) -> Column:
    """The bytes of a value, as a relation's row holds it."""
    return F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 8


def fits(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a side is small enough to broadcast."""
    if max_rows <= 0:
        return False
    n, total = measure(df)
    return n <= max_rows and total <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was measured to be small."""
    if fits(df, max_rows):
        return F.broadcast(df)
    return df


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df
