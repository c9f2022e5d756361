"""Stored quantile sketches: box summaries without the rows.

One KLL sketch of the measure per group, kept as binary. Sketches of parts of the rows (days,
tables, map tasks) merge into that of all rows, in any order. A quantile read from a sketch of
``k`` has a rank within ``rank_error(k)`` of the asked one, with 99 % confidence, whatever the
data and however often sketches were merged; the count, minimum and maximum are exact, and a
group of at most ``k`` rows is held whole. A sketch of k = 800 takes at most some 20 KB.

Rows with a null measure are ignored; a group without other rows has a sketch of nothing, and
null quartiles. Merging takes sketches of one ``k``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.summaries import QUARTILES, WHISKER

SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """Bound of the normalised rank error of one quantile at 99 % confidence, as published
    for these sketches (fixed values: 2.296 and 0.9021)."""
    return 2.296 / k**0.9021


def sketch_column(measure: str = "length_of_review", k: int = SKETCH_K) -> F.Column:
    """The aggregate that makes a sketch."""
    return F.kll_sketch_agg_bigint(F.col(measure).cast("long"), F.lit(k))


def sketch(rows: DataFrame, keys: Sequence[str], measure: str = "length_of_review", k: int = SKETCH_K) -> DataFrame:
    """``_n`` (non-null) and ``_sketch`` of the measure per group; combined in the map task."""
    return rows.groupBy(*keys).agg(
        F.count(measure).alias("_n"), sketch_column(measure, k).alias("_sketch")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """One sketch per group out of those of its parts."""
    return sketches.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.kll_merge_agg_bigint("_sketch", F.lit(k)).alias("_sketch")
    )


def box_from_sketches(sketches: DataFrame, keys: Sequence[str], whisker: float = WHISKER) -> DataFrame:
    """The columns of ``box_summary``, from one sketch per group. Quartiles are values that
    occur, not interpolated."""
    held = F.col("_n") > 0  # a sketch of nothing has no quantile
    at = [0.0, *QUARTILES, 1.0]
    q = F.when(held, F.kll_sketch_get_quantile_bigint("_sketch", F.array(*[F.lit(x) for x in at])))
    low, q1, med, q3, high = (F.col("_q").getItem(i).cast("double") for i in range(5))
    iqr = q3 - q1
    return sketches.select(*keys, F.col("_n").cast("long").alias("n"), q.alias("_q")).select(
        *keys,
        "n",
        low.alias("min_length"),
        q1.alias("q1"),
        med.alias("median"),
        q3.alias("q3"),
        high.alias("max_length"),
        iqr.alias("iqr"),
        (q1 - F.lit(whisker) * iqr).alias("lower_fence"),
        (q3 + F.lit(whisker) * iqr).alias("upper_fence"),
    )


def quartile_rank_errors(counts: DataFrame, box: DataFrame, keys: Sequence[str], measure: str = "length_of_review", weight: str = "_w") -> DataFrame:
    """How far the ranks of a box summary's quartiles are from 1/4, 1/2 and 3/4, by the rows
    themselves, given as counts by value: ``q1_error``, ``median_error``, ``q3_error``. A value
    has all ranks from the share of rows below it to the share of rows not above it."""
    names = ["q1", "median", "q3"]
    joined = counts.join(box.select(*keys, *names), list(keys))
    m, w = F.col(measure), F.col(weight)
    sums = [F.sum(w).alias("_n")]
    for name in names:
        sums += [F.sum(F.when(m < F.col(name), w).otherwise(0)).alias(f"_{name}_lo"), F.sum(F.when(m <= F.col(name), w).otherwise(0)).alias(f"_{name}_hi")]
    ranked = joined.where(m.isNotNull()).groupBy(*keys).agg(*sums)
    errors = [
        F.greatest(F.lit(0.0), F.col(f"_{name}_lo") / F.col("_n") - p, F.lit(p) - F.col(f"_{name}_hi") / F.col("_n")).alias(f"{name}_error")
        for name, p in zip(names, QUARTILES, strict=True)
    ]
    return ranked.select(*keys, *errors)
