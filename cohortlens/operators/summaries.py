"""Per-cohort summaries: mean and count, five-number box summaries, outliers,
shares above a reference quartile, gaps between cohorts, volume filters and the
list of promising users.

Grouped statistics run as partial (map-side) plus final aggregates, so a group
that holds a third of all rows is combined inside each task before any shuffle.
Exact quartiles use ``percentile`` with a frequency column: its buffer is a map
from distinct value to count, bounded by the number of distinct lengths, never by
the number of rows in the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import ELITE, NON_ELITE
from cohortlens.operators.joins import JoinSide, sized_broadcast

QUARTILES = [0.25, 0.5, 0.75]
WHISKER = 1.5
# Summaries hold one row per cohort group; bounded by categories x cohorts.
SUMMARY_ROWS = 1_000_000


def _summary_side(summary: DataFrame) -> DataFrame:
    return sized_broadcast(summary, SUMMARY_ROWS)


def mean_and_count(
    rows: DataFrame,
    keys: Sequence[str],
    measure: str = "length_of_review",
    mean_name: str = "length_of_reviews",
    count_name: str = "review_count",
) -> DataFrame:
    """``avg`` and ``count`` (non-null) of the measure per group."""
    return rows.groupBy(*keys).agg(
        F.avg(measure).alias(mean_name), F.count(measure).alias(count_name)
    )


def partial_sums(rows: DataFrame, keys: Sequence[str], measure: str = "length_of_review") -> DataFrame:
    """Integral sum and non-null count per group, the combinable form of a mean."""
    return rows.groupBy(*keys).agg(
        F.sum(measure).alias("_sum"), F.count(measure).alias("_n")
    )


def mean_from_partials(
    partials: DataFrame,
    keys: Sequence[str],
    mean_name: str = "length_of_reviews",
    count_name: str = "review_count",
) -> DataFrame:
    """Finish ``partial_sums`` rows into mean and count. For integral measures the
    result equals ``avg`` bit for bit (both divide an exact sum by the count)."""
    total = F.sum("_sum")
    n = F.sum("_n")
    return partials.groupBy(*keys).agg(
        F.when(n > 0, total / n).alias(mean_name), n.alias(count_name)
    )


def _box_columns(values: Column, weight: Column | None, exact: bool) -> list[Column]:
    if exact:
        q = F.percentile(values, QUARTILES, weight) if weight is not None else F.percentile(values, QUARTILES)
    else:
        q = F.percentile_approx(values, QUARTILES, 10_000)
    n = F.sum(weight) if weight is not None else F.count(values)
    return [
        n.alias("n"),
        F.min(values).cast("double").alias("min_length"),
        q.alias("_q"),
        F.max(values).cast("double").alias("max_length"),
    ]


def box_summary(
    rows: DataFrame,
    keys: Sequence[str],
    measure: str = "length_of_review",
    weight: str | None = None,
    exact: bool = True,
    k: float = WHISKER,
) -> DataFrame:
    """Five-number summary per group plus IQR and whisker fences (``k`` x IQR).

    ``weight`` names a count column when ``rows`` are pre-aggregated
    (value, count) pairs. Rows with a null measure are ignored, as in ``avg``.
    """
    src = rows.filter(F.col(measure).isNotNull())
    w = F.col(weight) if weight is not None else None
    if weight is not None and not exact:
        raise ValueError("approximate quartiles take unweighted rows")
    agg = src.groupBy(*keys).agg(*_box_columns(F.col(measure), w, exact))
    q1, med, q3 = (F.col("_q").getItem(i) for i in range(3))
    iqr = q3 - q1
    return agg.select(
        *keys,
        F.col("n").cast("long").alias("n"),
        "min_length",
        q1.alias("q1"),
        med.alias("median"),
        q3.alias("q3"),
        "max_length",
        iqr.alias("iqr"),
        (q1 - F.lit(k) * iqr).alias("lower_fence"),
        (q3 + F.lit(k) * iqr).alias("upper_fence"),
    )


def flag_outliers(
    rows: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    measure: str = "length_of_review",
    join_side: JoinSide = _summary_side,
) -> DataFrame:
    """Rows outside their group's whisker fences, with ``side`` 'high' or 'low'.

    The summary has one row per group; ``join_side`` decides whether it is
    broadcast (by default after a bounded count).
    """
    fences = summary.select(*keys, "lower_fence", "upper_fence")
    joined = rows.join(join_side(fences), list(keys))
    m = F.col(measure)
    side = F.when(m > F.col("upper_fence"), F.lit("high")).when(
        m < F.col("lower_fence"), F.lit("low")
    )
    return joined.withColumn("side", side).filter(F.col("side").isNotNull()).drop(
        "lower_fence", "upper_fence"
    )


def share_above_reference_q3(
    rows: DataFrame,
    summary: DataFrame,
    group_key: str,
    cohort_key: str,
    reference_cohort: str,
    measure: str = "length_of_review",
    join_side: JoinSide = _summary_side,
) -> DataFrame:
    """Per (group, cohort): rows, rows above the reference cohort's Q3 in the same
    group, and their share; both null where the reference cohort has no rows."""
    ref = summary.filter(F.col(cohort_key) == reference_cohort).select(
        group_key, F.col("q3").alias("reference_q3")
    )
    joined = rows.filter(F.col(measure).isNotNull()).join(join_side(ref), group_key, "left")
    over = F.col(measure) > F.col("reference_q3")
    above = F.when(over, 1).when(~over, 0)
    return joined.groupBy(group_key, cohort_key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(above).cast("long").alias("n_above_q3"),
        F.avg(above.cast("double")).alias("share_above_q3"),
        F.first("reference_q3").alias("reference_q3"),
    )


def cohort_gap(
    summary: DataFrame,
    group_key: str = "Category",
    cohort_key: str = "status",
    mean_col: str = "length_of_reviews",
    count_col: str = "review_count",
    first: str = ELITE,
    second: str = NON_ELITE,
    min_count: int = 0,
) -> DataFrame:
    """Per group: the two cohorts' means and counts side by side and their gap
    (first - second). Groups missing either cohort, or where either count is under
    ``min_count``, are left out. One aggregation over the (small) summary."""
    is_first = F.col(cohort_key) == first
    is_second = F.col(cohort_key) == second
    wide = summary.groupBy(group_key).agg(
        F.max(F.when(is_first, F.col(mean_col))).alias("first_mean"),
        F.max(F.when(is_first, F.col(count_col))).alias("first_count"),
        F.max(F.when(is_second, F.col(mean_col))).alias("second_mean"),
        F.max(F.when(is_second, F.col(count_col))).alias("second_count"),
    )
    kept = wide.filter(
        (F.col("first_count") >= min_count) & (F.col("second_count") >= min_count)
    )
    return kept.select(
        group_key,
        "first_mean",
        "second_mean",
        (F.col("first_mean") - F.col("second_mean")).alias("gap"),
        "first_count",
        "second_count",
    )


def min_volume(summary: DataFrame, count_col: str = "review_count", min_count: int = 1) -> DataFrame:
    """Summary rows with at least ``min_count`` reviews behind them."""
    return summary.filter(F.col(count_col) >= min_count)


def promising_users(
    rows: DataFrame,
    summary: DataFrame,
    group_key: str = "Category",
    cohort_key: str = "status",
    candidate_cohort: str = NON_ELITE,
    reference_cohort: str = NON_ELITE,
    user_key: str = "user_id",
    measure: str = "length_of_review",
    join_side: JoinSide = _summary_side,
) -> DataFrame:
    """Users of ``candidate_cohort`` with reviews above the reference cohort's Q3 in
    a group, counted per (user, group); ``tier`` is 'beyond_whisker' when at least
    one review passes the upper fence, else 'above_q3'.

    The per-user counting is a grouped aggregate with map-side combine, so a user or
    group holding many rows is reduced before its shuffle.
    """
    ref = summary.filter(F.col(cohort_key) == reference_cohort).select(
        group_key, "q3", "upper_fence"
    )
    cand = rows.filter(F.col(cohort_key) == candidate_cohort).join(join_side(ref), group_key)
    above = cand.filter(F.col(measure) > F.col("q3"))
    beyond = F.when(F.col(measure) > F.col("upper_fence"), 1).otherwise(0)
    per_user = above.groupBy(user_key, group_key).agg(
        F.count(F.lit(1)).alias("reviews_above_q3"),
        F.sum(beyond).cast("long").alias("reviews_beyond_whisker"),
        F.max(measure).alias("longest_review"),
    )
    return per_user.withColumn(
        "tier",
        F.when(F.col("reviews_beyond_whisker") > 0, F.lit("beyond_whisker")).otherwise(
            F.lit("above_q3")
        ),
    )
