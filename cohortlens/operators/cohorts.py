"""User cohorts: status from the elite field, first status year, before/after labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import (
    NO_STATUS,
    first_status_year,
    holds_status,
    pre_post_label,
    pre_post_label_compat,
    split_list,
    status_label,
    year_number,
)


def user_elite_years(users: DataFrame) -> DataFrame:
    """Users with the elite field split into the ``elites`` year list."""
    return users.select("user_id", "yelping_since", "elite", split_list("elite").alias("elites"))


def elite_users(user_years: DataFrame, compat: bool = False) -> DataFrame:
    """Users holding a status.

    compat=True is the notebook's pair of filters (list not empty, field not the
    sentinel), which keeps a blank field. The default drops null, blank and sentinel.
    """
    if compat:
        return user_years.filter((F.size("elites") >= 1) & (F.col("elite") != NO_STATUS))
    return user_years.filter(holds_status("elite"))


def user_status(users: DataFrame, compat: bool = False) -> DataFrame:
    """(user_id, elite, status) with status 'elite' / 'non-elite'."""
    return users.select("user_id", "elite", status_label("elite", compat).alias("status"))


def with_status(rows: DataFrame, users: DataFrame, compat: bool = False) -> DataFrame:
    """Attach the user's elite field and status to review rows (inner join on user_id)."""
    return rows.join(user_status(users, compat), "user_id")


def first_elite_year(user_years: DataFrame) -> DataFrame:
    """(user_id, first_elite_year) for every status holder: the earliest year in the
    user's own list. A per-row array minimum, so no shuffle and no row blow-up."""
    return (
        elite_users(user_years)
        .select("user_id", first_status_year("elites").alias("first_elite_year"))
        .filter(F.col("first_elite_year").isNotNull())
    )


def pre_post_labels(rows: DataFrame, first_years: DataFrame) -> DataFrame:
    """Label each review of a status holder 'Pre-elite review' when written in a year
    before the user's first status year, else 'Post-elite review'."""
    dated = rows.withColumn("review_year", year_number("date"))
    joined = dated.join(first_years, "user_id")
    return joined.withColumn(
        "new_filtered_elites", pre_post_label("review_year", "first_elite_year")
    )


# --- the notebook's own forms -------------------------------------------------


def exploded_elite_years(dated_with_elite: DataFrame) -> DataFrame:
    """Rows of status holders (notebook filters), one per year in their list."""
    kept = dated_with_elite.filter((F.size("elites") >= 1) & (F.col("elite") != NO_STATUS))
    return kept.select("*", F.explode("elites").alias("new_elite"))


def min_text(values: F.Column) -> F.Column:
    """Aggregate: smallest string of a group. ``min`` on strings plans a sort-based
    aggregate; the set of distinct values (a handful of status years) is a hash
    aggregate with a bounded buffer and map-side combine, and its minimum is the same."""
    return F.array_min(F.collect_set(values))


def compat_status_holders(user_years: DataFrame) -> DataFrame:
    """The notebook's status filter on users: list not empty, field not the sentinel."""
    return user_years.filter((F.size("elites") >= 1) & (F.col("elite") != NO_STATUS))


def first_elite_year_compat(dated_with_elite: DataFrame) -> DataFrame:
    """The notebook's minimum year grouped by (Category, length_of_review, date):
    users sharing those three are merged and the earliest year among them wins.

    ``min`` over the exploded years equals ``min`` over each row's ``array_min``,
    which skips the explode; the grouping (and so the result) is unchanged.
    """
    kept = dated_with_elite.filter((F.size("elites") >= 1) & (F.col("elite") != NO_STATUS))
    return kept.groupBy("Category", "length_of_review", "date").agg(
        min_text(F.array_min("elites")).alias("new_elites")
    )


def pre_post_labels_compat(first_years: DataFrame) -> DataFrame:
    """Distinct (Category, date, length_of_review, new_elites) labelled with the
    notebook's rule: 'Post' when the first year sorts after the full date."""
    return (
        first_years.select("Category", "date", "length_of_review", "new_elites")
        .distinct()
        .withColumn("new_filtered_elites", pre_post_label_compat("new_elites", "date"))
    )


__all__ = [
    "elite_users",
    "exploded_elite_years",
    "first_elite_year",
    "first_elite_year_compat",
    "pre_post_labels",
    "pre_post_labels_compat",
    "user_elite_years",
    "user_status",
    "with_status",
]
