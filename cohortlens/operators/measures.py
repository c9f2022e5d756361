"""Review measures: the length of each review and the year it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import text_length, year_number, year_text


def length_column(reviews: DataFrame) -> F.Column:
    """The review measure. A frame may carry it precomputed as ``length_of_review``
    (equal to the length of its text) when texts are shared between rows and are
    cheaper to measure where they are stored; otherwise it is taken from ``text``."""
    if "length_of_review" in reviews.columns:
        return F.col("length_of_review").cast("long")
    return text_length("text")


def review_lengths(reviews: DataFrame) -> DataFrame:
    """One row per distinct (user_id, date, business_id, review_id, length_of_review).

    The notebook deduplicates by grouping on the text itself. The length is taken
    in the scan stage instead, so whole texts are read once and never reach a
    shuffle; the deduplication key is the ids plus the length.
    """
    return reviews.select(
        "user_id", "date", "business_id", "review_id", length_column(reviews).alias("length_of_review")
    ).distinct()


def review_years(dated_reviews: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct (user_id, review_year, business_id, length_of_review).

    compat=True keeps the year as the leading text of the date, like the notebook;
    the default is an int year.
    """
    year = year_text("date") if compat else year_number("date")
    return dated_reviews.select(
        "user_id", year.alias("review_year"), "business_id", "length_of_review"
    ).distinct()


def review_grains(reviews: DataFrame) -> DataFrame:
    """The rows of ``review_lengths`` with three flags, so that the notebook's four
    deduplications are filters of one frame: ``first_of_date`` keeps one row of each
    (user, business, length, date), ``first_of_year`` of each (user, business, length,
    year), ``first_of_length`` of each (user, business, length).

    All four keys hold the user and the business, so one exchange on these two serves the
    distinct and the window nested above it; the window sorts once, by year, date and id.
    """
    narrow = reviews.select(
        "user_id", "business_id", "date", "review_id", length_column(reviews).alias("length_of_review")
    ).repartition("user_id", "business_id").distinct()
    dated = narrow.withColumn("review_year", year_number("date"))
    line = Window.partitionBy("user_id", "business_id", "length_of_review").orderBy("review_year", "date", "review_id")
    first = F.row_number().over(line) == 1
    changed = lambda c: first | ~F.lag(c).over(line).eqNullSafe(F.col(c))
    return dated.withColumns(
        {"first_of_length": first, "first_of_year": changed("review_year"), "first_of_date": changed("review_year") | changed("date")}
    )
