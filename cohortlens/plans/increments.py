"""Both summaries kept up to date over new partitions of reviews.

Reviews come by ingest date. For each date two tables are kept: its *registry*, the distinct
narrow identities (no text) of its reviews, and its *partials*, the sums and counts per cohort
and category of the reviews it owns. A result merges the partials of all dates, a few rows.

Repeats across dates. A review that several dates hold counts once: its owner is the
smallest date that holds it. Settling a date takes its registry without the identities of
smaller dates. So dates may come in any order and be sent again: an update re-settles the date
and, of the larger ones, those that hold an identity which the date gained or lost.

Reviews of two dates are compared only in the years that both hold, and a date that is new or
alone is not compared at all: its registry is what it brings. Settling a date makes both
questions' partials in one pass, in which reviews meet the users once and the businesses once.
Partials are made with the users, businesses and taxonomy given; when these change,
``rebuild`` makes all partials anew from the registries, without the reviews. An update
that was cut off is completed by sending the date again.

With ``sketch_k`` a quantile sketch per cohort and category is kept beside the sums, so that
``box`` gives quartiles of all dates, or of those up to one, without the reviews.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import write_stage
from cohortlens.functions.columns import first_status_year, holds_status, pre_post_label, split_list, year_number
from cohortlens.operators import cohorts, measures, sketches, summaries
from cohortlens.operators.joins import broadcast_if
from cohortlens.plans.pipelines import Q2_LABEL, CohortAnalysis

IDENTITY = ["user_id", "date", "business_id", "review_id", "length_of_review"]
KEYS = {"q1": ["status", "Category"], "q2": ["Category", Q2_LABEL]}
_DATE = re.compile(r"^[0-9A-Za-z_-]+$")


class IncrementalSummaries:
    def __init__(self, spark: SparkSession, folder: str, business: DataFrame, user: DataFrame, taxonomy: DataFrame, id_type: str = "string", sketch_k: int | None = None):
        self.sketch_k = sketch_k
        self.spark, self.folder = spark, folder.rstrip("/")
        self.business, self.user, self.taxonomy = business, user, taxonomy
        self.schema = f"user_id {id_type}, date string, business_id {id_type}, review_id string, length_of_review long, review_year int, ingest_date string"
        sums = ", _sum long, _n long, ingest_date string"
        self.tables = {"registry": self.schema} | {name: ", ".join(f"{k} string" for k in keys) + sums for name, keys in KEYS.items()}
        if sketch_k:
            held = ", _n long, _sketch binary, ingest_date string"
            self.tables |= {f"{name}_sketch": ", ".join(f"{k} string" for k in keys) + held for name, keys in KEYS.items()}
        for name, schema in self.tables.items():  # an empty table to read from
            spark.createDataFrame([], schema).write.mode("append").partitionBy("ingest_date").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.tables[name]).parquet(f"{self.folder}/{name}")

    def _replace(self, name: str, date: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/ingest_date={date}")

    @property
    def registry(self) -> DataFrame:
        return self._read("registry")

    def dates(self) -> list[str]:
        return sorted(x.ingest_date for x in self.registry.select("ingest_date").distinct().collect())

    def update(self, date: str, reviews: DataFrame) -> list[str]:
        """Take the reviews of one ingest date, in place of those it held. Returns the dates
        that were settled."""
        if not _DATE.match(date):
            raise ValueError(f"{date!r} can't name a partition")
        fresh = measures.review_lengths(reviews).withColumn("review_year", year_number("date"))
        fresh = fresh.select(*IDENTITY, "review_year")
        old = self.registry.where(F.col("ingest_date") == date).select(*fresh.columns)
        if old.isEmpty():  # a new date gains all that it brings
            self._replace("registry", date, fresh)
            changed = self.registry.where(F.col("ingest_date") == date).select(*fresh.columns)
        else:
            fresh = write_stage(fresh)
            changed = write_stage(_minus(old, fresh).unionByName(_minus(fresh, old)))
            self._replace("registry", date, fresh)
        later = self.registry.where(F.col("ingest_date") > date)
        touched = []
        if not later.isEmpty():
            later, changed = _near(later, changed), _near(changed, later)
            touched = sorted(x.ingest_date for x in _matching(later, changed, "left_semi").select("ingest_date").distinct().collect())
        for d in [date, *touched]:
            self._settle(d)
        return [date, *touched]

    def rebuild(self) -> None:
        """All partials anew, after users, businesses or the taxonomy have changed."""
        for date in self.dates():
            self._settle(date)

    def owned(self, date: str) -> DataFrame:
        """The reviews of a date that no smaller date holds. Only those of years that smaller
        dates hold too are compared."""
        own = self.registry.where(F.col("ingest_date") == date).drop("ingest_date")
        before = self.registry.where(F.col("ingest_date") < date)
        years = _years(before)
        if not years:
            return own
        shared = _in_years(years)
        return own.where(~shared).unionByName(_minus(own.where(shared), _near(before, own)))

    def _settle(self, date: str) -> None:
        """One pass over the owned reviews: partials by both questions' cohorts at once, a few
        rows, out of which each question's are merged."""
        a = _Owned(self.business, self.owned(date).select(*IDENTITY), self.user, self.taxonomy)
        both = write_stage(a.partials_of_both(self.sketch_k))
        for name, keys in KEYS.items():
            rows = both.where(F.col(Q2_LABEL).isNotNull()) if name == "q2" else both
            sums = rows.groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
            self._replace(name, date, sums.coalesce(1))  # cohorts x categories rows
            if self.sketch_k:
                self._replace(f"{name}_sketch", date, sketches.merge_sketches(rows, keys, self.sketch_k).coalesce(1))

    @property
    def q1_bar(self) -> DataFrame:
        return summaries.mean_from_partials(self._read("q1"), KEYS["q1"])

    @property
    def q2_bar(self) -> DataFrame:
        return summaries.mean_from_partials(self._read("q2"), KEYS["q2"], mean_name="length_of_review", count_name="review_counts")

    def box(self, name: str, until: str | None = None) -> DataFrame:
        """The box summary of question ``q1`` or ``q2`` from the stored sketches, over all dates
        or those up to ``until``: a review is owned by its smallest date, so these hold each
        review that came until then once."""
        if not self.sketch_k:
            raise ValueError("no sketches are kept; give sketch_k")
        held = self._read(f"{name}_sketch")
        if until is not None:
            held = held.where(F.col("ingest_date") <= until)
        return sketches.box_from_sketches(sketches.merge_sketches(held, KEYS[name], self.sketch_k), KEYS[name])


class _Owned(CohortAnalysis):
    """An analysis of reviews that are distinct already."""

    @property
    def review_lengths(self) -> DataFrame:
        return self.review

    def partials_of_both(self, sketch_k: int | None) -> DataFrame:
        """Sums, counts and, if asked for, a quantile sketch per (status, label, Category);
        the label is null where question 2 has none. Reviews meet each side once."""
        first = F.when(holds_status("elite"), first_status_year(split_list("elite"))).alias("first_elite_year")
        users = cohorts.user_status(self.user).select("user_id", "status", first)
        rows = self.review_lengths.select("user_id", "business_id", year_number("date").alias("review_year"), "length_of_review")
        rows = rows.join(broadcast_if(users, self._fits("status")), "user_id").drop("user_id")
        # A sketch takes rows one by one and is large, so these meet their few categories first.
        tagged = rows.join(self._business_top_side, "business_id")
        tagged = tagged.withColumn(Q2_LABEL, pre_post_label("review_year", "first_elite_year"))
        aggs = [F.sum("length_of_review").alias("_sum"), F.count("length_of_review").alias("_n")]
        if sketch_k:
            aggs.append(sketches.sketch_column("length_of_review", sketch_k).alias("_sketch"))
        return tagged.groupBy("status", Q2_LABEL, "Category").agg(*aggs)


def _years(rows: DataFrame) -> list[int | None]:
    """The review years of some registered rows: a few."""
    return [x.review_year for x in rows.select("review_year").distinct().collect()]


def _in_years(years: list[int | None]) -> F.Column:
    year = F.col("review_year")
    known = F.coalesce(year.isin([y for y in years if y is not None]), F.lit(False))
    return known | year.isNull() if None in years else known


def _near(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of a year that ``other`` holds: a review's year is part of its identity."""
    return rows.where(_in_years(_years(other)))


def _matching(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the whole identity, null equal to null."""
    names = other.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    return rows.join(names, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]), how)


def _minus(rows: DataFrame, other: DataFrame) -> DataFrame:
    return _matching(rows, other, "left_anti")
