"""The two cohort questions composed from the operators, lazily.

``CohortAnalysis`` holds the four inputs and exposes every stage of both questions
as a DataFrame, in the corrected form (default) and in the notebook's own form
(``*_compat``). Nothing runs until an action is called on a returned frame, apart
from the one job that bounds the join sides, and the written review stage that the
outlier, share and candidate analyses read twice.

Plan shape of the headline summaries (``q1_bar``, ``q2_bar`` and the box
summaries):

1. review length is taken in the scan stage; the text never reaches a shuffle;
2. reviews are deduplicated on ids + length (one shuffle of narrow rows);
3. the user's status (or first status year) is joined on ``user_id``;
4. where the business -> category side is broadcast, rows fan out to categories in the
   map task and are combined there, per (cohort, Category): few groups, few rows shuffled;
5. otherwise rows are aggregated per (business, cohort) before they meet that side.

Steps 3 and 4 broadcast a side only after counting it under a bound; otherwise they
stay shuffled joins under adaptive execution (runtime broadcast, skew splitting).
The data-dependent sides (titles, business -> category, user status, first status
year) are bounded together, when a query first needs one, on the inputs they come from.
Summaries keyed by (cohort, category) are bounded by the counted title set times the
fixed cohorts, so they are broadcast on that proof without a count of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import write_stage
from cohortlens.functions.columns import NON_ELITE
from cohortlens.operators import cohorts, measures, summaries, taxonomy
from cohortlens.operators.joins import BROADCAST_BYTES, DIMENSION_ROWS, TITLE_ROWS, bounds, broadcast_if, wide
from cohortlens.operators.runtime_filter import keep_known
from cohortlens.operators.sketches import SKETCH_K, sketch
from cohortlens.schemas import check_schema

Q2_LABEL = "new_filtered_elites"


def _count_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))


class CohortAnalysis:
    def __init__(self, business: DataFrame, review: DataFrame, user: DataFrame, taxonomy_df: DataFrame):
        self.business = check_schema(business, "business")
        self.review = check_schema(review, "review")
        self.user = check_schema(user, "user")
        self.taxonomy = check_schema(taxonomy_df, "taxonomy")

    @classmethod
    def from_star(cls, star) -> "CohortAnalysis":
        return cls(star.business, star.review, star.user, star.taxonomy)

    def materialize(self, *stages: str, fallback_dir: str | None = None) -> "CohortAnalysis":
        """Checkpoint the named stages into the shared ``spark.checkpoint.dir`` and use
        the written copies from then on. Outputs built afterwards read the files, so
        several outputs share one computation and a lost executor costs a re-read,
        not a re-run of the lineage."""
        from cohortlens.config import cut_lineage

        for name in stages:
            frame = getattr(self, name)
            if not isinstance(frame, DataFrame):
                raise ValueError(f"{name} is not a stage frame")
            self.__dict__[name] = cut_lineage(frame, fallback_dir)
        return self

    # -- taxonomy and businesses -------------------------------------------------

    @cached_property
    def top_level_taxonomy(self) -> DataFrame:
        return taxonomy.top_level_taxonomy(self.taxonomy)

    @cached_property
    def top_level_titles(self) -> DataFrame:
        return taxonomy.top_level_titles(self.taxonomy)

    @cached_property
    def top_level_titles_compat(self) -> DataFrame:
        return taxonomy.top_level_titles(self.taxonomy, compat=True)

    @cached_property
    def business_category_list(self) -> DataFrame:
        return taxonomy.business_category_list(self.business)

    # -- join sides -------------------------------------------------------------------

    @cached_property
    def _bounds(self) -> dict[str, tuple[int, int]]:
        """Upper bounds (rows, bytes) of the data-dependent join sides, by one job over the
        three small inputs: a business gives at most a row for each entry of its list, a user
        one row, a root category one title."""
        entries = F.when(F.col("categories").isNull(), 0).otherwise(F.length("categories") - F.length(F.replace("categories", F.lit(","))) + 1)
        user = wide("user_id") + wide("elite") + 8
        root = F.when(F.size("parents") == 0, 1).otherwise(0)
        found = bounds(
            {
                "business_top": (self.business.select("business_id", "categories"), entries, entries * (wide("business_id") + 8) + wide("categories")),
                "status": (self.user.select("user_id", "elite"), F.lit(1), user),
                "titles": (self.taxonomy.select("title", "parents"), root, root * wide("title")),
            }
        )
        return found | {"first_year": found["status"]}

    def _fits(self, side: str) -> bool:
        """Whether a data-dependent join side is small enough to broadcast."""
        n, size = self._bounds[side]
        return n <= (TITLE_ROWS if side == "titles" else DIMENSION_ROWS) and size <= BROADCAST_BYTES

    def _titles_side(self, titles: DataFrame) -> DataFrame:
        return broadcast_if(titles, self._fits("titles"))

    def _summary_side(self, summary: DataFrame) -> DataFrame:
        # Rows <= cohorts x titles, and the titles were measured under TITLE_ROWS.
        return broadcast_if(summary, self._fits("titles"))

    @cached_property
    def business_top_level(self) -> DataFrame:
        return taxonomy.business_top_level(
            self.business_category_list, self.top_level_titles, join_side=self._titles_side
        )

    @cached_property
    def _business_top_side(self) -> DataFrame:
        """(business_id, Category) as a join side, broadcast when counted small."""
        return broadcast_if(
            self.business_top_level.select("business_id", "Category"), self._fits("business_top")
        )

    def _category_pairs_side(self) -> DataFrame:
        """Like ``_business_top_side``, each pair once even if business rows repeat, so that
        rows distinct before the fan-out are distinct after it."""
        pairs = self.business_top_level.select("business_id", "Category").distinct()
        return broadcast_if(pairs, self._fits("business_top"))

    def _by_category(self, rows: DataFrame, keys: list[str], aggregate: Callable[[DataFrame, list[str]], DataFrame], side: DataFrame | None = None) -> DataFrame:
        """Partial aggregates by Category and ``keys``, to be combined by the caller. A
        broadcast business side fans out in the map task, where few groups combine well;
        otherwise rows are aggregated per business before they meet it."""
        side = self._business_top_side if side is None else side
        if self._fits("business_top"):
            return aggregate(rows.join(side, "business_id"), [*keys, "Category"])
        return aggregate(rows, ["business_id", *keys]).join(side, "business_id")

    # -- reviews -----------------------------------------------------------------

    @cached_property
    def review_lengths(self) -> DataFrame:
        return measures.review_lengths(self.review)

    @cached_property
    def review_grains(self) -> DataFrame:
        """``review_lengths`` with the flags of the notebook's three coarser deduplications."""
        return measures.review_grains(self.review)

    @cached_property
    def category_reviews(self) -> DataFrame:
        """Review rows tagged with each top-level category of their business (k rows
        for a business with k categories)."""
        return self.review_lengths.join(self._business_top_side, "business_id").select(
            "business_id", "Category", "review_id", "length_of_review", "date", "user_id"
        )

    @cached_property
    def distinct_category_reviews(self) -> DataFrame:
        """The notebook's Q1 deduplication: drops review id and date, so equal-length
        reviews by one user of one business collapse. Rows are deduplicated before the
        fan-out, so the join has an exchange of its own that can be split."""
        return self._distinct_reviews.join(self._category_pairs_side(), "business_id").select(
            "user_id", "business_id", "Category", "length_of_review"
        )

    @cached_property
    def _distinct_reviews(self) -> DataFrame:
        return self.review.select(
            "user_id", "business_id", measures.length_column(self.review).alias("length_of_review")
        ).distinct()

    # -- users -------------------------------------------------------------------

    @cached_property
    def user_elite_years(self) -> DataFrame:
        return cohorts.user_elite_years(self.user)

    @cached_property
    def elite_users(self) -> DataFrame:
        return cohorts.elite_users(self.user_elite_years)

    def _status_side(self, compat: bool = False) -> DataFrame:
        """(user_id, elite, status) as a join side, broadcast when counted small
        (one row per user, so the user count bounds it)."""
        return broadcast_if(cohorts.user_status(self.user, compat), self._fits("status"))

    @cached_property
    def _first_year_side(self) -> DataFrame:
        return broadcast_if(self.first_elite_year, self._fits("first_year"))

    # -- question 1: status holders against the others ---------------------------

    @cached_property
    def reviews_with_status(self) -> DataFrame:
        return self.category_reviews.join(self._status_side(), "user_id").select(
            "user_id", "business_id", "review_id", "Category", "length_of_review", "elite", "status"
        )

    @cached_property
    def reviews_with_status_compat(self) -> DataFrame:
        return self.distinct_category_reviews.join(self._status_side(compat=True), "user_id").select(
            "user_id", "Category", "length_of_review", "elite", "status"
        )

    def q1_partials(self, compat: bool = False) -> DataFrame:
        """Mergeable sums behind ``q1_bar``."""
        # The finer review-level dedupe would be subsumed by the compat one.
        rows = self._distinct_reviews if compat else self.review_lengths
        side = self._category_pairs_side() if compat else None  # that dedupe holds the category
        return self._by_category(rows.join(self._status_side(compat), "user_id"), ["status"], summaries.partial_sums, side)

    def q1_partials_compat(self) -> DataFrame:
        return self.q1_partials(compat=True)

    @cached_property
    def q1_bar(self) -> DataFrame:
        """Mean length and review count per (status, Category), review grain."""
        return summaries.mean_from_partials(self.q1_partials(), ["status", "Category"])

    @cached_property
    def q1_bar_compat(self) -> DataFrame:
        return summaries.mean_from_partials(self.q1_partials_compat(), ["status", "Category"])

    @cached_property
    def q1_box_rows(self) -> DataFrame:
        return self.reviews_with_status.select("status", "Category", "length_of_review")

    @cached_property
    def q1_box_summary(self) -> DataFrame:
        """Exact quartiles per (status, Category), from counts per length."""
        return summaries.box_summary(self.q1_length_counts, ["status", "Category"], weight="_w")

    @cached_property
    def q1_length_counts(self) -> DataFrame:
        """Partial counts ``_w`` by (status, Category, length)."""
        rows = self.review_lengths.join(self._status_side(), "user_id")
        return self._by_category(rows, ["status", "length_of_review"], _count_rows)

    def q1_sketches(self, k: int = SKETCH_K) -> DataFrame:
        """Mergeable quantile sketches behind ``q1_box_summary``."""
        rows = self.review_lengths.join(self._status_side(), "user_id")
        return self._sketched(rows, "status", k)

    def _sketched(self, rows: DataFrame, cohort: str, k: int) -> DataFrame:
        """Rows meet their categories before they are sketched: one sketch per cohort and
        category in a map task, never one per business, which would outgrow the rows."""
        return sketch(rows.join(self._business_top_side, "business_id"), [cohort, "Category"], k=k)

    @cached_property
    def q1_by_business(self) -> DataFrame:
        """Question 1 keyed by business instead of category. Reviews of unknown businesses
        are left out; businesses without a top-level category stay."""
        known = self.business.select("business_id")
        rows = self.review_lengths.join(known, "business_id", "left_semi").join(self._status_side(), "user_id")
        return summaries.mean_and_count(rows, ["status", "business_id"])

    # -- question 2: before against after the first status year ------------------

    @cached_property
    def first_elite_year(self) -> DataFrame:
        return cohorts.first_elite_year(self.user_elite_years)

    @cached_property
    def pre_post_labels(self) -> DataFrame:
        """Every category-tagged review of a status holder with its label, which is null when
        the review has no year."""
        return cohorts.pre_post_labels(self.category_reviews, self._first_year_side)

    @cached_property
    def _narrow_reviews(self) -> DataFrame:
        return self.review.select(
            "user_id", "date", "business_id", "review_id", measures.length_column(self.review).alias("length_of_review")
        )

    def _reviews_of(self, holders: DataFrame, side: str) -> DataFrame:
        """The reviews of some users, chosen before the dedupe: by a broadcast where the users
        were measured small, else by a sized Bloom filter below the shuffle."""
        users = holders.select("user_id")
        if self._fits(side):
            return self._narrow_reviews.join(F.broadcast(users), "user_id", "left_semi")
        return keep_known(self._narrow_reviews, users, "user_id")

    def _q2_labelled(self) -> DataFrame:
        """Labelled reviews before the category fan-out; those without a label are left out."""
        rows = measures.review_lengths(self._reviews_of(self.first_elite_year, "first_year"))
        return cohorts.pre_post_labels(rows, self._first_year_side).filter(F.col(Q2_LABEL).isNotNull())

    def q2_partials(self) -> DataFrame:
        """Mergeable sums behind ``q2_bar``."""
        return self._by_category(self._q2_labelled(), [Q2_LABEL], summaries.partial_sums)

    @cached_property
    def q2_bar(self) -> DataFrame:
        return summaries.mean_from_partials(
            self.q2_partials(), ["Category", Q2_LABEL], mean_name="length_of_review", count_name="review_counts"
        )

    @cached_property
    def q2_box_rows(self) -> DataFrame:
        return self.pre_post_labels.select("Category", "length_of_review", Q2_LABEL).filter(F.col(Q2_LABEL).isNotNull())

    @cached_property
    def q2_box_summary(self) -> DataFrame:
        return summaries.box_summary(self.q2_length_counts, ["Category", Q2_LABEL], weight="_w")

    @cached_property
    def q2_length_counts(self) -> DataFrame:
        """Partial counts ``_w`` by (Category, label, length)."""
        return self._by_category(self._q2_labelled(), [Q2_LABEL, "length_of_review"], _count_rows)

    def q2_sketches(self, k: int = SKETCH_K) -> DataFrame:
        """Mergeable quantile sketches behind ``q2_box_summary``."""
        return self._sketched(self._q2_labelled(), Q2_LABEL, k)

    # -- question 2, the notebook's form ------------------------------------------

    @cached_property
    def dated_category_reviews(self) -> DataFrame:
        """Deduplicated before the fan-out, like ``distinct_category_reviews``."""
        rows = self.review.select(
            "user_id", "business_id", "date", measures.length_column(self.review).alias("length_of_review")
        ).distinct()
        return rows.join(self._category_pairs_side(), "business_id").select(
            "user_id", "business_id", "date", "Category", "length_of_review"
        )

    @cached_property
    def review_years(self) -> DataFrame:
        return measures.review_years(self.dated_category_reviews)

    @cached_property
    def review_years_compat(self) -> DataFrame:
        return measures.review_years(self.dated_category_reviews, compat=True)

    @cached_property
    def dated_reviews_with_elite(self) -> DataFrame:
        users = self.user_elite_years.select("user_id", "elite", "elites")
        return self.dated_category_reviews.join(users, "user_id").select(
            "date", "length_of_review", "business_id", "user_id", "Category", "elite", "elites"
        )

    @cached_property
    def exploded_elite_years(self) -> DataFrame:
        return cohorts.exploded_elite_years(self.dated_reviews_with_elite)

    @cached_property
    def first_elite_year_compat(self) -> DataFrame:
        """Same rows as ``cohorts.first_elite_year_compat(dated_reviews_with_elite)``.

        A minimum does not change under deduplication, so the review and
        (user, business, date, category, length) dedupes are skipped, and the minimum
        is finished per (Category, length, date).
        """
        holders = cohorts.compat_status_holders(self.user_elite_years).select(
            "user_id", F.array_min("elites").alias("_first")
        )
        small = self._fits("status")
        rows = self._narrow_reviews if small else self._reviews_of(holders, "status")
        holders = broadcast_if(holders, small)
        firsts = self._by_category(
            rows.join(holders, "user_id"), ["length_of_review", "date"],
            lambda rows, keys: rows.groupBy(*keys).agg(cohorts.min_text(F.col("_first")).alias("_first")),
        )
        return firsts.groupBy("Category", "length_of_review", "date").agg(
            cohorts.min_text(F.col("_first")).alias("new_elites")
        )

    @cached_property
    def pre_post_labels_compat(self) -> DataFrame:
        return cohorts.pre_post_labels_compat(self.first_elite_year_compat)

    @cached_property
    def q2_bar_compat(self) -> DataFrame:
        return summaries.mean_and_count(
            self.pre_post_labels_compat,
            ["Category", Q2_LABEL],
            mean_name="length_of_review",
            count_name="review_counts",
        )

    # -- distribution analyses ------------------------------------------------------

    @cached_property
    def _written_reviews(self) -> DataFrame:
        """The deduplicated reviews with their status, before the category fan-out, written
        once in the shared folder: a box summary and the rows held against it both read it."""
        rows = self.review_lengths.join(self._status_side(), "user_id")
        return write_stage(rows.select("review_id", "user_id", "business_id", "status", "length_of_review"))

    def _written_rows(self, *columns: str) -> DataFrame:
        """``reviews_with_status`` rows over the written stage."""
        return self._written_reviews.join(self._business_top_side, "business_id").select(*columns)

    @cached_property
    def _written_box(self) -> DataFrame:
        """``q1_box_summary`` over the written stage."""
        counts = self._by_category(self._written_reviews, ["status", "length_of_review"], _count_rows)
        return summaries.box_summary(counts, ["status", "Category"], weight="_w")

    @cached_property
    def length_outliers(self) -> DataFrame:
        return summaries.flag_outliers(
            self._written_rows("status", "Category", "review_id", "user_id", "business_id", "length_of_review"),
            self._written_box,
            ["status", "Category"],
            join_side=self._summary_side,
        )

    @cached_property
    def share_above_q3(self) -> DataFrame:
        return summaries.share_above_reference_q3(
            self._written_rows("status", "Category", "length_of_review"),
            self._written_box,
            "Category",
            "status",
            NON_ELITE,
            join_side=self._summary_side,
        )

    def category_gap(self, min_count: int = 0) -> DataFrame:
        return summaries.cohort_gap(self.q1_bar, min_count=min_count)

    def volume_filter(self, min_count: int) -> DataFrame:
        return summaries.min_volume(self.q1_bar, "review_count", min_count)

    @cached_property
    def potential_elite_candidates(self) -> DataFrame:
        rows = self._written_rows("user_id", "Category", "status", "length_of_review")
        return summaries.promising_users(rows, self._written_box, join_side=self._summary_side)
