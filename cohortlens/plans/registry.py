"""Every stage and result of the analysis as a named, output-ready query.

Outputs hold no arrays (lists are rendered with ``array_join``) and integral
columns are bigint, so results compare cleanly with other engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import checkpoint_dir, write_stage
from cohortlens.functions.columns import ELITE, NO_STATUS, NON_ELITE, POST_LABEL, PRE_LABEL, year_number
from cohortlens.operators.sketches import SKETCH_K, quartile_rank_errors
from cohortlens.plans.colocated import ColocatedAnalysis
from cohortlens.plans.counted import run_counted
from cohortlens.plans.increments import KEYS, IncrementalSummaries
from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.plans.views import Q1_SQL, Q2_SQL, register_views, typed
from cohortlens.sources.colocated import ingest
from cohortlens.sources.quarantine import read_quarantined
from cohortlens.sources.sized import export_sized, read_sized
from cohortlens.sources.sinks import tsv_lines
from cohortlens.sources.testdata import load_star
from cohortlens.streaming import label_changes, q2_bar, review_events, start_q2_bar_stream, status_events

# Parameters of the registered analyses.
VOLUME_MIN_COUNT = 2_000  # summary rows backed by fewer reviews are dropped
LIST_JOIN = "|"


def _long(name: str) -> F.Column:
    return F.col(name).cast("long").alias(name)


def _src_review(a: CohortAnalysis) -> DataFrame:
    return a.review.select(
        "review_id",
        "user_id",
        "business_id",
        "date",
        "text_sha256",
        F.col("length_of_review").alias("text_length"),
    )


def _src_taxonomy(a: CohortAnalysis) -> DataFrame:
    return a.taxonomy.select(
        "alias",
        "title",
        F.array_join("parents", LIST_JOIN).alias("parents_list"),
        F.size("parents").cast("long").alias("n_parents"),
    )


def _business_category_list(a: CohortAnalysis) -> DataFrame:
    return a.business_category_list.select(
        "business_id",
        "name",
        "city",
        "state",
        F.array_join("catList", LIST_JOIN).alias("cat_list"),
        F.size("catList").cast("long").alias("n_categories"),
    )


def _user_elite_years(a: CohortAnalysis) -> DataFrame:
    return a.user_elite_years.select(
        "user_id",
        "yelping_since",
        "elite",
        F.array_join("elites", LIST_JOIN).alias("elite_list"),
        F.size("elites").cast("long").alias("n_elites"),
    )


def _pre_post_labels(a: CohortAnalysis) -> DataFrame:
    return a.pre_post_labels.select(
        "business_id",
        "Category",
        "review_id",
        "length_of_review",
        "date",
        "user_id",
        _long("review_year"),
        _long("first_elite_year"),
        "new_filtered_elites",
    )


def _elite_list(rows: DataFrame) -> DataFrame:
    return rows.select(
        "date",
        "length_of_review",
        "business_id",
        "user_id",
        "Category",
        "elite",
        F.array_join("elites", LIST_JOIN).alias("elite_list"),
    )


def _category_gap(a: CohortAnalysis) -> DataFrame:
    return a.category_gap(0).select(
        "Category",
        F.col("first_mean").alias("elite_mean"),
        F.col("second_mean").alias("non_elite_mean"),
        "gap",
        F.col("first_count").alias("elite_count"),
        F.col("second_count").alias("non_elite_count"),
    )


def _review_grains(a: CohortAnalysis) -> DataFrame:
    flags = ["first_of_length", "first_of_year", "first_of_date"]
    return a.review_grains.select(
        "user_id", "business_id", "date", "review_id", "length_of_review", _long("review_year"), *[_long(c) for c in flags]
    )


def _colocated(a: CohortAnalysis, key: str) -> ColocatedAnalysis:
    """The analysis over tables in buckets of ``key``, written into the shared folder. The
    adapter's reviews carry their measure, so their repeated texts are not copied."""
    folder = f"{checkpoint_dir(a.review.sparkSession)}/colocated-{uuid.uuid4().hex}"
    reviews = a.review.select("review_id", "user_id", "business_id", "date", "length_of_review")
    tables = ingest(reviews, a.user if key == "user_id" else a.business, key, folder)
    return ColocatedAnalysis(tables, a.business, a.user, a.taxonomy)


def _typed(a: CohortAnalysis, text: str, **args: str) -> DataFrame:
    prefix = f"v{uuid.uuid4().hex}_"
    register_views(a, prefix, ["business_top_level", "review_lengths", "dated_category_reviews", "user_elite_years"])
    return typed(a, text, prefix, none=NO_STATUS, **args)


INGEST_YEARS = 3  # review years that come together


def _arrived(a: CohortAnalysis) -> CohortAnalysis:
    """The analysis over the narrow reviews, written once: the adapter's joins run once."""
    reviews = write_stage(a.review.select("review_id", "user_id", "business_id", "date", "length_of_review"))
    return CohortAnalysis(a.business, reviews, a.user, a.taxonomy)


def _incremental(a: CohortAnalysis, sketch_k: int | None = None) -> IncrementalSummaries:
    """The summaries after the reviews came in ingests of some years each, the second half
    first; each ingest repeats some reviews of the years before, which count once."""
    spark, reviews = a.review.sparkSession, a.review
    part = F.floor(year_number("date") / INGEST_YEARS)
    parts = sorted(x.p for x in reviews.select(part.alias("p")).distinct().collect())
    kept = IncrementalSummaries(spark, f"{checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}", a.business, a.user, a.taxonomy, id_type="bigint", sketch_k=sketch_k)
    half = len(parts) // 2
    for p in parts[half:] + parts[:half]:
        kept.update(f"{p:06d}", reviews.where((part == p) | ((part == p - 1) & (F.col("business_id") % 5 == 0))))
    return kept


def _streamed(a: CohortAnalysis) -> DataFrame:
    """Question 2 after two runs of its stream: the reviews of odd businesses and each user's
    newest status year only, then the other reviews, some repeated ones, and the whole lists."""
    spark = a.review.sparkSession
    folder = f"{checkpoint_dir(spark)}/q2-stream-{uuid.uuid4().hex}"
    reviews = write_stage(a.review.select("review_id", "user_id", "business_id", "date", "length_of_review"))
    users = a.user.select("user_id", "elite")
    odd = F.col("business_id") % 2 == 1
    newest = users.select("user_id", F.split_part("elite", F.lit(","), F.lit(1)).alias("elite"))
    for some, lists in ((reviews.where(odd), newest), (reviews.where(~odd | (F.col("business_id") % 5 == 0)), users)):
        some.write.mode("append").parquet(f"{folder}/reviews")
        lists.write.mode("append").parquet(f"{folder}/users")
        came = review_events(spark.readStream.schema(reviews.schema).parquet(f"{folder}/reviews"))
        listed = status_events(spark.readStream.schema(users.schema).parquet(f"{folder}/users"))
        query = start_q2_bar_stream(label_changes(came.unionByName(listed)), a.business_top_level, folder)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return q2_bar(spark, folder)


def _quarantined_users(a: CohortAnalysis) -> DataFrame:
    """Users as JSON lines, of each seven one cut off and one without its identifier, read
    back: good rows and the quarantine."""
    spark = a.user.sparkSession
    path = f"{checkpoint_dir(spark)}/users-{uuid.uuid4().hex}"
    user = a.user.withColumn("user_id", F.col("user_id").cast("string"))
    whole, keyless = F.to_json(F.struct("user_id", "elite")), F.to_json(F.struct("elite"))
    kind = F.col("user_id").cast("long") % 7
    line = F.when(kind == 0, F.left(whole, F.lit(12))).when(kind == 1, keyless).otherwise(whole)
    user.select(line.alias("value")).write.text(path)
    good, bad = read_quarantined(spark, "user", path)
    return good.select("user_id", "elite").unionByName(bad.select("line", "reason"), allowMissingColumns=True)


def _sized(a: CohortAnalysis) -> DataFrame:
    """The rows of question 1 out of files of one MB each, read back by their manifest."""
    path = f"{checkpoint_dir(a.review.sparkSession)}/sized-{uuid.uuid4().hex}"
    rows = a.q1_box_rows
    export_sized(rows, path, 1 << 20)
    return read_sized(a.review.sparkSession, path, rows.schema)


#: A rank error that no quartile passes: over nine standard deviations at ``SKETCH_K``.
RANK_TOLERANCE = 0.02


def _box_sketched(a: CohortAnalysis, name: str) -> DataFrame:
    """The box summary merged from sketches stored by ingest: what sketches hold exactly, and
    whether each quartile's rank, counted over all reviews, is within the tolerance."""
    keys = KEYS[name]
    box = write_stage(_incremental(a, SKETCH_K).box(name))
    errors = quartile_rank_errors(getattr(a, f"{name}_length_counts"), box, keys)
    near = [(F.col(f"{q}_error") <= RANK_TOLERANCE).alias(f"{q}_near") for q in ("q1", "median", "q3")]
    return box.join(errors, keys).select(*keys, "n", "min_length", "max_length", *near)


QUERIES: dict[str, Callable[[CohortAnalysis], DataFrame]] = {
    # sources (adapter output in the analysis's own schema)
    "src_business": lambda a: a.business,
    "src_review": _src_review,
    "src_user": lambda a: a.user,
    "src_taxonomy": _src_taxonomy,
    # taxonomy and businesses
    "top_level_taxonomy": lambda a: a.top_level_taxonomy,
    "top_level_titles": lambda a: a.top_level_titles,
    "top_level_titles_compat": lambda a: a.top_level_titles_compat,
    "business_category_list": _business_category_list,
    "business_top_level": lambda a: a.business_top_level,
    # reviews and users
    "review_lengths": lambda a: a.review_lengths,
    "category_reviews": lambda a: a.category_reviews,
    "distinct_category_reviews": lambda a: a.distinct_category_reviews,
    "user_elite_years": _user_elite_years,
    "elite_users": lambda a: a.elite_users.select("user_id", "elite"),
    # question 1
    "reviews_with_status": lambda a: a.reviews_with_status,
    "reviews_with_status_compat": lambda a: a.reviews_with_status_compat,
    "q1_bar": lambda a: a.q1_bar,
    "q1_bar_compat": lambda a: a.q1_bar_compat,
    "q1_box_rows": lambda a: a.q1_box_rows,
    "q1_box_summary": lambda a: a.q1_box_summary,
    "q1_by_business": lambda a: a.q1_by_business,
    # question 2, corrected
    "first_elite_year": lambda a: a.first_elite_year.select("user_id", _long("first_elite_year")),
    "pre_post_labels": _pre_post_labels,
    "q2_bar": lambda a: a.q2_bar,
    "q2_box_rows": lambda a: a.q2_box_rows,
    "q2_box_summary": lambda a: a.q2_box_summary,
    # question 2, the notebook's form
    "dated_category_reviews": lambda a: a.dated_category_reviews,
    "review_years": lambda a: a.review_years.select(
        "user_id", _long("review_year"), "business_id", "length_of_review"
    ),
    "review_years_compat": lambda a: a.review_years_compat,
    "dated_reviews_with_elite": lambda a: _elite_list(a.dated_reviews_with_elite),
    "exploded_elite_years": lambda a: a.exploded_elite_years.drop("elites"),
    "first_elite_year_compat": lambda a: a.first_elite_year_compat,
    "pre_post_labels_compat": lambda a: a.pre_post_labels_compat,
    "q2_bar_compat": lambda a: a.q2_bar_compat,
    # distribution analyses
    "length_outliers": lambda a: a.length_outliers,
    "share_above_q3": lambda a: a.share_above_q3,
    "category_gap": _category_gap,
    "volume_filter": lambda a: a.volume_filter(VOLUME_MIN_COUNT),
    "potential_elite_candidates": lambda a: a.potential_elite_candidates,
    # chart files: the lines of the four exports
    "q1_bar_tsv": lambda a: tsv_lines(a.q1_bar),
    "q1_box_rows_tsv": lambda a: tsv_lines(a.q1_box_rows),
    "q2_bar_tsv": lambda a: tsv_lines(a.q2_bar),
    "q2_box_rows_tsv": lambda a: tsv_lines(a.q2_box_rows),
    "q1_box_rows_sized": _sized,
    # input with bad lines
    "quarantined_users": _quarantined_users,
    # over tables in buckets of the join key
    "category_reviews_colocated": lambda a: _colocated(a, "business_id").rows("category_reviews"),
    "reviews_with_status_colocated": lambda a: _colocated(a, "user_id").rows("reviews_with_status"),
    "dated_reviews_with_elite_colocated": lambda a: _elite_list(_colocated(a, "user_id").rows("dated_reviews_with_elite")),
    "q1_bar_colocated": lambda a: _colocated(a, "user_id").q1_bar,
    "q2_bar_colocated": lambda a: _colocated(a, "user_id").q2_bar,
    # typed in SQL over session views
    "q1_bar_compat_sql": lambda a: _typed(a, Q1_SQL, holder=ELITE, other=NON_ELITE),
    "q2_bar_compat_sql": lambda a: _typed(a, Q2_SQL, post=POST_LABEL, pre=PRE_LABEL),
    # kept up to date over ingests of reviews
    "q1_bar_incremental": lambda a: _incremental(_arrived(a)).q1_bar,
    "q2_bar_incremental": lambda a: _incremental(_arrived(a)).q2_bar,
    "q2_bar_streamed": _streamed,
    # quartiles from stored sketches
    "q1_box_sketched": lambda a: _box_sketched(_arrived(a), "q1"),
    "q2_box_sketched": lambda a: _box_sketched(_arrived(a), "q2"),
    # operations
    "stage_counts": lambda a: run_counted(a).to_frame(a.review.sparkSession),
    "review_grains": _review_grains,
}


def analysis_for(spark: SparkSession, sf_dir: str) -> CohortAnalysis:
    return CohortAnalysis.from_star(load_star(spark, sf_dir))


def build(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](analysis_for(spark, sf_dir))
