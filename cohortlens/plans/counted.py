"""Both questions in both forms from one pass over the reviews, with the row count of every
stage taken while the stage is made.

The notebook prints a count after every step, each of which runs its step again. Here the
reviews are shuffled once, into ``review_grains`` (whose flags stand for the notebook's
deduplications), and the stages that feed each other are made in one plan that carries
``observe`` metrics: a stage that is a filter or a multiple of another's rows is counted
by a conditional sum where those rows pass.

Retried tasks. Spark adds a task's metrics when the task ends. A result task that ends twice
is added once, but a map task that is run again after its executor was lost is added
again. Each write therefore runs in a job group of its own, and its metrics are used only if
no stage of the group was attempted twice and no task failed; otherwise the same
expressions are counted over the written stages, which hold each row once.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.config import write_stage
from cohortlens.functions.columns import NO_STATUS, first_status_year, holds_status, pre_post_label, pre_post_label_compat, status_label
from cohortlens.operators import cohorts, measures, summaries, taxonomy
from cohortlens.operators.joins import broadcast_if
from cohortlens.plans.pipelines import Q2_LABEL, CohortAnalysis

#: The stages that are counted, in the notebook's order, then those of the corrected form.
STAGES = [
    "business_category_list", "business_top_level", "review_lengths", "category_reviews", "distinct_category_reviews",
    "reviews_with_status_compat", "q1_bar_compat", "dated_category_reviews", "review_years", "dated_reviews_with_elite",
    "exploded_elite_years", "first_elite_year_compat", "pre_post_labels_compat", "q2_bar_compat", "reviews_with_status",
    "q1_bar", "pre_post_labels", "q2_bar",
]


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def _when(flag: Column, value: Column | int = 1) -> Column:
    return F.when(flag, value).otherwise(0)


def ran_once(spark: SparkSession, group: str, patience: float = 5.0) -> bool:
    """Whether every stage of a finished job group ran in one attempt without a failed task.
    What can't be read (the status store keeps a limited number of stages) counts as no."""
    tracker = spark.sparkContext.statusTracker()
    end = time.monotonic() + patience
    while True:
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        if not jobs or any(j is None for j in jobs):
            return False
        stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
        stages = [s for s in stages if s is not None and (s.numActiveTasks or s.numCompletedTasks or s.numFailedTasks)]  # others were skipped
        if any(s.numFailedTasks or s.currentAttemptId for s in stages):
            return False
        if stages and all(j.status == "SUCCEEDED" for j in jobs) and all(s.numCompletedTasks == s.numTasks for s in stages):
            return True
        if time.monotonic() > end:  # the status store lags behind the run
            return False
        time.sleep(0.05)


@dataclass
class CountedRun:
    """The four summaries, the written stages and the row count of every stage."""

    results: dict[str, DataFrame]
    stages: dict[str, DataFrame]
    counts: dict[str, int]
    recounted: list[str] = field(default_factory=list)  # writes whose metrics were not used

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.counts.items()), "stage string, rows long")


class _Counter:
    """Observes frames within one write at a time."""

    def __init__(self, spark: SparkSession, fallback_dir: str | None):
        self.spark, self.fallback_dir = spark, fallback_dir
        self.counts: dict[str, int] = {}
        self.recounted: list[str] = []
        self._open: list[tuple[Observation, DataFrame, dict[str, Column]]] = []

    def observe(self, df: DataFrame, **metrics: Column) -> DataFrame:
        watch = Observation(uuid.uuid4().hex)
        self._open.append((watch, df, metrics))
        return df.observe(watch, *[m.alias(name) for name, m in metrics.items()])

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df``, and settle the metrics observed below it."""
        sc, group = self.spark.sparkContext, f"counted-{name}-{uuid.uuid4().hex}"
        before = {p: sc.getLocalProperty(p) for p in ("spark.jobGroup.id", "spark.job.description")}
        sc.setJobGroup(group, f"write {name}")
        try:
            out = write_stage(df, self.fallback_dir)
        finally:
            for p, v in before.items():
                sc.setLocalProperty(p, v)
        watched, self._open = self._open, []
        if ran_once(self.spark, group):
            for watch, _, metrics in watched:
                self.counts |= {m: watch.get[m] for m in metrics}
        else:
            self.recounted.append(name)
            for _, rows, metrics in watched:
                self.counts |= rows.agg(*[c.alias(m) for m, c in metrics.items()]).first().asDict()
        return out


def run_counted(a: CohortAnalysis, fallback_dir: str | None = None) -> CountedRun:
    spark = a.review.sparkSession
    c = _Counter(spark, fallback_dir)

    lists = c.observe(a.business_category_list, business_category_list=_sum(F.lit(1)))
    tops = taxonomy.business_top_level(lists, a.top_level_titles, join_side=a._titles_side)
    pairs = _pairs(c.observe(tops, business_top_level=_sum(F.lit(1))))
    pairs = broadcast_if(c.write("pairs", pairs), a._fits("business_top"))

    grains = c.write("review_grains", c.observe(measures.review_grains(a.review), review_lengths=_sum(F.lit(1))))

    # One pass: the fan-out, the users, and the sums of both forms of question 1 and of question 2.
    tagged = c.observe(
        grains.join(pairs, "business_id"),
        category_reviews=_sum(F.col("times")),
        distinct_category_reviews=_sum(_when(F.col("first_of_length"))),
        dated_category_reviews=_sum(_when(F.col("first_of_date"))),
        review_years=_sum(_when(F.col("first_of_year") & F.col("first_pair"))),
    )
    with_users = c.observe(
        tagged.join(broadcast_if(_users(a), a._fits("status")), "user_id"),
        reviews_with_status=_sum(F.col("times")),
        reviews_with_status_compat=_sum(_when(F.col("first_of_length"))),
        pre_post_labels=_sum(_when(F.col("first_elite_year").isNotNull(), F.col("times"))),
        dated_reviews_with_elite=_sum(_when(F.col("first_of_date"))),
        exploded_elite_years=_sum(_when(F.col("first_of_date") & F.col("compat_holder"), F.col("n_years"))),
    )
    length, once = F.col("length_of_review"), F.when(F.col("first_of_length"), 1)
    sums = with_users.withColumn(Q2_LABEL, pre_post_label("review_year", "first_elite_year")).groupBy("status", "status_compat", "Category", Q2_LABEL).agg(
        F.sum(length * F.col("times")).alias("total"), F.sum(F.when(length.isNotNull(), F.col("times"))).alias("n"), F.sum(F.col("times")).alias("rows"),
        F.sum(length * once).alias("total_compat"), F.sum(F.when(length.isNotNull(), once)).alias("n_compat"), F.sum(once).alias("rows_compat"),
    )
    sums = c.write("sums", sums)
    results = {
        "q1_bar": _finish(sums, ["status", "Category"], "total", "n", "rows", "length_of_reviews", "review_count"),
        "q1_bar_compat": _finish(sums.withColumn("status", F.col("status_compat")), ["status", "Category"], "total_compat", "n_compat", "rows_compat", "length_of_reviews", "review_count"),
        "q2_bar": _finish(sums.where(F.col(Q2_LABEL).isNotNull()), ["Category", Q2_LABEL], "total", "n", "rows", "length_of_review", "review_counts"),
    }

    # The notebook's question 2 merges users, so it groups the same rows once more.
    holders = broadcast_if(_users(a).where("compat_holder").select("user_id", "first_text"), a._fits("status"))
    dated = grains.where("first_of_date").join(holders, "user_id").join(pairs, "business_id")
    firsts = dated.groupBy("Category", "length_of_review", "date").agg(cohorts.min_text(F.col("first_text")).alias("new_elites"))
    firsts = c.observe(firsts, first_elite_year_compat=_sum(F.lit(1)))
    # Each group is one row, so the notebook's distinct over the labelled groups keeps all.
    labelled = firsts.withColumn(Q2_LABEL, pre_post_label_compat("new_elites", "date"))
    labelled = c.write("pre_post_labels_compat", c.observe(labelled, pre_post_labels_compat=_sum(F.lit(1))))
    results["q2_bar_compat"] = summaries.mean_and_count(labelled, ["Category", Q2_LABEL], mean_name="length_of_review", count_name="review_counts")

    # The summaries are a few rows over written tables.
    few = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in results.items()]
    c.counts |= {x["stage"]: x["n"] for x in reduce(DataFrame.unionByName, few).collect()}
    return CountedRun(results, {"review_grains": grains, "sums": sums, "pre_post_labels_compat": labelled}, {k: c.counts[k] for k in STAGES}, c.recounted)


def _pairs(tops: DataFrame) -> DataFrame:
    """(business_id, Category, times, first_pair): each pair once with its repeats, and one
    marked for each business."""
    pairs = tops.groupBy("business_id", "Category").agg(F.count(F.lit(1)).alias("times"))
    return pairs.withColumn("first_pair", F.row_number().over(Window.partitionBy("business_id").orderBy("Category")) == 1)


def _users(a: CohortAnalysis) -> DataFrame:
    """What both forms ask of a user, one row for each row of the users."""
    return a.user_elite_years.select(
        "user_id",
        status_label("elite").alias("status"),
        status_label("elite", compat=True).alias("status_compat"),
        F.when(holds_status("elite"), first_status_year("elites")).alias("first_elite_year"),
        F.coalesce((F.size("elites") >= 1) & (F.col("elite") != NO_STATUS), F.lit(False)).alias("compat_holder"),
        F.size("elites").alias("n_years"),
        F.array_min("elites").alias("first_text"),
    )


def _finish(sums: DataFrame, keys: list[str], total: str, n: str, rows: str, mean_name: str, count_name: str) -> DataFrame:
    """Means and counts per ``keys`` of the groups that hold rows."""
    whole, count = F.sum(total), F.coalesce(F.sum(n), F.lit(0))
    found = sums.groupBy(*keys).agg(F.when(count > 0, whole / count).alias(mean_name), count.alias(count_name), F.sum(rows).alias("_rows"))
    return found.where("_rows > 0").drop("_rows")
