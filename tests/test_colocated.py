"""Reviews in buckets of the join key: no review exchange, hot keys apart, equal results."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import cohortlens.plans.pipelines as pipelines
from cohortlens.config import checkpoint_dir
from cohortlens.plans.colocated import ColocatedAnalysis
from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.plans.registry import analysis_for
from cohortlens.sources.colocated import HOT, ingest, open_tables
from conftest import rows
from test_scale_paths import NO_BROADCAST, conf, hot_star  # noqa: F401

SMOKE = "/root/testdata/sf0.001"


def _ingested(a, key, buckets=6):
    folder = f"{checkpoint_dir(a.review.sparkSession)}/co-{uuid.uuid4().hex}"
    tables = ingest(a.review, a.user if key == "user_id" else a.business, key, folder, buckets)
    return folder, tables, ColocatedAnalysis(tables, a.business, a.user, a.taxonomy)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\bExchange (\w+\(?[^)]*\)?)", plan)


@pytest.mark.parametrize("key,stages", [("user_id", ["review_lengths", "reviews_with_status", "dated_reviews_with_elite"]), ("business_id", ["review_lengths", "category_reviews"])])
def test_bucketed_reviews_are_joined_without_an_exchange(spark, hot_star, monkeypatch, key, stages):  # noqa: F811
    _, tables, co = _ingested(hot_star, key)
    # Only the co-located side is past the broadcast bound, as on a large input.
    fits = CohortAnalysis._fits
    big = {"user_id": ("status", "first_year"), "business_id": ("business_top",)}[key]
    monkeypatch.setattr(pipelines.CohortAnalysis, "_fits", lambda self, side: side not in big and fits(self, side))
    with conf(spark, **NO_BROADCAST):
        for stage in stages:
            df = getattr(co.bucketed, stage)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, plan
            carried = [x for x in _exchanges(df) if key in x]
            # The category lists are exploded before they meet their bucket, so that side alone is dealt again.
            assert len(carried) <= (stage == "category_reviews"), (stage, plan)
            if stage != "review_lengths":
                assert "SortMergeJoin" in plan, plan
                review_side = [line for line in plan.splitlines() if "Exchange" in line and "review_id" in line]
                assert not review_side, plan


@pytest.mark.parametrize("key", ["user_id", "business_id"])
def test_hot_keys_stand_apart_and_all_stages_are_equal(spark, hot_star, key):  # noqa: F811
    _, tables, co = _ingested(hot_star, key)
    hot = {r[key] for r in tables.hot_reviews.select(key).distinct().collect()}
    assert hot == {"u0" if key == "user_id" else "b0"}
    assert tables.reviews.where(F.col(key).isin(list(hot))).count() == 0
    assert tables.reviews.count() + tables.hot_reviews.count() == hot_star.review.count()
    for stage in ["review_lengths", "category_reviews", "reviews_with_status", "reviews_with_status_compat", "pre_post_labels", "dated_reviews_with_elite"]:
        want = getattr(hot_star, stage)
        assert sorted(map(tuple, co.rows(stage).select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), stage
    for result in ["q1_bar", "q1_bar_compat", "q2_bar"]:
        want = getattr(hot_star, result)
        assert rows(getattr(co, result), *want.columns) == rows(want), result


def test_hot_keys_are_few_whatever_the_counts(spark):
    from cohortlens.sources.colocated import hot_keys

    for counts in ([1000], [10] * 50, [100, 100, 1], [1], []):
        reviews = spark.createDataFrame([(f"k{i}",) for i, n in enumerate(counts) for _ in range(n)], "k string")
        for buckets in (1, 4, 16):
            found = hot_keys(reviews, "k", buckets).count()
            assert found <= buckets / HOT
            assert found == sum(n * buckets > HOT * sum(counts) for n in counts)


def test_null_keys_and_empty_inputs(spark, hot_star):  # noqa: F811
    nobody = hot_star.review.withColumn("user_id", F.when(F.col("user_id") == "u0", None).otherwise(F.col("user_id")))
    for review in (nobody, nobody.limit(0)):
        a = CohortAnalysis(hot_star.business, review, hot_star.user, hot_star.taxonomy)
        _, tables, co = _ingested(a, "user_id")
        assert rows(co.q1_bar, "status", "Category", "review_count") == rows(a.q1_bar, "status", "Category", "review_count")
        assert tables.reviews.count() + tables.hot_reviews.count() == review.count()


def test_tables_open_in_another_session(spark, hot_star):  # noqa: F811
    folder, tables, co = _ingested(hot_star, "user_id")
    want = rows(co.q1_bar)
    other = spark.newSession()
    for t in spark.catalog.listTables():
        if t.name.startswith("colocated_"):
            spark.sql(f"DROP TABLE `{t.name}`")  # the files stay
    again = open_tables(other, folder)
    plan = again.reviews.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    strangers = [other.createDataFrame(df.collect(), df.schema) for df in (hot_star.business, hot_star.user, hot_star.taxonomy)]
    assert rows(ColocatedAnalysis(again, *strangers).q1_bar) == want


def test_without_hot_keys_the_reviews_run_for_the_count_and_one_write(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return True

    reviews = spark.range(400).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 100).alias("user_id"))
    reviews = reviews.where(F.udf(look, "boolean")("review_id"))
    t = ingest(reviews, spark.range(100).withColumnRenamed("id", "user_id"), "user_id", f"{checkpoint_dir(spark)}/cold-{uuid.uuid4().hex}")
    assert seen.value == 2 * 400
    assert (t.reviews.count(), t.hot_reviews.count(), t.partner.count(), t.hot_partner.count()) == (400, 0, 100, 0)
