"""Sized Bloom filters on the path where a join side can't be broadcast."""

import uuid

import pytest
from pyspark.sql import functions as F

import cohortlens.operators.runtime_filter as rf
import cohortlens.plans.pipelines as pipelines
from cohortlens.config import checkpoint_dir
from cohortlens.plans.pipelines import CohortAnalysis
from conftest import rows
from test_scale_paths import NO_BROADCAST, conf, hot_star  # noqa: F401


def _parquet(spark, df):
    path = f"{checkpoint_dir(spark)}/rf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _nodes(plan):
    """The nodes of a plan as finally run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    yield plan
    if name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _shuffled(df, column):
    """Rows that the exchanges which carry a column wrote."""
    df.collect()
    found = [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec" and column in str(n.output())]
    assert found
    return sum(n.metrics().apply("shuffleRecordsWritten").value() for n in found)


@pytest.fixture(scope="module")
def many(spark):
    """20,000 reviews by 5,000 users, 100 of whom hold the status."""
    reviews = spark.range(20_000).select(
        F.concat(F.lit("r"), "id").alias("review_id"), F.concat(F.lit("u"), F.col("id") % 5000).alias("user_id"), F.concat(F.lit("b"), F.col("id") % 7).alias("business_id"),
        F.concat(F.lit(2010) + F.col("id") % 9, F.lit("-01-01")).alias("date"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"),
    )
    users = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(None).cast("string").alias("yelping_since"), F.when(F.col("id") % 50 == 0, "2012, 2014").otherwise("None").alias("elite"))
    business = spark.range(7).select(F.concat(F.lit("b"), "id").alias("business_id"), *[F.lit(None).cast("string").alias(c) for c in ("name", "city", "state")], F.lit("Food, Bars").alias("categories"))
    taxonomy = spark.createDataFrame([("food", "Food", []), ("bars", "Bars", [])], "alias string, title string, parents array<string>")
    return [_parquet(spark, df) for df in (business, reviews, users, taxonomy)]


def test_the_filter_stands_below_the_shuffle_and_few_rows_pass(spark, many):
    reviews, holders = many[1], many[2].where("elite <> 'None'")
    with conf(spark, **NO_BROADCAST):
        marked = rf.marked_keys(holders, "user_id")
        n = marked.count()
        plain = rf.known(reviews, marked, "user_id")
        assert _shuffled(plain, "review_id") == 20_000
        want = rows(plain)
        with rf.runtime_filters(spark, n):
            df = rf.known(reviews, marked, "user_id")
            passed = _shuffled(df, "review_id")
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "might_contain" in plan and "bloom_filter_agg(xxhash64(user_id" in plan and f"{n}, {rf.filter_bits(n)}" in plan
            assert rows(df) == want and len(want) == 400
        # 400 rows have a partner; of the others about the rate asked for may pass.
        assert 400 <= passed <= 400 + 2 * rf.RATE * 19_600


def test_question_2_is_the_same_with_the_filter(spark, many, monkeypatch):
    results = ["q2_bar", "q2_box_summary", "q2_bar_compat", "first_elite_year_compat"]
    want = {name: rows(getattr(CohortAnalysis(*many), name)) for name in results}
    used = []
    keep = pipelines.keep_known
    monkeypatch.setattr(pipelines, "keep_known", lambda *a: used.append(a) or keep(*a))
    monkeypatch.setattr(pipelines, "DIMENSION_ROWS", 1)
    with conf(spark, **NO_BROADCAST):
        a = CohortAnalysis(*many)
        for name in results:
            assert rows(getattr(a, name)) == want[name], name
    assert len(used) >= 2


def test_sizes_follow_the_items():
    for items in (1, 100, 10**6, 2 * 10**7):
        bits = rf.filter_bits(items)
        assert rf.false_positives(items, bits) <= rf.RATE * 1.1
    assert rf.filter_bits(10**12) == rf.MAX_BITS
    assert list(rf.filter_conf(10**12).values()) == ["false"]  # a filter full of ones keeps everything


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in rf.filter_conf(10)}
    with pytest.raises(ZeroDivisionError):
        with rf.runtime_filters(spark, 10):
            assert spark.conf.get(rf._PREFIX + "expectedNumItems") == "10"
            1 / 0
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_no_holders_and_null_keys(spark, many):
    with conf(spark, **NO_BROADCAST):
        assert rf.keep_known(many[1], many[2].limit(0), "user_id").count() == 0
        odd = spark.createDataFrame([(None, 1), ("u0", 2)], "user_id string, x int")
        assert rows(rf.keep_known(odd, many[2], "user_id")) == [("u0", 2)]
