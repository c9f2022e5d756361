"""The paths taken when join sides are too large to broadcast, and hot keys."""

import contextlib
import re

import pytest

import cohortlens.plans.pipelines as pipelines
from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.plans.registry import QUERIES, analysis_for
from conftest import rows

SMOKE = "/root/testdata/sf0.001"
COMPARED = [
    "q1_bar",
    "q1_bar_compat",
    "q2_bar",
    "q2_bar_compat",
    "q1_box_summary",
    "q2_box_summary",
    "first_elite_year_compat",
    "potential_elite_candidates",
    "length_outliers",
    "q1_by_business",
    "distinct_category_reviews",
    "dated_category_reviews",
]


@contextlib.contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def _final_plan(df):
    """The adaptive plan as finally executed (small test frames are collected)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffled_joins_give_the_same_results(spark, monkeypatch):
    expected = {name: QUERIES[name](analysis_for(spark, SMOKE)) for name in COMPARED}
    expected = {name: rows(df) for name, df in expected.items()}
    monkeypatch.setattr(pipelines, "DIMENSION_ROWS", 1)
    monkeypatch.setattr(pipelines, "TITLE_ROWS", 1)
    with conf(spark, **NO_BROADCAST):
        a = analysis_for(spark, SMOKE)
        assert not any(a._fits(x) for x in ("titles", "business_top", "status", "first_year"))
        for name in COMPARED:
            df = QUERIES[name](a)
            assert rows(df) == expected[name], name
        plan = _final_plan(a.q1_bar)
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.fixture
def hot_star(spark):
    """Business b0 and user u0 each hold a third of all reviews."""
    n = 3000
    business = spark.createDataFrame(
        [(f"b{i}", "n", None, None, "Food, Bars" if i % 2 else "Shops") for i in range(50)],
        "business_id string, name string, city string, state string, categories string",
    )
    taxonomy = spark.createDataFrame(
        [("food", "Food", []), ("shops", "Shops", []), ("bars", "Bars", ["food"])],
        "alias string, title string, parents array<string>",
    )
    users = spark.createDataFrame(
        [(f"u{i}", None, "2014, 2012" if i % 3 == 0 else "None") for i in range(40)],
        "user_id string, yelping_since string, elite string",
    )
    reviews = []
    for i in range(n):
        b = "b0" if i % 3 == 0 else f"b{i % 50}"
        u = "u0" if i % 3 == 1 else f"u{i % 40}"
        reviews.append((f"r{i}", u, b, f"{2010 + i % 7}-05-0{1 + i % 9}", "x" * (1 + (i * 37) % 400)))
    review = spark.createDataFrame(
        reviews, "review_id string, user_id string, business_id string, date string, text string"
    )
    return CohortAnalysis(business, review, users, taxonomy)


def test_hot_keys_are_split_and_results_hold(spark, monkeypatch, hot_star):
    expected = {name: rows(QUERIES[name](hot_star)) for name in ["q1_bar", "q2_bar", "reviews_with_status"]}
    monkeypatch.setattr(pipelines, "DIMENSION_ROWS", 1)
    monkeypatch.setattr(pipelines, "TITLE_ROWS", 1)
    skew = {
        **NO_BROADCAST,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.shuffle.partitions": "16",
        # Splitting works on map-output blocks; keep the tiny upstream stages at 16
        # map tasks, as large inputs would be, instead of coalescing them to one.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with conf(spark, **skew):
        a = CohortAnalysis(hot_star.business, hot_star.review, hot_star.user, hot_star.taxonomy)
        for name, want in expected.items():
            assert rows(QUERIES[name](a)) == want, name
        for name in ["reviews_with_status", "distinct_category_reviews", "dated_category_reviews", "exploded_elite_years"]:
            plan = _final_plan(getattr(a, name))
            assert "skew=true" in plan, (name, plan)


def _exchanged(df):
    """The columns that each exchange of the plan carries."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = re.split(r"\n(?=\(\d+\) )", text)
    return [re.search(r"(?:Input|Output) \[\d+\]: \[(.*)\]", b)[1] for b in blocks if re.match(r"\(\d+\) Exchange", b)]


@pytest.mark.parametrize("name", ["src_review", "review_lengths", "q1_bar", "q2_bar_compat"])
def test_no_exchange_carries_review_text(spark, name):
    carried = _exchanged(QUERIES[name](analysis_for(spark, "/root/testdata/sf0.1")))
    assert carried
    assert not any(re.search(r"\btext#", c) for c in carried), carried


def test_repeated_business_rows_do_not_repeat_distinct_reviews(hot_star):
    twice = CohortAnalysis(hot_star.business.unionAll(hot_star.business), hot_star.review, hot_star.user, hot_star.taxonomy)
    for name in ["distinct_category_reviews", "dated_category_reviews"]:
        assert rows(getattr(twice, name)) == rows(getattr(hot_star, name)), name
