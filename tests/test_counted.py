"""Stage counts observed while the stages run, and the four deduplications from one exchange."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import cohortlens.plans.counted as counted
from cohortlens.operators import measures
from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.plans.registry import analysis_for
from conftest import rows

SMOKE = "/root/testdata/sf0.001"
RESULTS = ["q1_bar", "q1_bar_compat", "q2_bar", "q2_bar_compat"]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated reviews, businesses and users, null texts and dates, blank status fields."""
    reviews = [
        (f"r{i % 41}", f"u{i % 6}", f"b{i % 7}", [None, "2012-03-04", "2012", "2012!x", "2012-03-05", "soon", "2015-01-01"][i % 7 if i % 3 else i % 5], [None, "aa", "bbb", ""][i % 4])
        for i in range(200)
    ]
    businesses = [(f"b{i}", None, None, None, c) for i, c in enumerate(["Food, Bars", "Food", "Shops, Food,Food", "Pizza", None, ""])]
    users = [(f"u{i}", None, e) for i, e in enumerate(["2012, 2010", "None", "", None, "20,2013"])]
    return CohortAnalysis(
        spark.createDataFrame([*businesses, businesses[0], businesses[2]], "business_id string, name string, city string, state string, categories string"),
        spark.createDataFrame(reviews, "review_id string, user_id string, business_id string, date string, text string"),
        spark.createDataFrame([*users, users[0]], "user_id string, yelping_since string, elite string"),
        spark.createDataFrame([("food", "Food", []), ("shops", "Shops", []), ("bars", "Bars", ["food"]), ("b2", "Bars", [])], "alias string, title string, parents array<string>"),
    )


def _by_branches(a):
    return {name: getattr(a, name).count() for name in counted.STAGES}


@pytest.mark.parametrize("which", ["odd", "smoke"])
def test_counts_and_results_equal_those_of_every_stage_run_alone(spark, odd, which):
    a = odd if which == "odd" else analysis_for(spark, SMOKE)
    run = counted.run_counted(a)
    assert run.recounted == []  # the observed metrics were used
    assert run.counts == _by_branches(a)
    for name in RESULTS:
        assert rows(run.results[name], *getattr(a, name).columns) == rows(getattr(a, name)), name
    assert rows(run.to_frame(spark)) == sorted(run.counts.items())


def test_a_run_with_retried_tasks_is_counted_over_its_written_stages(spark, odd, monkeypatch):
    want = counted.run_counted(odd).counts
    monkeypatch.setattr(counted, "ran_once", lambda *a, **k: False)
    # What the metrics say must not matter then.
    monkeypatch.setattr(counted.Observation, "get", property(lambda self: 1 / 0))
    run = counted.run_counted(odd)
    assert run.counts == want and len(run.recounted) == 4


def _tracker(jobs, stages):
    tracker = SimpleNamespace(getJobIdsForGroup=lambda g: list(jobs), getJobInfo=jobs.get, getStageInfo=stages.get)
    return SimpleNamespace(sparkContext=SimpleNamespace(statusTracker=lambda: tracker))


def test_metrics_are_trusted_only_after_a_single_attempt():
    def stage(attempt=0, done=4, failed=0, active=0):
        return SimpleNamespace(currentAttemptId=attempt, numTasks=4, numCompletedTasks=done, numFailedTasks=failed, numActiveTasks=active)

    job = {1: SimpleNamespace(stageIds=[7, 8], status="SUCCEEDED")}
    once = lambda jobs, stages: counted.ran_once(_tracker(jobs, stages), "g", patience=0)
    assert once(job, {7: stage(), 8: stage()})
    assert once(job, {7: stage(), 8: stage(done=0)})  # skipped: its shuffle was there
    assert once(job, {7: stage(), 8: None})
    assert not once(job, {7: stage(attempt=1), 8: stage()})
    assert not once(job, {7: stage(failed=1), 8: stage()})  # failed, or resubmitted as its executor was lost
    assert not once(job, {7: stage(done=3, active=1), 8: stage()})
    assert not once({}, {})
    assert not once({1: None}, {})


def test_one_pass_over_the_reviews(spark, monkeypatch):
    """The reviews are read and shuffled by one write; all that follow read its table."""
    plans = []
    write = counted.write_stage
    monkeypatch.setattr(counted, "write_stage", lambda df, d=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, d))
    counted.run_counted(analysis_for(spark, SMOKE))
    assert len(plans) == 4
    assert sum("lineitem" in p for p in plans) == 1
    assert sum("CollectMetrics" in p for p in plans) == 4


def _review_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_four_grains_from_one_review_exchange(spark, odd):
    grains = measures.review_grains(odd.review)
    four = {
        "review_lengths": grains,
        "dated": grains.where("first_of_date"),
        "years": grains.where("first_of_year"),
        "lengths": grains.where("first_of_length"),
    }
    for df in four.values():
        found = _review_exchanges(df)
        assert len(found) == 1 and "user_id" in found[0] and "business_id" in found[0] and "review_id" not in found[0]
    r = odd.review.withColumn("length_of_review", F.length("text").cast("long")).withColumn("y", F.split("date", "-")[0].try_cast("int"))
    want = {
        "review_lengths": ["user_id", "date", "business_id", "review_id", "length_of_review"],
        "dated": ["user_id", "business_id", "date", "length_of_review"],
        "years": ["user_id", "y", "business_id", "length_of_review"],
        "lengths": ["user_id", "business_id", "length_of_review"],
    }
    for name, keys in want.items():
        got = four[name].withColumnRenamed("review_year", "y").select(*keys)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, r.select(*keys).distinct().collect()), key=repr), name
