"""Stored quantile sketches: merging, rank error, prefixes of dates."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.config import checkpoint_dir
from cohortlens.operators.sketches import box_from_sketches, merge_sketches, quartile_rank_errors, rank_error, sketch
from cohortlens.plans.increments import KEYS, IncrementalSummaries
from cohortlens.plans.pipelines import CohortAnalysis
from conftest import rows
from test_increments import DAYS, _frame
from test_pipelines import star  # noqa: F401


def test_merged_sketches_keep_the_stated_rank_error(spark):
    # A hot group with two thirds of the rows, few and many distinct values, 30 days.
    r = spark.range(240_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        (F.col("id") % 30).alias("day"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("length_of_review"),
    )
    k = 200
    merged = merge_sketches(sketch(r, ["g", "day"], k=k), ["g"], k)
    box = box_from_sketches(merged, ["g"])
    counts = r.groupBy("g", "length_of_review").agg(F.count("*").alias("_w"))
    errors = quartile_rank_errors(counts, box, ["g"]).collect()
    assert len(errors) == 5
    # Three times the 99 % bound: some eight standard deviations.
    assert all(e[c] <= 3 * rank_error(k) for e in errors for c in ("q1_error", "median_error", "q3_error"))
    exact = r.groupBy("g").agg(F.count("*").alias("n"), F.min("length_of_review").cast("double").alias("min_length"), F.max("length_of_review").cast("double").alias("max_length"))
    assert rows(box, "g", "n", "min_length", "max_length") == rows(exact)


def test_small_groups_are_held_whole_and_nulls_ignored(spark):
    rng = random.Random(3)
    values = [rng.randrange(1000) for _ in range(99)]
    r = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", None), ("c", 7)], "g string, length_of_review long")
    got = {x.g: x for x in box_from_sketches(sketch(r, ["g"]), ["g"]).collect()}
    s = sorted(values)
    assert (got["a"].n, got["a"].min_length, got["a"].q1, got["a"].median, got["a"].q3, got["a"].max_length) == (99, s[0], s[24], s[49], s[74], s[-1])
    assert got["a"].upper_fence == s[74] + 1.5 * (s[74] - s[24])
    assert got["b"].n == 0 and got["b"].median is None and got["b"].upper_fence is None
    assert (got["c"].q1, got["c"].iqr) == (7, 0)
    none = sketch(r.where("false"), ["g"])
    assert box_from_sketches(merge_sketches(none, ["g"]), ["g"]).collect() == []


def test_rank_errors_by_hand(spark):
    counts = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 9, 1)], "g string, length_of_review long, _w long")
    box = spark.createDataFrame([("a", 1.0, 9.0, 2.0)], "g string, q1 double, median double, q3 double")
    e = quartile_rank_errors(counts, box, ["g"]).first()
    assert e.q1_error == 0 and abs(e.median_error - 0.4) < 1e-12 and e.q3_error == 0


def test_stored_sketches_equal_one_sketch_of_all_reviews(spark, star):  # noqa: F811
    kept = IncrementalSummaries(spark, f"{checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}", star.business, star.user, star.taxonomy, sketch_k=800)
    for i in (2, 0, 3, 1):
        day = list(DAYS)[i]
        kept.update(day, _frame(spark, star, DAYS[day]))
    for until in (None, "2024-01-02"):
        came = [r for d in DAYS if until is None or d <= until for r in DAYS[d]]
        a = CohortAnalysis(star.business, _frame(spark, star, came), star.user, star.taxonomy)
        for name, parts in (("q1", a.q1_sketches()), ("q2", a.q2_sketches())):
            whole = box_from_sketches(merge_sketches(parts, KEYS[name]), KEYS[name])
            assert rows(kept.box(name, until)) == rows(whole)
    exact = CohortAnalysis(star.business, _frame(spark, star, [r for d in DAYS.values() for r in d]), star.user, star.taxonomy).q1_box_summary
    assert rows(kept.box("q1"), "status", "Category", "n", "min_length", "max_length") == rows(exact, "status", "Category", "n", "min_length", "max_length")


def test_without_sketches_there_is_no_box(spark, star):  # noqa: F811
    kept = IncrementalSummaries(spark, f"{checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}", star.business, star.user, star.taxonomy)
    with pytest.raises(ValueError):
        kept.box("q1")


@pytest.mark.parametrize("parts", ["q1_sketches", "q2_sketches"])
def test_no_sketch_per_business_where_businesses_cant_be_broadcast(spark, star, parts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(CohortAnalysis, "_fits", lambda self, side: side == "first_year")
    plan = getattr(star, parts)()._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.splitlines() if "kll_sketch_agg" in x]
    assert len(made) == 1 and "business_id" not in made[0]
