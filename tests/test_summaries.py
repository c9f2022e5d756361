import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import summaries
from conftest import rows

SCHEMA = "g string, v long"


def _box_data(spark):
    data = [("spread", v) for v in list(range(1, 10)) + [100]]
    data += [("one", 5), ("flat", 7), ("flat", 7), ("flat", 7), ("spread", None)]
    return spark.createDataFrame(data, SCHEMA)


def test_box_summary_matches_linear_quartiles(spark):
    got = {r["g"]: r for r in summaries.box_summary(_box_data(spark), ["g"], measure="v").collect()}
    vals = np.array(list(range(1, 10)) + [100], dtype=float)
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    s = got["spread"]
    assert (s["n"], s["min_length"], s["max_length"]) == (10, 1.0, 100.0)
    assert (s["q1"], s["median"], s["q3"]) == (q1, med, q3)
    assert s["upper_fence"] == q3 + 1.5 * (q3 - q1)
    one, flat = got["one"], got["flat"]
    assert (one["q1"], one["median"], one["q3"], one["iqr"]) == (5.0, 5.0, 5.0, 0.0)
    assert (flat["iqr"], flat["lower_fence"], flat["upper_fence"]) == (0.0, 7.0, 7.0)


def test_weighted_box_equals_row_box(spark):
    df = _box_data(spark)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    a = summaries.box_summary(df, ["g"], measure="v")
    b = summaries.box_summary(counts, ["g"], measure="v", weight="w")
    assert rows(a) == rows(b)


def test_outliers_and_zero_iqr(spark):
    df = _box_data(spark)
    summary = summaries.box_summary(df, ["g"], measure="v")
    out = summaries.flag_outliers(df, summary, ["g"], measure="v")
    # 100 is past the upper fence; equal values with zero IQR are never outliers.
    assert rows(out, "g", "v", "side") == [("spread", 100, "high")]


def test_mean_from_partials_equals_avg(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 2), ("a", "y", 4), ("b", "x", None), ("a", "x", 7)],
        "k string, sub string, v long",
    )
    direct = summaries.mean_and_count(df, ["k"], measure="v")
    partial = summaries.partial_sums(df, ["k", "sub"], measure="v")
    finished = summaries.mean_from_partials(partial, ["k"])
    assert rows(direct) == rows(finished)
    assert dict(rows(finished, "k", "review_count")) == {"a": 4, "b": 0}


def test_gap_volume_share_and_candidates(spark):
    summary = spark.createDataFrame(
        [("elite", "A", 10.0, 50), ("non-elite", "A", 8.0, 40), ("elite", "B", 5.0, 3)],
        "status string, Category string, length_of_reviews double, review_count long",
    )
    gap = summaries.cohort_gap(summary, min_count=10)
    assert rows(gap, "Category", "gap") == [("A", 2.0)]
    assert rows(summaries.min_volume(summary, min_count=40), "Category", "status") == [
        ("A", "elite"), ("A", "non-elite")
    ]
    rws = spark.createDataFrame(
        [("u1", "A", "non-elite", v) for v in [1, 2, 3, 4]]
        + [("u2", "A", "non-elite", 100), ("u3", "A", "elite", 50), ("u4", "A", "non-elite", 4)],
        "user_id string, Category string, status string, length_of_review long",
    )
    box = summaries.box_summary(rws, ["status", "Category"])
    share = summaries.share_above_reference_q3(rws, box, "Category", "status", "non-elite")
    got = {r["status"]: (r["n"], r["n_above_q3"]) for r in share.collect()}
    assert got == {"non-elite": (6, 1), "elite": (1, 1)}
    cands = summaries.promising_users(rws, box)
    assert rows(cands, "user_id", "tier") == [("u2", "beyond_whisker")]


def test_approximate_quartiles_close_to_exact(spark):
    df = spark.range(0, 5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 1000).alias("v"))
    exact = summaries.box_summary(df, ["g"], measure="v").first()
    approx = summaries.box_summary(df, ["g"], measure="v", exact=False).first()
    for q in ("q1", "median", "q3"):
        assert abs(exact[q] - approx[q]) <= 2, q
    assert approx["n"] == exact["n"] == 5000
