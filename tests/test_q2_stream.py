"""Question 2 as a stream: late status lists re-label, repeats count once, any order."""

import glob
import os
import tempfile
import time

import pytest

from cohortlens.plans.pipelines import CohortAnalysis
from cohortlens.streaming import label_changes, q2_bar, review_events, start_q2_bar_stream, status_events
from conftest import rows
from test_pipelines import REVIEWS, star  # noqa: F401

USER = "user_id string, yelping_since string, elite string"
#: Steps of (reviews, status lists): labels come late, fall twice, and one user never has any.
STEPS = [
    (REVIEWS[20:], []),
    ([], [("u1", "2014"), ("u3", "None"), ("u2", "None")]),
    (REVIEWS[:25], [("u1", "2012, 2014"), ("u4", "2016")]),
    (REVIEWS[:3], [("u1", "2016, 2010"), ("u3", "2015"), ("u1", "2013"), ("u5", None), ("u4", "")]),
]


class _Stream:
    def __init__(self, spark, star):  # noqa: F811
        self.spark, self.star, self.top = spark, star, tempfile.mkdtemp(prefix="cohortlens-q2-")
        for name in ("reviews", "users"):
            os.mkdir(f"{self.top}/{name}")

    def step(self, reviews, users):
        """Some rows come; the stream takes them and stops, its state staying behind."""
        s = self.spark
        if reviews:
            s.createDataFrame(reviews, self.star.review.schema).coalesce(1).write.mode("append").parquet(f"{self.top}/reviews")
        if users:
            s.createDataFrame([(u, None, e) for u, e in users], USER).coalesce(1).write.mode("append").parquet(f"{self.top}/users")
        r = s.readStream.schema(self.star.review.schema).parquet(f"{self.top}/reviews")
        u = s.readStream.schema(USER).parquet(f"{self.top}/users")
        changes = label_changes(review_events(r, salts=3).unionByName(status_events(u, salts=3)))
        query = start_q2_bar_stream(changes, self.star.business_top_level, self.top)
        assert query.awaitTermination(120)
        return rows(q2_bar(s, self.top), "Category", "new_filtered_elites", "length_of_review", "review_counts")


def _batch(spark, star, steps):  # noqa: F811
    """The batch result over all that came; a user's lists are one list."""
    reviews = [r for came, _ in steps for r in came]
    lists = {}
    for _, users in steps:
        for u, e in users:
            lists.setdefault(u, []).append(e or "")
    users = spark.createDataFrame([(u, None, ", ".join(x for x in e if x not in ("", "None"))) for u, e in lists.items()], USER)
    a = CohortAnalysis(star.business, spark.createDataFrame(reviews, star.review.schema), users, star.taxonomy)
    return rows(a.q2_bar, "Category", "new_filtered_elites", "length_of_review", "review_counts")


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 0, 1]])
def test_stream_equals_batch_after_each_step(spark, star, order):  # noqa: F811
    stream, came = _Stream(spark, star), []
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    for i in order:
        came.append(STEPS[i])
        got = stream.step(*STEPS[i])
        assert got == _batch(spark, star, came)
    assert got and spark.conf.get(name) == before


def test_identities_expire_and_sums_stay(spark, star):  # noqa: F811
    top = tempfile.mkdtemp(prefix="cohortlens-q2-")
    os.mkdir(f"{top}/users")
    for n in (1, 2):
        spark.createDataFrame([REVIEWS[0]], star.review.schema).coalesce(1).write.mode("append").parquet(f"{top}/reviews")
        spark.createDataFrame([("u1", None, f"201{n}")], USER).coalesce(1).write.mode("append").parquet(f"{top}/users")
        events = review_events(spark.readStream.schema(star.review.schema).parquet(f"{top}/reviews")).unionByName(
            status_events(spark.readStream.schema(USER).parquet(f"{top}/users"))
        )
        side = spark.createDataFrame([(REVIEWS[0][2], "c")], "business_id string, Category string")
        done = len(glob.glob(f"{top}/progress/commits/[0-9]*"))
        query = start_q2_bar_stream(label_changes(events, dedupe_ttl_ms=1), side, top, available_now=False)
        for _ in range(300):  # with a time limit on state the stream goes on without new rows
            if query.exception() or len(glob.glob(f"{top}/progress/commits/[0-9]*")) > done:
                break
            time.sleep(0.2)
        query.stop()
        assert [x.review_counts for x in q2_bar(spark, top).collect()] == [n]


def test_reviews_meet_no_python_state_and_batches_need_rows(spark, star):  # noqa: F811
    # Without a time limit, deduplication and relabelling are Spark's own operators.
    stream = _Stream(spark, star)
    r = spark.readStream.schema(star.review.schema).parquet(f"{stream.top}/reviews")
    u = spark.readStream.schema(USER).parquet(f"{stream.top}/users")
    plan = label_changes(review_events(r).unionByName(status_events(u)))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Deduplicate" in plan
    for step in STEPS:
        stream.step(*step)
    held = spark.read.parquet(f"{stream.top}/firsts")
    # One row each time a first year falls: u1 to 2014, 2012, 2010; u3 and u4 once.
    assert sorted((x.user, x.first) for x in held.select("user", "first").collect()) == [("u1", 2010), ("u1", 2012), ("u1", 2014), ("u3", 2015), ("u4", 2016)]
    assert len(glob.glob(f"{stream.top}/progress/commits/[0-9]*")) == len(STEPS)
