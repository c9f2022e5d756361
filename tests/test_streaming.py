import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.plans.registry import analysis_for
from cohortlens.streaming import q1_bar_stream, review_stream, start_q1_bar_stream
from conftest import rows



@pytest.mark.parametrize("dedupe_within", [None, "1 hour"])
def test_streamed_q1_equals_batch_q1(spark, dedupe_within):
    a = analysis_for(spark, "/root/testdata/sf0.001")
    src = tempfile.mkdtemp(prefix="cohortlens-stream-src-")
    reviews = a.review.select("review_id", "user_id", "business_id", "date", "text")
    # Deliver the reviews in two batches of files, with a few re-delivered rows.
    first = reviews.filter(F.col("date") < "1998-01-01")
    second = reviews.filter(F.col("date") >= "1998-01-01")
    first.write.mode("append").parquet(src)
    second.unionByName(second.limit(5)).write.mode("append").parquet(src)
    stream = q1_bar_stream(
        review_stream(spark, src, max_files=3, schema=reviews.schema),
        a.user,
        a.business_top_level,
        dedupe_within=dedupe_within,
    )
    name = f"q1_stream_test_{0 if dedupe_within is None else 1}"
    q = start_q1_bar_stream(stream, name, tempfile.mkdtemp(prefix="cohortlens-stream-ckpt-"))
    q.awaitTermination(300)
    got = spark.sql(f"SELECT * FROM {name}")
    cols = ("status", "Category", "review_count")
    assert rows(got, *cols) == rows(a.q1_bar, *cols)
    means = {(r["status"], r["Category"]): r["length_of_reviews"] for r in got.collect()}
    for r in a.q1_bar.collect():
        assert abs(means[(r["status"], r["Category"])] - r["length_of_reviews"]) < 1e-9
