"""Question 1 kept up to date while reviews keep arriving.

Reviews are read as a file stream with the declared schema. Each micro-batch is
measured in the scan stage, deduplicated, tagged with the user's status and the
business's top-level categories by stream-static joins, and folded into a running
(status, Category) mean and count. The aggregate state holds one row per cohort and
category.

No review is ever dropped for arriving late or out of date order. Deduplication is
exact by default: its state is keyed by review identity and hash-partitioned across
the cluster (use the RocksDB state store for large streams). With ``dedupe_within``
the state is bounded instead: a review re-delivered more than that long after its
first arrival is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohortlens.operators import cohorts
from cohortlens.operators.measures import length_column
from cohortlens.schemas import REVIEW_SCHEMA


def review_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    schema: StructType = REVIEW_SCHEMA,
) -> DataFrame:
    """File stream of reviews with a declared schema (the JSON export's by default)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


REVIEW_KEY = ["review_id", "user_id", "business_id", "date", "length_of_review"]


def q1_bar_stream(
    reviews: DataFrame,
    users: DataFrame,
    business_top: DataFrame,
    dedupe_within: str | None = None,
) -> DataFrame:
    """Streaming ``q1_bar``: running mean length and count per (status, Category)."""
    measured = reviews.select(
        "review_id",
        "user_id",
        "business_id",
        "date",
        length_column(reviews).alias("length_of_review"),
    )
    if dedupe_within is None:
        unique = measured.dropDuplicates(REVIEW_KEY)
    else:
        # Arrival time (the micro-batch time) never runs behind the watermark, so no
        # row is late; only the deduplication memory is bounded.
        unique = (
            measured.withColumn("_arrival", F.current_timestamp())
            .withWatermark("_arrival", dedupe_within)
            .dropDuplicatesWithinWatermark(REVIEW_KEY)
        )
    status = cohorts.user_status(users).select("user_id", "status")
    tagged = unique.join(status, "user_id").join(business_top.select("business_id", "Category"), "business_id")
    return tagged.groupBy("status", "Category").agg(
        F.avg("length_of_review").alias("length_of_reviews"),
        F.count("length_of_review").alias("review_count"),
    )


def start_q1_bar_stream(
    summary: DataFrame,
    query_name: str,
    checkpoint_location: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the running summary into an in-memory table named ``query_name``; progress
    and state live under ``checkpoint_location`` (a shared folder on a cluster)."""
    writer = (
        summary.writeStream.outputMode("complete")
        .format("memory")
        .queryName(query_name)
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
