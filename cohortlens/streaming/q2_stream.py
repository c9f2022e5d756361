"""Question 2 kept up to date while reviews and status lists keep arriving, in any order.

A review's label depends on its author's first status year, which a later status list may
bring forward or bring at all: old reviews are then labelled anew. One stream carries both
kinds of rows. Spark's keyed deduplication lets each review, and each first year of a user,
through once. Each micro-batch then keeps what came as a folder of narrow rows, finds the users
whose first year fell, and writes the changes: a new review adds to the sum of its label; a
first year that fell retracts the reviews of the years in between from one label and adds them
to the other; the first list that names a year adds all of the user's reviews. The totals of
these changes per (Category, label) are a folder of the batch. A batch that is run again reads
only the folders of smaller batches and replaces its own, so each change counts once. ``q2_bar``
merges the folders, a few rows each.

A user's first year is the smallest of all lists met: a status once gained stays, so the order
of lists doesn't matter and the result equals the batch result over all rows.

State and expiry. Nothing expires by default, and the result is exact: state grows with the
distinct reviews (their 128-bit hashes, and the narrow rows). With ``dedupe_ttl_ms`` the
identities expire that long after they were met, and a review sent again later counts again;
first years and the rows stay, since any review may be labelled anew. Spark's deduplication
has no such limit, so these identities are kept by a Python processor, which costs a call a
review.

Cost. A micro-batch works on the rows it brings; one in which a first year fell also scans the
narrow rows, and only those of the users in question go on. All of it runs in Spark's own
operators.

Hot users. Identities are dealt by user and identity, and the joins on the user meet one
narrow row a user, so adaptive execution can split a user with a third of all reviews. With
``dedupe_ttl_ms`` state is keyed by (user, salt), the salt drawn from the review's identity.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cohortlens.functions.columns import first_status_year, pre_post_label, split_list, year_number
from cohortlens.operators import summaries
from cohortlens.operators.measures import length_column

SALTS = 16
Q2_LABEL = "new_filtered_elites"
#: What the stream is started with: the state store for state of this size, and no batches
#: without rows (expired identities are told by their time, not by such batches).
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: What the stream keeps of its rows: reviews, and the first years when they fell.
CAME = "user string, business string, year int, length long, first int, batch long"
FIRSTS = "user string, first int, batch long"
PARTIALS = f"Category string, {Q2_LABEL} string, _sum long, _n long, _rows long, batch long"
#: Sum of lengths, their count, and rows with or without a length.
TOTALS = ["_sum", "_n", "_rows"]


def review_events(reviews: DataFrame, salts: int = SALTS) -> DataFrame:
    """Reviews as rows of the common stream. Reviews without a year have no label and go."""
    length = length_column(reviews)
    row = reviews.select("review_id", "user_id", "business_id", "date", length.alias("length")).withColumn("year", year_number("date"))
    text = F.to_json(F.struct("review_id", "business_id", "date", "length"), {"ignoreNullFields": "false"})
    return row.where("year is not null and user_id is not null").select(
        F.col("user_id").cast("string").alias("user"),
        F.pmod(F.xxhash64("review_id", "business_id", "date", "length"), F.lit(salts)).cast("int").alias("salt"),
        F.col("business_id").cast("string").alias("business"),
        "year",
        F.unhex(F.md5(text)).alias("identity"),
        "length",
        F.lit(None).cast("int").alias("first"),
    )


def status_events(users: DataFrame, salts: int = SALTS) -> DataFrame:
    """Status lists as rows of the common stream; those that name no year change nothing."""
    first = users.select(F.col("user_id").cast("string").alias("user"), first_status_year(split_list("elite")).alias("first"))
    return first.where("first is not null and user is not null").select(
        "user",
        F.pmod(F.xxhash64("user"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(None).cast("string").alias("business"),
        F.lit(None).cast("int").alias("year"),
        F.lit(None).cast("binary").alias("identity"),
        F.lit(None).cast("long").alias("length"),
        "first",
    )


class _Met(StatefulProcessor):
    """The rows of one (user, salt) whose identity wasn't met within the time limit."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getMapState("met", "identity binary", "known boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if r.identity is not None:
                if self.met.containsKey((r.identity,)):
                    continue
                self.met.updateValue((r.identity,), (True,))
            yield Row(user=r.user, business=r.business, year=r.year, length=r.length, first=r.first)

    def close(self) -> None:
        pass


def label_changes(events: DataFrame, dedupe_ttl_ms: int | None = None) -> DataFrame:
    """The rows of the common stream of reviews and status lists that can change a label or a
    sum: each review once, and each first year that a user's lists name."""
    if dedupe_ttl_ms is None:
        return events.dropDuplicates(["user", "identity", "first"]).select("user", "business", "year", "length", "first")
    return events.groupBy("user", "salt").transformWithState(
        statefulProcessor=_Met(dedupe_ttl_ms),
        outputStructType="user string, business string, year int, length long, first int",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TOTALS])


def _moves(came: DataFrame, firsts: DataFrame, number: int) -> DataFrame:
    """Totals that batch ``number`` adds to (positive) or takes from (negative) each (business,
    label). ``firsts``: (user, old, new), the first year before and after the batch."""
    rows = came.where("first is null")
    label = lambda first: pre_post_label(F.col("year"), F.col(first))
    added = rows.where(F.col("batch") == number).join(firsts.where("new is not null"), "user").withColumns({"label": label("new"), "sign": F.lit(1)})
    fell = firsts.where("old is null or new < old")
    held = rows.where(F.col("batch") < number).join(fell, "user").withColumns({"was": label("old"), "label": label("new")})
    held = held.where("was is null or was != label")
    parts = [added, held.withColumn("sign", F.lit(1)), held.where("was is not null").withColumn("label", F.col("was")).withColumn("sign", F.lit(-1))]
    moved = parts[0].select("business", "label", "length", "sign")
    for part in parts[1:]:
        moved = moved.unionByName(part.select("business", "label", "length", "sign"))
    length, n = F.coalesce("length", F.lit(0)), F.when(F.col("length").isNull(), 0).otherwise(F.col("sign"))
    return moved.groupBy("business", "label").agg(
        F.sum(length * F.col("sign")).alias("_sum"), F.sum(n).cast("long").alias("_n"), F.sum("sign").cast("long").alias("_rows")
    )


def start_q2_bar_stream(changes: DataFrame, business_top: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """Fold the changes into ``folder``/partials; what came, first years, progress and state
    live beside it (a shared folder on a cluster)."""
    # Each pair once a business row, as the batch form joins them.
    side = business_top.select(F.col("business_id").cast("string").alias("business"), "Category")
    spark = changes.sparkSession
    for name, schema in (("came", CAME), ("firsts", FIRSTS)):  # an empty table to read from
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{folder}/{name}")

    def fold(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession

        def replace(name: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

        replace("came", batch)  # the one time that the batch, and its state, is computed
        came = s.read.schema(CAME).parquet(f"{folder}/came").where(F.col("batch") <= number)
        known = s.read.schema(FIRSTS).parquet(f"{folder}/firsts")
        old = known.where(F.col("batch") < number).groupBy("user").agg(F.min("first").alias("old"))
        listed = came.where((F.col("batch") == number) & F.col("first").isNotNull()).groupBy("user").agg(F.min("first").alias("first"))
        fell = listed.join(old, "user", "left").where("old is null or first < old")
        replace("firsts", fell.select("user", "first"))
        known = s.read.schema(FIRSTS).parquet(f"{folder}/firsts").where(F.col("batch") <= number)
        before = F.min(F.when(F.col("batch") < number, F.col("first")))
        firsts = known.groupBy("user").agg(before.alias("old"), F.min("first").alias("new"))
        sums = _moves(came, firsts, number)
        found = _summed(sums.join(side, "business").withColumnRenamed("label", Q2_LABEL), "Category", Q2_LABEL)
        replace("partials", found.coalesce(1))

    writer = changes.writeStream.foreachBatch(fold).outputMode("append").option("checkpointLocation", f"{folder}/progress")
    if available_now:
        writer = writer.trigger(availableNow=True)
    before = {name: spark.conf.get(name, None) for name in STREAM_CONF}
    for name, value in STREAM_CONF.items():
        spark.conf.set(name, value)  # a stream keeps the settings it was started with
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def q2_bar(spark: SparkSession, folder: str) -> DataFrame:
    """Mean length and count per (Category, label) after the batches so far. Groups that all
    their reviews have left are not shown."""
    held = spark.read.schema(PARTIALS).parquet(f"{folder}/partials")
    found = _summed(held, "Category", Q2_LABEL).where("_rows > 0")
    return summaries.mean_from_partials(found, ["Category", Q2_LABEL], mean_name="length_of_review", count_name="review_counts")
