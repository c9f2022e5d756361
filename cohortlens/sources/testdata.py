"""Adapter: the analysis's four inputs derived from the generated warehouse tables.

None of the generated tables holds businesses, reviews or status years, so they are
derived, all lazily and all from whole tables:

* business  <- part: id ``p_partkey``, name ``p_name``; categories are the words of
  ``p_name`` followed by ``p_type``, joined by ``', '``.
* taxonomy  <- part: every distinct ``p_name`` word is a top-level category (empty
  parent list); every distinct ``p_type`` is a child category. Each business
  therefore carries two top-level categories and one that must be dropped.
* review    <- lineitem joined to orders on the order key: id is the
  order-part-supplier triple, user ``o_custkey``, business ``l_partkey``, date
  ``o_orderdate`` as ``yyyy-MM-dd``, text the document whose ``doc_id`` is
  ``l_orderkey`` modulo the number of documents (every review gets a whole text).
  About sixty reviews share each document, so the frame also carries
  ``length_of_review``, measured once per document over its whole text and joined
  as a bigint: the text itself is never copied into review rows unless a
  consumer reads it.
* user      <- customer: id ``c_custkey``; the elite field lists, newest first, the
  distinct years in which the customer placed an order priced over the threshold,
  or holds the sentinel when there is none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import NO_STATUS

# Adapter parameters.
STATUS_ORDER_PRICE = 430_000.0
CHILD_PARENT = "types"


class Star(NamedTuple):
    business: DataFrame
    review: DataFrame
    user: DataFrame
    taxonomy: DataFrame


# Columns the adapter reads, with their stored types. Declaring them skips the
# schema-inference job of every read and prunes the scan to these columns.
TABLE_COLUMNS = {
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint",
    "documents": "doc_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.read.schema(TABLE_COLUMNS[name]) if name in TABLE_COLUMNS else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than task slots (a file written as one
    row group is read by one task) over all slots before the per-row work. Scans of
    large tables, split into many files and row groups, pass through unchanged.
    Round-robin output is made deterministic by Spark's sort before repartitioning,
    so a retried task sees the same rows."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return part.select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.concat_ws(", ", F.split("p_name", " "), F.col("p_type")).alias("categories"),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_name", "p_type")
    roots = (
        part.select(F.explode(F.split("p_name", " ")).alias("title"))
        .distinct()
        .select(
            F.col("title").alias("alias"),
            "title",
            F.array().cast("array<string>").alias("parents"),
        )
    )
    children = (
        part.select(F.col("p_type").alias("title"))
        .distinct()
        .select(
            F.concat(F.lit("type_"), F.lower("title")).alias("alias"),
            "title",
            F.array(F.lit(CHILD_PARENT)).alias("parents"),
        )
    )
    return roots.unionByName(children)


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    # What is derived from a whole text is derived per document, before the join.
    documents = table(spark, sf_dir, "documents", "doc_id", "text").withColumns(
        {"length_of_review": F.length("text").cast("long"), "text_sha256": F.sha2("text", 256)}
    )
    n_documents = documents.select(F.count(F.lit(1))).scalar()
    keyed = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.pmod(F.col("l_orderkey"), n_documents).alias("doc_id"),
    )
    return keyed.join(documents, "doc_id", "left").select(
        "review_id", "user_id", "business_id", "date", "text", "length_of_review", "text_sha256"
    )


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer", "c_custkey")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    # At most one entry per calendar year per customer: a bounded list.
    years = (
        orders.filter(F.col("o_totalprice") > STATUS_ORDER_PRICE)
        .groupBy("o_custkey")
        .agg(
            F.array_join(
                F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy")), asc=False), ", "
            ).alias("elite")
        )
    )
    return customers.join(years, customers.c_custkey == years.o_custkey, "left").select(
        F.col("c_custkey").alias("user_id"),
        F.lit(None).cast("string").alias("yelping_since"),
        F.coalesce(F.col("elite"), F.lit(NO_STATUS)).alias("elite"),
    )


def load_star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(
        business=business(spark, sf_dir),
        review=review(spark, sf_dir),
        user=user(spark, sf_dir),
        taxonomy=taxonomy(spark, sf_dir),
    )
