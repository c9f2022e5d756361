"""Readers for the four inputs, with declared schemas (no inference pass), and a
one-off ingest job that turns the compressed JSON exports into parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import year_number
from cohortlens.schemas import (
    BUSINESS_SCHEMA,
    REVIEW_SCHEMA,
    TAXONOMY_SCHEMA,
    USER_SCHEMA,
    check_schema,
)

_SCHEMAS = {
    "business": BUSINESS_SCHEMA,
    "review": REVIEW_SCHEMA,
    "user": USER_SCHEMA,
    "taxonomy": TAXONOMY_SCHEMA,
}


def read_source(
    spark: SparkSession, kind: str, path: str, fmt: str = "json", multi_line: bool = False
) -> DataFrame:
    """Read one input with only its declared columns.

    JSON is parsed against the declared schema, so unused fields are skipped at
    parse time and no inference job runs. Malformed input, such as a pretty-printed
    array read line by line, fails the job. ``multi_line`` reads a pretty-printed
    JSON array (one object per line otherwise). Parquet is read as stored and
    pruned to the declared columns, which reach the scan as its ReadSchema.
    """
    schema = _SCHEMAS[kind]
    if fmt == "json":
        df = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path).select(*[f.name for f in schema.fields])
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return check_schema(df, kind)


def read_business(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_source(spark, "business", path, fmt)


def read_review(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_source(spark, "review", path, fmt)


def read_user(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_source(spark, "user", path, fmt)


def read_taxonomy(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = False) -> DataFrame:
    return read_source(spark, "taxonomy", path, fmt, multi_line)


def ingest_to_parquet(spark: SparkSession, kind: str, src: str, dest: str, multi_line: bool = False) -> None:
    """Convert one JSON export to parquet. Reviews are partitioned by review year so
    year-bounded questions prune whole folders, each year by as many tasks as the session
    has shuffle partitions; other inputs are written as is."""
    df = read_source(spark, kind, src, "json", multi_line)
    writer = df.write.mode("overwrite")
    if kind == "review":
        df = df.withColumn("review_year", year_number("date"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition("review_year", F.pmod(F.xxhash64("review_id"), F.lit(n))).write.mode(
            "overwrite"
        ).partitionBy("review_year")
    writer.parquet(dest)
