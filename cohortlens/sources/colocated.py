"""Reviews and their join partner written in buckets of the join key, so that the
deduplications and the joins on that key read them without an exchange.

Reviews are joined by user in both questions and by business for the categories. ``ingest``
writes reviews and the partner (users or businesses) as tables of equally many buckets,
sorted by the key; a reader that groups or joins by the key finds each bucket whole.

A bucket is read by one task, so a key that holds more rows than ``HOT`` average buckets
would make one task long, and no shuffle is left that adaptive execution could split.
Such hot keys are found at ingest by a count per key and kept apart in a plain table: their
rows are spread over all tasks and meet the few partner rows by a broadcast. There are
at most buckets / HOT of them, whatever the data, which bounds that broadcast in keys.

The tables live in a folder that all executors reach. ``manifest`` beside them holds what
another session needs to open them (``open_tables``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import write_stage

#: A key is hot when it holds more rows than this many average buckets.
HOT = 2


@dataclass
class Colocated:
    """Reviews and partner rows by ``key``: bucketed, and apart those of the hot keys."""

    key: str
    buckets: int
    reviews: DataFrame
    partner: DataFrame
    hot_reviews: DataFrame
    hot_partner: DataFrame


def _write(df: DataFrame, key: str, buckets: int, name: str, path: str) -> None:
    # Dealt like the buckets, so each task writes one file.
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)


def _open(spark: SparkSession, key: str, buckets: int, name: str, path: str, schema: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def hot_keys(reviews: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key) of the keys with more rows than ``HOT`` average buckets; null is a key."""
    counts = write_stage(reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n")))  # read for the total and for the keys
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * buckets > HOT * total).select(key)


def ingest(reviews: DataFrame, partner: DataFrame, key: str, folder: str, buckets: int | None = None) -> Colocated:
    """Write both sides under ``folder`` and return them as read back."""
    spark = reviews.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder, name = folder.rstrip("/"), f"colocated_{uuid.uuid4().hex}"
    hot_keys(reviews, key, buckets).write.parquet(f"{folder}/hot_keys")
    hot = F.broadcast(spark.read.parquet(f"{folder}/hot_keys").withColumnRenamed(key, "_hot"))  # buckets / HOT rows at most
    none = hot.isEmpty()
    for side, df in (("reviews", reviews), ("partner", partner)):
        if none:  # what the side comes from isn't run again for nothing
            _write(df, key, buckets, f"{name}_{side}", f"{folder}/{side}")
            spark.createDataFrame([], df.schema).write.parquet(f"{folder}/hot_{side}")
            continue
        same = df[key].eqNullSafe(F.col("_hot"))
        _write(df.join(hot, same, "left_anti"), key, buckets, f"{name}_{side}", f"{folder}/{side}")
        df.join(hot, same, "left_semi").write.parquet(f"{folder}/hot_{side}")
    about = [(key, buckets, name, _ddl(reviews), _ddl(partner))]
    spark.createDataFrame(about, "key string, buckets int, name string, reviews string, partner string").coalesce(1).write.json(f"{folder}/manifest")
    return open_tables(spark, folder)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def open_tables(spark: SparkSession, folder: str) -> Colocated:
    """Tables that ``ingest`` wrote, in this or another session."""
    folder = folder.rstrip("/")
    m = spark.read.schema("key string, buckets int, name string, reviews string, partner string").json(f"{folder}/manifest").first()
    sides = {}
    for side in ("reviews", "partner"):
        sides[side] = _open(spark, m.key, m.buckets, f"{m.name}_{side}", f"{folder}/{side}", m[side])
        sides[f"hot_{side}"] = spark.read.schema(m[side]).parquet(f"{folder}/hot_{side}")
    return Colocated(m.key, m.buckets, sides["reviews"], sides["partner"], sides["hot_reviews"], sides["hot_partner"])
