"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Method. Rows are counted for each input partition. For each partition the numbers of its
rows that go to each shard are drawn from the multivariate hypergeometric law over what
the shards still lack, so the matrix has the exact row and column sums of a uniform
shuffle. Each partition permutes its rows and deals them out by its matrix row; every
shard permutes what it got. Law: ``rows`` (counts at most one apart).

Scale. Only (row, id, size, crc, partition) is written and shuffled, not the text. The
driver holds the matrix: partitions x shards numbers, whatever the rows. A shard's second
permutation runs in buckets of about ``BUCKET_ROWS`` rows: a bucket is a range of the
row's random key, and slots follow from the buckets' counts, so no task holds a shard.
The draw depends on the seed and the partition counts; keys on the seed and row number.

Null ids and texts are rows like others (a null text has 0 bytes and crc 0). Equal rows
are told apart by a row number that is written before use. No rows: no rows. More shards
than rows: some shards are empty. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, cut_table, table

SHARDS, SEED = 40, 20240
#: Rows that one task permutes in a shard.
BUCKET_ROWS = 100_000
#: Added to a text's UTF-8 bytes.
ROW_BYTES = 16


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard; exact row sums and shard sizes."""
    total = sum(counts)
    lack = np.full(shards, total // shards, dtype=np.int64)
    rng = np.random.default_rng(seed)
    lack[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        left = n
        rest = int(lack.sum())
        for s in range(shards):  # one conditional draw a shard
            rest -= int(lack[s])
            take = _hypergeometric(rng, int(lack[s]), rest, left)
            out[i, s] = take
            left -= take
        lack -= out[i]
    if (out < 0).any() or lack.any() or (out.sum(axis=1) != counts).any():
        raise AssertionError("the matrix doesn't have the partitions' counts and the shards' sizes")
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 1_000_000_000:  # the generator's limit
        return int(rng.hypergeometric(good, bad, n))
    # The law itself: chances from the ratios of neighbouring counts, outward from the most
    # likely one as far as a double can tell them from 0.
    low, high = max(0, n - bad), min(good, n)
    total = good + bad
    top = min(high, max(low, int((n + 1) * (good + 1) // (total + 2))))
    spread = int(40 * (n / total * good * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 60
    k = np.arange(max(low, top - spread), min(high, top + spread) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    chance = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return int(k[np.searchsorted(chance, rng.random() * chance[-1], side="right")])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"),
        )
    )
    return _placed(rows, shards, seed).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Written rows (row, part, ...) with their shard and slot."""
    spark = rows.sparkSession
    counts = {x["part"]: x["count"] for x in rows.groupBy("part").count().collect()}
    names = sorted(counts)
    matrix = draw_matrix([counts[p] for p in names], shards, seed)
    plan = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(matrix[i])]) for i, p in enumerate(names)] or [(-1, [0])], "part int, upto array<bigint>"
    )
    key = lambda salt: F.xxhash64("row", F.lit(seed), F.lit(salt))
    first = Window.partitionBy("part").orderBy(key(1), "row")
    dealt = rows.withColumn("k", F.row_number().over(first)).join(F.broadcast(plan), "part")  # one row a partition
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("k")))).drop("upto", "k", "part")
    biggest = max(1, -(-sum(counts.values()) // shards))
    buckets = max(1, -(-biggest // BUCKET_ROWS))
    dealt = dealt.withColumn("r", key(2)).withColumn("bucket", F.pmod(F.shiftrightunsigned("r", 1), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    second = Window.partitionBy("shard", "bucket").orderBy("r", "row")
    out = dealt.withColumn("nth", F.row_number().over(second)).join(sizes, ["shard", "bucket"])
    return out.withColumn("slot", (F.col("base") + F.col("nth") - 1).cast("long")).drop("base", "nth", "bucket", "r")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The operator's files: all columns of ``docs`` in ``path``/shard=N. The rows are numbered
    where they are written, so null and repeated ids keep their rows."""
    names = docs.columns
    numbered = docs.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"))
    full = cut_table(numbered)
    placed = _placed(cut(full.select("row", "part")), shards, seed).select("row", "shard", "slot")
    full = full.drop("part").join(placed, "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    other = [c for c in names if c not in ("shard", "slot")]
    full.select(*[F.col("doc")[c].alias(c) for c in other], "shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
