"""Tab-separated exports in files of about a given size, with a manifest.

The rows are written once as a narrow stage; the bytes of their lines, summed there, give the
number of files, and the rows are dealt to them in turn. So file sizes don't follow the
partitions of the last stage, nor a key that holds most rows. The manifest (file, bytes, rows)
lies beside the folder as ``<path>.manifest``; readers that go by it notice files that are
missing, cut or extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import write_stage
from cohortlens.sources.sinks import export_tsv, read_tsv, tsv_lines

TARGET_BYTES = 128 << 20


class ManifestMismatch(ValueError):
    pass


def export_sized(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write ``df`` as TSV in files of about ``target_bytes`` each; returns the manifest. No rows:
    one file with the header."""
    spark, stage = df.sparkSession, write_stage(df)
    total = tsv_lines(stage).agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    n = max(1, -(-total // target_bytes))
    export_tsv(stage.repartition(n), path)
    counts = _by_file(read_tsv(spark, path, stage.schema)).groupBy("file").agg(F.count("*").alias("rows"))
    manifest = _files(spark, path).join(counts, "file", "left").fillna(0, ["rows"])
    manifest.write.mode("overwrite").json(f"{path}.manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, bytes long, rows long").json(f"{path}.manifest")


def read_sized(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an ``export_sized`` folder back, if its files are those of the manifest."""
    listed = read_manifest(spark, path).select("file", F.col("bytes").alias("listed"))
    wrong = _files(spark, path).join(listed, "file", "full").where("not (bytes <=> listed)")
    found = wrong.orderBy("file").limit(5).collect()
    if found:
        raise ManifestMismatch("; ".join(f"{x.file}: {x.bytes} bytes, {x.listed} in the manifest" for x in found))
    return read_tsv(spark, path, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.col("_metadata.file_name"))
