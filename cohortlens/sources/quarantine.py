"""JSON input with bad lines: good rows go on, bad ones to a table with file and reason.

``read_source`` stops at the first malformed line, a fair default for a clean export. Here each
line is parsed once against the declared schema; a line that is no object, holds a value of
another type or lacks an identifier is kept as it is, with the file it came from. Both parts
come from one written parse, so every line is in exactly one of them and the JSON is read
once. Blank lines are no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.config import write_stage
from cohortlens.schemas import check_schema
from cohortlens.sources.readers import _SCHEMAS

NOT_JSON, WRONG_TYPE = "not a JSON object", "value of another type"


class Parsed(NamedTuple):
    good: DataFrame
    quarantine: DataFrame  # file, line, reason


def read_quarantined(spark: SparkSession, kind: str, path: str) -> Parsed:
    """One input, an object a line, parted into its good rows and the quarantine."""
    fields = _SCHEMAS[kind].fields
    target = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    row = F.from_json("line", target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.where(~F.col("line").rlike(r"^\s*$")).withColumn("row", row)
    # An array or a bare value also parses, as one row or as nulls.
    is_object = F.col("line").rlike(r"^\s*\{") & F.from_json("line", "map<string,string>").isNotNull()
    reason = F.when(F.col("row._bad").isNotNull() | ~F.col("line").rlike(r"^\s*\{"), F.when(is_object, WRONG_TYPE).otherwise(NOT_JSON))
    for f in fields:
        if not f.nullable:
            reason = reason.when(F.col(f"row.{f.name}").isNull(), f"no {f.name}")
    # The line of a good row is not kept: it would double the stage.
    parsed = parsed.withColumn("reason", reason).withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line")))
    stage = write_stage(parsed.select("file", "line", "reason", *[F.col(f"row.{f.name}").alias(f.name) for f in fields]))
    good = stage.where("reason is null").select(*[f.name for f in fields])
    return Parsed(check_schema(good, kind), stage.where("reason is not null").select("file", "line", "reason"))
