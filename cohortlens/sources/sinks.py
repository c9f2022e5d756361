"""Tab-separated export with a header, as the charting step expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"'}


def export_tsv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Write ``df`` as TSV with a header. Fields holding a tab, quote or line break are
    quoted (quotes doubled); null is written as an empty field.

    ``single_file=True`` writes one part file: all work runs in parallel, then one task
    streams the rows out. It is meant for summaries; row-level exports stay parallel.
    """
    if single_file:
        df = df.repartition(1)
    df.write.options(**_OPTIONS).mode(mode).csv(path)


def tsv_lines(df: DataFrame) -> DataFrame:
    """``df`` as the lines that ``export_tsv`` writes below its header: one column ``line``."""
    return df.select(F.to_csv(F.struct(*df.columns), {k: v for k, v in _OPTIONS.items() if k != "header"}).alias("line"))


# Read side: an unquoted empty field is null; a quoted empty field ("") is an empty
# string. The parser maps unquoted empties to ``nullValue``, so it is set to a
# marker that cannot occur in text, and quoted empties to ``emptyValue``.
_NULL_MARK = "\u0000"


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an ``export_tsv`` folder back with a declared schema."""
    return (
        spark.read.options(**_OPTIONS)
        .option("multiLine", "true")
        .option("nullValue", _NULL_MARK)
        .option("emptyValue", "")
        .schema(schema)
        .csv(path)
    )
