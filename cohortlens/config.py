"""Session settings the operators are designed for, and the shared checkpoint folder.

The operators never change a caller's session. ``recommended_conf`` lists what a
job should run with (adaptive execution with skew splitting and partition
coalescing); ``build_session`` applies it for scripts and tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def recommended_conf(shuffle_partitions: int | None = None) -> dict[str, str]:
    conf = {
        # Re-plan at run time from measured shuffle sizes: coalesce small partitions,
        # split a partition that holds a hot key, turn a join into a broadcast only
        # once its side has been measured small.
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return conf


def build_session(
    master: str = "local[8]",
    app_name: str = "cohortlens",
    shuffle_partitions: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = recommended_conf(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. ``fallback`` is used only where the
    session has none (tests), and is then installed on the context. In local mode,
    where one machine holds everything, a private temporary folder is the last resort.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    chosen = configured or fallback
    if not chosen and spark.sparkContext.master.startswith("local"):
        chosen = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    if not chosen:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor can reach"
        )
    spark.sparkContext.setCheckpointDir(chosen)
    return spark.sparkContext.getCheckpointDir() or chosen


def cut_lineage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession, fallback_dir)
    return df.checkpoint(eager=True)


def write_stage(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and go on from it: columnar
    and compressed, so later reads take only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession, fallback_dir)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
