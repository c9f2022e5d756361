"""Sized runtime filters: drop most rows without a partner before they are shuffled.

A side too large to broadcast still fits a Bloom filter: some 7 bits a key at a false-positive
rate of 3 %. Spark builds and pushes such filters itself (``InjectRuntimeFilter``), but by its
defaults for a fixed number of items, only over large scans, and for small filter sides.
``runtime_filters`` sets the sizes from a counted side while a stage is planned and run, and
puts the caller's settings back. ``keep_known`` uses it: the rows of a frame whose key the
side holds, written as a stage. False positives go in the join that follows the filter, so the
rate decides what is shuffled and never what is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import write_stage

#: The false-positive rate asked for; the most bits a filter may have (32 MB on each executor);
#: the rate from which a filter isn't worth its place.
RATE, MAX_BITS, USELESS = 0.03, 1 << 28, 0.5

_PREFIX = "spark.sql.optimizer.runtime.bloomFilter."


def filter_bits(items: int, rate: float = RATE) -> int:
    """Bits of a Bloom filter of that many items and that rate, at most ``MAX_BITS``."""
    return min(MAX_BITS, max(64, math.ceil(-max(1, items) * math.log(rate) / math.log(2) ** 2)))


def false_positives(items: int, bits: int) -> float:
    """The expected rate of a filter with the best number of hashes for its size."""
    items = max(1, items)
    hashes = max(1, round(bits / items * math.log(2)))
    return (1 - math.exp(-hashes * items / bits)) ** hashes


def filter_conf(items: int, rate: float = RATE) -> dict[str, str]:
    """Settings under which Spark filters a scan by a side of that many keys."""
    bits = filter_bits(items, rate)
    if false_positives(items, bits) > USELESS:
        return {_PREFIX + "enabled": "false"}
    return {
        _PREFIX + "enabled": "true",
        _PREFIX + "expectedNumItems": str(max(1, items)),
        _PREFIX + "maxNumItems": str(max(1, items)),
        _PREFIX + "numBits": str(bits),
        _PREFIX + "maxNumBits": str(bits),
        # The side was counted, so its size in bytes and that of the scan decide nothing here.
        _PREFIX + "creationSideThreshold": "1t",
        _PREFIX + "applicationSideScanSizeThreshold": "0",
    }


@contextmanager
def runtime_filters(spark: SparkSession, items: int, rate: float = RATE) -> Iterator[None]:
    """Within: Spark filters by sides of about that many keys. What runs has to be planned and
    run inside, as settings are read then."""
    new = filter_conf(items, rate)
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def marked_keys(side: DataFrame, key: str) -> DataFrame:
    """The distinct keys of ``side``, written with a mark: a narrow table that a filter is
    built from by one scan, whatever ``side`` is derived from."""
    return write_stage(side.select(key, F.lit(1).alias("_known")).distinct())


def known(rows: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is marked. Spark builds filters only from sides with a comparison."""
    return rows.join(marked.where(F.col("_known") == 1).select(key), key, "left_semi")


def keep_known(rows: DataFrame, side: DataFrame, key: str, rate: float = RATE) -> DataFrame:
    """The rows whose key ``side`` holds, by a sized filter below the shuffle, as a written stage."""
    marked = marked_keys(side, key)
    with runtime_filters(rows.sparkSession, marked.count(), rate):
        return write_stage(known(rows, marked, key))
