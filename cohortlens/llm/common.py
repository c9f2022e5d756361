"""Helpers shared by the training-data operators: code shipping, checkpoints, and
vectorised word hashing over Arrow string columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_M1, _M2, _STEP = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def ship(spark: SparkSession) -> None:
    """Send this package to every executor once per session, so that Python workers
    can import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="cohortlens-ship-"), "cohortlens_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._cohortlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one in the temporary folder of this
    machine only where the session names none (tests, local mode)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder every executor can reach")
        found = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, **options: str) -> DataFrame:
    """``cut`` by a Parquet table in the shared folder: a checkpoint's rows are neither
    columnar nor compressed, which many narrow rows pay for several times over."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a narrow table that one task may hold.
NARROW_ROWS = 100_000


def cut_narrow(df: DataFrame) -> DataFrame:
    """``cut`` for a table of a few numbers a row, in as many parts as its rows need: a
    small table in hundreds of parts costs hundreds of files in every later shuffle."""
    df = cut(df)
    n = -(-df.count() // NARROW_ROWS)
    return df.coalesce(max(1, n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of every text: (row, byte start, byte end, 64-bit hash), in order."""
    data, offs = string_bytes(col)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - start
    h = mix((eight[start] & _KEEP[np.minimum(left, 8)]) + left.astype(np.uint64) * _STEP)
    more = np.flatnonzero(left > 8)
    at = 8
    while len(more):
        got = eight[start[more] + at] & _KEEP[np.minimum(left[more] - at, 8)]
        h[more] = mix(h[more] * _M2 + got)
        at += 8
        more = more[left[more] > at]
    return row, start, end, h


def shingles(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of ``k`` words within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    x = h[at]
    for j in range(1, k):
        x = x * _STEP + h[at + j]
    return at, mix(x)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position 0..n: how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in slices whose texts in ``column`` have about ``limit`` bytes (one row at
    least), so that a worker's memory doesn't follow the batch size."""
    _, offs = string_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
