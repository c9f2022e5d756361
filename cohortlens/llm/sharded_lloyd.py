"""Centroid clustering: Lloyd's algorithm with the dimensions in shards.

Components become integers, floor(64 * x), of vectors with exactly 64 components. The
first centroids are the 16 vectors whose sha256 of ``1:<id>`` is smallest, in that order.
Each of 3 rounds assigns every vector to its nearest centroid (ties: the smaller number)
and moves each non-empty centroid to the floor of its vectors' mean; vectors are then
assigned once more. All arithmetic is exact.

Method. Vectors are laid out once as column blocks: a row holds one block of the dimensions
of a chunk of vectors, as packed integers, in a table partitioned by block. A task on a
block knows only that block's slice of the centroids and returns the exact partial
distances of its vectors. Reducing by chunk adds the blocks' distances and takes the
argmin. The assignments go back to the blocks, and each dimension shard sums its own
columns and updates its own slice.

Result of ``cluster``: id, cluster, distance (squared), cluster_inertia and inertia (distances
over the cluster and over all), centroid_sha256 (the final centroid's components).

Null vectors, vectors of another length, and those with a null or non-finite component are
dropped. Null ids sort last as first centroids; equal hashes (repeated ids) sort by
components. Components beyond +-2^24 after scaling count as +-2^24, sums beyond the largest
bigint as that. Repeated rows are clustered
each; with fewer than 16 vectors there are as many centroids, so some start empty or equal
and stay so. No rows: no rows. Other columns are not read.

Scale. A round shuffles packed partial distances, 2 bytes per vector, block and centroid
where they fit, and the packed columns (1 byte a component where they fit). Every shuffle
is keyed by chunks of at most ``CHUNK`` vectors, so no key is hot. The driver holds the
centroids (16 x 64 numbers) and one sum per cluster.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut_table, shared_dir, ship, table
from cohortlens.llm.vector_codes import finite, integers, squared, total

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Dimension shards, and vectors in a chunk.
BLOCKS, CHUNK = 4, 4096


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, after a byte that names it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for code, t in (("b", np.int8), ("B", np.uint8), ("h", np.int16), ("H", np.uint16), ("i", np.int32), ("I", np.uint32)):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return code.encode() + x.astype(t).tobytes()
    return b"q" + x.astype(np.int64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).astype(np.int64)


def slices_of(dim: int, blocks: int) -> list[slice]:
    ends = [dim * i // blocks for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _lay_out(dim: int, blocks: int, chunk: int) -> Callable:
    """Vectors to rows (chunk, block, data, ids); block -1 holds the chunk's ids."""
    cols = slices_of(dim, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
                ids = batch.column("id")
                lists = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (blocks + 1)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + nth] * (blocks + 1), pa.int64()), pa.array([-1, *range(blocks)], pa.int32()),
                     pa.array([b"", *[pack(x[:, c]) for c in cols]], pa.binary()), lists],
                    names=["chunk", "block", "data", "ids"],
                )
                nth += 1

    return run


def _partial(centroids: np.ndarray, blocks: int) -> Callable:
    """Column blocks to (chunk, dist): exact distances to the block's centroid slices."""
    cols = slices_of(centroids.shape[1], blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "block", "data")), strict=True):
                c = centroids[:, cols[block]]
                x = unpack(data).reshape(-1, c.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(squared(x, c).reshape(-1))], pa.binary())], names=["chunk", "dist"])

    return run


def _add_up(k: int) -> Callable:
    """The partial distances of a chunk's blocks, added: its vectors' centroids and distances."""

    def run(t: pa.Table) -> pa.Table:
        whole = sum(unpack(d) for d in t.column("dist").to_pylist()).reshape(-1, k)
        near = whole.argmin(1)  # the first of equal ones
        dist = whole[np.arange(len(whole)), near]
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "near": pa.array([pack(near)], pa.binary()), "dist": pa.array([pack(dist)], pa.binary())})

    return run


def _shard_sums(dim: int, blocks: int, k: int) -> Callable:
    """Column blocks with assignments to (block, cluster, at, n, total), one a task."""
    cols = slices_of(dim, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, added = np.zeros((blocks, k), np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for block, data, near in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "near")), strict=True):
                e = unpack(near)
                n[block] += np.bincount(e, minlength=k)
                np.add.at(added[:, cols[block]], e, unpack(data).reshape(len(e), -1))
        for b in range(blocks):
            at = np.arange(cols[b].start, cols[b].stop, dtype=np.int32)
            e = np.flatnonzero(n[b])
            if len(e) and len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(e) * len(at), b, np.int32)), pa.array(np.repeat(e, len(at)).astype(np.int32)), pa.array(np.tile(at, len(e))),
                     pa.array(np.repeat(n[b][e], len(at))), pa.array(added[e][:, at].reshape(-1))],
                    names=["block", "cluster", "at", "n", "total"],
                )

    return run


def first_centroids(kept: DataFrame, clusters: int, salt: str = "1:") -> np.ndarray:
    """The vectors of the smallest hashes of salt and id, in order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = kept.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([x["v"] for x in rows], dtype=np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, blocks: int = BLOCKS, chunk: int = CHUNK,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.where(finite(vector_col) & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), integers(vector_col, scale).alias("v"))
    blocks = max(1, min(blocks, dim))
    idt = kept.schema["id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters)
    k = len(centroids)
    if not k:
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"`{id_col}` {idt}, {none}")
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    laid = kept.mapInArrow(_lay_out(dim, blocks, chunk), f"chunk long, block int, data binary, ids array<{idt}>")
    laid.write.partitionBy("block").parquet(folder)
    laid = spark.read.schema(f"chunk long, data binary, ids array<{idt}>, block int").parquet(folder)
    shards = laid.where("block >= 0").select("chunk", "block", "data")

    def assign(centroids: np.ndarray) -> DataFrame:
        parts = shards.mapInArrow(_partial(centroids, blocks), "chunk long, dist binary")
        return parts.groupBy("chunk").applyInArrow(_add_up(k), "chunk long, near binary, dist binary")

    for _ in range(rounds):
        near = assign(centroids).select("chunk", "near")
        sums = shards.join(near, "chunk").select("block", "data", "near").mapInArrow(_shard_sums(dim, blocks, k), "block int, cluster int, at int, n long, total long")
        sums = sums.groupBy("block", "cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = centroids.copy()  # clusters x dimensions: bounded by the parameters
        for x in sums.collect():
            new[x["cluster"], x["at"]] = int(x["total"]) // x["n"]
        if (new == centroids).all():
            break  # further rounds would find the same
        centroids = new

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, near, dist in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("near", "dist")), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(unpack(near).astype(np.int32)), pa.array(unpack(dist))], names=["id", "cluster", "distance"])

    named = laid.where("block = -1").select("chunk", "ids").join(assign(centroids), "chunk").select("ids", "near", "dist")
    out = cut_table(named.mapInArrow(expand, f"id {idt}, cluster int, distance long"))
    sums = {x["cluster"]: x["s"] for x in out.groupBy("cluster").agg(total("distance").alias("s")).collect()}
    rows = [(c, s, min(sum(sums.values()), 2**63 - 1), digest(centroids[c])) for c, s in sums.items()]  # one a cluster
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Brute force: every vector against every centroid."""
    steps = [
        """x as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where len(embedding) = 64
 and len(list_filter(embedding, lambda x: x is null or isnan(x::double) or isinf(x::double))) = 0)""",
        "b0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as e, v from x qualify e < 16)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} as (select vec_id, min({{'d': d, 'e': e}}) as m, any_value(v) as v from (
 select x.vec_id, x.v, b.e, (list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v))::bigint as d
 from x, b{i} as b) group by vec_id)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} as (select e, list(floor(t / n) order by j) as v from (
 select m.e as e, j, sum(v[j]) as t, count(*) as n from a{i}, range(1, 65) as r(j) group by all) group by e)"""
            )
            steps.append(f"b{i + 1} as (select b.e, coalesce(s.v, b.v) as v from b{i} as b left join s{i} as s using (e))")
    return (
        "with " + ",\n".join(s.replace(" as (", " as materialized (", 1) for s in steps)
        + f"""
select vec_id, e::int as cluster, m.d as distance, sum(m.d) over (partition by e)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia,
 sha256(list_aggregate(list_transform(b.v, lambda c: c::bigint::varchar), 'string_agg', ',')) as centroid_sha256
from a{ROUNDS} as a join b{ROUNDS} as b on a.m.e = b.e"""
    )


#: All in whole numbers, which doubles hold exactly at this size.
OP12_SQL = _sql()
