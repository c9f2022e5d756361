"""Vector code compression: product codes, entries found by equal-average search.

Components become integers, floor(1024 * x); a vector is cut into 4 equal consecutive
parts, each coded by the nearest of the 256 entries of its position's codebook. Codebooks
start as the parts of the first 256 vectors and take 4 Lloyd rounds over all vectors.

Method. Entries lie sorted by their component sum. For a part of sum s the search begins at
s and goes outward, up and down, in blocks of entries. By Cauchy-Schwarz an entry of sum t
is at least (s - t)^2 / dimension away (squared), so a direction ends once that bound strictly
exceeds the best distance found; ties go to the lower entry. Parts with near sums are searched
together, so a block's distances are one matrix product. All is exact integer arithmetic:
in doubles where every value stays below 2^53, else in 64-bit integers.

Result of ``compress``: vec_id, code (two hex digits a part), error (squared distances over the
parts), label_error (errors over equal labels, nulls together), codebooks_sha256.

Null vectors, and those with a null or non-finite component, are dropped. The length of
the first vector (by id, null ids last, then by components) is the table's; vectors of
another length are dropped. A length that 4 does not divide is filled up with zeros, which
change no distance; vectors of length 0 all have code 00000000. Components beyond
+-2^24 after scaling count as +-2^24, and sums beyond the largest bigint as that. Repeated rows and ids are coded each; with fewer than 256
vectors the codebooks are shorter. No rows: no rows. Other columns are not read.

Scale. The integers are written once. A round is one scan; each task sends one row per
part, entry and component, summed in the shuffle. The codebooks (256 x length numbers) are
the only data on the driver. Label sums are broadcast when counted small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut_table, ship, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24
#: Parts searched together, and entries looked at in a step.
GROUP, STEP = 512, 32
LABELS = 100_000

Books = np.ndarray  # part x entry x component, int64


def integers(vector: str, scale: int, limit: int = LIMIT) -> Column:
    """floor(scale * x) of every component, as bigint, within +-limit."""
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(float(-limit)))).cast("long")
    )


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers; never null."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def total(column: str) -> Column:
    """The sum of whole numbers, at most the largest bigint."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``c``."""
    d = x.shape[1]
    if not d or not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * d * most * most < 2**53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        out = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]
        return out.astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(d):
        gap = x[:, j][:, None] - c[:, j][None, :]
        out += gap * gap
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest nearest entry, squared distance) of every row, by equal-average search."""
    n, d = x.shape
    order = np.argsort(entries.sum(1), kind="stable")
    sums, k = entries.sum(1)[order], len(entries)
    at, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    xs = x.sum(1)
    by = np.argsort(xs, kind="stable")

    def look(rows: np.ndarray, lo: int, hi: int) -> None:
        ids = np.sort(order[lo:hi])  # lower entries first, for ties
        found = squared(x[rows], entries[ids])
        j = found.argmin(1)
        dist, e = found[np.arange(len(rows)), j], ids[j]
        new = (dist < best[rows]) | ((dist == best[rows]) & (e < at[rows]))
        best[rows[new]], at[rows[new]] = dist[new], e[new]

    for start in range(0, n, GROUP):
        rows = by[start : start + GROUP]
        s = xs[rows].astype(np.float64)
        middle = int(np.searchsorted(sums, xs[rows[len(rows) // 2]]))
        lo, hi = max(0, middle - STEP // 2), min(k, middle + STEP // 2)
        if lo == hi:  # beyond the last or before the first sum
            lo, hi = max(0, min(lo, k - 1)), max(0, min(lo, k - 1)) + 1
        look(rows, lo, hi)
        while lo > 0 or hi < k:
            reach = best[rows].astype(np.float64) * d * (1 + 1e-9)
            up = np.maximum(sums[hi] - s, 0) ** 2 <= reach if hi < k else np.zeros(len(rows), bool)
            down = np.maximum(s - sums[lo - 1], 0) ** 2 <= reach if lo > 0 else np.zeros(len(rows), bool)
            if not up.any() and not down.any():
                break
            if up.any():
                look(rows[up], hi, min(k, hi + STEP))
                hi = min(k, hi + STEP)
            if down.any():
                look(rows[down], max(0, lo - STEP), lo)
                lo = max(0, lo - STEP)
    return at, best


def _matrix(col: pa.Array, dim: int, parts: int) -> np.ndarray:
    """part x row x component of an array column whose rows have ``dim`` components."""
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
    wide = -(-dim // parts)
    if wide * parts > dim:
        flat = np.concatenate([flat, np.zeros((n, wide * parts - dim), np.int64)], axis=1)
    return flat.reshape(n, parts, wide).transpose(1, 0, 2)


def _sums(books: Books, dim: int) -> Callable:
    """Vectors to (part, entry, at, n, total): one row for each entry that a task meets
    and each of its components (-1 counts an entry without components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, k, d = books.shape
        n, total = np.zeros((p, k), np.int64), np.zeros((p, k, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dim, p)
            for i in range(p):
                e, _ = nearest(x[i], books[i])
                n[i] += np.bincount(e, minlength=k)
                np.add.at(total[i], e, x[i])
        i, e = np.nonzero(n)
        if not len(i) or not d:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(i, d).astype(np.int32)), pa.array(np.repeat(e, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(i))),
             pa.array(np.repeat(n[i, e], d)), pa.array(total[i, e].reshape(-1))],
            names=["part", "entry", "at", "n", "total"],
        )

    return run


def quantise(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, v (integer components), label of the vectors that are kept."""
    return vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), integers(vector_col, scale).alias("v"), F.col(label_col).alias("label"))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Books, int] | None:
    """The codebooks and the vectors' length; none without vectors."""
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["v"])
    same = kept.where(F.size("v") == dim).select("id", "v")
    start = same.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = np.ascontiguousarray(_matrix(start, dim, parts))
    for _ in range(rounds if dim else 0):
        found = same.select("v").mapInArrow(_sums(books, dim), "part int, entry int, at int, n long, total long")
        found = found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = books.copy()  # parts x entries x components: bounded by the parameters
        for x in found.collect():
            new[x["part"], x["entry"], x["at"]] = int(x["total"]) // x["n"]
        if (new == books).all():
            break  # further rounds would find the same
        books = new
    return books, dim


def encode(kept: DataFrame, books: Books, dim: int) -> DataFrame:
    """id, code, error, label of every vector of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(books)
        for batch in batches:
            x = _matrix(batch.column("v"), dim, p)
            code, error = np.zeros((batch.num_rows, p), np.uint8), np.zeros(batch.num_rows, np.int64)
            for i in range(p):
                e, dist = nearest(x[i], books[i])
                code[:, i] = e
                error += dist
            text = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(text, pa.string()), pa.array(error), batch.column("label")], names=["id", "code", "error", "label"]
            )

    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.where(F.size("v") == dim).mapInArrow(run, f"id {types['id']}, code string, error long, label {types['label']}")


def decode(codes: DataFrame, books: Books, dim: int, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """``codes`` with ``approx``, the vector that a code stands for."""
    entries = F.array(*[F.array(*[F.lit([float(x) / scale for x in e]) for e in book.tolist()]) for book in books])
    number = lambda i: F.conv(F.substring(code_col, 2 * i + 1, 2), 16, 10).cast("int")
    whole = F.concat(*[F.get(F.get(entries, F.lit(i)), number(i)) for i in range(len(books))])
    return codes.withColumn("approx", F.slice(whole, 1, dim))


def digest(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry, place in the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    kept = cut_table(quantise(vectors, scale, id_col, vector_col, label_col))
    fitted = fit(kept, parts, entries, rounds)
    if fitted is None:
        none = kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit("")).limit(0)
    books, dim = fitted
    codes = cut_table(encode(kept, books, dim))
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(total("error").alias("label_error"))
    if by_label.count() <= LABELS:
        by_label = F.broadcast(by_label)
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Brute force: every part against every entry of its codebook."""
    steps = [
        """k as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x::double) or isinf(x::double))) = 0)""",
        "x as (select vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as v from k, range(4) as r(p))",
        "b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from x qualify e < 256)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} as (select vec_id, label, p, min({{'d': d, 'e': e}}) as m, any_value(v) as v from (
 select x.vec_id, x.label, x.p, x.v, b.e, (list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v))::bigint as d
 from x join b{i} as b using (p)) group by vec_id, label, p)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} as (select p, e, list(floor(t / n) order by j) as v from (
 select p, m.e as e, j, sum(v[j]) as t, count(*) as n from a{i}, range(1, len(v) + 1) as r(j) group by all) group by p, e)"""
            )
            steps.append(f"b{i + 1} as (select b.p, b.e, coalesce(s.v, b.v) as v from b{i} as b left join s{i} as s using (p, e))")
    steps.append(
        f"h as (select sha256(string_agg(v[j]::bigint::varchar, ',' order by p, e, j)) as codebooks_sha256 from b{ROUNDS}, range(1, len(v) + 1) as r(j))"
    )
    steps.append(
        f"c as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a{ROUNDS} group by vec_id, label)"
    )
    return (
        "with " + ",\n".join(s.replace(" as (", " as materialized (", 1) for s in steps)
        + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, h"
    )


#: All in whole numbers, which doubles hold exactly at this size.
OP11_SQL = _sql()
