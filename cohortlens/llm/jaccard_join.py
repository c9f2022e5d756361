"""N-gram Jaccard self-join by chosen paths.

A text's set is its five-word shingles (hashed to 64 bits); a text of one to four words has
one shingle of all of them, a text without words the empty set. Two texts are linked when
their sets' Jaccard similarity reaches the threshold, 0.8; equal sets are copies.

Method. Each run samples tokens by a shared hash: a set of n tokens chooses those whose
hash falls below 1 / (threshold * n), so each run sends it to 1 / threshold buckets in the
mean, and two linked sets share one bucket a run or more in the mean. A bucket of at most
``BUCKET_SETS`` sets is brute-forced. A larger one is split again by tokens chosen afresh
for its path, up to ``MAX_DEPTH`` levels. One level keeps a linked pair with a chance of
0.63 a run, two 0.47, three 0.37 (a branching process of mean one), so ``RUNS`` = 24 runs
miss a pair at the threshold in one of 2 * 10^10, 4 * 10^6 and 7 * 10^4 cases; more similar
pairs, which share more tokens, are missed far less.

Chance meetings. Most sets that share a bucket have one passage in common and no more. Each
set has a sketch: how many of its tokens fall in each of some bins, about n / 8 bytes. The sum
over the bins of the smaller count is never below the intersection, so it rules pairs out
exactly. Small buckets are parted where sizes or sketches rule out every pair, and only sets
with a possible partner are fetched. What is fetched grows with the near copies, not with the
chance meetings, which grow faster than the corpus.

Brute force is exact. Parts that share sets form a unit, which is compared whole, so each set
travels once; a unit of over ``UNIT_SETS`` sets whose buckets take less than its square (a long
chain) is compared by bucket, and a pair counts in the smallest bucket that both sets
share. Inside a unit the rarest tokens of every set (as many as a linked set can lack) link
candidates; every group of candidates is compared by exact intersections. Over ``BUCKET_SETS``
sets (near copies of one text share their tokens, however they are split) are compared in
blocks, one task for each pair of blocks. Pairs are not written: a task returns one row a
set, with its number of links and the smallest set it is joined to.

Result: a row for each input row: id, class_id (smallest id of all texts connected by
links or copies), n_links (other rows that are copies or linked), n_copies (rows with an
equal set, itself included).

Null texts have the empty set; empty sets are copies of each other. Null ids stay null, a
class of null ids only has a null class_id. Repeated rows are copies. Long texts are read
whole. No rows: no rows. Columns other than the id and the text are not read.

Scale. Copies collapse by a 128-bit signature of the set before anything is joined. Texts
with a possible partner are shuffled once, to take their token sets to their units, and once
more where there are large buckets, whose sets the further levels read. The others are kept
from either shuffle by a Bloom filter sized for those asked for, where these can't be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, cut_narrow, cut_table, mix, parts, shingles, ship, slices, table, words
from cohortlens.operators.runtime_filter import runtime_filters

WORDS, THRESHOLD = 5, 0.8
RUNS, MAX_DEPTH = 24, 3
BUCKET_SETS, UNIT_SETS = 1500, 6000
#: Pairs of sets that a task looks at together: its memory doesn't follow the square of a unit.
HELD_PAIRS = 1 << 20
#: Bins of a set's sketch.
MIN_BINS, MAX_BINS = 64, 4096

_U = np.uint64
_FULL = float(2**64)


def _odd(x: np.ndarray) -> np.ndarray:
    return mix(x) | _U(1)


_RUN_KEYS = _odd(np.arange(1, 1 + 256, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


def token_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted token sets of some texts, end to end, and their n+1 offsets."""
    row, _, _, h = words(texts)
    at, x = shingles(row, h, k)
    n = len(texts)
    ends = np.searchsorted(row[at], np.arange(n + 1))
    first = np.searchsorted(row, np.arange(n + 1))
    sets = []
    for i in range(n):
        if ends[i] < ends[i + 1]:
            sets.append(np.unique(x[ends[i] : ends[i + 1]]))
        elif first[i] < first[i + 1]:
            own = h[first[i] : first[i + 1]]
            sets.append(mix(np.add.reduce(own * _RUN_KEYS[: len(own)], keepdims=True) + _U(len(own))))
        else:
            sets.append(np.zeros(0, np.uint64))
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offs


def signatures(tokens: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """128 bits for each set, whatever the order of its tokens."""
    sums = [np.concatenate([[_U(0)], np.cumsum(mix(tokens ^ _U(c)), dtype=np.uint64)]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    a, b = (mix(s[offs[1:]] - s[offs[:-1]] + np.diff(offs).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) for s in sums)
    return [x.tobytes() for x in np.stack([a, b], axis=1)]


def _limit(sizes: np.ndarray, rate: float) -> np.ndarray:
    """The hash value below which a set of each size chooses a token."""
    return np.minimum(_FULL - 2048, _FULL * rate / np.maximum(sizes, 1)).astype(np.uint64)


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each of 2^i bins, about 8 a bin: the sum over the bins of the
    smaller of two sets' counts is never below their intersection."""
    bins = min(MAX_BINS, max(MIN_BINS, 1 << max(0, len(tokens) // 8 - 1).bit_length()))
    counts = np.bincount((tokens & _U(bins - 1)).astype(np.int64), minlength=bins)
    t = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return bytes([np.dtype(t).itemsize]) + counts.astype(t).tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1).astype(np.int64)


def _first_level(k: int, rate: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, offs = token_sets(part.column("text"), k)
                sizes = np.diff(offs)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                limit = _limit(sizes, rate)[owner]
                who, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for key in _RUN_KEYS[:runs]:
                    r = tokens * key
                    hit = np.flatnonzero(r < limit)
                    who.append(owner[hit])
                    bucket.append(mix(r[hit] ^ key))
                who, bucket = np.concatenate(who), np.concatenate(bucket)
                order = np.argsort(who, kind="stable")
                starts = np.searchsorted(who[order], np.arange(len(sizes) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("id"), pa.array(signatures(tokens, offs), pa.binary()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(starts), pa.array(bucket[order].view(np.int64))),
                     pa.array([sketch(tokens[a:b]) for a, b in zip(offs, offs[1:], strict=False)], pa.binary())],
                    names=["key", "id", "sig", "n", "buckets", "sketch"],
                )

    return run


def _next_level(rate: float):
    """Rows (sig, tokens, paths) to rows (sig, parent, bucket): tokens chosen afresh for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            for sig, tokens, paths in zip(*(batch.column(c).to_pylist() for c in ("sig", "tokens", "paths")), strict=True):
                own = np.frombuffer(tokens, np.uint64)
                limit = _limit(np.array([len(own)]), rate)[0]
                keys = _odd(np.array(paths, dtype=np.int64).view(np.uint64))
                for parent, key in zip(paths, keys, strict=True):
                    r = own * key
                    out += [(sig, parent, b) for b in mix(r[r < limit] ^ key).view(np.int64).tolist()]
            if out:
                cols = zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["sig", "parent", "bucket"])

    return run


def _with_sets(k: int):
    """Rows (text, sig, ...) to the same with the token set in place of the text; of
    repeated rows that a task holds, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, offs = token_sets(part.column("text"), k)
                have = signatures(tokens, offs)
                first = {s: i for i, s in reversed(list(enumerate(part.column("sig").to_pylist()))) if s == have[i] and s not in seen}
                ok = sorted(first.values())
                seen.update(first)
                if not ok:
                    continue
                rest = part.drop_columns(["text"]).take(pa.array(ok))
                sets = pa.array([tokens[offs[i] : offs[i + 1]].tobytes() for i in ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns, sets], names=[*rest.schema.names, "tokens"])

    return run


def _asked(df: DataFrame) -> DataFrame:
    """Rows to join others with, written with a mark, as Spark filters a join only by a side with a comparison."""
    return cut_table(df.withColumn("_known", F.lit(1)))


def _known(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    return rows.join(asked.where(F.col("_known") == 1).drop("_known"), key)


def _fetch(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows (key, sig, ...) with the token set in place of the key. Within ``runtime_filters``
    only texts that are asked for are shuffled, but for the filter's false positives."""
    met = _known(texts.select("key", "text"), asked, "key").drop("key")
    return met.mapInArrow(_with_sets(k), met.drop("text").withColumn("tokens", F.lit(None).cast("binary")).schema)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` nodes is connected to by edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(sets: list[np.ndarray], weights: np.ndarray, seen: list[np.ndarray], side: np.ndarray | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(links, component) of each set among the others. ``seen``: the smaller buckets of
    each set; a pair that shares one counts there. ``side``: if given, only pairs of a set
    with side 0 and one with side 1 are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    links = np.zeros(m, np.int64)
    owner = np.repeat(np.arange(m), sizes)
    value, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Candidates: sets that share one of the rarest tokens which a linked set can't all lack.
    order = np.lexsort((of, counts[of], owner))
    rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(sizes)])[:-1][owner[order]]
    lacks = sizes - np.array([-(-int(s) * threshold.numerator // threshold.denominator) for s in sizes])
    keep = (rank <= lacks[owner[order]]) & (counts[of[order]] > 1)
    tok, who = of[order][keep], owner[order][keep]
    by = np.argsort(tok, kind="stable")
    tok, who = tok[by], who[by]
    same = tok[1:] == tok[:-1] if len(tok) else np.zeros(0, bool)
    label = _components(m, who[:-1][same], who[1:][same]) if same.any() else np.arange(m)
    t, u = threshold.numerator, threshold.denominator
    groups, joined = np.argsort(label, kind="stable"), np.arange(m)
    ends = np.flatnonzero(np.concatenate([np.diff(label[groups]) > 0, [True]])) + 1
    start = 0
    for end in ends:
        g, start = groups[start:end], end
        if len(g) < 2 or (side is not None and len(np.unique(side[g])) < 2):
            continue
        own = np.arange(len(g))
        for (top, inter), (_, met) in zip(_overlaps([sets[i] for i in g]), _overlaps([seen[i] for i in g]), strict=True):
            here = g[top : top + len(inter)]
            both = sizes[here][:, None] + sizes[g][None, :]
            alike = (u + t) * inter >= t * both  # inter / (both - inter) >= t / u
            np.fill_diagonal(alike[:, top:], False)
            if side is not None:
                alike &= side[here][:, None] != side[g][None, :]
            a, b = np.nonzero(alike)
            up = a + top < b
            own = _components(len(g), np.concatenate([a[up] + top, np.arange(len(g))]), np.concatenate([b[up], own]))
            alike &= met == 0
            links[here] += alike @ weights[g]
        joined[g] = g[own]
    return links, joined


def may_be_linked(n: np.ndarray, group: np.ndarray, sketches: list[bytes], threshold: Fraction, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within a group that their sizes and sketches don't rule out. Rows are sorted by
    group and size. No pair at the threshold is left out, but with ``label`` those that are
    connected by pairs found before: it names what is connected, by the first row, and is brought up to date."""
    t, u = threshold.numerator, threshold.denominator
    rough = np.array([_counts(c).reshape(-1, MIN_BINS).sum(0) for c in sketches]).reshape(len(n), MIN_BINS)
    active, found_a, found_b, d = np.arange(len(n)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while True:
        d += 1
        active = active[active + d < len(n)]
        other = active + d
        active = active[(group[active] == group[other]) & (u * n[active] >= t * n[other])]  # holds for no larger d where it fails
        if not len(active):
            return np.concatenate(found_a), np.concatenate(found_b)
        ask = active if label is None else active[label[active] != label[active + d]]
        other = ask + d
        need = t * (n[ask] + n[other])  # inter / (both - inter) >= t / u
        pass_ = np.flatnonzero((u + t) * np.minimum(rough[ask], rough[other]).sum(1) >= need)
        fine = []
        for i in pass_.tolist():
            x, y = _counts(sketches[ask[i]]), _counts(sketches[other[i]])
            bins = min(len(x), len(y))
            both = np.minimum(x.reshape(-1, bins).sum(0), y.reshape(-1, bins).sum(0)).sum()
            if bins == MIN_BINS or (u + t) * both >= need[i]:
                fine.append(i)
        found_a.append(ask[fine])
        found_b.append(other[fine])
        if label is not None and fine:
            label[:] = _components(len(n), np.concatenate([np.arange(len(n)), ask[fine]]), np.concatenate([label, other[fine]]))


def _part_buckets(threshold: Fraction):
    """Rows (bucket, sig, n, sketch), sorted by all but the last, to (bucket, sig, to, m): each
    bucket in parts between which no pair can be linked, without sets that can be in none.
    ``to`` is the part's first set, ``m`` its number of sets."""

    def pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets of about ``HELD_PAIRS`` pairs at a time."""
        bucket = t.column("bucket").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        m = np.diff(first, append=t.num_rows)
        at = first[np.flatnonzero(np.diff(np.cumsum(m * m) // HELD_PAIRS, prepend=-1))]
        for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
            yield part(t.slice(lo, hi - lo))

    def part(t: pa.Table) -> pa.RecordBatch:
        bucket = t.column("bucket").to_numpy().astype(np.int64)
        sig = t.column("sig").to_pylist()
        n = t.column("n").to_numpy().astype(np.int64)
        label = np.arange(len(n))
        may_be_linked(n, bucket, t.column("sketch").to_pylist(), threshold, label)
        size = np.bincount(label, minlength=len(n))
        out = np.flatnonzero(size[label] > 1)
        first = label[out]
        start = np.searchsorted(bucket, bucket[first])  # names the part by its first set's place in the bucket
        new = mix(bucket[out].view(np.uint64) + (first - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        return pa.RecordBatch.from_arrays(
            [pa.array(new.view(np.int64)), pa.array([sig[i] for i in out], pa.binary()), pa.array([sig[i] for i in first], pa.binary()), pa.array(size[first])],
            names=["bucket", "sig", "to", "m"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            bucket = rows.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0  # the last bucket may go on
            if whole:
                yield from pieces(rows.slice(0, whole))
            left = rows.slice(whole)
        if left is not None and left.num_rows:
            yield from pieces(left)

    return run


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """All intersection sizes of a few sets, as products of slices of a 0-1 matrix: (first row,
    rows) for so many rows at a time that about ``HELD_PAIRS`` sizes are held."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[of] > 1
    new = np.cumsum(counts > 1) - 1
    owner, of = owner[keep], new[of[keep]]
    width = max(1, (4 << 20) // m)
    order = np.argsort(of, kind="stable")
    owner, of = owner[order], of[order]
    total = int(of[-1]) + 1 if len(of) else 0
    rows = max(1, HELD_PAIRS // m)
    for top in range(0, m, rows):
        out = np.zeros((min(rows, m - top), m), np.float64)
        for lo in range(0, total, width):
            part = slice(np.searchsorted(of, lo), np.searchsorted(of, lo + width))
            x = np.zeros((m, min(width, total - lo)), np.float32)
            x[owner[part], of[part] - lo] = 1
            out += x[top : top + rows] @ x.T
        yield top, np.rint(out).astype(np.int64)


def _brute(threshold: Fraction):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pydict()
        here, left, right = (rows[c][0] for c in ("bucket", "left", "right"))
        # A set that came twice (repeated ids) counts once.
        first = {s: i for i, s in reversed(list(enumerate(rows["sig"])))}
        at = sorted(first.values())
        sets = [np.frombuffer(rows["tokens"][i], np.uint64) for i in at]
        weights = np.array([rows["copies"][i] for i in at], dtype=np.int64)
        seen = [np.array([b for b in rows["leaves"][i] if b < here], dtype=np.int64) for i in at]
        side = None if left == right else np.array([int(rows["block"][i] == right) for i in at])
        links, label = compare(sets, weights, seen, side, threshold)
        size = np.bincount(label, minlength=len(at))
        sig = [rows["sig"][i] for i in at]
        low: dict[int, bytes] = {}
        for i, g in enumerate(label.tolist()):
            low[g] = min(low.get(g, sig[i]), sig[i])
        out = [i for i in range(len(at)) if size[label[i]] > 1]
        return pa.table({"sig": pa.array([sig[i] for i in out], pa.binary()), "to": pa.array([low[int(label[i])] for i in out], pa.binary()),
                         "links": pa.array([int(links[i]) for i in out], pa.int64()), "whole": pa.array([rows["whole"][0]] * len(out), pa.bool_())})

    return run


def _key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text; rows of one key are repeated rows."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.col(text_col)).cast("string"))


def connect(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(sig, root): the smallest signature that each is connected to. Rounds of taking the
    smallest neighbour's root, then the root's root, until nothing changes. ``nodes``: also
    those without an edge to another."""
    both = cut_narrow(edges.select("sig", "to").union(edges.select("to", "sig")).where("sig <> to").distinct())
    roots = both.groupBy("sig").agg(F.min("to").alias("m")).select("sig", F.least("sig", "m").alias("root"))
    if nodes is not None:
        roots = roots.unionByName(nodes.select("sig", F.col("sig").alias("root"))).groupBy("sig").agg(F.min("root").alias("root"))
    roots = cut_narrow(roots)
    while True:
        near = both.join(roots.select(F.col("sig").alias("to"), F.col("root").alias("r")), "to").groupBy("sig").agg(F.min("r").alias("r"))
        new = roots.join(near, "sig", "left").select("sig", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        new = cut_narrow(new)
        jump = new.select(F.col("sig").alias("root"), F.col("root").alias("up"))
        new = cut_narrow(new.join(jump, "root", "left").select("sig", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("sig", "root")
        if not changed:
            return roots


def join_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, runs: int = RUNS, bucket_sets: int = BUCKET_SETS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links, n_copies for each row of ``docs``."""
    return _groups(docs, threshold, k, runs, bucket_sets, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def _groups(docs: DataFrame, threshold: float, k: int, runs: int, bucket_sets: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    exact = Fraction(str(threshold))
    rate = 1 / threshold
    idt = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(_first_level(k, rate, runs), f"key string, id {idt}, sig binary, n long, buckets array<bigint>, sketch binary"))
    one = [F.min_by(c, "key").alias(c) for c in ("n", "buckets", "sketch")]  # equal sets have equal ones
    classes = cut(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.min("key").alias("key"), *one))
    rows = rows.drop("n", "buckets", "sketch")
    level = classes.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "sig")
    shared = level.join(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"), "bucket", "left_semi")
    some = shared.groupBy("sig").agg(F.collect_list("bucket").alias("buckets"))
    some = cut(some.join(classes.select("sig", "key", "copies", "n", "sketch"), "sig"))
    # (bucket, sig) level by level; those that stay small are leaves.
    level = some.select(F.explode("buckets").alias("bucket"), "sig", F.lit(None).cast("long").alias("parent"))
    leaves, heaps, parents, sets = [], [], None, None
    for depth in range(1, MAX_DEPTH + 1):
        # Members are summed exactly, so buckets of the same members have the same sum.
        member = F.sum(F.xxhash64("sig").cast("decimal(20,0)")).alias("who")
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), member, F.min("parent").alias("parent")).where("m > 1")
        if parents is not None:
            sizes = sizes.join(parents.withColumnsRenamed({"bucket": "parent", "m": "before"}), "parent", "left")
            stuck = F.coalesce(F.col("m") * 2 > F.col("before"), F.lit(False))  # splitting doesn't part near copies
        else:
            stuck = F.lit(False)
        sizes = cut(sizes.withColumn("stuck", stuck))
        small = F.col("m") <= bucket_sets
        go_on = ~small & ~F.col("stuck") if depth < MAX_DEPTH else F.lit(False)
        leaf = sizes.where(~go_on).groupBy("who", "m").agg(F.min("bucket").alias("bucket"))
        leaves.append(level.join(leaf.where(small).select("bucket"), "bucket", "left_semi").select("bucket", "sig"))
        heaps.append(level.join(leaf.where(~small).select("bucket"), "bucket", "left_semi").select("bucket", "sig"))
        large = sizes.where(go_on).select("bucket", "m")
        if depth == MAX_DEPTH or not large.limit(1).count():
            break
        paths = level.join(large.select("bucket"), "bucket", "left_semi").groupBy("sig").agg(F.collect_list("bucket").alias("paths"))
        if sets is None:  # later levels have none but these
            asked = _asked(paths.join(some.select("sig", "key"), "sig"))
            with runtime_filters(spark, asked.count()):
                again = sets = cut_table(_fetch(texts, asked, k))
        else:  # of which only those with a path are shuffled
            asked = _asked(paths)
            with runtime_filters(spark, asked.count()):
                again = cut(_known(sets.drop("paths"), asked, "sig"))
        level = cut(again.mapInArrow(_next_level(rate), "sig binary, parent long, bucket long").distinct())
        parents = large
    # Small buckets are parted where no pair can be linked; the sets of those that stayed large keep a list of them.
    found = reduce(DataFrame.unionByName, leaves).join(some.select("sig", "n", "sketch"), "sig").select("bucket", "n", "sig", "sketch")
    found = found.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "n", "sig")
    found = cut_narrow(found.mapInArrow(_part_buckets(exact), "bucket long, sig binary, to binary, m long"))
    heap = cut_narrow(reduce(DataFrame.unionByName, heaps).groupBy("sig").agg(F.sort_array(F.collect_list("bucket")).alias("heaps")))
    # Units: parts and large buckets that share sets. Large buckets that share a set are joined first, as these are few.
    edges, costs = found.select("sig", "to"), found.select("sig", "m")
    if heap.limit(1).count():
        of = heap.select(F.explode("heaps").alias("sig"), F.col("heaps")[0].alias("to")).distinct()
        of = connect(of, of.select("sig").distinct()).select(F.col("sig").alias("bucket"), F.col("root").alias("heap"))
        in_heap = heap.select("sig", F.col("heaps")[0].alias("bucket"), F.size("heaps").alias("times")).join(of, "bucket").drop("bucket")
        in_heap = cut_narrow(in_heap)
        least = in_heap.groupBy("heap").agg(F.min("sig").alias("to"), F.count(F.lit(1)).alias("m"))
        in_heap = in_heap.join(least, "heap")
        edges = edges.unionByName(in_heap.select("sig", "to"))
        costs = costs.unionByName(in_heap.select("sig", (F.col("m") * F.col("times")).alias("m")))
    unit = connect(edges)
    # A unit is compared whole, or by its buckets where that is less: a long chain of small ones.
    costs = costs.groupBy("sig").agg(F.sum("m").alias("cost"))
    unit = unit.join(costs, "sig", "left")
    sums = unit.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("cost").alias("cost"))
    unit = cut_narrow(unit.drop("cost").join(sums, "root"))
    whole = (F.col("m") <= UNIT_SETS) | (F.col("m") * F.col("m") <= 4 * F.col("cost"))
    small = unit.where(whole).select("sig", F.xxhash64("root").alias("bucket"), "root", "m", F.array().cast("array<bigint>").alias("leaves"))
    big = unit.where(~whole).select("sig")
    if big.limit(1).count():
        all_of = found.select("bucket", "sig").unionByName(heap.select(F.explode("heaps").alias("bucket"), "sig"))
        big = cut(all_of.join(big, "sig", "left_semi"))
        per_set = big.groupBy("sig").agg(F.sort_array(F.collect_list("bucket")).alias("leaves"))
        big = big.join(big.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket").join(per_set, "sig")
        small = small.unionByName(big.select("sig", "bucket", F.lit(None).cast("binary").alias("root"), "m", "leaves"))
    work = small
    # Blocks of a unit that stayed large; a set meets every block once.
    blocks = F.ceil(F.col("m") / bucket_sets).cast("int")
    work = work.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    work = work.withColumn("whole", F.col("root").isNotNull() & (F.col("blocks") == 1)).drop("other", "m", "blocks")
    # A set's places ride with its text, so that it is shuffled as a text and as tokens, once each.
    todo = work.groupBy("sig").agg(F.collect_list(F.struct("bucket", "root", "left", "right", "block", "leaves", "whole")).alias("todo"))
    asked = _asked(todo.join(some.select("sig", "key", "copies"), "sig"))
    with runtime_filters(spark, asked.count()):
        work = _fetch(texts, asked, k).select("sig", "copies", "tokens", F.inline("todo"))
        found = cut_narrow(work.groupBy("bucket", "root", "left", "right").applyInArrow(_brute(exact), "sig binary, to binary, links long, whole boolean"))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    # A unit compared in one task is joined as a whole there; others are joined here.
    roots, apart = found.where("whole").select("sig", F.col("to").alias("root")), found.where("not whole")
    if apart.limit(1).count():
        roots = roots.unionByName(connect(apart))
    named = classes.join(roots, "sig", "left").join(links, "sig", "left")
    named = named.select("sig", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sig").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("class_id"))
    named = named.join(low, "root").select("sig", "root", "copies", "links", "class_id")
    return rows.select("id", "key", "sig").join(named, "sig").select(
        "id", "key", "sig", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (null ids last); of
    repeated ids the smallest signature; of repeated rows one."""
    names = docs.columns
    groups = _groups(docs, threshold, k, RUNS, BUCKET_SETS, id_col, text_col)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig", "key")).alias("b"))
    row = docs.select(F.struct(*names).alias("_doc"), _key(id_col, text_col).alias("_key"))
    kept = row.join(best.select(F.col("b.key").alias("_key")), "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(*[F.col("_doc")[c].alias(c) for c in names])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


#: Exact: every pair of texts that share a shingle, then the transitive closure.
OP6_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                     when len(w) > 0 then [array_to_string(w, ' ')] else [''] end) as s from d),
n as (select r, count(*) as n from s group by r),
c as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.s = b.s and a.r <> b.r group by all),
p as (select a, b, (c = x.n and c = y.n) as same from c join n x on x.r = a join n y on y.r = b where 9 * c >= 4 * (x.n + y.n)),
reach(r, t) as (select r, r from d union select reach.r, p.b from reach join p on p.a = reach.t),
k as (select reach.r, min(d.doc_id) as class_id from reach join d on d.r = reach.t group by reach.r)
select d.doc_id, k.class_id, (select count(*) from p where p.a = d.r) as n_links, 1 + (select count(*) from p where p.a = d.r and same) as n_copies
from d join k using (r)
"""
