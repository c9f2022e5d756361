"""Lexical retrieval packing: documents into token sequences of one length.

Method. Documents are brought into one order in which lexically related ones are near, and
the order is cut into shards of about ``SHARD_BYTES`` of text. Each shard holds a BM25
inverted index of its documents. A seed document opens a window; its
unused neighbours, best BM25 score first, fill it, and the document that reaches the
window's end is cut there; its rest opens the next window and is that window's seed. A
document longer than a window fills windows by itself. So only a shard's last window is
padded: below 0.2 percent of all tokens.

The order. Words are weighed by their document frequency among all documents, counted in a
table of hashes. First by topic: the nearest of ``TOPICS`` centres, found by spherical k-means
over the points of all documents, their weighted words hashed to ``DIMS`` whole numbers; only
the places that the centres set out from are those of a few rows. Then by two terms, drawn
with a shared hash and a chance that grows with idf: documents draw the same one in proportion
to the weight of the terms they share, however large the input is. Many documents of equal draws (copies)
follow by row number, over as many shards as they need. A neighbour in another shard is
still never a candidate; the README has the share of true best neighbours that are met.

Tokens. Ids come from the tokenizer file, then ``END_ID`` closes each document. The
tokenizer's normaliser and pre-tokenizer never look across ASCII white space, so a word's
ids don't depend on its neighbours: each worker encodes a word once and keeps the ids of
up to ``CACHE_WORDS`` words by the word's 64-bit hash. Words of plain Latin letters, digits and signs go to the same
model in one call, cut where the tokenizer's own pattern cuts; all others go through the
whole tokenizer.

Null or empty texts are one ``END_ID``. Repeated rows and null ids are packed row by row.
Long texts are cut into as many windows as they need. No rows: no rows. Columns other than
the id and the text are not read.

Scale. The texts are written once with their keys and shuffled once; the order is that of
a narrow table. The points are written once more, a batch a value, for the rounds. Counts and centres are sums over all tasks, tables of a fixed size (8 MB and
256 KB), whole numbers and so the same however the rows are dealt. The driver holds these and
the first key of each shard (16 MB for 1 TB of text). A task holds one shard at a time; a longer document makes its
shard larger by itself only. Terms in more than half of a shard have a BM25 weight of
zero by the formula and aren't scored. The tokenizer file goes to workers as a broadcast of
its fixed size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import NARROW_ROWS, cut, cut_table, mix, ship, slices, string_bytes, table, words

LENGTH, END_ID = 2048, 1
SHARD_BYTES = 2 << 20
K1, B = 1.2, 0.75
CACHE_WORDS = 1_500_000
#: Neighbours of a seed that are sorted before the others.
NEAR = 16
#: Text that is split into words at once: the processor's cache holds it.
SLICE_BYTES = 1 << 19
TOPICS, ROUNDS = 64, 8
#: Numbers of a point, and its length; bits of the table of document frequencies, and its parts.
DIMS, UNIT = 512, 256
WEIGHT_BITS, COUNT_BLOCKS = 20, 64

_LATIN = "À-ÖØ-öø-ÿ"
#: Bytes that no word of the fast way has (nor the signs of multiplication and division): in
#: all other words, lower-casing and normalising are Python's too.
_ODD = np.ones(256, bool)
_ODD[[10, *range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3]] = False
#: The tokenizer's own pattern on lower-cased plain words.
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}\n]+")


class Store:
    """Id runs by the hash of a word, end to end in one array; emptied when it holds too many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names = np.zeros(0, np.uint64)  # sorted, with the place and size of each run
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def add(self, names: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        order = np.argsort(names)
        at = np.searchsorted(self.names, names[order])
        size = np.diff(ends, prepend=0)
        self.names = np.insert(self.names, at, names[order])
        self.begin = np.insert(self.begin, at, (ends - size + self.used)[order])
        self.size = np.insert(self.size, at, size[order])
        self.used += len(flat)

    def runs(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of each name's ids in ``flat``."""
        at = np.searchsorted(self.names, names)
        return self.begin[at], self.size[at].astype(np.int64)

    def room(self, names: np.ndarray) -> np.ndarray:
        """Places of the names that are not held; empties the store if all don't fit."""
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            new = np.flatnonzero(self.names[at] != names)
            if len(self.names) + len(new) <= CACHE_WORDS:
                return new
            self.clear()
        return np.arange(len(names))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin : begin + size], end to end."""
    stop = np.cumsum(size)
    return flat[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]


def named(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted; where each appears first; which of them each is. ``np.unique``
    in less time, as only the distinct ones are sorted."""
    met = pa.array(h).dictionary_encode()
    names, of = met.dictionary.to_numpy(), met.indices.to_numpy()
    first, rank, order = np.empty(len(names), np.int64), np.empty(len(names), np.int64), np.argsort(names)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    rank[order] = np.arange(len(names))
    return names[order], first[order], rank[of]


def closed(data: np.ndarray, start: np.ndarray, end: np.ndarray, by: bytes) -> np.ndarray:
    """The words data[start:end], end to end, a byte after each."""
    size = end - start + 1
    out = gather(np.append(data, np.uint8(0)), start, size)
    out[np.cumsum(size) - 1] = by[0]
    return out


class Encoder:
    """Ids of words, kept for words, and parts of words, met before."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        spec = json.loads(source)
        self.special = tuple(t["content"].encode() for t in spec["added_tokens"])
        model = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.model = Tokenizer.from_str(json.dumps(model))
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.words, self.bits = Store(), Store()

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> None:
        """Adds the words data[start:end] to the store."""
        lines = closed(data, start, end, b"\n")
        stop = np.cumsum(end - start + 1)
        odd = _ODD[lines]
        odd[1:] |= (lines[:-1] == 0xC3) & ((lines[1:] == 0x97) | (lines[1:] == 0xB7))
        ok = np.add.reduceat(odd, stop - (end - start + 1), dtype=np.int64) == 0
        raw = lines.tobytes()
        if any(x in raw for x in self.special):
            ok &= ~np.array([any(x in w for x in self.special) for w in raw[:-1].split(b"\n")])
        if ok.any():
            # A space after each part, a line for each word.
            text = raw if ok.all() else closed(data, start[ok], end[ok], b"\n").tobytes()
            parted = pa.array([_CUT.sub(r"\g<0> ", text.decode("utf-8").lower())])
            sign, _ = string_bytes(parted)
            _, left, right, h = words(parted)
            parts = np.searchsorted(left, np.flatnonzero(sign == 10))  # before each line's end
            bit, first, of = named(h)
            new = self.bits.room(bit)
            if len(new):
                fresh = closed(sign, left[first[new]], right[first[new]], b" ").tobytes().decode("utf-8")
                ids = np.array(self.model.encode_batch_fast([fresh], add_special_tokens=False)[0].ids, dtype=np.uint16)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(new):
                    raise ValueError("the model left a part without a closing token")
                self.bits.add(bit[new], ids, stops)
            begin, size = self.bits.runs(bit)
            begin, size = begin[of], size[of]
            self.words.add(names[ok], gather(self.bits.flat, begin, size), np.cumsum(size)[parts - 1])
        rest = np.flatnonzero(~ok)
        if len(rest):
            texts = [raw[a:b].decode("utf-8") for a, b in zip((stop - 1 - (end - start))[rest], stop[rest] - 1, strict=True)]
            got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            self.words.add(names[rest], np.array([i for x in got for i in x], np.uint16), np.cumsum([len(x) for x in got]))

    def ids(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each text; then (row, term, number of terms) for the index."""
        data, _ = string_bytes(texts)
        row, start, end, h = words(texts)
        names, first, term = named(h)
        new = self.words.room(names)
        if len(new):
            self.encode(data, start[first[new]], end[first[new]], names[new])
        begin, size = self.words.runs(names)
        lens = size[term]
        all_ids = gather(self.words.flat, begin[term], lens)
        stops = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(row, np.arange(len(texts) + 1))]
        out = [np.append(all_ids[stops[i] : stops[i + 1]], np.uint16(END_ID)) for i in range(len(texts))]
        return out, row, term, np.int64(len(names))


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, n_terms: int):
        length = np.bincount(row, minlength=n)
        pair, tf = np.unique(term * np.int64(n) + row, return_counts=True)
        t, self.doc = pair // n, pair % n
        self.ends = np.searchsorted(t, np.arange(n_terms + 1))
        df = np.diff(self.ends)
        self.idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.score = tf * (K1 + 1) / (tf + norm[self.doc]) * self.idf[t]
        # A term of one document scores for that document alone.
        self.alone = np.bincount(self.doc, weights=np.where(df[t] == 1, self.score, 0), minlength=n)
        use = np.flatnonzero((df > 1)[t] & (self.idf > 0)[t])
        order = use[np.argsort(self.doc[use], kind="stable")]
        self.terms, self.of = t[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents for the distinct terms of one."""
        q = self.terms[self.of[doc] : self.of[doc + 1]]
        lo, size = self.ends[q], self.ends[q + 1] - self.ends[q]
        stop = np.cumsum(size)
        at = np.repeat(lo - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        out = np.bincount(self.doc[at], weights=self.score[at], minlength=self.n)
        out[doc] += self.alone[doc]
        return out


def best_first(score: np.ndarray) -> Iterator[int]:
    """The places of the scores, best first, ties in order. A window takes a few, so the
    ``NEAR`` best are sorted first, and all only when these don't do."""
    n, done = len(score), 0
    if n > 4 * NEAR:
        top = np.flatnonzero(score >= np.partition(score, n - NEAR)[n - NEAR])
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        done = len(top)
    if done < n:
        yield from np.argsort(-score, kind="stable")[done:].tolist()


def fill(sizes: list[int], neighbours, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, window, offset). ``neighbours`` gives the scores of
    all documents for a seed; ties go to the earlier document."""
    unused = np.ones(len(sizes), bool)
    pieces, window, used, nxt = [], 0, 0, 0

    def place(doc: int) -> None:
        nonlocal window, used
        unused[doc] = False
        start = 0
        while start < sizes[doc]:
            take = min(sizes[doc] - start, length - used)
            pieces.append((doc, start, take, window, used))
            start, used = start + take, used + take
            if used == length:
                window, used = window + 1, 0

    while True:
        while nxt < len(sizes) and not unused[nxt]:
            nxt += 1
        if nxt == len(sizes):
            return pieces
        if used == 0:
            place(nxt)
            continue
        seed, at = pieces[-1][0], window
        score = np.where(unused, neighbours(seed), -1.0)
        for doc in best_first(score):
            if score[doc] < 0 or window != at:
                break
            place(doc)


def weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Idf of each place in the table of document frequencies of ``n`` documents."""
    return np.maximum(0.0, np.log((n - counts + 0.5) / (counts + 0.5))).astype(np.float32)


def _whole(x: np.ndarray) -> np.ndarray:
    """Vectors of length ``UNIT`` in whole numbers: their products and sums are exact, so
    that no topic depends on how the rows were dealt."""
    size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.clip(np.rint(x * (UNIT / size)), -127, 127).astype(np.int8)


def draws(texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, first draw, second draw) of each text. The point has the weights of its words,
    by hash, with a sign; a draw stands for a term."""
    n = len(texts)
    row, _, _, h = words(texts)
    ends = np.searchsorted(row, np.arange(n + 1))
    w = weight[h >> np.uint64(64 - WEIGHT_BITS)]
    at, signed = (h & np.uint64(DIMS - 1)).astype(np.int64), np.where(h & np.uint64(DIMS), -w, w)
    points = np.zeros((n, DIMS), np.int8)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        part = slice(ends[lo], ends[hi])
        x = np.bincount((row[part] - lo) * DIMS + at[part], weights=signed[part], minlength=(hi - lo) * DIMS)
        points[lo:hi] = _whole(x.reshape(hi - lo, DIMS))
    # The smallest of exponential draws at the rate of the weight, and the next smallest.
    u = ((mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    with np.errstate(divide="ignore"):
        draw = np.where(w > 0, -np.log(u) / w, np.inf)
    some = np.flatnonzero(np.diff(ends))
    first, second = np.full(n, np.inf), np.full(n, np.inf)
    if len(some):
        first[some] = np.minimum.reduceat(draw, ends[some])
        second[some] = np.minimum.reduceat(np.where(draw == first[row], np.inf, draw), ends[some])
    return points, first, second


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of each point; products of whole numbers, exact as floats."""
    return (points.astype(np.float32, copy=False) @ centres.T.astype(np.float32)).argmax(1).astype(np.int32)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("point").cast(pa.large_binary())
    if not len(col):
        return np.zeros((0, DIMS), np.int8)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.int8)[offs[0] : offs[-1]].reshape(-1, DIMS)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of each batch as one value, so that many rounds don't handle them row by row."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([_points(batch).tobytes()], pa.binary())], names=["points"])


def _rows(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["block", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "sums")), strict=True):
            own = np.frombuffer(sums, np.int64)
            out[block] = out[block] + own if block in out else own
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["block", "sums"])


def _summed(df: DataFrame, run) -> np.ndarray:
    """The sum over all tasks of the table of whole numbers that ``run`` makes of each task's rows."""
    some = df.mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(_add, "block int, sums binary").collect()
    return np.array([np.frombuffer(r.sums, np.int64) for r in sorted(some)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << WEIGHT_BITS, np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            row, _, _, h = words(part.column("text"))
            at = (h >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                counts[at[a:b]] += 1  # once for each place, however often it is named
    yield _rows(counts.reshape(COUNT_BLOCKS, -1))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of ``_counted``, and one more that starts with the bytes and the number of rows."""
    held = np.zeros((1 << WEIGHT_BITS) // COUNT_BLOCKS, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held[:2] += [string_bytes(batch.column("text"))[1][-1] + 16 * batch.num_rows, batch.num_rows]
            yield batch

    yield from _counted(told())
    yield pa.RecordBatch.from_arrays([pa.array([COUNT_BLOCKS], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["block", "sums"])


def _moved(centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        sums = np.zeros(known.shape, np.int64)
        for points in (np.frombuffer(x.as_buffer(), np.int8).reshape(-1, DIMS) for batch in batches for x in batch.column("points")):
            for lo in range(0, len(points), 4096):
                part = points[lo : lo + 4096].astype(np.float32)
                of = np.zeros((len(part), len(known)), np.float32)
                of[np.arange(len(part)), nearest(part, known)] = 1
                sums += np.rint(of.T @ part).astype(np.int64)
        yield _rows(sums)

    return run


def fit_topics(points: DataFrame) -> np.ndarray:
    """Centres of spherical k-means over all rows (row, point): every round moves each centre
    to the direction of the sum of its points, until none moves, ``ROUNDS`` times at most."""
    spark = points.sparkSession
    some = points.orderBy(F.xxhash64("row"), "row").limit(TOPICS).collect()
    centres = np.array([np.frombuffer(r.point, np.int8) for r in some]).reshape(-1, DIMS)
    blocks = cut_table(points.select("point").mapInArrow(_blocked, "points binary"), compression="zstd")
    for _ in range(ROUNDS):
        sums = _summed(blocks, _moved(spark.sparkContext.broadcast(centres)))
        new = np.where(sums.any(1, keepdims=True), _whole(sums), centres)
        if (new == centres).all():
            break
        centres = new
    return centres


def _keyed(weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                points, first, second = draws(part.column("text"), weight.value)
                size = np.diff(string_bytes(part.column("text"))[1]) + 16
                keys = [pa.array([x.tobytes() for x in points], pa.binary()), pa.array(first), pa.array(second), pa.array(size)]
                yield pa.RecordBatch.from_arrays([*part.columns, *keys], names=[*part.schema.names, "point", "first", "second", "bytes"])

    return run


def _topics(centres):
    """Rows with their topic in place of their point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = pa.array(nearest(_points(batch), centres.value))
            rest = batch.drop_columns(["point"])
            yield pa.RecordBatch.from_arrays([topic, *rest.columns], names=["topic", *rest.schema.names])

    return run


KEY = ("topic", "first", "second", "row")


def _begins(before, shard_bytes: int):
    """The key of the first row of each shard but the first, from rows in order. ``before``:
    for each part the bytes in front of it and the shard of the row before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = None
        for batch in batches:
            if batch.num_rows:
                if at is None:
                    at, last = before.value[batch.column("part")[0].as_py()]
                stop = at + np.cumsum(batch.column("bytes").to_numpy())
                shard = np.concatenate([[at], stop[:-1]]) // shard_bytes
                new = np.flatnonzero(np.diff(shard, prepend=last))
                at, last = int(stop[-1]), int(shard[-1])
                yield batch.select(KEY).take(pa.array(new))

    return run


def _dealt(centres, begins):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begins.value
        for batch in _topics(centres)(batches):
            own = np.empty(batch.num_rows, known.dtype)
            for c in KEY:
                own[c] = batch.column(c).to_numpy()
            shard = np.searchsorted(known, own, "right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text", "row")), pa.array(shard.astype(np.int64))], names=["id", "text", "row", "shard"])

    return run


def deal(d: DataFrame, shard_bytes: int) -> DataFrame:
    """Adds ``shard`` to the rows (id, text, row)."""
    spark, kind = d.sparkSession, d.schema["id"].dataType.simpleString()
    sums = _summed(d.select("text"), _sized)
    total, count = sums[-1][:2].tolist() if len(sums) else (0, 0)  # no task: no rows
    if total <= shard_bytes:
        return d.withColumn("shard", F.lit(0).cast("long"))
    weight = spark.sparkContext.broadcast(weights(sums[:-1].reshape(-1), count))
    keyed = cut_table(d.mapInArrow(_keyed(weight), f"id {kind}, text string, row long, point binary, first double, second double, bytes long"))
    centres = spark.sparkContext.broadcast(fit_topics(keyed.select("row", "point")))
    narrow = keyed.select("point", *KEY[1:], "bytes")
    # Written, as Spark reads a table twice to deal it by range.
    narrow = cut_table(narrow.mapInArrow(_topics(centres), "topic int, first double, second double, row long, bytes long"))
    narrow = narrow.repartitionByRange(max(1, -(-count // NARROW_ROWS)), *KEY).sortWithinPartitions(*KEY)
    narrow = cut(narrow.withColumn("part", F.spark_partition_id()))
    sizes = sorted(narrow.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max(F.struct(*KEY, "bytes")).alias("last")).collect())
    before, at, last = {}, 0, 0
    for r in sizes:
        before[r.part] = (at, last)
        at += r.bytes
        last = (at - r["last"]["bytes"]) // shard_bytes
    before = spark.sparkContext.broadcast(before)
    begins = narrow.mapInArrow(_begins(before, shard_bytes), "topic int, first double, second double, row long").collect()
    known = np.array(sorted(tuple(r[c] for c in KEY) for r in begins), dtype=[("topic", "i4"), ("first", "f8"), ("second", "f8"), ("row", "i8")])
    return keyed.drop("bytes").mapInArrow(_dealt(centres, spark.sparkContext.broadcast(known)), f"id {kind}, text string, row long, shard long")


_ENCODERS: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The worker's encoder, kept for its later tasks. A function that is sent to tasks must
    ask here: globals that it names itself are sent along and are new in each task."""
    if source not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[source] = Encoder(source)
    return _ENCODERS[source]


def _packer(source, id_type: pa.DataType, length: int):
    def run(t: pa.Table) -> pa.Table:
        # An order that doesn't depend on how the rows arrived.
        t = t.sort_by("row")
        texts = t.column("text").combine_chunks()
        ids, row, term, n_terms = encoder(source.value).ids(texts)
        index = Index(len(ids), row, term, int(n_terms))
        got = fill([len(x) for x in ids], index.scores, length)
        shard = t.column("shard")[0].as_py()
        doc = [p[0] for p in got]
        return pa.table({
            "id": t.column("id").take(pa.array(doc)).combine_chunks().cast(id_type),
            "start": pa.array([p[1] for p in got], pa.int64()),
            "length": pa.array([p[2] for p in got], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in got], pa.int64()),
            "doc_tokens": pa.array([len(ids[d]) for d in doc], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + p[3] for p in got], pa.int64()),
            "offset": pa.array([p[4] for p in got], pa.int64()),
        })

    return run


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer or tokenizer_file(), encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = deal(d.withColumn("row", F.monotonically_increasing_id()), shard_bytes)
    kind = d.schema["id"].dataType
    schema = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return d.groupBy("shard").applyInArrow(_packer(source, to_arrow_type(kind), length), schema).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
