"""Benchmark decontamination by greedy string tiling.

Method. A document and a benchmark item that share a run of ``MIN_MATCH`` words (the seed)
are tiled: the longest common run of words not marked yet is marked on both sides, again
and again down to ``MIN_MATCH`` words. Longest runs are found by running Karp-Rabin: the
rolling hashes of all unmarked windows of one length on both sides are compared, and the
length is halved in on. Tiles may stand in any order, so reordered passages count. The item
is leaked by a document when its tiles cover ``COVERAGE`` of its words. Words are compared by
their Unicode case folding without punctuation at both ends, so a passage in capitals or
with changed punctuation is found; a word of punctuation only stands for itself. Words are
counted as they stand in the texts.

The join on seeds. Items are taken in blocks of about ``BLOCK_BYTES``; a block's sorted
seed hashes are broadcast and every document looks its own runs up, so documents are never
shuffled and a passage in a third of all documents is ordinary map work. A larger benchmark
means more blocks, each against all documents. The bound on a broadcast is the block's
size, which is checked when it is read; one item larger than that is a block of its own.

Null or empty texts match nothing; items of fewer than ``MIN_MATCH`` words hold no seed and
are not looked for. Equal items are each reported. Repeated rows and null ids are reported
row by row. Long texts are read whole. No documents or no items: no rows. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import mix, shingles, ship, slices, string_bytes, table, words

MIN_MATCH, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20
#: Bits of the table that is asked before the sorted seeds.
FIRST_BITS = 20

#: What is cut off at both ends of a word.
MARKS = string.punctuation + "".join(c for c in map(chr, range(128, 1 << 16)) if unicodedata.category(c)[0] == "P")
#: Bytes that folding leaves as they are.
_KEPT = np.zeros(256, bool)
_KEPT[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True

_B = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


def fold(word: str) -> str:
    """The form by which a word is compared."""
    low = word.casefold()
    return low.strip(MARKS) or low


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of the folded word) of every word of every text, in order."""
    data, _ = string_bytes(texts)
    row, start, end, h = words(texts)
    odd = np.concatenate([[0], np.cumsum(~_KEPT[data])])
    at = np.flatnonzero(odd[end] > odd[start])
    if len(at):
        _, first, of = np.unique(h[at], return_index=True, return_inverse=True)
        raw = data.tobytes()
        spans = zip(start[at[first]].tolist(), end[at[first]].tolist(), strict=True)
        folded = pa.array([fold(raw[a:b].decode("utf-8")) for a, b in spans], pa.large_string())
        h[at] = words(folded)[3][of]
    return row, h


def _windows(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``s`` words, by doubling."""
    n = len(h) - s + 1
    out, have, at, power, run = np.zeros(n, np.uint64), 0, 1, _B, h
    left = s
    while left:
        if left & 1:
            out = out * power + run[have : have + n]
            have += at
        left >>= 1
        if left:
            run = run[:-at] * power + run[at:]
            power = np.multiply(power, power, dtype=np.uint64, casting="unsafe")
            at *= 2
    return mix(out)


def tile(item: np.ndarray, doc: np.ndarray, piece: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, doc place, length) of two word-hash sequences; ``piece``
    numbers the stretches of ``doc``, which no tile crosses."""
    used_a, used_b = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []

    def free(used: np.ndarray, s: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(used)])
        return sums[s:] == sums[:-s]

    def common(s: int):
        if s > len(item) or s > len(doc):
            return None
        a = np.flatnonzero(free(used_a, s))
        b = np.flatnonzero(free(used_b, s) & (piece[: len(doc) - s + 1] == piece[s - 1 :]))
        if not len(a) or not len(b):
            return None
        ha, hb = _windows(item, s)[a], _windows(doc, s)[b]
        keep = np.isin(hb, ha)
        return (a, ha, b[keep], hb[keep]) if keep.any() else None

    top = min(len(item), len(doc))
    while top >= least and common(least):
        low, high = least, top
        while low < high:  # the longest length with a common unmarked window
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        a, ha, b, hb = common(low)
        places: dict[int, list[int]] = {}
        for x, y in zip(hb.tolist(), b.tolist(), strict=True):
            places.setdefault(x, []).append(y)
        next_of = dict.fromkeys(places, 0)
        for x, i in zip(ha.tolist(), a.tolist(), strict=True):
            if x not in places or used_a[i : i + low].any():
                continue
            spots, k = places[x], next_of[x]
            while k < len(spots) and used_b[spots[k] : spots[k] + low].any():
                k += 1
            next_of[x] = k
            if k < len(spots):
                j = spots[k]
                used_a[i : i + low] = used_b[j : j + low] = True
                tiles.append((i, j, low))
        top = low - 1 if low > least else 0
    return tiles


class Block:
    """The seeds of one block of items."""

    def __init__(self, ids: list, texts: list[str], least: int):
        row, h = folded_words(pa.array(texts, pa.large_string()))
        self.ids, self.least = ids, least
        ends = np.searchsorted(row, np.arange(len(ids) + 1))
        self.items = [h[ends[i] : ends[i + 1]] for i in range(len(ids))]
        at, seed = shingles(row, h, least)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[order], row[at][order], (at - ends[row[at]])[order]
        self.maybe = np.zeros(1 << FIRST_BITS, bool)
        self.maybe[self.seed >> np.uint64(64 - FIRST_BITS)] = True

    def leaks(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, matched words, item words, tiles) for each leak in some texts."""
        k = self.least
        row, h = folded_words(texts)
        at, x = shingles(row, h, k)
        keep = self.maybe[x >> np.uint64(64 - FIRST_BITS)]
        at, x = at[keep], x[keep]
        lo, hi = np.searchsorted(self.seed, x, "left"), np.searchsorted(self.seed, x, "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        for r in np.unique(row[at]):
            mine = slice(np.searchsorted(row[at], r), np.searchsorted(row[at], r, "right"))
            spots = at[mine]
            seen: dict[int, set[int]] = {}
            for a, b in set(zip(lo[mine].tolist(), hi[mine].tolist(), strict=True)):
                for e in range(a, b):
                    seen.setdefault(int(self.owner[e]), set()).add(int(self.place[e]))
            # Only words in seed windows can be tiled; a jump between them ends a piece.
            inside = np.unique((spots[:, None] + np.arange(k)).ravel())
            piece = np.cumsum(np.concatenate([[0], np.diff(inside) > 1]))
            for item, places in sorted(seen.items()):
                own = self.items[item]
                most = len({p + d for p in places for d in range(k)})
                if most < coverage * len(own):
                    continue
                tiles = tile(own, h[inside], piece, k)
                got = sum(t[2] for t in tiles)
                if got >= coverage * len(own):
                    yield int(r), item, got, len(own), len(tiles)


def _blocks(bench: DataFrame, least: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Block]:
    b = bench.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total, rows = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // block_bytes))
    for i in range(n if rows else 0):
        part = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else b
        got, ids, texts, size = sorted(part.collect(), key=lambda r: (r.item is None, r.item, r.text)), [], [], 0
        for r in got:  # an uneven block is cut again
            if texts and size + len(r.text) > block_bytes:
                yield Block(ids, texts, least)
                ids, texts, size = [], [], 0
            ids.append(r.item)
            texts.append(r.text)
            size += len(r.text)
        if texts:
            yield Block(ids, texts, least)


def _finder(block, coverage: float, id_types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            for part in slices(batch, "text"):
                got = list(known.leaks(part.column("text"), coverage))
                if not got:
                    continue
                row, item, hit, size, tiles = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array([known.ids[i] for i in item], id_types[1]), pa.array(hit, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(tiles, pa.int64()), pa.array([h / s for h, s in zip(hit, size, strict=True)], pa.float64())],
                    names=["id", "item", "matched_words", "item_words", "n_tiles", "coverage"],
                )

    return run


def find_leaks(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each (document, item) leak: ids, matched_words, item_words, n_tiles, coverage."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = d.schema["id"].dataType, bench.schema[item_col].dataType
    schema = f"id {kinds[0].simpleString()}, item {kinds[1].simpleString()}, matched_words long, item_words long, n_tiles long, coverage double"
    found = [
        d.mapInArrow(_finder(spark.sparkContext.broadcast(b), coverage, tuple(map(to_arrow_type, kinds))), schema)
        for b in _blocks(bench, min_match, block_bytes, item_col, item_text_col)
    ]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _dropper(block, coverage: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                bad = np.zeros(part.num_rows, bool)
                bad[[x[0] for x in block.value.leaks(part.column(text_col), coverage)]] = True
                yield part.filter(pa.array(~bad))

    return run


def drop_leaks(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    for b in _blocks(bench, min_match, block_bytes, item_col, item_text_col):
        docs = docs.mapInArrow(_dropper(spark.sparkContext.broadcast(b), coverage, text_col), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
