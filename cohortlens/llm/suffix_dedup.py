"""Repeated passages by a sparse suffix array over words.

A word is repeated when it stands in a run of ``MIN_WORDS`` words that stands in at least
two documents. The result is every maximal stretch of repeated words: id, start_word,
end_word (exclusive), n_words.

Method. Only suffixes at content-selected positions are retained: the smallest hash of
``GRAM`` words in each window of ``WINDOW`` grams. Equal passages select equal positions,
and every run of ``MIN_WORDS`` words holds one in its first ``WINDOW``, so at least
``HEAD`` = MIN_WORDS - WINDOW + 1 words of the run follow it. Retained suffixes are grouped
by a 64-bit hash of their first ``HEAD`` words, and those of different documents in a group
are matches. Around each match every run of ``MIN_WORDS`` words that holds its position is
hashed and grouped in the same way; overlapping runs make a stretch. Nothing is sorted and
no match is extended word by word.

Null and empty texts and texts under ``MIN_WORDS`` words have no stretch. Passages that
repeat inside one document only are not reported; rows of equal id and text are one
document, each row is reported. Null ids are told apart by their texts. Long texts are
read whole. No rows: no rows. Columns other than the id and the text are not read.

Scale. One suffix in about twelve words is shuffled, as 20 bytes; comparison is a partial
minimum and maximum, so a passage in a third of all documents is one row a task, and the
join back is split by adaptive execution. Texts are shuffled once, those with a match go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import cut_table, mix, shingles, ship, slices, table, words

MIN_WORDS, GRAM, WINDOW = 50, 8, 24

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``at``."""
    x = np.zeros(len(at), np.uint64)
    for j in range(size):
        x = x * _BASE + h[at + j]
    return mix(x)


def chosen(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of grams: the place of its smallest, the first of equals."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Sparse-table minimum: two overlapping powers of two cover a window.
    best, at, size = grams.copy(), np.arange(len(grams)), 1
    while size * 2 <= window:
        right = best[size:] < best[: len(best) - size]
        best, at = np.where(right, best[size:], best[: len(best) - size]), np.where(right, at[size:], at[: len(at) - size])
        size *= 2
    a, b = best[:n], best[window - size : window - size + n]
    return np.where(b < a, at[window - size : window - size + n], at[:n])


def _by_doc(texts: pa.Array, gram: int, window: int, least: int):
    """For each text with a run: (row, first word, word hashes, chosen place of each run)."""
    row, _, _, h = words(texts)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    at, g = shingles(row, h, gram)
    g_ends = np.searchsorted(row[at], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        n = ends[i + 1] - ends[i]
        if n >= least:
            runs = n - least + 1
            yield i, h[ends[i] : ends[i + 1]], chosen(g[g_ends[i] : g_ends[i + 1]], window)[:runs]


def _suffixes(gram: int, window: int, least: int):
    head = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names = np.array(part.column("doc").to_numpy(zero_copy_only=False), dtype=np.int64)
                doc, pos, key = [], [], []
                for i, h, place in _by_doc(part.column("text"), gram, window, least):
                    p = np.unique(place)
                    doc.append(np.full(len(p), names[i]))
                    pos.append(p)
                    key.append(run_hashes(h, p, head))
                if doc:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32))],
                        names=["key", "doc", "pos"],
                    )

    return run


def _runs(gram: int, window: int, least: int):
    """The runs around the matched positions of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names = np.array(part.column("doc").to_numpy(zero_copy_only=False), dtype=np.int64)
                matched = part.column("places").to_pylist()
                doc, pos, key = [], [], []
                for i, h, place in _by_doc(part.column("text"), gram, window, least):
                    p = np.flatnonzero(np.isin(place, matched[i]))
                    doc.append(np.full(len(p), names[i]))
                    pos.append(p)
                    key.append(run_hashes(h, p, least))
                if doc:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32))],
                        names=["key", "doc", "pos"],
                    )

    return run


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, a, b = [], [], []
            for d, places in zip(batch.column("doc").to_pylist(), batch.column("places").to_pylist(), strict=True):
                p = np.unique(np.array(places, dtype=np.int64))
                breaks = np.flatnonzero(np.diff(p) > least)
                first, last = p[np.concatenate([[0], breaks + 1])], p[np.concatenate([breaks, [len(p) - 1]])]
                doc += [d] * len(first)
                a += first.tolist()
                b += (last + least).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc", "start_word", "end_word"])

    return run


def _matches(rows: DataFrame) -> DataFrame:
    """(doc, places): the rows whose key stands in more than one document, by document."""
    two = rows.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key")
    return rows.join(two, "key", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("places"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start_word, end_word, n_words of every stretch of repeated words."""
    if window + gram - 1 > min_words:
        raise ValueError("a run must hold a whole window of grams")
    ship(docs.sparkSession)
    name = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = docs.select(name.alias("doc"), F.col(text_col).alias("text"))
    kind = "key long, doc long, pos int"
    suffixes = cut_table(texts.mapInArrow(_suffixes(gram, window, min_words), kind))
    met = texts.join(_matches(suffixes), "doc")
    runs = cut_table(met.mapInArrow(_runs(gram, window, min_words), kind))
    spans = _matches(runs).mapInArrow(_merge(min_words), "doc long, start_word long, end_word long")
    ids = docs.select(F.col(id_col).alias("id"), name.alias("doc"))
    out = ids.join(spans, "doc").withColumn("n_words", F.col("end_word") - F.col("start_word"))
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", "n_words")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
