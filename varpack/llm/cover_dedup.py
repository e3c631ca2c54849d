"""Substring dedup with difference-cover anchors (word level).

A difference cover D modulo v holds, for every two offsets, a common shift that
brings both into D. So if a window of ``size`` words occurs at positions i and
j, some k < v makes i + k and j + k both cover positions, and the windows of
``size - v + 1`` words there are equal. Hashing only those |D| / v of all
positions finds every long repeat:

1. hash the short windows at cover positions only, and keep the anchors whose
   hash occurs more than once in the corpus;
2. extend: the ``size``-word windows that reach over a kept anchor are compared
   exactly, first as whole runs, then singly where runs differ.

Every word under a window that starts more than once is removed, in all places.

Defined cases: null or blank text has no words; a text shorter than ``size``
loses nothing; a repeated row (same id, same text) counts as a second
occurrence, so both rows lose all their windows; null ids are allowed; extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import (MARKED, Windows, blocks, marks_of, repeated_windows, resolve, row_numbers, sequences,
                      spread_marks, with_marks)
from .shuffle import documents, tidy, written
from .textcore import U64, buffers, prefix, row_slices, window_hash, word_bounds

PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # differences give every residue modulo 21


def anchors(docs: DataFrame, size: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Marks of the anchors that occur more than once."""
    short = size - period + 1
    w = Windows("word", size, short, later=False)
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True

    def find(batch: pa.RecordBatch, w: Windows):
        for a, _, codes, ptr, _ in sequences(batch.column("text"), w):
            if len(codes) < size:
                continue
            hashes = window_hash(prefix(codes), short)
            row = row_numbers(ptr, np.arange(len(hashes)))
            pos = np.arange(len(hashes)) - ptr[row]
            n = np.diff(ptr)[row]
            at = np.flatnonzero(at_cover[pos % period] & (pos + short <= n) & (n >= size))
            yield row[at] + a, pos[at], np.ones(len(at), np.int64), hashes[at], np.zeros(len(at), U64)

    return resolve(blocks(docs.select("did", "tag", "text"), w, find, refined=False), w).filter(F.col("kind") == MARKED)


def repeated_word_windows(docs: DataFrame, size: int = 35, gram: int = 15) -> DataFrame:
    """Marks (did, tag, pos, len) of all ``size``-word windows that start more than once."""
    if size < PERIOD + 4:  # too short for this period: every window is a candidate
        return repeated_windows(docs, docs.select("did", "tag", "text"), Windows("word", size, max(1, size // 2), later=False))
    reach = PERIOD - 1
    kept = written(anchors(docs, size).select(
        "did", "tag", F.greatest(F.col("pos") - reach, F.lit(0)).alias("pos"),
        (F.least(F.col("pos"), F.lit(reach)) + 1).alias("len")))
    near = with_marks(docs, kept, "inner").select("did", "tag", "text", "marks")
    return repeated_windows(docs, near, Windows("word", size, min(gram, size), later=False))


def remove_repeated_passages(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept_text (the
    words that stay, joined by one space)."""
    docs = documents(docs, id_col, text_col)
    marks = repeated_word_windows(docs, size)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            mark_ptr, pos, length = marks_of(batch)
            for a, b in row_slices(offsets, 2 << 20):
                yield _kept(batch.slice(a, b - a), offsets[a: b + 1], data, mark_ptr[a: b + 1], pos, length, size)

    return with_marks(docs, marks, "left").mapInArrow(
        tidy(task), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _kept(batch, offsets, data, mark_ptr, pos, length, size) -> pa.RecordBatch:
    start, end, ptr = word_bounds(offsets, data)
    i, j = mark_ptr[0], mark_ptr[-1]
    row = np.repeat(np.arange(len(mark_ptr) - 1), np.diff(mark_ptr))
    begin = ptr[row] + pos[i:j]
    gone = spread_marks(begin, np.minimum(length[i:j] + size - 1, ptr[row + 1] - begin), len(start))
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = np.append(data[lo:hi], np.uint8(32))
    keep = np.flatnonzero(~gone)
    of_row = row_numbers(ptr, keep)
    last = np.ones(len(keep), bool)
    last[:-1] = of_row[1:] != of_row[:-1]
    diff = np.zeros(len(text) + 2, np.int8)
    first_byte, stop = start[keep] - lo, end[keep] - lo + ~last   # the byte after a word becomes its space
    np.add.at(diff, first_byte, 1)
    np.add.at(diff, stop, -1)
    mask = np.cumsum(diff[: len(text)], dtype=np.int8) > 0
    text[stop[~last] - 1] = 32   # a row's last word has no space: the byte after it may be the next row's
    total = np.r_[0, np.cumsum(gone)]
    counts, removed = np.diff(ptr), total[ptr[1:]] - total[ptr[:-1]]
    digest, kept = [], []
    for r in range(len(offsets) - 1):
        x, y = offsets[r] - lo, offsets[r + 1] - lo
        out = text[x:y][mask[x:y]].tobytes()
        digest.append(hashlib.sha256(out).hexdigest())
        kept.append(out.decode("utf-8", "replace"))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(digest, pa.string()), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
