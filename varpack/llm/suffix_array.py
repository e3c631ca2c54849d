"""Byte-level dedup of repeated strings in buckets of positions.

A byte string of ``size`` bytes repeats exactly where two positions agree that
far. The dealt method, bucket-pointer refinement of a suffix array, sorts buckets
on the bucket identifiers of later offsets; here content fingerprints stand in for
those identifiers, as equality needs no order and fingerprints no exchange of
ranks between rounds (the README says so too):

1. *Buckets*: a window of ``size`` bytes is filed under its smallest q-gram, so
   neighbouring positions share one bucket and travel as one run.
2. *Runs*: members of a bucket are compared by the fingerprint of their whole run.
   A bucket with one member, or with equal members only, is final.
3. *Windows*: members of buckets that split are compared once more, by the
   fingerprint of each window of ``size`` bytes.

Within a bucket of equal strings the first position in (document, offset) order
stays; every other one marks its bytes as removed.

Defined cases: null or empty text has no bytes and one row of zeros; a null id
sorts before all ids; a repeated row (same id, same text) is the same document
read twice and does not count as an earlier copy of itself; rows that share an
id but not a text are separate documents ordered by a text hash; other columns
are ignored by ``remove_repeats`` and kept by ``deduplicated_documents``. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Windows, marks_of, repeated_windows, spread_marks, with_marks
from .shuffle import documents, tidy
from .textcore import buffers

GRAM = 32


def _cut(docs: DataFrame, size: int, gram: int, whole: bool) -> DataFrame:
    """Per row of ``docs`` (see ``documents``): what is removed and what stays."""
    w = Windows("byte", size, min(gram, size), later=True)
    marks = repeated_windows(docs, docs.select("did", "tag", "text"), w)
    carried = ["row"] if whole else ["doc_id"]
    numbers = ["n_bytes", "n_removed", "n_spans"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ptr, pos, length = marks_of(batch)
            out = []
            for i in range(batch.num_rows):
                raw = data[offsets[i]: offsets[i + 1]]
                if ptr[i + 1] == ptr[i]:
                    out.append((len(raw), 0, 0, raw.tobytes()))
                    continue
                gone = spread_marks(pos[ptr[i]: ptr[i + 1]], length[ptr[i]: ptr[i + 1]] + size - 1, len(raw))
                out.append((len(raw), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), raw[~gone].tobytes()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], *[pa.array(c, pa.int64()) for c in cols[:3]],
                 pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]], pa.string()),
                 pa.array([x.decode("utf-8", "ignore") for x in cols[3]] if whole else [None] * len(cols[3]), pa.string())],
                names=[*carried, *numbers, "kept_sha256", "kept_text"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), *(f"{c} long" for c in numbers), "kept_sha256 string", "kept_text string"])
    return with_marks(docs, marks, "left").select(*carried, "text", "marks").mapInArrow(tidy(task), schema)


def remove_repeats(docs: DataFrame, size: int = 100, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return _cut(documents(docs, id_col, text_col), size, gram, whole=False).drop("kept_text")


def deduplicated_documents(docs: DataFrame, size: int = 100, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cut (bytes that are no longer whole characters at
    the cuts are dropped; a null text stays null); other columns as they are."""
    cut = _cut(documents(docs, id_col, text_col, whole=True), size, gram, whole=True)
    text = F.when(~F.col("row._vp_null"), F.col("kept_text"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return remove_repeats(docs)
