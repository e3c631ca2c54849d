"""Harmonic packing of token sequences.

A bin holds ``capacity`` tokens. Piece lengths fall into reciprocal-capacity
classes: class j holds lengths in (capacity / (j + 1), capacity / j], and a bin
of class j takes exactly j pieces. Documents may be cut, so lengths are cut to
the classes' upper ends where nothing is wasted: as many whole bins as fit, then
the binary digits of the rest, each a power of two and so a class that fills its
bins without a gap. Bins of a class are filled with their fixed count by every
task on its own; nothing is shuffled. A task's last, partly filled bin of a class
is split by the binary digits of its piece count, so it too is a power of two
long and needs no padding.

Defined cases: null or empty text is the end id alone; a null id is kept as
null; repeated rows are packed like any others; extra columns are ignored. An
empty table gives an empty result. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shuffle import bounded_batches, tidy
from .vocab import PieceEncoder, read_file

CAPACITY = 1024
_TASK_IDS = 1 << 36   # sequence ids of one task


def cut(length: int, capacity: int) -> list[int]:
    """Piece lengths of a document: whole bins, then powers of two."""
    rest = length % capacity
    return [capacity] * (length // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Bins:
    """Open bins of one task: per class, the pieces of the bin being filled."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def add(self, size: int, piece) -> Iterator[tuple]:
        """Yields (piece, sequence id, offset) of the bin that this piece fills."""
        held = self.open.setdefault(self.capacity // size, [])
        held.append((size, piece))
        if len(held) == self.capacity // size:
            yield from self._close(held)
            held.clear()

    def _close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for size, piece in held:
            yield piece, self.next_id, offset
            offset += size
        self.next_id += 1

    def rest(self) -> Iterator[tuple]:
        for _, held in sorted(self.open.items()):
            at = 0
            for n in cut(len(held), self.capacity):
                yield from self._close(held[at: at + n])
                at += n


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids (little-endian unsigned 32-bit)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    definition = read_file(tokenizer_path)
    end = np.uint32(end_id)
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(definition, spaced=True, pieces=600_000, words=300_000)   # beside earlier stages' memory
        bins = Bins(capacity, TaskContext.get().partitionId() * _TASK_IDS)
        done: list[tuple] = []

        def placed() -> pa.RecordBatch:
            cols = list(zip(*[(*p[:5], s, o, *p[5:]) for p, s, o in done])) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            ids_of = batch.column("id").to_pylist()
            for a, b, ids, ptr in encoder.encode(batch.column("text")):
                for doc, i, j in zip(ids_of[a:b], ptr[:-1].tolist(), ptr[1:].tolist()):
                    raw = np.append(ids[i:j], end).astype("<u4").tobytes()
                    total, at = len(raw) // 4, 0
                    for n in cut(total, capacity):
                        part = raw[4 * at: 4 * (at + n)]
                        done.extend(bins.add(n, (doc, at, n, zlib.crc32(part), total, part) if with_ids else (doc, at, n, zlib.crc32(part), total)))
                        at += n
                if len(done) > 50_000:
                    yield placed()
                    done.clear()
        done.extend(bins.rest())
        yield placed()

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .mapInArrow(tidy(task, keep_caches=True), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
