"""Spark helpers shared by the operators: document identity, written tables,
and packed shuffles.

A packed shuffle moves records as columnar, compressed blocks: a map task sorts
its records by destination part and emits one row (part, blob) per part, so a
billion 16-byte records do not become a billion JVM rows. Spark still does the
partitioning, the transfer, the retries and the grouping; the number of parts
follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to tasks in Arrow batches; a few thousand rows a batch
    keep the batches of long documents small beside an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy(task, keep_caches: bool = False):
    """An Arrow task that starts without the token caches which tasks of another
    operator may have left in this Python worker (unless it uses them), and gives
    freed memory back to the system when it ends: workers outlive tasks, and
    several share an executor's memory."""
    def run(batches):
        store = sys.modules.get("_varpack_worker_store")
        if store is not None and store.store and not keep_caches:
            store.store.clear()
            _trim()
        yield from task(batches)
        _trim()

    return run


def _trim() -> None:
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):   # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def parts_of(spark: SparkSession, factor: int = 4) -> int:
    """Parts of a packed shuffle: several per shuffle partition, so that hashing
    parts to partitions stays even."""
    return factor * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees. Only
    a session on one machine may leave the setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="varpack-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"varpack-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    a lineage cut that survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, did, tag, text): ``did`` orders documents (a null id comes
    first) and ``tag`` tells rows apart that share an id but not a text. With
    ``whole`` also ``row``, a struct of all columns but the text."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("_vp_null"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"),
        F.hash(text).alias("tag"), text.alias("text"), *([row.alias("row")] if whole else []))


def paired(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, right_slices: int = 1) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` (rows are blocks; names
    must differ), as an equi-join of tiles: ``left`` is dealt by ``left_key`` over
    slices, one per shuffle partition, and copied once per slice of ``right``;
    ``right`` likewise. No key holds more than one tile. Nothing is broadcast: the
    copies of a small side would not be small."""
    slices = max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_tile_a", deal(left_key, slices)).withColumn("_tile_b", every(right_slices))
    b = right.withColumn("_tile_b", deal(right_key, right_slices)).withColumn("_tile_a", every(slices))
    return a.join(b.hint("shuffle_hash"), ["_tile_a", "_tile_b"]).drop("_tile_a", "_tile_b")


# ---------------------------------------------------------------- packed blocks

_DELTA = np.int64


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as one blob. Integer columns that are sorted or
    nearly so should be passed as deltas by the caller."""
    c = zstandard.ZstdCompressor(level=1)
    out = []
    for a in columns:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b""
        z = c.compress(raw)
        head = np.array([len(a), len(z)], np.int64).tobytes() + a.dtype.str.encode().ljust(8)
        out.append(head + z)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    out, at = [], 0
    while at < len(blob):
        n, size = np.frombuffer(blob, np.int64, 2, at)
        kind = np.dtype(bytes(blob[at + 16: at + 24]).decode().strip())
        at += 24
        raw = d.decompress(bytes(blob[at: at + int(size)]), max_output_size=max(1, int(n) * kind.itemsize))
        at += int(size)
        a = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T if n else np.zeros((0, kind.itemsize), np.uint8)
        out.append(np.ascontiguousarray(a).view(kind).reshape(-1))
    return out


def by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of records by part, the parts that occur, and the bounds of
    each in that order."""
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    cut = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return order, sorted_part[cut], np.r_[cut, len(part)]
