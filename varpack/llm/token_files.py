"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of many documents in one array (16 bits an id where the
vocabulary allows, else 32) and the documents' boundaries as an Elias-Fano
sequence: of every offset the low bits are stored packed, the high bits in unary
in a bit vector, about 2 + log2(tokens / documents) bits a document. A sampled
select over the bit vector returns any offset without a table of 64-bit
offsets.

Files are rows of a table that Spark writes and reads (any store it can reach):
each range partition of the documents writes its files in ascending document
order, one file per ``file_tokens`` ids. A file knows the ids before it in its
partition; the totals of the partitions give the offset of each in the whole
array.

Defined cases: null or empty text is the end id alone; a null id sorts first and
is read back as null; repeated rows are separate documents, next to each other;
extra columns are ignored. An empty table writes an empty table of files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shuffle import NO_ID, bounded_batches, shared_folder, tidy
from .vocab import PieceEncoder, read_file

MAGIC = b"EFTOKEN1"
FILE_TOKENS = 4 << 20
_SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of offsets in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.int64)
        low = np.packbits(((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (v >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::_SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Place of the i-th one: the sample before it, then whole bytes."""
        at = int(self.samples[i // _SAMPLE])
        left = i % _SAMPLE
        byte = at >> 3
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (at & 7)) - 1)))  # ones of that byte before the sample
        while True:
            chunk = np.cumsum(np.bitwise_count(self.high[byte: byte + 64]).astype(np.int64))
            if chunk[-1] > left:
                k = int(np.searchsorted(chunk, left, "right"))
                left -= int(chunk[k - 1]) if k else 0
                bits = np.flatnonzero(np.unpackbits(self.high[byte + k: byte + k + 1], bitorder="little"))
                return (byte + k) * 8 + int(bits[left])
            left -= int(chunk[-1])
            byte += 64

    def __getitem__(self, i: int) -> int:
        high = self.select(i) - i
        bits = np.arange(i * self.low_bits, (i + 1) * self.low_bits)
        low = int(((self.low[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1) @ (1 << np.arange(self.low_bits))) if self.low_bits else 0
        return (high << self.low_bits) | low

    def values(self) -> np.ndarray:
        """All offsets at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        low = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return ((ones - np.arange(self.count)) << self.low_bits) + low @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def dump(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self.low), len(self.high), len(self.samples)], np.int64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, blob: memoryview) -> tuple["EliasFano", int]:
        count, bits, a, b, c = (int(x) for x in np.frombuffer(blob, np.int64, 5))
        at = 40
        low = np.frombuffer(blob, np.uint8, a, at)
        high = np.frombuffer(blob, np.uint8, b, at + a)
        samples = np.frombuffer(blob, np.uint32, c, at + a + b)
        return cls(count, bits, low, high, samples), at + a + b + 4 * c


def file_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    """Header, document ids, Elias-Fano boundaries, ids."""
    ends = EliasFano.of(np.r_[0, np.cumsum(lengths)].astype(np.int64)).dump()
    head = np.array([len(doc_ids), ids.dtype.itemsize, len(ends)], np.int64)
    return MAGIC + head.tobytes() + np.array(doc_ids, np.int64).tobytes() + ends + ids.tobytes()


def read_file_bytes(blob: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray]:
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n, width, size = (int(x) for x in np.frombuffer(blob, np.int64, 3, 8))
    at = 32 + 8 * n
    ends, _ = EliasFano.load(memoryview(blob)[at: at + size])
    return np.frombuffer(blob, np.int64, n, 32), ends, np.frombuffer(blob, f"<u{width}", -1, at + size)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, file_tokens: int = FILE_TOKENS,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as token files in ascending id order below ``path``."""
    bounded_batches(docs.sparkSession)
    definition = read_file(tokenizer_path)
    vocabulary = json.loads(definition)
    largest = max([end_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary["added_tokens"])])
    kind = np.dtype("<u2" if largest < 65536 else "<u4")
    end = np.uint32(end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(definition, spaced=False)
        part, file, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            blob = file_bytes(ids, lengths, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([before], pa.int64()),
                                               pa.array([size], pa.int64()), pa.array([blob], pa.large_binary()).cast(pa.binary())],
                                              names=["part", "file", "before", "tokens", "data"])

        for batch in batches:
            did = batch.column("did").to_pylist()
            for a, b, found, ptr in encoder.encode(batch.column("text")):
                for doc, i, j in zip(did[a:b], ptr[:-1].tolist(), ptr[1:].tolist()):
                    one = np.append(found[i:j], end).astype(kind)
                    ids.append(doc)
                    lengths.append(len(one))
                    held.append(one)
                    size += len(one)
                    if size >= file_tokens:
                        yield row()
                        file, before = file + 1, before + size
                        ids, lengths, held, size = [], [], [], 0
        if ids:
            yield row()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), text.alias("text"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (rows.repartitionByRange(parts, "did", F.xxhash64("text")).sortWithinPartitions("did", F.xxhash64("text"))
     .mapInArrow(tidy(task, keep_caches=True), "part int, file int, before long, tokens long, data binary")
     .write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32, and with ``with_ids`` the ids (32-bit)."""
    files = spark.read.parquet(path)
    total = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))   # one row per range partition
    base = total.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                start = batch.column("base")[r].as_py() + batch.column("before")[r].as_py()
                doc, ends, ids = read_file_bytes(batch.column("data")[r].as_py())
                at = ends.values()
                raw = [ids[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:])]
                cols = [pa.array(doc, mask=doc == NO_ID), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return files.join(F.broadcast(base), "part").select("base", "before", "data").mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    path = shared_folder(spark)
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
