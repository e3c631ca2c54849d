"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Pre-tokens are taken from every text with their positions. A task keeps a
   block of documents as a sequence of word numbers and sends each distinct
   word of the block once, to the part that its hash names.
2. A part sees each word of the corpus once, however often it occurs, encodes
   it, and answers every block that asked with the ids of its word numbers.
3. Blocks join their sequences with the answers and put ids in place by
   position.

Decoding joins ids with the token-byte table, which has the vocabulary's size
(fixed by the rank file) and so travels with the task.

The pattern is applied to each distinct piece of a block (a run of text between
spaces that no match can reach over), and the pieces' words are then dealt out to
all their places. The words of a block are taken twice, once for each side of
the join, so word numbers must not depend on the run: a block is a run of rows
of one input split, and numbers follow the order of the pieces' fingerprints.

Defined cases: null or empty text has no ids; a null id is kept as null;
repeated rows are encoded each; text with special-token strings is ordinary
text; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shuffle import bounded_batches, pack, parts_of, unpack
from .textcore import buffers, row_slices, word_hashes
from .vocab import nul_joined, piece_bounds, read_file

BLOCK_BYTES = 8 << 20
_NUL = "\x00"


def read_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}


class Block:
    """A run of rows as word numbers: ``seq`` one after another, ``count`` per
    row; ``words`` in the order of their numbers (0 is the separator)."""

    def __init__(self, name: int, docs: list, parts: list[tuple], joined, plain):
        self.name, self.docs = name, docs
        raw = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        start, end = (np.concatenate([p[k] + s for p, s in zip(parts, shift)]) for k in (1, 2))
        keys = word_hashes(raw, start, end)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        text = nul_joined(raw, start[first], end[first])
        n = len(first)
        if text.count(_NUL) <= max(0, n - 1):
            found, alone = joined(text) if n else [], {}
        else:                                                # a text holds NUL itself
            whole = [raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(start[first], end[first])]
            alone = {i: plain(t) for i, t in enumerate(whole) if _NUL in t}
            found = joined(_NUL.join(["" if i in alone else t for i, t in enumerate(whole)]))
        self.words = list(dict.fromkeys([_NUL, *found, *(w for x in alone.values() for w in x)]))
        number = dict(zip(self.words, range(len(self.words))))
        flat = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        cut = np.flatnonzero(flat == 0)
        size = np.diff(np.r_[-1, cut, len(flat)]) - 1 if n else np.zeros(0, np.int64)
        begin = np.r_[0, cut + 1][:n]
        for i, x in alone.items():
            begin[i], size[i] = len(flat), len(x)
            flat = np.r_[flat, [number[w] for w in x]]
        many = size[back]
        stop = np.cumsum(many)
        total = int(stop[-1]) if len(stop) else 0
        self.seq = flat.astype(np.uint32)[np.repeat(begin[back] - (stop - many), many) + np.arange(total)]
        of_row = np.r_[0, np.cumsum(np.concatenate([p[3] for p in parts]))]
        self.count = np.diff(np.r_[0, stop][of_row])


def matcher(pattern: str):
    """findall of the pattern with NUL a match of its own, and without; white
    space is the Unicode property (which is what the rank files' library means by \\s)."""
    import regex
    own = pattern.replace(r"[^\s", r"[^\x00\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(_NUL + "|" + own).findall, regex.compile(own.replace(r"[^\x00", "[^")).findall


def blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[Block]:
    joined, plain = matcher(pattern)
    name = TaskContext.get().partitionId() << 24
    docs, parts, size = [], [], 0
    for batch in batches:
        ids = batch.column("id").to_pylist()
        offsets, data = buffers(batch.column("text"))
        for a, b in row_slices(offsets, 2 << 20):
            part = offsets[a: b + 1]
            start, end, ptr = piece_bounds(part, data)
            docs += ids[a:b]
            parts.append((data[part[0]: part[-1]].copy(), start - part[0], end - part[0], np.diff(ptr)))
            size += int(part[-1] - part[0])
            if size >= BLOCK_BYTES:
                yield Block(name, docs, parts, joined, plain)
                name += 1
                docs, parts, size = [], [], 0
    if docs:
        yield Block(name, docs, parts, joined, plain)


def _word_rows(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """(part, block, words, numbers): the distinct words of each block, by part."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for block in blocks(batches, pattern):
            raw = [w.encode("utf-8") for w in block.words]
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in raw), np.int32, len(raw))
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(raw) else np.zeros(0, np.int64)
            rows = [order[i:j] for i, j in zip(cut, np.r_[cut[1:], len(raw)])]
            words = [pack([np.array([len(raw[k]) for k in at], np.uint32), np.frombuffer(b"".join([raw[k] for k in at]), np.uint8)]) for at in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order[cut]], pa.int32()), pa.array(np.full(len(rows), block.name), pa.int64()), pa.array(words, pa.binary()),
                 pa.array([pack([np.diff(at, prepend=0).astype(np.uint32)]) for at in rows], pa.binary())],
                names=["part", "block", "words", "numbers"])

    return docs.mapInArrow(task, "part int, block long, words binary, numbers binary")


ROW_SCHEMA = "block long, docs binary, numbers binary, counts binary, ids binary"


def _answers(words: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Each distinct word of a part encoded once; one answer per asking block."""
    def task(table: pa.Table) -> pa.Table:
        import tiktoken
        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        sizes, ids = [], []
        for blob in table.column("words").to_pylist():
            length, raw = unpack(blob)
            raw, at = raw.tobytes(), np.r_[0, np.cumsum(length.astype(np.int64))].tolist()
            size, got = [], []
            for i, j in zip(at[:-1], at[1:]):
                w = raw[i:j]
                t = known.get(w)
                if t is None:
                    t = known[w] = piece(w)
                size.append(len(t))
                got += t
            sizes.append(np.array(size, np.uint32))
            ids.append(np.array(got, np.uint32))
        n = len(table)
        return pa.table({"block": table.column("block"), "docs": pa.nulls(n, pa.binary()), "numbers": table.column("numbers"),
                         "counts": pa.array([pack([x]) for x in sizes], pa.binary()), "ids": pa.array([pack([x]) for x in ids], pa.binary())})

    return words.groupBy("part").applyInArrow(task, ROW_SCHEMA)


def _sequences(docs: DataFrame, pattern: str) -> DataFrame:
    """One row per block: its documents and their word numbers, frequent words
    first renumbered so that high bytes are mostly zero."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, pattern):
            seq = block.seq
            by_use = np.argsort(-np.bincount(seq, minlength=len(block.words)), kind="stable").astype(np.uint32)
            rank = np.empty(len(by_use), np.uint32)
            rank[by_use] = np.arange(len(by_use), dtype=np.uint32)
            mask = np.array([d is None for d in block.docs], np.uint8)
            doc = np.array([0 if d is None else d for d in block.docs], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name], pa.int64()), pa.array([pack([doc, mask])], pa.binary()), pa.array([pack([rank[seq], by_use])], pa.binary()),
                 pa.array([pack([block.count.astype(np.uint32)])], pa.binary()), pa.array([None], pa.binary())],
                names=["block", "docs", "numbers", "counts", "ids"])

    return docs.mapInArrow(task, ROW_SCHEMA)


def _placed(table: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
    """A block's document ids and the ids of each document, by position."""
    start, size, flat, at = [], [], [], 0
    doc = mask = seq = by_use = count = None
    for docs, numbers, counts, ids in zip(*(table.column(c).to_pylist() for c in ("docs", "numbers", "counts", "ids"))):
        if docs is not None:
            (doc, mask), (seq, by_use), (count,) = unpack(docs), unpack(numbers), unpack(counts)
        else:
            (number,), (length,), (got,) = unpack(numbers), unpack(counts), unpack(ids)
            length = length.astype(np.int64)
            start.append((np.cumsum(number.astype(np.int64)), at + np.cumsum(length) - length))
            size.append(length)
            flat.append(got)
            at += len(got)
    first, length = np.zeros(len(by_use), np.int64), np.zeros(len(by_use), np.int64)
    for (number, begin), many in zip(start, size):
        first[number], length[number] = begin, many
    flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    first, length = first[by_use], length[by_use]
    row = np.r_[0, np.cumsum(count.astype(np.int64))]
    return pa.array(doc, mask=mask.astype(bool)), [_gather(flat, first, length, seq[i:j]) for i, j in zip(row[:-1], row[1:])]


def _gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The lists at ``places``, one after another."""
    many = length[places]
    stop = np.cumsum(many)
    return flat[np.repeat(first[places] - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0)]


class TokenBytes:
    """The token-byte table: the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.first = np.cumsum(self.length) - self.length
        self.raw = np.zeros(int(self.length.sum()), np.uint8)
        for token, rank in ranks.items():
            self.raw[self.first[rank]: self.first[rank] + len(token)] = np.frombuffer(token, np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.raw, self.first, self.length, ids).tobytes()


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str):
    """Blocks with the answers to them, grouped by block."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    answers = _answers(_word_rows(rows, pattern, parts_of(docs.sparkSession)), ranks, pattern)
    return _sequences(rows, pattern).unionByName(answers).groupBy("block")


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    def task(table: pa.Table) -> pa.Table:
        doc, ids = _placed(table)
        return pa.table({"doc_id": doc, "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})

    return _encoded(docs, read_ranks(read_file(rank_path)), pattern, id_col, text_col).applyInArrow(task, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, rank_path: str) -> DataFrame:
    """``encoded`` with the bytes of its ids (column ``decoded``)."""
    ranks = read_ranks(read_file(rank_path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(ranks)
        for batch in batches:
            out = [table.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(task, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return digests of both per document: doc_id,
    n_tokens, ids_sha256, decoded_sha256. Ids and bytes stay in the task."""
    ranks = read_ranks(read_file(rank_path))

    def task(table: pa.Table) -> pa.Table:
        doc, ids = _placed(table)
        back = TokenBytes(ranks)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.table({"doc_id": doc, "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                         "ids_sha256": pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()),
                         "decoded_sha256": pa.array([sha(back.decode(x)) for x in ids], pa.string())})

    return _encoded(docs, ranks, pattern, id_col, text_col).applyInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokens
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return round_trip(docs, tokens.path("byte_bpe_multi_50k.tiktoken"), tokens.PATTERN)
