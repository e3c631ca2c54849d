"""Finding repeated windows (n consecutive symbols) across a corpus.

Shared by the byte-level and the word-level substring dedup. Positions are cut
into *runs*: maximal stretches of window starts whose windows have the same
smallest q-gram, at the same place. Equal windows always fall into runs of the same bucket,
so a bucket that one run owns alone holds no repeat and is finished. The others
are refined with longer identifiers, first of the whole run, then of each
window, and only records that are still undecided travel on.

All grouping is done by Spark on (part, block) rows of a packed shuffle. A map
task first collapses equal records among its own rows, so a passage shared by a
third of all documents sends one record per task, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shuffle import by_part, pack, parts_of, tidy, unpack, written
from .textcore import (CODES, U64, buffers, mix, prefix, row_slices, sliding_min, span_hash,
                       window_hash, word_bounds, word_hashes)

BLOCK_SCHEMA = "part int, records binary, marks binary"
MARK_SCHEMA = "did long, tag int, kind int, pos int, len int"
MARKED, EXPAND = 0, 1
_HEAVY = 128       # identifiers of one bucket in one task from which on it is open at once
_MARKS = 1 << 9    # marks a row carries, where parts are enough
_FLUSH = 1 << 19   # records a map task holds before it collapses and emits them
_TILE = 1 << 20    # symbols hashed at a time
_PLACE = U64((1 << 28) - 1)  # low bits that hold a place while owners are sought


@dataclass(frozen=True)
class Windows:
    """unit: 'byte' or 'word'; size: symbols a window has; gram: symbols of the
    initial buckets; later: mark only windows that also start earlier (else
    every window that starts more than once)."""
    unit: str
    size: int
    gram: int
    later: bool


# ------------------------------------------------------------------ sequences

def sequences(texts: pa.Array, w: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, last row + 1, symbol codes, row pointer, first position):
    slices of the column as symbol sequences. A text longer than a slice comes
    in tiles that overlap by a window less one symbol."""
    offsets, data = buffers(texts)
    for a, b in row_slices(offsets, _TILE if w.unit == "byte" else 2 * _TILE):
        part = offsets[a: b + 1]
        if w.unit == "word":
            start, end, ptr = word_bounds(part, data)
            yield a, b, word_hashes(data, start, end), ptr, 0
        elif part[-1] - part[0] <= 2 * _TILE:
            yield a, b, CODES[data[part[0]: part[-1]]], part - part[0], 0
        else:
            n = int(part[-1] - part[0])
            for at in range(0, max(1, n - w.size + 1), _TILE):
                codes = CODES[data[part[0] + at: part[0] + min(n, at + _TILE + w.size - 1)]]
                yield a, b, codes, np.array([0, len(codes)]), at


def inside_rows(ptr: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which window starts keep their whole window inside one row."""
    cross = np.zeros(count + size + 1, np.int32)
    np.add.at(cross, np.maximum(ptr[1:] - size + 1, ptr[:-1]), 1)
    np.add.at(cross, ptr[1:], -1)
    return np.cumsum(cross[:count]) == 0


def spread_marks(pos: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of [pos, pos + length) over n places."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, np.clip(pos, 0, n), 1)
    np.add.at(diff, np.clip(pos + length, 0, n), -1)
    return np.cumsum(diff[:n]) > 0


def bucketed(codes: np.ndarray, ptr: np.ndarray, w: Windows, want: np.ndarray | None):
    """(prefix sums, q-gram identifiers, owner of every window start, usable
    starts). The owner is the place of the window's smallest q-gram, the
    leftmost one among equals, so equal windows have owners at equal offsets
    and no two windows of one owner are equal."""
    pre = prefix(codes)
    grams = window_hash(pre, w.gram)
    place = np.arange(len(grams), dtype=U64)
    owner = sliding_min((grams & ~_PLACE) | place, w.size - w.gram + 1) & _PLACE
    ok = inside_rows(ptr, len(owner), w.size)
    if want is not None:
        ok &= want[: len(ok)]
    return pre, grams, owner.astype(np.int64), ok


def runs(codes: np.ndarray, ptr: np.ndarray, w: Windows, want: np.ndarray | None = None):
    """(position, length, bucket, identifier) of each run of usable starts."""
    if len(codes) < w.size:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    pre, grams, owner, ok = bucketed(codes, ptr, w, want)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (owner[1:] != owner[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    return start, stop - start, mix(grams[owner[start]]), span_hash(pre, start, stop + (w.size - 1))


def single_windows(codes: np.ndarray, ptr: np.ndarray, w: Windows, want: np.ndarray):
    """(position, length 1, bucket, identifier) of each wanted window. Windows of
    one bucket stay together: their records pack to half the bytes that way."""
    if len(codes) < w.size:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    pre, grams, owner, ok = bucketed(codes, ptr, w, want)
    start = np.flatnonzero(ok)
    return start, np.ones(len(start), np.int64), mix(grams[owner[start]]), span_hash(pre, start, start + w.size)


# -------------------------------------------------------- records of a map task

FIELDS = (("key", np.uint64), ("sub", np.uint64), ("did", np.int64), ("tag", np.int32), ("pos", np.int32), ("len", np.int32))


class Collector:
    """Holds a map task's records, collapses equal ones and emits packed blocks.
    ``refined``: records of an open bucket are looked at again in a later round,
    so a heavy bucket need not be sent whole."""

    def __init__(self, later: bool, parts: int, refined: bool):
        self.later, self.parts, self.refined, self.held, self.n = later, parts, refined, [], 0

    def add(self, key, sub, did, tag, pos, length) -> Iterator[pa.RecordBatch]:
        self.held.append([np.asarray(a).astype(t) for a, (_, t) in zip((key, sub, did, tag, pos, length), FIELDS)])
        self.n += len(key)
        if self.n >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        r = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.n = [], 0
        r, first, count = grouped(r)
        several = np.repeat(count > 1, count)
        marked = later_than_first(r, first, count) if self.later else several
        keep = [a[first] for a in r] + [count > 1]
        known = [[a[marked] for a in r[2:]] + [np.full(int(marked.sum()), MARKED, np.int32)]]
        if self.refined:
            # a bucket of many identifiers is open whatever other tasks hold: two of
            # them tell the other tasks, the rest are expanded without being sent
            bucket = np.flatnonzero(np.r_[True, keep[0][1:] != keep[0][:-1]])
            subs = np.diff(np.r_[bucket, len(keep[0])])
            rank = np.arange(len(keep[0])) - np.repeat(bucket, subs)
            here = (np.repeat(subs, subs) >= _HEAVY) & (rank >= 2)
            known.append([a[here] for a in keep[2:6]] + [np.full(int(here.sum()), EXPAND, np.int32)])
            keep = [a[~here] for a in keep]
        # did, then position: neighbours differ little, so their deltas pack well
        part = ((keep[0] >> U64(32)) * U64(self.parts) >> U64(32)).astype(np.int32)
        order = np.lexsort((keep[4], keep[3], keep[2], part))
        keep, part = [a[order] for a in keep], part[order]
        _, which, bounds = by_part(part)
        blobs = [pack_records([a[i:j] for a in keep]) for i, j in zip(bounds[:-1], bounds[1:])]
        out_part, out_rec, out_mark = [int(p) for p in which], blobs, [None] * len(blobs)
        m = [np.concatenate(c) for c in zip(*known)]
        if len(m[0]):   # already decided here: dealt to parts in document order, to be passed on
            order = np.lexsort((m[2], m[1], m[0]))
            m = [a[order] for a in m]
            step = max(_MARKS, -(-len(m[0]) // self.parts))
            for k in range(0, len(m[0]), step):
                piece = [a[k: k + step] for a in m]
                out_part.append(int((abs(int(piece[0][0])) + 7919 * k) % self.parts))
                out_rec.append(None)
                out_mark.append(pack([np.diff(piece[0], prepend=0), *piece[1:]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_part, pa.int32()), pa.array(out_rec, pa.binary()), pa.array(out_mark, pa.binary())],
            names=["part", "records", "marks"])


def grouped(r: list[np.ndarray]):
    """Records sorted by (key, sub, document, position), the first of each
    (key, sub), and the sizes of those groups."""
    order = np.lexsort((r[4], r[3], r[2], r[1], r[0]))
    r = [a[order] for a in r]
    first = np.ones(len(r[0]), bool)
    first[1:] = (r[0][1:] != r[0][:-1]) | (r[1][1:] != r[1][:-1])
    return r, first, np.diff(np.r_[np.flatnonzero(first), len(first)])


def later_than_first(r: list[np.ndarray], first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Records at another place than the first of their group: a repeated row
    of one document is the same place."""
    at = np.flatnonzero(first)
    return np.logical_or.reduce([a != np.repeat(a[at], count) for a in r[2:5]])


def pack_records(r: list[np.ndarray]) -> bytes:
    key, sub, did, tag, pos, length, dup = r
    sub = sub if sub.any() else sub[:0]
    length = length if (length != 1).any() else length[:0]
    return pack([key.astype(np.uint32), sub, np.diff(did, prepend=0), tag, pos, length, dup])


def unpack_records(blob: bytes) -> list[np.ndarray]:
    key, sub, did, tag, pos, length, dup = unpack(blob)
    n = len(key)
    return [key.astype(U64), sub if len(sub) else np.zeros(n, U64), np.cumsum(did), tag, pos,
            length if len(length) else np.ones(n, np.int32), dup]


# ------------------------------------------------------------------- Spark jobs

def blocks(frame: DataFrame, w: Windows, find, refined: bool) -> DataFrame:
    """Packed blocks of the records that ``find(batch, w)`` yields as tuples
    (row numbers, position, length, bucket, identifier). Only a caller that looks
    at EXPAND rows again may set ``refined``."""
    parts = parts_of(frame.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collector(w.later, parts, refined)
        for batch in batches:
            did = batch.column("did").to_numpy(zero_copy_only=False)
            tag = batch.column("tag").to_numpy(zero_copy_only=False)
            for row, pos, length, key, sub in find(batch, w):
                yield from held.add(key, sub, did[row], tag[row], pos, length)
        yield from held.flush()

    return frame.mapInArrow(tidy(task), BLOCK_SCHEMA)


def resolve(packed: DataFrame, w: Windows) -> DataFrame:
    """Marks (did, tag, kind, pos, len): runs that are repeats, and runs of a
    bucket with several identifiers, to be expanded to single windows."""

    def task(table: pa.Table) -> pa.Table:
        out = [[np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int32)]]
        for blob in table.column("marks").to_pylist():
            if blob is not None:
                did, tag, pos, length, kind = unpack(blob)
                out.append([np.cumsum(did), tag, kind, pos, length])
        held = [unpack_records(b) for b in table.column("records").to_pylist() if b is not None]
        if held:
            r, first, count = grouped([np.concatenate(c) for c in zip(*held)])
            if w.later:
                repeat = later_than_first(r, first, count)
            else:
                some = np.logical_or.reduceat(r[6], np.flatnonzero(first)) | (count > 1)
                repeat = np.repeat(some, count)
            bucket = np.ones(len(first), bool)
            bucket[1:] = r[0][1:] != r[0][:-1]
            at = np.flatnonzero(bucket)
            subs = np.add.reduceat(first.astype(np.int64), at)
            open_ = first & np.repeat(subs > 1, np.diff(np.r_[at, len(first)]))
            for mask, kind in ((repeat, MARKED), (open_, EXPAND)):
                out.append([r[2][mask], r[3][mask], np.full(int(mask.sum()), kind, np.int32), r[4][mask], r[5][mask]])
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["did", "tag", "kind", "pos", "len"])

    return packed.groupBy("part").applyInArrow(task, MARK_SCHEMA)


def per_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("did", "tag").agg(F.collect_list(F.struct("pos", "len")).alias("marks"))


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents with their marks. The texts are hashed on the document once;
    Spark reuses that exchange for every such join in a plan."""
    return docs.join(per_document(marks).hint("shuffle_hash"), ["did", "tag"], how)


def marks_of(batch: pa.RecordBatch):
    """(row pointer, positions, lengths) of the list column ``marks``."""
    col = batch.column("marks")
    n = len(col)
    ptr = np.r_[0, np.cumsum(np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64))] if n else np.zeros(1, np.int64)
    flat = col.flatten()
    return ptr, flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def wanted(ptr, mark_ptr, pos, length, a: int, b: int, base: int, n: int) -> np.ndarray:
    """Cover of a slice's symbols by the marks of its rows a..b."""
    i, j = mark_ptr[a], mark_ptr[b]
    row = np.repeat(np.arange(b - a), np.diff(mark_ptr[a: b + 1]))
    begin = np.maximum(pos[i:j] - base, 0)
    stop = np.maximum(pos[i:j] + length[i:j] - base, 0)
    lo, hi = ptr[row], ptr[row + 1]
    begin, stop = np.minimum(lo + begin, hi), np.minimum(lo + stop, hi)
    return spread_marks(begin, stop - begin, n)


def row_numbers(ptr: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(ptr, at, "right") - 1


def find_runs(batch: pa.RecordBatch, w: Windows):
    """Runs of all windows, or only of the windows in ``marks`` where given."""
    have = "marks" in batch.schema.names
    if have:
        mark_ptr, mpos, mlen = marks_of(batch)
    for a, b, codes, ptr, base in sequences(batch.column("text"), w):
        want = wanted(ptr, mark_ptr, mpos, mlen, a, b, base, len(codes)) if have else None
        start, length, key, sub = runs(codes, ptr, w, want)
        row = row_numbers(ptr, start)
        yield row + a, start - ptr[row] + base, length, key, sub


def find_windows(batch: pa.RecordBatch, w: Windows):
    mark_ptr, mpos, mlen = marks_of(batch)
    for a, b, codes, ptr, base in sequences(batch.column("text"), w):
        want = wanted(ptr, mark_ptr, mpos, mlen, a, b, base, len(codes))
        start, length, key, sub = single_windows(codes, ptr, w, want)
        row = row_numbers(ptr, start)
        yield row + a, start - ptr[row] + base, length, key, sub


def repeated_windows(docs: DataFrame, runs_frame: DataFrame, w: Windows) -> DataFrame:
    """Marks of all repeated windows of ``docs`` (columns did, tag, text), from
    the frame whose runs are to be looked at (all rows, or rows with marks)."""
    first = written(resolve(blocks(runs_frame, w, find_runs, refined=True), w))
    again = with_marks(docs, first.filter(F.col("kind") == EXPAND), "inner")
    single = resolve(blocks(again, w, find_windows, refined=False), w)
    return (first.filter(F.col("kind") == MARKED).select("did", "tag", "pos", "len")
            .unionByName(single.filter(F.col("kind") == MARKED).select("did", "tag", "pos", "len")))
