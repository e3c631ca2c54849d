"""Near-duplicate documents by a parity-sketch join on word shingles.

A document is its set of distinct 5-word shingles. Two sets with Jaccard
similarity of at least p / 100 differ in at most
``d = (100 - p)(a + b) / (100 + p)`` elements (a, b: their sizes).

* *Parity sketches*: every shingle is XORed into one of m cells, so a cell holds
  the XOR of its shingles' hashes, and the number of cells that differ is at
  most the symmetric difference. A second sketch keeps one parity bit per cell;
  its Hamming distance is the same kind of lower bound and needs no shuffle of
  shingles to reject a pair.
* *Pigeonhole per size band*: sets are joined within bands of sizes
  (2**(k-1), 2**k], a smaller set also in the next band where a partner may lie.
  All sets of a band use the same m > d cells, so similar sets agree on at least
  m - d cells. Under any one order of the cells, indexing the first d + 1 of them
  therefore finds every pair. The order puts cells with a rare shingle first,
  then cells with many shingles: a passage that a third of all documents share,
  and empty cells, come last. Shingle frequencies are counted over all documents
  in a table of fixed size (``SLOTS``); they steer the order only.
* *Verify*: candidates pass the size and Hamming bounds, then the exact count of
  common shingles.

No bucket is expanded into pairs. Equal sets are one class (one record per task
and cell). A bucket first links its members to its smallest member. Buckets
whose members are then still in several components return, in rounds, at most a
spanning forest of their untested pairs within the bounds, closest sketches
first; pairs that fail the exact test are not proposed again. After
``ROUNDS`` rounds what is left untested is tested as it is. Large buckets are
compared in tiles. So every link between components is found, while a group of
near copies costs a few tests per member.

Defined cases: null, empty or blank text has no shingles and links with nothing;
fewer than 5 words make one shingle of the whole sequence; a null id is the
smallest id and is returned as null; rows that share an id (or have none) are
documents of their own, linked only by their texts; repeated rows have equal sets
and link; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shuffle import NO_ID, by_part, documents, pack, parts_of, tidy, unpack, written
from .textcore import (CODES_LOWER, U64, buffers, mix, prefix, row_slices, span_hash, word_bounds, word_hashes)

SHINGLE = 5
PERCENT = 80
SLOTS = 1 << 20        # of the frequency table: one byte each
SMALL = 50_000         # rows of documents to verify that may be broadcast, 48 bytes each
ROUNDS = 1
_FLUSH = 1 << 18       # records, and sets remembered, that a task holds
_SLICE = 1 << 20       # bytes of text hashed at a time
_DOC, _PAIR, _BUCKET = 0, 1, 2
_FOUND_SCHEMA = "kind int, a long, b long, n long, s2 long, sketch binary, tag long"


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row pointer, distinct shingle hashes sorted within each row)."""
    offsets, data = buffers(texts)
    for a, b in row_slices(offsets, _SLICE):
        start, end, ptr = word_bounds(offsets[a: b + 1], data)
        pre = prefix(word_hashes(data, start, end, CODES_LOWER))
        n = np.diff(ptr)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        out = np.r_[0, np.cumsum(count)]
        first = np.repeat(ptr[:-1] - out[:-1], count) + np.arange(out[-1])
        h = span_hash(pre, first, first + np.repeat(np.minimum(n, k), count))
        for i, j in zip(out[:-1], out[1:]):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[out[:-1][count > 0]] = True
        total = np.r_[0, np.cumsum(new)]
        yield a, total[out], h[new]


def max_difference(a, b, percent: int):
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def segment(values: np.ndarray, ptr: np.ndarray, op) -> np.ndarray:
    """Reduce the slices under a row pointer; 0 for empty ones."""
    out = np.zeros(len(ptr) - 1, values.dtype)
    full = np.diff(ptr) > 0
    if full.any():
        out[full] = op.reduceat(values, ptr[:-1][full])
    return out


def set_identity(ptr: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set."""
    s1 = mix(segment(mix(h), ptr, np.add) + np.diff(ptr).astype(U64))
    s2 = mix(segment(mix(h + U64(0x51ED27)), ptr, np.add))
    return s1.view(np.int64), s2.view(np.int64)


def bit_sketches(ptr: np.ndarray, h: np.ndarray) -> list[bytes]:
    """One parity bit per cell, four times as many cells as the row's size band
    has elements (a power of two): larger sketches fold by XOR."""
    out = []
    for i, j in zip(ptr[:-1], ptr[1:]):
        bits = 4 << max(4, int(j - i - 1).bit_length() if j > i else 0)
        cell = (h[i:j] & U64(bits - 1)).astype(np.int64)
        parity = np.bincount(cell, minlength=bits).astype(np.uint8) & 1
        out.append(np.packbits(parity).tobytes())
    return out


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two sketches, the longer one folded to the shorter. Cells
    are numbered by low hash bits, so halves fold onto each other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    a = np.bitwise_xor.reduce(a.reshape(-1, n), axis=0)
    b = np.bitwise_xor.reduce(b.reshape(-1, n), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def cells(size: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, d) of sets of these sizes in these bands: cells of the sketch, and
    the most cells that may differ from a partner in the band."""
    top = np.int64(1) << band
    most = max_difference(top, top, percent)
    partner = np.minimum(top, 100 * size // percent)
    return np.maximum(most + 1, -(-9 * most // 5)), max_difference(size, partner, percent)


def band_keys(ptr: np.ndarray, h: np.ndarray, band: np.ndarray, rows: np.ndarray, percent: int, common: np.ndarray):
    """(row, key) of the indexed cells of ``rows``, sketched for ``band``."""
    size = np.diff(ptr)[rows]
    band = band[rows]
    m, d = cells(size, band, percent)
    go = d > 0                               # d = 0: only equal sets can link
    rows, size, band, m, d = rows[go], size[go], band[go], m[go], d[go]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    local = np.r_[0, np.cumsum(size)]
    pick = np.repeat(ptr[rows] - local[:-1], size) + np.arange(local[-1])
    x = h[pick]
    owner = np.repeat(np.arange(len(rows)), size)
    cell = ((x >> U64(32)) * np.repeat(m, size).astype(U64)) >> U64(32)
    new = np.ones(len(x), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    value = np.bitwise_xor.reduceat(mix(x), at)
    rarest = np.minimum.reduceat(common[(x & U64(SLOTS - 1)).astype(np.int64)], at)
    held = np.diff(np.r_[at, len(x)])
    owner, cell = owner[at], cell[at]
    key = cell_key(value, cell, held, band[owner], rarest)
    cut = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(rows)))]
    for i, j in zip(cut[:-1], cut[1:]):
        key[i:j].sort()
    rank = np.arange(len(key)) - cut[owner]
    keep = rank <= d[owner]
    out_row, out_key = [rows[owner[keep]]], [key[keep]]
    filled = np.diff(cut)
    for r in np.flatnonzero(filled <= d):    # too few cells hold anything: empty ones follow, by hash
        empty = np.setdiff1d(np.arange(m[r], dtype=U64), cell[cut[r]: cut[r + 1]])
        z = np.zeros(len(empty), np.int64)
        more = np.sort(cell_key(z.astype(U64), empty, z, z + band[r], z + 63))[: d[r] + 1 - filled[r]]
        out_row.append(np.full(len(more), rows[r]))
        out_key.append(more)
    return np.concatenate(out_row), np.concatenate(out_key)


def cell_key(value, cell, held, band, rarest) -> np.ndarray:
    """Key of a cell's content, in indexing order: rare content first, then many shingles."""
    g = mix(value + cell.astype(U64) * U64(0x9E3779B97F4A7C15) + band.astype(U64) * U64(0xD1B54A32D192ED03))
    many = U64(31) - np.minimum(held, 31).astype(U64)
    return (np.minimum(rarest, 63).astype(U64) << U64(58)) | (many << U64(53)) | (g >> U64(11))


def index_keys(ptr: np.ndarray, h: np.ndarray, rows: np.ndarray, percent: int, common: np.ndarray):
    """(row, key) of ``rows`` in their own band and, near its top, in the next."""
    size = np.diff(ptr)
    band = np.array([max(0, int(n - 1).bit_length()) if n > 0 else 0 for n in size], np.int64)
    r1, k1 = band_keys(ptr, h, band, rows[size[rows] > 0], percent, common)
    upper = rows[(size[rows] > 0) & (100 * size[rows] // percent > (np.int64(1) << band[rows]))]
    r2, k2 = band_keys(ptr, h, band + 1, upper, percent, common)
    return np.r_[r1, r2], mix(np.r_[k1, k2])


def _found_table(kind: int, **columns) -> pa.Table:
    size = len(next(iter(columns.values())))
    got = {"kind": np.full(size, kind, np.int32), **columns}
    return pa.table([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(size, f.type) for f in _FOUND], schema=_FOUND)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
                    ("s2", pa.int64()), ("sketch", pa.binary()), ("tag", pa.int64())])


def _buckets(key: np.ndarray, sid: np.ndarray):
    """Of (key, set) records: the smallest set of each key, and what links a
    key's further sets to it: star pairs and (key, members) lists."""
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[fresh], sid[fresh]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(key)])
    head = np.repeat(sid[at], size)
    pair = np.unique(np.stack([head, sid], 1)[head != sid], axis=0)
    several = np.flatnonzero(size > 1)
    found = []
    if len(pair):
        found.append(_found_table(_PAIR, a=pair[:, 0], b=pair[:, 1]))
        found.append(_found_table(_BUCKET, a=key[at[several]].view(np.int64), n=size[several],
                                  sketch=[sid[at[g]: at[g] + size[g]].tobytes() for g in several]))
    return key[at], sid[at], found


def _sealed(tables: list[pa.Table]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _FOUND, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for t in tables:
            out.write_table(t)
    return sink.getvalue().to_pybytes()


def shingle_frequency(docs: DataFrame) -> np.ndarray:
    """How common each slot of shingles is over all documents, one byte a slot:
    0 up to the mean load, then its binary logarithm. Fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, h in shingle_sets(batch.column("text")):
                total += np.bincount((h & U64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        step = SLOTS // _SLICES
        parts = [(k, total[k * step: (k + 1) * step]) for k in range(_SLICES)]
        parts = [(k, pack([t.astype(np.uint32 if t.max() < 2**32 else np.int64)])) for k, t in parts if t.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(b)[0].astype(np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([pack([total])], pa.binary())})

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(tidy(count), schema).groupBy("slice").applyInArrow(add, schema).collect()
    total = np.zeros(SLOTS, np.int64)
    for r in rows:
        total[r["slice"] * (SLOTS // _SLICES):][: SLOTS // _SLICES] = unpack(r["counts"])[0]
    load = max(1.0, total.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(total, 1) / load))).astype(np.uint8)


_SLICES = 64


def _sketch_blocks(docs: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (part, keys, found): packed (cell key, set) records, one per key and
    task, and what a task already knows (its documents, its own buckets)."""
    parts = parts_of(docs.sparkSession)

    def rows(part, keys, found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
                                          names=["part", "keys", "found"])

    def emit(held) -> Iterator[pa.RecordBatch]:
        key, sid, found = _buckets(*(np.concatenate(c) for c in zip(*held)))
        if found:
            yield rows([int(key[0] % U64(parts))], [None], [_sealed(found)])
        part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)  # keys are sorted, so are parts
        _, which, at = by_part(part)
        blobs = [pack([np.diff(key[i:j], prepend=U64(0)), sid[i:j]]) for i, j in zip(at[:-1], at[1:])]
        yield rows(which, blobs, [None] * len(blobs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            did, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
            for a, ptr, h in shingle_sets(batch.column("text")):
                n = np.diff(ptr)
                s1, s2 = set_identity(ptr, h)
                fresh = np.array([not (x in seen or seen.add(x)) for x in s1.tolist()], bool)
                if len(seen) > _FLUSH:
                    seen.clear()
                row, key = index_keys(ptr, h, np.flatnonzero(fresh), percent, common)
                held.append((key, s1[row]))
                count += len(key)
                yield rows([int(abs(int(s1[0])) % parts)], [None], [_sealed([_found_table(
                    _DOC, a=did[a: a + len(n)], b=s1, n=n, s2=s2, sketch=bit_sketches(ptr, h), tag=tag[a: a + len(n)])])])
                if count >= _FLUSH:
                    yield from emit(held)
                    held, count = [], 0
        if count:
            yield from emit(held)

    return docs.select("did", "tag", "text").mapInArrow(tidy(task), "part int, keys binary, found binary")


def _join_part(table: pa.Table) -> pa.Table:
    out = [_FOUND.empty_table()]
    for blob in table.column("found").to_pylist():
        if blob is not None:
            out.append(pa.ipc.open_stream(blob).read_all())
    held = [unpack(b) for b in table.column("keys").to_pylist() if b is not None]
    if held:
        out += _buckets(np.concatenate([np.cumsum(x[0], dtype=U64) for x in held]), np.concatenate([x[1] for x in held]))[2]
    return pa.concat_tables(out).combine_chunks()


def within_bounds(na, nb, x: bytes, y: bytes, percent: int) -> bool:
    """Size and Hamming bounds that every linked pair meets."""
    return (100 * min(na, nb) >= percent * max(na, nb)) and hamming(x, y) <= max_difference(na, nb, percent)


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b: set identities) that pass the bounds, as
    (ida, idb, na, nb)."""
    side = lambda k: classes.select(F.col("s1").alias(k), F.col("id").alias(f"id{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"x{k}"))
    joined = (pairs.join(side("a"), "a").join(side("b"), "b")
              .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb, x, y = (t.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))
            keep = pa.array([within_bounds(*r, percent) for r in zip(na, nb, x, y)], pa.bool_())
            yield t.select(["ida", "idb", "na", "nb"]).filter(keep)

    return joined.select("ida", "idb", "na", "nb", "xa", "xb").mapInArrow(tidy(task), "ida long, idb long, na long, nb long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs of classes, by the exact count of common
    shingles. The set of a class is read from its document (did, tag); a row that
    shares both but holds another set is told by the set's own fingerprints."""
    need = written(pairs.select(F.explode(F.array("ida", "idb")).alias("id")).distinct()
                   .join(classes.select("id", "did", "tag", "s1", "s2", "n"), "id"))
    few = need.limit(SMALL + 1).count() <= SMALL           # else whole texts move to their ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ptr, h in shingle_sets(batch.column("text")):
                size = len(ptr) - 1
                own = {c: batch.column(c).slice(a, size) for c in ("id", "s1", "s2", "n")}
                s1, s2 = set_identity(ptr, h)
                same = np.logical_and.reduce([own[c].to_numpy() == v for c, v in (("s1", s1), ("s2", s2), ("n", np.diff(ptr)))])
                sets = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([own["id"], sets], names=["id", "set"]).filter(pa.array(same))

    sets = written(docs.select("did", "tag", "text").join(F.broadcast(need) if few else need.hint("shuffle_hash"), ["did", "tag"])
                   .select("id", "s1", "s2", "n", "text").mapInArrow(tidy(task), "id long, set array<long>").dropDuplicates(["id"]))
    a = sets.select(F.col("id").alias("ida"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("idb"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "ida").join(b, "idb").withColumn("c", common)
            .filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent)
            .select(F.col("ida").alias("a"), F.col("idb").alias("b")))


_TILE_ROWS = 2048


def _explode_members(buckets: DataFrame) -> DataFrame:
    """(bucket, s1) of each list."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.column("n").to_numpy(zero_copy_only=False)
            raw = b"".join(t.column("sketch").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(t.column("a").to_numpy(zero_copy_only=False), n)), pa.array(np.frombuffer(raw, np.int64))], names=["bucket", "s1"])

    return buckets.select("a", "n", "sketch").mapInArrow(task, "bucket long, s1 long").distinct()


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (bucket, id) of the buckets that lie in several components, with
    label and bucket size; of buckets with equal members one stays."""
    rows = members.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    h = F.xxhash64("id")
    open_ = (rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"),
                                        F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
             .filter("lo <> hi").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")))
    return rows.join(open_.select("bucket", "size"), "bucket")


def spanning(label, n, sketches: list[bytes], failed: list, ids, percent: int, everything: bool) -> list[tuple[int, int]]:
    """Index pairs of one bucket that lie in different components, meet the
    bounds and have not failed: all of them, or a spanning forest of them."""
    k = len(ids)
    width = min(map(len, sketches))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in sketches])
    folded = folded.view(np.uint64) if width % 8 == 0 else folded
    label, n = np.asarray(label), np.asarray(n)
    place = {v: i for i, v in enumerate(ids)}
    bad = {(i, place[v]) for i, row in enumerate(failed) if row for v in row if v in place}
    rows, cols, dist = [], [], []
    for i in range(k - 1):
        j = np.flatnonzero((label[i + 1:] != label[i]) & (100 * np.minimum(n[i], n[i + 1:]) >= percent * np.maximum(n[i], n[i + 1:]))) + i + 1
        if not len(j):
            continue
        d = np.bitwise_count(folded[j] ^ folded[i]).sum(1, dtype=np.int64)
        ok = d <= max_difference(n[i], n[j], percent)
        j, d = j[ok], d[ok]
        if len(sketches[i]) != width:        # the fold loses resolution: decide on the finer sketches
            fine = np.array([hamming(sketches[i], sketches[c]) if len(sketches[c]) != width else e for c, e in zip(j, d)], np.int64)
            ok = fine <= max_difference(n[i], n[j], percent)
            j, d = j[ok], fine[ok]
        if bad:
            ok = np.array([(i, c) not in bad and (c, i) not in bad for c in j.tolist()], bool)
            j, d = j[ok], d[ok]
        if not everything and len(j):        # of each component the closest is enough for a forest
            order = np.lexsort((d, label[j]))
            first = np.ones(len(j), bool)
            first[1:] = label[j[order]][1:] != label[j[order]][:-1]
            j, d = j[order[first]], d[order[first]]
        rows.append(np.full(len(j), i))
        cols.append(j)
        dist.append(d)
    if not rows:
        return []
    rows, cols, dist = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    if everything:
        return list(zip(rows.tolist(), cols.tolist()))
    root: dict = {}

    def find(v):
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    out = []
    for e in np.argsort(dist, kind="stable").tolist():
        a, b = find(int(label[rows[e]])), find(int(label[cols[e]]))
        if a != b:
            root[a] = b
            out.append((int(rows[e]), int(cols[e])))
    return out


def _proposed(members: DataFrame, classes: DataFrame, failed: DataFrame, percent: int, everything: bool) -> DataFrame:
    """Untested pairs (ida, idb, na, nb) of open buckets (see ``spanning``). A
    large bucket is cut into tiles; every pair of tiles is a group of bounded size."""
    tiles = F.ceil(F.col("size") / _TILE_ROWS).cast("int")
    of = failed.select(F.col("ida").alias("id"), F.col("idb").alias("o")).unionByName(failed.select(F.col("idb").alias("id"), F.col("ida").alias("o")))
    dealt = (members.join(classes.select("id", "n", "sketch"), "id").join(of.groupBy("id").agg(F.collect_set("o").alias("failed")), "id", "left")
             .withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
             .withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows):
            ids, label, n, sketch, bad = zip(*rows)
            for i, j in spanning(label, n, sketch, bad, ids, percent, everything):
                a, b = sorted(((ids[i], n[i]), (ids[j], n[j])))
                yield a + b

        def emit(found):
            c = list(zip(*set(found))) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c[k], pa.int64()) for k in (0, 2, 1, 3)], names=["ida", "idb", "na", "nb"])

        group, rows, found = None, [], []
        for t in batches:
            for bucket, ti, tj, *row in zip(*(t.column(c).to_pylist() for c in ("bucket", "ti", "tj", "id", "label", "n", "sketch", "failed"))):
                if (bucket, ti, tj) != group:
                    if len(rows) > 1:
                        found += pairs(rows)
                    group, rows = (bucket, ti, tj), []
                    if len(found) > 100_000:
                        yield emit(found)
                        found = []
                rows.append(tuple(row))
        if len(rows) > 1:
            found += pairs(rows)
        yield emit(found)

    return (dealt.select("bucket", "ti", "tj", "id", "label", "n", "sketch", "failed")
            .repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj")
            .mapInArrow(tidy(task), "ida long, idb long, na long, nb long").distinct())


def _failed(tried: DataFrame, links: DataFrame) -> DataFrame:
    pair = tried.select(F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb"))
    return pair.join(links.select(F.least("a", "b").alias("ida"), F.greatest("a", "b").alias("idb")), ["ida", "idb"], "left_anti")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of ``docs`` (did, tag, text): did, tag, n, and the smallest (did,
    tag) of its component and of the rows with an equal set. Classes of equal sets
    bear numbers of their own until the end, so ids may be null or shared."""
    common = shingle_frequency(docs)
    found = written(_sketch_blocks(docs, percent, common).groupBy("part").applyInArrow(_join_part, _FOUND_SCHEMA))
    of = lambda kind: found.filter(F.col("kind") == kind)
    doc = of(_DOC).select(F.col("a").alias("did"), "tag", F.col("b").alias("s1"), "s2", "n")
    name = F.struct("did", "tag")
    classes = (of(_DOC).filter("n > 0").groupBy(F.col("b").alias("s1"), "s2", "n")
               .agg(F.min(F.struct(F.col("a").alias("did"), "tag")).alias("name"), F.first("sketch").alias("sketch")))
    classes = written(classes.select("s1", "s2", "n", "name.did", "name.tag", "sketch", F.monotonically_increasing_id().alias("id")))
    tried = written(_bounded(of(_PAIR).select("a", "b").distinct(), classes, percent))
    links = written(_verified(docs, tried, classes, percent))
    label = components(links)
    members = written(_explode_members(of(_BUCKET)).join(classes.select("s1", "id"), "s1").select("bucket", "id"))
    failed = _failed(tried, links)
    for k in range(ROUNDS + 1):
        members = written(_labelled(members.select("bucket", "id"), label))
        tried = written(_proposed(members, classes, failed, percent, everything=k == ROUNDS))
        if tried.isEmpty():
            break
        fresh = written(_verified(docs, tried, classes, percent))
        links, failed = links.unionByName(fresh), written(failed.unionByName(_failed(tried, fresh)))
        label = components(links)
    placed = classes.select("s1", "s2", "n", "id", name.alias("equal")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = placed.groupBy("component").agg(F.min("equal").alias("first"))
    placed = placed.join(first, "component").select("s1", "s2", "n", "equal", "first")
    return (doc.filter("n > 0").join(placed, ["s1", "s2", "n"]).select("did", "tag", "n", "first", "equal")
            .unionByName(doc.filter("n = 0").select("did", "tag", "n", name.alias("first"), name.alias("equal"))))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, tag, text): tag tells rows apart that share an id but not a text."""
    return documents(docs, id_col, text_col).select("did", F.xxhash64("text").alias("tag"), "text")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable
    over links, itself included) and class_id (smallest id with an equal set)."""
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return _grouped(_identified(docs, id_col, text_col), percent).select(
        back("did").alias("doc_id"), F.col("n").alias("n_shingles"), back("first.did").alias("component_id"), back("equal.did").alias("class_id"))


def one_per_group(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of every component does:
    the smallest by id (a null id is the smallest), then by a hash of the text.
    Rows of equal id and text are one document, whatever their other columns."""
    keep = (_grouped(_identified(docs, id_col, text_col), percent)
            .filter((F.col("did") == F.col("first.did")) & (F.col("tag") == F.col("first.tag"))).select("did", "tag").distinct())
    text = F.col(text_col).cast("string")
    key = {"_vp_did": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_vp_tag": F.xxhash64(F.coalesce(text, F.lit(""))), "_vp_null": text.isNull()}
    return (docs.withColumns(key).join(keep.select(F.col("did").alias("_vp_did"), F.col("tag").alias("_vp_tag")), ["_vp_did", "_vp_tag"], "left_semi")
            .dropDuplicates(list(key)).select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
