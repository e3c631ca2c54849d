"""Ranked lexical search by branch and bound over document FP-trees.

One pass over the documents counts terms and keeps, of every document, the vector
(term, tf) restricted to terms that may occur in an item, in blocks of documents
with their shared terms and document counts. Sums over the blocks give the
collection's counts and the weights. Each block of documents then meets each block
of items: the documents' vectors, terms in order of frequency, share the paths of
a trie; a node knows the largest tf of every term and the smallest m below it, and
so a bound of every item's score there. The trie is searched depth first, best
bounds first, and a subtree is left out for the items whose 10th best score so far
it cannot reach. Leaves are scored exactly; a task keeps the best rows per item,
and a last ranking merges those.

Terms are filtered by a bitmap of the items' terms of fixed size (1 MB), so nothing
that is sent to all tasks grows with documents or items; what the filter passes by
chance is dropped when the blocks meet. Blocks meet in tiles: documents are dealt
over slices, and items over slices of their own; only items are copied to each
slice of documents while they fit one slice of their own.

Defined cases: a null text has no terms, such documents don't count; repeated rows
and rows that share an id are documents of their own; a null doc_id sorts first;
equal rows of the items are one item, rows that share an item_id but not a text are
items of their own; items without terms, or without a document that scores, have no
rows; extra columns are ignored. Empty tables give an empty result. Very long texts
are cut into terms piece by piece.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shuffle import NO_ID, bounded_batches, pack, paired, tidy, unpack, written

K = 10
DOCS, ENTRIES = 1024, 1 << 18          # bounds of a block of documents
ITEMS = 256                            # items of a block, on average
LEAF = 16                              # documents of a leaf
BITS = 1 << 23                         # bits of the filter
HELD = 8                               # item blocks whose best rows a task holds at once
_KNOWN, _PIECE = 1 << 20, 1 << 22

# Bytes of a term stay, A-Z as a-z; all others are spaces.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a piece of it at a time."""
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and _CLEAN[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_CLEAN).split()
        at = end


# ------------------------------------------------------------------ restricted vectors

class _Filter(dict):
    """Number of a term within a task, or -1 if no item can hold it."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap, self.names = bitmap, []

    def __missing__(self, term: bytes) -> int:
        bit = zlib.crc32(term) % BITS
        found = -1
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            found = len(self.names)
            self.names.append(term)
        self[term] = found
        return found


def _bitmap(items: DataFrame) -> bytes:
    """The filter's bits, from (term) rows."""
    size = 1 << 16                                  # bits of a row

    def chunk(rows: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        at = rows.column("bit").to_numpy()
        bits[at % size] = 1
        return pa.table({"part": pa.array([int(at[0]) // size], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = (items.select((F.crc32("term") % BITS).alias("bit")).distinct().groupBy(F.expr(f"bit div {size}"))
            .applyInArrow(chunk, "part long, bits binary").collect())          # at most BITS / 8 bytes
    out = bytearray(BITS // 8)
    for r in rows:
        out[r.part * size // 8:(r.part + 1) * size // 8] = r.bits
    return bytes(out)


_BLOCKS = "docs long, words long, terms array<binary>, df array<long>, vectors binary"


def _vectors(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """Blocks of documents: counts over all of them, and of those with wanted
    terms the id, number of terms and (term, tf) pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(shared.value)
        state = {"docs": 0, "words": 0}
        ids, sizes, lengths, number, tf = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            used, local = np.unique(np.array(number, np.int64), return_inverse=True)
            blob = pack([np.array(ids, np.int64), np.array(sizes, np.int64), np.array(lengths, np.int32), local.astype(np.int32), np.array(tf, np.int32)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([state["docs"]], pa.int64()), pa.array([state["words"]], pa.int64()),
                 pa.array([[known.names[i] for i in used.tolist()]], pa.list_(pa.binary())),
                 pa.array([np.bincount(local, minlength=len(used)).tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["docs", "words", "terms", "df", "vectors"])
            state.update(docs=0, words=0)
            for x in (ids, sizes, lengths, number, tf):
                x.clear()
            if len(known) > _KNOWN:
                known.clear()
                known.names.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                count: Counter = Counter()
                for some in terms(text.as_py() or b""):
                    count.update(some)
                n = count.total()
                if not n:
                    continue
                state["docs"] += 1
                state["words"] += n
                found = [(known[t], c) for t, c in count.items()]
                found = [x for x in found if x[0] >= 0]
                if found:
                    ids.append(doc)
                    sizes.append(n)
                    lengths.append(len(found))
                    number.extend(x[0] for x in found)
                    tf.extend(x[1] for x in found)
                if len(ids) >= DOCS or len(number) >= ENTRIES:
                    yield flush()
        if state["docs"]:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(task), _BLOCKS)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, fp, term), each once; fp tells texts of one id apart."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, f, t) for i, f, text in zip(*(c.to_pylist() for c in batch.columns))
                     for t in set(itertools.chain.from_iterable(terms(text or b"")))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()),
                                              pa.array([x[2] for x in found], pa.binary())], names=["item_id", "fp", "term"])

    text = F.col("text").cast("string")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.md5(text).alias("fp"), text.cast("binary").alias("text"))
    return rows.mapInArrow(tidy(task), "item_id long, fp string, term binary").distinct()


# ------------------------------------------------------------------ a block of documents, a block of items

def _parts(tf: np.ndarray, m) -> np.ndarray:
    """What a term adds per unit of weight: 0 where tf is 0."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """A block of items, and the best rows found so far."""

    def __init__(self, row: dict, k: int):
        self.k = k
        self.keys = [(x["item_id"], x["fp"]) for x in row["items"]]
        named = sorted({(-t["df"], t["term"]) for x in row["items"] for t in x["terms"]})
        self.place = {t: i for i, (_, t) in enumerate(named)}                 # by frequency, most frequent first
        self.term = np.array([self.place[t["term"]] for x in row["items"] for t in x["terms"]])
        self.weight = np.array([t["w"] for x in row["items"] for t in x["terms"]], np.int64)
        self.size = np.array([len(x["terms"]) for x in row["items"]])
        self.score = np.zeros((len(self.keys), k), np.int64)                  # best first; 0: none yet
        self.doc = np.full((len(self.keys), k), np.iinfo(np.int64).max)

    def totals(self, parts: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Sums over the terms of the active items, for the rows of ``parts``."""
        use = np.repeat(active, self.size)
        start = np.r_[0, np.cumsum(self.size[active])[:-1]]
        return np.add.reduceat(parts[:, self.term[use]] * self.weight[use], start, axis=1)

    def offer(self, active: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Merge documents (docs) and their scores (docs x active items)."""
        at = np.flatnonzero(active)
        better = (scores >= np.maximum(self.score[at, -1], 1)).any(0)
        at, scores = at[better], scores[:, better]
        if not len(at):
            return
        s = np.concatenate([self.score[at], scores.T], 1)
        d = np.concatenate([self.doc[at], np.broadcast_to(docs, (len(at), len(docs)))], 1)
        order = np.lexsort((d, -s), axis=1)[:, :self.k]
        self.score[at], self.doc[at] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.keys[x][0] for x in i], pa.int64()), pa.array([self.keys[x][1] for x in i], pa.string()),
             pa.array(self.doc[i, j], pa.int64()), pa.array(self.score[i, j], pa.int64())], names=["item_id", "fp", "doc_id", "score"])


class Tree:
    """FP-tree of a block's documents, restricted to the terms of a block of items."""

    def __init__(self, row: dict, items: Items, n_docs: int, n_words: int):
        ids, sizes, lengths, number, tf = unpack(row["vectors"])
        place = np.array([items.place.get(t, -1) for t in row["terms"]])[number]
        doc = np.repeat(np.arange(len(ids)), lengths)
        keep = place >= 0
        order = np.lexsort((place[keep], doc[keep]))
        doc, place, tf = doc[keep][order], place[keep][order], tf[keep][order].astype(np.int64)
        count = np.bincount(doc, minlength=len(ids))
        first = np.r_[0, np.cumsum(count)]
        path = place.astype(">u4").tobytes()
        by_path = [i for i in sorted(range(len(ids)), key=lambda i: path[4 * first[i]:4 * first[i + 1]]) if count[i]]
        # Documents in order of their paths: a node is a range of them.
        self.ids = ids[by_path]
        self.m = np.array([10 + 90 * n * n_docs // n_words for n in sizes[by_path].tolist()], np.int64)
        take = np.concatenate([np.arange(first[i], first[i + 1]) for i in by_path]) if by_path else np.zeros(0, np.int64)
        self.start = np.r_[0, np.cumsum(count[by_path])].astype(np.int64)
        self.place, self.tf, self.width = place[take], tf[take], len(items.place)

    def children(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Ranges that share one more term than the range does; levels with a
        single child are passed over."""
        a, b = (self.place[self.start[i]:self.start[i + 1]][depth:] for i in (low, high - 1))
        size = min(len(a), len(b))                  # in order: what both ends share, all share
        differ = np.flatnonzero(a[:size] != b[:size])
        depth += int(differ[0]) if len(differ) else size
        at = self.start[low:high] + depth
        nxt = np.where(at < self.start[low + 1:high + 1], self.place[np.minimum(at, len(self.place) - 1)], -1)
        cut = np.r_[0, np.flatnonzero(np.diff(nxt)) + 1, high - low] + low
        return [(int(x), int(y), depth + 1) for x, y in zip(cut[:-1], cut[1:])]

    def bound(self, low: int, high: int) -> np.ndarray:
        """Largest part of every term over a range's documents."""
        s = slice(self.start[low], self.start[high])
        top = np.zeros((1, self.width), np.int64)
        np.maximum.at(top[0], self.place[s], self.tf[s])
        return _parts(top, self.m[low:high].min())

    def exact(self, low: int, high: int) -> np.ndarray:
        """Part of every term of each document of a range."""
        s = slice(self.start[low], self.start[high])
        out = np.zeros((high - low, self.width), np.int64)
        out[np.repeat(np.arange(high - low), np.diff(self.start[low:high + 1])), self.place[s]] = self.tf[s]
        return _parts(out, self.m[low:high, None])

    def search(self, items: Items) -> None:
        everyone = np.ones(len(items.keys), bool)
        stack = [(0, len(self.ids), 0, everyone, None)] if len(self.ids) else []
        while stack:
            low, high, depth, active, limit = stack.pop()
            if limit is not None:                  # the best rows may have risen since
                active = active.copy()
                active[active] = limit >= np.maximum(items.score[active, -1], 1)
            if not active.any():
                continue
            if high - low <= LEAF:
                items.offer(active, self.ids[low:high], items.totals(self.exact(low, high), active))
                continue
            nodes = self.children(low, high, depth)
            if len(nodes) == 1:                    # equal paths: any cut will do
                half = (low + high) // 2
                nodes = [(low, half, depth), (half, high, depth)]
            nodes = _together(nodes)
            limits = [items.totals(self.bound(x, y), active)[0] for x, y, _ in nodes]
            for at in sorted(range(len(nodes)), key=lambda i: int(limits[i].max())):
                stack.append((*nodes[at], active, limits[at]))


def _together(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring small children as one leaf."""
    out: list[tuple] = []
    for low, high, depth in nodes:
        if out and high - out[-1][0] <= LEAF:
            out[-1] = (out[-1][0], high, depth - 1)
        else:
            out.append((low, high, depth))
    return out


# ------------------------------------------------------------------ the job

def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``documents`` (doc_id,
    text) for each of ``items`` (item_id, text)."""
    spark = documents.sparkSession
    bounded_batches(spark)
    wanted = written(_item_terms(items))
    blocks = written(_vectors(documents, _bitmap(wanted)))
    n_docs, n_words = blocks.agg(F.sum("docs"), F.sum("words")).first()
    n_items = wanted.select("item_id", "fp").distinct().count()
    if not n_docs or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = wanted.join(df, "term").select("item_id", "fp", F.struct("term", "df", weight.cast("long").alias("w")).alias("t"))
    groups = -(-n_items // ITEMS)
    item_blocks = written(
        weighed.groupBy("item_id", "fp").agg(F.array_sort(F.collect_list("t")).alias("terms"))
        .groupBy(F.pmod(F.xxhash64("item_id", "fp"), F.lit(groups)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("item_id", "fp", "terms"))).alias("items")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Items] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("terms", "vectors", "block")}
                found = held.get(row["block"])
                if found is None:
                    found = held[row["block"]] = Items({"items": batch.column("items")[i].as_py()}, k)
                held.move_to_end(row["block"])
                Tree(row, found, n_docs, n_words).search(found)
                if len(held) > HELD:
                    yield held.popitem(last=False)[1].rows()
        for found in held.values():
            yield found.rows()

    tiles = paired(blocks.filter(F.size("terms") > 0).select("terms", "vectors"), F.xxhash64("vectors"), item_blocks, F.col("block"), -(-groups // HELD))
    best = tiles.mapInArrow(tidy(task), "item_id long, fp string, doc_id long, score long")
    order = Window.partitionBy("item_id", "fp").orderBy(F.desc("score"), F.asc("doc_id"))
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sf_dir.rstrip("/")
    return search(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), docs AS (
  SELECT doc, doc_id, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0
), total AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs
), tf AS (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM words) GROUP BY doc, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), item_terms AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), parts AS (
  SELECT tf.doc, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part
  FROM tf JOIN weight ON weight.term = tf.term JOIN docs ON docs.doc = tf.doc, total
  WHERE tf.term IN (SELECT term FROM item_terms)
), scored AS (
  SELECT item_id, text, doc, CAST(sum(part) AS BIGINT) AS score FROM item_terms JOIN parts ON parts.term = item_terms.term GROUP BY item_id, text, doc
), ranked AS (
  SELECT item_id, docs.doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, docs.doc_id NULLS FIRST) AS place
  FROM scored JOIN docs ON docs.doc = scored.doc WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS "rank", doc_id, score FROM ranked WHERE place <= 10
"""
