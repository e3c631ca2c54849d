"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. A round counts, per
query, how many scores fall into each bin of its current score range; the counts
are summed over all blocks, the bin that holds the k-th best score becomes the
next range, and after a few rounds the k-th value of every query is known (or a
range that holds only a few scores). A last pass keeps the scores from there up,
at most k per block and query, and ranks them with ties to the smaller id.

What moves is blocks of vectors, histogram counts (combined per task before the
shuffle) and at most k rows per block and query, whatever the ties. Blocks meet in
tiles: candidates are dealt over slices and so are queries, each side is copied to
the other's slices, and a (slice, slice) pair is the join key.

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors of another length than a query are no candidates of it; fewer
candidates than k give fewer rows; equal scores rank by id; a null id takes no
part; rows that share an id are separate candidates (and none is the candidate
of a query with its own id); extra columns are ignored. An empty table, or one
without queries, gives an empty result. Scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embedding_forest import matrix
from .shuffle import pack, paired, unpack, written

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
SLICE_BLOCKS = 64      # query blocks of a tile, on average
BINS = 256
_EXACT = 2**53


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, ints): rows of one length in blocks of ``size``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), size):
                    some = pa.array(at[k: k + size])
                    part = batch.take(some)
                    ints = np.floor(1024.0 * matrix(part.column("v"))) if dim else np.zeros((len(some), 0))
                    small = np.int16 if np.abs(ints).max(initial=0) < 2**15 else np.float64
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()),
                         pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([pack([ints.astype(small).reshape(-1)])], pa.binary())],
                        names=["dim", "ids", "ints"])

    return rows.mapInArrow(task, "dim int, ids binary, ints binary")


def _block(ids: bytes, ints: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, unpack(ints)[0].astype(np.float64).reshape(len(i), -1)


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products, candidates by queries."""
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if bound < _EXACT:
        return (c @ q.T).astype(np.int64)
    if bound < 2**63 and max(np.abs(c).max(initial=0), np.abs(q).max(initial=0)) < 2**62:
        return c.astype(np.int64) @ q.astype(np.int64).T
    to_int = np.vectorize(int, otypes=[object])
    return (to_int(c) @ to_int(q).T).astype(np.int64)  # raises where a score exceeds a long


def _histograms(pairs: DataFrame) -> DataFrame:
    """(query_id, bin, count) of one round; a task sums over its blocks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cid, c = _block(r["ids"], r["ints"])
                qid, q = _block(r["qids"], r["qints"])
                low, width = np.array(r["low"], np.int64), np.array(r["width"], np.int64)
                s = scores(c, q)
                b = (s - low) // width
                use = (b >= 0) & (b < BINS) & (cid[:, None] != qid[None, :])
                flat = (np.arange(len(qid)) * BINS)[None, :] + b
                count = np.bincount(flat[use], minlength=len(qid) * BINS)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[at // BINS]), pa.array(at % BINS, pa.int32()), pa.array(count[at], pa.int64())], names=["query_id", "bin", "count"])

    return pairs.mapInArrow(task, "query_id long, bin int, count long").groupBy("query_id", "bin").agg(F.sum("count").alias("count"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from each query's threshold up, k per block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cid, c = _block(r["ids"], r["ints"])
                qid, q = _block(r["qids"], r["qints"])
                s = scores(c, q)
                i, j = np.nonzero((s >= np.array(r["low"], np.int64)) & (cid[:, None] != qid[None, :]))
                v = s[i, j]
                order = np.lexsort((cid[i], -v, j))
                i, j, v = i[order], j[order], v[order]
                rank = np.arange(len(j)) - np.searchsorted(j, j)
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[j[keep]]), pa.array(cid[i[keep]]), pa.array(v[keep], pa.int64())],
                                                 names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(task, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` by integer
    inner product for each row of ``queries`` (same columns)."""
    def clean(df: DataFrame) -> DataFrame:
        bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad))

    size = F.array_max(F.transform("v", lambda e: F.abs(F.floor(e * 1024.0).cast("double"))))
    cand = clean(vectors)
    asked = written(_packed(clean(queries), QUERY_BLOCK)
                    .withColumn("block", F.monotonically_increasing_id()))
    slices = -(-asked.count() // SLICE_BLOCKS) or 1
    largest = cand.agg(F.max(size)).first()[0] or 0.0
    blocks = written(_packed(cand, CANDIDATE_BLOCK).repartition(max(1, vectors.sparkSession.sparkContext.defaultParallelism)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid, q = _block(r["ids"], r["ints"])
                reach = np.abs(q).sum(1) * largest + 1          # no score lies beyond it
                low = -np.ceil(reach).astype(np.int64)
                width = -(-(2 * -low + 1) // BINS)
                n = len(qid)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(qid), pa.array(low), pa.array(width), pa.array(np.full(n, k, np.int64)), pa.array(np.zeros(n, bool))],
                    names=["block", "place", "query_id", "low", "width", "need", "done"])

    state = written(asked.mapInArrow(start, "block long, place int, query_id long, low long, width long, need long, done boolean"))

    def pairs(state: DataFrame) -> DataFrame:
        ranges = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "low", "width"))).alias("r"))
        q = asked.join(ranges, "block").select("block", F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("ints").alias("qints"),
                                               F.col("r.low").alias("low"), F.col("r.width").alias("width"))
        # The stated query set against all rows, in tiles of blocks.
        return paired(blocks, F.xxhash64("ids"), q, F.col("block"), slices).filter("dim = qdim")

    while state.filter(~F.col("done")).limit(1).count():
        found = _histograms(pairs(state))
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        hit = (found.withColumn("upto", F.sum("count").over(w)).join(state.filter(~F.col("done")), "query_id")
               .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("count") < F.col("need"))))
        nxt = hit.select("block", "place", F.col("bin").alias("b"), F.col("count").alias("inside"), (F.col("need") - F.col("upto") + F.col("count")).alias("rest"))
        moved = state.join(nxt, ["block", "place"], "left")
        small = F.col("inside") <= 4 * k
        state = written(moved.select(
            "block", "place", "query_id",
            F.when(F.col("done") | F.col("b").isNull(), F.col("low")).otherwise(F.col("low") + F.col("b") * F.col("width")).alias("low"),
            F.when(F.col("done") | F.col("b").isNull(), F.col("width")).otherwise(F.expr(f"(width + {BINS - 1}) div {BINS}")).alias("width"),
            F.coalesce("rest", "need").alias("need"),
            # no bin holds the k-th score: fewer candidates than k, so all of them stay
            (F.col("done") | F.col("b").isNull() | small | (F.col("width") == 1)).alias("done")))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (_best(pairs(state), k).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS "rank", vec_id, score FROM r WHERE rk <= 10
"""
