"""Embedding near-dedup with a random-projection tree forest.

Every tree cuts the vectors of a label recursively: level by level along a
random direction, at the median of the node's sample, until a leaf holds about
``leaf_rows`` vectors. Vectors within a margin of a cut go to both sides
(spill), so a close pair parted by a cut still meets. The margin follows from
the distance of two vectors at the threshold, so a dense group is not cut finer
than its links reach: a node that no direction parts well is not cut at all.
Leaves are compared exactly in double precision, a large one in pairs of tiles
that are groups of their own, and links are united over all leaves and trees.

The cuts are fitted on a bounded sample (``sample_rows``, the smallest id
hashes); routing is then a function of the vector alone, so every row is indexed
in every tree. Below the depth that the sample supports, cuts go through the
mean of the deepest fitted node; a dense group that stays together there is
compared in tiles like any large leaf.

Nothing of quadratic size leaves a leaf. Equal vectors are one weighted class
before anything is compared. A leaf returns one row per class: the links that no
earlier common leaf counts (each class knows all its leaves), and the smallest
class it is connected with.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
lengths never link; a null id is the smallest id; rows that share an id (or have
none) are vectors of their own; repeated rows link with each other; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shuffle import NO_ID, written

TREES = 10
LEAF_ROWS = 512
SAMPLE_ROWS = 16384
MARGIN = 0.6         # on either side of a cut, as a share of what parts a pair at the threshold along a direction
_GAIN = 0.9          # a cut leaves at most this share of a node's comparisons
_TILE_ROWS = 2048    # rows of a leaf compared at a time
_MIN_FIT = 32        # a node with fewer sampled rows is not fitted
_BLOCK = 1024


def directions(dim: int, tree: int) -> np.ndarray:
    """Unit directions of the cuts of one tree."""
    r = np.random.Generator(np.random.PCG64([dim, tree])).standard_normal((64, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def spill(threshold: float, dim: int) -> float:
    """Half the width of the band around a cut that goes to both sides. Vectors
    of a cosine of ``threshold`` are sqrt(2 - 2 * threshold) apart, and along a
    random direction typically that over sqrt(dim)."""
    return MARGIN * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def best_cut(proj: np.ndarray, first: int, margin: float):
    """(direction, cut) of a node: its median along direction ``first``, or, if
    that saves too few comparisons, the best of all directions and quartiles;
    None if none saves enough."""
    def cost(p, mid):
        return (p < mid + margin).mean(0) ** 2 + (p >= mid - margin).mean(0) ** 2

    mid = float(np.median(proj[:, first]))
    if cost(proj[:, first], mid) <= _GAIN:
        return first, mid
    mids = np.quantile(proj, [0.25, 0.5, 0.75], axis=0)
    costs = np.array([cost(proj, m) for m in mids])
    q, d = np.unravel_index(np.argmin(costs), costs.shape)
    return (int(d), float(mids[q, d])) if costs[q, d] <= _GAIN else None


def fit_tree(x: np.ndarray, tree: int, depth: int, margin: float) -> dict:
    """Cuts of one tree from sampled unit vectors: node -> (direction, cut), or
    None for a node that stays whole. A node is its path, with a leading one bit."""
    proj = x @ directions(x.shape[1], tree).T
    cuts, mean, todo = {}, {}, [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if level == depth:
            continue
        if len(rows) < _MIN_FIT:
            mean[node] = x[rows].mean(0) if len(rows) else x.mean(0)
            continue
        cuts[node] = cut = best_cut(proj[rows], level, margin)
        if cut is not None:
            p = proj[rows, cut[0]]
            todo += [(2 * node, rows[p < cut[1]], level + 1), (2 * node + 1, rows[p >= cut[1]], level + 1)]
    return {"depth": depth, "margin": margin, "cuts": cuts, "mean": mean}


def route(x: np.ndarray, tree: int, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of unit vectors in one tree; spilled rows have several."""
    depth, margin, cuts, mean = model["depth"], model["margin"], model["cuts"], model["mean"]
    row, node, done = np.arange(len(x)), np.ones(len(x), np.int64), []
    d = directions(x.shape[1], tree)
    proj = x @ d.T if depth else None
    for level in range(depth):
        mid, along, whole = np.empty(len(row)), np.full(len(row), level), np.zeros(len(row), bool)
        for n in np.unique(node):
            at = node == n
            if int(n) in cuts:
                cut = cuts[int(n)]
                if cut is None:
                    whole |= at
                else:
                    along[at], mid[at] = cut
            else:                        # through the mean of the deepest fitted node
                k = int(n)
                while k > 1 and k not in mean:
                    k >>= 1
                mid[at] = float(mean[k] @ d[level]) if k in mean else 0.0
        done.append((row[whole], node[whole]))
        p = proj[row, along]
        left, right = ~whole & (p < mid + margin), ~whole & (p >= mid - margin)
        row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
    done.append((row, node))
    return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def fit_forest(sample: list, total: int, trees: int, leaf_rows: int, seen: int, threshold: float) -> dict:
    """Models by (label, length); None for labels the sample holds few of."""
    groups: dict = {}
    for label, vector in sample:
        groups.setdefault((label, len(vector)), []).append(vector)
        groups.setdefault((None, len(vector)), []).append(vector)
    models = {}
    for key, rows in groups.items():
        if key[0] is not None and len(rows) < 2 * _MIN_FIT:
            continue
        x = np.array(rows, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        share = len(rows) if key[0] is not None else min(len(rows), 2 * _MIN_FIT)
        n = total * share / max(1, seen)
        depth = min(48, max(0, int(np.ceil(np.log2(max(1.0, n / leaf_rows))))))
        models[key] = [fit_tree(x, t, depth, spill(threshold, key[1])) for t in range(trees)]
    return models


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def leaf_key(tree: int, node: np.ndarray) -> np.ndarray:
    """One number for tree and leaf: depth is 48 at most, trees 256."""
    return node * np.int64(256) + np.int64(tree)


def compare_leaf(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, leaves: list, own: int, threshold: float, tile: np.ndarray | None = None):
    """Per class of one leaf: links first met here, and the smallest id reached.
    With ``tile`` only classes of different tiles are compared."""
    k = len(ids)
    earlier = sorted({v for row in leaves for v in row if v < own})
    column = {v: i for i, v in enumerate(earlier)}
    member = np.zeros((k, max(1, len(earlier))), np.float32)
    for i, row in enumerate(leaves):
        for v in row:
            if v < own:
                member[i, column[v]] = 1
    counted = np.zeros(k, np.int64)
    near = []
    for a in range(0, k, _BLOCK):
        link = x[a: a + _BLOCK] @ x.T >= threshold
        link[np.arange(len(link)), np.arange(a, a + len(link))] = False
        if tile is not None:
            link &= tile[a: a + _BLOCK, None] != tile
        if link.any():
            new = link & ~(member[a: a + _BLOCK] @ member.T > 0)
            counted[a: a + _BLOCK] = new @ weight
            near.append((a, link))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(k, np.int32)
    rank[order] = np.arange(k, dtype=np.int32)
    reach = rank.copy()
    while near:
        before = reach.copy()
        for a, link in near:
            there = np.where(link, before, np.int32(k)).min(1)
            reach[a: a + _BLOCK] = np.minimum(reach[a: a + _BLOCK], there)
        reach = reach[order[reach]]
        if (reach == before).all():
            break
    return counted, ids[order[reach]]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
                           sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id
    (smallest id reachable), kept (vec_id = component_id)."""
    v = F.col(vector_col)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    # Classes of equal vectors bear numbers of their own until the end: ids may be null or shared.
    classes = written(rows.filter("sound").groupBy("label", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("w"))
                      .withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()
    sample = [(r.label, r.v) for r in classes.select("label", "v", F.xxhash64("label", "v").alias("h"), "rep").orderBy("h", "rep").limit(sample_rows).collect()]
    models = fit_forest(sample, total, trees, leaf_rows, len(sample), threshold)

    def routed(batch: pa.RecordBatch):
        """(rows of one label and length, length, row, leaf), in row order."""
        size = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        label = np.array(batch.column("label").to_pylist(), object)
        for key in {(a, int(b)) for a, b in zip(label, size)}:
            at = np.flatnonzero((label == key[0]) & (size == key[1]))
            x = matrix(batch.column("v").take(pa.array(at)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            forest = models.get(key) or models.get((None, key[1])) or [fit_tree(x[:1], t, 0, 0.0) for t in range(trees)]
            of_row, of_leaf = [], []
            for t, model in enumerate(forest):
                r, n = route(x, t, model)
                of_row.append(r)
                of_leaf.append(leaf_key(t, n))
            r, leaf = np.concatenate(of_row), np.concatenate(of_leaf)
            order = np.lexsort((leaf, r))
            yield at, key[1], r[order], leaf[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, dim, r, leaf in routed(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(pa.array(at[r])), pa.array(np.full(len(r), dim), pa.int32()), pa.array(leaf)],
                    names=["label", "dim", "leaf"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, dim, r, leaf in routed(batch):
                ptr = np.searchsorted(r, np.arange(len(at) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(leaf))
                take = pa.array(at[r])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(take), pa.array(np.full(len(r), dim), pa.int32()), pa.array(leaf), batch.column("rep").take(take),
                     batch.column("w").take(take), batch.column("v").take(take), lists.take(pa.array(r))],
                    names=["label", "dim", "leaf", "rep", "w", "v", "leaves"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x = matrix(t.column("v").combine_chunks())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tile = t.column("tile").to_numpy() if key[3].as_py() != key[4].as_py() else None
        n, reach = compare_leaf(x, t.column("rep").to_numpy(), t.column("w").to_numpy(), t.column("leaves").to_pylist(), key[2].as_py(), threshold, tile)
        some = (n > 0) | (reach != t.column("rep").to_numpy())
        return pa.table({"rep": t.column("rep").to_numpy()[some], "n": n[some], "reach": reach[some]})

    kind, leaf = dict(classes.dtypes), ["label", "dim", "leaf"]
    of_leaf = f"label {kind['label']}, dim int, leaf long"
    large = written(classes.mapInArrow(place, of_leaf).groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / _TILE_ROWS).cast("int").alias("tiles")).filter("tiles > 1"))
    indexed = (classes.mapInArrow(index, f"{of_leaf}, rep long, w long, v {kind['v']}, leaves array<long>")
               .join(large, leaf, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
               .withColumn("tile", F.pmod(F.xxhash64("rep", "v"), "tiles").cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
               .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other"))
    met = written(indexed.groupBy(*leaf, "low", "high").applyInArrow(compare, "rep long, n long, reach long"))
    links = met.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(met.select(F.col("rep").alias("a"), F.col("reach").alias("b")))
    per_class = (classes.join(links, "rep", "left").join(label, F.col("rep") == F.col("id"), "left")
                 .select("label", "v", "first", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")))
    smallest = per_class.groupBy("group").agg(F.min("first").alias("component"))
    per_class = per_class.join(smallest, "group").select("label", "v", "n_links", "component")
    out = (rows.filter("sound").join(per_class, ["label", "v"]).select("id", "n_links", "component")
           .unionByName(rows.filter(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))))
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("id").alias("vec_id"), "n_links", back("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
