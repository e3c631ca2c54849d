"""Toxicity by a classifier chain.

Categories are predicted one after the other. The model of a category is a
logistic regression on hashed words (does the document hold the word) plus the
probabilities of the earlier categories. To train a later model on the kind of
probabilities it will meet, the earlier ones are out-of-fold predictions: the
sample is cut into folds, every fold is predicted by a model of the others, and
a last model of all rows serves at prediction time.

Training takes a bounded sample of the labelled rows (``sample_rows``, the
smallest hashes of the id). Its features are taken by Spark; the folds of a
category train in parallel tasks, each of bounded size. Scoring is a map over
all documents and whole texts.

Defined cases: null or empty text holds no words and gets the intercepts'
probability; a null id is scored like any other row; labels that are null or
without a document are not used; several labels of a document count as several
samples; with no labelled rows, or only one class, a category's probability is
the share of ones (0 without rows); extra columns are ignored by
``score_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shuffle import bounded_batches, tidy, written
from .textcore import CODES_LOWER, U64, buffers, prefix, row_slices, span_hash

SAMPLE_ROWS = 20_000
FOLDS = 4
BUCKETS = 1 << 20      # of the word hash
FEATURES = 4_000       # words a model keeps, by chi-square on the sample
MIN_DOCS = 3
L2 = 0.3
LEAST_CHI = 20.0      # so many words are tried that one chance in a thousand is not enough
CATEGORIES = ("low_quality", "toxic")
PROBABILITIES = ("p_low_quality", "p_toxic")

#: letters are bytes that are not ASCII punctuation, digits or white space
_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def word_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row pointer, distinct word buckets of each row): words are
    runs of letters, ASCII letters lower-cased."""
    offsets, data = buffers(texts)
    for a, b in row_slices(offsets, 1 << 20):
        lo, hi = int(offsets[a]), int(offsets[b])
        part = data[lo:hi]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = _LETTER[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[offsets[a: b + 1] - lo] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        h = (span_hash(prefix(CODES_LOWER[part]), start, end) % U64(BUCKETS)).astype(np.int32)
        ptr = np.searchsorted(start, offsets[a: b + 1] - lo)
        for i, j in zip(ptr[:-1], ptr[1:]):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[ptr[:-1][np.diff(ptr) > 0]] = True
        total = np.r_[0, np.cumsum(new)]
        yield a, total[ptr], h[new]


def logistic(ptr: np.ndarray, column: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, l2: float = L2):
    """Weights (words, extra, intercept) of a ridge logistic regression on
    binary word features and dense extra columns, both classes weighing the
    same; Newton steps, each solved by conjugate gradients."""
    n, rows = len(y), np.repeat(np.arange(len(y)), np.diff(ptr))
    k = extra.shape[1]

    def times(w):
        return np.bincount(rows, w[column], n) + extra @ w[width: width + k] + w[-1]

    ones = y.sum()
    weight = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))

    def back(r):
        return np.r_[np.bincount(column, r[rows], width), r @ extra, r.sum()]

    penalty = np.r_[np.full(width, l2), np.full(k, l2), 1e-6]
    w = np.zeros(width + k + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(times(w), -35, 35)))
        g = back(weight * (p - y)) + penalty * w
        if np.abs(g).max() < 1e-3:
            break
        s = weight * p * (1 - p)
        d, r = np.zeros_like(w), -g
        q, rr = r.copy(), r @ r
        for _ in range(20):
            hq = back(s * times(q)) + penalty * q
            a = rr / max(q @ hq, 1e-12)
            d += a * q
            r -= a * hq
            new = r @ r
            if new < 1e-8 * (g @ g):
                break
            q, rr = r + (new / rr) * q, new
        w += d
    return w


def choose(ptr: np.ndarray, words: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The words with the largest chi-square against ``y``, among those in
    ``MIN_DOCS`` documents or more that are hardly there by chance; sorted."""
    rows = np.repeat(np.arange(len(y)), np.diff(ptr))
    df = np.bincount(words, minlength=BUCKETS).astype(float)
    pos = np.bincount(words, y[rows], BUCKETS)
    n, ones = len(y), y.sum()
    expect = df * ones / max(1, n)
    chi = np.where(df >= MIN_DOCS, (pos - expect) ** 2 / np.maximum(expect * (1 - ones / max(1, n)), 1e-9), 0)
    top = np.argsort(-chi, kind="stable")[:most]
    return np.sort(top[chi[top] > LEAST_CHI])


def fit(ptr, words, extra, y) -> dict:
    """A model as plain arrays; only the share of ones where y has one class."""
    k = extra.shape[1]
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return {"words": np.zeros(0, np.int64), "w": np.zeros(0), "extra": np.zeros(k), "bias": float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))}
    kept = choose(ptr, words, y, FEATURES)
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    column = place[words]
    use = column >= 0
    inside = np.r_[0, np.cumsum(use)][ptr]
    w = logistic(inside, column[use], extra, y, len(kept))
    return {"words": kept, "w": w[: len(kept)], "extra": w[len(kept): len(kept) + k], "bias": float(w[-1])}


def predict(model: dict, ptr: np.ndarray, words: np.ndarray, extra: np.ndarray) -> np.ndarray:
    weight = np.zeros(BUCKETS)
    weight[model["words"]] = model["w"]
    total = np.r_[0.0, np.cumsum(weight[words])]
    z = total[ptr[1:]] - total[ptr[:-1]] + extra @ model["extra"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(length)].astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def trainer(category: str, folds: int):
    """The task that trains ``category`` without one fold and predicts that
    fold; fold number ``folds`` holds nothing out and returns the model."""
    def train(key: tuple, table: pa.Table) -> pa.Table:
        mine = key[0].as_py()
        table = table.sort_by([("id", "ascending")])
        ptr, words = _lists(table.column("words"))
        y = table.column(category).to_numpy().astype(float)
        earlier = np.array(table.column("earlier").to_pylist(), float).reshape(len(y), -1)
        held = table.column("fold").to_numpy() == mine

        def rows(mask):
            size = np.diff(ptr)
            return np.r_[0, np.cumsum(size[mask])], words[np.repeat(mask, size)], earlier[mask]

        model = fit(*rows(~held), y[~held])
        ids, p, last = table.column("id").to_numpy()[held], predict(model, *rows(held)), mine == folds
        none = len(ids) * [None]
        return pa.table({
            "id": pa.array([*ids, *([None] if last else [])], pa.int64()), "p": pa.array([*p, *([None] if last else [])], pa.float64()),
            "words": pa.array([*none, *([model["words"].tolist()] if last else [])], pa.list_(pa.int64())),
            "weights": pa.array([*none, *([np.r_[model["w"], model["extra"], model["bias"]].tolist()] if last else [])], pa.list_(pa.float64()))})

    return train


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample_rows: int = SAMPLE_ROWS,
                folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """One model per category; ``labels`` has ``id_col`` and a 0/1 column per category."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    sample = known.orderBy(F.xxhash64("id"), "id", *categories).limit(sample_rows)   # bounded: sample_rows small rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ptr, words in word_sets(batch.column("text")):
                rows = [c.slice(a, len(ptr) - 1) for c in (batch.column("id"), *(batch.column(x) for x in categories))]
                yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(words))],
                                                 names=["id", *categories, "words"])

    kinds = ", ".join(f"{c} int" for c in categories)
    found = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(sample), "id").mapInArrow(tidy(features), f"id long, {kinds}, words array<int>")
             .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(folds)).cast("int"))
             .withColumn("earlier", F.array().cast("array<double>")))
    found = written(found)
    models: list[dict] = []
    for category in categories:
        # fold `folds` holds nothing out: the model that is used to predict
        tasks = found.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        result = written(tasks.groupBy("without").applyInArrow(trainer(category, folds), "id long, p double, words array<long>, weights array<double>"))
        last = result.filter("weights IS NOT NULL").first()
        if last is None:
            models.append({"words": np.zeros(0, np.int64), "w": np.zeros(0), "extra": np.zeros(len(models)), "bias": -13.8})
            continue
        n, w = len(last["words"]), np.array(last["weights"])
        models.append({"words": np.array(last["words"], np.int64), "w": w[:n], "extra": w[n:-1], "bias": float(w[-1])})
        if category != categories[-1]:
            oof = result.filter("id IS NOT NULL").groupBy("id").agg(F.first("p").alias("p"))
            found = written(found.join(oof, "id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"))
    return models


def score_documents(docs: DataFrame, models: list[dict], threshold: float = 0.5, probabilities: tuple[str, ...] = PROBABILITIES,
                    verdict: str = "toxic", text_col: str = "text") -> DataFrame:
    """``docs`` with a probability column per model and ``verdict``: 1 where the
    last one is at least ``threshold``. Columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (*probabilities, verdict) if c != text_col])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = []
        for m in models:
            w = np.zeros(BUCKETS, np.float32)
            w[m["words"]] = m["w"]
            weights.append(w)
        for batch in batches:
            got = [[] for _ in models]
            for _, ptr, words in word_sets(batch.column("_vp_text")):
                extra = np.zeros((len(ptr) - 1, 0))
                for k, (m, w) in enumerate(zip(models, weights)):
                    total = np.r_[0.0, np.cumsum(w[words], dtype=np.float64)]
                    z = total[ptr[1:]] - total[ptr[:-1]] + extra @ m["extra"] + m["bias"]
                    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                    got[k].append(p)
                    extra = np.c_[extra, p]
            cols = [pa.array(np.concatenate(g) if g else np.zeros(0), pa.float64()) for g in got]
            keep = [n for n in batch.schema.names if n != "_vp_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *cols], names=[*keep, *probabilities])

    wide = docs.withColumn("_vp_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{n} double" for n in probabilities)])
    return wide.mapInArrow(tidy(task), schema).withColumn(verdict, (F.col(probabilities[-1]) >= threshold).cast("int"))


def load_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as chain categories: low quality, then toxic."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return rows.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    models = train_chain(docs, load_labels(spark, sf_dir))
    return score_documents(docs.select("doc_id", "text"), models).drop("text")
