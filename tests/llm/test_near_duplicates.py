"""N-gram Jaccard join and embedding forest."""
import numpy as np
import pytest

from tests.llm import brute
from varpack.llm import embedding_forest as forest
from varpack.llm import jaccard_join as join
from varpack.llm.components import components


def test_join_matches_brute_force(odd_docs, odd_rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join.near_duplicates(odd_docs).collect()), key=repr)
    assert got == sorted(brute.jaccard(odd_rows), key=repr)


@pytest.fixture(scope="module")
def families(prose):
    """Chains and groups of near copies around the threshold, tiny documents,
    and a passage that most documents share."""
    r, rows, passage = np.random.default_rng(3), [], prose(45, 99)
    for k in range(12):
        words = prose(int(r.integers(4, 90)), 100 + k).split()
        for _ in range(14):
            new = list(words)
            for _ in range(int(r.integers(0, 4))):
                new[int(r.integers(len(new)))] = f"w{r.integers(50)}"
            rows.append((len(rows), " ".join(new) if r.random() < 0.5 else " ".join(new) + " " + passage))
            if r.random() < 0.3:
                words = new
    rows += [(len(rows) + k, " ".join(f"t{(k + j) % 6}" for j in range(5 + k % 5))) for k in range(30)]
    return rows


@pytest.mark.parametrize("percent", [80, 60, 95])
def test_join_loses_no_link(spark, families, percent):
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.near_duplicates(docs, percent).collect())
    assert got == sorted(brute.jaccard(families, percent))


def test_every_bucket_in_tiles_and_one_round(spark, families, monkeypatch):
    monkeypatch.setattr(join, "_TILE_ROWS", 3)
    monkeypatch.setattr(join, "ROUNDS", 0)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.near_duplicates(docs).collect())
    assert got == sorted(brute.jaccard(families))


def test_sketch_distance_is_a_lower_bound(prose):
    a, b = brute.shingles(prose(200, 1)), brute.shingles(prose(120, 1) + " " + prose(300, 2))
    hashes = lambda s: np.sort(np.array([hash(x) & (2**64 - 1) for x in s], np.uint64))
    x, y = (join.bit_sketches(np.array([0, len(s)]), hashes(s))[0] for s in (a, b))
    assert len(x) != len(y) and join.hamming(x, y) <= len(a ^ b)
    assert join.hamming(x, x) == 0


@pytest.fixture(scope="module")
def clashes(prose):
    """Rows without an id, with different texts, and ids that hold two texts."""
    near = lambda k, w: " ".join([*prose(120, k).split()[:w], "changed", *prose(120, k).split()[w + 1:]])
    rows = [(None, prose(120, 1)), (None, prose(120, 2)), (None, prose(120, 3)), (6, near(1, 50)), (9, prose(120, 1)), (5, near(2, 60)), (5, near(3, 70)),
            (7, prose(120, 4)), (7, prose(120, 5)), (8, near(5, 30)), (None, prose(120, 2)), (7, prose(120, 4)), (None, None), (7, ""), (None, ""), (3, prose(120, 6)), (3, near(4, 10))]
    return rows


@pytest.mark.parametrize("turned", [False, True])
def test_join_of_rows_without_own_ids(spark, clashes, turned):
    rows = clashes[::-1] if turned else clashes
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag int").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in join.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute.jaccard(rows), key=repr)
    assert {(6, None), (9, None), (5, None), (8, 7), (3, 3)} <= {(d, c) for d, _, c in got}


def test_one_row_of_every_group_stays(spark, clashes):
    docs = spark.createDataFrame([(*r, 1) for r in clashes], "doc_id long, text string, tag int").repartition(3)
    kept = [(r.doc_id, r.text) for r in join.one_per_group(docs).collect()]
    texts = [t for _, t in kept]
    assert len(kept) == len(set(kept)) and set(kept) <= set(clashes) and join.one_per_group(docs).dtypes == docs.dtypes
    sets = [(d, brute.shingles(t)) for d, t in clashes]
    same = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i][1] and 100 * len(sets[i][1] & sets[j][1]) >= 80 * len(sets[i][1] | sets[j][1])]
    group = brute.components(range(len(sets)), same)
    want = {}
    for k, (d, t) in enumerate(clashes):
        if sets[k][1]:
            want.setdefault(group[k], set()).add((d, t))
    least = lambda g: min((d is not None, d or 0) for d, _ in g)
    assert all(len(g & set(kept)) == 1 and all((d is not None, d or 0) == least(g) for d, _ in g & set(kept)) for g in want.values())
    assert texts.count(None) == 1 and texts.count("") == 2                       # (null, null), (7, ""), (null, "")


def test_join_of_no_documents(no_docs):
    assert join.near_duplicates(no_docs).collect() == []


def test_components(spark):
    rows = [(1, 2), (2, 3), (9, 9), (7, 8), (8, 5), (3, 1), (100, 5)] + [(k, k + 1) for k in range(20, 60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5, 100: 5, **{k: 20 for k in range(20, 61)}}
    assert got == want


def vectors(spark, n=1500, dim=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for i in range(n // 2, n):                       # half of them are near or exact copies
        x[i] = x[r.integers(n // 2)] + (0 if i % 7 == 0 else 0.12) * r.standard_normal(dim)
    rows = [(int(i), [float(v) for v in np.float32(x[i])], int(i % 3)) for i in range(n)]
    rows += [(5001, None, 0), (5002, [], 0), (5003, [0.0] * dim, 0), (5004, [float("nan")] + [1.0] * (dim - 1), 0), (5005, [None] + [1.0] * (dim - 1), 0),
             (5006, rows[0][1], None), (5007, rows[0][1][:4], 0), (5008, rows[0][1], 0), (5008, rows[0][1], 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<float>, label int, rep string")


def brute_links(rows, threshold=0.93):
    good = [(i, v, l) for i, v, l in rows if v and l is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links = {k: [] for k in range(len(good))}
    for label in {g[2] for g in good}:
        for dim in {len(g[1]) for g in good}:
            at = [k for k, g in enumerate(good) if g[2] == label and len(g[1]) == dim]
            if at:
                x = np.array([good[k][1] for k in at], float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
                    if a != b:
                        links[at[a]].append(at[b])
    return good, links


def test_forest_links(spark):
    rows, df = vectors(spark)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicate_vectors(df, leaf_rows=64).collect()), key=repr)
    good, links = brute_links(rows)
    label = brute.smallest_ids([g[0] for g in good], [(a, b) for a in links for b in links[a]])
    want = [(g[0], len(links[k]), label[k], g[0] == label[k]) for k, g in enumerate(good)]
    want += [(i, 0, i, True) for i, v, l in rows if 5001 <= (i or 0) <= 5006]
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, sorted(want, key=repr))) <= 0.02 * len(want)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.98 * there <= found <= there


def test_forest_keeps_the_links_of_a_dense_group(spark, monkeypatch):
    """Distinct near copies that fill more than 16 leaves, compared in several tiles."""
    monkeypatch.setattr(forest, "_TILE_ROWS", 150, raising=False)
    r, dim = np.random.default_rng(8), 32
    centre, other = r.standard_normal(dim), r.standard_normal((500, dim))
    near = centre + 0.2 * np.linalg.norm(centre) / np.sqrt(dim) * r.standard_normal((700, dim))
    rows = [(i, [float(e) for e in np.float32(v)], 0) for i, v in enumerate(np.r_[other, near])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {g.vec_id: g for g in forest.near_duplicate_vectors(df, leaf_rows=16).collect()}
    good, links = brute_links(rows)
    label = brute.components({g[0] for g in good}, [(a, b) for a in links for b in links[a]])
    assert sum(map(len, links.values())) > 300000
    assert all(got[k].n_links <= len(v) for k, v in links.items())
    assert sum(g.n_links for g in got.values()) >= 0.999 * sum(map(len, links.values()))
    assert all(got[k].component_id == label[k] for k in links)


def test_forest_rows_without_own_ids(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((4, 12))
    near = base + 0.05 * r.standard_normal((4, 12))
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (4, near[0]), (5, near[1]), (5, near[2]), (6, base[3]), (6, base[0]), (6, near[3]), (6, near[3])]
    rows = [(i, [float(e) for e in v], 0) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(((g.vec_id, g.n_links, g.component_id, g.kept) for g in forest.near_duplicate_vectors(df).collect()), key=repr)
    good, links = brute_links(rows)
    label = brute.smallest_ids([g[0] for g in good], [(a, b) for a in links for b in links[a]])
    assert got == sorted(((g[0], len(links[k]), label[k], g[0] == label[k]) for k, g in enumerate(good)), key=repr)


def test_forest_odd_rows_and_empty_table(spark):
    rows, df = vectors(spark)
    got = [(r.vec_id, r.n_links, r.kept) for r in forest.near_duplicate_vectors(df.filter("vec_id > 5000 OR vec_id IS NULL")).collect()]
    assert sorted(got, key=repr) == sorted([(5001, 0, True), (5002, 0, True), (5003, 0, True), (5004, 0, True), (5005, 0, True), (5006, 0, True),
                                            (5007, 0, True), (5008, 2, False), (5008, 2, False), (None, 2, True)], key=repr)
    assert forest.near_duplicate_vectors(df.limit(0)).collect() == []
