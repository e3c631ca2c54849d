"""Lexical search against scoring every document."""
import math
import random
import re
from collections import Counter

import pytest

from varpack.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    big_n, big_l = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in docs:
            m = 10 + 90 * c.total() * big_n // big_l
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, item_id string").repartition(4),
            spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, doc_id int, terms string").repartition(2))


@pytest.fixture(scope="module")
def corpus(prose):
    r = random.Random(8)
    docs = [(i, prose(r.choice([3, 20, 60, 200]), 100 + i)) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[9][1]), (None, None), (900, ""), (901, "!? \n"), (902, "ÄÖ ÄÖ 日本 é" * 30)]
    docs += [(903, prose(40_000, 3)), (904, docs[3][1].upper())]
    items = [(i, prose(r.randint(1, 30), 900 + i)) for i in range(25)] + [(30, docs[7][1]), (31, None), (32, ""), (33, "notfound Zzz9"), (34, "ÄÖ 日本"), (5, "other text"),
                                                                          (None, docs[3][1]), (30, docs[7][1]), (35, prose(4000, 5))]
    return docs, items


@pytest.mark.parametrize("sizes", [(1024, 16, 256, 8), (37, 2, 4, 1), (1, 1, 1, 2)])
def test_against_brute_force(spark, corpus, monkeypatch, sizes):
    for name, value in zip(("DOCS", "LEAF", "ITEMS", "HELD"), sizes):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus
    got = search.search(*frames(spark, docs, items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_all_documents_when_k_is_large(spark, corpus):
    docs, items = corpus[0][:120], corpus[1][:3]
    got = search.search(*frames(spark, docs, items), k=500)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 500)


def test_bounds_skip_subtrees(corpus, monkeypatch):
    """Exact scoring is asked for some leaves only, and the best rows stay right."""
    docs = [(i, Counter(terms(t))) for i, (_, t) in enumerate(corpus[0][:300])]
    names = sorted({t for _, c in docs for t in c})
    df = Counter(t for _, c in docs for t in c)
    ask = sorted(docs[11][1], key=lambda t: df[t])[:4]
    items = search.Items({"items": [{"item_id": 1, "fp": "", "terms": [{"term": t, "df": df[t], "w": 5000 - df[t]} for t in ask]}]}, 3)
    where = {t: i for i, t in enumerate(names)}
    blob = search.pack([search.np.array([i for i, _ in docs], "i8"), search.np.array([c.total() for _, c in docs], "i8"), search.np.array([len(c) for _, c in docs], "i4"),
                        search.np.array([where[t] for _, c in docs for t in c], "i4"), search.np.array([n for _, c in docs for n in c.values()], "i4")])
    tree = search.Tree({"vectors": blob, "terms": names}, items, len(docs), sum(c.total() for _, c in docs))
    scored = []
    exact = tree.exact
    monkeypatch.setattr(tree, "exact", lambda low, high: (scored.append(high - low), exact(low, high))[1])
    tree.search(items)
    everything = sorted((-sum((5000 - df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * 300 // sum(x.total() for _, x in docs)))) for t in ask if c[t]), i)
                        for i, c in docs)
    assert [(-s, d) for s, d in zip(items.score[0].tolist(), items.doc[0].tolist())] == everything[:3]
    assert 0 < sum(scored) < len(tree.ids) <= 300


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"Wort{i % 97}é" for i in range(5000)).encode()
    whole = [t for some in search.terms(text) for t in some]
    monkeypatch.setattr(search, "_PIECE", 10)
    assert [t for some in search.terms(text) for t in some] == whole
    assert [t.decode() for t in whole] == terms(text.decode())


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in search.search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])
