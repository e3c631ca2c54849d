import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Seeded texts: a vocabulary of 300 invented words."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Documents with every odd case: nulls, empty and blank texts, a long text,
    copies, near copies, repeated rows, periodic text, other scripts."""
    base, passage = prose(150, 1), prose(60, 2)
    near = base.split()
    near[70] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(80, 3) + "\n" + passage + "\n" + prose(40, 4)),
        (5, passage + " " + prose(90, 5)), (6, None), (7, ""), (8, " \t\n "), (9, "one two three"), (10, "One TWO three"),
        (11, "ab" * 400), (12, "line again\n" * 60), (13, "Ärger über Öl " * 20 + prose(30, 6)), (14, prose(5000, 7) + " " + passage),
        (None, prose(50, 8)), (15, prose(50, 8)), (20, base.upper()), (21, "x" * 99), (22, "x" * 100), (23, "x" * 101),
        (24, "日本語の文 " * 30), (25, "a  b c\r\nd \n e   "), (26, "don't I'LL <|endoftext|> 12345 ½ é"),
    ]
    return rows + [(4, rows[3][1]), (7, "")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as a table with extra columns whose names clash with internal ones."""
    schema = "doc_id long, text string, did string, tag string, part int, marks string, n int, component string"
    return spark.createDataFrame([(d, t, "x", None, 1, "m", 2, None) for d, t in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
