"""Literal cases of the reference's own test suite, as pytest."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from varpack.functions import measures as V
from varpack.functions.parse import canonical_category, dc_sign, parse_amount, period_key, with_amounts
from varpack.functions.text import looks_like_total, normalise_header

AMOUNTS = [("512.000,00", 512000), ("1,234,567.89", 1234567.89), ("445.000", 445000),
           ("12,5", 12.5), ("€ 1.234,50", 1234.5), ("1.234,50 EUR", 1234.5),
           ("-45 678,90", -45678.9), ("(2.500,00)", -2500), ("1.234,50-", -1234.5),
           ("1,234.50 CR", -1234.5), ("1,234.50 DR", 1234.5), ("−1.000,00", -1000),
           ("1 234,50", 1234.5), ("0,00", 0), ("", None), ("n/a", None), ("-", None),
           (None, None)]


def test_amounts_staged_and_single(spark):
    df = spark.createDataFrame([(a,) for a, _ in AMOUNTS], "s string")
    staged = [r["a"] for r in with_amounts(df, {"a": "s"}).collect()]
    single = [r[0] for r in df.select(parse_amount("s")).collect()]
    for (text, want), got1, got2 in zip(AMOUNTS, staged, single):
        for got in (got1, got2):
            if want is None:
                assert got is None, text
            else:
                assert float(got) == pytest.approx(want), text


def test_period_keys(spark):
    vals = ["2025-06", "2025/06", "202506", "06.2025", "2025-06-30", "June", "2025", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(period_key("s")).collect()]
    assert got == [202506] * 5 + [None] * 4


def test_dc_and_category(spark):
    df = spark.createDataFrame([("H", "cogs"), ("S", " opex "), ("x", "revenue")], "m string, c string")
    rows = df.select(dc_sign("m").alias("s"), canonical_category("c").alias("c")).collect()
    assert [r.s for r in rows] == [-1, 1, 1]
    assert [r.c for r in rows] == ["COGS", "OpEx", "Revenue"]


def test_header_fold_and_totals(spark):
    df = spark.createDataFrame([("Költséghely", "Total", ""), ("GL Code", "Net interest", "7000"),
                                ("Számla", "Összesen:", "4000"), ("x", "Sales total", "")],
                               "h string, n string, c string")
    rows = df.select(normalise_header("h").alias("h"),
                     looks_like_total("n", "c").alias("t")).collect()
    assert [r.h for r in rows] == ["koltseghely", "gl code", "szamla", "x"]
    assert [r.t for r in rows] == [True, False, True, True]


def _one(spark, **cols):
    names = ", ".join(f"{k} {v[1]}" for k, v in cols.items())
    return spark.createDataFrame([tuple(v[0] for v in cols.values())], names)


@pytest.mark.parametrize("act,bud,pct_none,mat", [
    (1030000, 1000000, False, False), (9000, 3000, False, False),
    (130000, 100000, False, True), (150000, 7, True, True), (60000, 23000, False, True)])
def test_materiality(spark, act, bud, pct_none, mat):
    df = _one(spark, a=(Decimal(act), "decimal(18,4)"), b=(Decimal(bud), "decimal(18,4)"))
    v = V.variance("a", "b")
    r = df.select(V.pct_nm(v, "b").alias("p"), V.material(v, V.pct_nm(v, "b")).alias("m")).first()
    assert (r.p is None) == pct_none
    assert r.m == mat


def test_fav_unfav(spark):
    df = spark.createDataFrame([(20000, True), (20000, False), (0, False), (0, True)], "v int, h boolean")
    got = [r[0] for r in df.select(V.favourable("v", F.col("h"))).collect()]
    assert got == ["F", "U", "F", "F"]
