"""The catalogue of extracts at size: texts are not shuffled, amounts are printed
without a formatter, cells are counted with their row."""
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from varpack.operators import extracts as E
from varpack.sources import extracts as XT
from varpack.session import written as keep

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _tables(spark, path, postings):
    """A star schema of one order per region; postings are (order, line number, price)."""
    when = datetime(2001, 2, 3)
    made = {"region": ([(i, r) for i, r in enumerate(REGIONS)], "r_regionkey int, r_name string"),
            "nation": ([(i, i) for i in range(5)], "n_nationkey int, n_regionkey int"),
            "customer": ([(i, i, "BUILDING") for i in range(5)], "c_custkey long, c_nationkey int, c_mktsegment string"),
            "orders": ([(i, i % 5) for i in range(15)], "o_orderkey long, o_custkey long"),
            "part": ([(1, "STANDARD", 3), (2, "SMALL", 4)], "p_partkey long, p_type string, p_size int"),
            "lineitem": ([(o, n, 1 + (o + (n or 0)) % 2, when, p, 0.1, 0.05) for o, n, p in postings],
                         "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_extendedprice double, l_discount double, l_tax double")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _lines(spark, path, monkeypatch, number=None):
    """The lines, sorted, and the plans of what was written for them."""
    plans = []
    monkeypatch.setattr(XT, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    if number:
        monkeypatch.setattr(XT, "_numbered", lambda *_: number)
    return sorted(map(tuple, XT.extract_lines(spark, path).collect()), key=str), plans


def test_postings_are_ranked_where_they_were_joined(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    path = _tables(spark, tmp_path, [(o, n, p) for o in range(15) for n in (0, 1, 9) for p in (10.0, 1234567.5, 10.0)[:1 + o % 3]])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with monkeypatch.context() as m:
            got, plans = _lines(spark, path, m)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "line_id" not in "".join(x for x in plans[0].split("\n") if "Exchange" in x)
    assert got == _lines(spark, path, monkeypatch, ["line_id"])[0] and len(got) > 90


def test_posting_numbers_that_meet_across_orders(spark, tmp_path, monkeypatch):
    """Line 51 of order 0, or line -49 of order 5, has the number of the other's line 1:
    they are ranked together, so no line number comes twice."""
    for i, odd in enumerate([(0, 51), (5, -49), (5, None)]):
        path = _tables(spark, tmp_path / str(i), [(o, 1, 5.0 + o) for o in range(15)] + [(*odd, 7.0), (*odd, 6.0)])
        assert XT._numbered(spark, path) == ["line_id"]
        with monkeypatch.context() as m:
            got, _ = _lines(spark, path, m)
        numbers = [r[:2] for r in got if r[1] is not None]
        assert len(numbers) == len(set(numbers)) and sum("BUILDING" in r[2] for r in got) == 17


def test_amounts_are_printed_by_length(spark):
    texts = ["0", "-0.5", "7.005", "999.99", "-999.99", "1000", "-1000", "12345.6", "999999.99", "-999999.99", "1000000", "-1234567.89", "12345678901234.56", None]
    df = spark.createDataFrame([(e, None if t is None else Decimal(t)) for e in REGIONS for t in texts], "entity string, a decimal(24,4)")
    out = XT._printed(df, {"p": "a"})
    assert out.columns == ["entity", "a", "p_plain", "p"]
    us = F.format_number(F.col("a").cast("decimal(18,2)"), 2)
    want = F.when(F.col("entity").isin("AFRICA", "ASIA"), us).otherwise(F.translate(us, ",.", ".,"))
    rows = out.select("p", want.alias("want"), "p_plain", F.col("a").cast("decimal(18,2)").cast("string").alias("plain")).collect()
    assert [(r.p, r.p_plain) for r in rows] == [(r.want, r.plain) for r in rows] and len({r.p for r in rows}) > 20
    assert "format_number" not in out._jdf.queryExecution().executedPlan().toString()


def test_cells_are_counted_with_their_row(spark):
    rows = [("a", ["x", " ", None, "", "y"] * 9), ("a", ["1"] * 17), ("a", [None, "z"]), ("a", []), ("b", [" "] * 40), ("c", ["v"] * 16), ("d", ["", "w"])]
    df = spark.createDataFrame(rows, "extract_id string, cells array<string>")
    one = (df.select("extract_id", F.posexplode("cells").alias("pos", "v")).filter(F.trim("v") != "").groupBy("extract_id", "pos").count())
    got = E._filled(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    assert "posexplode(slice(" in got._jdf.queryExecution().optimizedPlan().toString()
