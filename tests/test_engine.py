"""Engine behaviour on small hand-made frames (reference audit cases)."""
from decimal import Decimal

from pyspark.sql import functions as F

from varpack.operators import normalise as NO
from varpack.operators import plan as PL
from varpack.operators import reports as R
from varpack.operators.aggregate import account_cube

SCHEMA = ("account_code string, account_name string, category string, "
          "actual decimal(18,4), budget decimal(18,4), prior_year decimal(18,4)")


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[:3]) + tuple(Decimal(x) for x in r[3:]) for r in rows], SCHEMA)


def test_pnl_fu_and_seven_lines(spark):
    gl = frame(spark, [("4000", "Sales", "Revenue", 120000, 100000, 90000),
                       ("6000", "Rent", "OpEx", 120000, 100000, 90000)])
    rep = {r.line: r for r in R.build_report(gl).collect()}
    assert len(rep) == 7
    assert rep["Revenue"].fav_unfav == "F"
    assert rep["Operating expenses"].fav_unfav == "U"
    assert rep["Net income"].actual == 0.0


def test_one_line_file_gives_seven_lines_and_zero_flags_nothing(spark):
    gl = frame(spark, [("4000", "Sales", "Revenue", 0, 0, 0)])
    rep = R.build_report(gl).collect()
    assert len(rep) == 7 and not any(r.material for r in rep)


def test_no_plan_gates_variances(spark):
    gl = frame(spark, [("4000", "Sales", "Revenue", 500, 0, 400)])
    r = [x for x in R.build_report(gl).collect() if x.line == "Revenue"][0]
    assert r.budget is None and r.var_bud is None and r.fav_unfav == "" and not r.material
    assert r.var_py == 100.0


def test_sign_rule(spark):
    gl = frame(spark, [("4000", "A", "Revenue", -500000, 0, 0), ("4010", "B", "Revenue", -300000, 0, 0),
                       ("6000", "C", "OpEx", 100000, 0, 0), ("6010", "D", "OpEx", 80000, 0, 0),
                       ("6020", "E", "OpEx", -250000, 0, 0)])
    out = NO.normalise_signs(gl).groupBy("category").agg(F.sum("actual").alias("a"))
    got = {r.category: float(r.a) for r in out.collect()}
    assert got == {"Revenue": 800000.0, "OpEx": -70000.0}


def test_cube_collapses(spark):
    df = spark.createDataFrame(
        [("6000", "Rent", "OpEx", "A", Decimal(10)), ("6000", "Rent", "OpEx", "A", Decimal(20)),
         ("6000", "Rent", "OpEx", "B", Decimal(30))],
        "account_code string, account_name string, category string, department string, actual decimal(18,4)")
    c = account_cube(df).collect()
    assert len(c) == 2 and sum(float(r.actual) for r in c) == 60.0


def test_allocation(spark):
    act = spark.createDataFrame(
        [("6000", "A", "Rent", "OpEx", Decimal(75), Decimal(0)), ("6000", "B", "Rent", "OpEx", Decimal(25), Decimal(0))],
        "account_code string, entity string, account_name string, category string, actual decimal(18,4), prior_year decimal(18,4)")
    plan = spark.createDataFrame([("6000", Decimal(200))], "account_code string, budget decimal(18,4)")
    got = sorted(r.budget for r in PL.budget_join(act, plan).collect())
    assert got == [50.0, 150.0]
