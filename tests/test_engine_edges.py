"""Edges of the engine: amounts of any size, accents in either form, NULL keys,
plan joins without a window, one pass over the postings, finding texts."""
import re

import pytest
from pyspark.sql import functions as F

from varpack.functions import parse as PA
from varpack.functions.keywords import SYNONYMS
from varpack.functions.text import fold, normalise_header
from varpack.operators import classify as K
from varpack.operators import deck as D
from varpack.operators import extracts as E
from varpack.operators import findings as G
from varpack.operators import normalise as NO
from varpack.operators import pack as PK
from varpack.operators import plan as PL
from varpack.operators import reports as R
from varpack.operators import rollups as RU
from varpack.functions.measures import Materiality
from varpack.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("text,value", [
    ("123456789012345", "123456789012345"), ("0.123456", "0.123456"), ("-987.654.321.098.765,12", "-987654321098765.12"),
    ("(1,234,567,890,123.456789)", "-1234567890123.456789"), ("n/a", None), ("", None), ("abc", None)])
def test_amounts_of_any_size(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    one = PA.with_amounts(df, {"a": "t"}).first()["a"]
    three = PA.with_amounts(df, {"a": "t", "b": "t", "c": "t"}).first()
    want = None if value is None else float(value)
    assert (None if one is None else float(one)) == want
    assert one == three["a"] == three["b"] == three["c"]


def test_accents_composed_and_decomposed(spark):
    df = spark.createDataFrame([("Értékcsökkenés",), ("Értékcsökkenés",)], "x string")
    assert {r[0] for r in df.select(fold("x")).collect()} == {"ertekcsokkenes"}
    assert len({r[0] for r in df.select(K.category_from_name("x")).collect()}) == 1
    assert df.select(normalise_header("x")).distinct().count() == 1


def ledger(spark, rows):
    return spark.createDataFrame(rows, "entity string, department string, cost_centre string, account_code string, account_name string, "
                                       "category string, expense_type string, period string, period_no int, actual double, budget double, prior_year double"
                                 ).withColumns({m: F.col(m).cast("decimal(38,4)") for m in ("actual", "budget", "prior_year")})


ROWS = [
    (None, "Ops", "C1", "6100", "Salaries", "OpEx", "Salaries & wages", "2000-05", 200005, 150000.0, 100000.0, 0.0),
    (None, "Ops", "C1", "4100", "Sales", "Revenue", "", "2000-06", 200006, 500000.0, 400000.0, 0.0),
    ("A", "Ops", None, "6100", "Salaries", "OpEx", "Salaries & wages", "2000-06", 200006, 90000.0, 50000.0, 0.0),
    ("A", None, "C2", "6200", "Rent", "OpEx", "Facilities & office", "2000-06", 200006, 10000.0, 60000.0, 0.0),
    ("B", "Ops", "C1", "4100", "Sales", "Revenue", "", "2000-06", 200006, 100000.0, 180000.0, 0.0),
]


def test_null_group_keys_are_groups(spark):
    out = {(r.entity, r.account_code): r for r in R.leaf_variances(ledger(spark, ROWS), by=["entity"]).collect()}
    assert out[None, "4100"].var_bud == 100000.0 and out[None, "4100"].material is True
    assert out["A", "6200"].fav_unfav == "F"


def test_leaves_in_report_order(spark):
    got = [abs(r.var_bud) for r in R.by_size(R.leaf_variances(ledger(spark, ROWS))).collect()]
    assert got == sorted(got, reverse=True)


def test_concentration_of_huge_amounts(spark):
    big = [("A", "Ops", "C1", f"6{i}00", f"Cost {i}", "OpEx", "x", "2000-06", 200006, 1e16 * (i + 1), 1e15, 0.0) for i in range(3)]
    out = G.dimension_findings(ledger(spark, big), "department", "account_name", 200006).collect()
    assert out[0].verdict == "all" and "Cost" not in out[0].concentration_text


def test_profit_bridge_nets_all_flagged_accounts(spark):
    b = D.profit_bridge(ledger(spark, ROWS)).first()
    # Sales +20 000 in all, below its percentage floor; salaries +90 000; rent -50 000
    assert (b.revenue_shortfall, b.cost_overrun, b.impact, b.residual) == (0.0, 40000.0, -40000.0, 20000.0)
    assert b.largest_mover == "Salaries" and b.n_material == 2


def test_coverage_counts_flagged_only(spark):
    led = ledger(spark, ROWS)
    assert G.driver_coverage(RU.drivers(led, 200006, Materiality(1e9, 0.1))).collect() == []
    row = G.driver_coverage(RU.drivers(led, 200006)).first()
    assert row.n_flagged < row.n_accounts and "Sales" not in row.largest.split("|")[1:]


def test_year_on_plan_has_no_direction(spark):
    rows = [("A", "Ops", "C1", "6100", "S", "OpEx", "x", f"2000-{m:02d}", 200000 + m, a, b, 0.0)
            for m, a, b in ((1, 100000.0, 10000.0), (2, 100000.0, 10000.0), (12, 0.0, 1180000.0))]
    out = G.dimension_findings(ledger(spark, rows), "department", "account_name", 200002).first()
    assert out.fy_on_plan is True and out.fy_direction is None and out.full_year_text == G.ON_PLAN


def test_plan_join_allocates_and_keeps_plan_only_keys(spark):
    a = ledger(spark, ROWS).select("account_code", "account_name", "category", "entity", "actual")
    plan = spark.createDataFrame([("6100", None, 300.0), ("6100", "A", 90.0), ("9999", "Z", 7.0), ("4100", "B", 50.0)],
                                 "account_code string, entity string, budget double").withColumn("budget", F.col("budget").cast("decimal(38,4)"))
    got = {(r.account_code, r.entity): r.budget for r in PL.budget_join(a, plan).collect()}
    assert got["6100", ""] == 300.0 and got["6100", "A"] == 90.0 and got["9999", "Z"] == 7.0 and got["6200", "A"] == 0.0
    named = plan.withColumnRenamed("budget", "actual")
    assert {(r.account_code, r.entity): r.budget for r in PL.budget_join(a, named).collect()} == got


def test_plan_join_has_no_window(spark, capsys):
    QUERIES["j2_budget_allocate"](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["a5_department", "a6_cost_centre", "a8_expense_report", "a9_dept_cc_report", "a10_entity_report", "a14_reconcile",
                                  "a15_collapse_note", "d6_views_available", "r2_pnl_full", "r2_pnl_by_entity_period"])
def test_one_pass_over_the_postings(spark, capsys, name):
    QUERIES[name](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert len(re.findall(r"Location:.*lineitem\.parquet", plan)) == 1


def test_month_reports_push_the_month(spark, capsys):
    QUERIES["a14_reconcile"](spark, SF_SMALL).explain("formatted")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate", capsys.readouterr().out)


def test_synonyms_belong_to_one_field():
    seen = [s for words in SYNONYMS.values() for s in words]
    assert len(seen) == len(set(seen))


def test_header_below_titles_and_delimiter(spark):
    text = ["My ledger", "", "Account;Account name;Amount;", "4000;Sales;1.234,50;", "6000;Rent;100,00;", ";Total;1.334,50;"]
    lines = spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(text)], "extract_id string, line_no long, text string")
    delimiters = E.sniff_delimiters(lines)
    assert delimiters.collect()[0].delimiter == ";"
    records = E.records(lines, delimiters)
    cells = E.read_cells(records)
    heads = E.header_rows(cells, records)
    assert heads.first().header_line == 3
    data, columns = E.headed(cells, heads)
    assert [r.header for r in columns.orderBy("pos").collect()] == ["Account", "Account name", "Amount"]
    mapping = E.match_columns(columns)
    std = NO.standardise(E.mapped_texts(data, mapping)).orderBy("account_code").collect()
    assert [(r.account_code, r.category, float(r.actual)) for r in std] == [("4000", "Revenue", 1234.5), ("6000", "OpEx", 100.0)]
    assert E.missing_fields(mapping, columns).collect() == []
    assert [r.issue for r in E.guards(data, columns, mapping, NO.standardise(E.mapped_texts(data, mapping))).collect()] == ["no_budget"]


def test_finding_texts_name_no_cause(spark):
    texts = [v for k, v in vars(G).items() if k.isupper() and isinstance(v, str)]
    assert not any(re.search(r"\b(because of|due to|caused by|driven by)\b", t) for t in texts)


def test_pack_of_a_month_is_written_again_in_place(spark):
    rows = ledger(spark, ROWS)
    path = PK.write_pack(rows, 200005)
    PK.write_pack(rows, 200006, path)
    once = {p: sorted(map(tuple, PK.read_pack(spark, path, p).collect())) for p in (200005, 200006)}
    PK.write_pack(rows, 200006, path)
    assert {p: sorted(map(tuple, PK.read_pack(spark, path, p).collect())) for p in once} == once
    PK.write_pack(rows.filter("account_code = '4100'"), 200006, path)
    assert sorted(map(tuple, PK.read_pack(spark, path, 200005).collect())) == once[200005]
    assert sorted(map(tuple, PK.read_pack(spark, path, 200006).collect())) != once[200006]


@pytest.mark.parametrize("name", ["j6_ytd_detail", "j7_month_detail", "j8_history", "p4_ytd"])
def test_ranges_reach_the_scan(spark, capsys, name):
    found = [n for n in QUERIES if n.startswith(name[:3])]
    QUERIES[name if name in QUERIES else found[0]](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("GreaterThanOrEqual(l_shipdate") >= len(re.findall(r"Location:.*lineitem\.parquet", plan)) > 0


def test_reconciliation_per_group(spark):
    got = RU.reconcile(ledger(spark, ROWS), by=["entity", "period_no"]).collect()
    assert {(r.entity, r.period_no) for r in got} == {(None, 200005), (None, 200006), ("A", 200006), ("B", 200006)} and len(got) == 32
    assert {(r.lhs, r.rhs) for r in got if r.entity == "B" and r.check == "entity revenue = P&L revenue"} == {(100000.0, 100000.0)}
    blank = [r for r in got if r.entity is None and r.period_no == 200005]
    assert [r.ok for r in blank if r.check.startswith("entity net")] == [False]          # a blank entity is in no entity view
