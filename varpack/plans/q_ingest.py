"""Queries for plan joins (J1-J10) and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions import parse as PA
from ..operators import aggregate as A
from ..operators import normalise as NO
from ..operators import plan as PL
from ..sources import fixture as X
from . import sqlgen as S
from .oracle_views import with_views
from .q_core import P
from .registry import register

CUBE_COLS = ["account_code", "account_name", "category", "period", "expense_type",
             "department", "cost_centre", "entity"]
JKEYS = ["account_code", "period", "department", "entity"]


def _cube(spark, sf_dir, led=None):
    led = led if led is not None else X.ledger(spark, sf_dir)
    return led.groupBy(*CUBE_COLS).agg(A.dsum(F.col("actual")).alias("actual"),
                                      A.dsum(F.col("budget")).alias("budget"),
                                      A.dsum(F.col("prior_year")).alias("prior_year"))


def _join_out(df):
    return df.select(*CUBE_COLS, "period_no", V.money("actual").alias("actual"),
                     V.money("prior_year").alias("prior_year"),
                     F.col("budget").cast("double").alias("budget"))


_ACUBE = ("a AS (SELECT " + ", ".join(CUBE_COLS) + ", sum(actual) AS actual, "
          "sum(prior_year) AS prior_year FROM ledger GROUP BY " + ", ".join(CUBE_COLS) + ")")


def _join_sql(plan: str, allocate: bool, acube: str = "a") -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in JKEYS)
    keys = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in JKEYS)
    part = ", ".join(JKEYS)
    bud = ("CAST(budget AS DOUBLE) * CASE WHEN tot > 0 THEN CAST(abs(actual) AS DOUBLE) / tot "
           "ELSE 1.0 / n END" if allocate else "CAST(budget AS DOUBLE)")
    cat = ("CASE WHEN coalesce(trim(category), '') = '' THEN CASE substr(account_code, 1, 1) "
           "WHEN '4' THEN 'Revenue' WHEN '5' THEN 'COGS' WHEN '6' THEN 'OpEx' WHEN '7' THEN 'Other' "
           "ELSE 'OpEx' END ELSE trim(category) END")
    name = ("CASE WHEN coalesce(trim(account_name), '') = '' THEN account_code "
            "ELSE trim(account_name) END")
    return (f"WITH b AS (SELECT {part}, sum(budget) AS budget FROM {plan} GROUP BY {part}), "
            f"j AS (SELECT {keys}, a.account_name, a.category, a.expense_type, a.cost_centre, "
            f"a.actual, a.prior_year, b.budget FROM {acube} a FULL OUTER JOIN b ON {on}), "
            f"w AS (SELECT j.*, CAST(sum(abs(coalesce(actual, 0))) OVER (PARTITION BY {part}) AS DOUBLE) "
            f"AS tot, CAST(count(*) OVER (PARTITION BY {part}) AS DOUBLE) AS n FROM j) "
            f"SELECT account_code, {name} AS account_name, {cat} AS category, "
            "coalesce(trim(period), '') AS period, coalesce(trim(expense_type), '') AS expense_type, "
            "coalesce(trim(department), '') AS department, coalesce(trim(cost_centre), '') AS cost_centre, "
            "coalesce(trim(entity), '') AS entity, "
            "CAST(CAST(substr(regexp_replace(period, '[^0-9]', '', 'g'), 1, 4) AS INT) * 100 + "
            "CAST(substr(regexp_replace(period, '[^0-9]', '', 'g'), 5, 2) AS INT) AS INT) AS period_no, "
            + S.money("coalesce(actual, 0)") + " AS actual, " + S.money("coalesce(prior_year, 0)")
            + f" AS prior_year, coalesce({bud}, 0) AS budget FROM w")


@register("j1_budget_join", with_views(_join_sql("plan", False), "plan", extra=[_ACUBE]))
def j1_budget_join(spark, sf_dir):
    return _join_out(PL.budget_join(_cube(spark, sf_dir), X.plan(spark, sf_dir), allocate=False))


@register("j2_budget_allocate", with_views(_join_sql("plan", True), "plan", extra=[_ACUBE]))
def j2_budget_allocate(spark, sf_dir):
    return _join_out(PL.budget_join(_cube(spark, sf_dir), X.plan(spark, sf_dir)))


_ACUBE_NO_MARCH = _ACUBE.replace("a AS (", "a0 AS (").replace(
    "FROM ledger GROUP BY", "FROM ledger WHERE period_no <> 200003 GROUP BY")


@register("j3_plan_only", with_views(
    "SELECT * FROM (" + _join_sql("plan", True, acube="a0") + ") q WHERE actual = 0",
    "plan", extra=[_ACUBE_NO_MARCH]))
def j3_plan_only(spark, sf_dir):
    led = X.ledger(spark, sf_dir).filter(F.col("period_no") != 200003)
    merged = PL.budget_join(_cube(spark, sf_dir, led), X.plan(spark, sf_dir))
    return _join_out(merged).filter(F.col("actual") == 0)


@register("j4_plan_gap", with_views(
    "SELECT DISTINCT trim(period) AS period FROM ledger WHERE trim(period) <> '' "
    "AND trim(period) NOT IN (SELECT trim(period) FROM plan_gappy)", "ledger", "plan_gappy"))
def j4_plan_gap(spark, sf_dir):
    return PL.plan_gap(X.ledger(spark, sf_dir), X.plan_gappy(spark, sf_dir))


@register("j5_unmatched", with_views(
    "SELECT count(*) FILTER (WHERE actual = 0) AS budget_only_lines, "
    "count(*) FILTER (WHERE budget = 0) AS actual_only_lines FROM ("
    + _join_sql("plan_gappy", True) + ") q", "plan_gappy", extra=[_ACUBE]))
def j5_unmatched(spark, sf_dir):
    merged = PL.budget_join(_cube(spark, sf_dir), X.plan_gappy(spark, sf_dir))
    return PL.unmatched_counts(merged)


def _outer_sql(keys, plan, lo, hi):
    k = ", ".join(keys)
    return (f"SELECT {k}, {S.money('coalesce(a.actual, 0)')} AS actual, "
            f"{S.money('coalesce(b.budget, 0)')} AS budget FROM "
            f"(SELECT {k}, sum(actual) AS actual FROM ledger WHERE period_no BETWEEN {lo} AND {hi} "
            f"GROUP BY {k}) a FULL OUTER JOIN (SELECT {k}, sum(budget) AS budget FROM {plan} "
            f"WHERE period_no BETWEEN {lo} AND {hi} GROUP BY {k}) b USING ({k})")


def _outer_out(df, keys):
    return df.select(*keys, V.money("actual").alias("actual"), V.money("budget").alias("budget"))


@register("j6_ytd_detail", with_views(
    _outer_sql(["entity", "department", "account_code"], "plan", 200001, P), "plan"))
def j6_ytd_detail(spark, sf_dir):
    keys = ["entity", "department", "account_code"]
    span = (200001, P)
    return _outer_out(PL.detail_outer(X.ledger(spark, sf_dir, months=span), X.plan(spark, sf_dir, months=span), keys,
                                      period_to=P, period_from=200001), keys)


@register("j7_month_detail", with_views(
    "SELECT b.entity, b.department, b.account_code, " + S.money("b.budget") + " AS budget, "
    + S.money("coalesce(a.actual, 0)") + " AS actual FROM "
    f"(SELECT entity, department, account_code, sum(budget) AS budget FROM plan WHERE period_no = {P} "
    "GROUP BY entity, department, account_code) b LEFT JOIN "
    f"(SELECT entity, department, account_code, sum(actual) AS actual FROM ledger WHERE period_no = {P} "
    "GROUP BY entity, department, account_code) a USING (entity, department, account_code)", "plan"))
def j7_month_detail(spark, sf_dir):
    keys = ["entity", "department", "account_code"]
    j = PL.plan_left_actuals(X.plan(spark, sf_dir, months=(P, P)), X.ledger(spark, sf_dir, months=(P, P)), keys, P)
    return j.select(*keys, V.money("budget").alias("budget"), V.money("actual").alias("actual"))


@register("j8_history", with_views(
    _outer_sql(["department", "period_no"], "plan_gappy", 200001, P), "plan_gappy"))
def j8_history(spark, sf_dir):
    keys = ["department", "period_no"]
    span = (200001, P)
    return _outer_out(PL.detail_outer(X.ledger(spark, sf_dir, months=span), X.plan_gappy(spark, sf_dir, months=span), keys,
                                      period_to=P, period_from=200001), keys)


@register("j9_driver_frame", with_views(
    "SELECT account_code, account_name, category, "
    + S.money(f"sum(CASE WHEN period_no = {P} THEN actual ELSE 0 END)") + " AS act, "
    + S.money(f"sum(CASE WHEN period_no = {P} THEN budget ELSE 0 END)") + " AS bud, "
    + S.money(f"sum(CASE WHEN period_no <= {P} THEN actual ELSE 0 END)") + " AS yact, "
    + S.money(f"sum(CASE WHEN period_no <= {P} THEN budget ELSE 0 END)") + " AS ybud "
    "FROM fy GROUP BY account_code, account_name, category", "fy"))
def j9_driver_frame(spark, sf_dir):
    from .q_core import fy_frame
    f = A.five_figures(fy_frame(spark, sf_dir), ["account_code", "account_name", "category"], P)
    return f.select("account_code", "account_name", "category",
                    *[V.money(c).alias(c) for c in ("act", "bud", "yact", "ybud")])


@register("j10_parent_lookup", with_views(
    "SELECT cost_centre, min(department) AS department FROM ledger "
    "WHERE cost_centre IS NOT NULL GROUP BY cost_centre", "ledger"))
def j10_parent_lookup(spark, sf_dir):
    return PL.parent_lookup(X.ledger(spark, sf_dir), "cost_centre", "department")


# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------

_EXPECTED = ("CASE WHEN conv <= 3 THEN -CAST(cents AS DOUBLE) / 100 "
             "WHEN conv <= 5 THEN CAST(cents AS DOUBLE) / 100 END")


@register("n1_parse_amount", with_views(
    f"SELECT doc_no, line_no, conv, {_EXPECTED} AS amount FROM ledger_raw", "ledger_raw"))
def n1_parse_amount(spark, sf_dir):
    raw = PA.with_amounts(X.ledger_raw(spark, sf_dir), {"amount": "amount_text"})
    return raw.select("doc_no", "line_no", "conv", F.col("amount").cast("double").alias("amount"))


@register("n1_parse_quality", with_views(
    "SELECT conv, count(*) AS n, count(*) FILTER (WHERE conv = 6) AS n_null, "
    "CAST(0 AS BIGINT) AS n_wrong FROM ledger_raw GROUP BY conv", "ledger_raw"))
def n1_parse_quality(spark, sf_dir):
    raw = PA.with_amounts(X.ledger_raw(spark, sf_dir), {"amount": "amount_text"})
    c = F.col("cents").cast("double")
    expected = F.when(F.col("conv") <= 3, -c / 100).when(F.col("conv") <= 5, c / 100)
    wrong = ~F.col("amount").cast("double").eqNullSafe(expected)
    return raw.groupBy("conv").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("amount").isNull()).alias("n_null"),
                                   F.count_if(wrong).alias("n_wrong"))


_CAT_SUMS = lambda src, e: (
    f"SELECT category, {S.money(f'sum({e})')} AS actual FROM {src} GROUP BY category")


@register("n2_debit_credit", with_views(
    _CAT_SUMS("ledger", "CASE WHEN category = 'Revenue' THEN -actual ELSE actual END"), "ledger"))
def n2_debit_credit(spark, sf_dir):
    tb = X.ledger_tb(spark, sf_dir)
    d = tb.withColumn("actual", PA.debit_minus_credit(F.col("debit"), F.col("credit")))
    return d.groupBy("category").agg(V.money(F.sum("actual")).alias("actual"))


@register("n3_dc_sign", with_views(
    _CAT_SUMS("ledger", "CASE WHEN category = 'Revenue' THEN -abs(actual) ELSE abs(actual) END"),
    "ledger"))
def n3_dc_sign(spark, sf_dir):
    dc = X.ledger_dc(spark, sf_dir)
    d = dc.withColumn("actual", PA.signed_by_marker(F.col("amount"), F.col("dc_indicator")))
    return d.groupBy("category").agg(V.money(F.sum("actual")).alias("actual"))


@register("n4_category", with_views(
    "SELECT category, count(*) AS n FROM ledger GROUP BY category", "ledger"))
def n4_category(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    variant = F.col("line_no") % 3     # three spellings of the same label
    raw = (F.when(variant == 0, F.lower("category")).when(variant == 1, F.upper("category"))
            .otherwise(F.concat(F.lit("  "), F.col("category"), F.lit(" "))))
    return (led.select(PA.canonical_category(raw).alias("category"))
               .groupBy("category").agg(F.count(F.lit(1)).alias("n")))


@register("n5_dims", with_views(
    "SELECT CASE WHEN line_no IN (1, 2) THEN '' ELSE cost_centre END AS cost_centre, count(*) AS n "
    "FROM ledger GROUP BY 1", "ledger"))
def n5_dims(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    raw = (F.when(F.col("line_no") == 1, F.lit(None)).when(F.col("line_no") == 2, F.lit("nan"))
            .otherwise(F.concat(F.lit(" "), F.col("cost_centre"), F.lit(" "))))
    return (led.select(PA.clean_dimension(raw).alias("cost_centre"))
               .groupBy("cost_centre").agg(F.count(F.lit(1)).alias("n")))


@register("n6_null_amounts", with_views(
    "SELECT conv, count(*) AS n, " + S.money(f"sum({_EXPECTED})") + " AS actual, "
    + S.money(f"sum(CASE WHEN conv = 5 THEN 0 ELSE {_EXPECTED} END)") + " AS budget "
    "FROM ledger_raw WHERE conv <> 6 GROUP BY conv", "ledger_raw"))
def n6_null_amounts(spark, sf_dir):
    raw = X.ledger_raw(spark, sf_dir).withColumn(
        "budget_text", F.when(F.col("conv") >= 5, F.lit(None)).otherwise(F.col("amount_text")))
    d = PA.with_amounts(raw, {"actual": "amount_text", "budget": "budget_text"})
    kept = NO.drop_null_amounts(d)
    return kept.groupBy("conv").agg(F.count(F.lit(1)).alias("n"),
                                    V.money(F.sum("actual")).alias("actual"),
                                    V.money(F.sum("budget")).alias("budget"))


@register("n7_total_rows", with_views(
    "SELECT department, count(*) FILTER (WHERE account_name = 'Total') AS total_rows, "
    "count(*) FILTER (WHERE account_name = 'Suspense') AS empty_rows, "
    "count(*) FILTER (WHERE account_name NOT IN ('Total', 'Suspense')) AS kept_rows, "
    + S.money("sum(actual) FILTER (WHERE account_name NOT IN ('Total', 'Suspense'))")
    + " AS kept_actual FROM ledger_printed GROUP BY department", "ledger_printed"))
def n7_total_rows(spark, sf_dir):
    k = NO.row_kinds(X.ledger_printed(spark, sf_dir))
    kept = ~F.col("_total") & ~F.col("_empty")
    return k.groupBy("department").agg(
        F.count_if(F.col("_total")).alias("total_rows"), F.count_if(F.col("_empty")).alias("empty_rows"),
        F.count_if(kept).alias("kept_rows"),
        V.money(F.sum(F.when(kept, F.col("actual")))).alias("kept_actual"))


@register("n8_empty_rows", with_views(
    "SELECT department, count(*) AS kept_rows, " + S.money("sum(actual)") + " AS actual "
    "FROM ledger GROUP BY department", "ledger"))
def n8_empty_rows(spark, sf_dir):
    kept = NO.drop_non_account_rows(X.ledger_printed(spark, sf_dir))
    return kept.groupBy("department").agg(F.count(F.lit(1)).alias("kept_rows"),
                                          V.money(F.sum("actual")).alias("actual"))


@register("n9_sign_norm", with_views(
    "SELECT category, " + S.money("sum(actual)") + " AS actual, " + S.money("sum(budget)")
    + " AS budget FROM ledger GROUP BY category", "ledger"))
def n9_sign_norm(spark, sf_dir):
    n = NO.normalise_signs(X.ledger_credit(spark, sf_dir))
    return n.groupBy("category").agg(V.money(F.sum("actual")).alias("actual"),
                                     V.money(F.sum("budget")).alias("budget"))


def _flip_sql(col):
    return (f"SELECT category, '{col}' AS \"column\" FROM ledger_credit GROUP BY category "
            f"HAVING count(*) FILTER (WHERE {col} <> 0) > 0 AND sum({col}) < 0 AND "
            f"((count(*) FILTER (WHERE {col} <> 0) >= 2 AND CAST(count(*) FILTER (WHERE {col} < 0) AS DOUBLE) "
            f"/ count(*) FILTER (WHERE {col} <> 0) >= 0.7) OR (count(*) FILTER (WHERE {col} <> 0) = 1 "
            f"AND category = 'Revenue'))")


@register("n9_sign_log", with_views(
    " UNION ALL ".join(_flip_sql(c) for c in ("actual", "budget", "prior_year")), "ledger_credit"))
def n9_sign_log(spark, sf_dir):
    return NO.sign_log(X.ledger_credit(spark, sf_dir))


_VARIANTS = [
    ("dash", "period"),
    ("slash", "replace(period, '-', '/')"),
    ("compact", "replace(period, '-', '')"),
    ("month_first", "concat(substr(period, 6, 2), '.', substr(period, 1, 4))"),
    ("date", "concat(period, '-28')"),
]


@register("n10_period_key", with_views(
    " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS form, {e} AS label, period_no AS period_key FROM ledger"
                       for n, e in _VARIANTS), "ledger"))
def n10_period_key(spark, sf_dir):
    p = X.ledger(spark, sf_dir).select("period").distinct()
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.expr(e).alias("label"))
                      for n, e in _VARIANTS])
    x = p.select(F.inline(forms))
    return x.select("form", "label", PA.period_key("label").alias("period_key"))
