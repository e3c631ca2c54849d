"""Queries for commentary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commentary as T
from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.structure import LINE_OF_CATEGORY
from ..operators import commentary as C
from ..sources import fixture as X
from . import sqlgen as S
from . import text_sql as TX
from .oracle_views import with_views
from .q_core import GRAIN, P, _leaf, fy_frame, month_frame
from .registry import register

_G = ", ".join(GRAIN)
_LEAF = (f"leaf AS (SELECT {_G}, sum(actual) AS actual, sum(budget) AS budget, "
         f"sum(prior_year) AS prior_year FROM ledger GROUP BY {_G})")


_mag_sql, _pct_sql = TX.mag, TX.pct


@register("t1_mag", with_views(
    f"SELECT {_G}, {_mag_sql('actual - budget')} AS var_text, {_mag_sql('actual')} AS actual_text FROM leaf",
    "ledger", extra=[_LEAF]))
def t1_mag(spark, sf_dir):
    return _leaf(spark, sf_dir).select(*GRAIN, T.mag(F.col("actual") - F.col("budget")).alias("var_text"),
                                       T.mag("actual").alias("actual_text"))


@register("t2_pct", with_views(
    f"SELECT {_G}, {_pct_sql(S.pct('actual - budget', 'budget'))} AS pct_text FROM leaf",
    "ledger", extra=[_LEAF]))
def t2_pct(spark, sf_dir):
    return _leaf(spark, sf_dir).select(
        *GRAIN, T.pct_text(V.pct_nm(V.variance("actual", "budget"), "budget")).alias("pct_text"))


@register("t3_join_names", with_views(
    "SELECT category, " + TX.join("items") + " AS names FROM (SELECT category, list(lower(account_name) ORDER BY account_code, "
    "lower(account_name)) AS items FROM (SELECT DISTINCT category, account_code, account_name FROM ledger) GROUP BY category)", "ledger"))
def t3_join_names(spark, sf_dir):
    """Accounts of each category joined for prose, in code order (one name per
    account of the chart)."""
    acc = X.ledger(spark, sf_dir).select("category", "account_code", "account_name").distinct()
    g = acc.groupBy("category").agg(F.sort_array(F.collect_list(F.struct(
        "account_code", F.lower("account_name").alias("n")))).alias("items"))
    return g.select("category", T.join_names(F.col("items.n")).alias("names"))


@register("t4_prose", with_views(
    "SELECT DISTINCT x AS name, CASE WHEN NOT regexp_matches(trim(x), '\\p{Ll}') AND regexp_matches(trim(x), '\\p{Nd}') "
    "AND regexp_matches(trim(x), '\\p{L}') AND NOT contains(trim(x), ' ') THEN trim(x) ELSE lower(trim(x)) END AS prose "
    "FROM (SELECT account_name AS x FROM ledger UNION ALL SELECT cost_centre FROM ledger "
    "UNION ALL SELECT upper(account_name) FROM ledger) t", "ledger"))
def t4_prose(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    names = (led.select(F.col("account_name").alias("x"))
                .unionByName(led.select(F.col("cost_centre").alias("x")))
                .unionByName(led.select(F.upper("account_name").alias("x"))))
    return names.distinct().select(F.col("x").alias("name"), T.prose_name("x").alias("prose"))


_clause_sql = TX.clause


@register("t5_clause", with_views(
    f"SELECT {_G}, " + _clause_sql("(actual - budget)", S.pct("actual - budget", "budget"),
                                   "CASE WHEN " + S.fu("(actual - budget)", "(category = 'Revenue')")
                                   + " = 'F' THEN 'favourable' ELSE 'unfavourable' END") + " AS clause FROM leaf",
    "ledger", extra=[_LEAF]))
def t5_clause(spark, sf_dir):
    v = V.variance("actual", "budget")
    fu = V.favourable(v, V.higher_is_better_for_category("category"))
    return _leaf(spark, sf_dir).select(*GRAIN, T.clause(v, V.pct_nm(v, "budget"), T.fu_word(fu)).alias("clause"))


# ---------------------------------------------------------------------------
# Two horizons and the names that drive them
# ---------------------------------------------------------------------------

LOW = Materiality(1000.0, 0.005)
_LINE_CATEGORY = "CASE line " + " ".join(f"WHEN '{l}' THEN '{c}'" for c, l in LINE_OF_CATEGORY.items()) + " END"


def _driver_text(names: str, n_fu: str) -> str:
    return (f"concat(' ', CASE WHEN {n_fu} > 1 THEN 'Offsetting movements in' ELSE 'Driven by' END, ' ', {TX.join(names)}, '.')")


def _account_pool(keys: list[str], horizon: str, a: str, b: str, rule: Materiality) -> str:
    """Material accounts per category on one horizon; none without a plan."""
    v, k = f"({a} - {b})", "".join(f"{c}, " for c in keys)
    over = f" OVER (PARTITION BY {', '.join(keys)})" if keys else " OVER ()"
    return (f"SELECT {k}category, '{horizon}' AS horizon, list(lower(account_name) ORDER BY abs({v}) DESC, account_code, lower(account_name)) "
            f"AS names, count(DISTINCT {S.fu(v, chr(40) + 'category = ' + chr(39) + 'Revenue' + chr(39) + chr(41))}) AS n_fu "
            f"FROM (SELECT *, sum(abs({b})){over} AS plan FROM ac) q "
            f"WHERE plan > 0 AND {S.material(v, S.pct(v, b), rule.abs_floor, rule.pct_floor)} GROUP BY {k}category")


def _line_comments(by: list[str], rule: Materiality) -> list[str]:
    k = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"p.{c} IS NOT DISTINCT FROM r.{c}" for c in by] + ["p.category = r.category", "p.horizon = r.horizon"])
    mm, ym = "r.flag IN ('BOTH', 'MONTH')", "r.flag IN ('BOTH', 'YTD')"
    text = TX.two_horizon("r.var_bud", "round(r.var_bud_pct, 4)", mm, "r.ytd_var", "round(r.ytd_pct, 4)", ym, TX.word("r.fav_unfav"))
    return [f"ac AS (SELECT {k}account_code, account_name, category, {S.five_sums_sql()} FROM fy GROUP BY {k}account_code, account_name, category)",
            "pool AS (" + _account_pool(by, "month", "act", "bud", rule) + " UNION ALL " + _account_pool(by, "ytd", "yact", "ybud", rule) + ")",
            "rep AS (" + S.pnl_full_sql("fy", by, abs_floor=rule.abs_floor, pct_floor=rule.pct_floor) + ")",
            f"rl AS (SELECT *, {_LINE_CATEGORY} AS category, CASE WHEN flag = 'MONTH' THEN 'month' ELSE 'ytd' END AS horizon FROM rep)",
            f"cm AS (SELECT {''.join(f'r.{c}, ' for c in by)}r.line_ord, r.line, trim(CASE WHEN r.fav_unfav IS NOT NULL THEN concat({text}, "
            f"CASE WHEN r.flag <> '' AND len(p.names) > 0 THEN {_driver_text('p.names', 'p.n_fu')} ELSE '' END) "
            f"ELSE concat({TX.mag('r.actual')}, ' actual; no budget supplied.') END) AS comment FROM rl r LEFT JOIN pool p ON {on})"]


def _rollup(parent: str, child: str, source: str, hib: str, rule: Materiality, by: list[str]) -> list[str]:
    key = [*by, "parent"]
    k = ", ".join(key)

    def horizon(h: str, a: str, b: str, n: str) -> str:
        v = f"({a} - {b})"
        mat = S.material(v, S.pct(v, b), rule.abs_floor, rule.pct_floor)
        name = TX.prose("CAST(child AS VARCHAR)")
        return (f"SELECT {k}, '{h}' AS horizon, count(*) AS n_children, list({name} ORDER BY CAST(child AS VARCHAR)) FILTER (WHERE {mat}) AS names, "
                f"count(DISTINCT {S.fu(v, hib)}) FILTER (WHERE {mat}) AS n_fu FROM ch WHERE {n} > 0 GROUP BY {k}")

    mv, yv = "(q.a - q.b)", "(q.ya - q.yb)"
    mp, yp = S.pct("q.a - q.b", "q.b"), S.pct("q.ya - q.yb", "q.yb")
    mm, ym = S.material(mv, mp, rule.abs_floor, rule.pct_floor), S.material(yv, yp, rule.abs_floor, rule.pct_floor)
    cond = " AND ".join([f"p.{c} IS NOT DISTINCT FROM q.{c}" for c in key]
                        + [f"p.horizon = CASE WHEN {mm} AND NOT {ym} THEN 'month' ELSE 'ytd' END"])
    sums = (f"sum(CASE WHEN period_no = {P} THEN actual ELSE 0 END) AS a, sum(CASE WHEN period_no = {P} THEN budget ELSE 0 END) AS b, "
            f"count(*) FILTER (WHERE period_no = {P}) AS n, sum(CASE WHEN period_no <= {P} THEN actual ELSE 0 END) AS ya, "
            f"sum(CASE WHEN period_no <= {P} THEN budget ELSE 0 END) AS yb, count(*) FILTER (WHERE period_no <= {P}) AS yn")
    return [f"ch AS (SELECT {''.join(f'{c}, ' for c in by)}{parent} AS parent, {child} AS child, {sums} FROM {source} GROUP BY ALL)",
            f"par AS (SELECT {k}, sum(a) AS a, sum(b) AS b, sum(n) AS n, sum(ya) AS ya, sum(yb) AS yb FROM ch GROUP BY {k} HAVING sum(n) > 0)",
            "pool AS (" + horizon("month", "a", "b", "n") + " UNION ALL " + horizon("ytd", "ya", "yb", "yn") + ")",
            f"cm AS (SELECT {', '.join('q.' + c for c in key)}, trim(concat(" + TX.two_horizon(mv, mp, mm, yv, yp, ym, TX.word(S.fu(mv, hib)))
            + f", CASE WHEN ({mm} OR {ym}) AND p.n_children >= 2 AND len(p.names) > 0 THEN {_driver_text('p.names', 'p.n_fu')} ELSE '' END)) AS comment "
            f"FROM par q LEFT JOIN pool p ON {cond})"]


_SPEND = "sp AS (SELECT * FROM fy WHERE category <> 'Revenue')"


@register("t7_line_comments", with_views("SELECT line_ord, line, comment FROM cm", "fy",
                                         extra=[S.signs_cte(), *_line_comments([], LOW)]))
def t7_line_comments(spark, sf_dir):
    return C.line_comments(fy_frame(spark, sf_dir), P, LOW)


@register("t7_by_entity", with_views("SELECT entity, line_ord, line, comment FROM cm", "fy",
                                     extra=[S.signs_cte(), *_line_comments(["entity"], Materiality())]))
def t7_by_entity(spark, sf_dir):
    return C.line_comments(fy_frame(spark, sf_dir), P, by=["entity"])


@register("t8_rollup_comments", with_views("SELECT entity, parent AS department, comment FROM cm", "fy",
                                           extra=[_SPEND, *_rollup("department", "cost_centre", "sp", "false", LOW, ["entity"])]))
def t8_rollup_comments(spark, sf_dir):
    spend = fy_frame(spark, sf_dir).filter(F.col("category") != "Revenue")
    return C.rollup_comments(spend, "department", "cost_centre", P, rule=LOW, by=["entity"])


@register("t9_total_comment", with_views("SELECT comment FROM cm", "fy",
                                         extra=[_SPEND, *_rollup("'total'", "department", "sp", "false", LOW, [])]))
def t9_total_comment(spark, sf_dir):
    spend = fy_frame(spark, sf_dir).filter(F.col("category") != "Revenue")
    return C.total_comment(spend, "department", P, rule=LOW)


# ---------------------------------------------------------------------------
# The narrative
# ---------------------------------------------------------------------------

def _narrative(rule: Materiality) -> list[str]:
    short = {"rev": "Revenue", "cogs": "Cost of goods sold", "gp": "Gross profit", "opex": "Operating expenses",
             "ebit": "Operating income (EBIT)", "ni": "Net income"}
    wide = ", ".join(f"max({c}) FILTER (WHERE line = '{l}') AS {s}_{t}" for s, l in short.items()
                     for c, t in (("actual", "a"), ("var_bud", "v"), ("var_bud_pct", "p"), ("fav_unfav", "fu")))
    side = lambda v: f"CASE WHEN {v} >= 0 THEN 'above' ELSE 'below' END"
    move = lambda s: f"{TX.mag(s + '_v')}, ' (', {TX.pct(s + '_p')}, ') ', {side(s + '_v')}"
    w = TX.word("ni_fu")
    p1 = (f"concat(CASE WHEN ni_a < 0 THEN concat('A net loss of ', {TX.mag('ni_a')}) ELSE concat('Net income of ', {TX.mag('ni_a')}) END, "
          f"' came in ', {move('ni')}, ' budget, ', CASE WHEN left({w}, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END, ' ', {w}, "
          f"' result. This reflects ', CASE WHEN ebit_a < 0 THEN concat('an operating loss of ', {TX.mag('ebit_a')}) "
          f"ELSE concat('operating income (EBIT) of ', {TX.mag('ebit_a')}) END, ', ', {move('ebit')}, ' plan.')")
    p2 = (f"concat('Revenue of ', {TX.mag('rev_a')}, CASE WHEN rev_p IS NULL OR abs(rev_p) < 0.01 THEN ' was broadly in line with budget' "
          f"ELSE concat(' was ', {move('rev')}, ' budget') END, '. Gross profit of ', {TX.mag('gp_a')}, ' was ', {move('gp')}, "
          f"' budget, with cost of goods sold ', {side('cogs_v')}, ' plan by ', {TX.mag('cogs_v')}, ' (', {TX.pct('cogs_p')}, ').')")
    v = "(actual - budget)"
    rv = f"CAST(round({v}, 2) AS DOUBLE)"
    item = f"concat(lower(account_name), ' (', {TX.mag(rv)}, ', ', {TX.pct(S.pct(v, 'budget'))}, ' ', {side(rv)}, ' budget)')"
    fu = S.fu(v, "(category = 'Revenue')")
    order = f"ORDER BY abs({rv}) DESC, account_code, {item}"
    p3 = (f"CASE WHEN coalesce(len(u), 0) + coalesce(len(f), 0) = 0 THEN 'No account-level variances cleared the materiality thresholds.' ELSE "
          f"concat_ws(' ', CASE WHEN len(u) > 0 THEN concat('The main unfavourable drivers were ', {TX.join('u')}, '.') END, "
          f"CASE WHEN len(f) > 0 THEN concat(CASE WHEN len(u) > 0 THEN 'This was partly offset by' ELSE 'The main favourable drivers were' END, "
          f"' ', {TX.join('f')}, '.') END) END")
    margin = ("CASE WHEN rev_a <> 0 THEN concat(' a gross margin of ', CAST(CAST(round(CAST(gp_a AS DOUBLE) / CAST(rev_a AS DOUBLE) * 100, 1) "
              "AS DECIMAL(38,1)) AS VARCHAR), '%') ELSE ' no revenue in the period' END")
    alone = (f"concat('Revenue of ', {TX.mag('rev_a')}, ' produced gross profit of ', {TX.mag('gp_a')}, ',', {margin}, '. After operating expenses of ', "
             f"{TX.mag('opex_a')}, ' the result is ', {TX.mag('ebit_a')}, ' at EBIT and ', CASE WHEN ni_a < 0 THEN concat('a net loss of ', {TX.mag('ni_a')}) "
             f"ELSE concat('net income of ', {TX.mag('ni_a')}) END, '.')")
    para = "chr(10) || chr(10)"
    return [S.signs_cte(),
            "ac AS (SELECT entity, account_code, account_name, category, sum(actual) AS actual, sum(budget) AS budget, sum(prior_year) AS prior_year "
            "FROM m GROUP BY entity, account_code, account_name, category)",
            "rep AS (" + S.build_report_sql("ac", ["entity"]) + ")",
            f"wd AS (SELECT entity, {wide} FROM rep GROUP BY entity)",
            "pl AS (SELECT entity AS e, sum(abs(budget)) > 0 AS planned FROM ac GROUP BY entity)",
            f"dr AS (SELECT entity, list({item} {order}) FILTER (WHERE {fu} = 'U') AS u, list({item} {order}) FILTER (WHERE {fu} = 'F') AS f "
            f"FROM ac JOIN pl ON pl.e = ac.entity WHERE planned AND {S.material(v, S.pct(v, 'budget'), rule.abs_floor, rule.pct_floor)} GROUP BY entity)",
            f"na AS (SELECT wd.entity, ni_fu <> '' AS budgeted, CASE WHEN ni_fu <> '' THEN concat({p1}, {para}, {p2}, {para}, {p3}) "
            f"ELSE concat({alone}, {para}, '{C.NO_BUDGET_PARAGRAPH}') END AS narrative FROM wd LEFT JOIN dr ON dr.entity = wd.entity)"]


_MONTH = f"m AS (SELECT * FROM ledger WHERE period_no = {P})"


@register("t10_narrative", with_views("SELECT entity, budgeted, narrative FROM na", "ledger", extra=[_MONTH, *_narrative(Materiality())]))
def t10_narrative(spark, sf_dir):
    return C.narrative(month_frame(spark, sf_dir), by=["entity"])


@register("t11_no_plan_text", with_views("SELECT entity, budgeted, narrative FROM na", "ledger",
                                         extra=[f"m AS (SELECT * REPLACE (0 AS budget) FROM ledger WHERE period_no = {P})", *_narrative(Materiality())]))
def t11_no_plan_text(spark, sf_dir):
    led = month_frame(spark, sf_dir).withColumn("budget", F.lit(0).cast("decimal(24,4)"))
    return C.narrative(led, by=["entity"])
