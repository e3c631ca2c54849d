"""Queries for findings (G1-G10) with oracles written from the finding rules:
one relational chain (totals, drivers, history) per slice view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.structure import EXPENSE_GROUPS, OTHER_EXPENSE_GROUP, PNL_LINES, SIGN_MATRIX
from ..operators import findings as G
from ..operators import rollups as RU
from ..operators.periods import with_expense_group
from . import sqlgen as S
from . import text_sql as TX
from .oracle_views import with_views
from .q_core import MONTHS_SQL, P, fy_frame
from .registry import register

#: Floors at which every slice view of the test ledger has flagged slices.
LOW = Materiality(1000.0, 0.005)
FY0 = (P // 100) * 100


def _chain(hib: str, rule: Materiality = Materiality()) -> list[str]:
    """CTEs over f(dim, child, period, period_no, actual, budget) and mo(months)."""
    mv, yv = "(act - bud)", "(yact - ybud)"
    flag = S.flag(S.material(mv, S.pct(mv, "bud"), rule.abs_floor, rule.pct_floor),
                  S.material(yv, S.pct(yv, "ybud"), rule.abs_floor, rule.pct_floor))
    bad = f"(CASE WHEN {hib} THEN v < 0 ELSE v > 0 END)"
    share = "(CAST(top_var AS DOUBLE) / CAST(ytd_var AS DOUBLE))"
    item = f"concat({TX.prose('child')}, ' (', {TX.mag('var')}, ')')"
    gap = "(CAST(yact AS DOUBLE) * 12.0 / CAST(months AS DOUBLE) - CAST(fybud AS DOUBLE))"
    ok = "(months < 12 AND fybud <> 0)"
    adverse_gap = f"(CASE WHEN {hib} THEN {gap} < 0 ELSE {gap} > 0 END)"
    average = "(CAST(yact AS DOUBLE) / CAST(months AS DOUBLE))"
    return [
        f"tot AS (SELECT dim, {S.five_sums_sql()} FROM f GROUP BY dim)",
        f"fl AS (SELECT dim, yact, fybud, {mv} AS month_var, {yv} AS ytd_var, {flag} AS flag FROM tot)",
        "ds AS (SELECT f.dim, f.child, "
        f"sum(CASE WHEN period_no <= {P} THEN actual ELSE 0 END) - sum(CASE WHEN period_no <= {P} THEN budget ELSE 0 END) AS var "
        "FROM f GROUP BY f.dim, f.child)",
        "rk AS (SELECT ds.*, fl.ytd_var, row_number() OVER (PARTITION BY ds.dim ORDER BY abs(var) DESC, child) AS r "
        "FROM ds JOIN fl ON fl.dim = ds.dim WHERE (var > 0 AND ytd_var > 0) OR (var < 0 AND ytd_var < 0))",
        "cn AS (SELECT dim, count(*) AS n_same, count(*) FILTER (WHERE r <= 3) AS n_top, sum(var) FILTER (WHERE r <= 3) AS top_var, "
        f"sum(var) AS same_var, any_value(ytd_var) AS ytd_var, list({item} ORDER BY r) FILTER (WHERE r <= 3) AS items FROM rk GROUP BY dim)",
        f"cv AS (SELECT *, {share} AS share, CASE WHEN {share} < 0.55 THEN 'spread' WHEN {share} >= 0.99 THEN 'all' ELSE 'named' END "
        "AS verdict, abs(same_var - ytd_var) > abs(ytd_var) * CAST(0.02 AS DOUBLE) AS tail FROM cn)",
        "ct AS (SELECT *, CASE verdict WHEN 'spread' THEN "
        + TX.fill(G.SPREAD, "n_same", "n_top", TX.pct("share")) + " WHEN 'all' THEN "
        + TX.fill(G.ALL_IN, "n_top", "CASE WHEN n_top = 1 THEN 'line' ELSE 'lines' END", TX.join("items"),
                  "CASE WHEN tail THEN " + TX.fill(G.ALL_TAIL, TX.mag("same_var - ytd_var")) + " ELSE '' END")
        + " ELSE " + TX.fill(G.NAMED, "n_top", "CASE WHEN n_top = 1 THEN 'line accounts' ELSE 'lines account' END",
                             TX.pct("share"), TX.join("items")) + " END AS concentration_text FROM cv)",
        f"hs AS (SELECT dim, period, period_no, sum(actual) - sum(budget) AS v FROM f WHERE period_no > {FY0} AND period_no <= {P} "
        "GROUP BY dim, period, period_no)",
        f"hc AS (SELECT dim, count(*) AS n, count(*) FILTER (WHERE {bad}) AS nb, "
        f"min(period) FILTER (WHERE {bad}) AS first_bad FROM hs GROUP BY dim)",
        "hp AS (SELECT *, CASE WHEN n < 3 OR nb = 0 THEN NULL WHEN nb = 1 THEN 'timing' WHEN nb >= n - 1 THEN 'level' ELSE 'mixed' END AS ask FROM hc)",
        "ht AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN nb = 0 THEN " + TX.fill(G.NEVER, "n") + " ELSE "
        + TX.fill(G.ADVERSE, "nb", "n", "'months'") + " END END AS persistence_text, CASE ask WHEN 'timing' THEN "
        + TX.fill(G.ASK_TIMING, "first_bad", "n - 1") + " WHEN 'level' THEN " + TX.fill(G.ASK_LEVEL, "nb", "n")
        + " WHEN 'mixed' THEN " + TX.fill(G.ASK_MIXED, "nb", "n") + " END AS ask_text FROM hp)",
        f"yr AS (SELECT fl.*, months, CASE WHEN {ok} THEN {gap} END AS fy_gap, CASE WHEN {ok} THEN abs({gap}) < 1 END AS fy_on_plan, "
        f"CASE WHEN {ok} AND abs({gap}) >= 1 THEN CASE WHEN {gap} > 0 THEN 'over' ELSE 'under' END END AS fy_direction, "
        f"CASE WHEN {ok} AND abs({gap}) >= 1 THEN {adverse_gap} END AS fy_adverse, "
        f"CASE WHEN {ok} THEN CAST(fybud - yact AS DOUBLE) END AS remaining_plan, CASE WHEN {ok} THEN 12 - months END AS months_left, "
        f"CASE WHEN {ok} THEN {average} END AS avg_month, CASE WHEN {ok} THEN CASE WHEN abs({gap}) < 1 THEN '{G.ON_PLAN}' ELSE "
        + TX.fill(G.YEAR, TX.mag(gap), f"CASE WHEN {gap} > 0 THEN 'over' ELSE 'under' END", TX.mag("fybud"),
                  f"CASE WHEN {adverse_gap} THEN '' ELSE '{G.YEAR_FAVOURABLE}' END", TX.mag("fybud - yact"), "12 - months", TX.mag(average))
        + " END END AS full_year_text FROM fl CROSS JOIN mo WHERE flag <> '')",
        "fd AS (SELECT yr.dim, flag, " + S.money("month_var") + " AS month_var, " + S.money("yr.ytd_var") + " AS ytd_var, "
        "ct.share, ct.n_same, ct.verdict, CASE WHEN ct.verdict = 'all' THEN ct.tail END AS offset_tail, "
        "CASE WHEN n >= 2 THEN n END AS n_months, CASE WHEN n >= 2 THEN nb END AS n_adverse, "
        "CASE WHEN n >= 2 THEN CASE WHEN nb = 0 THEN 'never' ELSE 'adverse' END END AS persistence, ask, "
        "CASE WHEN ask = 'timing' THEN first_bad END AS ask_period, fy_gap, fy_on_plan, fy_direction, fy_adverse, remaining_plan, "
        "months_left, avg_month, concentration_text, persistence_text, full_year_text, ask_text "
        "FROM yr LEFT JOIN ct ON ct.dim = yr.dim LEFT JOIN ht ON ht.dim = yr.dim)"]


def _source(dim: str, child: str, where: str = "true", source: str = "fy", sign: str | None = None) -> str:
    a, b = ("actual", "budget") if sign is None else (f"actual * ({sign})", f"budget * ({sign})")
    return (f"f AS (SELECT {dim} AS dim, {child} AS child, period, period_no, {a} AS actual, {b} AS budget FROM {source} "
            f"WHERE ({where}) AND {dim} IS NOT NULL AND CAST({dim} AS VARCHAR) NOT IN ('', '(multiple)'))")


_NET_SIGN = "CASE WHEN category = 'Revenue' THEN 1 ELSE -1 END"
_ENTITY = [_source("entity", "department", sign=_NET_SIGN), MONTHS_SQL, *_chain("true", LOW)]
_CATEGORY = [_source("category", "account_name"), MONTHS_SQL, *_chain("dim = 'Revenue'", LOW)]
_DEPARTMENT = [_source("department", "cost_centre", "category <> 'Revenue'"), MONTHS_SQL, *_chain("false", LOW)]
_GROUPS = "eg(expense_type, expense_group) AS (VALUES " + ", ".join(f"('{t}', '{g}')" for g, ts in EXPENSE_GROUPS for t in ts) + ")"
_EXPENSE = [_GROUPS, "fe AS (SELECT fy.*, coalesce(eg.expense_group, '" + OTHER_EXPENSE_GROUP + "') AS expense_group FROM fy LEFT JOIN eg USING (expense_type))",
            _source("expense_group", "expense_type", "category <> 'Revenue'", "fe"), MONTHS_SQL, *_chain("false", LOW)]
_LINE_OF = "CASE category " + " ".join(f"WHEN '{cat}' THEN '{label}'" for label, kind, _h, cat, _c in PNL_LINES if kind == "category") + " END"
_PNL = [f"fl0 AS (SELECT *, {_LINE_OF} AS line FROM fy)", _source("line", "account_name", source="fl0"), MONTHS_SQL,
        *_chain("dim = 'Revenue'", LOW)]
_COMPUTED = ["cs(line, cat, sign) AS (VALUES " + ", ".join(
    f"('{label}', '{cat}', {sign})" for label, kind, *_r in PNL_LINES if kind == "computed" for cat, sign in SIGN_MATRIX[label].items()) + ")",
    "fx AS (SELECT fy.period, fy.period_no, fy.category, cs.line, fy.actual * cs.sign AS actual, fy.budget * cs.sign AS budget "
    "FROM fy JOIN cs ON cs.cat = fy.category)", _source("line", "category", source="fx"), MONTHS_SQL, *_chain("true", LOW)]


def _sql(chain: list[str], name: str, columns: str = "* EXCLUDE (dim)") -> str:
    return with_views(f"SELECT dim AS {name}, {columns} FROM fd", "fy", extra=chain)


def _entity(spark, sf_dir):
    """Entity -> department findings (net income, higher is better)."""
    return G.dimension_findings(fy_frame(spark, sf_dir), "entity", "department", P,
                                higher=True, spend_only=False, net=True, rule=LOW)


def _category(spark, sf_dir):
    return G.dimension_findings(fy_frame(spark, sf_dir), "category", "account_name", P,
                                higher=V.higher_is_better_for_category("category"), spend_only=False, rule=LOW)


def _department(spark, sf_dir):
    return G.dimension_findings(fy_frame(spark, sf_dir), "department", "cost_centre", P, rule=LOW)


def _expense(spark, sf_dir):
    """Expense groups: the group is found per expense type, on the few summed rows."""
    base = G.finding_base(fy_frame(spark, sf_dir), "expense_type", "expense_type", F.col("category") != "Revenue")
    grouped = with_expense_group(base).drop("group_ord", "type_ord")
    return G.findings_of_base(grouped, "expense_group", "expense_type", P, rule=LOW, months=G.base_months(base, P))


_G1 = "flag, ytd_var, share, n_same, verdict, offset_tail, concentration_text"
_G2 = "flag, n_months, n_adverse, persistence, persistence_text"
_G3 = "fy_gap, fy_on_plan, fy_direction, fy_adverse, remaining_plan, months_left, avg_month, full_year_text"
_G4 = "n_months, n_adverse, ask, ask_period, ask_text"


def _cols(text: str) -> list[str]:
    return text.split(", ")


@register("g1_concentration", _sql(_CATEGORY, "category", _G1))
def g1_concentration(spark, sf_dir):
    return _category(spark, sf_dir).select("category", *_cols(_G1))


@register("g2_persistence", _sql(_DEPARTMENT, "department", _G2))
def g2_persistence(spark, sf_dir):
    return _department(spark, sf_dir).select("department", *_cols(_G2))


@register("g3_full_year", _sql(_ENTITY, "entity", _G3))
def g3_full_year(spark, sf_dir):
    return _entity(spark, sf_dir).select("entity", *_cols(_G3))


@register("g4_ask", _sql(_EXPENSE, "expense_group", _G4))
def g4_ask(spark, sf_dir):
    return _expense(spark, sf_dir).select("expense_group", *_cols(_G4))


@register("g5_findings", with_views(
    "SELECT dim AS entity, ord, heading, text FROM (" + " UNION ALL ".join(
        f"SELECT dim, {i + 1} AS ord, '{h}' AS heading, {c} AS text FROM fd" for i, (h, c) in enumerate(G.HEADINGS))
    + ") x WHERE text IS NOT NULL", "fy", extra=_ENTITY))
def g5_findings(spark, sf_dir):
    return G.compose(_entity(spark, sf_dir), ["entity"])


@register("g8_department_findings", _sql(_DEPARTMENT, "department"))
def g8_department_findings(spark, sf_dir):
    return _department(spark, sf_dir)


@register("g8_entity_findings", _sql(_ENTITY, "entity"))
def g8_entity_findings(spark, sf_dir):
    return _entity(spark, sf_dir)


@register("g8_category_findings", _sql(_CATEGORY, "category"))
def g8_category_findings(spark, sf_dir):
    return _category(spark, sf_dir)


@register("g6_pnl_findings", _sql(_PNL, "line"))
def g6_pnl_findings(spark, sf_dir):
    """Category lines of the P&L: drivers are the accounts in the line."""
    line = F.create_map(*[x for label, kind, _h, cat, _c in PNL_LINES if kind == "category"
                          for x in (F.lit(cat), F.lit(label))])[F.col("category")]
    return G.dimension_findings(fy_frame(spark, sf_dir).withColumn("line", line), "line", "account_name", P,
                                higher=F.col("line") == "Revenue", spend_only=False, rule=LOW)


@register("g7_computed_findings", _sql(_COMPUTED, "line"))
def g7_computed_findings(spark, sf_dir):
    """Computed lines: the sums per category and period, signed into each line
    they feed; drivers are the signed category variances."""
    base = G.finding_base(fy_frame(spark, sf_dir), "category", "category")
    parts = [F.struct(F.lit(label).alias("line"), F.lit(cat).alias("cat"), F.lit(sign).alias("sign"))
             for label, kind, *_r in PNL_LINES if kind == "computed" for cat, sign in SIGN_MATRIX[label].items()]
    x = (base.withColumn("_p", F.explode(F.array(*parts))).filter(F.col("_p.cat") == F.col("category"))
             .withColumn("line", F.col("_p.line")).withColumn("actual", (F.col("actual") * F.col("_p.sign")).cast("decimal(38,4)"))
             .withColumn("budget", (F.col("budget") * F.col("_p.sign")).cast("decimal(38,4)")).drop("_p"))
    return G.findings_of_base(x, "line", "category", P, True, LOW, months=G.base_months(base, P))


_ORDER = {label: i for i, (label, *_r) in enumerate(PNL_LINES)}


@register("w7_dedupe_blocks", with_views(
    "SELECT line, flag, CASE WHEN line <> head THEN head END AS repeats, CASE WHEN line <> head THEN " + TX.fill(G.SAME_PICTURE, "head")
    + " END AS note FROM (SELECT dim AS line, flag, first_value(dim) OVER (PARTITION BY coalesce(concentration_text, ''), coalesce(persistence_text, ''), "
    "coalesce(ask_text, '') ORDER BY CASE dim " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ORDER.items()) + " END) AS head FROM fd) q",
    "fy", extra=_COMPUTED))
def w7_dedupe_blocks(spark, sf_dir):
    order = F.create_map(*[x for k, v in _ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("line")]
    return G.dedupe_blocks(g7_computed_findings(spark, sf_dir), "line", order)


@register("g9_expense_findings", _sql(_EXPENSE, "expense_group"))
def g9_expense_findings(spark, sf_dir):
    return _expense(spark, sf_dir)


_DV, _DY = "(act - bud)", "(yact - ybud)"
_COVER = [
    f"a AS (SELECT account_code, account_name, category, {S.five_sums_sql()} FROM fy GROUP BY account_code, account_name, category)",
    f"r AS (SELECT account_code, account_name, {S.money(_DV)} AS v, "
    + S.flag(S.material(_DV, S.pct(_DV, "bud"), LOW.abs_floor, LOW.pct_floor), S.material(_DY, S.pct(_DY, "ybud"), LOW.abs_floor, LOW.pct_floor))
    + " AS flag FROM a)",
    "top AS (SELECT * FROM r WHERE flag <> '' AND v > 0 ORDER BY v DESC, account_code LIMIT 3)",
    f"tt AS (SELECT list(account_name ORDER BY v DESC, account_code) AS names, list(concat(lower(account_name), ' (', {TX.mag('v')}, ')') "
    "ORDER BY v DESC, account_code) AS items FROM top)",
    "g AS (SELECT count(*) AS n_accounts, count(*) FILTER (WHERE flag <> '') AS n_flagged, count(*) FILTER (WHERE flag = 'BOTH') AS n_both, "
    "CASE WHEN sum(abs(v)) > 0 THEN sum(abs(v)) FILTER (WHERE flag <> '') / sum(abs(v)) ELSE 0.0 END AS flagged_share FROM r)"]


@register("g10_coverage", with_views(
    "SELECT n_accounts, n_flagged, n_both, round(flagged_share, 9) AS flagged_share, array_to_string(coalesce(names, []), '|') AS largest, "
    + TX.fill(G.COVERAGE, "n_flagged", "n_accounts", TX.pct("flagged_share")) + " AS coverage_text, "
    "CASE WHEN n_both > 0 THEN " + TX.fill(G.COVERAGE_BOTH, "n_both") + " END AS both_text, "
    "CASE WHEN len(items) > 0 THEN " + TX.fill(G.COVERAGE_LARGEST, TX.join("items")) + " END AS largest_text "
    "FROM g CROSS JOIN tt WHERE n_flagged > 0", "fy", extra=_COVER))
def g10_coverage(spark, sf_dir):
    d = G.driver_coverage(RU.drivers(fy_frame(spark, sf_dir), P, LOW))
    return d.withColumn("flagged_share", F.round("flagged_share", 9))
