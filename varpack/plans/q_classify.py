"""Queries for classification (K1-K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keywords import CATEGORY_KEYWORDS, EXPENSE_TYPE_KEYWORDS, alternation
from ..functions.parse import infer_category
from ..functions.structure import UNCLASSIFIED_EXPENSE
from ..operators import classify as K
from ..sources import fixture as X
from . import text_sql as TX
from .oracle_views import with_views
from .registry import register


def _match_sql(text: str, table) -> str:
    parts = " ".join(f"WHEN regexp_matches({text}, '{alternation(w)}') THEN '{lab}'" for lab, w in table)
    return f"(CASE {parts} END)"


FOLD = "strip_accents(lower(account_name))"
BY_NAME = f"(CASE WHEN trim({FOLD}) = '' THEN NULL ELSE {_match_sql(FOLD, CATEGORY_KEYWORDS)} END)"

CODE_SQL = {
    "by_4567": "CASE substr(c, 1, 1) WHEN '4' THEN 'Revenue' WHEN '5' THEN 'COGS' WHEN '6' THEN 'OpEx' "
               "WHEN '7' THEN 'Other' END",
    "by_sap": "CASE WHEN substr(c, 1, 2) IN ('40', '41') THEN 'COGS' WHEN substr(c, 1, 2) = '48' THEN 'Other' "
              "ELSE CASE substr(c, 1, 1) WHEN '4' THEN 'OpEx' WHEN '8' THEN 'Revenue' WHEN '6' THEN 'OpEx' "
              "WHEN '7' THEN 'OpEx' WHEN '2' THEN 'Other' END END",
    "by_skr03": "CASE WHEN substr(c, 1, 2) = '48' THEN 'Other' ELSE CASE substr(c, 1, 1) WHEN '8' THEN 'Revenue' "
                "WHEN '3' THEN 'COGS' WHEN '4' THEN 'OpEx' WHEN '2' THEN 'Other' END END",
    "by_hu": "CASE WHEN substr(c, 1, 1) = '9' THEN CASE WHEN substr(c, 1, 2) IN ('97', '98', '99') THEN 'Other' "
             "ELSE 'Revenue' END WHEN substr(c, 1, 2) IN ('57', '86', '87', '88', '89') THEN 'Other' "
             "WHEN substr(c, 1, 2) IN ('51', '52', '53') OR substr(c, 1, 1) = '8' THEN CASE WHEN substr(c, 1, 2) "
             "IN ('51', '81', '82') THEN 'COGS' ELSE 'OpEx' END WHEN substr(c, 1, 1) = '5' THEN 'OpEx' END",
}


@register("k1_category_by_name", with_views(
    f"SELECT DISTINCT account_name, {BY_NAME} AS by_name FROM ledger", "ledger"))
def k1_category_by_name(spark, sf_dir):
    names = X.ledger(spark, sf_dir).select("account_name").distinct()
    return names.select("account_name", K.category_from_name("account_name").alias("by_name"))


@register("k2_category_by_code", with_views(
    "SELECT DISTINCT c AS account_code, " + ", ".join(f"{e} AS {k}" for k, e in CODE_SQL.items())
    + " FROM (SELECT trim(account_code) AS c FROM ledger) t", "ledger"))
def k2_category_by_code(spark, sf_dir):
    codes = X.ledger(spark, sf_dir).select(F.trim("account_code").alias("account_code")).distinct()
    return codes.select("account_code", *[K.category_by_code("account_code", s).alias(K.STYLE_COL[s])
                                          for s in K.STYLES])


def _scores_sql() -> str:
    cols = []
    for k in CODE_SQL:
        cols.append(f"CASE WHEN named > 0 AND read_{k} > 0 THEN CAST(agree_{k} AS DOUBLE) / named ELSE 0.0 END AS score_{k}")
        cols.append(f"CAST(cov_{k} AS DOUBLE) / greatest(rows, 1) AS coverage_{k}")
    aggs = ["sum(n) AS rows", "sum(CASE WHEN by_name IS NOT NULL THEN n ELSE 0 END) AS named"]
    for k in CODE_SQL:
        aggs += [f"sum(CASE WHEN by_name IS NOT NULL AND {k} = by_name THEN n ELSE 0 END) AS agree_{k}",
                 f"sum(CASE WHEN by_name IS NOT NULL AND {k} IS NOT NULL THEN n ELSE 0 END) AS read_{k}",
                 f"sum(CASE WHEN {k} IS NOT NULL THEN n ELSE 0 END) AS cov_{k}"]
    styles = list(zip(K.STYLES, CODE_SQL))
    best = "CASE " + " ".join(f"WHEN score_{k} = greatest({', '.join('score_' + x for x in CODE_SQL)}) THEN '{s}'"
                              for s, k in styles) + " END"
    widest = "CASE " + " ".join(f"WHEN coverage_{k} = greatest({', '.join('coverage_' + x for x in CODE_SQL)}) THEN '{s}'"
                                for s, k in styles) + " END"
    conf = f"greatest({', '.join('score_' + x for x in CODE_SQL)})"
    wcov = f"greatest({', '.join('coverage_' + x for x in CODE_SQL)})"
    return (
        "WITH p AS (SELECT c AS account_code, account_name, count(*) AS n, "
        + BY_NAME.replace("account_name", "account_name") + " AS by_name, "
        + ", ".join(f"{e} AS {k}" for k, e in CODE_SQL.items())
        + " FROM (SELECT trim(account_code) AS c, account_name FROM ledger) t GROUP BY c, account_name), "
        "g AS (SELECT " + ", ".join(aggs) + " FROM p), "
        "s AS (SELECT rows, named, " + ", ".join(cols) + " FROM g), "
        f"d AS (SELECT *, {best} AS best, {conf} AS confidence, {widest} AS widest, {wcov} AS widest_cov FROM s) "
        "SELECT rows, named, CASE WHEN confidence >= 0.6 AND named >= 3 THEN best "
        "WHEN named < 3 AND widest_cov > 0 THEN widest END AS style, "
        "(NOT (confidence >= 0.6 AND named >= 3)) AND named < 3 AND widest_cov > 0 AS blind, confidence, "
        + ", ".join(f"score_{k}" for k in CODE_SQL) + ", " + ", ".join(f"coverage_{k}" for k in CODE_SQL)
        + " FROM d")


@register("k3_style_scores", with_views(_scores_sql(), "ledger"))
def k3_style_scores(spark, sf_dir):
    led = X.ledger_blank_category(spark, sf_dir)
    return K.style_scores(K.readings(led))


@register("k4_categories", with_views(
    "SELECT DISTINCT trim(account_code) AS account_code, account_name, category FROM ledger", "ledger"))
def k4_categories(spark, sf_dir):
    c = K.infer_categories(X.ledger_blank_category(spark, sf_dir))
    return c.select("account_code", "account_name", "category").distinct()


_CHART_CODE = "CASE " + " ".join(
    f"WHEN entity = '{e}' AND substr(account_code, 1, 1) = '{d}' THEN concat('{lead}', substr(account_code, 2))"
    for e, digits in X.CHARTS.items() for d, lead in digits.items()) + " ELSE account_code END"


def _pairs_sql() -> list[str]:
    """Per entity of the chart ledger: pairs with both readings, the entity's
    style, and the final category."""
    named = "by_name IS NOT NULL"
    aggs = ", ".join(f"sum(n) FILTER (WHERE {named} AND {k} = by_name) AS agree_{k}, sum(n) FILTER (WHERE {named} AND {k} IS NOT NULL) AS read_{k}, "
                     f"sum(n) FILTER (WHERE {k} IS NOT NULL) AS cov_{k}" for k in CODE_SQL)
    score = {k: f"(CASE WHEN named > 0 AND coalesce(read_{k}, 0) > 0 THEN CAST(coalesce(agree_{k}, 0) AS DOUBLE) / named ELSE 0.0 END)" for k in CODE_SQL}
    cover = {k: f"(CAST(coalesce(cov_{k}, 0) AS DOUBLE) / rows)" for k in CODE_SQL}
    top = lambda d: f"greatest({', '.join(d.values())})"
    first = lambda d: "CASE " + " ".join(f"WHEN {d[k]} = {top(d)} THEN '{s}'" for s, k in zip(K.STYLES, CODE_SQL)) + " END"
    by_code = "CASE style " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in zip(K.STYLES, CODE_SQL)) + " END"
    return [
        f"lc AS (SELECT entity, {_CHART_CODE} AS c, CASE WHEN account_name = 'Advertising' THEN 'Sales revenue rebate' ELSE account_name END AS account_name FROM ledger)",
        f"p AS (SELECT entity, c, account_name, count(*) AS n, {BY_NAME} AS by_name, " + ", ".join(f"{e} AS {k}" for k, e in CODE_SQL.items())
        + " FROM lc GROUP BY entity, c, account_name)",
        f"g AS (SELECT entity, sum(n) AS rows, coalesce(sum(n) FILTER (WHERE {named}), 0) AS named, {aggs} FROM p GROUP BY entity)",
        f"st AS (SELECT *, {top(score)} AS confidence, CASE WHEN {top(score)} >= 0.6 AND named >= 3 THEN {first(score)} "
        f"WHEN named < 3 AND {top(cover)} > 0 THEN {first(cover)} END AS style, NOT ({top(score)} >= 0.6 AND named >= 3) AND named < 3 AND {top(cover)} > 0 AS blind FROM g)",
        f"pc AS (SELECT p.entity, c, account_name, n, by_name, {by_code} AS by_code, style, blind, confidence FROM p JOIN st USING (entity))",
        "ps AS (SELECT *, coalesce(by_code, by_name, 'OpEx') AS category, by_code IS NULL AND by_name IS NULL AS defaulted, "
        "coalesce(by_code <> by_name, false) AS disagreed FROM pc)",
        "ki AS (SELECT entity, any_value(style) AS style, any_value(blind) AS blind, round(any_value(confidence), 2) AS confidence, any_value(confidence) AS exact, "
        "CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE disagreed), 0) AS BIGINT) AS disagreed_rows, "
        "CAST(coalesce(sum(n) FILTER (WHERE defaulted), 0) AS BIGINT) AS defaulted_rows, "
        "CAST(coalesce(sum(n) FILTER (WHERE by_name = 'Revenue' AND category <> 'Revenue'), 0) AS BIGINT) AS revenue_contradicted_rows, "
        "bool_or(category = 'Revenue') AS has_revenue FROM ps GROUP BY entity)",
        "kq AS (SELECT * EXCLUDE (exact), style IS NOT NULL AND NOT blind AND exact >= 0.999 AND disagreed_rows = 0 AND has_revenue AND defaulted_rows = 0 AS silent, "
        "defaulted_rows > greatest(2, floor(rows / 5)) AS many_defaulted FROM ki)"]


@register("k4_charts", with_views("SELECT entity, c AS account_code, account_name, style, category, CASE WHEN by_code IS NOT NULL THEN 'code' "
                                  "WHEN by_name IS NOT NULL THEN 'name' ELSE 'default' END AS source, disagreed FROM ps", "ledger", extra=_pairs_sql()))
def k4_charts(spark, sf_dir):
    """Every entity's own chart of accounts is found and read."""
    p = K.classify_pairs(X.ledger_charts(spark, sf_dir), ["entity"])
    return p.select("entity", "account_code", "account_name", "style", "category", "source", "disagreed")


@register("k2_charts", with_views("SELECT DISTINCT c AS account_code, " + ", ".join(CODE_SQL) + " FROM p", "ledger", extra=_pairs_sql()))
def k2_charts(spark, sf_dir):
    codes = X.ledger_charts(spark, sf_dir).select(F.trim("account_code").alias("account_code")).distinct()
    return codes.select("account_code", *[K.category_by_code("account_code", s).alias(K.STYLE_COL[s]) for s in K.STYLES])


@register("k5_category_issues", with_views("SELECT * FROM kq", "ledger", extra=_pairs_sql()))
def k5_category_issues(spark, sf_dir):
    return K.category_issues(X.ledger_charts(spark, sf_dir), ["entity"])


def _named_sql(issue: str, when: str, most: int) -> str:
    return (f"SELECT entity, '{issue}' AS issue, CAST(row_number() OVER (PARTITION BY entity ORDER BY c, account_name) AS INTEGER) AS rank, "
            f"concat(c, ' ', account_name) AS account FROM ps SEMI JOIN (SELECT entity FROM kq WHERE NOT silent) k USING (entity) WHERE {when} QUALIFY rank <= {most}")


@register("k5_issue_accounts", with_views(
    _named_sql("contradicted", "by_name = 'Revenue' AND category <> 'Revenue'", K.NAMED_CONTRADICTED) + " UNION ALL "
    + _named_sql("disagreed", "disagreed", K.NAMED_DISAGREED), "ledger", extra=_pairs_sql()))
def k5_issue_accounts(spark, sf_dir):
    return K.issue_accounts(X.ledger_charts(spark, sf_dir), ["entity"])


@register("k6_infer_category", with_views(
    "SELECT DISTINCT trim(account_code) AS account_code, CASE substr(trim(account_code), 1, 1) "
    "WHEN '4' THEN 'Revenue' WHEN '5' THEN 'COGS' WHEN '6' THEN 'OpEx' WHEN '7' THEN 'Other' "
    "ELSE 'OpEx' END AS category FROM ledger", "ledger"))
def k6_infer_category(spark, sf_dir):
    codes = X.ledger(spark, sf_dir).select(F.trim("account_code").alias("account_code")).distinct()
    return codes.select("account_code", infer_category("account_code").alias("category"))


ETYPE = (f"(CASE WHEN category = 'Revenue' OR trim({FOLD}) = '' THEN NULL "
         f"ELSE {_match_sql(FOLD, EXPENSE_TYPE_KEYWORDS)} END)")


@register("k7_expense_type", with_views(
    f"SELECT DISTINCT account_name, category, {ETYPE} AS expense_type FROM ledger", "ledger"))
def k7_expense_type(spark, sf_dir):
    d = X.ledger(spark, sf_dir).select("account_name", "category").distinct()
    return d.select("account_name", "category",
                    K.expense_type_from_name("account_name", "category").alias("expense_type"))


@register("k8_expense_summary", with_views(
    f"SELECT count(*) FILTER (WHERE category <> 'Revenue' AND {ETYPE} IS NOT NULL) AS recognised, "
    "count(*) FILTER (WHERE category <> 'Revenue') AS costs, "
    f"count(*) FILTER (WHERE category <> 'Revenue') - count(*) FILTER (WHERE category <> 'Revenue' "
    f"AND {ETYPE} IS NOT NULL) AS unclassified, "
    f"count(*) FILTER (WHERE category <> 'Revenue' AND {ETYPE} IS NOT NULL) > 0 AS applied FROM ledger",
    "ledger"))
def k8_expense_summary(spark, sf_dir):
    return K.expense_summary(X.ledger(spark, sf_dir))


_COST = "category <> 'Revenue'"


@register("k8_issues", with_views(
    "SELECT department, ord, note FROM (SELECT department, 1 AS ord, " + TX.fill(K.EXPENSE_NOTE, "recognised", "costs") + " AS note FROM s "
    "UNION ALL SELECT department, 2, " + TX.fill(K.EXPENSE_UNCLASSIFIED, "costs - recognised") + " FROM s WHERE costs > recognised) x", "ledger",
    extra=[f"s AS (SELECT department, count(*) FILTER (WHERE {_COST} AND {ETYPE} IS NOT NULL) AS recognised, count(*) FILTER (WHERE {_COST}) AS costs "
           f"FROM ledger GROUP BY department HAVING count(*) FILTER (WHERE {_COST}) > 0)"]))
def k8_issues(spark, sf_dir):
    return K.expense_issues(X.ledger(spark, sf_dir), ["department"])


@register("k9_partial", with_views(
    f"SELECT DISTINCT trim(account_code) AS account_code, account_name, CASE WHEN account_code LIKE '%3%' THEN 'Other' ELSE category END AS category, "
    f"CASE WHEN account_code LIKE '%2%' THEN 'Confirmed' WHEN category = 'Revenue' THEN '' ELSE coalesce({ETYPE}, '{UNCLASSIFIED_EXPENSE}') END AS expense_type FROM ledger",
    "ledger"))
def k9_partial(spark, sf_dir):
    """Overrides for some accounts and some columns; a NULL keeps the inferred value."""
    led = X.ledger(spark, sf_dir)
    code = F.trim("account_code")
    some = led.select(code.alias("account_code")).distinct().select(
        "account_code", F.when(F.col("account_code").contains("3"), "Other").alias("category"),
        F.when(F.col("account_code").contains("2"), "Confirmed").alias("expense_type")).filter("category IS NOT NULL OR expense_type IS NOT NULL")
    inferred = K.infer_expense_types(K.infer_categories(X.ledger_blank_category(spark, sf_dir)))
    return K.apply_overrides(inferred, some).select("account_code", "account_name", "category", "expense_type").distinct()


@register("k9_overrides", with_views(
    "SELECT DISTINCT trim(account_code) AS account_code, account_name, category, expense_type FROM ledger",
    "ledger"))
def k9_overrides(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    # the confirmed classification: one row per account from the ledger's own columns
    confirmed = (led.select(F.trim("account_code").alias("account_code"), "category", "expense_type")
                    .distinct())
    inferred = K.infer_expense_types(K.infer_categories(X.ledger_blank_category(spark, sf_dir)))
    out = K.apply_overrides(inferred, confirmed)
    return out.select("account_code", "account_name", "category", "expense_type").distinct()
