"""Account classification (K1-K9).

Readings are computed on the distinct (group, code, name) pairs with their
row counts - a few thousand rows however large the ledger - so the style
scores weight rows (not distinct accounts) without touching the postings
again. The per-group decision (one row per group) is joined back to the
pairs, and the pairs' categories to the postings, on the pair key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import CATEGORY_KEYWORDS, EXPENSE_TYPE_KEYWORDS, alternation
from ..functions.parse import infer_category  # noqa: F401  (K6, re-exported)
from ..functions.structure import UNCLASSIFIED_EXPENSE
from ..functions.text import fold
from .aggregate import join_on_keys

# Fixed value: chart styles in the order that breaks score ties.
STYLES = ["4-5-6-7", "SAP", "SKR03", "Hungarian"]
STYLE_COL = {"4-5-6-7": "by_4567", "SAP": "by_sap", "SKR03": "by_skr03", "Hungarian": "by_hu"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first_match(text: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for label, words in reversed(table):
        out = F.when(text.rlike(alternation(words)), F.lit(label)).otherwise(out)
    return out


def category_from_name(name) -> Column:
    """K1: ordered keyword rules over the folded name; NULL when none hits or
    the name is blank."""
    text = fold(F.coalesce(_c(name).cast("string"), F.lit("")))
    return F.when(F.trim(text) == "", F.lit(None).cast("string")).otherwise(
        _first_match(text, CATEGORY_KEYWORDS))


def expense_type_from_name(name, category=None) -> Column:
    """K7: ordered expense-type rules; Revenue (and blank names) -> NULL."""
    text = fold(F.coalesce(_c(name).cast("string"), F.lit("")))
    e = F.when(F.trim(text) == "", F.lit(None).cast("string")).otherwise(
        _first_match(text, EXPENSE_TYPE_KEYWORDS))
    if category is not None:
        e = F.when(_c(category) == "Revenue", F.lit(None).cast("string")).otherwise(e)
    return e


def category_by_code(code, style: str) -> Column:
    """K2: the category a chart style reads from the code (NULL if none)."""
    c = F.trim(_c(code).cast("string"))
    one, two = F.substring(c, 1, 1), F.substring(c, 1, 2)
    if style == "4-5-6-7":
        return (F.when(one == "4", "Revenue").when(one == "5", "COGS")
                 .when(one == "6", "OpEx").when(one == "7", "Other"))
    if style == "SAP":
        return (F.when(two.isin("40", "41"), "COGS").when(two == "48", "Other")
                 .when(one == "4", "OpEx").when(one == "8", "Revenue").when(one == "6", "OpEx")
                 .when(one == "7", "OpEx").when(one == "2", "Other"))
    if style == "SKR03":
        return (F.when(two == "48", "Other").when(one == "8", "Revenue")
                 .when(one == "3", "COGS").when(one == "4", "OpEx").when(one == "2", "Other"))
    if style == "Hungarian":
        return (F.when(one == "9", F.when(two.isin("97", "98", "99"), "Other").otherwise("Revenue"))
                 .when(two.isin("57", "86", "87", "88", "89"), "Other")
                 .when(two.isin("51", "52", "53") | (one == "8"),
                       F.when(two.isin("51", "81", "82"), "COGS").otherwise("OpEx"))
                 .when(one == "5", "OpEx"))
    raise ValueError(style)


def readings(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (group, code, name) with row count, name reading and the four
    code readings."""
    pairs = (df.select(*by, F.trim(F.col("account_code").cast("string")).alias("account_code"),
                       "account_name")
               .groupBy(*by, "account_code", "account_name").agg(F.count(F.lit(1)).alias("n")))
    return readings_of(pairs, by)


def readings_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Name and code readings of distinct (group, code, name) rows with counts n."""
    out = pairs.withColumn("by_name", category_from_name("account_name"))
    for s in STYLES:
        out = out.withColumn(STYLE_COL[s], category_by_code("account_code", s))
    return out


def style_scores(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K3: per group, agreement score and coverage per style (row-weighted),
    the best style and whether it is trusted / chosen blind."""
    named = F.col("by_name").isNotNull()
    aggs = [F.sum(F.col("n")).alias("rows"),
            F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named")]
    for s in STYLES:
        c = F.col(STYLE_COL[s])
        aggs += [F.sum(F.when(named & (c == F.col("by_name")), F.col("n")).otherwise(0)).alias(f"agree_{STYLE_COL[s]}"),
                 F.sum(F.when(named & c.isNotNull(), F.col("n")).otherwise(0)).alias(f"read_{STYLE_COL[s]}"),
                 F.sum(F.when(c.isNotNull(), F.col("n")).otherwise(0)).alias(f"cov_{STYLE_COL[s]}")]
    g = r.groupBy(*by).agg(*aggs)
    for s in STYLES:
        k = STYLE_COL[s]
        g = (g.withColumn(f"score_{k}", F.when((F.col("named") > 0) & (F.col(f"read_{k}") > 0),
                                               F.col(f"agree_{k}") / F.col("named")).otherwise(0.0))
              .withColumn(f"coverage_{k}", F.col(f"cov_{k}") / F.greatest(F.col("rows"), F.lit(1))))

    def first_max(prefix: str) -> Column:
        best = F.greatest(*[F.col(f"{prefix}_{STYLE_COL[s]}") for s in STYLES])
        out = F.lit(None).cast("string")
        for s in reversed(STYLES):
            out = F.when(F.col(f"{prefix}_{STYLE_COL[s]}") == best, F.lit(s)).otherwise(out)
        return out

    g = (g.withColumn("best", first_max("score"))
          .withColumn("confidence", F.greatest(*[F.col(f"score_{STYLE_COL[s]}") for s in STYLES]))
          .withColumn("widest", first_max("coverage"))
          .withColumn("widest_cov", F.greatest(*[F.col(f"coverage_{STYLE_COL[s]}") for s in STYLES])))
    trusted = F.when((F.col("confidence") >= 0.6) & (F.col("named") >= 3), F.col("best"))
    blind = trusted.isNull() & (F.col("named") < 3) & (F.col("widest_cov") > 0)
    g = (g.withColumn("blind", blind)
          .withColumn("style", F.when(trusted.isNotNull(), trusted)
                               .when(blind, F.col("widest"))))
    keep = list(by) + ["rows", "named", "style", "blind", "confidence"] + \
        [f"score_{STYLE_COL[s]}" for s in STYLES] + [f"coverage_{STYLE_COL[s]}" for s in STYLES]
    return g.select(*keep)


def classify_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K4: final category per (group, code, name): trusted code reading, else
    name reading, else OpEx; with the source and the disagreement flag."""
    return classify_readings(readings(df, by), by)


def classify_readings(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K4 on readings."""
    s = style_scores(r, by).select(*by, "style", "blind", "confidence")
    j = join_on_keys(r, s, by)
    by_code = F.lit(None).cast("string")
    for st in reversed(STYLES):
        by_code = F.when(F.col("style") == st, F.col(STYLE_COL[st])).otherwise(by_code)
    j = j.withColumn("by_code", by_code)
    return j.select(
        *by, "account_code", "account_name", "n", "by_name", "by_code", "style", "blind",
        F.coalesce("by_code", "by_name", F.lit("OpEx")).alias("category"),
        F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name")
         .otherwise("default").alias("source"),
        (F.col("by_code").isNotNull() & F.col("by_name").isNotNull()
         & (F.col("by_code") != F.col("by_name"))).alias("disagreed"))


def infer_categories(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K4 applied to the rows: adds ``category`` (and ``category_source``)."""
    pairs = classify_pairs(df, by).select(*by, "account_code", "account_name", "category",
                                          F.col("source").alias("category_source"))
    d = df.withColumn("account_code", F.trim(F.col("account_code").cast("string")))
    if "category" in d.columns:
        d = d.drop("category")
    keys = list(by) + ["account_code", "account_name"]
    # one row per distinct account: size grows with the chart, not the postings;
    # AQE broadcasts it when small and falls back to a shuffle join otherwise
    return join_on_keys(d, pairs, keys)


def category_issues(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K5: the numbers behind the classification notes, per group."""
    p = classify_pairs(df, by)
    contra = (F.col("by_name") == "Revenue") & (F.col("category") != "Revenue")
    agg = p.groupBy(*by).agg(
        F.first("style").alias("style"), F.first("blind").alias("blind"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("disagreed"), F.col("n")).otherwise(0)).alias("disagreed_rows"),
        F.sum(F.when(F.col("source") == "default", F.col("n")).otherwise(0)).alias("defaulted_rows"),
        F.sum(F.when(contra, F.col("n")).otherwise(0)).alias("revenue_contradicted_rows"),
        F.bool_or(F.col("category") == "Revenue").alias("has_revenue"))
    sc = style_scores(readings(df, by), by).select(*by, "confidence")
    j = join_on_keys(agg, sc, by)
    silent = (F.col("style").isNotNull() & ~F.col("blind") & (F.col("confidence") >= 0.999)
              & (F.col("disagreed_rows") == 0) & F.col("has_revenue") & (F.col("defaulted_rows") == 0))
    many_defaulted = F.col("defaulted_rows") > F.greatest(F.lit(2), F.floor(F.col("rows") / 5))
    return j.select(*by, "style", "blind", F.round("confidence", 2).alias("confidence"),
                    "rows", "disagreed_rows", "defaulted_rows", "revenue_contradicted_rows",
                    "has_revenue", silent.alias("silent"), many_defaulted.alias("many_defaulted"))


# Fixed values (must equal the reference): how many accounts a note names.
NAMED_CONTRADICTED, NAMED_DISAGREED = 6, 5


def issue_accounts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K5 as rows: the accounts behind the notes of a group that is not silent,
    (by, issue, rank, account): names that say revenue and are classified
    otherwise (first 6), codes and names that disagree (first 5), in code order."""
    loud = category_issues(df, by).filter(~F.col("silent")).select(*by, F.lit(True).alias("_loud"))
    contra = (F.col("by_name") == "Revenue") & (F.col("category") != "Revenue")
    kinds = F.array(F.struct(F.lit("contradicted").alias("issue"), contra.alias("hit"), F.lit(NAMED_CONTRADICTED).alias("most")),
                    F.struct(F.lit("disagreed").alias("issue"), F.col("disagreed").alias("hit"), F.lit(NAMED_DISAGREED).alias("most")))
    rows = (join_on_keys(classify_pairs(df, by), loud, by).filter("_loud")
            .select(*by, "account_code", "account_name", F.inline(kinds)).filter("hit"))
    w = Window.partitionBy(*by, "issue").orderBy("account_code", "account_name")
    return (rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("most"))
            .select(*by, "issue", "rank", F.concat_ws(" ", "account_code", "account_name").alias("account")))


# Fixed values (must equal the reference): notes on inferred expense types.
EXPENSE_NOTE = ("No expense-type column was supplied, so expense types were inferred from the account names: "
                "{0} of {1} cost accounts were recognised. Check the Expense Report before relying on it.")
EXPENSE_UNCLASSIFIED = ("{0} cost accounts could not be recognised and are grouped under \"" + UNCLASSIFIED_EXPENSE
                        + "\". Add an expense-type column to classify them yourself.")


def expense_issues(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K8 as rows (by, ord, note): nothing without costs."""
    from .findings import fill
    s = expense_summary(df, by).filter("costs > 0")
    notes = F.array(F.struct(F.lit(1).alias("ord"), fill(EXPENSE_NOTE, F.col("recognised"), F.col("costs")).alias("note")),
                    F.when(F.col("unclassified") > 0, F.struct(F.lit(2).alias("ord"), fill(EXPENSE_UNCLASSIFIED, F.col("unclassified")).alias("note"))))
    return s.select(*by, F.inline(F.filter(notes, lambda x: x.isNotNull())))


def infer_expense_types(df: DataFrame) -> DataFrame:
    """K8: Revenue -> '', recognised type, else 'Other expenses'."""
    e = expense_type_from_name("account_name", "category")
    return df.withColumn("expense_type",
                         F.when(F.col("category") == "Revenue", F.lit(""))
                          .otherwise(F.coalesce(e, F.lit(UNCLASSIFIED_EXPENSE))))


def expense_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K8 summary: recognised cost rows, cost rows, unclassified."""
    cost = F.col("category") != "Revenue"
    rec = cost & expense_type_from_name("account_name", "category").isNotNull()
    return (df.groupBy(*by).agg(F.count_if(rec).alias("recognised"),
                                F.count_if(cost).alias("costs"))
              .withColumn("unclassified", F.col("costs") - F.col("recognised"))
              .withColumn("applied", F.col("recognised") > 0))


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """K9: confirmed overrides (account_code -> category / expense_type)
    replace inference; a NULL in the override keeps the inferred value."""
    o = overrides.select("account_code", *[F.col(c).alias(f"_ov_{c}") for c in
                                           ("category", "expense_type") if c in overrides.columns])
    j = df.join(o, "account_code", "left")
    for c in ("category", "expense_type"):
        if f"_ov_{c}" in j.columns:
            j = j.withColumn(c, F.coalesce(F.col(f"_ov_{c}"), F.col(c))).drop(f"_ov_{c}")
    return j
