"""Normalisation of a mapped ledger.

Row-level steps are narrow projections and filters (no shuffle). The one
set-level step, credit-balance sign normalisation (N9), is an aggregate per
category (a handful of groups after partial aggregation, whatever the row
count) joined back - never a window over the raw postings partitioned by category, which would put a
quarter of the ledger in one task.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as PA
from ..functions.structure import UNCLASSIFIED_EXPENSE
from ..functions.text import looks_like_total
from ..session import written
from .aggregate import join_on_keys

LOGGED_NAMES = 4
MONEY = ["actual", "budget", "prior_year"]


def standardise(texts: DataFrame, by: Sequence[str] = ("extract_id",)) -> DataFrame:
    """Canonical rows from mapped texts (one text column per canonical
    field, NULL where unmapped), for all extracts at once: amounts, debit minus
    credit or marker signs (N1-N3; a blank marker reads as debit), labels and
    dimensions (N4, N5), rows without amounts, totals and empty rows dropped
    (N6-N8), accounts classified after that (K4, K8, per extract, where no such
    column is mapped; expense types only if a cost account is recognised), signs
    (N9). Names are read once per account, not once per row; the signs are decided
    on the sums per account, so the rows meet one small table, once."""
    from .classify import classify_readings, expense_type_from_name, readings_of
    d = PA.with_amounts(texts, {f"_{f}": f for f in ("actual", "budget", "prior_year", "debit", "credit")})
    zero = F.lit(0).cast(PA.AMOUNT_TYPE)
    single = F.col("_actual")
    marked = F.when(F.col("_has_dc_indicator"), PA.signed_by_marker(single, F.coalesce("dc_indicator", F.lit("")))).otherwise(single)
    actual = F.when(F.col("_has_actual"), marked).otherwise(PA.debit_minus_credit(F.col("_debit"), F.col("_credit")))
    d = d.select(
        *by, "line_no", F.trim("account_code").alias("account_code"), F.trim("account_name").alias("account_name"),
        actual.cast(PA.AMOUNT_TYPE).alias("actual"), F.when(F.col("_has_budget"), F.col("_budget")).otherwise(zero).alias("budget"),
        F.coalesce("_prior_year", zero).alias("prior_year"),
        F.when(F.col("_has_category"), F.coalesce(PA.canonical_category("category"), F.lit(""))).alias("given_category"),
        *[PA.clean_dimension(F.col(c)).alias(c) for c in ("period", "department", "cost_centre", "entity")],
        F.when(F.col("_has_expense_type"), PA.clean_dimension(F.col("expense_type"))).alias("given_type"), PA.period_key("period").alias("period_no"))
    # Read for the accounts and the rows; written before the filter, which would repeat the readings below it.
    d = drop_null_amounts(written(d))
    account = [*by, "account_code", "account_name"]
    money = reduce(lambda x, y: x | y, [F.col(m) != 0 for m in MONEY])
    # Written before the filter: it reads the account alone, so it would be moved below the sums, to every row.
    counts = written(d.groupBy(*account, "given_category").agg(F.count_if(money).alias("n"), *_sign_stats(MONEY)))
    counts = written(counts.filter(~looks_like_total(F.col("account_name"), F.col("account_code")) & (F.col("n") > 0)))
    kinds = classify_readings(readings_of(counts.groupBy(*account).agg(F.sum("n").alias("n")), by), by).select(*account, F.col("category").alias("inferred"))
    typed = (join_on_keys(counts, kinds, account).withColumn("category", F.coalesce("given_category", "inferred"))
             .withColumn("type", expense_type_from_name("account_name", "category"))).drop("inferred", "n")
    typed = written(typed)
    recognised = typed.groupBy(*by).agg(F.bool_or(F.col("type").isNotNull()).alias("recognised"))
    typed = join_on_keys(typed, recognised, by)
    inferred = (F.when(~F.col("recognised") | (F.col("category") == "Revenue"), F.lit(""))
                .otherwise(F.coalesce("type", F.lit(UNCLASSIFIED_EXPENSE))).alias("type"))
    stats = [f"{m}__{s}" for m in MONEY for s in ("sum", "nz", "neg")]
    flips = _decide_flips(typed.groupBy(*by, "category").agg(*[F.sum(s).alias(s) for s in stats]), MONEY, by)
    typed = join_on_keys(typed.select(*account, "given_category", "category", inferred), flips, [*by, "category"])
    d = join_on_keys(d.filter(money), written(typed.withColumn("_kept", F.lit(True))), [*account, "given_category"]).filter("_kept")
    d = d.withColumn("expense_type", F.coalesce("given_type", "type"))
    return _flipped(d.drop("given_category", "given_type", "type", "_kept"), MONEY)


def drop_null_amounts(df: DataFrame) -> DataFrame:
    """Drop rows where actual and budget are both NULL, then NULL -> 0."""
    zero = F.lit(0).cast(PA.AMOUNT_TYPE)
    d = df.filter(F.col("actual").isNotNull() | F.col("budget").isNotNull())
    for m in MONEY:
        if m in d.columns:
            d = d.withColumn(m, F.coalesce(F.col(m), zero))
    return d


def row_kinds(df: DataFrame) -> DataFrame:
    """Mark N7 total rows and N8 empty rows (all money 0 and not a total)."""
    total = looks_like_total(F.col("account_name"), F.col("account_code"))
    money = [m for m in MONEY if m in df.columns]
    empty = None
    for m in money:
        e = F.coalesce(F.col(m), F.lit(0)) == 0
        empty = e if empty is None else (empty & e)
    return (df.withColumn("_total", total)
              .withColumn("_empty", (empty if empty is not None else F.lit(False)) & ~F.col("_total")))


def drop_non_account_rows(df: DataFrame) -> DataFrame:
    """N7 + N8: keep rows that are neither totals nor empty."""
    return row_kinds(df).filter(~F.col("_total") & ~F.col("_empty")).drop("_total", "_empty")


def dropped_rows_log(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The drop log per group: totals dropped (count, first four names in
    name order) and empty rows dropped. Names are reduced to one row each and
    ranked before the four are put in one list."""
    k = row_kinds(df)
    counts = k.groupBy(*by).agg(F.sum(F.col("_total").cast("int")).alias("total_rows"),
                                F.sum(F.col("_empty").cast("int")).alias("empty_rows"))
    names = (k.filter("_total").select(*by, F.trim(F.col("account_name")).alias("_name")).distinct())
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_name"))
    first = (names.withColumn("_rank", rank).filter(F.col("_rank") <= LOGGED_NAMES)
             .groupBy(*by).agg(F.sort_array(F.collect_list("_name")).alias("total_names")))
    out = join_on_keys(counts, first, by)
    return out.select(*by, "total_rows", F.coalesce("total_names", F.array().cast("array<string>")).alias("total_names"), "empty_rows")


# ---------------------------------------------------------------------------
# N9 credit-balance sign normalisation
# ---------------------------------------------------------------------------

def sign_flips(df: DataFrame, money: Sequence[str] = MONEY, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, category, money column): flip when the sum is negative and
    (>= 2 nonzero rows with >= 70% negative, or exactly one nonzero row and
    the category is Revenue)."""
    money = [m for m in money if m in df.columns]
    return _decide_flips(df.groupBy(*by, "category").agg(*_sign_stats(money)), money, by)


def _sign_stats(money: Sequence[str]) -> list[Column]:
    """Aggregates of the sign rule: sum, nonzero and negative rows per column."""
    aggs = []
    for m in money:
        v = F.coalesce(F.col(m), F.lit(0))
        aggs += [F.sum(v).alias(f"{m}__sum"),
                 F.count(F.when(v != 0, 1)).alias(f"{m}__nz"),
                 F.count(F.when(v < 0, 1)).alias(f"{m}__neg")]
    return aggs


def _decide_flips(stats: DataFrame, money: Sequence[str], by: Sequence[str]) -> DataFrame:
    out = stats
    for m in money:
        s, nz, neg = F.col(f"{m}__sum"), F.col(f"{m}__nz"), F.col(f"{m}__neg")
        flip = ((nz > 0) & (s < 0)
                & (((nz >= 2) & (neg / nz >= 0.7)) | ((nz == 1) & (F.col("category") == "Revenue"))))
        out = out.withColumn(f"{m}__flip", F.coalesce(flip, F.lit(False)))
    return out.select(*by, "category", *[f"{m}__flip" for m in money])


def normalise_signs(df: DataFrame, money: Sequence[str] = MONEY, by: Sequence[str] = ()) -> DataFrame:
    """Every category (of a group) reported as a positive magnitude."""
    money = [m for m in money if m in df.columns]
    flips = sign_flips(df, money, by)   # one row per category: adaptive execution picks the join
    return _flipped(join_on_keys(df, flips, [*by, "category"]), money)


def _flipped(j: DataFrame, money: Sequence[str]) -> DataFrame:
    for m in money:
        j = j.withColumn(m, F.when(F.coalesce(F.col(f"{m}__flip"), F.lit(False)), -F.col(m))
                           .otherwise(F.col(m)))
    return j.drop(*[f"{m}__flip" for m in money])


def sign_log(df: DataFrame, money: Sequence[str] = MONEY) -> DataFrame:
    """N9 notes: one row per (category, money column) flipped."""
    money = [m for m in money if m in df.columns]
    f = sign_flips(df, money)
    stacked = f.select("category", F.explode(F.array(*[
        F.struct(F.lit(m).alias("column"), F.col(f"{m}__flip").alias("flipped")) for m in money
    ])).alias("x"))
    return (stacked.filter(F.col("x.flipped"))
                   .select("category", F.col("x.column").alias("column")))
