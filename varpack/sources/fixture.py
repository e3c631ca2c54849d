"""Ledger and plan views over the given star-schema tables.

The posting ledger is a star join: lineitem (fact) with part (gives the
account), orders -> customer -> nation -> region (gives entity, department and
cost centre). The orders side is reduced to one row per order before it meets
lineitem, and the part side to the five columns the account needs, so each of
the two large joins shuffles only narrow rows. nation (25 rows) and region
(5 rows) are fixed-size by the TPC-H specification and are broadcast.

Money is DECIMAL with four places end to end; it becomes double only in the
final projection of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

DEC2 = "decimal(18,2)"
DEC42 = "decimal(4,2)"

REVENUE_TYPES = ["STANDARD", "LARGE", "PROMO", "MEDIUM"]


def _str(c: Column) -> Column:
    return c.cast("string")


def part_accounts(part: DataFrame) -> DataFrame:
    """partkey -> account attributes (one narrow projection, no shuffle)."""
    t = F.col("p_type")
    d = F.col("p_size") % 10
    ds = _str(d)
    is_rev = t.isin(REVENUE_TYPES)
    code = F.concat(
        F.when(is_rev, "4").when(t == "ECONOMY", "5").when(d == 8, "7").otherwise("6"),
        ds,
        F.when(t == "LARGE", "10").when(t == "PROMO", "20").when(t == "MEDIUM", "30")
         .otherwise("00"))
    cogs_name = (F.when(d <= 3, "Direct materials ").when(d <= 5, "Direct labour ")
                 .when(d <= 7, "Cloud hosting ").when(d == 8, "Third-party licences ")
                 .otherwise("Freight and delivery "))
    opex_name = (F.when(d == 0, "Salaries").when(d == 1, "Payroll taxes")
                 .when(d == 2, "Bonus pool").when(d == 3, "Contractor support")
                 .when(d == 4, "Advertising").when(d == 5, "Legal fees")
                 .when(d == 6, "Software tools").when(d == 7, "Office rent")
                 .when(d == 8, "Interest expense").otherwise("Company fleet"))
    name = (F.when(t == "STANDARD", F.concat(F.lit("Product revenue "), ds))
            .when(t == "LARGE", F.concat(F.lit("Subscription revenue "), ds))
            .when(t == "PROMO", F.concat(F.lit("Service sales "), ds))
            .when(t == "MEDIUM", F.concat(F.lit("Training turnover "), ds))
            .when(t == "ECONOMY", F.concat(cogs_name, ds))
            .otherwise(opex_name))
    category = (F.when(is_rev, "Revenue").when(t == "ECONOMY", "COGS")
                .when(d == 8, "Other").otherwise("OpEx"))
    cogs_type = (F.when(d <= 3, "Materials & components").when(d <= 5, "Direct labour")
                 .when(d <= 7, "Hosting & infrastructure").when(d == 8, "Third-party licences")
                 .otherwise("Logistics & fees"))
    opex_type = (F.when(d == 0, "Salaries & wages").when(d == 1, "Payroll benefits")
                 .when(d == 2, "Employee incentives")
                 .when(d == 3, "External staff / contractors")
                 .when(d == 4, "Marketing & advertising")
                 .when(d == 5, "External professional fees")
                 .when(d == 6, "IT & software").when(d == 7, "Facilities & office")
                 .when(d == 8, "Financing & bank").otherwise("Company fleet"))
    etype = (F.when(t == "ECONOMY", cogs_type).when(t == "SMALL", opex_type)
             .otherwise(F.lit("")))
    budget_factor = (F.lit(0.80) + F.lit(0.05) * d).cast(DEC42)
    return part.select(
        F.col("p_partkey"),
        code.alias("account_code"), name.alias("account_name"),
        category.alias("category"), etype.alias("expense_type"),
        budget_factor.alias("budget_factor"))


def order_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orderkey -> entity, department, cost centre."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cust = (customer
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
            .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select("c_custkey",
                    F.col("r_name").alias("entity"),
                    F.col("c_mktsegment").alias("department"),
                    F.concat(F.substring("c_mktsegment", 1, 2),
                             _str(F.col("n_nationkey") % 4 + 1),
                             F.lit("0100")).alias("cost_centre")))
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .select("o_orderkey", "entity", "department", "cost_centre"))


def ledger(spark: SparkSession, sf_dir: str, fiscal_year: int | None = None,
           months: tuple[int, int] | None = None) -> DataFrame:
    """The posting ledger (FIXTURES §4 `ledger`).

    With ``fiscal_year``, or ``months`` (first and last period key), the range
    is selected on the source date column, so it reaches the parquet scan
    (row-group skipping on min/max) instead of being applied to the derived
    period key after the joins."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        "l_extendedprice", "l_discount", "l_tax")
    if fiscal_year is not None:
        months = (fiscal_year * 100 + 1, fiscal_year * 100 + 12)
    if months is not None:
        t = li.schema["l_shipdate"].dataType.simpleString()
        start, (y, m) = months[0], divmod(months[1], 100)
        stop = (y + 1) * 100 + 1 if m == 12 else months[1] + 1
        day = lambda p: F.lit(f"{p // 100:04d}-{p % 100:02d}-01 00:00:00").cast(t)
        li = li.filter((F.col("l_shipdate") >= day(start)) & (F.col("l_shipdate") < day(stop)))
    acc = part_accounts(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"))
    dims = order_dims(spark, sf_dir)
    j = (li.join(acc, li.l_partkey == acc.p_partkey)
           .join(dims, li.l_orderkey == dims.o_orderkey))
    y = F.year("l_shipdate")
    m = F.month("l_shipdate")
    price = F.col("l_extendedprice").cast(DEC2)
    one = F.lit(1).cast(DEC42)
    return j.select(
        F.col("l_orderkey").alias("doc_no"),
        F.col("l_linenumber").alias("line_no"),
        F.concat(_str(y), F.lit("-"), F.lpad(_str(m), 2, "0")).alias("period"),
        (y * 100 + m).cast("int").alias("period_no"),
        "account_code", "account_name", "category", "expense_type",
        "entity", "department", "cost_centre",
        (price * (one - F.col("l_discount").cast(DEC42))).alias("actual"),
        (price * F.col("budget_factor")).alias("budget"),
        (price * (F.lit(0.93).cast(DEC42) - F.col("l_tax").cast(DEC42))).alias("prior_year"),
    )


def fiscal_year_frame(df: DataFrame, fiscal_year: int) -> DataFrame:
    """Rows of one fiscal year: a range predicate on period_no, which reaches
    the scan as a partition filter when the ledger is partitioned by it."""
    return df.filter(F.col("period_no").between(fiscal_year * 100 + 1, fiscal_year * 100 + 12))


# --------------------------------------------------------------------------
# Derived views (FIXTURES §4)
# --------------------------------------------------------------------------

PLAN_KEYS = ["period", "period_no", "entity", "department", "account_code"]


def plan(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    """Plan coarser than the ledger: no cost centre, no expense type."""
    return (ledger(spark, sf_dir, months=months).groupBy(*PLAN_KEYS)
            .agg(F.sum("budget").alias("budget")))


def plan_gappy(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    """`plan` without 2000-03 and without one account per month: the account
    whose code sorts first in that month (a deterministic, data-derived gap)."""
    p = plan(spark, sf_dir, months).filter(F.col("period_no") != 200003)
    first = (p.groupBy("period_no").agg(F.min("account_code").alias("_drop_code")))
    return (p.join(first, "period_no")
             .filter(F.col("account_code") != F.col("_drop_code"))
             .drop("_drop_code"))


def actuals_only(spark: SparkSession, sf_dir: str, fiscal_year: int | None = None) -> DataFrame:
    return ledger(spark, sf_dir, fiscal_year).withColumn("budget", F.lit(0).cast("decimal(24,4)"))


def ledger_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue carried as credit balances (negative actual and budget)."""
    led = ledger(spark, sf_dir)
    rev = F.col("category") == "Revenue"
    return (led.withColumn("actual", F.when(rev, -F.col("actual")).otherwise(F.col("actual")))
               .withColumn("budget", F.when(rev, -F.col("budget")).otherwise(F.col("budget"))))


def ledger_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude plus a debit/credit marker (SAP S/H)."""
    led = ledger(spark, sf_dir)
    return (led.withColumn("dc_indicator",
                           F.when(F.col("category") == "Revenue", "H").otherwise("S"))
               .withColumn("amount", F.abs("actual")).drop("actual"))


def ledger_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial-balance shape: revenue in credit, everything else in debit."""
    led = ledger(spark, sf_dir)
    rev = F.col("category") == "Revenue"
    zero = F.lit(0).cast("decimal(24,4)")
    return (led.withColumn("debit", F.when(rev, zero).otherwise(F.col("actual")))
               .withColumn("credit", F.when(rev, F.col("actual")).otherwise(zero))
               .drop("actual"))


def ledger_blank_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).drop("category", "expense_type")


def ledger_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger plus printed furniture: one `Total` row without a code per
    department (carrying the department's sums) and one coded row with all
    amounts zero per department."""
    led = ledger(spark, sf_dir)
    tot = (led.groupBy("department")
              .agg(F.sum("actual").alias("actual"), F.sum("budget").alias("budget"),
                   F.sum("prior_year").alias("prior_year")))
    blank = F.lit("")
    totals = tot.select(
        F.lit(None).cast("bigint").alias("doc_no"), F.lit(None).cast("int").alias("line_no"),
        blank.alias("period"), F.lit(None).cast("int").alias("period_no"),
        blank.alias("account_code"), F.lit("Total").alias("account_name"),
        blank.alias("category"), blank.alias("expense_type"), blank.alias("entity"),
        "department", blank.alias("cost_centre"), "actual", "budget", "prior_year")
    zero = F.lit(0).cast("decimal(24,4)")
    zeros = tot.select(
        F.lit(None).cast("bigint").alias("doc_no"), F.lit(None).cast("int").alias("line_no"),
        blank.alias("period"), F.lit(None).cast("int").alias("period_no"),
        F.lit("9999").alias("account_code"), F.lit("Suspense").alias("account_name"),
        blank.alias("category"), blank.alias("expense_type"), blank.alias("entity"),
        "department", blank.alias("cost_centre"),
        zero.alias("actual"), zero.alias("budget"), zero.alias("prior_year"))
    return led.unionByName(totals, allowMissingColumns=False).unionByName(zeros)


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text in seven conventions (FIXTURES §4 `ledger_raw`):
    leading minus, parentheses, trailing minus, US with CR, currency prefix,
    US with DR, and a blank marker."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    d = li.select(F.col("l_orderkey").alias("doc_no"), F.col("l_linenumber").alias("line_no"),
                  ((F.col("l_orderkey") + F.col("l_linenumber")) % 7).cast("int").alias("conv"),
                  cents.alias("cents"))
    c = F.col("cents")
    big = F.concat(_str(F.floor(c / 100000).cast("bigint")), F.lit("."),
                   F.lpad(_str(F.floor(c % 100000 / 100).cast("bigint")), 3, "0"))
    eu = F.concat(F.when(c >= 100000, big).otherwise(_str(F.floor(c / 100).cast("bigint"))),
                  F.lit(","), F.lpad(_str(c % 100), 2, "0"))
    us = F.translate(eu, ".,", ",.")
    conv = F.col("conv")
    text = (F.when(conv == 0, F.concat(F.lit("-"), eu))
             .when(conv == 1, F.concat(F.lit("("), eu, F.lit(")")))
             .when(conv == 2, F.concat(eu, F.lit("-")))
             .when(conv == 3, F.concat(us, F.lit(" CR")))
             .when(conv == 4, F.concat(F.lit("EUR "), eu))
             .when(conv == 5, F.concat(us, F.lit(" DR")))
             .otherwise(F.lit("n/a")))
    return d.select("doc_no", "line_no", "conv", "cents", text.alias("amount_text"))


# Fixed value: for each first digit of the ledger's codes, the leading digits
# that mean the same in the chart of another entity.
CHARTS = {"AFRICA": {"4": "8", "5": "40", "6": "6", "7": "48"},        # SAP
          "AMERICA": {"4": "8", "5": "3", "6": "4", "7": "2"},         # SKR03
          "ASIA": {"4": "91", "5": "81", "6": "52", "7": "98"}}        # Hungarian


def ledger_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the codes of three entities in other charts, and the
    advertising account named as if it were revenue."""
    led = ledger(spark, sf_dir)
    first, rest = F.substring("account_code", 1, 1), F.substring("account_code", 2, 9)
    code = F.col("account_code")
    for entity, digits in CHARTS.items():
        for d, lead in digits.items():
            code = F.when((F.col("entity") == entity) & (first == d), F.concat(F.lit(lead), rest)).otherwise(code)
    name = F.when(F.col("account_name") == "Advertising", "Sales revenue rebate").otherwise(F.col("account_name"))
    return led.withColumn("account_code", code).withColumn("account_name", name)
