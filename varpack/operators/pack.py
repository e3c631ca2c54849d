"""Report sink (S5): the pack's tables as one Parquet table per view, all from
one account cube, which is summed and written first. Tables are partitioned by
fiscal year and period; writing a period again replaces that period's partition of
every table and leaves the others alone."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import Materiality
from ..session import shared_path, written
from .aggregate import account_cube
from .reports import gl_listing, pnl_full
from .rollups import department_report, drivers, entity_report, expense_report

TABLES = ["ledger", "pnl", "expense", "entity", "department", "drivers"]


def write_pack(fy: DataFrame, period_no: int, path: str | None = None, rule: Materiality = Materiality()) -> str:
    """Write the pack of one reporting period below ``path``; returns that folder."""
    spark = fy.sparkSession
    path = path or shared_path(spark)
    cube = written(account_cube(fy))
    views = {"ledger": gl_listing(cube), "pnl": pnl_full(cube, period_no, rule=rule), "expense": expense_report(cube, period_no, rule),
             "entity": entity_report(cube, period_no, rule), "department": department_report(cube, period_no, rule),
             "drivers": drivers(cube, period_no, rule)}
    of = {"report_year": F.lit(period_no // 100), "report_period": F.lit(period_no)}
    for name in TABLES:
        (views[name].withColumns(of).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*of).parquet(os.path.join(path, name)))
    return path


def read_pack(spark: SparkSession, path: str, period_no: int | None = None) -> DataFrame:
    """(table, n_rows, actual): what a written pack holds, of one period or of all."""
    of = F.lit(True) if period_no is None else (F.col("report_year") == period_no // 100) & (F.col("report_period") == period_no)
    counts = [spark.read.parquet(os.path.join(path, name)).filter(of).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"),
                                                               F.round(F.sum("actual"), 2).alias("actual")) for name in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
