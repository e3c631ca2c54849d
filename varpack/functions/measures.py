"""Variance measures as native Column expressions.

Every function returns a ``Column`` so whole reports stay inside whole-stage
codegen; nothing here is a Python UDF. Money arrives as DECIMAL and stays
decimal through sums and differences; only percentages are computed in double.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for the same results:
# n/m rule of the variance percentage, and the default materiality floors.
NM_ABS_FLOOR = 100.0     # |base| below this: percentage not meaningful
NM_RATIO_CAP = 10.0      # |variance / base| above this: not meaningful
DEFAULT_ABS_FLOOR = 25000.0
DEFAULT_PCT_FLOOR = 0.10


@dataclass(frozen=True)
class Materiality:
    """Two floors; a variance is material only when it clears both (or the
    percentage is not meaningful and the amount clears its floor)."""
    abs_floor: float = DEFAULT_ABS_FLOOR
    pct_floor: float = DEFAULT_PCT_FLOOR


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def variance(actual, base) -> Column:
    """V1: actual minus base (budget or prior year)."""
    return col(actual) - col(base)


def pct_nm(var, base) -> Column:
    """V2: variance / |base|, NULL when |base| < 100 or |ratio| > 10."""
    ratio = dbl(var) / F.abs(dbl(base))
    return (F.when(col(base).isNull() | (F.abs(col(base)) < F.lit(NM_ABS_FLOOR)), F.lit(None))
             .when(F.abs(ratio) > F.lit(NM_RATIO_CAP), F.lit(None))
             .otherwise(ratio)).cast("double")


def favourable(var, higher_is_better) -> Column:
    """V3: F/U. ``higher_is_better`` is a bool or a boolean Column (zero
    variance is favourable either way)."""
    hib = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else col(higher_is_better)
    good = F.when(hib, col(var) >= 0).otherwise(col(var) <= 0)
    return F.when(good, F.lit("F")).otherwise(F.lit("U"))


def higher_is_better_for_category(category) -> Column:
    """Revenue is higher-is-better; every other (and unknown) category lower."""
    return F.coalesce(col(category) == F.lit("Revenue"), F.lit(False))


def material(var, pct, rule: Materiality = Materiality()) -> Column:
    """V4: |var| >= abs floor and (pct is n/m or |pct| >= pct floor)."""
    return ((F.abs(col(var)) >= F.lit(rule.abs_floor))
            & (col(pct).isNull() | (F.abs(col(pct)) >= F.lit(rule.pct_floor))))


def flag(month_material, ytd_material) -> Column:
    """V5: BOTH / MONTH / YTD / ''."""
    m, y = col(month_material), col(ytd_material)
    return (F.when(m & y, "BOTH").when(m, "MONTH").when(y, "YTD").otherwise(""))


def run_rate(ytd_actual, months) -> Column:
    """V6: YTD actual x 12 / months in double; NULL when months = 0 (never
    plan-gated)."""
    return F.when(col(months) != 0, dbl(ytd_actual) * F.lit(12.0) / dbl(months))


def money(c) -> Column:
    """Output form of money: rounded to 2 places on the decimal, then double."""
    return F.round(col(c), 2).cast("double")


def pct_out(c) -> Column:
    """Output form of a percentage: 4 places."""
    return F.round(col(c), 4)