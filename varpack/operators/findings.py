"""Rule-based findings per flagged slice (G1-G10), for every slice of a
dimension in one job.

The postings are summed once to (slice, child, period); totals, drivers and
history are small aggregates of those rows (their exchange is shared). Windows
are partitioned by the slice and hold one row per child or per month, so a
slice with a third of the postings is still a handful of rows by the time it is
ranked. The ledger holds no causes, so no sentence names one.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commentary as T
from ..functions import measures as V
from ..functions.measures import Materiality
from .aggregate import attach_scalar, dsum, horizon_measures, month_bit
from .periods import MULTIPLE

# Fixed values (must equal the reference).
CONCENTRATION_FLOOR = 0.55
MAX_DRIVERS = 3
ALL_OF_IT = 0.99
OFFSET_SHARE = 0.02

# Fixed values (must equal the reference): the findings' sentences.
SPREAD = ("The movement is spread across {0} lines rather than sitting in a few: the largest {1} "
          "account for {2} of it. There is no single driver to chase.")
ALL_IN = "Effectively all of the movement sits in {0} {1}: {2}{3}."
ALL_TAIL = " - more than the net movement, because {0} of it is offset by lines going the other way"
NAMED = "{0} {1} for {2} of it: {3}."
NEVER = "Not once in {0} months has this line been on the wrong side of plan."
ADVERSE = "Adverse in {0} of {1} {2}."
ON_PLAN = "At the current run rate the year lands on plan."
YEAR = ("At the current run rate the year lands {0} {1} a {2} plan{3}. Holding the plan leaves {4} "
        "for the remaining {5} months, against {6} a month so far.")
YEAR_FAVOURABLE = " - favourable, but worth confirming it is not timing"
ASK_TIMING = ("One month out of line ({0}) against {1} on plan. That shape is usually timing rather than "
              "level - worth checking the cut-off, any accrual released into the month, and whether a "
              "single invoice landed in the wrong period before treating it as a change in run rate.")
ASK_LEVEL = ("Adverse in {0} of {1} months, which is a level rather than an event: the plan and the actual "
             "activity disagree. Worth asking the budget owner whether the plan was set before the current "
             "activity level, and whether the run rate is expected to hold - one of the two numbers has to move.")
ASK_MIXED = ("Adverse in {0} of {1} months, so neither a one-off nor a settled level. Worth looking at what "
             "the months differ by before deciding whether to re-plan or to treat it as noise.")
COVERAGE = ("{0} of {1} accounts carry a flag, and they hold {2} of the gross movement on the sheet - "
            "the rest is noise around the plan.")
COVERAGE_BOTH = ("{0} of them are adverse on the month and cumulatively, which is where a re-plan "
                 "conversation starts rather than a variance explanation.")
COVERAGE_LARGEST = "The largest movements are {0}."


def fill(template: str, *values: Column) -> Column:
    """A template with {0}, {1}, ... as a string Column."""
    parts, rest = [], template
    for i, v in enumerate(values):
        head, rest = rest.split(f"{{{i}}}", 1)
        parts += [F.lit(head), v.cast("string")]
    return F.concat(*parts, F.lit(rest))


def _adverse(var: Column, higher) -> Column:
    hib = F.lit(higher) if isinstance(higher, bool) else higher
    return F.when(hib, var < 0).otherwise(var > 0)


def finding_base(frame: DataFrame, dim: str, child: str, used: Column | None = None) -> DataFrame:
    """One row per slice, child and period: the sums of the rows that are
    ``used`` (all by default; rows of blank slices never are) and the months
    posted by any row, as bits. The one pass over the postings."""
    named = F.col(dim).isNotNull() & ~F.col(dim).cast("string").isin("", MULTIPLE)
    use = F.coalesce(named if used is None else (named & used), F.lit(False))
    month = F.when(F.col("actual") != 0, month_bit())
    keys = list(dict.fromkeys([dim, child, "period", "period_no"]))
    return frame.groupBy(*keys).agg(
        dsum(F.when(use, F.col("actual"))).alias("actual"), dsum(F.when(use, F.col("budget"))).alias("budget"),
        F.count_if(use).alias("_n"), F.bit_or(month).alias("_bits"))


def base_months(base: DataFrame, period_no: int) -> DataFrame:
    """P9 of a finding base: one row."""
    bits = F.bit_count(F.coalesce(F.bit_or(F.when(F.col("period_no") <= period_no, F.col("_bits"))), F.lit(0)))
    return base.agg(F.when(bits > 0, bits).otherwise(F.lit(period_no % 100 or 1)).cast("int").alias("months"))


def slice_flags(base: DataFrame, dim: str, period_no: int, rule: Materiality) -> DataFrame:
    """Per slice: month and YTD variance, their materiality and the flag."""
    ms = horizon_measures(period_no)
    g = base.groupBy(dim).agg(*[dsum(ms[k]).alias(k) for k in ("act", "bud", "yact", "ybud", "fybud")])
    mv, yv = V.variance("act", "bud"), V.variance("yact", "ybud")
    mm = V.material(mv, V.pct_nm(mv, "bud"), rule)
    ym = V.material(yv, V.pct_nm(yv, "ybud"), rule)
    return g.select(dim, "yact", "fybud", mv.alias("month_var"), yv.alias("ytd_var"),
                    V.flag(mm, ym).alias("flag"))


def concentration(base: DataFrame, dim: str, child: str, period_no: int, totals: DataFrame) -> DataFrame:
    """G1 per slice: drivers moving the same way as the YTD total, top 3 by
    |variance| (then name), their share of the total, the verdict, the sentence."""
    ms = horizon_measures(period_no)
    d = (base.groupBy(*dict.fromkeys([dim, child])).agg(dsum(ms["yact"]).alias("a"), dsum(ms["ybud"]).alias("b"))
             .withColumn("var", F.col("a") - F.col("b"))
             .join(totals.select(dim, "ytd_var"), dim))
    same = d.filter((F.col("ytd_var") != 0) & (F.signum(V.dbl("var")) == F.signum(V.dbl("ytd_var"))))
    w = Window.partitionBy(dim).orderBy(F.abs(F.col("var")).desc(), F.col(child))
    ranked = same.withColumn("rank", F.row_number().over(w))
    top = F.col("rank") <= MAX_DRIVERS
    item = F.struct("rank", F.concat(T.prose_name(F.col(child)), F.lit(" ("), T.mag("var"), F.lit(")")).alias("text"))
    g = ranked.groupBy(dim).agg(
        F.count(F.lit(1)).alias("n_same"), F.sum(F.when(top, F.col("var"))).alias("top_var"),
        F.count(F.when(top, 1)).alias("n_top"), F.sum("var").alias("same_var"), F.first("ytd_var").alias("ytd_var"),
        F.sort_array(F.collect_list(F.when(top, item))).alias("top"))      # three at most
    share = V.dbl("top_var") / V.dbl("ytd_var")
    offset = F.col("same_var") - F.col("ytd_var")
    tail = F.abs(offset) > F.abs(F.col("ytd_var")) * F.lit(OFFSET_SHARE)
    verdict = (F.when(share < CONCENTRATION_FLOOR, "spread").when(share >= ALL_OF_IT, "all").otherwise("named"))
    names, one = T.join_names(F.col("top.text")), F.col("n_top") == 1
    text = (F.when(share < CONCENTRATION_FLOOR, fill(SPREAD, F.col("n_same"), F.col("n_top"), T.pct_text(share)))
             .when(share >= ALL_OF_IT, fill(ALL_IN, F.col("n_top"), F.when(one, "line").otherwise("lines"), names,
                                            F.when(tail, fill(ALL_TAIL, T.mag(offset))).otherwise("")))
             .otherwise(fill(NAMED, F.col("n_top"), F.when(one, "line accounts").otherwise("lines account"), T.pct_text(share), names)))
    return g.select(dim, share.alias("share"), "n_same", "n_top", verdict.alias("verdict"),
                    F.when(verdict == "all", tail).alias("offset_tail"), text.alias("concentration_text"))


def persistence(base: DataFrame, dim: str, period_no: int, higher) -> DataFrame:
    """G2 + G4 per slice: months adverse of the months so far, the single
    adverse month when there is one, the question the shape asks, sentences."""
    fy0 = (period_no // 100) * 100
    inside = (F.col("period_no") > fy0) & (F.col("period_no") <= period_no) & (F.col("_n") > 0)
    h = (base.groupBy(dim, "period", "period_no")
             .agg(dsum(F.col("actual")).alias("a"), dsum(F.col("budget")).alias("b"), F.max(inside).alias("_in"))
             .filter(F.col("_in")))
    bad = _adverse(F.col("a") - F.col("b"), higher)
    g = h.groupBy(dim).agg(F.count(F.lit(1)).alias("n_months"), F.count_if(bad).alias("n_adverse"),
                           F.min_by(F.when(bad, F.col("period")), F.when(bad, F.col("period_no"))).alias("adverse_period"))
    n, nb = F.col("n_months"), F.col("n_adverse")
    persist = F.when(n >= 2, F.when(nb == 0, "never").otherwise("adverse"))
    ask = (F.when((n < 3) | (nb == 0), F.lit(None))
            .when(nb == 1, "timing").when(nb >= n - 1, "level").otherwise("mixed"))
    said = F.when(n >= 2, F.when(nb == 0, fill(NEVER, n)).otherwise(fill(ADVERSE, nb, n, F.lit("months"))))
    asked = (F.when(ask == "timing", fill(ASK_TIMING, F.col("adverse_period"), n - 1))
              .when(ask == "level", fill(ASK_LEVEL, nb, n)).when(ask == "mixed", fill(ASK_MIXED, nb, n)))
    return g.select(dim, F.when(n >= 2, n).alias("n_months"), F.when(n >= 2, nb).alias("n_adverse"),
                    persist.alias("persistence"), ask.alias("ask"),
                    F.when(ask == "timing", F.col("adverse_period")).alias("ask_period"),
                    said.alias("persistence_text"), asked.alias("ask_text"))


def full_year(totals: DataFrame, months: Column, higher) -> DataFrame:
    """Where the run rate lands against the full-year plan; no direction
    where it lands on plan (within one)."""
    m = months
    rr = V.dbl("yact") * F.lit(12.0) / m.cast("double")
    gap = rr - V.dbl("fybud")
    ok = (m != 0) & (m < 12) & (F.col("fybud") != 0)
    off = ok & (F.abs(gap) >= 1)
    average = V.dbl("yact") / m.cast("double")
    text = F.when(ok & ~off, F.lit(ON_PLAN)).when(off, fill(
        YEAR, T.mag(gap), F.when(gap > 0, "over").otherwise("under"), T.mag("fybud"),
        F.when(_adverse(gap, higher), F.lit("")).otherwise(YEAR_FAVOURABLE),
        T.mag(F.col("fybud") - F.col("yact")), F.lit(12) - m, T.mag(average)))
    return totals.select(
        "*",
        F.when(ok, gap).alias("fy_gap"),
        F.when(ok, ~off).alias("fy_on_plan"),
        F.when(off, F.when(gap > 0, "over").otherwise("under")).alias("fy_direction"),
        F.when(off, _adverse(gap, higher)).alias("fy_adverse"),
        F.when(ok, V.dbl(F.col("fybud") - F.col("yact"))).alias("remaining_plan"),
        F.when(ok, F.lit(12) - m).alias("months_left"),
        F.when(ok, average).alias("avg_month"), text.alias("full_year_text"))


FINDING_COLUMNS = ["share", "n_same", "verdict", "offset_tail", "n_months", "n_adverse", "persistence",
                   "ask", "ask_period", "fy_gap", "fy_on_plan", "fy_direction", "fy_adverse",
                   "remaining_plan", "months_left", "avg_month"]
HEADINGS = [("Concentration", "concentration_text"), ("Persistence", "persistence_text"),
            ("Full year", "full_year_text"), ("Ask", "ask_text")]


def findings_of_base(base: DataFrame, dim: str, child: str, period_no: int, higher=False,
                     rule: Materiality = Materiality(), months: DataFrame | None = None) -> DataFrame:
    """G1-G4 for every flagged slice of a finding base, with their sentences."""
    shown = base.filter(F.col("_n") > 0)
    flags = slice_flags(shown, dim, period_no, rule).filter(F.col("flag") != "")
    fyr = full_year(attach_scalar(flags, base_months(base, period_no) if months is None else months), F.col("months"), higher)
    conc = concentration(shown, dim, child, period_no, flags)
    pers = persistence(base, dim, period_no, higher)
    out = fyr.join(conc, dim, "left").join(pers, dim, "left")
    return out.select(dim, "flag", V.money("month_var").alias("month_var"), V.money("ytd_var").alias("ytd_var"),
                      *FINDING_COLUMNS, *[c for _, c in HEADINGS])


def dimension_findings(fy: DataFrame, dim: str, child: str, period_no: int,
                       higher=False, spend_only: bool = True, net: bool = False,
                       rule: Materiality = Materiality()) -> DataFrame:
    """G8 (and G9 with an expense-group column): G1-G4 for every flagged
    slice of ``dim``, drivers taken by ``child``."""
    if net:
        sign = F.when(F.col("category") == "Revenue", 1).otherwise(-1)
        fy = fy.withColumn("actual", F.col("actual") * sign).withColumn("budget", F.col("budget") * sign)
    used = (F.col("category") != "Revenue") if spend_only else None
    return findings_of_base(finding_base(fy, dim, child, used), dim, child, period_no, higher, rule)


def compose(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The findings of a slice in reading order, one row each (keys, ord,
    heading, text); a part that the data cannot support is left out."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(h).alias("heading"), F.col(c).alias("text"))
                     for i, (h, c) in enumerate(HEADINGS)])
    return found.select(*keys, F.inline(F.filter(rows, lambda x: x["text"].isNotNull())))


# Fixed value (must equal the reference): what stands in for a repeated block.
SAME_PICTURE = ("The same picture as {0} above: the movement, its persistence and the question it raises are identical, "
                "because the lines below feed both.")


def dedupe_blocks(found: DataFrame, label: str, order: Column) -> DataFrame:
    """Of finding blocks with the same texts (the full year left out) the
    first in report order stays; the others refer to it. One row per block:
    label, repeats (the first block's label, NULL for the first), note."""
    key = F.concat_ws("\n", *[F.col(c) for h, c in HEADINGS if h != "Full year"])
    w = Window.partitionBy("_key").orderBy("_ord", label)
    first = F.first(label).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = found.withColumn("_key", key).withColumn("_ord", order).withColumn("_first", first)
    repeats = F.when(F.col("_first") != F.col(label), F.col("_first"))
    return d.select(label, "flag", repeats.alias("repeats"), F.when(repeats.isNotNull(), fill(SAME_PICTURE, repeats)).alias("note"))


def driver_coverage(drivers: DataFrame) -> DataFrame:
    """G10 over the drivers view (A11 rows): flagged n of N, share of the gross
    |month variance| they hold, how many are BOTH, the three largest positive
    month variances among the flagged; no row when nothing is flagged."""
    flagged = F.coalesce(F.col("flag"), F.lit("")) != ""
    mag = F.abs(F.coalesce(F.col("var_bud"), F.lit(0.0)))
    agg = drivers.agg(F.count(F.lit(1)).alias("n_accounts"), F.count_if(flagged).alias("n_flagged"),
                      F.count_if(F.col("flag") == "BOTH").alias("n_both"),
                      F.sum(F.when(flagged, mag)).alias("_fm"), F.sum(mag).alias("_gm"))
    rank = F.row_number().over(Window.orderBy(F.col("var_bud").desc(), F.col("account_code")))
    top = (drivers.filter(flagged & (F.col("var_bud") > 0)).orderBy(F.col("var_bud").desc(), "account_code").limit(MAX_DRIVERS)
                  .withColumn("rank", rank)
                  .agg(F.sort_array(F.collect_list(F.struct("rank", "account_name", "var_bud"))).alias("t")))
    d = attach_scalar(agg.filter("n_flagged > 0"), top)
    share = F.when(F.col("_gm") > 0, F.col("_fm") / F.col("_gm")).otherwise(0.0)
    names = T.join_names(F.transform("t", lambda x: F.concat(F.lower(x["account_name"]), F.lit(" ("), T.mag(x["var_bud"]), F.lit(")"))))
    return d.select(
        "n_accounts", "n_flagged", "n_both", share.alias("flagged_share"),
        F.array_join(F.col("t.account_name"), "|").alias("largest"),
        fill(COVERAGE, F.col("n_flagged"), F.col("n_accounts"), T.pct_text(share)).alias("coverage_text"),
        F.when(F.col("n_both") > 0, fill(COVERAGE_BOTH, F.col("n_both"))).alias("both_text"),
        F.when(F.size("t") > 0, fill(COVERAGE_LARGEST, names)).alias("largest_text"))
