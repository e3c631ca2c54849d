"""Commentary as a column (T7-T11): one string per report row, for every
group in one job. Postings are summed once to account (or parent and child)
level with the month, year-to-date and full-year figures; report rows and driver
names both come from those rows. A list of names holds the material accounts (or
children) of one row of a report, so its length is bounded by the chart of
accounts; it is joined by key and never broadcast. No Python touches the rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import commentary as T
from ..functions import measures as V
from ..functions.measures import Materiality
from ..functions.structure import LINE_OF_CATEGORY
from .aggregate import attach_scalar, category_sums, dsum, join_on_keys, lines_from_sums
from .reports import build_report, leaf_variances, report_tail
from .rollups import BASE, context_aggs, leaf_frame

NO_BUDGET_LINE = " actual; no budget supplied."
# Fixed value (must equal the reference): the actuals-only second paragraph.
NO_BUDGET_PARAGRAPH = (
    "No budget was supplied with this file, so no variance, favourable / "
    "unfavourable classification or materiality flagging is reported. "
    "Upload a budget alongside the ledger for the full variance pack.")


def _lead(n_fu: Column) -> Column:
    return F.when(n_fu > 1, F.lit("Offsetting movements in")).otherwise(F.lit("Driven by"))


ACCOUNT = ["account_code", "account_name", "category"]


def _names(items: Column, label: str = "names") -> list[Column]:
    """Names in order and how many directions they have, of sorted items."""
    return [items["name"].alias(label), F.size(F.array_distinct(items["fu"])).alias("n_fu")]


def _pool(leaf: DataFrame, by: Sequence[str], horizon: str, act: str, bud: str, rule: Materiality) -> DataFrame:
    """Material accounts of each category on one horizon, largest first."""
    var = F.col(act) - F.col(bud)
    d = leaf.withColumn("_v", var).withColumn("_p", V.pct_nm("_v", bud)).filter(V.material("_v", "_p", rule))
    fu = V.favourable("_v", V.higher_is_better_for_category("category"))
    items = F.sort_array(F.collect_list(F.struct((-F.abs(F.col("_v"))).alias("k"), F.col("account_code").alias("code"),
                                                 F.lower("account_name").alias("name"), fu.alias("fu"))))
    # no plan on this horizon: no variance, so no drivers
    planned = leaf.groupBy(*by).agg((F.coalesce(F.sum(F.abs(bud)), F.lit(0)) > 0).alias("_planned"))
    g = d.groupBy(*by, "category").agg(items.alias("items"))
    return (join_on_keys(g, planned, by).filter("_planned")
            .select(*by, "category", F.lit(horizon).alias("horizon"), *_names(F.col("items"))))


def line_comments(fy: DataFrame, period_no: int, rule: Materiality = Materiality(), by: Sequence[str] = ()) -> DataFrame:
    """A comment per P&L line (and group): two horizons, the verdict, and
    for category lines the material account drivers of the talking timeframe.
    Percentages are those of the report, at four places."""
    by = list(by)
    leaf = leaf_frame(fy, [*by, *ACCOUNT], period_no)
    context = {c: e for c, e in zip(("_budgeted", "_months", "_several"), context_aggs(period_no))}
    sums = category_sums(leaf, by, {k: F.col(k) for k in BASE}, context)
    r = report_tail(lines_from_sums(sums, by, BASE, keep=list(context)), F.col("higher_is_better"), rule,
                    F.col("_budgeted"), F.col("_months"))
    pools = _pool(leaf, by, "month", "act", "bud", rule).unionByName(_pool(leaf, by, "ytd", "yact", "ybud", rule))
    cat_of_line = F.create_map(*[x for c, l in LINE_OF_CATEGORY.items() for x in (F.lit(l), F.lit(c))])
    m_mat = F.col("flag").isin("BOTH", "MONTH")
    y_mat = F.col("flag").isin("BOTH", "YTD")
    lines = (r.withColumn("category", cat_of_line[F.col("line")])
              .withColumn("horizon", F.when(m_mat & ~y_mat, "month").otherwise("ytd")))
    j = join_on_keys(lines, pools, [*by, "category", "horizon"])
    drivers = F.when((m_mat | y_mat) & (F.coalesce(F.size("names"), F.lit(0)) > 0),
                     F.concat(F.lit(" "), _lead(F.col("n_fu")), F.lit(" "),
                              T.join_names(F.col("names")), F.lit("."))).otherwise(F.lit(""))
    text = F.when(F.col("fav_unfav").isNotNull(), F.concat(
        T.two_horizon("var_bud", V.pct_out("var_bud_pct"), m_mat, "ytd_var", V.pct_out("ytd_pct"), y_mat,
                      T.fu_word("fav_unfav")), drivers)).otherwise(
        F.concat(T.mag("actual"), F.lit(NO_BUDGET_LINE)))
    return j.select(*by, "line_ord", "line", F.trim(text).alias("comment"))


def _verdicts(df: DataFrame, var: str, bud: str, higher: bool, rule: Materiality, p: str) -> DataFrame:
    v = F.col(var)
    pct = V.pct_nm(v, bud)
    return (df.withColumn(f"{p}pct", pct)
              .withColumn(f"{p}fu", V.favourable(v, higher))
              .withColumn(f"{p}mat", V.material(v, pct, rule)))


def rollup_comments(fy: DataFrame, parent: str, child: str, period_no: int,
                    higher: bool = False, rule: Materiality = Materiality(),
                    child_names: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A comment for every parent (of a group) over its children: two
    horizons, and when either is material the material children of the talking
    timeframe (only when the parent has at least two children)."""
    key = [*by, parent]
    month, ytd = F.col("period_no") == period_no, F.col("period_no") <= period_no
    base = fy.groupBy(*key, child).agg(
        dsum(F.when(month, F.col("actual"))).alias("a"), dsum(F.when(month, F.col("budget"))).alias("b"), F.count_if(month).alias("n"),
        dsum(F.when(ytd, F.col("actual"))).alias("ya"), dsum(F.when(ytd, F.col("budget"))).alias("yb"), F.count_if(ytd).alias("yn"))
    par = base.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("a", "b", "n", "ya", "yb", "yn")]).filter("n > 0")
    par = _verdicts(par.withColumn("v", F.col("a") - F.col("b")), "v", "b", higher, rule, "m")
    par = _verdicts(par.withColumn("yv", F.col("ya") - F.col("yb")), "yv", "yb", higher, rule, "y")

    def children(a: str, b: str, n: str, horizon: str) -> DataFrame:
        c = base.filter(F.col(n) > 0).withColumn("cv", F.col(a) - F.col(b))
        c = _verdicts(c, "cv", b, higher, rule, "c")
        label = F.col(child).cast("string")
        if child_names is not None:
            c = c.join(child_names, child, "left")
            label = F.coalesce(F.col("child_label"), label)
        items = F.sort_array(F.collect_list(F.when(F.col("cmat"), F.struct(
            F.col(child).cast("string").alias("k"), T.prose_name(label).alias("name"), F.col("cfu").alias("fu")))))
        return (c.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"), items.alias("items"))
                 .select(*key, F.lit(horizon).alias("horizon"), "n_children", *_names(F.col("items"))))

    pools = children("a", "b", "n", "month").unionByName(children("ya", "yb", "yn", "ytd"))
    par = par.withColumn("horizon", F.when(F.col("mmat") & ~F.col("ymat"), "month").otherwise("ytd"))
    j = join_on_keys(par, pools, [*key, "horizon"])
    movers = F.when((F.col("mmat") | F.col("ymat")) & (F.col("n_children") >= 2)
                    & (F.coalesce(F.size("names"), F.lit(0)) > 0),
                    F.concat(F.lit(" "), _lead(F.col("n_fu")), F.lit(" "),
                             T.join_names(F.col("names")), F.lit("."))).otherwise(F.lit(""))
    text = F.concat(T.two_horizon("v", "mpct", "mmat", "yv", "ypct", "ymat", T.fu_word("mfu")), movers)
    return j.select(*key, F.trim(text).alias("comment"))


def total_comment(fy: DataFrame, child: str, period_no: int, higher: bool = False,
                  rule: Materiality = Materiality(), by: Sequence[str] = ()) -> DataFrame:
    """The grand-total row's comment: T8 with one constant parent."""
    t = fy.withColumn("_total", F.lit("total"))
    return rollup_comments(t, "_total", child, period_no, higher, rule, by=by).drop("_total")


def _article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def narrative(gl: DataFrame, by: Sequence[str] = (), rule: Materiality = Materiality()) -> DataFrame:
    """Three paragraphs per group (result; revenue and gross
    profit; material account drivers), or the actuals-only text when the
    group has no plan."""
    by = list(by)
    gl = gl.groupBy(*by, *[c for c in ACCOUNT if c not in by]).agg(
        *[dsum(F.col(m)).alias(m) for m in ("actual", "budget", "prior_year")])   # the one pass over the postings
    r = build_report(gl, by, rule)
    short = {"Revenue": "rev", "Cost of goods sold": "cogs", "Gross profit": "gp",
             "Operating expenses": "opex", "Operating income (EBIT)": "ebit", "Net income": "ni"}
    cols = []
    for line, s in short.items():
        for c in ("actual", "var_bud", "var_bud_pct", "fav_unfav"):
            cols.append(F.max(F.when(F.col("line") == line, F.col(c))).alias(f"{s}_{c}"))
    wide = r.groupBy(*by).agg(*cols)

    def c(name: str) -> Column:
        return F.col(name)

    def dirw(v: Column) -> Column:
        return F.when(v >= 0, F.lit("above")).otherwise(F.lit("below"))

    ni_fu = T.fu_word(c("ni_fav_unfav"))
    p1 = F.concat(
        F.when(c("ni_actual") < 0, F.concat(F.lit("A net loss of "), T.mag("ni_actual")))
         .otherwise(F.concat(F.lit("Net income of "), T.mag("ni_actual"))),
        F.lit(" came in "), T.mag("ni_var_bud"), F.lit(" ("), T.pct_text("ni_var_bud_pct"), F.lit(") "),
        dirw(c("ni_var_bud")), F.lit(" budget, "), _article(ni_fu), F.lit(" "), ni_fu,
        F.lit(" result. This reflects "),
        F.when(c("ebit_actual") < 0, F.concat(F.lit("an operating loss of "), T.mag("ebit_actual")))
         .otherwise(F.concat(F.lit("operating income (EBIT) of "), T.mag("ebit_actual"))),
        F.lit(", "), T.mag("ebit_var_bud"), F.lit(" ("), T.pct_text("ebit_var_bud_pct"), F.lit(") "),
        dirw(c("ebit_var_bud")), F.lit(" plan."))
    rev_clause = F.when(c("rev_var_bud_pct").isNull() | (F.abs(c("rev_var_bud_pct")) < 0.01),
                        F.concat(F.lit("Revenue of "), T.mag("rev_actual"),
                                 F.lit(" was broadly in line with budget"))).otherwise(
        F.concat(F.lit("Revenue of "), T.mag("rev_actual"), F.lit(" was "), T.mag("rev_var_bud"),
                 F.lit(" ("), T.pct_text("rev_var_bud_pct"), F.lit(") "), dirw(c("rev_var_bud")),
                 F.lit(" budget")))
    p2 = F.concat(rev_clause, F.lit(". Gross profit of "), T.mag("gp_actual"), F.lit(" was "),
                  T.mag("gp_var_bud"), F.lit(" ("), T.pct_text("gp_var_bud_pct"), F.lit(") "),
                  dirw(c("gp_var_bud")), F.lit(" budget, with cost of goods sold "),
                  dirw(c("cogs_var_bud")), F.lit(" plan by "), T.mag("cogs_var_bud"), F.lit(" ("),
                  T.pct_text("cogs_var_bud_pct"), F.lit(")."))
    # paragraph 3: material leaves per group, unfavourable and favourable
    lv = leaf_variances(gl, by=by, rule=rule).filter(F.col("material"))
    phrase = F.concat(F.lower(F.col("account_name")), F.lit(" ("), T.mag("var_bud"), F.lit(", "),
                      T.pct_text("var_bud_pct"), F.lit(" "), dirw(F.col("var_bud")), F.lit(" budget)"))
    item = F.struct((-F.abs(F.col("var_bud"))).alias("k"), F.col("account_code").alias("code"),
                    phrase.alias("p"))
    drv = lv.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("fav_unfav") == "U", item))).alias("u"),
        F.sort_array(F.collect_list(F.when(F.col("fav_unfav") == "F", item))).alias("f"))
    wide = join_on_keys(wide, drv, by) if by else attach_scalar(wide, drv)
    nu, nf = F.coalesce(F.size("u"), F.lit(0)), F.coalesce(F.size("f"), F.lit(0))
    unfav = F.when(nu > 0, F.concat(F.lit("The main unfavourable drivers were "),
                                    T.join_names(F.col("u.p")), F.lit(".")))
    fav = F.when(nf > 0, F.concat(F.when(nu > 0, F.lit("This was partly offset by"))
                                   .otherwise(F.lit("The main favourable drivers were")),
                                   F.lit(" "), T.join_names(F.col("f.p")), F.lit(".")))
    p3 = F.when((nu + nf) == 0, F.lit("No account-level variances cleared the materiality thresholds.")
                ).otherwise(F.concat_ws(" ", unfav, fav))
    budgeted = c("ni_fav_unfav") != ""
    # actuals-only
    margin = F.when(c("rev_actual") != 0, F.concat(
        F.lit(" a gross margin of "),
        F.round(V.dbl("gp_actual") / V.dbl("rev_actual") * 100, 1).cast("decimal(38,1)").cast("string"),
        F.lit("%"))).otherwise(F.lit(" no revenue in the period"))
    ni_term = F.when(c("ni_actual") < 0, F.concat(F.lit("a net loss of "), T.mag("ni_actual"))) \
        .otherwise(F.concat(F.lit("net income of "), T.mag("ni_actual")))
    a1 = F.concat(F.lit("Revenue of "), T.mag("rev_actual"), F.lit(" produced gross profit of "),
                  T.mag("gp_actual"), F.lit(","), margin, F.lit(". After operating expenses of "),
                  T.mag("opex_actual"), F.lit(" the result is "), T.mag("ebit_actual"),
                  F.lit(" at EBIT and "), ni_term, F.lit("."))
    text = F.when(budgeted, F.concat_ws("\n\n", p1, p2, p3)).otherwise(
        F.concat_ws("\n\n", a1, F.lit(NO_BUDGET_PARAGRAPH)))
    return wide.select(*by, budgeted.alias("budgeted"), text.alias("narrative"))
