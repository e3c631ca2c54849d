"""Commentary building blocks as native string Column expressions.

Numbers are rounded on decimals before formatting, so the text does not
depend on how an engine rounds binary doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): verdict sentences of the
# two-horizon comment, keyed by (month material, YTD material).
VERDICTS = {
    (True, True): "Material on both timeframes.",
    (False, True): "Material cumulatively; the month alone stays within the floors.",
    (True, False): "Material this month; the year to date is still within the floors.",
    (False, False): "Neither timeframe clears the materiality floors.",
}
AMBIGUOUS_SEPARATORS = [" - ", " – ", ", "]
IN_LINE = "in line with budget"
NOT_MEANINGFUL = "percentage not meaningful"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dec(x) -> Column:
    return F.abs(_c(x).cast("decimal(38,4)"))


def mag(x) -> Column:
    """EUR magnitude: m above a million, k above a thousand, else whole."""
    a = _dec(x)
    m = F.round(a * F.lit(0.000001).cast("decimal(7,6)"), 1).cast("decimal(38,1)").cast("string")
    k = F.round(a * F.lit(0.001).cast("decimal(4,3)"), 1).cast("decimal(38,1)").cast("string")
    u = F.round(a, 0).cast("decimal(38,0)").cast("string")
    return (F.when(a >= 1000000, F.concat(F.lit("€"), m, F.lit("m")))
             .when(a >= 1000, F.concat(F.lit("€"), k, F.lit("k")))
             .otherwise(F.concat(F.lit("€"), u)))


def pct_text(x) -> Column:
    """|pct| as a percentage with one decimal, NULL -> 'n/a'."""
    p = F.round(F.abs(_c(x)).cast("decimal(38,10)") * 100, 1).cast("decimal(38,1)").cast("string")
    return F.when(_c(x).isNull(), F.lit("n/a")).otherwise(F.concat(p, F.lit("%")))


def prose_name(x) -> Column:
    """T4: lower case for prose, except code-like tokens (letters and digits,
    no space, no lower case) which stay as written."""
    s = F.trim(_c(x).cast("string"))
    code = (~s.rlike(r"\p{Ll}")) & s.rlike(r"\p{Nd}") & s.rlike(r"\p{L}") & ~s.contains(" ")
    return F.when(code, s).otherwise(F.lower(s))


def join_names(items) -> Column:
    """T3: 'a', 'a and b', 'a, b and c'; '; ' between all items when any
    item itself holds a separator."""
    arr = F.filter(_c(items), lambda i: i.isNotNull() & (i != ""))
    n = F.size(arr)
    ambiguous = F.exists(arr, lambda i: i.contains(" - ") | i.contains(" – ") | i.contains(", "))
    plain = (F.when(n == 0, F.lit("")).when(n == 1, F.element_at(arr, 1))
              .otherwise(F.concat(F.array_join(F.slice(arr, 1, n - 1), ", "), F.lit(" and "),
                                  F.element_at(arr, -1))))
    return F.when((n >= 2) & ambiguous, F.array_join(arr, "; ")).otherwise(plain)


def clause(var, pct, fu_word=None) -> Column:
    """T5: one timeframe as a phrase."""
    v, p = _c(var), _c(pct)
    direction = F.when(v >= 0, F.lit("above")).otherwise(F.lit("below"))
    core = (F.when(p.isNull(), F.concat(mag(v), F.lit(" "), direction, F.lit(" budget, " + NOT_MEANINGFUL)))
             .otherwise(F.concat(mag(v), F.lit(" ("), pct_text(p), F.lit(") "), direction,
                                 F.lit(" budget"))))
    if fu_word is not None:
        core = F.when(_c(fu_word).isNull() | (_c(fu_word) == ""), core).otherwise(
            F.concat(core, F.lit(", "), _c(fu_word)))
    in_line = (F.abs(v) < 0.5) | (p.isNotNull() & (F.abs(p) < 0.005))
    return F.when(in_line, F.lit(IN_LINE)).otherwise(core)


def fu_word(fu) -> Column:
    return F.when(_c(fu) == "F", F.lit("favourable")).otherwise(F.lit("unfavourable"))


def verdict_sentence(month_material, ytd_material) -> Column:
    m, y = F.coalesce(_c(month_material), F.lit(False)), F.coalesce(_c(ytd_material), F.lit(False))
    return (F.when(m & y, VERDICTS[(True, True)]).when(y, VERDICTS[(False, True)])
             .when(m, VERDICTS[(True, False)]).otherwise(VERDICTS[(False, False)]))


def two_horizon(m_var, m_pct, m_mat, y_var, y_pct, y_mat, word) -> Column:
    """Year to date (with the verdict word), then the month, then which
    timeframe clears the floors."""
    return F.concat(F.lit("YTD "), clause(y_var, y_pct, word), F.lit(". Month "),
                    clause(m_var, m_pct), F.lit(". "), verdict_sentence(m_mat, y_mat))