"""Parsing and cleaning as native Column expressions.

No UDFs: the amount parser is a chain of ``regexp_replace`` / ``rlike`` /
``when`` with the sign carried as an XOR of booleans, run once per distinct shape
of a text; the result goes through ``try_cast`` so an unreadable value becomes
NULL instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference)
# ---------------------------------------------------------------------------
# Cell texts read as "no amount".
AMOUNT_BLANKS = ["", "na", "n/a", "n.a.", "-", "–", "—", "nil", "none", "null"]
# Debit / credit markers (SAP S/H, English D/C and DR/CR, Hungarian T/K).
CREDIT_MARKERS = ["c", "cr", "credit", "h", "k", "-", "2"]
# Trailing credit/debit marker on an amount.
TRAILING_MARKER = r"(?i)[\s.]*\b(cr|dr)\b[\s.]*$"

AMOUNT_TYPE = "decimal(38,6)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _amount_stages(src: Column):
    """The parser as a list of (name, expression) stages; each stage reads the
    previous stage's column only, so it can be projected step by step."""
    return [
        ("s1", lambda c: _strip(F.translate(src.cast("string"),
                                            "\u2212\u00a0\u202f\u2009", "-   "))),
        ("blank", lambda c: c("s1").isNull() | F.lower(c("s1")).isin(AMOUNT_BLANKS)),
        ("paren", lambda c: c("s1").startswith("(") & c("s1").endswith(")")),
        ("s2", lambda c: F.when(c("paren"), _strip(F.regexp_replace(c("s1"), r"^\(|\)$", "")))
                          .otherwise(c("s1"))),
        ("credit", lambda c: F.lower(F.regexp_extract(c("s2"), TRAILING_MARKER, 1)) == "cr"),
        ("s4", lambda c: F.regexp_replace(_strip(F.regexp_replace(c("s2"), TRAILING_MARKER, "")),
                                          r"[^0-9,.\-]", "")),
        ("trail", lambda c: c("s4").endswith("-")),
        ("s5", lambda c: F.regexp_replace(c("s4"), r"-$", "")),
        ("lead", lambda c: c("s5").startswith("-")),
        ("s6", lambda c: F.regexp_replace(F.regexp_replace(c("s5"), r"^-", ""), "-", "")),
        ("num", lambda c: _separators(c("s6"))),
        ("value", lambda c: c("num").try_cast(AMOUNT_TYPE)),
        ("out", lambda c: F.when(c("blank"), F.lit(None))
                           .when((c("paren") != c("credit")) != (c("trail") != c("lead")),
                                 -c("value"))
                           .otherwise(c("value")).cast(AMOUNT_TYPE)),
    ]


def _separators(s6: Column) -> Column:
    has_dot, has_comma = s6.contains("."), s6.contains(",")
    both = (F.when(s6.rlike(r",[^.]*$"), F.translate(F.regexp_replace(s6, r"\.", ""), ",", "."))
             .otherwise(F.regexp_replace(s6, ",", "")))
    comma_only = (F.when(s6.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+$"), F.regexp_replace(s6, ",", ""))
                   .when(s6.rlike(r",[0-9]{1,2}$"), F.translate(s6, ",", "."))
                   .otherwise(F.regexp_replace(s6, ",", "")))
    dot_only = (F.when(s6.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+$"), F.regexp_replace(s6, r"\.", ""))
                 .otherwise(s6))
    return (F.when(has_dot & has_comma, both).when(has_comma, comma_only)
             .when(has_dot, dot_only).otherwise(s6))


def parse_amount(x) -> Column:
    """N1 as one Column expression (for small inputs and tests). Large frames
    should use ``with_amounts``, which projects the stages one at a time and
    keeps the generated code small."""
    cols: dict[str, Column] = {}
    for name, f in _amount_stages(_c(x)):
        cols[name] = f(lambda n: cols[n])
    return cols["out"]


_DIGITS, _RUN = "0123456789", "9" * 8
# Texts that the cast reads as the parser does: no thousands mark, no other character.
_PLAIN = r"\A-?[0-9]+(?:\.[0-9]{1,2})?\z"


def amount_shape(x) -> Column:
    """What decides how a text is read: every digit as 9, long runs of digits
    shortened (a run of four or more stays one), NULL where there is no digit."""
    t = F.translate(_c(x).cast("string"), _DIGITS, "9" * 10)
    for _ in range(2):
        t = F.replace(t, F.lit(_RUN), F.lit(_RUN[:4]))
    return F.when(_c(x).cast("string").rlike("[0-9]"), t)


def amount_rules(shapes: DataFrame) -> DataFrame:
    """The parser's reading of each shape: (shape, negative, others, mark).
    ``others`` are the characters that are no digits, ``mark`` is the decimal
    mark or empty, NULL for a shape that holds no readable amount."""
    d = shapes
    for name, f in _amount_stages(F.col("shape")):
        d = d.withColumn(f"__{name}", f(lambda n: F.col(f"__{n}")))
    s6 = F.col("__s6")
    has_dot, has_comma = s6.contains("."), s6.contains(",")
    mark = (F.when(has_dot & has_comma, F.when(s6.rlike(r",[^.]*$"), ",").otherwise("."))
             .when(has_comma & ~s6.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$") & s6.rlike(r",[0-9]{1,2}$"), ",")
             .when(has_dot & ~has_comma & ~s6.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), ".").otherwise(""))
    negative = (F.col("__paren") != F.col("__credit")) != (F.col("__trail") != F.col("__lead"))
    # No filter: it would be pushed below the stages and repeat them.
    return d.select("shape", negative.alias("negative"), F.regexp_replace("shape", "[0-9]", "").alias("others"),
                    F.when(F.col("__out").isNotNull(), mark).alias("mark"))


def with_amounts(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """N1 over a DataFrame: ``targets`` maps output column -> text column.

    EU/US number text with four negative conventions -> decimal: blanks are NULL;
    unicode minus and thin/no-break spaces are read; ``( )`` negates; a trailing CR
    toggles the sign (DR is dropped); everything but digits, separators and minus
    is removed; a trailing then a leading minus toggle; the rightmost separator
    decides decimal vs thousands.

    Plain numbers are cast as they are. Of the others, texts of one shape are read
    alike, so the chain of regular expressions runs once per distinct shape of the
    whole frame (a few hundred in a ledger). Rows look their shape up and are read
    with one translation and one cast; the join keys are NULL for plain numbers and
    for texts without a digit."""
    keys = {out: f"__shape_{i}" for i, out in enumerate(targets)}
    plain = lambda src: F.col(src).cast("string").rlike(_PLAIN)
    shape = lambda src, known: F.when(~known, amount_shape(src))
    shaped = df.withColumns({f"{k}_plain": plain(targets[out]) for out, k in keys.items()})
    shaped = shaped.withColumns({k: shape(targets[out], F.col(f"{k}_plain")) for out, k in keys.items()})
    shapes = df.select(F.explode(F.array(*[shape(src, plain(src)) for src in targets.values()])).alias("shape")).filter("shape IS NOT NULL").distinct()
    rules = written(amount_rules(shapes))   # its size is then known: broadcast while small, no shuffle by shape
    for out, src in targets.items():
        k = keys[out]
        named = rules.select(F.col("shape").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("negative", "others", "mark")])
        others, mark = F.col(f"{k}_others"), F.col(f"{k}_mark")
        text = F.col(src).cast("string")
        number = F.when(F.col(f"{k}_plain") | (others == ""), text).otherwise(
            F.call_function("translate", F.rtrim(text, others), F.concat(mark, others), F.when(mark != "", ".").otherwise("")))
        value = number.try_cast(AMOUNT_TYPE)
        shaped = (shaped.join(named, k, "left").withColumn(out, F.when(F.col(f"{k}_negative"), -value).otherwise(value).cast(AMOUNT_TYPE))
                  .drop(k, f"{k}_plain", f"{k}_negative", f"{k}_others", f"{k}_mark"))
    return shaped


def period_key(x) -> Column:
    """All digits concatenated; YYYYMM from the first six when the month
    is 1-12 and the year 1900-2999, else MMYYYY, else NULL."""
    d = F.regexp_replace(_c(x).cast("string"), r"[^0-9]", "")
    ok = F.length(d) >= 6
    y = F.substring(d, 1, 4).try_cast("int")
    m = F.substring(d, 5, 2).try_cast("int")
    m2 = F.substring(d, 1, 2).try_cast("int")
    y2 = F.substring(d, 3, 4).try_cast("int")
    ymd = m.between(1, 12) & y.between(1900, 2999)
    mdy = m2.between(1, 12) & y2.between(1900, 2999)
    return (F.when(ok & ymd, y * 100 + m).when(ok & mdy, y2 * 100 + m2)).cast("int")


def dc_sign(marker) -> Column:
    """-1 for a credit marker, +1 otherwise (unknown reads as debit)."""
    m = F.lower(F.trim(_c(marker).cast("string")))
    return F.when(m.isin(CREDIT_MARKERS), F.lit(-1)).otherwise(F.lit(1))


def signed_by_marker(amount, marker) -> Column:
    return F.abs(_c(amount)) * dc_sign(marker)


def debit_minus_credit(debit=None, credit=None) -> Column:
    """Debit - credit with NULL as 0; either side optional."""
    z = F.lit(0).cast(AMOUNT_TYPE)
    d = F.coalesce(_c(debit), z) if debit is not None else z
    c = F.coalesce(_c(credit), z) if credit is not None else z
    return d - c


def canonical_category(x) -> Column:
    """Trim + title case, Cogs -> COGS, Opex -> OpEx."""
    t = F.initcap(F.trim(_c(x).cast("string")))
    return F.when(t == "Cogs", "COGS").when(t == "Opex", "OpEx").otherwise(t)


def clean_dimension(x) -> Column:
    """NULL / 'nan' / 'None' -> '', trimmed."""
    t = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(t.isin("nan", "None"), F.lit("")).otherwise(t)


def infer_category(code) -> Column:
    """K6: first character 4/5/6/7 -> Revenue/COGS/OpEx/Other, else OpEx."""
    f = F.substring(F.trim(_c(code).cast("string")), 1, 1)
    return (F.when(f == "4", "Revenue").when(f == "5", "COGS").when(f == "6", "OpEx")
             .when(f == "7", "Other").otherwise("OpEx"))
