"""Text folding and row-shape predicates as Column expressions.

Spark SQL has no NFKD normalisation, so accents are folded with
``translate``. The translation table is derived by rule, at import, from
Unicode decomposition over Latin-1 Supplement and Latin Extended-A: every
letter whose compatibility decomposition is one ASCII letter plus combining
marks maps to that letter (this covers the Hungarian long umlauts). Letters
without such a decomposition (for example the sharp s) stay as they are, as
they do under NFKD.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x00C0, 0x0180):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch)
                       if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): words that name a total rather
# than an account, folded and accent-free (Hungarian, English, German).
# ---------------------------------------------------------------------------
TOTAL_WORDS = [
    "osszesen", "mindosszesen", "vegosszeg", "egyenleg", "forgalom",
    "total", "subtotal", "sub-total", "grand total", "sum", "summe",
    "gesamt", "zwischensumme", "saldo", "balance", "net", "gross",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x) -> Column:
    """Lower case and strip accents, whether composed or written as a letter
    and a combining mark; punctuation kept."""
    plain = F.translate(F.lower(_c(x).cast("string")), ACCENTED, UNACCENTED)
    return F.regexp_replace(plain, r"\p{M}+", "")


def normalise_header(x) -> Column:
    """M1: fold, anything outside [0-9a-z] and whitespace -> space, collapse
    whitespace, trim."""
    s = F.regexp_replace(fold(x), r"[^0-9a-z\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def looks_like_total(name, code) -> Column:
    """The folded name (stripped of ' .:-\\t' at both ends) is a total
    word -> always a total row; it starts or ends with one -> a total row
    only when the code holds no digit."""
    text = F.regexp_replace(fold(F.coalesce(_c(name).cast("string"), F.lit(""))),
                            r"^[ .:\-\t]+|[ .:\-\t]+$", "")
    coded = F.coalesce(_c(code).cast("string"), F.lit("")).rlike("[0-9]")
    exact = text.isin(TOTAL_WORDS)
    edge = None
    for w in TOTAL_WORDS:
        e = text.startswith(w + " ") | text.endswith(" " + w)
        edge = e if edge is None else (edge | e)
    return (text != "") & (exact | (edge & ~coded))
