"""Queries over the extract catalogue: reading (S1-S4), column mapping
and standardisation (N11). The oracles state the expected shape of each extract
and derive the amounts from the ledger, not from the extract's text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as V
from ..functions.keywords import CANONICAL
from ..functions.structure import UNCLASSIFIED_EXPENSE
from ..functions.text import normalise_header
from ..operators import extracts as E
from ..operators import normalise as NO
from ..session import written
from ..sources import extracts as XT
from . import sqlgen as S
from .oracle_views import with_views
from .q_classify import ETYPE
from .registry import register

# expected (extract, position, header, field), by reading the headers
_HEADERS = {
    "AFRICA": [("Account", "account_code"), ("Account name", "account_name"), ("Period", "period"), ("Amount", "actual"),
               ("Budget", "budget"), ("Dept", "department"), ("Cost centre", "cost_centre"), ("Memo", None)],
    "AMERICA": [("Főkönyvi számla", "account_code"), ("Megnevezés", "account_name"), ("Időszak", "period"), ("Tény", "actual"),
                ("Terv", "budget"), ("Részleg", "department"), ("Költséghely", "cost_centre")],
    "ASIA": [("GL code", "account_code"), ("GL description", "account_name"), ("Posting period", "period"), ("Debit", "debit"),
             ("Credit", "credit"), ("Budget amount", "budget"), ("Division", "department"), ("CC code", "cost_centre")],
    "EUROPE": [("Nominal code", "account_code"), ("Description", "account_name"), ("Month", "period"), ("Amt", "actual"),
               ("D/C", "dc_indicator"), ("Plan", "budget"), ("Function", "department"), ("Cctr", "cost_centre")],
    "MIDDLE EAST": [("Ref A", "account_code"), ("Account name", "account_name"), ("Period", "period"), ("Wert", "actual"),
                    ("Seq", None), ("Dept", "department"), ("Currency", None)],
}
_CONTENT = {("MIDDLE EAST", "account_code"): 0.75, ("MIDDLE EAST", "actual"): 0.6}
_DELIMITER = {"AFRICA": ",", "AMERICA": ";", "ASIA": "\t", "EUROPE": "|", "MIDDLE EAST": ";"}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_COLUMNS = _values("hc", "extract_id, pos, header, field", [(e, i, h, f) for e, hs in _HEADERS.items() for i, (h, f) in enumerate(hs)])
_ENTITIES = "en AS (SELECT DISTINCT entity AS extract_id FROM ledger)"


class _Read:
    """The reading chain over the catalogue, step by step. Extracts with quotes are
    joined to records, whose cells are written once (of blank records too, which the
    header scan counts); the lines of the others are cut where they are read. The
    small tables that later steps read several times are written once."""

    def __init__(self, spark, sf_dir):
        self.lines = lines = XT.extract_lines(spark, sf_dir)
        ranges = E.line_ranges(lines)
        first = E.first_lines(lines, ranges)
        self.delimiters = written(E.sniff_delimiters(lines, ranges, first))
        self.quoted = written(ranges.filter("quoted").select("extract_id").distinct())
        # a line meets the small table of the extracts that are read its way, and no other
        self.plain = written(self.delimiters.join(self.quoted, "extract_id", "left_anti"))
        records = E.records(lines, written(self.delimiters.join(self.quoted, "extract_id", "left_semi")))
        self.records = written(E.cells_of_records(records).withColumn("holds", F.exists("cells", lambda c: c.isNotNull())))
        self.cells = self.cells_of()
        plain = first.join(self.quoted, "extract_id", "left_anti")
        head = E.head_of_lines(plain, self.plain).unionByName(E.head_rows(self.cells, self.records))
        self.headers = written(E.header_rows(self.cells, self.records, head))
        self.data, columns = E.headed(self.cells, self.headers, head)
        self.columns = written(columns)

    def cells_of(self, some=None):
        """The cells of all extracts, or of ``some``: then no other line is cut."""
        lines, records = self.lines, self.records.filter("cells IS NOT NULL")
        if some is not None:
            lines, records = (x.join(some, "extract_id", "left_semi") for x in (lines, records))
        return E.fields_of_lines(lines, self.plain).unionByName(records)

    def profile(self, fuzzy=False):
        """Without ``fuzzy`` names are matched by synonyms only, as M2 does: what the
        SQL of all queries but m4_match_columns states."""
        self.matched = written(E.match_columns(self.columns, fuzzy=fuzzy))
        some = written(E.unmapped(self.columns, self.matched).select("extract_id").distinct())
        data = E.data_rows(self.cells_of(some), self.headers)
        return written(E.profile_columns(E.free_cells(data, self.columns, self.matched)))

    def mapping(self, fuzzy=False):
        profile = self.profile(fuzzy)
        return written(E.assign_by_content(self.matched, profile))


@register("s2_delimiter", with_views("SELECT d.* FROM d JOIN en USING (extract_id)", "ledger", extra=[
    _ENTITIES, _values("d", "extract_id, delimiter", list(_DELIMITER.items()))]))
def s2_delimiter(spark, sf_dir):
    return E.sniff_delimiters(XT.extract_lines(spark, sf_dir))


_LINE_ID = "(doc_no * 10 + line_no)"


@register("s1_load_extracts", with_views(
    "SELECT extract_id, n + 3 AS n_rows, w AS widest, w AS narrowest, n * per_row + 1 + h + 2 + CASE WHEN extract_id = 'AFRICA' THEN n - cut ELSE 0 END AS filled, "
    "CASE WHEN extract_id = 'AFRICA' THEN doubled ELSE 0 END AS with_quote, CASE WHEN extract_id = 'AFRICA' THEN broken ELSE 0 END AS with_break, "
    "CASE WHEN extract_id = 'AFRICA' THEN doubled + broken + thousands ELSE 0 END AS with_comma FROM (SELECT entity AS extract_id, count(*) AS n, "
    f"count(*) FILTER (WHERE {_LINE_ID} % 4 = 0) AS doubled, count(*) FILTER (WHERE {_LINE_ID} % 4 = 1) AS broken, count(*) FILTER (WHERE {_LINE_ID} % 4 = 3) AS cut, "
    "count(*) FILTER (WHERE abs(round(actual, 2)) >= 1000) AS thousands FROM ledger GROUP BY entity) c JOIN w USING (extract_id)",
    "ledger", extra=[_values("w", "extract_id, w, h, per_row", [(e, len(h) + 1, len(h), 7 if e != "EUROPE" else 8) for e, h in _HEADERS.items()])]))
def s1_load_extracts(spark, sf_dir):
    """Rows and cells per extract: every row as wide as the widest, quoted cells
    with doubled quotes, line breaks and (of the comma file) delimiters in them."""
    r = _Read(spark, sf_dir)
    holds = lambda x: F.count_if(F.coalesce(F.col("c").contains(x), F.lit(False)))
    every = E.pad_rows(r.cells).select("extract_id", F.size("cells").cast("long").alias("width"), F.posexplode("cells").alias("pos", "c"))
    every = every.withColumn("c", E.cell("c"))
    return every.groupBy("extract_id").agg(
        F.count_if(F.col("pos") == 0).alias("n_rows"), F.max("width").alias("widest"), F.min("width").alias("narrowest"),
        F.count("c").alias("filled"), holds('"').alias("with_quote"), holds("\n").alias("with_break"),
        F.count_if((F.col("extract_id") == "AFRICA") & F.coalesce(F.col("c").contains(","), F.lit(False))).alias("with_comma"))


@register("s3_header_row", with_views(f"SELECT extract_id, {XT.HEADER_LINE} AS header_line FROM en", "ledger", extra=[_ENTITIES]))
def s3_header_row(spark, sf_dir):
    return _Read(spark, sf_dir).headers


@register("s4_drop_blank", with_views(
    "SELECT hc.extract_id, pos, header, CASE WHEN header = 'Debit' THEN nd + 1 WHEN header = 'Credit' THEN nr WHEN field = 'actual' OR header = 'Account name' "
    "OR header IN ('Megnevezés', 'GL description', 'Description') THEN n + 1 WHEN header = 'Memo' THEN n - cut ELSE n END AS n_values FROM hc JOIN (SELECT entity, count(*) AS n, "
    f"count(*) FILTER ({_LINE_ID} % 4 = 3) AS cut, "
    "count(*) FILTER (category = 'Revenue') AS nr, count(*) FILTER (category <> 'Revenue') AS nd FROM ledger GROUP BY entity) c ON c.entity = hc.extract_id"
    .replace("FILTER (", "FILTER (WHERE "), "ledger", extra=[_COLUMNS]))
def s4_drop_blank(spark, sf_dir):
    return _Read(spark, sf_dir).columns.select("extract_id", "pos", "header", "n_values")


@register("m1_normalise_header", with_views(
    "SELECT extract_id, pos, trim(regexp_replace(regexp_replace(strip_accents(lower(header)), '[^0-9a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm "
    "FROM hc JOIN en USING (extract_id)", "ledger", extra=[_ENTITIES, _COLUMNS]))
def m1_normalise_header(spark, sf_dir):
    return _Read(spark, sf_dir).columns.select("extract_id", "pos", normalise_header("header").alias("norm"))


@register("m2_synonym_match", with_views(
    "SELECT extract_id, field, pos, header FROM hc JOIN en USING (extract_id) WHERE field IS NOT NULL "
    "AND NOT (extract_id = 'MIDDLE EAST' AND field IN ('account_code', 'actual'))", "ledger", extra=[_ENTITIES, _COLUMNS]))
def m2_synonym_match(spark, sf_dir):
    return E.match_columns(_Read(spark, sf_dir).columns, fuzzy=False).select("extract_id", "field", "pos", "header")


def _mapping_sql(columns: str) -> str:
    content = " ".join(f"WHEN extract_id = '{e}' AND field = '{f}' THEN {s}" for (e, f), s in _CONTENT.items())
    return (f"SELECT {columns} FROM (SELECT extract_id, field, pos, header, CASE {content} ELSE 1.0 END AS score, "
            f"CASE WHEN (CASE {content} ELSE 1.0 END) < 1 THEN 'content' ELSE 'synonym' END AS method FROM hc JOIN en USING (extract_id) WHERE field IS NOT NULL) q")


# 11 letters of "account name" are in "account number", in order: account_code, the first field, takes it
@register("m4_match_columns", with_views(
    "SELECT * FROM (" + _mapping_sql("extract_id, field, header, method, CAST(score AS DOUBLE) AS score") + ") x "
    "WHERE NOT (extract_id = 'MIDDLE EAST' AND field IN ('account_code', 'account_name')) "
    "UNION ALL SELECT extract_id, 'account_code', 'Account name', 'fuzzy', round(CAST(2 * 11 AS DOUBLE) / (12 + 14), 2) FROM en WHERE extract_id = 'MIDDLE EAST'",
    "ledger", extra=[_ENTITIES, _COLUMNS]))
def m4_match_columns(spark, sf_dir):
    return _Read(spark, sf_dir).mapping(fuzzy=True).select("extract_id", "field", "header", "method", "score")


@register("m5_override", with_views(
    "SELECT extract_id, field, header, 'synonym' AS method FROM hc JOIN en USING (extract_id) WHERE extract_id = 'AFRICA' AND field IS NOT NULL "
    "UNION ALL SELECT extract_id, 'entity', 'Dept', 'override' FROM en WHERE extract_id = 'AFRICA'", "ledger", extra=[_ENTITIES, _COLUMNS]))
def m5_override(spark, sf_dir):
    """A manual override takes its column, also one that an earlier field has by
    its name; one whose header is missing does nothing."""
    r = _Read(spark, sf_dir)
    given = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit("AFRICA").alias("extract_id"), F.lit(f).alias("field"), F.lit(h).alias("header"))
                                                     for f, h in (("department", "No such header"), ("entity", "Dept"))])))
    m = E.match_columns(r.columns.filter(F.col("extract_id") == "AFRICA"), given, fuzzy=False)
    return m.select("extract_id", "field", "header", "method")


@register("m6_code_profile", with_views(
    "SELECT 'MIDDLE EAST' AS extract_id, header, share > 0.7 AS is_code FROM (SELECT 'Ref A' AS header, avg(CASE WHEN regexp_full_match(account_code, '[0-9]{3,6}') "
    "THEN 1 ELSE 0 END) AS share FROM ledger WHERE entity = 'MIDDLE EAST' UNION ALL SELECT 'Seq', avg(CASE WHEN regexp_full_match(CAST(doc_no * 10 + line_no AS VARCHAR), "
    "'[0-9]{3,6}') THEN 1 ELSE 0 END) FROM ledger WHERE entity = 'MIDDLE EAST' UNION ALL SELECT 'Currency', 0 UNION ALL SELECT 'Wert', 0) q "
    "UNION ALL SELECT 'AFRICA', 'Memo', false", "ledger"))
def m6_code_profile(spark, sf_dir):
    r = _Read(spark, sf_dir)
    p = r.profile()
    return p.select("extract_id", "header", (F.col("code_share") > E.CODE_SHARE).alias("is_code"))


@register("m7_money_profile", with_views(
    "SELECT 'MIDDLE EAST' AS extract_id, header, money FROM (VALUES ('Wert', true), ('Seq', false), ('Currency', false)) t(header, money) "
    "UNION ALL SELECT 'AFRICA', 'Memo', false", "ledger"))
def m7_money_profile(spark, sf_dir):
    """Amounts are money, a line counter and a text column are not (the account
    column is taken by its codes)."""
    r = _Read(spark, sf_dir)
    p = r.profile()
    return p.filter(F.col("header") != "Ref A").select("extract_id", "header", "money")


@register("m8_assign_actual", with_views(
    "SELECT extract_id, field, header, score FROM (" + _mapping_sql("extract_id, field, header, method, CAST(score AS DOUBLE) AS score")
    + ") x WHERE method = 'content'", "ledger", extra=[_ENTITIES, _COLUMNS]))
def m8_assign_actual(spark, sf_dir):
    return _Read(spark, sf_dir).mapping().filter("method = 'content'").select("extract_id", "field", "header", "score")


@register("m9_mapping_report", with_views(
    "SELECT en.extract_id, c.field, m.header AS mapped_from, coalesce(m.method, 'unmatched') AS method, coalesce(CAST(m.score AS DOUBLE), 0.0) AS confidence, "
    "c.field IN ('account_code', 'account_name') AS required FROM en CROSS JOIN c LEFT JOIN (" + _mapping_sql("*") + ") m ON m.extract_id = en.extract_id AND m.field = c.field",
    "ledger", extra=[_ENTITIES, _COLUMNS, _values("c", "field", [(f,) for f in CANONICAL])]))
def m9_mapping_report(spark, sf_dir):
    return E.mapping_report(_Read(spark, sf_dir).mapping()).drop("ord")


@register("m10_unmapped", with_views("SELECT extract_id, pos, header FROM hc JOIN en USING (extract_id) WHERE field IS NULL", "ledger",
                                     extra=[_ENTITIES, _COLUMNS]))
def m10_unmapped(spark, sf_dir):
    r = _Read(spark, sf_dir)
    return E.unmapped(r.columns, r.mapping())


@register("m11_required", with_views(
    "SELECT extract_id, f AS field FROM en, (VALUES ('account_code'), ('actual (or budget)')) t(f) WHERE extract_id = 'MIDDLE EAST'", "ledger", extra=[_ENTITIES]))
def m11_required(spark, sf_dir):
    """Before content detection the extract with unknown headers lacks fields."""
    r = _Read(spark, sf_dir)
    return E.missing_fields(E.match_columns(r.columns, fuzzy=False), r.columns)


def _standard(r: _Read, mapping):
    return NO.standardise(E.mapped_texts(r.data, mapping))


@register("m12_guards", with_views(
    "SELECT extract_id, issue, detail FROM en JOIN (VALUES ('no_budget', NULL), ('several_currencies', 2)) t(issue, detail) ON extract_id = 'MIDDLE EAST'",
    "ledger", extra=[_ENTITIES]))
def m12_guards(spark, sf_dir):
    r = _Read(spark, sf_dir)
    m = r.mapping()
    return E.guards(r.data, r.columns, m, _standard(r, m))


_N11_KEYS = "extract_id, account_code, account_name, category, expense_type, department, period_no"


@register("n11_standardise", with_views(
    f"SELECT {_N11_KEYS}, count(*) AS n, {S.money('sum(a)')} AS actual, {S.money('sum(b)')} AS budget FROM (SELECT entity AS extract_id, account_code, account_name, "
    "category, CASE WHEN category = 'Revenue' THEN '' ELSE coalesce(" + ETYPE + f", '{UNCLASSIFIED_EXPENSE}') END AS expense_type, department, period_no, round(actual, 2) AS a, "
    "CASE WHEN entity = 'MIDDLE EAST' THEN 0 ELSE round(budget, 2) END AS b FROM ledger) q WHERE a <> 0 OR b <> 0 "
    f"GROUP BY {_N11_KEYS}", "ledger"))
def n11_standardise(spark, sf_dir):
    r = _Read(spark, sf_dir)
    d = _standard(r, r.mapping())
    return d.groupBy(*_N11_KEYS.split(", ")).agg(F.count(F.lit(1)).alias("n"), V.money(F.sum("actual")).alias("actual"), V.money(F.sum("budget")).alias("budget"))
