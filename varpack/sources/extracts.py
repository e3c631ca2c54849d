"""A catalogue of ledger extracts as text lines, derived from the test ledger.

One extract per entity, each in the shape of another export: its delimiter, its
header language, its way to sign amounts, title lines above the header, an empty
last column, a blank line and a printed total row below. One of them quotes cells:
amounts with a delimiter inside, notes with doubled quotes or over two lines, and
some of its rows end early. Lines are (extract_id, line_no, text), kept as a table
that the total rows and every reading share; no text files are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from .fixture import ledger

HEADER_LINE, FIRST_LINE = 3, 10
_GAP = 128    # line numbers of one posting number: two for each posting that has it


US, EU = (",", "."), (".", ",")   # mark of the thousands, decimal mark
MARKS = {"AFRICA": US, "AMERICA": EU, "ASIA": US, "EUROPE": EU, "MIDDLE EAST": EU}


def _plain(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _grouped(c: Column, mark: Column, point: Column) -> Column:
    """A plain number of two places with its marks. It is cut by length, in compiled
    code; a regular expression reads only numbers of a million and more."""
    size = F.length(c) - c.startswith("-").cast("int")
    until = lambda n: F.left(c, F.length(c) - n)
    return F.concat(F.when(size <= 6, until(3)).when(size <= 9, F.concat(until(6), mark, F.substring(c, -6, 3)))
                    .otherwise(F.regexp_replace(until(3), F.lit("(?<=[0-9])(?=(?:[0-9]{3})+$)"), mark)), point, F.right(c, F.lit(2)))


def _printed(df: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Amounts as text: ``amounts`` maps output column -> amount, printed with the
    marks of the row's ``entity`` as <output>, without them as <output>_plain. Made
    step by step and once per row, so that the generated code stays small."""
    mark, point = (F.lit(None).cast("string") for _ in range(2))
    for name, (m, p) in MARKS.items():
        mark, point = F.when(F.col("entity") == name, m).otherwise(mark), F.when(F.col("entity") == name, p).otherwise(point)
    df = df.withColumns({"_mark": mark, "_point": point, **{f"{out}_plain": _plain(F.col(c)) for out, c in amounts.items()}})
    return df.withColumns({out: _grouped(F.col(f"{out}_plain"), F.col("_mark"), F.col("_point")) for out in amounts}).drop("_mark", "_point")


def _note() -> Column:
    """Free text of a row in quotes, by the row's number; NULL: the row ends before it."""
    kind = F.col("line_id") % 4
    return (F.when(kind == 0, '"Doc ""A"", posted"').when(kind == 1, '"Doc B\nsecond line, same cell"').when(kind == 2, "plain"))


def shapes() -> dict[str, tuple[str, list[tuple[str, Column]]]]:
    """Extract id -> (delimiter, [(header, cell)]), of rows with ``paid`` and
    ``planned`` as _printed gives them."""
    col, rev = F.col, F.col("category") == "Revenue"
    blank = ("", F.lit(""))
    return {
        "AFRICA": (",", [("Account", col("account_code")), ("Account name", col("account_name")), ("Period", col("period")),
                         ("Amount", F.concat(F.lit('"'), col("paid"), F.lit('"'))), ("Budget", col("planned_plain")), ("Dept", col("department")),
                         ("Cost centre", col("cost_centre")), ("Memo", _note()), ("", F.when(_note().isNotNull(), ""))]),
        "AMERICA": (";", [("Főkönyvi számla", col("account_code")), ("Megnevezés", col("account_name")), ("Időszak", col("period")),
                          ("Tény", col("paid")), ("Terv", col("planned")), ("Részleg", col("department")),
                          ("Költséghely", col("cost_centre")), blank]),
        "ASIA": ("\t", [("GL code", col("account_code")), ("GL description", col("account_name")), ("Posting period", col("period")),
                        ("Debit", F.when(rev, "").otherwise(col("paid"))), ("Credit", F.when(rev, col("paid")).otherwise("")),
                        ("Budget amount", col("planned")), ("Division", col("department")), ("CC code", col("cost_centre")), blank]),
        "EUROPE": ("|", [("Nominal code", col("account_code")), ("Description", col("account_name")), ("Month", col("period")),
                         ("Amt", F.ltrim(col("paid"), F.lit("-"))), ("D/C", F.when(rev, "H").otherwise("S")), ("Plan", col("planned")),
                         ("Function", col("department")), ("Cctr", col("cost_centre")), blank]),
        "MIDDLE EAST": (";", [("Ref A", col("account_code")), ("Account name", col("account_name")), ("Period", col("period")),
                              ("Wert", col("paid")), ("Seq", col("line_id").cast("string")), ("Dept", col("department")),
                              ("Currency", F.when(col("line_id") % 2 == 0, "EUR").otherwise("USD")), blank]),
    }


def _numbered(spark: SparkSession, sf_dir: str) -> list[str]:
    """The columns that part postings by their number doc_no * 10 + line_no. With one
    digit in every line number, they may be its two parts: rows that were joined by
    doc_no are then ranked where they are, and their texts are not shuffled."""
    line = F.col("l_linenumber")
    other = table(spark, sf_dir, "lineitem").filter(line.isNull() | (line < 0) | (line > 9))
    return ["line_id"] if other.limit(1).count() else ["doc_no", "posting"]


def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract_id, line_no, text)."""
    led = ledger(spark, sf_dir).withColumnRenamed("line_no", "posting").withColumn("line_id", F.col("doc_no") * 10 + F.col("posting"))
    led = _printed(led, {"paid": "actual", "planned": "budget"})
    names = list(shapes())
    text = F.lit(None).cast("string")
    for name, (delimiter, cells) in shapes().items():
        text = F.when(F.col("entity") == name, F.concat_ws(delimiter, *[c for _, c in cells])).otherwise(text)
    # Posting numbers are not unique: postings of one number follow each other.
    number = _numbered(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy(*number, "entity").orderBy("text"))
    data = (led.filter(F.col("entity").isin(names)).select(*{"line_id": 0, **dict.fromkeys(number)}, "entity", "actual", text.alias("text")).withColumn("nth", nth)
            .select("entity", "line_id", "actual", (_GAP * F.col("line_id") + 2 * F.col("nth") + FIRST_LINE).alias("line_no"),
                    F.posexplode(F.split("text", "\n")).alias("part", "text")))
    data = written(data.select("entity", (F.col("line_no") + F.col("part")).alias("line_no"), "text", "line_id",
                               F.when(F.col("part") == 0, F.col("actual")).alias("actual")))
    total = data.groupBy("entity").agg(F.sum("actual").alias("a"), (_GAP * (F.max("line_id") + 1)).alias("last"))
    total = _printed(total, {"sum": "a"})
    furniture = F.lit(None).cast("array<struct<line_no:bigint,text:string>>")
    for name, (delimiter, cells) in shapes().items():
        total_row = [F.lit("")] * len(cells)
        total_row[1], total_row[3] = F.lit("Total"), F.col("sum" if name != "AFRICA" else "sum_plain")
        rows = [(F.lit(1), F.lit(f"Ledger extract {name}")), (F.lit(2), F.lit("")), (F.lit(HEADER_LINE), F.lit(delimiter.join(h for h, _ in cells))),
                (F.col("last") + FIRST_LINE + 1, F.lit("")), (F.col("last") + FIRST_LINE + 2, F.concat_ws(delimiter, *total_row))]
        made = F.array(*[F.struct(n.cast("bigint").alias("line_no"), t.alias("text")) for n, t in rows])
        furniture = F.when(F.col("entity") == name, made).otherwise(furniture)
    lines = data.select(F.col("entity").alias("extract_id"), "line_no", "text")
    return lines.unionByName(written(total.select(F.col("entity").alias("extract_id"), F.inline(furniture))))
