"""Reading a catalogue of raw extracts and mapping their columns (S1-S4,
M1-M12), for all extracts in one job.

Lines are (extract_id, line_no, text). What decides a shape is small: the first
50 lines, the first 15 rows, one row per header cell; ranks are taken over the first
ranges of lines only. Contents of columns that no header names are profiled over
their cells alone. No Python touches a line; only distinct headers are compared with
the synonyms in Python. What is found per extract, column or
range of lines is written as a small table before it meets the lines, so that the
planner knows its size and broadcasts it: joined by a shuffle, all lines of an
extract would go to one task.

Extracts without any quote need no records: their lines are cut where they are read
(``fields_of_lines``), which costs less than to write the cells and read them back.
Such cells are as they stand in the line; ``cell`` reads them, and the others too.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import AMOUNT_FIELDS, CANONICAL, CURRENCY_HEADERS, REQUIRED, SYNONYMS
from ..functions.parse import with_amounts
from ..functions.text import normalise_header
from ..session import written

# Fixed values (must equal the reference).
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_LINES, HEADER_ROWS = 50, 15
CODE_SHARE, MONEY_VALUES, INTEGER_SHARE, ID_SPREAD = 0.7, 5, 0.98, 3
SCORES = {"override": 1.0, "synonym": 1.0, "code": 0.75, "money": 0.6}
FUZZY_CUTOFF = 0.82
_DIRECT = 16       # cells of a row that are counted with the row
_BUCKET = 1 << 20   # line numbers a window partition spans when order matters


def _span(order: str) -> Column:
    return F.floor(F.col(order) / _BUCKET)


def _near(df: DataFrame, key: str, order: str, n: int, counts: DataFrame | None = None) -> DataFrame:
    """The rows of the ranges of ``order`` that are needed to reach ``n`` rows per
    key: the rows beyond them are counted, not sorted. ``counts`` (key, _span, _n)
    may come from an earlier pass over the rows."""
    span = _span(order)
    if counts is None:
        counts = df.groupBy(key, span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_span")) - F.col("_n")
    reach = written(counts.withColumn("_before", before).filter(F.col("_before") < n).groupBy(key).agg(F.max("_span").alias("_reach")))
    # no key reaches further: what lies beyond is skipped by the scan's statistics
    end = reach.select((F.max("_reach") + 1) * _BUCKET).scalar()
    some = df.filter(F.col(order).isNull() | (F.col(order) < end))
    return some.join(reach, key).filter(F.col(order).isNull() | (span <= F.col("_reach"))).drop("_reach")


def _ranked(near: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= n)


def _first(df: DataFrame, key: str, order: str, n: int, counts: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows per key, ranked within the ranges of _near."""
    return _ranked(_near(df, key, order, n, counts), key, order, n)


def line_ranges(lines: DataFrame) -> DataFrame:
    """(extract_id, _span, _n, quoted): lines that are not blank, and whether any
    line has a quote, per range of line numbers; written."""
    return written(lines.groupBy("extract_id", _span("line_no").alias("_span")).agg(
        F.count_if(F.trim("text") != "").alias("_n"), F.coalesce(F.bool_or(F.col("text").contains('"')), F.lit(False)).alias("quoted")))


def first_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The lines, blank ones included, of the first ranges of each extract that hold
    its first 50 lines that are not blank; written. All other lines come later."""
    return written(_near(lines, "extract_id", "line_no", SNIFF_LINES, ranges.filter("_n > 0")))


def sniff_delimiters(lines: DataFrame, ranges: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """Per extract, over its first 50 non-blank lines: a candidate's best
    field count is the most frequent one above 1 (then the larger); the winner
    has the highest (frequency, count), the first candidate wins ties. ``ranges``,
    ``first``: what line_ranges and first_lines gave for the lines."""
    if ranges is None:
        ranges = line_ranges(lines)
    if first is None:
        first = _near(lines, "extract_id", "line_no", SNIFF_LINES, ranges.filter("_n > 0"))
    head = _ranked(first.filter(F.trim("text") != ""), "extract_id", "line_no", SNIFF_LINES)
    cand = F.array(*[F.struct(F.lit(-i).alias("ord"), F.lit(d).alias("delimiter"),
                              (F.length("text") - F.length(F.replace("text", F.lit(d))) + 1).alias("fields")) for i, d in enumerate(DELIMITERS)])
    counts = (head.select("extract_id", F.inline(cand)).filter("fields > 1")
              .groupBy("extract_id", "ord", "delimiter", "fields").agg(F.count(F.lit(1)).alias("freq")))
    best = counts.groupBy("extract_id").agg(F.max(F.struct("freq", "fields", "ord", "delimiter")).alias("b"))
    every = ranges.select("extract_id").distinct()
    return every.join(best, "extract_id", "left").select("extract_id", F.coalesce("b.delimiter", F.lit(",")).alias("delimiter"))


# Quotes: a field that starts with one runs to the next single one, over
# delimiters and line breaks; a doubled one inside stands for itself.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def _not(delimiter: str) -> str:
    return "[^" + ("\\|" if delimiter == "|" else delimiter) + "]"


def _for_each_delimiter(make) -> Column:
    out = F.lit(None)
    for d in reversed(DELIMITERS):
        out = F.when(F.col("delimiter") == d, make(d)).otherwise(out)
    return out


def _open_after(text: Column, delimiter: str) -> Column:
    """Does ``text``, read from the start of a field, end inside quotes: whole
    fields, then one whose quote is not closed. Read once from its start; nothing
    is searched for or replaced."""
    other = _not(delimiter)
    return text.rlike(f'\\A(?:(?:{_QUOTED}|(?!")){other}*+{re.escape(delimiter)})*+(?!{_QUOTED})"')


def _carried(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Running composition of the state changes (from_out, from_in: the state
    after a row, in quotes or not, by the state before it) within ``part``, as
    columns out, in: the state after the row by the state before the first one.
    A change that forgets the state before sets it; one that turns it counts."""
    w = Window.partitionBy(*part).orderBy(order)
    turns = F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(w)
    df = df.withColumn("_turns", turns)
    fixed = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("v"), F.col("_turns").alias("t"))), ignorenulls=True).over(w)
    df = df.withColumn("_fixed", fixed)
    odd = (F.col("_turns") - F.coalesce("_fixed.t", F.lit(0))) % 2 == 1
    return (df.withColumn("out", F.coalesce("_fixed.v", F.lit(False)) != odd).withColumn("in", F.coalesce("_fixed.v", F.lit(True)) != odd)
            .drop("_turns", "_fixed"))


def records(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Lines joined to records (extract_id, line_no of the first line, delimiter,
    text) where quotes run over line breaks. Only extracts with a line that ends
    inside quotes are looked at further: a line changes the state inside / outside
    quotes, changes are composed within ranges of lines (for either state before
    the range) and then from range to range, and the lines of a record of several
    are grouped. A quote that is never closed is plain text, so no record grows to
    the end of the extract."""
    quoted = F.col("text").contains('"')
    from_out = F.coalesce(quoted & _for_each_delimiter(lambda d: _open_after(F.col("text"), d)), F.lit(False))
    from_in = F.coalesce(~quoted | _for_each_delimiter(lambda d: _open_after(F.concat(F.lit('"'), F.col("text")), d)), F.lit(True))
    read = written(lines.join(delimiters, "extract_id").withColumns({"from_out": from_out, "from_in": from_in}))   # read four times
    broken = written(read.filter("from_out").select("extract_id").distinct())
    plain = read.join(broken, "extract_id", "left_anti")

    d = read.join(broken, "extract_id", "left_semi").withColumn("range", F.floor(F.col("line_no") / _BUCKET))
    key = ["range", "extract_id"]
    d = _carried(d, key, "line_no")
    w = Window.partitionBy(*key).orderBy("line_no")
    # both states in one step each: a window holds the lines of its range once more
    states = (("out", False), ("in", True))
    d = d.withColumns({f"before_{state}": F.coalesce(F.lag(state).over(w), F.lit(enter)) for state, enter in states})
    d = d.withColumns({f"first_{state}": F.last(F.when(~F.col(f"before_{state}"), F.col("line_no")), ignorenulls=True).over(w) for state, _ in states})
    d = written(d.drop("from_out", "from_in"))   # read for the ranges and for the records

    by_state = lambda x, y: F.when(F.col("enter"), F.col(x)).otherwise(F.col(y))
    ends = (d.groupBy(*key).agg(F.max_by(F.struct("out", "in"), "line_no").alias("e"), F.max("first_out").alias("start_out"), F.max("first_in").alias("start_in"))
            .select(*key, F.col("e.out").alias("from_out"), F.col("e.in").alias("from_in"), "start_out", "start_in"))
    by_range = Window.partitionBy("extract_id").orderBy("range")
    ranges = (_carried(ends, ["extract_id"], "range").withColumn("enter", F.coalesce(F.lag("out").over(by_range), F.lit(False)))
              .select(*key, "enter", by_state("start_in", "start_out").alias("start"), by_state("from_in", "from_out").alias("open")))
    whole = Window.partitionBy("extract_id")
    ranges = written(ranges.select(
        *key, "enter", F.last("start", ignorenulls=True).over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.when(F.max_by("open", "range").over(whole), F.max("start").over(whole)).alias("unclosed")))
    d = d.join(ranges, key).select("extract_id", "line_no", "delimiter", "text", F.coalesce(by_state("first_in", "first_out"), "carried").alias("record"),
                                   "unclosed", by_state("before_in", "before_out").alias("before"), by_state("in", "out").alias("after"))
    alone = F.coalesce(F.col("record") == F.col("unclosed"), F.lit(False)) | ~(F.col("before") | F.col("after"))
    joined = (d.filter(~alone).groupBy("extract_id", "delimiter", "record").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
              .select("extract_id", F.col("record").alias("line_no"), "delimiter", F.array_join(F.col("l.text"), "\n").alias("text")))
    as_read = ["extract_id", "line_no", "delimiter", "text"]
    return plain.select(*as_read).unionByName(d.filter(alone).select(*as_read)).unionByName(joined)


def _without_mark() -> Column:
    return F.when(F.col("text").startswith("\ufeff"), F.expr("substring(text, 2)")).otherwise(F.col("text"))


def _cells() -> Column:
    text = _without_mark()

    def split(d: str) -> Column:
        one = f"{re.escape(d)}({_QUOTED}{_not(d)}*+|{_not(d)}*+)"
        fields = F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(one), F.lit(1))
        bare = F.transform(fields, lambda c: cell(F.when(c.startswith('"') & c.rlike("^" + _QUOTED), F.replace(
            F.regexp_replace(c, '^"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c)))
        return F.when(F.col("text").contains('"'), bare).otherwise(F.transform(F.split(text, re.escape(d), -1), cell))

    return _for_each_delimiter(split)


def read_cells(records: DataFrame) -> DataFrame:
    """(extract_id, line_no, cells) of the records that hold anything; cells
    without their quotes, trimmed, empty ones NULL, a leading byte-order mark
    dropped."""
    return records.filter(F.trim("text") != "").select("extract_id", "line_no", _cells().alias("cells"))


def cells_of_records(records: DataFrame) -> DataFrame:
    """As read_cells, with the blank records, whose cells are NULL."""
    return records.select("extract_id", "line_no", F.when(F.trim("text") != "", _cells()).alias("cells"))


def cell(x) -> Column:
    """A cell as read: trimmed, NULL if empty."""
    return F.nullif(F.trim(x), F.lit(""))


def fields_of_lines(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """(extract_id, line_no, cells, holds) of the lines, not blank, of extracts
    without quotes, cut in compiled code; the cells are not trimmed. ``holds``: any
    cell is filled."""
    text = _without_mark()
    mark = F.when(F.col("delimiter") == "|", "\\|").otherwise(F.col("delimiter"))
    return (lines.join(delimiters, "extract_id").filter(F.trim("text") != "")
            .select("extract_id", "line_no", F.split(text, mark, -1).alias("cells"), (F.btrim(text, F.concat("delimiter", F.lit(" "))) != "").alias("holds")))


def pad_rows(cells: DataFrame) -> DataFrame:
    """Rows filled with NULL cells to the widest row of their extract."""
    widest = written(cells.groupBy("extract_id").agg(F.max(F.size("cells")).alias("_widest")))
    fill = F.array_repeat(F.lit(None).cast("string"), F.col("_widest") - F.size("cells"))
    padded = F.when(F.size("cells") < F.col("_widest"), F.concat("cells", fill)).otherwise(F.col("cells"))
    return cells.join(widest, "extract_id").withColumn("cells", padded).drop("_widest")


def head_rows(cells: DataFrame, records: DataFrame) -> DataFrame:
    """(extract_id, line_no, cells) of the first 15 records that are not blank,
    written once: the header scan and the header's names read them. Records that
    bring their cells are read once."""
    if "cells" in records.columns:
        first = _first(records.select("extract_id", "line_no", "cells"), "extract_id", "line_no", HEADER_ROWS)
        return written(first.filter("cells IS NOT NULL").drop("_r"))
    top = written(_first(records.select("extract_id", "line_no"), "extract_id", "line_no", HEADER_ROWS).drop("_r"))
    return written(cells.join(top, ["extract_id", "line_no"], "left_semi").select("extract_id", "line_no", "cells"))


def head_of_lines(first: DataFrame, delimiters: DataFrame) -> DataFrame:
    """As head_rows, of extracts without quotes, from their first lines."""
    top = _ranked(first.select("extract_id", "line_no", "text"), "extract_id", "line_no", HEADER_ROWS)
    return written(read_cells(top.join(delimiters, "extract_id")))


def header_rows(cells: DataFrame, records: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """S3: (extract_id, header_line): of the first 15 records, blank ones
    included, the one with the best score 0.1 x cells + 2 x share of text + 1.5 x
    known headers; a row of fewer than two cells scores -1, the first best row
    wins. ``head``: what head_rows gave for the same records."""
    if head is None:
        head = head_rows(cells, records)
    known = [s for words in SYNONYMS.values() for s in words]
    one = with_amounts(head.select("extract_id", "line_no", F.explode("cells").alias("cell")), {"amount": "cell"})
    filled = F.col("cell").isNotNull()
    score = (one.groupBy("extract_id", "line_no")
             .agg(F.count_if(filled).alias("n"), F.count_if(filled & F.col("amount").isNull()).alias("text"),
                  F.count_if(filled & normalise_header("cell").isin(known)).alias("known"))
             .withColumn("score", F.when(F.col("n") < 2, -1.0).otherwise(F.col("n") * 0.1 + F.col("text") / F.col("n") * 2.0 + F.col("known") * 1.5)))
    return score.groupBy("extract_id").agg(F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("header_line"))


def _below(cells: DataFrame, headers: DataFrame) -> DataFrame:
    return cells.join(headers, "extract_id").filter(F.col("line_no") > F.col("header_line")).drop("header_line")


def data_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows below the header that hold anything."""
    below = _below(cells, headers)
    return below.filter("holds").drop("holds") if "holds" in cells.columns else below.filter(F.exists("cells", lambda c: c.isNotNull()))


def _filled(rows: DataFrame) -> DataFrame:
    """(extract_id, pos, n_values): how many cells of a column hold anything, counted
    in compiled code. The first cells of a row are counted with the row, only those
    beyond one by one. ``beyond`` is NULL for a row that has none: an inner explode
    would bring a filter on the cells, for which lines are cut once more."""
    holds = lambda c: F.trim(c) != ""
    once = F.coalesce(F.col("beyond") == 0, F.lit(True))
    parts = rows.select("extract_id", "cells", F.posexplode_outer(F.slice("cells", _DIRECT + 1, (1 << 31) - 1)).alias("beyond", "v"))
    counts = parts.groupBy("extract_id", "beyond").agg(
        *[F.count_if(once & holds(F.get("cells", F.lit(i)))).alias(f"n_{i}") for i in range(_DIRECT)], F.count_if(holds("v")).alias("n"))
    each = [F.struct(F.lit(i).alias("pos"), F.col(f"n_{i}").alias("n")) for i in range(_DIRECT)]
    return (counts.select("extract_id", F.inline(F.array(*each, F.struct((F.col("beyond") + _DIRECT).alias("pos"), F.col("n").alias("n")))))
            .filter("n > 0").groupBy("extract_id", "pos").agg(F.sum("n").alias("n_values")))


def headed(cells: DataFrame, headers: DataFrame, head: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(data rows below the header that hold anything, header cells with
    how many values their column has); columns without a value are dropped, and
    columns with values beyond the header's cells are named by position. ``head``:
    rows that hold the header rows, if they are written apart."""
    below, data = _below(cells, headers), data_rows(cells, headers)
    top = (cells if head is None else head).join(headers, "extract_id")
    names = top.filter(F.col("line_no") == F.col("header_line")).select("extract_id", F.posexplode("cells").alias("pos", "header"))
    filled = _filled(below)
    named = filled.join(names, ["extract_id", "pos"], "left")
    return data, named.select("extract_id", "pos", F.coalesce("header", F.concat(F.lit("col_"), F.col("pos").cast("string"))).alias("header"), "n_values")


def similar_fields(norms: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """M3: (norm, near: [(field, score, shown)]) of distinct normalised headers: per
    field the best difflib ratio to any of its synonyms, where it reaches the cutoff,
    and the score rounded to two places. Two bounds that no ratio exceeds come first."""
    cutoff = FUZZY_CUTOFF

    def near(norm):
        found = []
        for field, words in synonyms.items():
            best = 0.0
            for word in words if norm else ():
                if 2.0 * min(len(norm), len(word)) / (len(norm) + len(word)) >= cutoff:
                    pair = SequenceMatcher(None, norm, word)
                    best = max(best, pair.ratio() if pair.quick_ratio() >= cutoff else 0.0)
            if best >= cutoff:
                found.append((field, best, round(best, 2)))
        return found

    return norms.select("norm", F.udf(near, "array<struct<field:string,score:double,shown:double>>")("norm").alias("near"))


def match_columns(columns: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """M2-M5: (extract_id, ord, field, pos, header, method, score). The fields are
    taken in canonical order, one fold per extract over its headers: an override
    (extract_id, field, header) wins where its header exists; else the first header
    that is a synonym of the field and that no earlier field has; else, of the
    headers that no earlier field has, the one most similar to a synonym of the field,
    if it reaches the cutoff (the first of equal ones). Without ``fuzzy``, by overrides
    and synonyms only."""
    named = columns.select("extract_id", "pos", "header", normalise_header("header").alias("norm"))
    if fuzzy:
        named = named.join(similar_fields(named.select("norm").distinct(), SYNONYMS), "norm", "left")
    else:
        named = named.withColumn("near", F.lit(None).cast("array<struct<field:string,score:double,shown:double>>"))
    heads = named.groupBy("extract_id").agg(F.sort_array(F.collect_list(F.struct("pos", "header", "norm", "near"))).alias("heads"))
    if overrides is None:
        heads = heads.withColumn("given", F.lit(None).cast("map<string,string>"))
    else:
        one = overrides.groupBy("extract_id", "field").agg(F.min("header").alias("header"))
        given = one.groupBy("extract_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "header"))).alias("given"))
        heads = heads.join(given, "extract_id", "left")
    fields = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.array(*map(F.lit, SYNONYMS[f])).alias("words")) for i, f in enumerate(CANONICAL)])
    kind = dict(columns.dtypes)["pos"]
    start = F.struct(F.array().cast("array<string>").alias("used"),
                     F.array().cast(f"array<struct<ord:int,field:string,pos:{kind},header:string,method:string,score:double>>").alias("found"))

    def step(acc: Column, f: Column) -> Column:
        def first(method: str, suits) -> Column:
            row = lambda h: F.struct(f["ord"].alias("ord"), f["field"].alias("field"), h["pos"].alias("pos"), h["header"].alias("header"),
                                     F.lit(method).alias("method"), F.lit(SCORES[method]).alias("score"))
            return F.get(F.transform(F.filter("heads", suits), row), F.lit(0))

        free = lambda h: ~F.array_contains(acc["used"], h["header"])
        like = lambda h: F.get(F.filter(h["near"], lambda n: n["field"] == f["field"]), F.lit(0))
        given = first("override", lambda h: h["header"] == F.try_element_at("given", f["field"]))
        same = first("synonym", lambda h: F.array_contains(f["words"], h["norm"]) & free(h))
        near = F.array_max(F.transform(F.filter("heads", lambda h: like(h).isNotNull() & free(h)), lambda h: F.struct(
            like(h)["score"].alias("score"), (-h["pos"]).alias("order"), h["pos"].alias("pos"), h["header"].alias("header"), like(h)["shown"].alias("shown"))))
        alike = F.when(near.isNotNull(), F.struct(f["ord"].alias("ord"), f["field"].alias("field"), near["pos"].alias("pos"), near["header"].alias("header"),
                                                  F.lit("fuzzy").alias("method"), near["shown"].alias("score")))
        pick = F.coalesce(given, same, alike) if fuzzy else F.coalesce(given, same)
        taken = F.transform(F.array(pick), lambda p: F.struct(F.array_append(acc["used"], p["header"]).alias("used"), F.array_append(acc["found"], p).alias("found")))
        return F.when(pick.isNull(), acc).otherwise(F.get(taken, F.lit(0)))

    found = heads.select("extract_id", F.inline(F.aggregate(fields, start, step)["found"]))
    return found.select("extract_id", "ord", "field", "pos", "header", "method", "score")


def free_cells(data: DataFrame, columns: DataFrame, matched: DataFrame) -> DataFrame:
    """(extract_id, pos, header, line_no, v): the values of unmatched columns; only
    those cells of a row are unpivoted."""
    free = unmapped(columns, matched)
    # a row meets as many free columns as its extract has
    return data.join(free, "extract_id").select("extract_id", "pos", "header", "line_no", cell(F.get("cells", F.col("pos"))).alias("v")).filter("v IS NOT NULL")


def profile_columns(values: DataFrame) -> DataFrame:
    """M6 + M7: per unmatched column, the share of 3-6 digit codes and whether
    it looks like money: at least 5 amounts, not all zero, not an id band (all
    integers within a factor of 3), not a counter (integers that never fall in
    file order). File order is checked where it decides, for columns of integers
    that are no id band, within ranges of lines and then between their ends, so no
    window holds a whole column. The amounts are written once, for the figures and
    the order."""
    v = with_amounts(values, {"amount": "v"})
    v = written(v.select("extract_id", "pos", "header", "line_no", F.col("v").rlike("^[0-9]{3,6}$").alias("coded"), "amount"))
    code = F.avg(F.col("coded").cast("int")).alias("code_share")
    a = F.abs(F.col("amount"))
    whole = F.avg((F.col("amount") == F.floor("amount")).cast("int")).alias("integers")
    flat = written(v.groupBy("extract_id", "pos", "header").agg(code, F.count("amount").alias("n"), F.max(a).alias("most"), F.min(a).alias("least"), whole))
    ints = F.col("integers") > INTEGER_SHARE
    spread = F.col("most").cast("double") / F.greatest(F.col("least").cast("double"), F.lit(1e-9))
    decided = ints & (F.col("n") >= MONEY_VALUES) & (F.col("most") != 0) & (spread >= ID_SPREAD)
    v = (v.filter(F.col("amount").isNotNull()).join(flat.filter(decided).select("extract_id", "pos"), ["extract_id", "pos"], "left_semi")
         .withColumn("bucket", F.floor(F.col("line_no") / _BUCKET)))
    w = Window.partitionBy("bucket", "pos", "extract_id").orderBy("line_no")
    inside = (v.withColumn("falls", F.col("amount") < F.lag("amount").over(w)).groupBy("extract_id", "pos", "bucket")
              .agg(F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls"), F.min_by("amount", "line_no").alias("first"), F.max_by("amount", "line_no").alias("last")))
    w = Window.partitionBy("extract_id", "pos").orderBy("bucket")
    order = (inside.withColumn("falls", F.col("falls") | F.coalesce(F.col("first") < F.lag("last").over(w), F.lit(False)))
             .groupBy("extract_id", "pos").agg(F.bool_or("falls").alias("falls")))
    money = ((F.col("n") >= MONEY_VALUES) & (F.col("most") != 0) & ~(ints & (spread < ID_SPREAD)) & ~(ints & ~F.col("falls")))
    return (flat.join(order, ["extract_id", "pos"], "left")
            .select("extract_id", "pos", "header", "code_share", "n", "integers", F.coalesce(money, F.lit(False)).alias("money")))


def assign_by_content(matched: DataFrame, profile: DataFrame) -> DataFrame:
    """M6 + M8: the first free column of codes becomes the account code where
    none is matched; the only free column of money becomes the actual."""
    have = lambda f: matched.filter(F.col("field") == f).select("extract_id")

    def found(p: DataFrame, field: str, score: float) -> DataFrame:
        return p.join(have(field), "extract_id", "left_anti").select(
            "extract_id", F.lit(CANONICAL.index(field)).alias("ord"), F.lit(field).alias("field"), "pos", "header",
            F.lit("content").alias("method"), F.lit(score).alias("score"))

    codes = (profile.filter(F.col("code_share") > CODE_SHARE).groupBy("extract_id").agg(F.min(F.struct("pos", "header")).alias("b"))
             .select("extract_id", "b.pos", "b.header"))
    code = found(codes, "account_code", SCORES["code"])
    left = profile.filter("money").join(code.select("extract_id", "pos"), ["extract_id", "pos"], "left_anti")
    one = (left.groupBy("extract_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "header")).alias("b"))
           .filter("n = 1").select("extract_id", "b.pos", "b.header"))
    return matched.unionByName(code).unionByName(found(one, "actual", SCORES["money"]))


def mapping_report(mapping: DataFrame) -> DataFrame:
    """M9: every canonical field per extract: where it came from, how, how sure."""
    fields = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(f in REQUIRED).alias("required")) for i, f in enumerate(CANONICAL)])
    every = mapping.select("extract_id").distinct().select("extract_id", F.inline(fields))
    return (every.join(mapping.drop("ord", "pos"), ["extract_id", "field"], "left")
            .select("extract_id", "ord", "field", F.col("header").alias("mapped_from"), F.coalesce("method", F.lit("unmatched")).alias("method"),
                    F.coalesce("score", F.lit(0.0)).alias("confidence"), "required"))


def unmapped(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Header cells that no field uses."""
    return columns.join(mapping.select("extract_id", "pos"), ["extract_id", "pos"], "left_anti").select("extract_id", "pos", "header")


def missing_fields(mapping: DataFrame, extracts: DataFrame) -> DataFrame:
    """Required fields without a source; any amount field serves."""
    has = mapping.groupBy("extract_id").agg(
        *[F.bool_or(F.col("field") == f).alias(f) for f in REQUIRED], F.bool_or(F.col("field").isin(AMOUNT_FIELDS)).alias("amount"))
    lost = F.filter(F.array(*[F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in REQUIRED],
                            F.when(~F.coalesce("amount", F.lit(False)), F.lit("actual (or budget)"))), lambda x: x.isNotNull())
    return extracts.select("extract_id").distinct().join(has, "extract_id", "left").select("extract_id", F.explode(lost).alias("field"))


def place(field: str) -> Column:
    """The text of a canonical field, by the extract's mapping (NULL: unmapped)."""
    return cell(F.get(F.col("cells"), F.try_element_at(F.col("_places"), F.lit(field))))


def mapped_texts(data: DataFrame, mapping: DataFrame) -> DataFrame:
    """(extract_id, line_no, one text column per canonical field)."""
    places = mapping.groupBy("extract_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("_places"))  # 14 at most
    return data.join(places, "extract_id").select(
        "extract_id", "line_no", *[place(f).alias(f) for f in CANONICAL],
        *[F.map_contains_key("_places", F.lit(f)).alias(f"_has_{f}") for f in ("actual", "budget", "dc_indicator", "category", "expense_type")])


def guards(data: DataFrame, columns: DataFrame, mapping: DataFrame, standard: DataFrame) -> DataFrame:
    """M12 as issue rows (extract_id, issue, detail): no budget column next to
    an actual, an actual total of zero, several currencies while the amount
    column names no reporting currency."""
    used = mapping.groupBy("extract_id").agg(F.bool_or(F.col("field") == "actual").alias("a"), F.bool_or(F.col("field") == "budget").alias("b"),
                                             F.max(F.when(F.col("field") == "actual", normalise_header("header"))).alias("h"))
    no_budget = used.filter("a AND NOT b").select("extract_id", F.lit("no_budget").alias("issue"), F.lit(None).cast("long").alias("detail"))
    zero = (standard.groupBy("extract_id").agg(F.sum("actual").alias("t")).join(used.filter("a"), "extract_id").filter("t = 0")
            .select("extract_id", F.lit("zero_actual").alias("issue"), F.lit(None).cast("long").alias("detail")))
    money = columns.filter(normalise_header("header").isin(CURRENCY_HEADERS)).groupBy("extract_id").agg(F.min("pos").alias("pos"))
    kinds = (data.join(money, "extract_id").select("extract_id", cell(F.get("cells", F.col("pos"))).alias("c")).filter("c IS NOT NULL")
             .distinct().groupBy("extract_id").agg(F.count(F.lit(1)).alias("detail")).filter("detail > 1"))
    mixed = (kinds.join(used, "extract_id").filter(~F.coalesce(F.col("h").contains("eur") | F.col("h").contains("report"), F.lit(False)))
             .select("extract_id", F.lit("several_currencies").alias("issue"), "detail"))
    return no_budget.unionByName(zero).unionByName(mixed)
