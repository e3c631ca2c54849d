"""Reading extracts at size: no step sends all lines of an extract to one task,
and amounts are read without a shuffle of the rows."""
import re

from pyspark.sql import functions as F

from varpack.functions.parse import parse_amount, with_amounts
from varpack.operators import extracts as E
from varpack.operators import normalise as NO
from varpack.session import written
from varpack.sources import extracts as XT
from tests.conftest import SF_SMALL

TEXTS = ["1,234.50", "-1,234.50", "1.234,50", "1234.50", "-1234,50", "007", "-12", "1.234", "1,234", "12,345,6", "1.5", "1,2,3.45", "1.2.3,45",
         "(-5,00)", "-5.00-", "(5.00", "5.00)", "1.234,50-", "EUR -1.234,50", "EUR 7", "-3 CR", "1,234.50 DR", "(1.5)", "5.00 CR-", "USD 1.234", "(12)", "CR 5.00",
         "-", "--5.00", "5.00-", "(5.00)", "12.50\n", " 12.50 ", "EUR 12.50", "1.50 CR", "9" * 40 + ".00", "abc", "", None]


def test_amounts_are_read_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, s string")
    out = with_amounts(df, {"a": "s"})
    assert not re.search("SortMergeJoin|hashpartitioning", out._jdf.queryExecution().executedPlan().toString())
    assert [r.a for r in out.orderBy("i").collect()] == [r[0] for r in df.orderBy("i").select(parse_amount("s")).collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark):
    rows = [(e, i + 1, t) for e, text in {
        "quoted": ["Account,Account name,Amount"] + ['4000,"Sales\nat home","1,234.50"', "6000,Rent,10.00"] * 40,
        "plain": ["Account;Account name;Amount"] + ["5000;Materials;7,25"] * 60}.items() for i, t in enumerate("\n".join(text).split("\n"))]
    return written(spark.createDataFrame(rows, "extract_id string, line_no long, text string").repartition(4))


def test_lines_are_not_shuffled_by_extract(spark, monkeypatch):
    monkeypatch.setattr(E, "_BUCKET", 16)
    lines = _lines(spark)
    records = E.records(lines, written(E.sniff_delimiters(lines)))
    assert not re.search(r"hashpartitioning\(extract_id#\d+, \d+\)", _plan(records))
    got = {r.extract_id: r.n for r in E.read_cells(records).groupBy("extract_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"quoted": 81, "plain": 61}


def test_rows_meet_their_accounts_once(spark):
    lines = _lines(spark)
    records = E.records(lines, written(E.sniff_delimiters(lines)))
    cells = written(E.read_cells(records))
    data, columns = E.headed(cells, written(E.header_rows(cells, records)))
    standard = NO.standardise(E.mapped_texts(data, written(E.match_columns(columns))))
    assert not re.search("SortMergeJoin|hashpartitioning", _plan(standard))
    sums = {(r.extract_id, r.account_code): float(r.a) for r in standard.groupBy("extract_id", "account_code").agg(F.sum("actual").alias("a")).collect()}
    assert sums == {("quoted", "4000"): 40 * 1234.5, ("quoted", "6000"): 400.0, ("plain", "5000"): 60 * 7.25}


def test_the_source_joins_the_ledger_once(spark):
    plan = _plan(XT.extract_lines(spark, SF_SMALL))
    assert "lineitem.parquet" not in plan and "Join" not in plan


def test_columns_are_counted_in_compiled_code_and_headers_read_apart(spark):
    lines = _lines(spark)
    records = written(E.cells_of_records(E.records(lines, written(E.sniff_delimiters(lines)))))
    cells = records.filter("cells IS NOT NULL")
    head = E.head_rows(cells, records)
    data, columns = E.headed(cells, written(E.header_rows(cells, records, head)), head)
    assert "lambda" not in _plan(columns) and head.count() == 30
    got = {(r.extract_id, r.pos, r.header, r.n_values) for r in columns.collect()}
    assert got == {("quoted", 0, "Account", 80), ("quoted", 1, "Account name", 80), ("quoted", 2, "Amount", 80),
                   ("plain", 0, "Account", 60), ("plain", 1, "Account name", 60), ("plain", 2, "Amount", 60)}
    matched = E.match_columns(columns).filter("field <> 'actual'")
    free = E.free_cells(data, columns, written(matched))
    assert "collect_list" not in _plan(free)
    assert sorted((r.extract_id, r["count"]) for r in free.filter("header = 'Amount'").groupBy("extract_id").count().collect()) == [("plain", 60), ("quoted", 80)]


def test_the_end_of_a_line_in_quotes(spark):
    texts = ['a,"b', '"a,b', '"a""', 'x"y,"z', '"a,""b', '"a"b,c', '"a",b"', 'a,b', '', '"', '""', '"""', 'a,"b""c",d,"', ',"x,y",z', '"x"y"', '"' + 'a""' * 5000,
             '"a",' * 20000, '"a",' * 20000 + '"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(E._open_after(F.col("text"), ",")).collect()]
    assert got == [True, True, True, True, True, False, False, False, False, True, False, True, True, False, False, True, False, True]
    assert "regexp_replace" not in str(E._open_after(F.col("text"), ","))


def test_plain_numbers_are_cast_without_their_shape(spark, monkeypatch):
    from varpack.functions import parse as PA
    rules = []
    monkeypatch.setattr(PA, "written", lambda df: rules.append(written(df)) or rules[-1])
    texts = ["7", "-12.5", "0012.50", "9" * 40, "1.234", "12.345", "1\n", "-", "--5", "5.", ".5", "1.5 ", "٣", "EUR", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    out = with_amounts(df, {"a": "s"})
    assert out.columns == ["i", "s", "a"]
    assert [r.a for r in out.orderBy("i").collect()] == [r[0] for r in df.orderBy("i").select(parse_amount("s")).collect()]
    assert sorted(r.shape for r in rules[0].collect()) == sorted(["9.999", "99.999", "9\n", "--9", "9.", ".9", "9.9 "])


def test_extracts_without_quotes_are_cut_where_they_are_read(spark):
    rows = [(e, i + 1, t) for e, text in {
        "plain": ["Title", "", "Account|Account name|Amount|", "4000| Sales |1|", "|| |", "5000||", "  ", "6000|Rent|2|x"] + ["7000|Tax|3|"] * 60,
        "marked": ["﻿Account;Account name;Amount", "4000;a;1", ";;", "5000; ;2"],
        "blank": ["", " "], "quoted": ['Account,Account name,Amount', '4000,"a\nb",1']}.items() for i, t in enumerate("\n".join(text).split("\n"))]
    lines = written(spark.createDataFrame(rows, "extract_id string, line_no long, text string").repartition(4))
    ranges = E.line_ranges(lines)
    assert {r.extract_id for r in ranges.filter("quoted").collect()} == {"quoted"}
    first = E.first_lines(lines, ranges)
    delimiters = written(E.sniff_delimiters(lines, ranges, first))
    assert delimiters.collect() and {tuple(r) for r in delimiters.collect()} == {tuple(r) for r in E.sniff_delimiters(lines).collect()}

    some = F.col("extract_id") != "quoted"
    fields = E.fields_of_lines(lines.filter(some), delimiters)
    assert "lambda" not in _plan(fields) and "hashpartitioning" not in _plan(fields)
    records = written(E.cells_of_records(E.records(lines.filter(some), delimiters)))
    cells = records.filter("cells IS NOT NULL")
    assert (sorted((r.extract_id, r.line_no, r.cells) for r in fields.select("extract_id", "line_no", F.transform("cells", E.cell).alias("cells")).collect())
            == sorted((r.extract_id, r.line_no, r.cells) for r in cells.collect()))
    head = E.head_rows(cells, records)
    firsts = E.head_of_lines(first.filter(some), delimiters)
    rows_of = lambda d: sorted(map(str, d.collect()))
    assert rows_of(firsts) == rows_of(head)
    headers = written(E.header_rows(cells, records, head))
    (data, columns), (data2, columns2) = E.headed(cells, headers, head), E.headed(fields, headers, firsts)
    assert rows_of(columns) == rows_of(columns2)
    place = lambda d: d.select("extract_id", "line_no", F.transform("cells", E.cell).alias("cells"))
    assert rows_of(place(data)) == rows_of(place(data2))
    assert str(columns2._jdf.queryExecution().optimizedPlan().toString()).count("split(") == 1     # a filter on the cells would cut twice
    free = lambda d: E.free_cells(d, columns, E.match_columns(columns).filter("field <> 'account_name'"))
    assert rows_of(free(data)) == rows_of(free(data2))


def test_order_is_checked_only_where_it_decides(spark):
    rows = [("x", pos, str(pos), i, v) for pos, vs in enumerate([["4000", "5000", "4100", "6000", "7000", "4200"], ["1", "2", "3", "4", "5", "6"],
                                                                 ["9", "2", "30", "4", "5", "6"], ["0", "0", "0", "0", "0", "0"], ["1.5", "a", "2.5", "7", "8", "9"]]) for i, v in enumerate(vs)]
    p = E.profile_columns(spark.createDataFrame(rows, "extract_id string, pos int, header string, line_no long, v string"))
    assert [r.money for r in p.orderBy("pos").collect()] == [False, False, True, False, True]


def test_names_are_read_once_per_account(spark, monkeypatch):
    """The rule for total rows reads the account alone: moved below the sums, it would run for every row."""
    plans = []
    monkeypatch.setattr(NO, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    lines = _lines(spark)
    records = E.records(lines, written(E.sniff_delimiters(lines)))
    cells = written(E.read_cells(records))
    data, columns = E.headed(cells, written(E.header_rows(cells, records)))
    NO.standardise(E.mapped_texts(data, written(E.match_columns(columns))))
    sums = [p for p in plans if "actual__sum" in p and "Aggregate" in p and "grand total" in p]
    assert any("grand total" in p for p in plans) and not sums


def test_generated_code_is_compiled(spark):
    """No stage may run a method that HotSpot leaves to its interpreter, over 8000 bytes."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
