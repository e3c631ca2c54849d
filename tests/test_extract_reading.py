"""Reading extracts: quotes, line breaks, ragged rows, files; matching; standard rows."""
import csv
import io
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from varpack.operators import classify as K
from varpack.operators import extracts as E
from varpack.operators import normalise as NO
from varpack.session import shared_path
from varpack.sources import extract_files, extracts as XT
from tests.conftest import SF_SMALL


def lines_of(spark, files, step=1):
    rows = [(name, step * i + 1, t) for name, text in files.items() for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "extract_id string, line_no long, text string").repartition(4)


def read(spark, files, delimiter=",", step=1):
    lines = lines_of(spark, files, step)
    known = lines.select("extract_id", F.lit(delimiter).alias("delimiter")).distinct()
    out = {}
    for r in E.read_cells(E.records(lines, known)).orderBy("line_no").collect():
        out.setdefault(r.extract_id, []).append(r.cells)
    return out


def library(text, delimiter=","):
    trimmed = [[c.strip(" ") or None for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter)]
    return [row for row in trimmed if row and (len(row) > 1 or row[0] is not None)]


@pytest.mark.parametrize("text", [
    '4000,"Sales, domestic","1,234.50"', 'a,"say ""yes"", now",b', 'x,"over\ntwo lines",y\nz,1,2', '"all\n\nof\nthis","and ""that""\n",1\n2,3,4', 'a,5" pipe,b\nc,d,e',
    '"",x,""\n"a"b,c,d', ' "a",b', ',,\n,"",x', '"1\n2","3\n4"\n"5","6\n7"', 'a,"b""\nc",d'])
@pytest.mark.parametrize("bucket", [1, 2, 1 << 20])
def test_quotes_as_the_csv_library_reads_them(spark, monkeypatch, text, bucket):
    monkeypatch.setattr(E, "_BUCKET", bucket)
    assert read(spark, {"f": text})["f"] == library(text)


@pytest.mark.parametrize("delimiter", [";", "\t", "|"])
def test_other_delimiters(spark, delimiter):
    text = 'a,b,"c,d"\n"e\nf",g,"h""i"'.replace(",", delimiter)
    assert read(spark, {"f": text}, delimiter, step=7)["f"] == library(text, delimiter)


def test_random_files(spark, monkeypatch):
    monkeypatch.setattr(E, "_BUCKET", 5)
    r = random.Random(6)
    files = {}
    for k in range(25):
        rows = [["".join(r.choice(['a', 'b', '"', ',', '\n', ' x', '1']) for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 12))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        files[f"f{k}"] = out.getvalue().rstrip("\n")
    got = {k: [c for c in v if c != [None]] for k, v in read(spark, files).items()}     # an empty quoted cell alone
    assert {k: v for k, v in got.items() if v} == {k: library(v) for k, v in files.items() if library(v)}


def test_a_quote_that_never_closes_is_text(spark):
    text = '"x\ny",z\na,"b\nc,d\ne,f'
    assert read(spark, {"f": text, "g": "1,2"}) == {"f": [["x\ny", "z"], ["a", '"b'], ["c", "d"], ["e", "f"]], "g": [["1", "2"]]}


def test_ragged_rows_and_columns_beyond_the_header(spark):
    lines = lines_of(spark, {"f": "Account,Amount\n4000,1,x\n5000\n\n6000,2,,y"})
    records = E.records(lines, lines.select("extract_id", F.lit(",").alias("delimiter")).distinct())
    cells = E.read_cells(records)
    assert [len(r.cells) for r in E.pad_rows(cells).collect()] == [4] * 4
    _, columns = E.headed(cells, E.header_rows(cells, records))
    assert [r.header for r in columns.orderBy("pos").collect()] == ["Account", "Amount", "col_2", "col_3"]


def test_blank_rows_count_in_the_header_scan(spark):
    far = "t\n" + "\n" * 13 + "Account,Account name,Amount\n1,2,3"           # the header is row 15
    beyond = "t\n" + "\n" * 14 + "Account,Account name,Amount\n1,2,3"
    lines = lines_of(spark, {"far": far, "beyond": beyond})
    records = E.records(lines, lines.select("extract_id", F.lit(",").alias("delimiter")).distinct())
    heads = {r.extract_id: r.header_line for r in E.header_rows(E.read_cells(records), records).collect()}
    assert heads == {"far": 15, "beyond": 1}


def test_files_give_the_rows_of_the_catalogue(spark):
    lines = XT.extract_lines(spark, SF_SMALL)
    path = shared_path(spark)
    (lines.repartition("extract_id").sortWithinPartitions("extract_id", "line_no").select("extract_id", F.coalesce("text", F.lit("")).alias("text"))
     .write.partitionBy("extract_id").text(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")              # many blocks of one file
    try:
        files = extract_files.read_extracts(spark, path)
        files = files.withColumn("extract_id", F.replace(F.regexp_extract("extract_id", "extract_id=([^/]+)/", 1), F.lit("%20"), F.lit(" ")))
        assert files.groupBy("extract_id", "line_no").count().filter("count > 1").count() == 0
        cells = lambda x: {k: [r.cells for r in v] for k, v in group(E.read_cells(E.records(x, E.sniff_delimiters(x))))}
        assert cells(files) == cells(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def group(cells):
    out = {}
    for r in cells.orderBy("extract_id", "line_no").collect():
        out.setdefault(r.extract_id, []).append(r)
    return out.items()


def test_file_with_mark_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfAccount,Name\r\n4000,M\xfcller\r\n\r\n5000,\xc3\x89va")
    (tmp_path / "b.txt").write_bytes(b"")
    got = [(r.line_no, r.text) for r in extract_files.read_extracts(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(1, "Account,Name"), (2, "4000,M�ller"), (3, ""), (4, "5000,Éva")]


def matched(spark, headers, overrides=()):
    columns = spark.createDataFrame([("x", i, h) for i, h in enumerate(headers)], "extract_id string, pos int, header string")
    given = spark.createDataFrame([("x", f, h) for f, h in overrides], "extract_id string, field string, header string") if overrides else None
    return {r.field: (r.header, r.method) for r in E.match_columns(columns, given).collect()}


def test_matching_in_field_order(spark, monkeypatch):
    assert matched(spark, ["Dept", "Account", "Amount"], [("entity", "Dept"), ("budget", "None such")]) == {
        "account_code": ("Account", "synonym"), "actual": ("Amount", "synonym"), "department": ("Dept", "synonym"), "entity": ("Dept", "override")}
    # an override takes a header away from later fields
    assert "department" not in matched(spark, ["Account", "Dept"], [("account_name", "Dept")])
    shared = {**E.SYNONYMS, "account_name": [*E.SYNONYMS["account_name"], "account"]}
    monkeypatch.setattr(E, "SYNONYMS", shared)
    assert matched(spark, ["Account", "Acct"]) == {"account_code": ("Account", "synonym")}
    assert matched(spark, ["Acct", "Account"]) == {"account_code": ("Acct", "synonym"), "account_name": ("Account", "synonym")}


def similarity_matched(headers, overrides):
    """The rule, header by header, with the synonyms in the order of the fields."""
    norm, used, out = {h: re.sub(r"\s+", " ", re.sub(r"[^0-9a-z\s]", " ", h.lower())).strip() for h in headers}, set(), {}
    ratio = lambda h, f: max(SequenceMatcher(None, norm[h], s).ratio() for s in E.SYNONYMS[f])
    for f in E.CANONICAL:
        free = [h for h in headers if h not in used]
        same, near = [h for h in free if norm[h] in E.SYNONYMS[f]], sorted(free, key=lambda h: -ratio(h, f))
        if overrides.get(f) in headers:
            out[f] = (overrides[f], "override", 1.0)
        elif same:
            out[f] = (same[0], "synonym", 1.0)
        elif near and ratio(near[0], f) >= 0.82:
            out[f] = (near[0], "fuzzy", round(ratio(near[0], f), 2))
        if f in out:
            used.add(out[f][0])
    return out


def test_headers_close_to_a_synonym(spark):
    assert matched(spark, ["Acount code", "Acct nam", "Ammount", "Zzz", "--"]) == {"account_code": ("Acount code", "fuzzy"), "actual": ("Ammount", "fuzzy")}
    # the most similar one wins, the first of equal ones; an earlier field takes what a later one names exactly
    assert matched(spark, ["Departmet", "Departments"])["department"] == ("Departments", "fuzzy")
    assert matched(spark, ["Budgett", "Buddget"])["budget"] == ("Budgett", "fuzzy")
    assert matched(spark, ["Ref A", "Account name"]) == {"account_code": ("Account name", "fuzzy")}
    assert matched(spark, ["Ref A", "Account name"], [("account_code", "Ref A")]) == {"account_code": ("Ref A", "override"), "account_name": ("Account name", "synonym")}


def test_similarity_as_the_library_gives_it(spark):
    r = random.Random(4)
    words = [w for ws in E.SYNONYMS.values() for w in ws]

    def spoilt():
        w = list(r.choice(words))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(["", "e", "x", "aa", " ", "-"])
        return "".join(w).strip() or "q"

    files = {f"f{k}": list(dict.fromkeys(spoilt() for _ in range(r.randint(1, 14)))) for k in range(60)}
    given = {k: {r.choice(E.CANONICAL): r.choice([*hs, "none such"])} for k, hs in files.items() if r.random() < 0.5}
    columns = spark.createDataFrame([(k, i, h) for k, hs in files.items() for i, h in enumerate(hs)], "extract_id string, pos int, header string")
    overrides = spark.createDataFrame([(k, f, h) for k, o in given.items() for f, h in o.items()], "extract_id string, field string, header string")
    got = {k: {} for k in files}
    for x in E.match_columns(columns, overrides).collect():
        got[x.extract_id][x.field] = (x.header, x.method, x.score)
    assert got == {k: similarity_matched(hs, given.get(k, {})) for k, hs in files.items()}
    assert sum(m == "fuzzy" for v in got.values() for _, m, _ in v.values()) > 20
    by_name = E.match_columns(columns, overrides, fuzzy=False)
    assert by_name.filter("method = 'fuzzy'").count() == 0 and by_name.count() > 0


def standard(spark, header, rows):
    lines = lines_of(spark, {"x": "\n".join([header, *rows])})
    records = E.records(lines, E.sniff_delimiters(lines))
    cells = E.read_cells(records)
    data, columns = E.headed(cells, E.header_rows(cells, records))
    mapping = E.match_columns(columns)
    return sorted(tuple(r) for r in NO.standardise(E.mapped_texts(data, mapping)).select("account_code", "category", "expense_type", F.col("actual").cast("double")).collect())


def test_blank_marker_reads_as_debit(spark):
    got = standard(spark, "Account;Account name;Amount;D/C", ["6000;Office rent;-500;", "6100;Salaries;-70;H", "6200;Legal fees;30;S"])
    assert [(r[0], r[3]) for r in got] == [("6000", 500.0), ("6100", -70.0), ("6200", 30.0)]


def test_mapped_labels_are_not_inferred(spark):
    got = standard(spark, "Account;Account name;Amount;Category;Expense type", ["6000;Office rent;5;opex;", "4000;Sales;7;;x", "5000;Materials;9;cogs;Goods"])
    assert got == [("4000", "", "x", 7.0), ("5000", "COGS", "Goods", 9.0), ("6000", "OpEx", "", 5.0)]


def test_expense_types_need_one_recognised(spark):
    got = standard(spark, "Account;Account name;Amount", ["6000;Zzz;5", "6100;Qqq;7"])
    assert {r[2] for r in got} == {""}
    got = standard(spark, "Account;Account name;Amount", ["6000;Zzz;5", "6100;Salaries;7"])
    assert [r[2] for r in got] == ["Other expenses", "Salaries & wages"]


def test_accounts_without_a_name_keep_their_category(spark):
    df = spark.createDataFrame([("4000", None), ("5000", "Direct materials"), ("6000", "Office rent"), ("4100", "Product revenue")], "account_code string, account_name string")
    got = {r.account_code: r.category for r in K.infer_categories(df).collect()}
    assert got["4000"] == "Revenue" and None not in got.values()
