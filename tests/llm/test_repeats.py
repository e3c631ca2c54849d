"""Suffix-array dedup (bytes) and difference-cover dedup (words)."""
import numpy as np
import pytest

from tests.llm import brute
from varpack.llm import cover_dedup, repeats, suffix_array
from varpack.llm.repeats import Windows, runs
from varpack.llm.textcore import CODES


def rows_of(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def test_byte_repeats_match_brute_force(odd_docs, odd_rows):
    got = rows_of(suffix_array.remove_repeats(odd_docs), 5)
    assert got == sorted((r[:5] for r in brute.byte_repeats(odd_rows)), key=repr)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_byte_repeats_other_sizes(spark, size, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffix_array.remove_repeats(docs, size=size), 5)
    assert got == sorted((r[:5] for r in brute.byte_repeats(rows, size)), key=repr)


def test_deduplicated_documents_keep_columns(odd_docs, odd_rows):
    out = suffix_array.deduplicated_documents(odd_docs)
    assert out.columns == odd_docs.columns
    want = [(d, None if t is None else r[5].decode("utf-8", "ignore")) for (d, t), r in zip(odd_rows, brute.byte_repeats(odd_rows))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_word_repeats_match_brute_force(odd_docs, odd_rows):
    assert rows_of(cover_dedup.remove_repeated_passages(odd_docs), 4) == sorted(brute.word_repeats(odd_rows), key=repr)


@pytest.mark.parametrize("size", [2, 24, 26])
def test_word_repeats_other_sizes(odd_docs, odd_rows, size):
    got = rows_of(cover_dedup.remove_repeated_passages(odd_docs, size=size), 4)
    assert got == sorted(brute.word_repeats(odd_rows, size), key=repr)


def test_a_passage_in_many_surroundings(monkeypatch, spark, prose):
    """A bucket with many identifiers in each task, and copies across tasks."""
    passage = prose(60, 77)
    monkeypatch.setattr(repeats, "_HEAVY", 16)
    rows = [(i, prose(12, 1000 + i % 70) + " " + passage + " " + prose(9, 2000 + i % 90)) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffix_array.remove_repeats(docs), 5) == sorted((r[:5] for r in brute.byte_repeats(rows)), key=repr)
    assert rows_of(cover_dedup.remove_repeated_passages(docs), 4) == sorted(brute.word_repeats(rows), key=repr)


def test_single_windows_of_a_hot_bucket_meet_across_tasks(monkeypatch, spark, prose):
    """The second round in several tasks and flushes: its heavy buckets are sent whole."""
    passage = prose(60, 77)
    monkeypatch.setattr(repeats, "_HEAVY", 4)
    monkeypatch.setattr(repeats, "_FLUSH", 64)
    rows = [(i, prose(12, 1000 + i) + " " + passage + " " + prose(9, 2000 + i)) for i in range(120)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert rows_of(suffix_array.remove_repeats(docs), 5) == sorted((r[:5] for r in brute.byte_repeats(rows)), key=repr)
        assert rows_of(cover_dedup.remove_repeated_passages(docs), 4) == sorted(brute.word_repeats(rows), key=repr)
    finally:
        spark.conf.set(coalesce, before)


def test_empty_tables(no_docs):
    assert suffix_array.remove_repeats(no_docs).collect() == []
    assert cover_dedup.remove_repeated_passages(no_docs).collect() == []
    assert suffix_array.deduplicated_documents(no_docs).columns == no_docs.columns


def test_cover_reaches_every_difference():
    d = cover_dedup.COVER
    assert {(a - b) % cover_dedup.PERIOD for a in d for b in d} == set(range(cover_dedup.PERIOD))


def test_no_two_windows_of_a_run_are_equal():
    data = np.frombuffer(b"abab" * 60 + b"xyz" * 40, np.uint8)
    start, length, _, _ = runs(CODES[data], np.array([0, len(data)]), Windows("byte", 50, 16, True))
    assert length.sum() == len(data) - 49
    for s, n in zip(start, length):
        seen = [data[i:i + 50].tobytes() for i in range(s, s + n)]
        assert len(set(seen)) == len(seen)


def test_long_text_is_tiled(monkeypatch, spark, prose):
    monkeypatch.setattr(repeats, "_TILE", 512)
    text = prose(700, 11)
    rows = [(1, text), (2, "q" + text[1500:] + text[:700]), (3, text[2000:2099]), (4, text[2000:2100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_array.remove_repeats(docs), 5) == sorted((r[:5] for r in brute.byte_repeats(rows)), key=repr)
