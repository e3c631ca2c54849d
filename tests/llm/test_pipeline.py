"""The corpus pipeline, stage by stage against brute force, and the registered queries."""
import public_tokenizers as tokens
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_tokens import library_ids

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op3_embedding_forest_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op4_toxicity_chain": ["doc_id", "p_low_quality", "p_toxic", "toxic"],
    "op5_elias_fano_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_license_scan": ["doc_id", "license", "n_matched", "n_shingles", "first_word"],
    "op7_histogram_top_k": ["query_id", "rank", "vec_id", "score"],
    "op8_cover_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_distinct_word_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_harmonic_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_composite_text_density": ["page_id", "url", "text", "n_chars"],
    "op12_prefix_doubling_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_fp_tree_search": ["item_id", "rank", "doc_id", "score"],
}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "no id " * 40, "en", "s", 1), (10_000, None, "en", "s", 0), (10_001, "", None, None, 0)], docs.schema)
    got = [docs.unionByName(extra).unionByName(docs.filter("doc_id = 3"))]
    for name, stage in pipeline.STAGES:
        got.append(stage(spark, got[-1], SF).cache())
    return got


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_stage_drops_toxic_and_keeps_clean(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({d for d, _ in pairs(s)} for s in stages[:2])
    gone = before - after
    assert after <= before and None in after and 10_000 in after
    assert gone and sum(labels.get(d) == 0 for d in gone) <= 0.05 * len(labels)
    assert sum(labels[d] == 1 for d in gone if d in labels) >= 0.5 * sum(v for d, v in labels.items() if d in before)


def test_near_duplicate_stage(stages):
    rows = pairs(stages[1])
    first = {d for d, _, c in brute.jaccard(rows) if d == c}
    assert sorted(pairs(stages[2]), key=repr) == sorted({r for r in rows if r[0] in first}, key=repr)


def test_repeat_stage(stages):
    rows = pairs(stages[2])
    want = [(d, None if t is None else r[5].decode("utf-8", "ignore")) for (d, t), r in zip(rows, brute.byte_repeats(rows))]
    assert sorted(pairs(stages[3]), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages[3].collect())


def test_packing_stage(stages):
    rows = pairs(stages[3])
    ids = library_ids(pipeline.TOKENIZER, [t or "" for _, t in rows])
    assert brute.pieces_ok(stages[4].collect(), {d: [*x, 0] for (d, _), x in zip(rows, ids)}) == 0


def test_run_writes_and_rereads(spark):
    assert pipeline.run(spark, SF).columns == COLUMNS["op10_harmonic_packing"]
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_query(spark, name):
    got = entry.queries()[name](spark, SF)
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert got.count() > 0


def test_join_query_on_whole_table(spark):
    rows = pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    got = entry.queries()["op2_ngram_jaccard_join"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.jaccard(rows))
    assert tokens.path(pipeline.TOKENIZER)
