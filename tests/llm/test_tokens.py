"""Token files, byte-level BPE, packing."""
import base64
import zlib

import numpy as np
import public_tokenizers as tokens
import pytest

from tests.llm import brute
from varpack.llm import byte_bpe, packing, token_files


def library_ids(name, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, odd_docs, odd_rows, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd_docs, path, tokens.path("word_bpe_49k.json"), file_tokens=500)
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    assert spark.read.parquet(path).count() > 3
    want = [(d, (*ids, 1)) for (d, _), ids in zip(odd_rows, library_ids("word_bpe_49k.json", [t or "" for _, t in odd_rows]))]
    as_ids = [(r.doc_id, tuple(int(x) for x in np.frombuffer(r.ids, "<u4"))) for r in got]
    assert sorted(as_ids, key=repr) == sorted(want, key=repr)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_token_files_of_no_documents(spark, no_docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(no_docs, path, tokens.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 1000, 10**9, 10**9 + 1], list(range(0, 9000, 3)), [0] * 700 + [2**40]])
def test_elias_fano(values):
    v = np.array(values, np.int64)
    ef, used = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(v).dump()))
    assert ef.values().tolist() == values
    assert [ef[i] for i in range(0, len(values), 7)] == values[::7]
    assert used == len(token_files.EliasFano.of(v).dump())


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(token_files.EliasFano.of(v).dump()) < 1.7 * len(v)   # against 8 bytes an offset


def test_byte_bpe_matches_the_library(odd_docs, odd_rows, monkeypatch):
    import tiktoken
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 3000)
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(odd_docs, path, tokens.PATTERN), path).collect()
    have = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded.decode()) for r in got), key=repr)
    want = [(d, len(ids), ids, t or "") for d, t in odd_rows for ids in [library.encode_ordinary(t or "")]]
    assert have == sorted(want, key=repr)


def test_encoders_on_white_space_and_odd_characters(spark):
    import tiktoken
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "a\x00b c\x00", "\x00", "x\x1cy z", "x\x85 y\xa0z", "é é  ñ x", "x \u3000y", "日本 語 a",
             "Σίσυφος ΟΔΟΣ", "İstanbul ǅ", "e \u0301x", "don't I'LL we've", "À×÷ß ÿ", "½ ²³ 123", "<|endoftext|> <|startoftext|>", "z"]
    texts += [" ".join(texts), "\n".join(texts[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode_documents(docs, path, tokens.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    pieces = packing.pack_documents(docs, tokens.path("byte_bpe_50k.json")).collect()
    assert brute.pieces_ok(pieces, {i: [*x, 0] for i, x in enumerate(library_ids("byte_bpe_50k.json", texts))}) == 0


def test_byte_bpe_of_no_documents(no_docs):
    path = tokens.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode_documents(no_docs, path, tokens.PATTERN).collect() == []


def test_packing(spark, odd_rows):
    rows = list({d: (d, t) for d, t in odd_rows}.values())
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = packing.pack_documents(docs, tokens.path("byte_bpe_50k.json")).collect()
    ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in rows])
    assert brute.pieces_ok(got, {d: [*x, 0] for (d, _), x in zip(rows, ids)}) == 0
    full = sum(len(x) + 1 for x in ids) / 1024
    assert len({p.sequence_id for p in got}) <= full + 3 * 40


def test_packing_repeated_rows_ids_and_empty(spark, odd_docs, odd_rows, no_docs):
    got = packing.pack_documents(odd_docs, tokens.path("byte_bpe_50k.json"), with_ids=True).collect()
    total = sum(len(x) + 1 for x in library_ids("byte_bpe_50k.json", [t or "" for _, t in odd_rows]))
    assert sum(p.length for p in got) == total == sum(len(p.ids) // 4 for p in got)
    assert packing.pack_documents(no_docs, tokens.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("length", [1, 3, 512, 1023, 1024, 1025, 5000])
def test_cut(length):
    sizes = packing.cut(length, 1024)
    assert sum(sizes) == length and all(1024 % s == 0 for s in sizes)
