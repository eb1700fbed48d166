"""Encoding equal to the library's, and files that read back."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


ENCODE = whole(WORDS)
ODD = ["Don't STOP's we'll <|endoftext|> x<|startoftext|>y  a\tb\x1cc É́É ΟΔΟΣ Σ. İstanbul ŉa ǅ! ١٢٣ 12ab, a1! ... !!! ...?? 你好。 q ́e ﬁ ß ẞ", "", " ", "\n\n", "a" * 500 + ".", "é" * 300 + ".", "A.b,c;", "ªº µ ĳ ŀ, ſ.", "x'S 'tis ''s dogs' (a) [b]. #c# d--", "漢字kana かな"]


def as_ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_library(path):
    encode, want = tokenfile.Encoder(path), whole(path)
    assert tokenfile.splits_at_space(path) == (path == WORDS)
    for _ in range(2):
        assert [as_ids(x) for x in encode.many([*ODD, None])] == [want(t) for t in [*ODD, None]]


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("aeThI .,;!?'\n#$<|>-é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert as_ids(tokenfile.encoder(WORDS)(text)) == ENCODE(text)


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 3)
    monkeypatch.setattr(tokenfile, "GROUP", 20)
    encode = tokenfile.Encoder(WORDS)
    texts = [f"word{i} Alpha, beta gamma{i % 3}. delta" for i in range(50)]
    assert [as_ids(x) for x in encode.many(texts * 2)] == [ENCODE(t) for t in texts * 2]


def expected(rows):
    """(doc_id, start, n_tokens, crc), ties in the order of the files."""
    out, start = [], 0
    coded = [(r[0], np.array(ENCODE(r[1]), "<u4")) for r in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(x[1].tobytes())))
    for i, ids in coded:
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("per_shard", [3, 10_000])
def test_files_read_back(spark, edge_docs, edge_rows, tmp_path, per_shard):
    root = str(tmp_path / "t")
    manifest = tokenfile.write_tokens(edge_docs, WORDS, root, docs_per_shard=per_shard)
    got = sorted(map(tuple, tokenfile.read_tokens(manifest, root).collect()), key=lambda r: r[1])
    assert got == expected(edge_rows)
    assert sum(r.n_docs for r in manifest.collect()) == len(edge_rows)


def test_a_document_is_read_alone(spark, edge_docs, edge_rows, tmp_path):
    root = str(tmp_path / "t")
    manifest = tokenfile.write_tokens(edge_docs, WORDS, root)
    with open(f"{root}/dictionary.zstd", "rb") as f:
        dictionary = f.read()
    shard = tokenfile.ShardReader(manifest.first().path, dictionary)
    place = shard.ids.index(10)
    assert shard.document(place).tolist() == ENCODE("one two")
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.ShardReader(manifest.first().path, dictionary + b"x")
    with pytest.raises(ValueError, match="not a token shard"):
        tokenfile.ShardReader(f"{root}/dictionary.zstd", dictionary)


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    root = str(tmp_path / "t")
    manifest = tokenfile.write_tokens(df, WORDS, root)
    path = manifest.first().path
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.seek(tokenfile.HEAD + 12)
        f.write(b"\xff\xff")
    assert os.path.getsize(path) == size
    with pytest.raises(Exception, match=r"damaged|Error"):
        tokenfile.read_tokens(manifest, root).collect()


def test_empty_table(spark, no_docs):
    assert tokenfile.tokenise(no_docs, WORDS).count() == 0


def test_wide_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    manifest = tokenfile.write_tokens(df, WORDS, str(tmp_path / "t"), end_id=70_000)
    got = sorted(tokenfile.read_tokens(manifest, str(tmp_path / "t")).collect())
    assert [r.n_tokens for r in got] == [3, 1] and got[1].ids_crc32 == zlib.crc32(np.array([70_000], "<u4").tobytes())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, tokenfile.query(spark, sf).collect())) == expected(rows)


def test_an_id_of_many_rows_and_rows_without_id_fill_several_shards(spark, tmp_path):
    rows = [(None, f"none {i}") for i in range(50)] + [(None, "same")] * 30 + [(7, f"hot {i}") for i in range(90)] + [(i, f"w {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = tokenfile.write_tokens(df, WORDS, str(tmp_path), docs_per_shard=20)
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    assert max(r.n_docs for r in shards) <= 45 and sum(r.n_docs for r in shards) == len(rows)
    back = sorted(tokenfile.read_tokens(manifest, str(tmp_path)).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), zlib.crc32(np.array(ENCODE(t), "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in back) == want
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens
