"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pytest
from dossier.llm.bpe import BytePairCoder, encode_decode
from dossier.llm.queries import op3_bpe_coding, tokenizer_files

ODD = ["", " ", "\n\n  \n", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "=" * 500, "<|endoftext|> x<|endoftext|>", "日本語のテキスト 😀😀 ñandú", "x" * 3 + " " * 700 + "y", "don't we'll I'M 12345 1,000.00", "\x00\x01�", "ﷺ ﷺ​  é"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, _, pattern = tokenizer_files()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    path, _, pattern = tokenizer_files()
    return BytePairCoder(path, pattern)


def test_same_ids_as_the_library(coder, library):
    rng = random.Random(5)
    alphabet = "aeiou  thnrs.,!?\n\t'0123456789éßñ漢😀ABC"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(600)]
    texts += ["".join(rng.choices("theanrdi", k=rng.randrange(1, 300))) for _ in range(200)]
    for text in texts:
        assert coder.encode(text) == library.encode_ordinary(text), text[:80]
        assert b"".join(coder.decode(np.array(coder.encode(text), dtype="<u4"))) == text.encode()


def test_long_texts_are_cut_without_a_trace(coder, library, monkeypatch):
    import dossier.llm.bpe as bpe

    monkeypatch.setattr(bpe, "SEGMENT", 50)
    text = "The quick  brown fox's tail, \n\n ends here. " * 40 + "z" * 300
    assert coder.encode(text) == library.encode_ordinary(text)


def test_rows(spark):
    path, _, pattern = tokenizer_files()
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "ab", None), (3, "", "y")], "doc_id bigint, text string, n_tokens string")
    rows = sorted(encode_decode(docs, path, pattern, with_ids=True).collect(), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 4 and sum(r.n_tokens == 0 and r.ids_sha256 == none for r in rows) == 3
    assert encode_decode(docs.limit(0), path, pattern).count() == 0


def test_query_on_whole_table(spark, small_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op3_bpe_coding(spark, small_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
