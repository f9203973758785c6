"""Passage removal against brute force."""

import hashlib
import random
import re

from dossier.llm.queries import op8_substring_dedup
from dossier.llm.substring import dedup_passages, lengths

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, length=13):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        if i is not None:
            for a in range(len(w) - length + 1):
                k = tuple(w[a : a + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if i is not None and first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é x", "日本"]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (12, 13, 14, 30, 80)]
    docs = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))))
        docs.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t\t", "\x0b"]).join(parts)))
    docs = list(dict(docs).items())
    docs += [(docs[0][0], docs[0][1]), (None, passages[3]), (None, None), (20_000, None), (20_001, ""), (-5, passages[4])]
    docs.append((30_000, " ".join(passages) + " tail"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(dedup_passages(frame)) == brute(docs)
    for length in (1, 4, 30, 50):
        assert result(dedup_passages(frame, length=length)) == brute(docs, length)


def test_rewritten_text_and_odd_tables(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    frame = spark.createDataFrame([(1, f"a\n{passage}  b", "s", 5), (2, f"c {passage}\nd", None, None), (3, "x  y", "s", 1)], "doc_id bigint, text string, n_words string, level int")
    rows = {r.doc_id: r for r in dedup_passages(frame).collect()}
    assert rows[1].text == f"a\n{passage}  b" and rows[2].text == "c d" and rows[3].text == "x  y"
    assert rows[2].n_removed == 20 and rows[2].level is None
    assert dedup_passages(frame.limit(0)).count() == 0


def test_levels():
    assert [lengths(n) for n in (1, 2, 4, 13, 14, 50)] == [[1], [1, 2], [2, 4], [7, 13], [7, 14], [7, 13, 25, 50]]


def test_one_id_or_none_in_many_rows(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(None, f"{passage} n{i}") for i in range(300)] + [(7, f"{passage} s{i}") for i in range(300)] + [(9, passage)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(dedup_passages(frame)) == brute(docs)
    odd = frame.selectExpr("doc_id", "text", "1 AS _block", "2 AS part", "3 AS block", "4 AS `a.b`")
    assert dedup_passages(odd).columns == ["doc_id", "text", "_block", "part", "block", "a.b", "n_words", "n_removed", "kept_sha256"]


def test_query(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert result(op8_substring_dedup(spark, small_dir)) == brute(docs)


def test_long_text(spark, monkeypatch):
    import numpy as np
    from dossier.llm import words

    monkeypatch.setattr(words, "CHUNK", 100)
    texts = [b"", b"ab cd " * 100, b"x" * 500, b"ab cd", " é ab".encode()]
    h, bounds = words.hashed_words(texts, words.SPACES)
    assert bounds.tolist() == [0, 0, 200, 201, 203, 205]
    assert len(set(h[:200].tolist())) == 2 and h[0] == h[201] == h[204] and h[1] == h[202]
    assert np.array_equal(words.windows(h, 2)[:2], words.windows(h, 2)[2:4])
