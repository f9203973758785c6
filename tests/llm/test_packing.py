"""Packing: the same ids as the tokenizers library, no gap, no overlap, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from dossier.llm.packing import Plan, pack, pack_documents, token_pieces, tokenizer
from dossier.llm.queries import op4_best_fit_packing, tokenizer_files


def laid_out(plan, counts):
    """(sequence, offset, length) of each piece of a plan."""
    for length, runs in plan.arrays().items():
        first = [r[0] for r in runs] + [counts[length]]
        for i, (rank, sequence, offset) in enumerate(runs):
            for j in range(first[i + 1] - rank):
                yield int(sequence) + j, int(offset), length


def gapless(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plans():
    rng = random.Random(3)
    for trial in range(150):
        capacity = rng.choice([7, 16, 64, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        plan = Plan(counts, capacity)
        rows = list(laid_out(plan, counts))
        assert len(rows) == sum(counts.values())
        n = gapless(rows, capacity)
        assert n == plan.sequences
        least = -(-sum(x * k for x, k in counts.items()) // capacity)
        items = sorted((x for x, k in counts.items() for _ in range(k)), reverse=True)
        bins = []
        for x in items:  # best fit decreasing, one by one
            fit = [i for i, g in enumerate(bins) if g >= x]
            if fit:
                i = min(fit, key=lambda i: bins[i])
                bins[i] -= x
            else:
                bins.append(capacity - x)
        assert least <= n <= len(bins) * 1.03 + 1
    assert Plan({}, 8).sequences == 0


@pytest.mark.parametrize("unit", [" ", "\n", "a", "ab cd  ", "é", "<|endoftext|>", "\t \n"])
def test_long_texts_have_the_ids_of_the_library(unit):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_files()[1]), tokenizer(*tokenizer_files())
    for text in (unit * (1_000_000 // len(unit)), "x " + unit * (700_000 // len(unit)) + "<|endoftext|> y  z" + unit * 7):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a"])
def test_the_longest_texts_are_packed(spark, unit):
    docs = spark.createDataFrame([(1, unit * 5_000_000), (2, "short"), (3, None)], "doc_id bigint, text string")
    rows = pack_documents(docs, *tokenizer_files()).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert gapless([(r.sequence_id, r.offset, r.length) for r in rows], 1024) == len({r.sequence_id for r in rows})


def test_query(spark, small_dir):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(tokenizer_files()[1])
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = op4_best_fit_packing(spark, small_dir).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    for doc_id, parts in by.items():
        ids = np.array([*tokens.encode(docs[doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == 1024 for p in parts[1:]) and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert len(parts) == -(-len(ids) // 1024)
    n = gapless([(r.sequence_id, r.offset, r.length) for r in rows], 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 2


def test_clashing_names_and_null_ids(spark):
    rows = [(None, 0, 500 + i % 3, i) for i in range(200)] + [(1, 0, 1024, 1)] * 3
    names = ("rank", "bucket", "before", "sequence_id", "a.b")
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, own bigint").selectExpr("*", *[f"own AS `{n}`" for n in names])
    out = pack(pieces).collect()
    gapless([(r.sequence_id, r.offset, r.length) for r in out], 1024)
    assert len(out) == 203 and all(r["rank"] == r.own and r["a.b"] == r.own for r in out)
    assert pack(pieces).columns == ["doc_id", "piece", "length", "own", "rank", "bucket", "before", "a.b", "sequence_id", "offset"]


def test_odd_rows(spark):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    texts = [None, "", "same", "same", "a <|endoftext|> b<|endoftext|>", "many words " * 3000, "x" * 5000]
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, length string")
    docs = docs.union(docs.where("doc_id = 3"))
    rows = pack_documents(docs, *files).collect()
    gapless([(r.sequence_id, r.offset, r.length) for r in rows], 1024)
    tokens = Tokenizer.from_file(files[1])
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == (i or None)]
        assert sum(r.length for r in mine) == (len(tokens.encode(t or "", add_special_tokens=False).ids) + 1) * (2 if i == 3 else 1)
    assert pack_documents(docs.limit(0), *files).count() == 0
    assert token_pieces(docs.limit(0), *files).columns == ["doc_id", "piece", "start", "length", "ids_crc32"]
