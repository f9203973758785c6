"""Exact search against brute force."""

import numpy as np
import pytest
from dossier.llm import topk
from dossier.llm.topk import exact_top_k, integer_components
from pyspark.sql import functions as F


def brute(rows, k):
    out = []
    for i, q in rows:
        if i % 100:
            continue
        scored = sorted(((-int(np.dot(q, x)), j) for j, x in rows if j != i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "HELD_BYTES", 130 * 16 * 56)
    for dims, n in ((3, 40), (40, 500), (64, 700)):
        x = rng.normal(size=(n, dims)) * rng.uniform(0.1, 3, size=(n, 1))
        x[n // 2 :: 3] = x[1]  # many ties
        ints = np.floor(1024 * x).astype(int).tolist()
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = exact_top_k(frame.select("vec_id", integer_components().alias("v")), F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == brute(list(enumerate(ints)), 10)


@pytest.mark.parametrize("parts", [2, 23, 211])
def test_any_number_of_parts(spark, monkeypatch, parts):
    """Spark may make other parts than those asked for: all are searched."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[: 1000] *= rng.uniform(0.1, 3, size=(1000, 1))
    plain = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *by: plain(self, parts, *by))
    monkeypatch.setattr(topk, "ASKING", 10)
    monkeypatch.setattr(topk, "HEAD", 64)
    monkeypatch.setattr(topk, "BLOCK", 100)
    ints = np.floor(1024 * x).astype(int).tolist()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = exact_top_k(frame.select("vec_id", integer_components().alias("v")), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(ints)), 10)


def test_one_id_or_one_vector_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD_BYTES", 20 * 16 * 19)
    frame = spark.createDataFrame([(100, [1, 0])] * 50 + [(7, [1, 1])] * 60 + [(200, [-1, 2]), (8, [9, 9, 9])], "vec_id bigint, v array<bigint>")
    got = exact_top_k(frame, F.col("vec_id") % 100 == 0, 3)
    want = [(100, 1, 8, 9), (100, 2, 7, 1), (100, 3, 7, 1), (200, 1, 8, 9), (200, 2, 7, 1), (200, 3, 7, 1)]
    assert sorted(map(tuple, got.collect())) == want


def test_parts_are_sized_by_bytes():
    """Wider vectors make smaller parts, so what a task holds does not grow with their width."""
    assert topk.part_rows(64) > 90_000 and topk.part_rows(4096) < 2100
    assert all(16 * d * topk.part_rows(d) <= topk.HELD_BYTES for d in (1, 3, 64, 768, 4096))
    assert topk.part_rows(1 << 30) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, nan]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, [-0.5, 0.25]), (None, [1.0, 1.0]), (6, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "vec_id bigint, embedding array<double>, score string")
    ready = frame.select("vec_id", integer_components().alias("v"), "score")
    got = sorted(map(tuple, exact_top_k(ready, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 6, 0), (0, 2, 5, -524288)]
    assert exact_top_k(ready.limit(0), F.col("vec_id") % 100 == 0).count() == 0
