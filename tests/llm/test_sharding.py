"""Sharding: a permutation that is the one in plain Python, whichever way rows lie; shards and slots; files; odd rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from dossier.llm import sharding
from dossier.llm.queries import op11_feistel_sharding
from dossier.llm.sharding import ROUNDS, SEED, permuted, radices, row_number_at, shard, walk_length, write_shards
from pyspark.sql import functions as F


def plain_place(x, n):
    a, b = radices(n)
    while True:
        u, v = divmod(x, b)
        for i in range(ROUNDS):
            u, v = v, (u + int(hashlib.md5(f"{SEED}:{i}:{v}".encode()).hexdigest()[:15], 16)) % (a, b)[i % 2]
        x = u * b + v
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    a, b = radices(n)
    assert n <= a * b < n + a
    passes, back = walk_length(spark, n), walk_length(spark, n, inverse=True)
    place = permuted(F.col("id"), n, passes)
    rows = spark.range(n).select("id", place.alias("p"), row_number_at(place % 4, F.floor(place / 4), n, back, 4).alias("id2")).collect()
    assert [r.p for r in sorted(rows)] == [plain_place(x, n) for x in range(n)]
    assert {r.p for r in rows} == set(range(n)) and all(r.id == r.id2 for r in rows)


def test_every_walk_ends_in_time(spark):
    for n in range(1, 60):
        a, b = radices(n)
        longest = 1
        for x in range(n):
            for step in range(1, 99):
                u, v = divmod(x, b)
                for i in range(ROUNDS):
                    u, v = v, (u + int(hashlib.md5(f"{SEED}:{i}:{v}".encode()).hexdigest()[:15], 16)) % (a, b)[i % 2]
                x = u * b + v
                if x < n:
                    longest = max(longest, step)
                    break
        if n % 7 == 0 or longest > 3:
            assert walk_length(spark, n) == longest


def test_query(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in op11_feistel_sharding(spark, small_dir).collect()}
    assert len(rows) == len(docs)
    for x, d in enumerate(sorted(docs)):
        raw, p = (d.text or "").encode(), plain_place(x, len(docs))
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(raw) + 8, zlib.crc32(raw), "rows", p % 24, p // 24, None)
    sizes = Counter(r.shard for r in rows.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_same_wherever_rows_lie(spark, monkeypatch):
    rows = [(i % 300 if i % 3 else None, f"text {i % 50}", i % 7) for i in range(900)]  # a third has no id, ids and rows repeat
    one = shard(spark.createDataFrame(rows, "doc_id bigint, text string, shard int"), 7)
    many = shard(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, shard int").repartition(31), 7)
    got = [sorted(map(str, x.collect())) for x in (one, many)]
    assert got[0] == got[1] and one.columns == ["doc_id", "text", "row_number", "shard", "slot"]
    slots = sorted((r.shard, r.slot) for r in one.collect())
    assert slots == sorted((p % 7, p // 7) for p in range(900))


def test_odd_rows_and_files(spark, tmp_path):
    schema = "doc_id bigint, text string, `a.b` string, row string, part int, before map<string,int>"
    rows = [(1, None, "x", "r", 1, {"k": 1}), (1, None, "x", "r", 1, None), (None, "", None, None, None, None), (5, "z" * 2_000_000, "y", "s", 2, None)]
    out = shard(spark.createDataFrame(rows, schema), 3)
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(0, 0), (0, 1), (1, 0), (2, 0)] and "a.b" in out.columns
    assert shard(spark.createDataFrame([], schema), 3).count() == 0
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    write_shards(shard(docs, 4), str(tmp_path / "shards"))
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert read.count() == 500 and sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    assert {(r.shard, r.slot) for r in read.collect()} == {(p % 4, p // 4) for p in range(500)}
