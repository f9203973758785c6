"""Runs of repeated words: equal to a search of every stretch at every period; the contract's query; odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from dossier.llm import periodic
from dossier.llm.periodic import periodic_runs, runs_in
from dossier.llm.queries import op12_periodic_runs


def plain_runs(words, least=6, exponent=4):
    """All maximal stretches at each period, without those that have a smaller one."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(texts):
    names = {}
    return np.array([names.setdefault(w, len(names)) for t in texts for w in t], dtype=np.int64), np.cumsum([0, *map(len, texts)])


def some_words(rng):
    words = []
    while len(words) < rng.randint(0, 120):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    return words


def test_same_as_trying_everything():
    rng = random.Random(7)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        want = [(t, *r) for t, words in enumerate(texts) for r in plain_runs(words)]
        assert [tuple(r) for r in runs_in(*numbered(texts)).tolist()] == want
    for least, exponent in ((3, 3), (10, 5), (1, 7)):
        words = some_words(rng) * 3
        assert [tuple(r[1:]) for r in runs_in(*numbered([words]), least, exponent).tolist()] == plain_runs(words, least, exponent)


def test_long_periods_and_long_runs():
    rng = np.random.default_rng(2)
    unit = rng.integers(0, 50, 25_000)
    words = np.concatenate([[-1], np.tile(unit, 5)[:110_000], [-2], np.zeros(300_000, dtype=np.int64)])
    got = runs_in(np.unique(words, return_inverse=True)[1], np.array([0, len(words)])).tolist()
    assert [0, 1, 110_000, 25_000] in got and [0, 110_002, 300_000, 1] in got


def test_query(spark, small_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    planted = 0
    for r in op12_periodic_runs(spark, small_dir).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
        runs = plain_runs(words)
        planted += bool(runs) and h % 10 == 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert tuple(r) == (r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))
    assert planted > 5


def test_odd_rows(spark, monkeypatch):
    schema = "doc_id bigint, text string, runs string, `row` int, `a.b` string"
    rows = [(1, None, "x", 1, "p"), (2, "", "x", 1, "p"), (3, " \t\n ", "x", 1, "p"), (4, "b\xa0c " * 7 + "é", "x", 1, "p"), (4, "b\xa0c " * 7 + "é", "x", 1, "p"), (None, "w " * 400_000, "x", None, None)]
    frame = spark.createDataFrame(rows, schema)
    out = periodic_runs(frame)
    assert out.columns == ["doc_id", "text", "row", "a.b", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, [], None), (2, 0, [], ""), (3, 0, [], ""), *[(4, 8, [(0, 7, 1)], "b\xa0c é")] * 2, (0, 400_000, [(0, 400_000, 1)], "w")], key=str)
    assert periodic_runs(frame.limit(0)).count() == 0
    monkeypatch.setattr(periodic, "WORDS", 10)  # texts are then judged one by one
    words, bounds = periodic._split(__import__("pyarrow").array(["a a a a a a a", None, "b c " * 9, "x"]))
    assert len(words) == 26 and list(periodic._groups(bounds)) == [(0, 2), (2, 3), (3, 4)]
