"""Fingerprints: next documents and edits by brute force, likeness, and where edits are."""

import hashlib
import random

import pytest

from dossier.llm import merkle
from dossier.llm.merkle import differing, fingerprints, likeness, with_fingerprint
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(text):
    """[section node, [[paragraph node, leaves]]] of a text, and its root, by hand."""
    sections = []
    for s in text.split("\n\n"):
        leaves = [[sha(p[i : i + 32]) for i in range(0, len(p), 32)] for p in s.split("\n")]
        paragraphs = [[sha(",".join(x)), x] for x in leaves]
        sections.append([sha(",".join(n for n, _ in paragraphs)), paragraphs])
    return sections, sha(",".join(n for n, _ in sections))


def plain(text):
    """Fingerprint, leaves, and the nodes of sections and paragraphs."""
    sections, root = tree(text)
    paragraphs = [p for _, ps in sections for p in ps]
    # leaves follow the lines of the whole text; empty lines have none
    leaves = [x[:8] for _, xs in paragraphs for x in xs]
    nodes = [n[:16] for n, _ in sections], [n[:16] for n, _ in paragraphs]
    return ".".join([root, "".join(nodes[0]), "".join(nodes[1]), "".join(leaves)]), leaves, nodes


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def unlike(a, b):
    return sum(i >= len(a) or i >= len(b) or a[i] != b[i] for i in range(max(len(a), len(b))))


def test_edited_texts(spark):
    rng = random.Random(8)
    docs = {rng.randrange(10**9): "".join(rng.choices("ab é\n日😀", k=rng.choice([0, 1, 3, 50, 400, 4000]))) for _ in range(150)}
    docs[5] = None
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs.items()], "doc_id bigint, text string, head string, times int")
    rows = {r.doc_id: r for r in fingerprints(frame).collect()}
    order = sorted(docs)
    assert sorted(rows) == order
    for i, j in zip(order, order[1:] + order[:1]):
        t, n = docs[i] or "", docs[j] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        (mine, leaves, nodes), (new, new_leaves, new_nodes) = plain(t), plain(edited)
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (mine, new)
        assert rows[i].near_edited == pytest.approx(jaccard(leaves, new_leaves)) and rows[i].near_next == pytest.approx(jaccard(leaves, plain(n)[1]))
        assert (rows[i].edited_sections, rows[i].edited_paragraphs) == tuple(unlike(a, b) for a, b in zip(nodes, new_nodes))
    assert fingerprints(frame.limit(0)).count() == 0
    alone = fingerprints(frame.where("doc_id = 5")).first()
    assert alone.n_chars == 0 and alone.near_edited == 1.0 == alone.near_next


def test_ties_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 4


def test_whole_repeats(spark):
    """Each repeat is followed by the next one, the last by the next document."""
    a, b = "first text " * 30, "another one, quite unlike " * 20
    got = fingerprints(spark.createDataFrame([(1, a), (2, b), (1, a), (1, a)], "doc_id bigint, text string")).collect()
    near = sorted(r.near_next for r in got if r.doc_id == 1)
    own, onward = a[: len(a) - len(a) // 4] + a[: len(a) // 4], a[: len(a) - len(a) // 4] + b[: len(a) // 4]
    assert len(got) == 4 and near == [pytest.approx(jaccard(plain(a)[1], plain(b)[1])), 1.0, 1.0]
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 1) == sorted([sha(own), sha(own), sha(onward)])


def test_many_rows_of_one_id_or_none(spark):
    """Each row still stands before the next in one round trip."""
    rows = [(i, f"{c}{k:03d}" * 8) for c, ids in (("n", [None] * 200), ("f", [5] * 200), ("o", range(100))) for k, i in enumerate(ids)]
    got = [(r.key, r.text[:4], r.head) for r in merkle.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    onward = {name: head[:4] for _, name, head in got}
    keys = {name: key for key, name, _ in got}
    at, seen = "n000", []
    for _ in rows:
        seen.append(keys[at])
        at = onward[at]
    assert len(got) == 500 and at == "n000" and len(set(onward.values())) == len(rows)
    first = seen.index(0)
    turned = seen[first:] + seen[:first]
    assert turned == sorted(k for k, _ in rows if k is not None) + [None] * 200


def test_texts_move_once(spark):
    """The texts' exchange is planned once and reused."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    plan = merkle.with_next(docs)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_long_texts(spark):
    rows = [(1, "x" * 3_000_000), (2, "\n" * 300_000), (3, None)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_chars == 3_000_000 and got[1].edited_sha256 == sha("x" * 2_250_000 + "\n" * 300_000)
    assert got[2].edited_sha256 == sha("\n" * 225_000) and got[3].edited_sha256 == sha("")


def test_edits_are_located(spark):
    a = "one line\nand another\n\nsecond section\nwith two lines of text that go on for a while, longer than a piece"
    b = a.replace("two lines", "2 lines")
    frame = spark.createDataFrame([(a, b), (a, a)], "a string, b string")
    frame = with_fingerprint(with_fingerprint(frame, "a", "fa", "pa"), "b", "fb", "pb")
    rows = frame.select(differing(F.col("fa"), F.col("fb")).alias("d"), likeness(F.col("pa"), F.col("pb")).alias("l")).collect()
    assert (rows[0].d.sections, rows[0].d.paragraphs) == ([1], [3]) and 0.2 < rows[0].l < 1
    assert (rows[1].d.sections, rows[1].d.paragraphs, rows[1].l) == ([], [], 1.0)
