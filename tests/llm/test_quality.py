"""Quality classifier: held-out accuracy, a version in plain Python, odd rows, tables without labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from dossier.llm import quality
from dossier.llm.quality import ACCEPT, HALVED, METADATA, SHARE, SLOTS, SMOOTH, SURE, Logistic, score, train

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_score double"
MARKS = "doc_id bigint, quality int, toxic int, text string"


def test_accuracy_on_documents_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    unseen = labels.where("doc_id % 2 = 1").join(docs, "doc_id")
    rows = score(unseen, model).select("quality", "quality_score").collect()
    good = [r.quality_score >= ACCEPT for r in rows if r.quality == 1]
    bad = [r.quality_score < ACCEPT for r in rows if r.quality == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.995 and np.mean(bad) > 0.9
    alone = score(unseen, train(docs, labels.where("doc_id % 2 = 0"), rounds=0)).select("quality", "quality_score").collect()
    print("ranked right, labels alone and co-trained:", ranked_right(alone), ranked_right(rows))
    assert ranked_right(rows) > ranked_right(alone)  # what the views have taught each other adds


def ranked_right(rows):
    """The share of pairs of a good and a bad document in which the good one scores higher."""
    bad = np.sort([r.quality_score for r in rows if r.quality == 0])
    good = np.array([r.quality_score for r in rows if r.quality == 1])
    return float((np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).mean() / 2 / len(bad))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_both_views_teach_on_the_given_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where("doc_id % 2 = 0"))
    print(model.history)
    assert len(model.history) == quality.ROUNDS
    for content, metadata, content_right, metadata_right in model.history:
        assert content > 0 and metadata > 0 and min(content_right, metadata_right) >= SURE


def plain_tokens(text):
    raw = [ord("0") if 48 <= b <= 57 else b for b in f"\n{text or ''}\n".encode()]
    return [(raw[i] * 7919 + raw[i + 1] * 263 + raw[i + 2]) % SLOTS for i in range(len(raw) - 2)]


def plain_style(text):
    words = f"{text or ''}".split()
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    most = max(Counter(words).values(), default=0)
    return [20 * again // n, 64 + 32 * int(math.log2(n)) + 20 * len(set(words)) // n, 600 + 20 * most // n]


def plain_metadata(row):
    _, text, lang, source, n, _ = row
    ratio = None if n is None else max(-20, min(20, round(4 * math.log((1 + max(0, n)) / (1 + len(text or ""))))))
    length = None if n is None else int(2 * math.log2(1 + max(0, n)))
    text = text or ""
    word, line = min(80, 4 * len(text) // max(1, len(text.split()))), int(2 * math.log2(1 + len(text) / len(text.split("\n"))))
    return [zlib.crc32(f"{i} {v}".encode()) % METADATA for i, v in enumerate((lang, source, length, ratio, word, line))]


def plain_scores(rows, labels, rounds):
    """The same by loops over documents and dictionaries."""
    kinds = [{i: tokens(r) for i, r in enumerate(rows)} for tokens in (lambda r: plain_tokens(r[1]), lambda r: plain_style(r[1]), plain_metadata)]
    known = {i: labels[r[0]] for i, r in enumerate(rows) if r[0] in labels}
    kept = [i for i in known if zlib.crc32(str(rows[i][0]).encode()) % 4 == 0]
    learn = {i: y for i, y in known.items() if i not in kept}

    def fitted(marks):
        evidence = []
        for kind, marked in zip(kinds, (marks[0], marks[0], marks[1])):
            sums = [Counter(), Counter()]
            for i, y in marked.items():
                for t in kind[i]:
                    sums[y][t] += 1 / max(1, len(kind[i]))
            seen = set(sums[0]) | set(sums[1])
            total = [sum(s.values()) + SMOOTH * len(seen) for s in sums]
            ratio = {t: math.log((sums[1][t] + SMOOTH) / total[1]) - math.log((sums[0][t] + SMOOTH) / total[0]) for t in seen}
            evidence.append([sum(ratio.get(t, 0.0) for t in kind[i]) / max(1, len(kind[i])) for i in range(len(rows))])
        order = sorted(kept, key=lambda i: rows[i][0])
        y = np.array([float(known[i]) for i in order])
        out = [Logistic().fit(x[order], y).odds(x) for x in (np.array(evidence[:2]).T, np.array(evidence[2:]).T)]
        both = np.stack(out, 1)
        return out, Logistic().fit(both[order], y, quality.JOINT_RIDGE).odds(both)

    def sure(odds, share):
        for part in [share / 2**i for i in range(HALVED + 1)]:
            low, high = (np.quantile([odds[i] for i in kept if known[i] == y], part if y == 0 else 1 - part) for y in (0, 1))
            below, above = ([known[i] for i in kept if side(odds[i])] for side in (lambda o: o <= low, lambda o: o >= high))
            if low < high and below.count(0) >= SURE * len(below) and above.count(1) >= SURE * len(above):
                return {i: int(odds[i] >= high) for i in range(len(rows)) if i not in known and not low < odds[i] < high}
        return {}

    (a, b), joint = fitted([learn, learn])
    taught = []
    for n in range(rounds):
        marks = [learn | sure(odds, SHARE * (n + 1)) for odds in (b, a)]
        (a, b), joint = fitted(marks)
        taught.append(tuple(len(m) - len(learn) for m in reversed(marks)))
    return 1 / (1 + np.exp(-joint)), taught


def small_corpus(n=160):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = rng.choice(["good", "plain", "words", "9 of 17", "été"] if good else ["###", "bad$$$", "words", "!!", "42"], size=int(rng.integers(1, 30)))
        text = " ".join(words)
        rows.append((i, text, "en", f"s{int(rng.integers(4)) + 4 * good}", len(text) + 9 * (not good), 0.1))
    return [*rows, (n, None, None, None, None, 0.0), (n + 1, "", "en", None, 0, 0.0)]


def test_same_as_plain_python(spark):
    rows = small_corpus()
    labels = {i: int(i % 3 > 0) for i in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = train(docs, spark.createDataFrame([(i, y, 0, "x") for i, y in labels.items()], MARKS), rounds=2)
    got = {r.doc_id: r.quality_score for r in score(docs, model).collect()}
    want, taught = plain_scores(rows, labels, 2)
    assert min(min(t) for t in taught) > 3 and [h[:2] for h in model.history] == taught  # each view has taught the other in each round
    assert [got[r[0]] for r in rows] == pytest.approx(want.tolist(), abs=1e-6)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "!!! ### " * 40, "en", "s", 5), (3, "!!! ### " * 40, "en", "s", 5), (None, "words and more words", "fr", None, -3), (4, "z" * 3_000_000, "en", "s", 1)]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA)
    for labels in ([], [(1, 1, 0, "x")], [(None, 0, 0, "x"), (2, 7, 0, "x")]):
        model = train(frame, spark.createDataFrame(labels, MARKS))
        assert model is None and {r.quality_score for r in score(frame, model).collect()} == {1.0}
    docs = spark.createDataFrame(small_corpus(), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(0, 120, 2)] * 2, MARKS)
    model = train(docs.unionAll(docs), labels)
    got = score(docs, model)
    assert all((r.quality_score > 0.5) == bool(r.doc_id % 3) for r in got.collect() if r.doc_id < 160)
    out = score(frame.withColumn("slot", frame.doc_id).withColumn("y.z", frame.doc_id), model)
    assert out.count() == 6 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "y.z", "quality_score", "content_score", "metadata_score"]
    assert score(frame.limit(0), model).count() == 0 and train(frame.limit(0), labels) is None


def test_long_texts_are_read_in_parts(monkeypatch):
    text = ("word " * 40 + "é###").encode()
    whole = Counter(s for _, slots in quality.trigrams([b"abc", text, b"x"]) for s in slots.tolist())
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert Counter(s for _, slots in quality.trigrams([b"abc", text, b"x"]) for s in slots.tolist()) == whole
    assert sum(whole.values()) == 1 + len(text) - 2
