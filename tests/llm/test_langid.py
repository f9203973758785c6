"""Language identification: exact marginals, held-out accuracy, code-switched words."""

import itertools
import unicodedata

import numpy as np
import pytest
import regex as re
from dossier.llm import langid
from dossier.llm.langid import Crf, Reader, forward_backward, held_out, predict, train
from dossier.llm.queries import op2_language_id
from pyspark.sql import functions as F


def test_marginals_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(langid, "BUCKET", 3)
    lengths = np.array([1, 7, 0, 3, 8])
    emit, moves, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = forward_backward(emit, lengths, moves, start)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(emit[at + i, k] for i, k in enumerate(path)) + (start[path[0]] if n else 0) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += p
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(unseen) > 150
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    text = {r.lang: r.text for r in docs.where("n_chars between 1000 and 2000 and lang in ('fr', 'de')").orderBy("doc_id").collect()}
    words = [langid.WORDS.findall(text[k].lower())[:60] for k in ("fr", "de")]
    marginals = Reader(model).label_words([words[0] + words[1]])[0].argmax(1)
    want = [model.labels.index("fr")] * len(words[0]) + [model.labels.index("de")] * len(words[1])
    assert np.mean(marginals == np.array(want)) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "the of and the", "en"), (5, "le la des et", "fr"), (5, "le la des et", "fr"), (6, "x" * 5000 + " the", None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int")
    assert predict(frame, None).where("lang_pred <> 'und'").count() == 0
    model = train(spark.createDataFrame([(i, t, k, 1) for i, (t, k) in enumerate([("the of and", "en"), ("le la des", "fr")] * 20)], frame.schema))
    got = predict(frame, model).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in got if r.doc_id == 5} == {"fr"} and {r.lang_pred for r in got if r.doc_id is None} == {"en"}
    assert train(frame.limit(0)) is None and predict(frame.limit(0), model).count() == 0


def plain_prediction(model, text):
    """One text, word by word, by the textbook's recursions."""
    words = re.findall(r"\p{L}+", (text or "").lower()) if text else []
    if not words:
        return "und", 0.0
    n = len(model.labels)
    emit = [[sum(model.weights[s, k] for s in langid.slots_of([w])[0]) + (model.lexicon[w][k] if w in model.lexicon else 0) for k in range(n)] for w in words]
    emit = [np.exp(np.array(e) - max(e)) for e in emit]
    moves = np.exp(model.moves)
    alpha = [np.exp(model.start) * emit[0]]
    for e in emit[1:]:
        alpha.append(alpha[-1] @ moves * e)
        alpha[-1] /= alpha[-1].sum()
    beta = [np.ones(n)]
    for e in reversed(emit[1:]):
        beta.append(moves @ (e * beta[-1]))
        beta[-1] /= beta[-1].sum()
    both = np.array(alpha) * np.array(beta[::-1])
    mean = (both / both.sum(1, keepdims=True)).mean(0)
    return model.labels[int(mean.argmax())], float(mean.max())


def test_same_as_plain_python(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = train(docs.where(~held_out()), sample=20)
    got = {r.doc_id: r for r in predict(docs, model).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        name, score = plain_prediction(model, row.text)
        assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == (name, pytest.approx(score, abs=1e-6))


def test_number_signs_are_no_letters(spark):
    model = train(spark.createDataFrame([(1, "the of and", "en"), (2, "le la des", "fr")], "doc_id bigint, text string, lang string"))
    frame = spark.createDataFrame([(1, "½ ² ① Ⅷ 7"), (2, "² the ½of")], "doc_id bigint, text string")
    assert sorted(map(tuple, predict(frame, model).select("doc_id", "lang_pred").collect())) == [(1, "und"), (2, "en")]
    odd = "".join(chr(c) for c in (*range(0x20, 0x2FFF), *range(0x1D400, 0x1D800), *range(0x10100, 0x10200)) if unicodedata.category(chr(c)) != "Cn")
    assert langid.WORDS.findall(odd) == re.findall(r"\p{L}+", odd)


def test_words_of_texts_without_number_signs_take_the_short_way(monkeypatch):
    """The pattern that knows all number signs tries each letter on all of them, which took four fifths of the operator's time."""
    plain = ["", "Un Œuvre d'ÉTÉ_2, ça va? Straße 7", "İstanbul שלום 漢字 a\u0301b", "A" * 9 + " \U0001d504x"]
    odd = ["x² y", "½of Ⅷ the", "a①b", "n\U00010107n", "一二 三"]
    want = {t: langid.WORDS.findall(t.lower()) for t in plain + odd}
    assert [langid.words_of(t) for t in plain + odd] == list(want.values())
    monkeypatch.setattr(langid, "WORDS", None)
    assert [langid.words_of(t) for t in plain] == [want[t] for t in plain]


def test_training_reads_whole_texts(spark):
    long = " ".join(["the"] * 400 + ["latest"])
    rows = [(1, long, "en"), (1, long, "en"), (1, "zz " + long, "en"), (2, "le", "fr"), (3, "..", "fr")]
    texts = langid.training_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert [(n, i, len(w), w[-1]) for n, i, w in texts] == [("en", 1, 401, "latest"), ("fr", 2, 1, "le")]
    chains = langid.spliced(texts, ["en", "fr"])
    assert sum(len(w) for w, _ in chains[: len(chains) // 2]) == 402


def test_one_label():
    model = Crf(["en"])
    model.fit([(["the", "of"], [0, 0])])
    assert np.allclose(Reader(model).label_words([["the", "zzz"], []])[0], 1)
