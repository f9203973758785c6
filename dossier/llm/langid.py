"""Language of words and texts by a linear-chain conditional random field.

Each word of letters is a node. Its features are affixes (1 to 3 first, 1 to 4 last letters),
letter n-grams (2 and 3, with word ends), the word itself and its share among the languages in the
training words (the lexicon). Transitions between the labels of neighbours are learned too. The
training chains are whole labelled texts, cut into stretches of ``CHAIN`` words, and as many spliced from texts of different languages, so the
transitions are those of code-switched text. Marginals come from forward-backward; a text's
language is the label with the largest mean marginal over its words, which is the score.

The model is fitted on a bounded sample of labelled documents, about ``SAMPLE`` a language drawn by a hash of
doc_id (of several rows with one id and language the text that sorts first), whole texts, and sent to the tasks with their code. Prediction is a map over
whole texts without a shuffle. It looks at the text alone.

``und`` with score 0 for null texts and those without a letter (number signs such as 2 in superscript are none), and for all if there is nothing to
learn from. Rows are predicted one by one: repeated rows give repeated results, null ids stay null. Texts of any length are labelled whole, long ones alone.
Of equally likely languages the first by name is taken. An empty table gives an empty result. Other columns, whatever they are called, are left out.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .words import mix, powers

SAMPLE = 60  # documents a language, about
CHAIN = 160  # words of a training chain
SLOTS = 1 << 16  # hashed features
BUCKET = 32  # words that are folded into one step along a text
MEMO = 200_000  # words whose features are kept
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Signs of numbers, which \w takes too but which are no letters.
NUMBER_SIGNS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
#: Runs of letters: of any text, and, some twenty times as fast, of one without number signs.
WORDS = re.compile(r"[^\W\d_%s]+" % "".join(sorted(NUMBER_SIGNS)))
PLAIN_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a whole text, in lower case."""
    low = text.lower()
    return (PLAIN_WORDS if low.isascii() or NUMBER_SIGNS.isdisjoint(low) else WORDS).findall(low)


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of several lower-case words end to end, and where each word's begin.

    All words are laid out as code points between marks, and each kind of feature is hashed for all of them at once.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words]) + 2
    ends = np.cumsum(lengths)
    first = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - first[word]
    owners, slots = [], []

    def add(kind: int, at: np.ndarray, size: int, of: np.ndarray) -> None:
        h = np.full(len(at), kind, dtype=np.uint64)
        for i in range(size):
            h = h * _STEP + codes[at + i]
        owners.append(of)
        slots.append((mix(h) % np.uint64(SLOTS)).astype(np.int64))

    for size in (2, 3):  # letter n-grams
        at = np.flatnonzero(place + size <= lengths[word])
        add(size, at, size, word[at])
    for size in (1, 2, 3, 4):  # affixes
        long = np.flatnonzero(lengths - 2 >= size)
        if size < 4:
            add(10 + size, first[long] + 1, size, long)
        add(20 + size, ends[long] - 1 - size, size, long)
    owners.append(np.arange(len(words)))  # the word itself
    slots.append((mix(np.add.reduceat(codes * powers(_STEP, int(lengths.max()))[0][place], first)) % np.uint64(SLOTS)).astype(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(owner[order], np.arange(len(words)))


class Crf:
    """Weights of features and transitions, and the lexicon."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels, self.weights, self.moves, self.start = labels, np.zeros((SLOTS, n)), np.zeros((n, n)), np.zeros(n)
        self.lexicon: dict[str, np.ndarray] = {}
        self.trust = 1.0

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word by its own features."""
        flat, starts = slots_of(words)
        out = np.add.reduceat(self.weights[flat], starts)
        for i, word in enumerate(words):
            known = self.lexicon.get(word)
            if known is not None:
                out[i] += self.trust * known
        return out

    def fit(self, chains: list[tuple[list[str], list[int]]], rounds: int = 8, rate: float = 0.1, decay: float = 1e-5) -> None:
        """Conditional likelihood by AdaGrad over batches of chains of one length."""
        n = len(self.labels)
        counts: dict[str, np.ndarray] = {}
        for words, marks in chains:
            for word, mark in zip(words, marks):
                counts.setdefault(word, np.zeros(n))[mark] += 1
        self.lexicon = {w: np.log((c + 0.5) / (c.sum() + 0.5 * n)) + np.log(n) for w, c in counts.items() if c.sum() > 2}
        vocabulary = {w: i for i, w in enumerate(counts)}
        flat, starts = slots_of(list(counts))
        sizes = np.diff(np.append(starts, len(flat)))
        known = np.array([self.lexicon.get(w, np.zeros(n)) for w in counts])
        length = max(len(w) for w, _ in chains)
        at = np.full((len(chains), length), -1)
        gold = np.zeros((len(chains), length), dtype=int)
        for i, (words, marks) in enumerate(chains):
            at[i, : len(words)] = [vocabulary[w] for w in words]
            gold[i, : len(words)] = marks
        seen_w, seen_m, seen_s = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8), np.full_like(self.start, 1e-8)
        order = np.random.default_rng(11)
        for _ in range(rounds):
            for batch in np.array_split(order.permutation(len(chains)), max(1, len(chains) // 64)):
                mine, marks = at[batch], gold[batch]
                real = mine >= 0
                used, place = np.unique(mine[real], return_inverse=True)
                ends = np.cumsum(sizes[used])
                first = ends - sizes[used]
                own = flat[np.arange(ends[-1]) + np.repeat(starts[used] - first, sizes[used])]  # the slots of the words in the batch
                emit = np.zeros((*mine.shape, n))
                emit[real] = (np.add.reduceat(self.weights[own], first) + self.trust * known[used])[place]
                g_emit, g_moves, g_start = _gradient(emit, real, marks, self.moves, self.start)
                touched, which = np.unique(own, return_inverse=True)
                for k in range(n):
                    word_g = np.bincount(place, g_emit[real][:, k], minlength=len(used))
                    g = np.bincount(which, np.repeat(word_g, sizes[used])) / len(batch) - decay * self.weights[touched, k]
                    seen_w[touched, k] += g * g
                    self.weights[touched, k] += rate * g / np.sqrt(seen_w[touched, k])
                for value, g, seen in ((self.moves, g_moves / len(batch), seen_m), (self.start, g_start / len(batch), seen_s)):
                    seen += g * g
                    value += rate * g / np.sqrt(seen)

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(label of word | its text) for texts laid end to end: ``lengths`` words each."""
        return forward_backward(emit, lengths, self.moves, self.start)


def _gradient(emit, real, gold, moves, start):
    """Observed minus expected counts of emissions, transitions and starts, over padded chains."""
    b, t, n = emit.shape
    step, first = np.exp(moves - moves.max()), np.exp(start - start.max())
    scores = np.exp(emit - emit.max(2, keepdims=True))
    alpha, beta = np.zeros((b, t, n)), np.ones((b, t, n)) / n
    alpha[:, 0] = first * scores[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ step) * scores[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (beta[:, i + 1] * scores[:, i + 1]) @ step.T
        beta[:, i] = np.where(real[:, i + 1, None], x / x.sum(1, keepdims=True), 1 / n)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    truth = np.eye(n)[gold]
    g_emit = (truth - gamma) * real[:, :, None]
    both = alpha[:, :-1, :, None] * step * (scores * beta)[:, 1:, None, :]
    both /= both.sum((2, 3), keepdims=True)
    linked = real[:, 1:, None, None]
    seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    return g_emit, ((seen - both) * linked).sum((0, 1)), (truth[:, 0] - gamma[:, 0]).sum(0)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Exact marginals, vectorised along the texts.

    Texts are cut into steps of BUCKET words, each folded into one matrix; messages pass from step to step
    in all texts at once, then within all steps at once. Padding is neutral: an identity matrix.
    """
    n = emit.shape[1]
    blocks = -(-lengths // BUCKET)
    total = int(blocks.sum())
    base = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(len(emit)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(base[:-1], lengths) + place // BUCKET
    col = place % BUCKET
    scores, real = np.ones((total, BUCKET, n)), np.zeros((total, BUCKET), dtype=bool)
    scores[row, col] = np.exp(emit - emit.max(1, keepdims=True))
    real[row, col] = True
    opens = np.zeros((total, BUCKET), dtype=bool)
    opens[base[:-1][lengths > 0], 0] = True
    step, first = np.exp(moves - moves.max()), np.exp(start - start.max())
    opens = opens[:, 0]  # the move into a text's first word comes from no word

    folded = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for i in range(BUCKET):
        x = (folded.reshape(-1, n) @ step).reshape(total, n, n)
        if i == 0:
            x[opens] = first
        x *= scores[:, i, None, :]
        x /= x.sum((1, 2), keepdims=True)
        done = ~real[:, i]
        x[done] = folded[done]
        folded = x
    ahead, behind = np.ones((total, n)) / n, np.ones((total, n)) / n  # messages into a step from before and from after it
    for k in range(1, int(blocks.max(initial=0))):
        here = base[:-1][blocks > k] + k
        m = np.einsum("bi,bij->bj", ahead[here - 1], folded[here - 1])
        ahead[here] = m / m.sum(1, keepdims=True)
        here = base[1:][blocks > k] - k
        m = np.einsum("bij,bj->bi", folded[here], behind[here])
        behind[here - 1] = m / m.sum(1, keepdims=True)
    alpha = np.zeros((total, BUCKET, n))
    a = ahead
    for i in range(BUCKET):
        x = a @ step
        if i == 0:
            x[opens] = first
        x *= scores[:, i]
        x /= x.sum(1, keepdims=True)
        a = alpha[:, i] = np.where(real[:, i, None], x, a)
    b, out = behind, np.zeros((total, BUCKET, n))
    for i in range(BUCKET - 1, -1, -1):
        out[:, i] = alpha[:, i] * b
        x = (scores[:, i] * b) @ step.T
        x /= x.sum(1, keepdims=True)
        b = np.where(real[:, i, None], x, b)
    out = out[row, col]
    return out / out.sum(1, keepdims=True)


def training_texts(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> list[tuple[str, int, list[str]]]:
    """(label, doc_id, words) of about ``sample`` whole documents a label, drawn by a hash of their ids."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(label) == name, min(1.0, sample / n)).otherwise(share)
    drawn = rows.where(draw < share).groupBy(F.col(label).alias("label"), "doc_id").agg(F.min("text").alias("text"))
    texts = sorted((r.label, r.doc_id, words_of(r.text)) for r in drawn.collect())  # the bounded sample
    return [t for t in texts if t[2]]


def spliced(texts: list[tuple[str, int, list[str]]], labels: list[str]) -> list[tuple[list[str], list[int]]]:
    """Chains for training: all words of the texts as they are, and as many chains spliced from stretches of several."""
    rng = np.random.default_rng(7)
    number = {name: i for i, name in enumerate(labels)}
    chains = []
    for name, _, words in texts:
        cuts = [words[at : at + CHAIN] for at in range(0, len(words), CHAIN)]
        chains += [(some, [number[name]] * len(some)) for some in cuts]
    by = {name: [w for n, _, w in texts if n == name] for name in labels}
    for _ in range(len(chains)):
        words: list[str] = []
        marks: list[int] = []
        while len(words) < 80:
            name = labels[rng.integers(len(labels))]
            source = by[name][rng.integers(len(by[name]))]
            size = int(rng.integers(4, 40))
            at = int(rng.integers(0, max(1, len(source) - size)))
            words += source[at : at + size]
            marks += [number[name]] * len(source[at : at + size])
        chains.append((words, marks))
    return chains


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Crf | None:
    """The model of the given labelled documents, or None if they teach nothing."""
    texts = training_texts(docs, label, sample)
    labels = sorted({name for name, _, _ in texts})
    if not labels:
        return None
    model = Crf(labels)
    model.fit(spliced(texts, labels))
    return model


class Reader:
    """A worker's side of the model: word features are computed once a distinct word."""

    def __init__(self, model: Crf):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.labels)))

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            first, last = len(known), len(known) + len(new)
            while last > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:last] = self.model.emissions(new)
            known.update(zip(new, range(first, last)))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def label_words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        if len(self.number) > MEMO:
            self.forget()
        lengths = np.array([len(t) for t in texts])
        numbers = self.numbers([w for t in texts for w in t])  # may enlarge the table
        emit = self.table[numbers]
        marginals = self.model.marginals(emit, lengths) if len(emit) else emit
        return np.split(marginals, np.cumsum(lengths)[:-1])


def predict(docs: DataFrame, model: Crf | None, together: int = 100_000) -> DataFrame:
    """doc_id, lang_pred, score of every row; ``together``: words whose chains are computed at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model) if model else None
        for batch in batches:
            texts = [words_of(t) if t else [] for t in batch["text"]]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = 0
            while reader and at < len(texts):
                end, words = at, 0
                while end < len(texts) and (end == at or words + len(texts[end]) <= together):
                    words += len(texts[end])
                    end += 1
                for i, marginal in enumerate(reader.label_words(texts[at:end]), at):
                    if len(marginal):
                        mean = marginal.mean(0)
                        names[i], scores[i] = reader.model.labels[int(mean.argmax())], float(min(1.0, mean.max()))
                at = end
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    in_small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id bigint, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
