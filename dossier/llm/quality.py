"""Quality classifier by co-training on two views of a document.

The content view is naive Bayes over letter n-grams: every three bytes in a row of the whole text, digits taken as
one, hashed into ``SLOTS`` counts, and over how much its words repeat (shares of words like the one before, of different words for
its length, and of its commonest word). A document's evidence is the mean log ratio of its trigrams, so long and short ones
weigh alike, and that of its repetitions. The metadata view is naive Bayes over what is known of the page without reading it: language, source, stored length,
the ratio of that to the text's, characters a word and characters a line. Both are sums over documents, so they are learned from all documents with partial aggregates: only sums
(SLOTS + STYLE + METADATA rows) come to the driver.

First both views learn from the labelled sample. Then, in each of ``ROUNDS`` rounds, every unlabelled
document of the corpus of which one view is sure teaches the other view (Blum and Mitchell), and both are made anew from
the labels and these pseudo-labels. After each round both are calibrated on labelled documents that neither
learns from. A view is sure of the documents that it ranks first in a class: beyond the odds that a share of that class reaches among those, ``SHARE`` of it in the first round and as much more in
each that follows, so either class is taught at its own rate; while it is right about them less often than ``SURE``, the share is halved, up to ``HALVED`` times. A round that changes no count ends the
loop. What each view has taught, and how often it was right, is kept in ``history``. Scores combine the calibrated log
odds of both views, weighed by a logistic regression on the same documents (the views aren't independent, so odds that are merely added up would count some evidence twice).

The labelled sample is bounded: about ``LABELLED`` labelled ids drawn by a hash of doc_id, never over twice as many; other labels count
as absent. Of several rows with a labelled id the smallest (text, then the other columns) teaches. All else, pseudo-labels and
scores, covers every document.

Null texts count as empty, other nulls as values of their own. Labels that are neither 0 nor 1 are left out, of several for
one document the lowest holds. Without labels of both classes, or with no documents, every score is 1. Rows are scored one by one,
repeated or not, whatever their length (a long text is read a megabyte at a time). Empty tables give empty results. Other columns
stay; those called quality_score, content_score or metadata_score are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, written
from .words import CHUNK, SPACES, hashed_words, stretches

LABELLED = 4000
ROUNDS = 3
SURE = 0.95  # how often a view must be right about the documents that it teaches the other
SHARE, HALVED = 0.1, 3  # of a class, taught in the first round; how often it may be halved
ACCEPT = 0.25  # documents with a lower probability of good quality are rejected
JOINT_RIDGE = 0.1
SLOTS, STYLE, METADATA = 1 << 15, 1024, 256
PARTS = (slice(0, SLOTS), slice(SLOTS, SLOTS + STYLE), slice(SLOTS + STYLE, SLOTS + STYLE + METADATA))
SMOOTH = 0.02  # added to each count; a document's trigrams count as 1 in total, as do its repetitions and its metadata
TOGETHER = 100  # texts looked at together
NAMES = ("quality_score", "content_score", "metadata_score")

_FOLDED = np.arange(256, dtype=np.int32)
_FOLDED[ord("0") : ord("9") + 1] = ord("0")


def trigrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, slot) of every three bytes in a row within a text, about CHUNK at a time."""
    for first, last in stretches(texts):
        lengths = [len(t) for t in texts[first:last]]
        raw = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        ends = np.cumsum(lengths)
        for at in range(0, len(raw) - 2, CHUNK):
            b = _FOLDED[raw[at : at + CHUNK + 2]]
            slot = (b[:-2] * 7919 + b[1:-1] * 263 + b[2:]) & (SLOTS - 1)
            owner = np.searchsorted(ends, np.arange(at, at + len(b)), side="right") + first
            inside = owner[:-2] == owner[2:]
            yield owner[:-2][inside], slot[inside]


def metadata_slots(lang, source, n_chars, size: int, words: int, lines: int) -> list[int]:
    stated = None if n_chars is None or pd.isna(n_chars) else max(0, int(n_chars))
    ratio = None if stated is None else max(-20, min(20, round(4 * float(np.log((1 + stated) / (1 + size))))))
    length = None if stated is None else int(2 * np.log2(1 + stated))
    word, line = min(80, 4 * size // max(1, words)), int(2 * np.log2(1 + size / lines))
    return [zlib.crc32(f"{i} {value}".encode()) % METADATA for i, value in enumerate((lang, source, length, ratio, word, line))]


def style_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(for each text, the slots of how much its words repeat: three numbers; how many words it has)."""
    words, bounds = hashed_words(texts, SPACES)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(texts)), sizes)
    again = np.bincount(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=len(texts))
    order = np.lexsort((words, text))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[1:] != text[:-1])
    different = np.bincount(text[new], minlength=len(texts))
    most = np.zeros(len(texts), dtype=np.int64)
    first = np.flatnonzero(new)
    np.maximum.at(most, text[first], np.diff(np.append(first, len(words))))
    n = np.maximum(1, sizes)
    length = np.minimum(15, np.log2(n).astype(int))
    return np.stack([20 * again // n, 64 + 32 * length + 20 * different // n, 600 + 20 * most // n], 1), sizes


class Batch:
    """Some documents: their texts as bytes, how many trigrams each has, and their metadata."""

    def __init__(self, rows: pd.DataFrame):
        texts = [t if isinstance(t, str) else "" for t in rows["text"]]
        self.texts = [b"\n" + t.encode("utf-8", "replace") + b"\n" for t in texts]
        self.sizes = np.array([max(1, len(t) - 2) for t in self.texts], dtype=float)
        self.style, words = style_slots(self.texts)
        known = zip(rows["lang"], rows["source"], rows["n_chars"], texts, words.tolist())
        self.metadata = np.array([metadata_slots(a, b, c, len(t), n, 1 + t.count("\n")) for a, b, c, t, n in known], dtype=np.int64).reshape(-1, 6)

    def evidence(self, ratios: list[np.ndarray]) -> np.ndarray:
        """Mean log ratio of each document by trigrams, repetitions and metadata, in three columns."""
        total = np.zeros(len(self.texts))
        for owner, slot in trigrams(self.texts):
            total += np.bincount(owner, ratios[0][slot], minlength=len(total))
        return np.stack([total / self.sizes, ratios[1][self.style].mean(1), ratios[2][self.metadata].mean(1)], 1)

    def counts(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Sums for both classes (columns bad, good) of the documents marked 0 or 1, by content and by metadata marks; nan: unmarked."""
        out = np.zeros((PARTS[-1].stop, 2))
        for y in (0, 1):
            weight = np.where(content == y, 1 / self.sizes, 0.0)
            if weight.any():
                for owner, slot in trigrams(self.texts):
                    out[:SLOTS, y] += np.bincount(slot, weight[owner], minlength=SLOTS)
            for part, slots, mark, size in zip(PARTS[1:], (self.style, self.metadata), (content, metadata), (STYLE, METADATA)):
                out[part, y] += np.bincount(slots[mark == y].ravel(), minlength=size) / slots.shape[1]
        return out


class Logistic:
    """Logistic regression on standardised columns, by Newton's method with a ridge."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._ready(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - penalty * w
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(h, g)
            w += np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-6:
                break
        self.w = w
        return self

    def _ready(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._ready(x) @ self.w, -30, 30)


def log_ratios(counts: np.ndarray) -> list[np.ndarray]:
    """Log of P(slot | good) by P(slot | bad), for trigrams, repetitions and metadata."""
    out = []
    for part in (counts[p] for p in PARTS):
        seen = part + SMOOTH * (part.sum(1, keepdims=True) > 0)  # slots that no document has tell nothing
        share = seen / np.maximum(seen.sum(0), 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(seen[:, 0] > 0, np.log(share[:, 1]) - np.log(share[:, 0]), 0.0))
    return out


def bounds(odds: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """(odds up to which a view is sure of bad, odds from which it is sure of good, how often it is right there); infinite if it is never right often enough."""
    for part in (share / 2**i for i in range(HALVED + 1)):
        low, high = float(np.quantile(odds[y == 0], part)), float(np.quantile(odds[y == 1], 1 - part))
        right = float(min((y[odds <= low] == 0).mean(), (y[odds >= high] == 1).mean()))
        if low < high and right >= SURE:
            return low, high, right
    return -np.inf, np.inf, 0.0


class CoTrained:
    """Two calibrated views and their combination."""

    COLUMNS = ([0, 1], [2])  # of the evidence, by view

    def __init__(self, ratios: list[np.ndarray], evidence: np.ndarray, y: np.ndarray, share: float):
        """From rows with known classes that the views have not learned from; ``share`` of each class is to be taught next."""
        self.history: list[tuple[float, ...]] = []  # a round each: documents that content taught and that metadata taught, how often each view was right
        self.ratios = ratios
        self.calibrated = [Logistic().fit(evidence[:, at], y) for at in self.COLUMNS]
        views = [c.odds(evidence[:, at]) for c, at in zip(self.calibrated, self.COLUMNS)]
        self.joint = Logistic().fit(np.stack(views, 1), y, JOINT_RIDGE)
        self.bounds = [bounds(v, y, share) for v in views]

    def odds(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.evidence(self.ratios)
        return tuple(c.odds(x[:, at]) for c, at in zip(self.calibrated, self.COLUMNS))

    def scores(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: both views together, content alone, metadata alone."""
        a, b = self.odds(batch)
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (self.joint.odds(np.stack([a, b], 1)), a, b))

    def taught(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Pseudo-labels (nan: none) for content, of which metadata is sure, and for metadata, of which content is sure."""
        a, b = (np.where(o >= high, 1.0, np.where(o <= low, 0.0, np.nan)) for o, (low, high, _) in zip(self.odds(batch), self.bounds))
        return b, a


def _some_at_a_time(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            yield batch.iloc[at : at + TOGETHER]


def _sums(rows: DataFrame, marks: Callable[[pd.DataFrame, Batch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sums over all rows with the marks that they are given; added up in the tasks, then by slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((PARTS[-1].stop, 2))
        for some in _some_at_a_time(batches):
            batch = Batch(some)
            total += batch.counts(*marks(some, batch))
        at = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"slot": at, "bad": total[at, 0], "good": total[at, 1]})

    sums = rows.mapInPandas(run, "slot int, bad double, good double").groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    out = np.zeros((PARTS[-1].stop, 2))
    got = sums.toPandas()  # so many rows at most
    out[got["slot"].to_numpy(int)] = got[["bad", "good"]].to_numpy(float)
    return out


def _calibrated(sample: DataFrame, counts: np.ndarray, share: float) -> CoTrained | None:
    """The views of these sums, calibrated on the sample's rows of fold 0; None if those lack a class."""
    ratios = log_ratios(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some_at_a_time(batches):
            x = Batch(some).evidence(ratios)
            yield pd.DataFrame({"doc_id": some["doc_id"], "y": some["y"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    got = sample.where("fold = 0").mapInPandas(run, "doc_id bigint, y int, a double, b double, c double").toPandas().sort_values("doc_id")  # a part of the bounded sample
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    return CoTrained(ratios, got[["a", "b", "c"]].to_numpy(float), y, share)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-trains on all of ``docs`` (doc_id, text, lang, source, n_chars) and a bounded sample of ``labels`` (doc_id, quality)."""
    in_small_batches(docs.sparkSession)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    n_marks = marks.count()
    if not n_marks:
        return None
    drawn = marks.where(draw < F.lit(int(1_000_003 * min(1.0, labelled / n_marks)))).orderBy(draw, "doc_id").limit(2 * labelled)  # bounded, so it is broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    one = F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")
    sample = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(one)
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("fold")
    sample = written(sample.select("doc_id", "y", "d.*", fold), "labelled")

    known = lambda some, batch: (some["y"].to_numpy(float),) * 2
    base = _sums(sample.where("fold <> 0").select("y", "text", "lang", "source", "n_chars"), known)
    if not base.any(0).all():
        return None
    model = _calibrated(sample, base, SHARE)
    unlabelled = rows.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_anti").select("text", "lang", "source", "n_chars")
    before = None
    for i in range(rounds if model else 0):
        taught = _sums(unlabelled, lambda some, batch, now=model: now.taught(batch))
        if before is not None and np.allclose(taught, before, rtol=1e-9, atol=1e-12):
            break
        to_content, to_metadata = (round(float(taught[p].sum())) for p in PARTS[1:])  # each document counts as 1
        history = [*model.history, (to_metadata, to_content, *(b[2] for b in model.bounds))]
        model, before = _calibrated(sample, base + taught, SHARE * (i + 2)), taught
        model.history = history
    return model


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with quality_score, content_score and metadata_score (probabilities of good quality)."""
    in_small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in NAMES]
    docs = docs.select(*rest)
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in NAMES})

    @F.pandas_udf("quality_score double, content_score double, metadata_score double")
    def scored(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        batch = pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars})
        parts = [np.stack(model.scores(Batch(some)), 1) for some in _some_at_a_time(iter([batch]))]
        return pd.DataFrame(np.concatenate([*parts, np.zeros((0, 3))]), columns=list(NAMES))

    got = scored("text", "lang", "source", F.col("n_chars").cast("bigint"))
    return docs.select(*rest, got.alias("_scores")).select(*rest, *[F.col(f"_scores.{n}").alias(n) for n in NAMES])
