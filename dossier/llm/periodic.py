"""Stretches of words that repeat themselves: every run with its smallest period, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_LENGTH, MIN_EXPONENT * q) words that no
neighbouring word extends. Runs are found with a dictionary of basic factors: every stretch of 2**k words gets a name,
made of the names of its two halves. Two successive occurrences of a name at a gap of at most 2**k words (both lie within 2**(k+1)) are terms of an
arithmetic progression, and so is the gap of the next start, as long as the words go on repeating. A streak of starts with one gap d,
2**(k-1) < d <= 2**k, therefore proposes the period d for the words from its first start to its last start's second occurrence; as the nearest occurrence
is d away, no smaller period fits. The proposed stretch is extended to both sides word by word of the period, and what several streaks have found counts once.
Since a run has four periods or more and 2**k < 2 * d, each run has a streak at exactly one level. Levels end when no name is met twice within reach.

Each text is judged whole, in one task; texts of a batch are laid end to end, up to ``WORDS`` words, and no factor crosses from one into the next. Memory follows
the longest text.

Null and empty texts, and texts of separators alone, have no words and no runs; their collapsed text is the empty one (null for null). Repeated rows are judged one by one;
nothing depends on other rows, so there are no ties. Empty tables give empty results. Other columns stay, but for those that have the names of the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
WORDS = 1 << 17  # words of several texts that are looked at together
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
RESULT = ("n_words", "runs", "collapsed")


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each key, distance to the next place with the same key or 0)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    names, gaps = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    names[order[1:]] = np.cumsum(~same)
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return names, gaps


def _extended(words: np.ndarray, first: int, last: int, period: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch around words first to last (excluded) of the text from begin to end that keeps the period."""
    while first > begin and words[first - 1] == words[first - 1 + period]:
        first -= 1
    while last < end and words[last] == words[last - period]:
        last += 1
    return first, last


def runs_in(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order, of texts laid end to end.

    ``words``: a number for each word; ``bounds``: where each text begins, and the end of the last. ``min_exponent`` must be
    3 at least, as a run needs room for one factor and its next occurrence.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    found: set[tuple[int, int, int, int]] = set()
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place, size, keys = np.arange(len(words)), 1, words
    while len(place):
        names, gaps = _named(keys)
        reach = np.minimum(np.arange(len(place)) + gaps, len(place) - 1)
        gaps[(text[reach] != text) | (gaps * min_exponent > np.diff(bounds)[text])] = 0  # the next one lies in another text, or too far off for any run
        streak = np.where((gaps <= size) & (gaps * 2 > size), gaps, 0)
        edges = np.flatnonzero((np.diff(streak) != 0) | (np.diff(text) != 0)) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(streak)]])
        period = streak[first]
        proposed = (period > 0) & (last - first - 1 + period + size >= np.maximum(min_length, min_exponent * period))
        for i, j, d in zip(place[first[proposed]].tolist(), place[last[proposed] - 1].tolist(), period[proposed].tolist(), strict=True):
            t = int(np.searchsorted(bounds, i, side="right")) - 1
            start, end = _extended(words, i, j + d + size, d, int(bounds[t]), int(bounds[t + 1]))
            found.add((t, start - int(bounds[t]), end - start, d))
        # only texts in which a factor is met again go on, with factors of twice the length
        going = np.zeros(len(bounds) - 1, dtype=bool)
        going[text[gaps > 0]] = True
        going &= (size + 1) * min_exponent <= np.diff(bounds)
        names, place, text = names[going[text]], place[going[text]], text[going[text]]
        left = np.flatnonzero(place + 2 * size <= bounds[1:][text])
        keys = names[left] * (names.max(initial=0) + 1) + names[left + size]
        place, text, size = place[left], text[left], 2 * size
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), dtype=np.int64).reshape(-1, 4)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of words before each text and after the last). Words are what ASCII white space separates."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(words, "")
    row = np.repeat(np.arange(len(lengths)), lengths)[filled.to_numpy(zero_copy_only=False)]
    return words.filter(filled), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lengths)))]).astype(np.int64)


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about WORDS words together."""
    first = 0
    for i in range(1, len(bounds)):
        if i == len(bounds) - 1 or bounds[i + 1] - bounds[first] > WORDS:
            yield first, i
            first = i


def _judged(texts: pa.Array, min_length: int, min_exponent: int) -> list[pa.Array]:
    """Number of words, runs, and collapsed text of each text."""
    words, bounds = _split(texts)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept, runs = np.ones(len(words), dtype=bool), [np.zeros((0, 4), dtype=np.int64)]
    for first, last in _groups(bounds):
        own = runs_in(numbers[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], min_length, min_exponent)
        own[:, 0] += first
        for text, start, length, period in own.tolist():
            kept[bounds[text] + start + period : bounds[text] + start + length] = False
        runs.append(own)
    found = np.concatenate(runs)
    per_text = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=len(texts)))])
    listed = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in found[:, 1:].T.copy()], names=["start", "length", "period"]))
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
    return [pa.array(np.diff(bounds), pa.int64()), listed, pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), collapsed)]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with n_words bigint, runs (by start, then period; start is a word's number from 0) and collapsed string.

    ``collapsed``: the words that no run contains after its first period, joined by single spaces.
    """
    own = [c for c in docs.columns if c.lower() not in RESULT]
    # all columns travel in a struct, so that no name can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    schema = T.StructType([packed.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, pc.struct_field(batch.column("row"), "text")):
                rows = part.column("row")
                yield pa.RecordBatch.from_arrays([rows, *_judged(pc.struct_field(rows, "text"), min_length, min_exponent)], names=["row", *RESULT])

    found = packed.mapInArrow(judged, schema)
    return found.select(*(F.col("row").getField(c).alias(c) for c in own), *RESULT)
