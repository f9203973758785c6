"""Hashes of words and of word windows, for many texts at once, in numpy.

A word is a run of bytes of UTF-8 that are no separators. Its hash is a polynomial over its bytes,
a window's one over its words' hashes, both modulo 2**64 and mixed. Equal sequences have equal hashes
everywhere; different ones collide as random 64-bit numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18  # bytes hashed at a time

#: Separators: ASCII white space; or all of ASCII but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_BYTES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        one = np.ones(1, dtype=np.uint64)
        have = tuple(np.concatenate([one, np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (base, inverse))
        if size <= 2 * CHUNK:
            _powers[int(base)] = have
    return have


def _words(raw: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of one stretch."""
    inside = ~separators[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    up, down = powers(_P, len(raw))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)])])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def hashed_words(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and after the last)."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], []
    for first, last in stretches(texts):
        if last - first == 1 and len(texts[first]) > CHUNK:
            own = [_words(np.frombuffer(part, dtype=np.uint8), separators)[2] for part in _parts(texts[first], separators)]
            hashes += own
            counts.append(sum(map(len, own)))
            continue
        raw = np.frombuffer(b"\n".join(texts[first:last]) + b"\n", dtype=np.uint8)
        start, _, h = _words(raw, separators)
        hashes.append(h)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        counts += np.diff(np.searchsorted(start, bounds)).tolist()
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def stretches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about CHUNK bytes together; a longer one alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _parts(text: bytes, separators: np.ndarray) -> Iterator[bytes]:
    """A long text, cut at separators."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not separators[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of ``size`` words that starts at each word (of all texts laid end to end)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(_Q, len(words))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)])])
    return mix((total[size:] - total[:n]) * down[:n] + np.uint64(size))


def starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, text) of all windows of ``size`` words that lie within one text."""
    count = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][text]
    return position, text
