"""Removal of repeated passages by level-wise doubling.

A passage of 13 words can only repeat if its windows of 7 do. So windows of FIRST words or fewer are looked at first, and only
where they repeat at twice that length (less overlap), and so on, until the wanted length is reached
or no candidate survives: for 13 words the lengths are 7 and 13, for 50 they are 7, 13, 25 and 50. Not even all windows of a level
are sent: of those inside a window of the next length, the one with the smallest hash
stands for it, which is the same choice in every document, so nothing is missed and a quarter of the windows travel. At the
wanted length a second hash, of other values of the words, is sent along: 128 bits must agree for two passages to be the same.

Documents are dealt into blocks by a hash of doc_id and text, so many that a block holds some MB. A block sends each different hash once, marked
if several of its documents hold it, packed by hash range; a range answers each block with one bit a
hash: whether it repeats or, at the last level, whether a document of a smaller id elsewhere has it. A passage
that stands in a third of all documents is thus one entry a block, texts are shuffled once, and no task holds
more than a block's texts or a range's hashes. Blocks and ranges grow in number with the corpus.

Words are runs of anything but ASCII white space. Null texts have no words. Rows with a null doc_id neither lose words
nor take them from others; rows that repeat a doc_id are the same document, so none is earlier. A long text is one row of its block, hashed in parts.
An empty table gives an empty result. Other columns stay, whatever they are called, but for n_words, n_removed and kept_sha256, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .words import SPACES, hashed_words, mix, starts, windows

FIRST = 7  # words of the first windows, at most
RANGE_HASHES = 1_000_000  # hashes that a range is meant to hold
BLOCK_LEAST, BLOCK_DOCS, BLOCK_CHARS = 128, 4096, 8_000_000  # documents of a block, about, and characters
PACKED = "part int, block int, level int, hashes binary, docs binary"
BITS = "block int, part int, level int, bits binary"
OWN = "_block_of_passages"
Told = list[dict[int, np.ndarray]]  # for each level, the bits of each range


def lengths(wanted: int) -> list[int]:
    """The windows' lengths, ascending, each at most twice the one before."""
    out = [wanted]
    while out[0] > FIRST or (len(out) == 1 and wanted > 1):
        out.insert(0, -(-out[0] // 2))
    return out


class Block:
    """The texts of a block: their words' hashes, and what each level asks and is told."""

    def __init__(self, rows: pd.DataFrame, sizes: list[int], parts: int):
        self.rows, self.sizes, self.parts = rows, sizes, parts
        self.texts = [t.encode("utf-8", "replace") if t else b"" for t in rows["text"]]
        self.words, self.bounds = hashed_words(self.texts, SPACES)
        ids = rows["doc_id"]
        self.known = ids.notna().to_numpy()
        self.ids = ids.fillna(0).to_numpy(dtype=np.int64)

    def windows_left(self, k: int, told: Told) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of the windows of the k-th length that may repeat by what shorter ones were told."""
        at, text = starts(self.bounds, self.sizes[k])
        fine = self.known[text]
        if k > 1:  # all windows inside it repeat
            alive = np.zeros(len(self.words) + 1, dtype=np.int64)
            alive[self.repeating(k - 1, told)[0] + 1] = 1
            before = np.cumsum(alive)
            last = at + self.sizes[k] - self.sizes[k - 1] + 1
            fine &= before[last] - before[at] == last - at
        return at[fine], text[fine]

    def standing(self, k: int, at: np.ndarray) -> np.ndarray:
        """Of the windows of the k-th length inside each window of the next one, the smallest hash."""
        inside = windows(self.words, self.sizes[k])
        out = inside[at].copy()
        for i in range(1, self.sizes[k + 1] - self.sizes[k] + 1):
            np.minimum(out, inside[at + i], out=out)
        return out

    def asked(self, k: int, told: Told) -> tuple[np.ndarray, np.ndarray]:
        """Different standing hashes of the k-th length, and which of them several documents here have."""
        at, text = self.windows_left(k + 1, told)
        hashes = self.standing(k, at)
        order = np.lexsort((self.ids[text], hashes))
        h, d = hashes[order], self.ids[text][order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = np.zeros(len(first), bool)
        several[group[d != d[first][group]]] = True
        return h[new], several

    def repeating(self, k: int, told: Told) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of the windows of the k-th length whose standing window repeats."""
        at, text = self.windows_left(k, told)
        asked, _ = self.asked(k - 1, told)
        found = np.isin(self.standing(k - 1, at), asked[self.answers(asked, told[k - 1])])
        return at[found], text[found]

    def last_asked(self, told: Told) -> tuple[np.ndarray, ...]:
        """Places and documents of the candidates, their different double hashes with the smallest doc_id here, and each one's number among these."""
        at, text = self.repeating(len(self.sizes) - 1, told) if len(self.sizes) > 1 else self.windows_left(0, told)
        one, two = (windows(w, self.sizes[-1]) for w in (self.words, mix(self.words + np.uint64(0x5851F42D4C957F2D))))
        hashes = np.stack([one[at], two[at]], 1)
        different, number = np.unique(hashes, axis=0, return_inverse=True) if len(at) else (hashes, np.zeros(0, np.int64))
        least = np.full(len(different), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids[text])
        return at, self.ids[text], different, least, number

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.reshape(len(hashes), -1)[:, 0] >> np.uint64(32)).astype(np.int64) % self.parts

    def answers(self, hashes: np.ndarray, bits: dict[int, np.ndarray]) -> np.ndarray:
        """The bits told for hashes that were sent in this order."""
        out = np.zeros(len(hashes), bool)
        part = self.part_of(hashes)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for some in np.split(order, cuts):
            if len(some) and int(part[some[0]]) in bits:
                out[some] = np.unpackbits(bits[int(part[some[0]])], count=len(some)).astype(bool)
        return out

    def pack(self, block: int, level: int, hashes: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
        part = self.part_of(hashes)
        order = np.argsort(part, kind="stable")
        rows = [
            (int(part[some[0]]), block, level, hashes[some].tobytes(), docs[some].tobytes())
            for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            if len(some)
        ]
        return pd.DataFrame(rows, columns=["part", "block", "level", "hashes", "docs"])

    def removed(self, told: Told) -> np.ndarray:
        """Which words a window covers that also starts in a document of smaller id."""
        at, ids, different, least, number = self.last_asked(told)
        elsewhere = self.answers(different, told[-1])
        hit = at[elsewhere[number] | (ids > least[number])]
        edge = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.sizes[-1], -1)
        return np.cumsum(edge)[:-1] > 0


def _told(rows: pd.DataFrame, levels: int) -> Told:
    out: Told = [{} for _ in range(levels)]
    for level, part, bits in zip(rows["level"], rows["part"], rows["bits"]):
        out[int(level)][int(part)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _ask(sizes: list[int], parts: int, k: int) -> Callable:
    """What blocks ask about the k-th length, by what they were told about shorter ones."""

    def run(rows: pd.DataFrame, told: pd.DataFrame | None = None) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["part", "block", "level", "hashes", "docs"])
        block = Block(rows, sizes, parts)
        known = [] if told is None else _told(told, k)
        if k < len(sizes) - 1:
            hashes, several = block.asked(k, known)
            return block.pack(int(rows[OWN].iloc[0]), k, hashes, several.astype(np.uint8))
        _, _, hashes, least, _ = block.last_asked(known)
        return block.pack(int(rows[OWN].iloc[0]), k, hashes, least)

    return run


def _ask_first(sizes: list[int], parts: int) -> Callable:
    ask = _ask(sizes, parts, 0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return ask(rows)

    return run


def _answer(last: int) -> Callable:
    """For all blocks that ask about a range: a bit for each hash, in the order sent."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        final = rows["level"].iloc[0] == last
        hashes = [np.frombuffer(b, dtype=np.uint64).reshape(-1, 2 if final else 1) for b in rows["hashes"]]
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.lexsort(flat.T)
        new = np.concatenate([[True], (flat[order][1:] != flat[order][:-1]).any(1)])
        group = np.empty(len(flat), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        if final:  # a smaller document elsewhere
            docs = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in rows["docs"]])
            bit = np.minimum.reduceat(docs[order], np.flatnonzero(new))[group] < docs
        else:  # repeated: sent by two blocks, or held by several documents of one
            times = 1 + np.concatenate([np.frombuffer(b, dtype=np.uint8) for b in rows["docs"]]).astype(np.int64)
            bit = np.bincount(group, times)[group] >= 2
        bits = [np.packbits(b).tobytes() for b in np.split(bit, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "level": rows["level"], "bits": bits})

    return run


def _apply(sizes: list[int], parts: int, columns: list[str], rewrite: bool) -> Callable:
    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = [*columns, "n_words", "n_removed", "kept_sha256"]
        if rows.empty:
            return pd.DataFrame(columns=names)
        block = Block(rows, sizes, parts)
        gone = block.removed(_told(told, len(sizes)))
        n_words, n_removed, digests, texts = [], [], [], []
        for i, (text, old) in enumerate(zip(block.texts, rows["text"])):
            mine = gone[block.bounds[i] : block.bounds[i + 1]]
            words = text.split()  # of bytes: at ASCII white space
            lost = int(mine.sum())
            if lost:
                words = [w for w, g in zip(words, mine.tolist()) if not g]
            kept = b" ".join(words)
            n_words.append(len(mine))
            n_removed.append(lost)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8") if lost else old)
        out = rows.assign(n_words=n_words, n_removed=n_removed, kept_sha256=digests)
        return (out.assign(text=texts) if rewrite else out)[names]

    return run


def dedup_passages(docs: DataFrame, length: int = 13, rewrite: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the words of passages seen in a smaller doc_id.

    Adds n_words, n_removed and kept_sha256 (the kept words, joined by one space). With ``rewrite``, texts that lost
    words are what is left, joined by one space; other texts stay as they are.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    count, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(count // BLOCK_LEAST, 8 * shuffled), count // BLOCK_DOCS, (chars or 0) // BLOCK_CHARS)
    parts = max(64, (chars or 0) // 24 // RANGE_HASHES)  # a word has six letters, and one in four windows travels
    inner = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(rest)}  # names that meet no others
    dealt = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()]).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # by text too: rows with a null or the same doc_id spread
    dealt = dealt.withColumn(OWN, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(OWN)

    by_block = dealt.groupBy(OWN)
    sizes = lengths(length)
    told = None
    for k in range(len(sizes)):
        if told is None:
            asked = by_block.applyInPandas(_ask_first(sizes, parts), PACKED)
        else:
            asked = by_block.cogroup(told.groupBy("block")).applyInPandas(_ask(sizes, parts, k), PACKED)
        answers = asked.groupBy("part").applyInPandas(_answer(len(sizes) - 1), BITS)
        told = answers if told is None else told.unionAll(answers)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != OWN]
    schema = ", ".join([*fields, "n_words bigint", "n_removed bigint", "kept_sha256 string"])
    out = by_block.cogroup(told.groupBy("block")).applyInPandas(_apply(sizes, parts, list(inner.values()), rewrite), schema)
    return out.select(*[F.col(name).alias(c) for c, name in inner.items()], "n_words", "n_removed", "kept_sha256")
