"""Best-fit packing of token pieces by large-item matching.

A piece longer than a third of the capacity is large: no three large ones share a sequence. Large
pieces are matched greedily, longest first, each with the longest that still fits beside it. What
is left fills the gaps, longest first, each into the smallest gap that holds it; what fits no gap
opens a sequence.

There are no more different lengths than the capacity, so all this needs only the number of pieces
of each length. The driver plans with that histogram (at most ``capacity`` rows whatever the
corpus) and the plan says: of length l, the pieces with ranks from r on go to sequences from s on,
at offset o. Its size depends on the capacity alone. Ranks are counted on the executors, within
buckets of each length, dealt by a number that each piece got when it was written: neither a length nor an id that holds
a third of all pieces is a hot key.

Null texts count as empty (a document of one token, the end mark). Repeated rows and rows with a
null id are pieces like any other. Texts of any length are coded whole. Which of equally long pieces goes where is open. An empty table gives an
empty result. Other columns of documents, whatever they are called, are left out; those of pieces stay.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import coder
from .common import in_small_batches, written

LONG = 200_000  # characters that the compiled encoder gets at a time
CUT = re.compile(r"(?<=\S) (?=\S)")
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Tokenizer:
    """The vocabulary as a compiled encoder; strings of its special tokens count as such.

    Long texts are cut where the pattern begins a new piece in any case: before a single space between two other characters. The compiled encoder gives up on
    a million characters of white space, so a stretch without a cut for more than LONG characters goes to the coder of ``bpe``, which takes any length.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.any_length = lambda: coder(ranks_path, pattern)

    def stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > LONG:
            cut = CUT.search(text, start + LONG // 2)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for part in self.stretches(text):
            if len(part) <= LONG:
                parts.append(np.array(self.fast.encode(part, allowed_special="all"), dtype="<u4"))
                continue
            for piece in re.split("(" + "|".join(map(re.escape, self.special)) + ")", part) if self.special else [part]:
                ids = np.array([self.special[piece]], dtype="<u4") if piece in self.special else np.frombuffer(self.any_length().encode_bytes(piece), dtype="<u4")
                parts.append(ids)
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, json_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(ranks_path, json_path, pattern)


def token_pieces(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Each document's ids and the end mark; longer ones cut, so that only the first piece is short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(ranks_path, json_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode.encode(text or ""), np.array([end_id], dtype="<u4"))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    in_small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, PIECE)


class Plan:
    """Runs of pieces and where they go, made from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, first sequence, offset)
        self.used: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        self.sizes: list[int] = []  # the gaps there are, ascending
        left = {length: n for length, n in counts.items() if n > 0}
        large = [length for length in sorted(left, reverse=True) if 3 * length > capacity]
        self.match(large, left)
        for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
            self.fill(length, left[length])

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.setdefault(length, []).append((rank, sequence, offset))
        self.used[length] = rank + n

    def leave(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.sizes, gap)
            self.gaps[gap].append((sequence, n))

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def match(self, large: list[int], left: dict[int, int]) -> None:
        for a in large:
            while left[a]:
                fits = (b for b in large if b <= self.capacity - a and left[b] > (b == a))
                b = next(fits, None)
                if b is None:
                    n, rest = left[a], self.capacity - a
                else:
                    n, rest = (left[a] // 2 if a == b else min(left[a], left[b])), self.capacity - a - b
                at = self.open(n)
                self.place(a, n, at, 0)
                left[a] -= n
                if b is not None:
                    self.place(b, n, at, a)
                    left[b] -= n
                self.leave(rest, at, n)

    def fill(self, length: int, n: int) -> None:
        while n:
            gap = next((g for g in self.sizes if g >= length), None)
            if gap is None:
                each = self.capacity // length
                gap, runs = self.capacity, [(self.open(-(-n // each)), -(-n // each))]
            else:
                runs = self.gaps.pop(gap)
                self.sizes.remove(gap)
            each = gap // length
            for sequence, there in runs:
                full = min(there, n // each)
                for slot in range(each if full else 0):
                    self.place(length, full, sequence, self.capacity - gap + slot * length)
                self.leave(gap - each * length, sequence, full)
                n -= full * each
                some = 0
                if n and full < there:  # fewer than fill one more sequence
                    some, n = n, 0
                    for slot in range(some):
                        self.place(length, 1, sequence + full, self.capacity - gap + slot * length)
                    self.leave(gap - some * length, sequence + full, 1)
                untouched = there - full - bool(some)
                self.leave(gap, sequence + there - untouched, untouched)

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(runs, dtype=np.int64).reshape(-1, 3) for length, runs in self.runs.items()}


def _assign(plan: dict[int, np.ndarray], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            offset = np.zeros(len(batch), dtype=np.int64)
            ranks, lengths = batch["_rank"].to_numpy(), batch["length"].to_numpy()
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, sequences, offsets = plan[int(length)].T
                at = np.searchsorted(first, ranks[here], side="right") - 1
                sequence[here] = sequences[at] + ranks[here] - first[at]
                offset[here] = offsets[at]
            yield batch[columns].assign(sequence_id=sequence, offset=offset)

    return run


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = 50_000) -> DataFrame:
    """A sequence and an offset for each piece: its columns plus sequence_id and offset (which replace columns of those names).

    ``pieces``: doc_id, piece, length (1 to ``capacity``) and any other columns; written first, so that they read the same each time.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = {c: c if c == "length" else f"_c{i}" for i, c in enumerate(columns)}  # names that meet no others
    kept = pieces.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()])
    numbered = written(kept.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {int(length): n for length, n in numbered.groupBy("length").count().collect()}  # at most ``capacity`` rows
    buckets = max(64, sum(counts.values()) // bucket_rows)
    plan = Plan(counts, capacity).arrays()
    dealt = numbered.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = W.partitionBy("length", "_bucket").orderBy("_row")
    ranked = dealt.withColumn("_place", F.row_number().over(within) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place")).drop("_row", "_bucket", "_before", "_place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id bigint, offset bigint"
    out = ranked.mapInPandas(_assign(plan, list(inner.values())), schema)
    return out.select(*[F.col(name).alias(c) for c, name in inner.items()], "sequence_id", "offset")


def pack_documents(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = 1024) -> DataFrame:
    """Tokenizes once, writes the pieces' lengths (not the texts) and packs them."""
    return pack(token_pieces(docs, ranks_path, json_path, pattern, capacity), capacity)
