"""Byte-level BPE by longest matches and backtracking.

A piece of text (one match of the pre-tokenizer's pattern) is mapped byte by byte to Latin-1, so
that an Aho-Corasick automaton over the vocabulary finds, in one pass, the longest token that
starts at each byte. Encoding goes from left to right with the longest token. Two neighbours
are compatible if merging their joint bytes by rank gives back just these two; that answer is
memoised. Where nothing compatible is left, the last token is taken back and replaced by its
next shorter prefix. A byte position that once proved hopeless stays so (the tokens before a
position are the same whichever way it is reached), hence the time is linear in the piece.

Null texts count as empty; an empty text has no ids. Any length is taken: long texts are cut
where the pattern has a boundary in any case, so memory follows the segment and not the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

SEGMENT = 1_000_000  # characters that are split into pieces at a time
MEMO_PIECES = 400_000  # distinct pieces kept, then forgotten: bounds a worker's memory
MEMO_PAIRS = 1_000_000
MEMO_LENGTH = 48  # longer pieces hardly ever return


class BytePairCoder:
    """Encoder and decoder for one vocabulary file of ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        import ahocorasick
        import regex

        with open(ranks_path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.rank.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self.find = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.pieces_of = regex.compile(pattern).findall
        self.safe_cut = regex.compile(r"(?<=\S) (?=\S)")
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._lengths = np.array(self.sizes, dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])
        self._bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging by rank: the definition, used on two neighbours at a time."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in what merging makes of their bytes."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token too, or -1."""
        known = self._shorter.get(token)
        if known is None:
            raw = self.tokens[token]
            known = next((self.rank[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.rank), -1)
            self._shorter[token] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        whole = self.rank.get(raw)
        if whole is not None:
            return [whole]
        sizes, n = self.sizes, len(raw)
        longest = [-1] * n
        for end, token in self.find.iter(raw.decode("latin-1")):
            start = end + 1 - sizes[token]
            if longest[start] < 0 or sizes[longest[start]] < sizes[token]:
                longest[start] = token
        out: list[int] = []
        hopeless = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            if token < 0:  # nothing fits here: take back what led here
                hopeless[at] = 1
                token = out.pop()
                at -= sizes[token]
                token = self.shorter(token)
                continue
            end = at + sizes[token]
            if not hopeless[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[end] if end < n else -1
            else:
                token = self.shorter(token)
        return out

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts, cut only before a single space between two other characters."""
        start = 0
        while len(text) - start > SEGMENT:
            cut = self.safe_cut.search(text, start + SEGMENT)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, out = self._memo, []
        for segment in self.segments(text):
            for piece in self.pieces_of(segment):
                ids = memo.get(piece)
                if ids is None:
                    ids = np.array(self.encode_piece(piece), dtype="<u4").tobytes()
                    if len(piece) <= MEMO_LENGTH:
                        if len(memo) >= MEMO_PIECES:
                            memo.clear()
                        memo[piece] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of the ids, in parts."""
        for first in range(0, len(ids), SEGMENT // 4):
            part = ids[first : first + SEGMENT // 4].astype(np.int64)
            lengths = self._lengths[part]
            ends = np.cumsum(lengths)
            where = np.arange(ends[-1]) + np.repeat(self._starts[part] - (ends - lengths), lengths)
            yield self._bytes[where].tobytes()


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> BytePairCoder:
    """One coder a worker process and vocabulary: its memo lasts over batches and tasks."""
    return BytePairCoder(ranks_path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and the digest of what they decode to.

    Returns per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids``
    the ids themselves. Rows with a null id or repeated rows are kept as they are. A map without
    a shuffle: the work of a task is what its input split holds.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                packed = code.encode_bytes(text or "")
                ids = np.frombuffer(packed, dtype="<u4")
                decoded = hashlib.sha256()
                for part in code.decode(ids):
                    decoded.update(part)
                row = (len(ids), hashlib.sha256(packed).hexdigest(), decoded.hexdigest())
                rows.append((*row, ids.astype(np.int64)) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    in_small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, schema)
