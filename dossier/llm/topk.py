"""Exact search for the largest inner products.

Candidates are range-partitioned by descending length into parts of about ``HELD_BYTES`` as they are held in a task, so fewer of wider vectors; the
parts' numbers and longest vectors are read off the written table, so however many parts Spark makes, all are
searched. A first pass over the ``HEAD`` longest vectors gives each query the score that it has to
beat; after that

* a query is sent only to the parts whose longest vector can reach that score (|q| * longest, Cauchy-Schwarz),
* within a part, vectors are met by descending length in blocks, and a block goes if its longest can't reach the
  score to beat, which rises as better ones are found,
* a pair goes when the partial sum over the leading axes plus |q's rest| * |x's rest| (Cauchy-Schwarz again) can't reach it; the axes are
  the right singular vectors of the whole table, so the leading ones carry most of each product,
* what is left is multiplied exactly, in integers.

The bounds only ever discard what can't be among the best, so the result is exact. Where all vectors have one length, as
normalised embeddings have, the first two bounds prune nothing and the rotated partial sums do the work.

Queries meet parts in cells of ``ASKING`` queries and a part: the part's vectors come first and are held, the queries
stream past them. A vector travels once for every ASKING queries, a query once for every part it can reach.

Ties go to the smaller id. Vectors that are null, or hold a null or non-finite component, take no part; shorter
vectors count as padded by zeros. An empty table gives an empty result. Rows that repeat an id
are candidates of their own, but none is matched with a query of the same id; of several query rows with one id the one
that sorts first asks. Rows with a null id take no part. Other columns are left out of the result. Components times
components must fit 64 bits when summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

HEAD = 2048  # longest vectors that set the scores to beat
HELD_BYTES = 1 << 27  # of a part's vectors in a task: 16 bytes a component, see ``part_rows``
ASKING = 65_536  # queries that meet a part in one task
BLOCK = 2048  # vectors met at a time
QUERIES = 512  # queries that meet them at a time
LEADING = (16, 32)  # axes of the partial sums


def integer_components(column: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null for a vector that takes no part."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unpack(packed: pd.Series, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(-1, dims).astype(np.int64)


def _packed(vectors: DataFrame, dims: int, kind: str) -> DataFrame:
    """``vectors`` with v as bytes of ``dims`` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[row.tobytes() for row in _matrix(batch["v"], dims).astype(kind)])

    return vectors.select("vec_id", "asks", "n2", "v").mapInPandas(run, "vec_id bigint, asks boolean, n2 double, v binary")


def rotation(vectors: DataFrame, dims: int, kind: str) -> np.ndarray:
    """Right singular vectors of the whole table (packed), leading first, from its dims x dims Gram matrix."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _unpack(batch["v"], dims, kind).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "x": total.ravel()})

    cells = vectors.select("v").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((dims, dims))
    for i, j, x in cells.toPandas().itertuples(index=False):
        total[int(i), int(j)] = x
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def part_rows(dims: int) -> int:
    """Vectors of a part: each is held as integers and rotated, 8 bytes a component both times, beside some numbers of its own."""
    return max(1, HELD_BYTES // (16 * (dims + 16)))


class Side:
    """Vectors with their rotated forms and, for each number of leading axes, the length of the rest."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray):
        self.ids, self.v, self.turned = ids, v, v @ turn
        self.length = np.sqrt((v.astype(float) ** 2).sum(1))
        self.rest = {n: np.sqrt((self.turned[:, n:] ** 2).sum(1)) for n in LEADING if n < turn.shape[1]}

    def __getitem__(self, at) -> Side:
        out = object.__new__(Side)
        out.ids, out.v, out.turned, out.length = self.ids[at], self.v[at], self.turned[at], self.length[at]
        out.rest = {n: r[at] for n, r in self.rest.items()}
        return out


def best_products(q: Side, beat: np.ndarray, x: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of those pairs of two blocks that can be among a query's best k, best first."""
    alive = None
    for lead, rest in q.rest.items():
        if alive is None:
            bound = q.turned[:, :lead] @ x.turned[:, :lead].T + np.outer(rest, x.rest[lead])
            rows, cols = np.nonzero(bound * (1 + 1e-9) + 1 >= beat[:, None])
        else:
            rows, cols = alive
            bound = np.einsum("ij,ij->i", q.turned[rows, :lead], x.turned[cols, :lead]) + rest[rows] * x.rest[lead][cols]
            keep = bound * (1 + 1e-9) + 1 >= beat[rows]
            rows, cols = rows[keep], cols[keep]
        alive = rows, cols
    rows, cols = alive if alive is not None else map(np.ravel, np.indices((len(q.ids), len(x.ids))))
    found = []
    for at in range(0, len(rows), 200_000):
        r, c = rows[at : at + 200_000], cols[at : at + 200_000]
        score = np.einsum("ij,ij->i", q.v[r], x.v[c])
        keep = (score >= beat[r]) & (q.ids[r] != x.ids[c])
        found.append((r[keep], x.ids[c[keep]], score[keep]))
    return _best(*((np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 3), k)


def _best(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, r))
    r, ids, score = r[order], ids[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], ids[place < k], score[place < k]


def meet(q: Side, beat: np.ndarray, x: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's best k among vectors sorted by descending length, and the scores to beat from there on."""
    beat = beat.copy()
    have = (np.zeros(0, np.int64),) * 3
    for at in range(0, len(x.ids), BLOCK):
        block = x[at : at + BLOCK]
        can = np.flatnonzero(q.length * block.length.max() * (1 + 1e-9) + 1 >= beat)
        if not len(can):
            continue
        r, ids, score = best_products(q[can], beat[can], block, k)
        have = _best(*(np.concatenate(z) for z in zip(have, (can[r], ids, score))), k)
        last = np.flatnonzero(np.bincount(have[0], minlength=len(beat)) == k)
        beat[last] = np.maximum(beat[last], have[2][np.searchsorted(have[0], last, side="right") - 1])
    return *have, beat


def _floors(head: tuple[np.ndarray, np.ndarray], dims: int, kind: str, turn: np.ndarray, k: int):
    """Queries with the score of their k-th best among the longest vectors, if there are k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = Side(*head, turn)
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                some = batch.iloc[at : at + QUERIES]
                q = Side(some["vec_id"].to_numpy(np.int64), _unpack(some["v"], dims, kind), turn)
                yield some.assign(beat=meet(q, np.full(len(q.ids), -np.inf), longest, k)[3], length=q.length)

    return run


def _cells(dims: int, kind: str, turn: np.ndarray, k: int):
    """Over rows sorted so that a cell's vectors stand before its queries: each query's best in the cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, x = None, [], None
        for batch in batches:
            cells = batch[["part", "deal"]].to_numpy(np.int64)
            asks = batch["asks"].to_numpy(bool)
            change = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(1) | (asks[1:] != asks[:-1])])) if len(batch) else []
            for lo, hi in zip(change, [*change[1:], len(batch)]):
                rows = batch.iloc[lo:hi]
                if here != tuple(cells[lo]):
                    here, held, x = tuple(cells[lo]), [], None
                if not asks[lo]:
                    held.append((rows["vec_id"].to_numpy(np.int64), _unpack(rows["v"], dims, kind)))
                    continue
                if x is None and held:
                    x, held = Side(*(np.concatenate(z) for z in zip(*held)), turn), []
                for at in range(0, len(rows) if x is not None else 0, QUERIES):
                    some = rows.iloc[at : at + QUERIES]
                    q = Side(some["vec_id"].to_numpy(np.int64), _unpack(some["v"], dims, kind), turn)
                    r, ids, score, _ = meet(q, some["beat"].to_numpy(float), x, k)
                    yield pd.DataFrame({"query_id": q.ids[r], "vec_id": ids, "score": score})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k rows of largest inner product with each query row.

    ``vectors``: vec_id and v, an array of integers or null. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = written(rows.select(F.col("vec_id").cast("bigint"), "v", F.coalesce(is_query, F.lit(False)).alias("asks"), squares.alias("n2")), "vectors")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    count, asking, dims, most = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), largest).first()
    if not asking or not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"

    # the last sort key spreads rows that repeat an id
    dealt = _packed(rows, dims, kind).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(max(1, -(-count // part_rows(dims))), F.desc("n2"), "vec_id", "row").withColumn("part", F.spark_partition_id())
    ready = written(dealt, "ready")
    turn = rotation(ready, dims, kind)
    longest = ready.orderBy(F.desc("n2"), "vec_id", "row").limit(HEAD).select("vec_id", "v").toPandas()
    head = longest["vec_id"].to_numpy(np.int64), _unpack(longest["v"], dims, kind)

    asks = ready.where("asks").groupBy("vec_id").agg(F.min_by("v", "row").alias("v"))
    floors = written(asks.mapInPandas(_floors(head, dims, kind, turn, k), "vec_id bigint, v binary, beat double, length double"), "floors")

    # the parts' longest vectors in one value: two numbers a part
    parts = ready.groupBy("part").agg(F.sqrt(F.max("n2")).alias("longest")).agg(F.collect_list(F.struct("part", "longest")))
    reached = F.filter("parts", lambda p: F.col("length") * p["longest"] * (1 + 1e-9) + 1 >= F.col("beat"))
    deals = -(-asking // ASKING)
    queries = floors.withColumn("parts", parts.scalar()).select(F.explode(F.transform(reached, lambda p: p["part"])).alias("part"), "vec_id", "v", "beat", F.lit(True).alias("asks"), F.lit(None).cast("double").alias("n2"))
    queries = queries.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(deals)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    candidates = ready.select("part", "vec_id", "v", F.lit(None).cast("double").alias("beat"), F.lit(False).alias("asks"), "n2", every)
    cells = candidates.unionByName(queries).repartition("part", "deal").sortWithinPartitions("part", "deal", "asks", F.desc("n2"), "vec_id")
    found = cells.select("part", "deal", "asks", "vec_id", "v", "beat").mapInPandas(_cells(dims, kind, turn, k), "query_id bigint, vec_id bigint, score bigint")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
