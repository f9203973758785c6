"""Reproducible shuffles: every row gets a shard and a slot that can be computed from its row number, and back.

Rows are numbered from 0 by ``order_by``. A Feistel network over two halves of unlike radix (a * b is the least such product at or above the
number of rows, a the root of it) permutes the numbers; a value beyond the last row walks on along its cycle
until it lands inside. The place p of a row gives shard p % n_shards and slot p div n_shards, so shards differ by one row at
most and slots have no gaps. The longest walk is known before the rows are touched: only the a * b - n values outside, fewer than the
root of the row count, can be passed through, and a job over them finds it.

Rows are range-partitioned once by (``order_by``, a hash of the whole row, place of reading), so one value of ``order_by``, or
one row, may repeat any number of times and is still split among tasks. All else is columns of SQL functions.

Nulls in ``order_by`` come first. Rows that agree in it are ordered by the hash of all their columns (but maps and variants); whole
repeats are interchangeable, so the result does not depend on where they lie. Empty tables give empty results. Texts may be null, empty or of any length. Other
columns stay as they are, but for those named ``row_number``, ``shard`` or ``slot``, which the result's own replace.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

ROUNDS = 8
SEED = "dossier"
RESULT = ("row_number", "shard", "slot")
_POSITION = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the place within its partition


def radices(n_rows: int) -> tuple[int, int]:
    """Two factors whose product is at least n_rows, and less than one factor above it."""
    a = isqrt(max(n_rows, 1) - 1) + 1
    return a, -(-max(n_rows, 1) // a)


def _div(x: Column, by: int) -> Column:
    """Whole quotient of x >= 0, exact beyond 2**53 too."""
    return F.call_function("div", x, F.lit(by))


def _mixed(key: Column, half: Column) -> Column:
    """60 bits of MD5 of the round's key and a half."""
    return F.conv(F.substring(F.md5(F.concat(key, half.cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _network(x: Column, n_rows: int, seed: str, inverse: bool = False) -> Column:
    """One pass of x, 0 <= x < a * b, through the rounds."""
    a, b = radices(n_rows)
    rounds = [(f"{seed}:{i}:", (a, b)[i % 2]) for i in range(ROUNDS)]
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(r).cast("bigint").alias("radix")) for k, r in (reversed(rounds) if inverse else rounds)))

    def forth(s: Column, k: Column) -> Column:
        return F.struct(s["v"].alias("u"), ((s["u"] + _mixed(k["key"], s["v"])) % k["radix"]).alias("v"))

    def back(s: Column, k: Column) -> Column:
        return F.struct(F.pmod(s["v"] - _mixed(k["key"], s["u"]), k["radix"]).alias("u"), s["u"].alias("v"))

    return F.aggregate(keys, F.struct(_div(x, b).alias("u"), (x % b).alias("v")), back if inverse else forth, lambda s: s["u"] * b + s["v"])


def walk_length(spark: SparkSession, n_rows: int, seed: str = SEED, inverse: bool = False) -> int:
    """The most passes that any row number needs until it lands below n_rows."""
    a, b = radices(n_rows)
    outside = spark.range(n_rows, a * b)
    onward = outside.select(_network(F.col("id"), n_rows, seed, inverse).alias("id"))
    met, passes = outside.join(onward, "id", "left_anti"), 1  # what rows meet after one pass: values outside that none outside leads to
    while not met.isEmpty():
        met, passes = met.select(_network(F.col("id"), n_rows, seed, inverse).alias("id")).where(F.col("id") >= n_rows), passes + 1
    return passes


def permuted(x: Column, n_rows: int, passes: int, seed: str = SEED, inverse: bool = False) -> Column:
    """Place of row x among n_rows (or the row at place x). ``passes``: at least ``walk_length``."""
    first = _network(x.cast("bigint"), n_rows, seed, inverse)
    if passes == 1:
        return first
    return F.aggregate(F.sequence(F.lit(2), F.lit(passes)), first, lambda at, _: F.when(at < n_rows, at).otherwise(_network(at, n_rows, seed, inverse)))


def numbered(rows: DataFrame, order_by: str = "doc_id") -> tuple[DataFrame, int]:
    """(rows as a struct ``row`` with ``row_number`` from 0, how many there are). The rows move once and are written to the shared folder."""
    hashed = [rows[f"`{c}`"] for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    packed = rows.select(rows[f"`{order_by}`"].alias("key"), F.xxhash64(*hashed).alias("content"), F.monotonically_increasing_id().alias("seen"), F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"))
    dealt = packed.repartitionByRange("key", "content", "seen").sortWithinPartitions("key", "content", "seen")
    at = F.monotonically_increasing_id()
    dealt = written(dealt.select(F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(_POSITION)).alias("at"), "row"), "numbered")
    offsets, total = [], 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return dealt.join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("at")).alias("row_number")), total


def shard(rows: DataFrame, n_shards: int = 24, order_by: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``rows`` with row_number bigint, shard int and slot bigint."""
    placed, n_rows = numbered(rows, order_by)
    place = permuted(F.col("row_number"), n_rows, walk_length(rows.sparkSession, n_rows, seed), seed)
    own = [F.col("row")[c].alias(c) for c in rows.columns if c.lower() not in RESULT]
    placed = placed.select(*own, "row_number", place.alias("slot"))
    return placed.select(*(f"`{c}`" for c in placed.columns[:-1]), (F.col("slot") % n_shards).cast("int").alias("shard"), _div(F.col("slot"), n_shards).alias("slot"))


def row_number_at(shard: Column, slot: Column, n_rows: int, passes: int, n_shards: int = 24, seed: str = SEED) -> Column:
    """The row that lies at a slot of a shard. ``passes``: at least ``walk_length(..., inverse=True)``."""
    return permuted(slot.cast("bigint") * n_shards + shard, n_rows, passes, seed, inverse=True)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder ``shard=K`` for each shard, whose files hold its rows by slot; a large shard is written by several tasks."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
