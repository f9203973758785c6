"""Vectors, the duplicate gate and interned names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_company, slugify
from ..session import written

PRODUCT = 1 << 19  # numbers that a task multiplies out at a time, whatever the sizes of parts and the count of pivots
PIVOTS = 1024
SLACK = 1e-9  # what rounding may take from a bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit_normalise(vec: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def _nearest(k: int):
    """Over rows sorted so that a cell's archive stands before its new rows: each new row's k nearest in the cell, none below its floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, ids, other = None, [], None, None
        for batch in batches:
            marks = batch[["cell", "part", "deal", "asks"]].to_numpy(np.int64)
            cuts = np.flatnonzero((np.diff(marks, axis=0, prepend=-1) != 0).any(1))
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)]):
                rows, here = batch.iloc[lo:hi], tuple(marks[lo, :3])
                if here != cell:
                    cell, held, other = here, [], None
                if not marks[lo, 3]:
                    held.append((rows["id"].to_numpy(), np.stack(rows["vec"].to_list()).astype(float)))
                    continue
                if other is None and held:
                    ids, other, held = *(np.concatenate(x) for x in zip(*held)), []
                step = max(1, PRODUCT // len(other)) if other is not None else 1
                for at in range(0, len(rows) if other is not None else 0, step):
                    some = rows.iloc[at : at + step]
                    vec = np.stack(some["vec"].to_list()).astype(float)
                    like = vec @ other.T
                    like[some["id"].to_numpy()[:, None] == ids] = -np.inf
                    least = some["floor"].to_numpy(float)
                    if other.shape[0] > k:
                        least = np.maximum(least, np.partition(like, -k, axis=1)[:, -k])
                    i, j = np.nonzero(like >= least[:, None] - SLACK)
                    exact = np.zeros(len(i))
                    for d in range(vec.shape[1]):  # summed up in order, as the expression does
                        exact += vec[i, d] * other[j, d]
                    yield pd.DataFrame({"id": some["id"].to_numpy()[i], "matched": ids[j], "similarity": exact})

    return run


def _lengths(vec: np.ndarray) -> np.ndarray:
    return np.sqrt((vec * vec).sum(axis=1))


def _angles(vec: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each vector to each pivot; a zero vector lies at a right angle to all."""
    return np.arccos(np.clip(vec @ pivots.T / np.maximum(_lengths(vec), 1e-300)[:, None], -1, 1))


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, vec) with the nearest pivot as ``cell``, the angle to it, and the vector's length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, PRODUCT // len(pivots))
            for at in range(0, len(batch), step):
                some = batch.iloc[at : at + step]
                vec = np.stack(some["vec"].to_list()).astype(float)
                angles = _angles(vec, pivots)
                cell = angles.argmin(axis=1)
                yield some.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(vec)), cell], length=_lengths(vec))

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>, cell int, angle double, length double")


def _routed(asked: DataFrame, pivots: np.ndarray, cells: pd.DataFrame) -> DataFrame:
    """``asked`` (id, vec, home, floor) with a row for each cell but home that may hold a vector at the floor.

    By the triangle inequality for angles, a vector at angle x from a pivot is at least |y - x| away from a query at angle y from it; the cell's least and largest x bound that for all
    of its vectors at once.
    """
    number, low, high, longest = (cells[c].to_numpy() for c in ("cell", "low", "high", "longest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, PRODUCT // len(cells))
            for at in range(0, len(batch), step):
                some = batch.iloc[at : at + step]
                vec = np.stack(some["vec"].to_list()).astype(float)
                to_pivot = _angles(vec, pivots[number])
                apart = np.maximum(0, np.maximum(to_pivot - high, low - to_pivot))
                most = np.maximum(0, np.cos(apart)) * _lengths(vec)[:, None] * longest
                reach = (most >= some["floor"].to_numpy(float)[:, None] - SLACK) & (number != some["home"].to_numpy()[:, None])
                rows, places = np.nonzero(reach)
                few = max(1, PRODUCT // vec.shape[1])  # each row takes its vector along
                for lo in range(0, len(rows), few):
                    row, cell = rows[lo : lo + few], places[lo : lo + few]
                    yield pd.DataFrame({"id": some["id"].to_numpy()[row], "vec": some["vec"].to_numpy()[row], "cell": number[cell].astype(np.int32), "floor": some["floor"].to_numpy(float)[row]})

    return asked.mapInPandas(run, f"id {asked.schema['id'].dataType.simpleString()}, vec array<double>, cell int, floor double")


def _meet(asked: DataFrame, archive: DataFrame, sizes: dict[int, int], k: int, part: int) -> DataFrame:
    """(id, matched, similarity): queries (id, vec, cell, floor) against the archive rows of their cells.

    A cell's archive is cut into parts and its queries into deals of about ``part`` rows; each part meets each deal once, as a product of matrices.
    """
    deals = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a pivot
    plan = [(c, -(-sizes[c] // part), -(-n // part)) for c, n in deals.items()]
    plan = F.broadcast(asked.sparkSession.createDataFrame(plan, "cell int, parts int, deals int"))

    def placed(rows: DataFrame, own: str, n: str, other: str, m: str, asks: bool, floor) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other)
        return rows.join(plan, "cell").select("cell", "id", "vec", F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own), every, F.lit(asks).alias("asks"), floor.alias("floor"))

    cells = placed(archive, "part", "parts", "deal", "deals", False, F.lit(0.0)).unionByName(placed(asked, "deal", "deals", "part", "parts", True, F.col("floor")))
    cells = cells.repartition("cell", "part", "deal").sortWithinPartitions("cell", "part", "deal", "asks")
    kind = asked.schema["id"].dataType.simpleString()
    return cells.mapInPandas(_nearest(k), f"id {kind}, matched {kind}, similarity double")


def nearest_pairs(new: DataFrame, archive: DataFrame, k: int, threshold: float, part: int) -> tuple[DataFrame, int]:
    """(candidates for the k nearest as id, matched, similarity; how many pairs are multiplied to find them)."""
    sides = [x.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec")) for x in (archive, new)]
    n = sides[0].count()
    chosen = sides[0].where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, 2 * n // part))).collect()
    if not chosen:  # an archive of zero vectors: any axis will do
        first = sides[0].first()
        chosen = [first] if first else []
    if not chosen:
        return sides[1].select("id", F.col("id").alias("matched"), F.lit(0.0).alias("similarity")).where(F.lit(False)), 0
    pivots = np.array([r.vec for r in chosen])
    pivots = pivots / np.maximum(_lengths(pivots), 1e-300)[:, None]
    held = written(_dealt(sides[0], pivots), "archive")
    cells = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("length").alias("longest")).toPandas()  # a row a pivot
    sizes = dict(zip(cells["cell"].tolist(), cells["n"].tolist()))
    asked = written(_dealt(sides[1], pivots), "asked")
    home = asked.where(F.col("cell").isin(list(sizes))).select("id", "vec", "cell", F.lit(float(threshold)).alias("floor"))
    met = home.groupBy("cell").count().collect()
    pairs = sum(r["count"] * sizes[r.cell] for r in met)
    near = _meet(home, held, sizes, k, part)
    if len(sizes) == 1:
        return near, pairs
    near = written(near.where(F.col("similarity") >= threshold), "near")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity")))
    kth = near.withColumn("place", place).where(F.col("place") == k).select("id", F.col("similarity").alias("kth"))
    rising = asked.join(kth, "id", "left").select("id", "vec", F.col("cell").alias("home"), F.greatest(F.lit(float(threshold)), F.col("kth")).alias("floor"))
    far = written(_routed(rising, pivots, cells), "routed")
    pairs += sum(r["count"] * sizes[r.cell] for r in far.groupBy("cell").count().collect())
    return near.unionByName(_meet(far, held, sizes, k, part)), pairs


def knn_cosine(new: DataFrame, archive: DataFrame, k: int = 5, threshold: float = 0.72, part: int = 20_000) -> DataFrame:
    """(id, matched, similarity, place): the k nearest archive rows of each new one at the threshold, exactly.

    Both sides hold ``id`` and a unit vector ``vec``, all of one length; rows with a null one take no part. The archive is dealt to the nearest of some of its own
    vectors (PIVOTS at most, so that they can stay with the driver). Each new row first meets its own pivot's cell; what it finds there is the least that others must reach, and it is sent on only to
    cells that the triangle inequality leaves. A bound only ever discards what can't be among the k nearest, so the result is that of comparing all.
    """
    near = nearest_pairs(new, archive, k, threshold, part)[0].where(F.col("similarity") >= threshold)
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "matched")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).withColumn("similarity", F.round("similarity", 4))


def similarity_gate(new: DataFrame, matches: DataFrame) -> DataFrame:
    """Each new row with its best match and where it goes."""
    best = matches.where("place = 1").select("id", "matched", "similarity")
    held = F.col("matched").isNotNull()
    out = new.select("id").join(best, "id", "left")
    return out.withColumn("status", F.when(held, "pending_review").otherwise("queued")).withColumn("review_decision", F.when(held, "pending").otherwise("approved_for_eval"))


def match_reasons(matches: DataFrame) -> DataFrame:
    """Why a match was made, as a list of texts. Needs similarity, the names company_a and company_b, category_b (a label) and evaluated_b."""
    percent = F.concat(F.floor(F.col("similarity") * 100 + 0.5).cast("string"), F.lit("% similar"))
    own, other = (normalize_company(F.col(c).cast("string")) for c in ("company_a", "company_b"))
    same = F.when((own != "") & (other != ""), F.when(own == other, "Same organisation").otherwise("Different organisation"))
    category = F.concat(F.lit("Category: "), F.col("category_b"))
    return matches.withColumn("reasons", F.array_compact(F.array(percent, same, category, F.when(F.col("evaluated_b"), "Already evaluated"))))


def record_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """All matches with new ones added as pending; a pair that is known stays as it is."""
    fresh = new.select("proposal_id", "matched_id").distinct().join(old, ["proposal_id", "matched_id"], "left_anti")
    return old.select("proposal_id", "matched_id", "status").unionByName(fresh.withColumn("status", F.lit("pending")))


def resolve_reviews(proposals: DataFrame, matches: DataFrame, rulings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies rulings (proposal_id, ruling: evaluate or skip) to both tables; only pending matches move."""
    ruled = rulings.select("proposal_id", "ruling")
    go, skip = F.col("ruling") == "evaluate", F.col("ruling") == "skip"
    p = proposals.join(ruled, "proposal_id", "left")
    p = p.withColumn("status", F.when(go, "queued").when(skip, "skipped").otherwise(F.col("status"))).withColumn("review_decision", F.when(go, "approved_for_eval").when(skip, "skipped_duplicate").otherwise(F.col("review_decision"))).drop("ruling")
    m = matches.join(ruled, "proposal_id", "left")
    open_ = F.col("status") == "pending"
    m = m.withColumn("status", F.when(open_ & go, "dismissed").when(open_ & skip, "confirmed_duplicate").otherwise(F.col("status"))).drop("ruling")
    return p, m


def mark_duplicates(proposals: DataFrame, matches: DataFrame, rulings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rulings on any proposals, applied: (proposals, matches, report of proposal_id, accepted, reason).

    ``rulings`` holds one row a proposal: proposal_id, is_duplicate, original_id (or null). A proposal ruled a copy is skipped and keeps its original's id, its pending
    matches are confirmed; one ruled none after all goes back to the queue, its pending matches are dismissed. What can't be ruled keeps its state and gets a reason.
    """
    known = proposals.select("proposal_id", F.coalesce("is_evaluated", F.lit(False)).alias("_evaluated"))
    originals = proposals.select(F.col("proposal_id").alias("original_id"), F.lit(True).alias("_original"))
    rows = rulings.select("proposal_id", "is_duplicate", "original_id").join(known, "proposal_id", "left").join(originals, "original_id", "left")
    copy, named = F.col("is_duplicate"), F.col("original_id").isNotNull()
    reason = (
        F.when(F.col("_evaluated").isNull(), "Not found")
        .when(copy & F.col("_evaluated"), "Already evaluated")
        .when(copy & named & F.col("_original").isNull(), "Original not found")
        .when(copy & (F.col("original_id") == F.col("proposal_id")), "Same proposal")
    )
    report = rows.select("proposal_id", reason.isNull().alias("accepted"), reason.alias("reason"))
    applied = rows.where(reason.isNull()).select("proposal_id", copy.alias("_copy"), F.col("original_id").alias("_of"))
    p = proposals.join(applied, "proposal_id", "left")
    if "duplicate_of_id" not in proposals.columns:
        p = p.withColumn("duplicate_of_id", F.lit(None).cast(proposals.schema["proposal_id"].dataType))
    ruled = lambda yes, no, now: F.when(F.col("_copy"), yes).when(~F.col("_copy"), no).otherwise(F.col(now))
    p = p.withColumns({
        "status": ruled(F.lit("skipped"), F.lit("queued"), "status"),
        "review_decision": ruled(F.lit("skipped_duplicate"), F.lit("approved_for_eval"), "review_decision"),
        "duplicate_of_id": ruled(F.col("_of"), F.lit(None), "duplicate_of_id"),
    }).drop("_copy", "_of")
    m = matches.join(applied, "proposal_id", "left")
    moved = F.when(F.col("status") == "pending", ruled(F.lit("confirmed_duplicate"), F.lit("dismissed"), "status")).otherwise(F.col("status"))
    return p, m.withColumn("status", moved).drop("_copy", "_of"), report


def _interned(existing: DataFrame, incoming: DataFrame, key: Column, prefix: str, extras: tuple[str, ...]) -> DataFrame:
    """One row a key: known rows keep id and spelling; blank extras are filled in order of arrival, never overwritten."""
    both = existing.select("name", "seen_at", F.lit(0).alias("age"), *extras).unionByName(incoming.select("name", "seen_at", F.lit(1).alias("age"), *extras))
    order = F.struct("age", "seen_at", "name")
    filled = [F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", order)).alias(c) for c in extras]
    out = both.withColumn("key", key).groupBy("key").agg(F.min_by("name", order).alias("name"), F.min("seen_at").alias("seen_at"), *filled)
    return out.withColumn("id", F.concat(F.lit(prefix), F.substring(F.sha2("key", 256), 1, 16)))


def intern_companies(existing: DataFrame, incoming: DataFrame, extras: tuple[str, ...] = ("email",)) -> DataFrame:
    return _interned(existing, incoming, normalize_company(F.col("name")), "c-", extras)


def intern_categories(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return _interned(existing, incoming, slugify(F.col("name")), "k-", ())
