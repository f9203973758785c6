"""Filters, sorts, pages and latest rows of the archive's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a list can be sorted by, and the column behind it.
SORT_KEYS = {
    "created_at": "created_at",
    "updated_at": "updated_at",
    "title": "title",
    "filename": "filename",
    "status": "status",
    "score": "latest_score",
    "evaluated_at": "evaluated_at",
    "pages": "total_pages",
    "words": "total_words",
}


def status_in(df: DataFrame, listed: str | None) -> DataFrame:
    """Rows whose status is in a comma list; blanks count for nothing, an empty list for no filter."""
    names = [s.strip() for s in (listed or "").split(",") if s.strip()]
    return df.where(F.col("status").isin(names)) if names else df


def eq_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the columns whose value is not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def exclude_duplicates(df: DataFrame) -> DataFrame:
    return df.where(F.col("review_decision") != "skipped_duplicate")


def search(df: DataFrame, text: str | None, columns: tuple[str, ...] = ("title", "filename", "problem_statement")) -> DataFrame:
    """Case-insensitive substring in any of the columns; % and _ stay wildcards."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).like(f"%{text.lower()}%"), F.lit(False))
    return df.where(hit)


def listing_projection(df: DataFrame, companies: DataFrame, categories: DataFrame) -> DataFrame:
    """What a list shows: no texts, names instead of keys."""
    named = with_dims(df, companies, categories)
    return named.select("proposal_id", "title", "filename", "status", "review_decision", "latest_score", "company_name", "category_label", "batch_id")


def with_dims(df: DataFrame, companies: DataFrame, categories: DataFrame) -> DataFrame:
    """Names of company and category; a missing one is null and drops no row. Join strategy by measured size."""
    names = companies.select("company_id", F.col("name").alias("company_name"))
    labels = categories.select("category", F.col("label").alias("category_label"))
    return df.join(names, "company_id", "left").join(labels, "category", "left")


def working_list(df: DataFrame) -> DataFrame:
    return exclude_duplicates(df.where(~F.col("is_evaluated")))


def review_queue(df: DataFrame) -> DataFrame:
    return df.where((F.col("review_decision") == "pending") & (F.col("status") == "pending_review"))


def retry_queue(df: DataFrame, most: int = 3) -> DataFrame:
    return df.where(F.col("status") == "failed").withColumn("can_retry", F.col("retry_count") < most)


def ineligible(force: bool = False) -> Column:
    """The first reason against evaluating a proposal, or null. Forcing never beats the gate."""
    status, gate = F.col("status"), F.col("review_decision")
    reason = F.when(gate == "pending", "Awaiting duplicate review").when(gate == "skipped_duplicate", "Ruled a duplicate")
    if not force:
        reason = reason.when(F.col("is_evaluated"), "Already evaluated")
    busy = status.isin("uploaded", "extracting", "extracted")
    return reason.when(busy, "Still in processing").when(status == "failed", "Processing failed")


def eligibility(df: DataFrame, force: bool = False) -> DataFrame:
    return df.withColumn("reason", ineligible(force))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Rows whose key is among the ids: a semi join, for lists of any length."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def stale_runs(df: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Runs that have been in processing for longer."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    return df.where((F.col("status") == "processing") & (F.col("created_at") < cutoff))


def newest_first(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(ts), *[F.desc(t) for t in ties])


def sort_listing(df: DataFrame, by: str = "created_at", descending: bool = True) -> DataFrame:
    """By an allowed key (any other: created_at), nulls last both ways, newest first among equals."""
    key = F.col(SORT_KEYS.get(by, "created_at"))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.desc("created_at"), F.desc("proposal_id"))


def sort_jobs(df: DataFrame) -> DataFrame:
    """Open work first, then by priority, then newest first."""
    open_first = F.when(F.col("status").isin("queued", "running"), 0).otherwise(1)
    return df.orderBy(open_first, F.asc("priority"), F.desc("created_at"), F.desc("job_id"))


def page(ordered: DataFrame, number: int, limit: int) -> tuple[DataFrame, int, int]:
    """(rows of a page, all rows, pages)."""
    total = ordered.count()
    return ordered.offset((max(1, number) - 1) * limit).limit(limit), total, -(-total // limit) if limit else 0


def top_k(df: DataFrame, decisions: DataFrame, k: int = 10, undecided_only: bool = True) -> DataFrame:
    """The best scored ones; undecided: no decision of any kind."""
    scored = df.where(F.col("latest_score").isNotNull())
    if undecided_only:
        scored = scored.join(decisions.select("proposal_id"), "proposal_id", "left_anti")
    return scored.orderBy(F.desc("latest_score"), F.asc("proposal_id")).limit(k)


def latest_per_key(df: DataFrame, key: str, *newest: Column) -> DataFrame:
    """One row a key: the first in the given order, which should end in an id."""
    place = W.partitionBy(key).orderBy(*newest)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def run_history(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def match_pairs(matches: DataFrame, rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Matches (a, b, similarity) with columns of both sides."""
    sides = [rows.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in ("a", "b")]
    return matches.join(sides[0], "a").join(sides[1], "b")


def exact_duplicates(df: DataFrame, key: str, hashed: Column) -> DataFrame:
    """Each row with the smallest key of its content: (key, canonical_id). The hash is aggregated, not collected."""
    rows = df.select(F.col(key), hashed.alias("_hash"))
    first = rows.groupBy("_hash").agg(F.min(key).alias("canonical_id"))
    return rows.join(first, "_hash").select(key, "canonical_id")
