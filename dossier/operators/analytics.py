"""Counts, distributions, timelines and totals over the archive.

Aggregates are declared once and left to partial and final aggregation; zero rows come from joins with
the small fixed tables of stages and bands. Means are sums of decimals by counts, so they do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import APPROVING, BANDS, STAGES


def mean(column: Column | str, places: int = 2) -> Column:
    """Mean of a decimal sum, rounded; nulls count for nothing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.sum(c.cast("decimal(20,4)")).cast("double") / F.count(c), places)


def pipeline_stages(df: DataFrame) -> DataFrame:
    """All stages in order with their counts, zeros included, the total, and how many are cleared for an evaluation that they have not had."""
    stages = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STAGES)], "position int, stage string")
    counts = df.groupBy(F.col("status").alias("stage")).agg(F.count("*").alias("n"))
    out = stages.join(counts, "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = df.agg(F.count("*").alias("total"), F.count_if(~F.col("is_evaluated") & (F.col("review_decision") == "approved_for_eval")).alias("actionable"))
    return out.join(totals)


def band_of(score: Column) -> Column:
    return reduce(lambda c, b: c.when((score >= b[0]) & (score < b[1]), b[2]), BANDS, F.when(F.lit(False), F.lit("")))


def score_bands(df: DataFrame, score: str = "latest_score") -> DataFrame:
    bands = df.sparkSession.createDataFrame([(i, b[2]) for i, b in enumerate(BANDS)], "position int, band string")
    counts = df.where(F.col(score).isNotNull()).groupBy(band_of(F.col(score)).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counts, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def score_summary(df: DataFrame, score: str = "latest_score") -> DataFrame:
    """Count, mean, least, most and the interpolated median of the scored rows."""
    median = F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {score})")
    return df.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), mean(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"), F.round(median, 4).alias("median"))


def counted_by(df: DataFrame, column: str) -> DataFrame:
    """Rows a value, nulls left out, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def score_by_category(df: DataFrame) -> DataFrame:
    s = "latest_score"
    return df.where(F.col(s).isNotNull()).groupBy("category").agg(F.count("*").alias("n"), mean(s).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high")).orderBy(F.desc("mean"), "category")


def throughput(df: DataFrame, months: int = 12, received: str = "created_at", done: str = "evaluated_at") -> DataFrame:
    """Received and evaluated a month. Each series is cut to its last ``months`` before they are joined."""

    def series(ts: str, name: str) -> DataFrame:
        month = F.date_format(ts, "yyyy-MM")
        return df.where(F.col(ts).isNotNull()).groupBy(month.alias("period")).agg(F.count("*").alias(name)).orderBy(F.desc("period")).limit(months)

    both = series(received, "received").join(series(done, "evaluated"), "period", "full")
    return both.select("period", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "evaluated")]).orderBy("period")


def aligned(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """Two series side by side; gaps are 0."""
    return left.join(right, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def operations_totals(runs: DataFrame) -> DataFrame:
    """Completed runs, their tokens (sum, and mean cut to an integer) and mean seconds."""
    whole = F.floor(F.sum("tokens") / F.count("tokens")).cast("bigint")
    return runs.where("status = 'completed'").agg(F.count("*").alias("completed"), F.sum("tokens").alias("tokens"), whole.alias("avg_tokens"), F.round(F.sum("duration_ms") / F.count("duration_ms") / 1000, 2).alias("avg_seconds"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "processing").alias("in_flight"))


def failures_by_stage(df: DataFrame) -> DataFrame:
    return df.where("status = 'failed'").groupBy(F.coalesce("error_stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def avg_json_path(runs: DataFrame, column: str, path: str) -> DataFrame:
    """Mean of a number inside a JSON column, completed runs only."""
    return runs.where("status = 'completed'").agg(mean(F.get_json_object(column, path).cast("double"), 4).alias("mean"))


def dominant_model(runs: DataFrame) -> DataFrame:
    return counted_by(runs, "model").limit(1)


def duplicate_gate_report(df: DataFrame, matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Flagged, confirmed, pending and dismissed proposals, and the tokens that confirmed duplicates saved."""
    flagged = matches.agg(F.count_distinct("proposal_id").alias("flagged"), F.count_if(F.col("status") == "dismissed").alias("dismissed"))
    ruled = df.agg(F.count_if(F.col("review_decision") == "skipped_duplicate").alias("confirmed"), F.count_if(F.col("review_decision") == "pending").alias("pending"))
    tokens = runs.where("status = 'completed'").agg((F.sum("tokens").cast("double") / F.count("tokens")).alias("each"))
    saved = F.when((F.col("confirmed") > 0) & (F.col("each") != 0), F.floor(F.col("confirmed") * F.col("each")).cast("bigint"))
    return flagged.join(ruled).join(tokens).select("flagged", "confirmed", "pending", "dismissed", saved.alias("tokens_saved"))


def approvals(decisions: DataFrame, year: int | None = None) -> DataFrame:
    out = decisions.where(F.col("decision").isin(*APPROVING))
    return out.where(F.year("decided_at") == year) if year is not None else out


def approvals_by_category(decisions: DataFrame, year: int | None = None) -> DataFrame:
    """Distinct approved proposals a category; undoing a selection takes none away."""
    return approvals(decisions, year).where(F.col("category").isNotNull()).groupBy("category").agg(F.count_distinct("proposal_id").alias("approved"))


def approvals_by_company(decisions: DataFrame, year: int | None = None, exact: bool = True) -> DataFrame:
    """Distinct approved proposals and categories a company, and whether that is more than one category."""
    count = F.count_distinct if exact else F.approx_count_distinct
    out = approvals(decisions, year).where(F.col("company_id").isNotNull()).groupBy("company_id").agg(count("proposal_id").alias("approved"), count("category").alias("categories"))
    return out.withColumn("multi_category", F.col("categories") > 1)


def company_context(decisions: DataFrame) -> DataFrame:
    """A company's approvals, newest first, and how many proposals and categories they touch."""
    newest = F.struct((-F.unix_micros(F.col("decided_at").cast("timestamp"))).alias("order"), "proposal_id", "category")
    out = approvals(decisions).groupBy("company_id").agg(F.array_sort(F.collect_list(newest)).alias("a"), F.count_distinct("proposal_id").alias("approved"), F.count_distinct("category").alias("categories"))
    return out.select("company_id", F.col("a.proposal_id").alias("proposals"), "approved", "categories")


def approval_timeline(decisions: DataFrame, by: str, year: int | None = None) -> DataFrame:
    """Distinct approved proposals a month and company or category; a missing one is Uncategorized."""
    period = F.date_format("decided_at", "yyyy-MM").alias("period")
    dim = F.coalesce(F.col(by).cast("string"), F.lit("Uncategorized")).alias("dim")
    return approvals(decisions, year).groupBy(F.year("decided_at").alias("year"), F.month("decided_at").alias("month"), period, dim).agg(F.count_distinct("proposal_id").alias("approved"))


def timeline_pivot(timeline: DataFrame, series: list[str]) -> DataFrame:
    """Period by series, zeros filled in; the series are given, so no job looks for them."""
    return timeline.groupBy("period").pivot("dim", series).agg(F.sum("approved")).fillna(0)


def timeline_total(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("period").agg(F.sum("approved").alias("approved"))


def stage_share(stages: DataFrame) -> DataFrame:
    """Percent of the total; empty stages are left out."""
    return stages.where("n > 0").withColumn("percent", F.round(F.col("n") * 100.0 / F.col("total"), 2))


def overview(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of totals. Approved adds up categories: a proposal approved under two counts twice."""
    counts = df.agg(F.count("*").alias("proposals"), F.count_if("is_evaluated").alias("evaluated"), F.count_if(F.col("status") == "failed").alias("failed"))
    approved = approvals_by_category(decisions).agg(F.sum("approved").alias("approved"))
    spread = approvals_by_company(decisions).agg(F.count("*").alias("companies"), F.count_if("multi_category").alias("multi_category"))
    return counts.join(approved).join(spread)


PARKED = ("queued", "evaluated", "skipped", "failed", "pending_review")


def batch_state(df: DataFrame) -> DataFrame:
    """Per batch: by status, evaluated, awaiting a review, failed, and in progress (in no parked status)."""
    by_status = df.groupBy("batch_id", "status").agg(F.count("*").alias("n"), F.count_if("is_evaluated").alias("evaluated"), F.count_if(F.col("review_decision") == "pending").alias("awaiting"))
    out = by_status.groupBy("batch_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
        F.sum("n").alias("total"),
        F.sum("evaluated").alias("evaluated"),
        F.sum("awaiting").alias("awaiting"),
        F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(~F.col("status").isin(*PARKED), F.col("n"))), F.lit(0)).alias("in_progress"),
    )
    return out


def batch_partition(df: DataFrame) -> DataFrame:
    """Per batch: ready, blocked, skipped and already evaluated; the four overlap."""
    return df.groupBy("batch_id").agg(
        F.count_if((F.col("review_decision") == "approved_for_eval") & ~F.col("is_evaluated")).alias("ready"),
        F.count_if(F.col("review_decision") == "pending").alias("blocked"),
        F.count_if(F.col("review_decision") == "skipped_duplicate").alias("skipped"),
        F.count_if("is_evaluated").alias("already"),
    )


def bulk_report(ids: DataFrame, df: DataFrame, reason: Column) -> DataFrame:
    """(proposal_id, queued, reason) for requested ids; unknown ones are Not found."""
    rows = df.select("proposal_id", F.lit(True).alias("_found"), reason.alias("_reason"))
    why = F.when(F.col("_found").isNull(), "Not found").otherwise(F.col("_reason"))
    return ids.join(rows, "proposal_id", "left").select("proposal_id", why.isNull().alias("queued"), why.alias("reason"))


def upload_report(df: DataFrame) -> DataFrame:
    """Per batch: uploads, accepted ones and duplicates (another row is canonical)."""
    return df.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("canonical_id") == F.col("id")).alias("accepted"), F.count_if(F.col("canonical_id") != F.col("id")).alias("duplicates"))


def verdict_facts(parameters: DataFrame) -> DataFrame:
    return parameters.groupBy("proposal_id").agg(F.sum("red_flags").alias("red_flags"), F.count("score").alias("scored"))
