"""Patches, ledgers, deletes and widened schemas: what the archive's tables are changed by."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREVIEW = 2000


def apply_patch(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Column-wise patch by key. ``patch`` has the key, ``fields`` (names that it sets) and columns of new values.

    A named column is set even to null; unknown columns are ignored; new text refreshes the preview.
    """
    known = [c for c in patch.columns if c in base.columns and c != key]
    news = patch.select(F.col(key), F.col("fields").alias("_fields"), *[F.col(c).alias(f"_new_{c}") for c in known])
    out = base.join(news, key, "left")

    def value(c: str) -> Column:
        if c not in known:
            return F.col(c)
        named = F.coalesce(F.array_contains("_fields", c), F.lit(False))
        return F.when(named, F.col(f"_new_{c}")).otherwise(F.col(c))

    columns = {c: value(c) for c in base.columns}
    if "preview" in base.columns and "text" in known:
        columns["preview"] = F.when(F.coalesce(F.array_contains("_fields", "text"), F.lit(False)), F.substring("_new_text", 1, PREVIEW)).otherwise(F.col("preview"))
    return out.select(*[c.alias(name) for name, c in columns.items()])


def with_periods(df: DataFrame, ts: str = "decided_at") -> DataFrame:
    return df.withColumn("decision_year", F.year(ts)).withColumn("decision_month", F.month(ts))


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends decisions, partitioned by year and month; earlier rows are never touched. A month's rows are brought together first, so few files are written."""
    with_periods(df).hint("rebalance", "decision_year", "decision_month").write.mode("append").partitionBy("decision_year", "decision_month").parquet(path)


def append_audit(df: DataFrame, path: str) -> bool:
    """Appends audit rows; a failure is logged and told, not raised: the caller's work stands."""
    try:
        df.write.mode("append").parquet(path)
        return True
    except Exception:
        logging.getLogger(__name__).exception("audit rows could not be written to %s", path)
        return False


def cascade_delete(proposals: DataFrame, evaluations: DataFrame, decisions: DataFrame, matches: DataFrame, ids: DataFrame) -> tuple[DataFrame, ...]:
    """All four tables without the proposals of ``ids``; matches go if either side does."""
    gone = ids.select("proposal_id").distinct()
    kept = [t.join(gone, "proposal_id", "left_anti") for t in (proposals, evaluations, decisions)]
    for side in ("proposal_id", "matched_id"):
        matches = matches.join(gone.withColumnRenamed("proposal_id", side), side, "left_anti")
    return (*kept, matches)


VERDICT = ("latest_score", "latest_recommendation", "latest_evaluation_id", "evaluated_at")


def with_verdicts(proposals: DataFrame, newest: DataFrame, only_missing: bool) -> DataFrame:
    """``proposals`` with a boolean ``filled``: where it is true, score, label, id and time are those of the newest completed run.

    ``newest`` holds one row a proposal: proposal_id, run_id, score, recommendation, completed_at (or null) and created_at.
    """
    runs = newest.select("proposal_id", F.struct("score", "recommendation", "run_id", F.coalesce("completed_at", "created_at")).alias("_run"))
    out = proposals.join(runs, "proposal_id", "left")
    filled = F.col("_run").isNotNull() & F.col("latest_score").isNull() if only_missing else F.col("_run").isNotNull()
    out = out.withColumn("filled", filled)
    news = [F.col("_run").getField(f) for f in out.schema["_run"].dataType.names]
    return out.withColumns({c: F.when(F.col("filled"), new).otherwise(F.col(c)) for c, new in zip(VERDICT, news, strict=True)}).drop("_run")


def backfill_verdict(proposals: DataFrame, newest: DataFrame) -> DataFrame:
    """The newest completed run onto proposals without a score; verdicts that are there stay as they are."""
    return with_verdicts(proposals, newest, only_missing=True).drop("filled")


def widen_schema(df: DataFrame, columns: T.StructType) -> DataFrame:
    """Missing columns as nulls; present ones are left alone, whatever their type."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in columns if f.name not in df.columns})
