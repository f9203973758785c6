"""Analytics over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Archive
from ..operators import analytics as A
from ..operators import listing as L
from ..registry import query
from .relational import ELIGIBLE

APPROVED = "SELECT * FROM decisions WHERE decision IN ('approved', 'selected_for_funding')"
PERIOD = "strftime(decided_at, '%Y-%m')"
STAGE_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(["uploaded", "extracting", "extracted", "metadata_ready", "pending_review", "queued", "evaluating", "evaluated", "skipped", "failed"]))
STAGES = f"""SELECT CAST(position AS INT) AS position, stage, count(p.status) AS n, (SELECT count(*) FROM proposals) AS total,
    (SELECT count(*) FROM proposals WHERE NOT is_evaluated AND review_decision = 'approved_for_eval') AS actionable
    FROM (VALUES {STAGE_ROWS}) s(position, stage) LEFT JOIN proposals p ON p.status = s.stage GROUP BY ALL"""


def mean(c: str, places: int = 2) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(20,4))) AS DOUBLE) / count({c}), {places})"


@query(STAGES)
def a1_pipeline_stages(a: Archive) -> DataFrame:
    return A.pipeline_stages(a.proposals).select("position", "stage", "n", "total", "actionable")


@query("""SELECT CAST(b.position AS INT) AS position, b.band, count(latest_score) AS n
    FROM (VALUES (0, 0, 40, '0-40'), (1, 40, 55, '40-55'), (2, 55, 70, '55-70'), (3, 70, 85, '70-85'), (4, 85, 101, '85-100')) b(position, low, high, band)
    LEFT JOIN proposals ON latest_score >= low AND latest_score < high GROUP BY ALL""")
def a2_score_bands(a: Archive) -> DataFrame:
    return A.score_bands(a.proposals).select("position", "band", "n")


@query(f"SELECT count(*) AS n, {mean('latest_score')} AS mean, min(latest_score) AS low, max(latest_score) AS high, round(quantile_cont(latest_score, 0.5), 4) AS median FROM proposals WHERE latest_score IS NOT NULL")
def a3_score_summary(a: Archive) -> DataFrame:
    return A.score_summary(a.proposals)


@query("SELECT CASE WHEN latest_score >= 80 THEN 'Highly Recommended' WHEN latest_score >= 65 THEN 'Recommended' WHEN latest_score >= 45 THEN 'Conditionally Recommended' ELSE 'Not Recommended' END AS recommendation, count(*) AS n FROM proposals WHERE latest_score IS NOT NULL GROUP BY 1")
def a4_by_recommendation(a: Archive) -> DataFrame:
    from ..operators.scoring import recommendation_of

    return A.counted_by(a.proposals.withColumn("recommendation", recommendation_of(F.col("latest_score"))), "recommendation")


@query(f"SELECT category, count(*) AS n, {mean('latest_score')} AS mean, min(latest_score) AS low, max(latest_score) AS high FROM proposals WHERE latest_score IS NOT NULL GROUP BY category")
def a5_score_by_category(a: Archive) -> DataFrame:
    return A.score_by_category(a.proposals)


EVALUATED = "created_at + INTERVAL 1 DAY * (proposal_id % 45)"


@query(f"""WITH r AS (SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS received FROM proposals GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
    e AS (SELECT strftime({EVALUATED}, '%Y-%m') AS period, count(*) AS evaluated FROM proposals WHERE is_evaluated GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
    SELECT period, coalesce(received, 0) AS received, coalesce(evaluated, 0) AS evaluated FROM r FULL JOIN e USING (period)""")
def a6_throughput(a: Archive) -> DataFrame:
    done = F.when(F.col("is_evaluated"), F.col("created_at") + F.expr("make_dt_interval(CAST(proposal_id % 45 AS INT))"))
    return A.throughput(a.proposals.withColumn("evaluated_at", done))


@query("""WITH r AS (SELECT strftime(created_at, '%Y-%m') AS period, count(*) AS received FROM proposals GROUP BY 1),
    d AS (SELECT strftime(decided_at, '%Y-%m') AS period, count(*) AS decided FROM decisions GROUP BY 1)
    SELECT period, coalesce(received, 0) AS received, coalesce(decided, 0) AS decided FROM r FULL JOIN d USING (period)""")
def j7_aligned_periods(a: Archive) -> DataFrame:
    received = a.proposals.groupBy(F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("received"))
    decided = a.decisions.groupBy(F.date_format("decided_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("decided"))
    return A.aligned(received, decided, "period", "received", "decided")


@query("SELECT count(*) AS completed, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(floor(sum(tokens) / count(tokens)) AS BIGINT) AS avg_tokens, round(sum(duration_ms) / count(duration_ms) / 1000, 2) AS avg_seconds FROM evaluations WHERE status = 'completed'")
def a7_operations_totals(a: Archive) -> DataFrame:
    return A.operations_totals(a.evaluations)


@query("SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS in_flight FROM evaluations")
def a8_status_counts(a: Archive) -> DataFrame:
    return A.status_counts(a.evaluations)


@query("SELECT coalesce(error_stage, 'unknown') AS stage, count(*) AS n FROM proposals WHERE status = 'failed' GROUP BY 1")
def a9_failures_by_stage(a: Archive) -> DataFrame:
    return A.failures_by_stage(a.proposals)


@query(f"SELECT {mean('coverage', 4)} AS mean FROM evaluations WHERE status = 'completed'")
def a10_avg_json_path(a: Archive) -> DataFrame:
    report = F.to_json(F.struct(F.struct(F.col("coverage").alias("evidence_coverage")).alias("evaluation")))
    return A.avg_json_path(a.evaluations.withColumn("report", report), "report", "$.evaluation.evidence_coverage")


@query("SELECT model, count(*) AS n FROM evaluations GROUP BY model ORDER BY n DESC, model LIMIT 1")
def a11_dominant_model(a: Archive) -> DataFrame:
    return A.dominant_model(a.evaluations)


MATCHES = "SELECT p.proposal_id, p.proposal_id + 1 AS matched_id, CASE p.proposal_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed_duplicate' ELSE 'dismissed' END AS status FROM proposals p WHERE p.review_decision = 'pending' OR p.review_decision = 'skipped_duplicate'"


def gate_matches(a: Archive) -> DataFrame:
    """Synthetic matches of the proposals that the gate holds or has ruled on."""
    status = F.when(F.col("proposal_id") % 3 == 0, "pending").when(F.col("proposal_id") % 3 == 1, "confirmed_duplicate").otherwise("dismissed")
    return a.proposals.where(F.col("review_decision").isin("pending", "skipped_duplicate")).select("proposal_id", (F.col("proposal_id") + 1).alias("matched_id"), status.alias("status"))


@query(f"""WITH m AS ({MATCHES}), c AS (SELECT count(*) FILTER (WHERE review_decision = 'skipped_duplicate') AS confirmed, count(*) FILTER (WHERE review_decision = 'pending') AS pending FROM proposals),
    t AS (SELECT CAST(sum(tokens) AS DOUBLE) / count(tokens) AS each_ FROM evaluations WHERE status = 'completed')
    SELECT (SELECT count(DISTINCT proposal_id) FROM m) AS flagged, confirmed, pending, (SELECT count(*) FROM m WHERE status = 'dismissed') AS dismissed,
           CASE WHEN confirmed > 0 AND each_ <> 0 THEN CAST(floor(confirmed * each_) AS BIGINT) END AS tokens_saved FROM c, t""")
def a12_duplicate_gate_report(a: Archive) -> DataFrame:
    return A.duplicate_gate_report(a.proposals, gate_matches(a), a.evaluations)


@query(f"SELECT category, count(DISTINCT proposal_id) AS approved FROM ({APPROVED}) GROUP BY category")
def a13_approvals_by_category(a: Archive) -> DataFrame:
    return A.approvals_by_category(a.decisions)


@query(f"SELECT company_id, count(DISTINCT proposal_id) AS approved, count(DISTINCT category) AS categories, count(DISTINCT category) > 1 AS multi_category FROM ({APPROVED}) GROUP BY company_id")
def a14_approvals_by_company(a: Archive) -> DataFrame:
    return A.approvals_by_company(a.decisions)


@query(f"""SELECT company_id, string_agg(CAST(proposal_id AS VARCHAR), ',' ORDER BY decided_at DESC, proposal_id, category) AS proposals, count(DISTINCT proposal_id) AS approved, count(DISTINCT category) AS categories
    FROM ({APPROVED}) GROUP BY company_id""")
def a15_company_context(a: Archive) -> DataFrame:
    return A.company_context(a.decisions).withColumn("proposals", F.array_join("proposals", ","))


TIMELINE = f"SELECT CAST(year(decided_at) AS INT) AS year, CAST(month(decided_at) AS INT) AS month, {PERIOD} AS period, coalesce(category, 'Uncategorized') AS dim, count(DISTINCT proposal_id) AS approved FROM ({APPROVED}) GROUP BY ALL"


@query(TIMELINE)
def a16_approval_timeline(a: Archive) -> DataFrame:
    return A.approval_timeline(a.decisions, "category")


@query(f"SELECT period, " + ", ".join(f"CAST(coalesce(sum(approved) FILTER (WHERE dim = '{c}'), 0) AS BIGINT) AS {n}" for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low"))) + f" FROM ({TIMELINE}) GROUP BY period")
def a17_timeline_pivot(a: Archive) -> DataFrame:
    wide = A.timeline_pivot(A.approval_timeline(a.decisions, "category"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return wide.toDF("period", "urgent", "high", "medium", "unspecified", "low")


@query(f"SELECT period, CAST(sum(approved) AS BIGINT) AS approved FROM ({TIMELINE}) GROUP BY period")
def a18_timeline_total(a: Archive) -> DataFrame:
    return A.timeline_total(A.approval_timeline(a.decisions, "category"))


@query(f"SELECT stage, n, round(n * 100.0 / total, 2)::DOUBLE AS percent FROM ({STAGES}) WHERE n > 0")
def a19_stage_share(a: Archive) -> DataFrame:
    return A.stage_share(A.pipeline_stages(a.proposals)).select("stage", "n", F.col("percent").cast("double").alias("percent"))


@query(f"""WITH c AS (SELECT category, count(DISTINCT proposal_id) AS n FROM ({APPROVED}) GROUP BY category), k AS (SELECT company_id, count(DISTINCT category) AS m FROM ({APPROVED}) GROUP BY company_id)
    SELECT count(*) AS proposals, count(*) FILTER (WHERE is_evaluated) AS evaluated, count(*) FILTER (WHERE status = 'failed') AS failed, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS approved,
           (SELECT count(*) FROM k) AS companies, (SELECT count(*) FROM k WHERE m > 1) AS multi_category FROM proposals""")
def a20_overview(a: Archive) -> DataFrame:
    return A.overview(a.proposals, a.decisions)


@query("""WITH s AS (SELECT batch_id, status, count(*) AS n, count(*) FILTER (WHERE is_evaluated) AS e, count(*) FILTER (WHERE review_decision = 'pending') AS w FROM proposals GROUP BY ALL)
    SELECT batch_id, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status, CAST(sum(n) AS BIGINT) AS total,
           CAST(sum(e) AS BIGINT) AS evaluated, CAST(sum(w) AS BIGINT) AS awaiting,
           CAST(coalesce(sum(n) FILTER (WHERE status = 'failed'), 0) AS BIGINT) AS failed,
           CAST(coalesce(sum(n) FILTER (WHERE status NOT IN ('queued', 'evaluated', 'skipped', 'failed', 'pending_review')), 0) AS BIGINT) AS in_progress FROM s GROUP BY batch_id""")
def a21_batch_state(a: Archive) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return A.batch_state(a.proposals).withColumn("by_status", shown)


@query("""SELECT batch_id, count(*) FILTER (WHERE review_decision = 'approved_for_eval' AND NOT is_evaluated) AS ready, count(*) FILTER (WHERE review_decision = 'pending') AS blocked,
    count(*) FILTER (WHERE review_decision = 'skipped_duplicate') AS skipped, count(*) FILTER (WHERE is_evaluated) AS already FROM proposals GROUP BY batch_id""")
def a22_batch_partition(a: Archive) -> DataFrame:
    return A.batch_partition(a.proposals)


@query(f"""WITH ids AS (SELECT proposal_id * 2 AS proposal_id FROM proposals), r AS (SELECT proposal_id, {ELIGIBLE.format(forced=chr(10) + ' WHEN is_evaluated THEN ' + repr('Already evaluated'))} AS why FROM proposals)
    SELECT coalesce(CASE WHEN r.proposal_id IS NULL THEN 'Not found' ELSE why END, 'queued') AS outcome, count(*) AS n FROM ids LEFT JOIN r USING (proposal_id) GROUP BY 1""")
def a24_bulk_report(a: Archive) -> DataFrame:
    ids = a.proposals.select((F.col("proposal_id") * 2).alias("proposal_id"))
    rows = A.bulk_report(ids, a.proposals, L.ineligible())
    return rows.groupBy(F.coalesce("reason", F.lit("queued")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, doc_id % 20 AS batch_id, min(doc_id) OVER (PARTITION BY md5(text)) AS c FROM documents)
    SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE c = doc_id) AS accepted, count(*) FILTER (WHERE c <> doc_id) AS duplicates FROM d GROUP BY batch_id""")
def a25_upload_report(a: Archive) -> DataFrame:
    rows = L.exact_duplicates(a.texts, "doc_id", F.sha2("text", 256))
    return A.upload_report(rows.select(F.col("doc_id").alias("id"), "canonical_id", (F.col("doc_id") % 20).alias("batch_id")))
