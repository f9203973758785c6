"""Sources, filters, sorts and joins over the archive."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..bindings import Archive
from ..operators import listing as L
from ..registry import query
from ..session import shared_dir
from ..sources import files, tables

ELIGIBLE = """CASE WHEN review_decision = 'pending' THEN 'Awaiting duplicate review'
    WHEN review_decision = 'skipped_duplicate' THEN 'Ruled a duplicate' {forced}
    WHEN status IN ('uploaded', 'extracting', 'extracted') THEN 'Still in processing'
    WHEN status = 'failed' THEN 'Processing failed' END"""
NEWEST = "created_at DESC, line DESC, part_id DESC, supp_id DESC, score DESC, tokens DESC, duration_ms DESC, coverage DESC"


def newest_run():
    return [F.desc(c.split()[0]) for c in NEWEST.split(", ")]


@query("SELECT proposal_id, status, latest_score FROM proposals")
def s4_load_tables(a: Archive) -> DataFrame:
    return a.proposals.select("proposal_id", "status", "latest_score")


@query("""SELECT filename AS name, proposal_id % 60000000 AS size, CASE
    WHEN lower(split_part(filename, '.', -1)) NOT IN ('pdf','docx','doc','pptx','ppt','txt','png','jpg','jpeg','tiff','bmp') THEN 'Unsupported format'
    WHEN proposal_id % 60000000 = 0 THEN 'Empty file' WHEN proposal_id % 60000000 > 52428800 THEN 'File too large' END AS reason FROM proposals""")
def s2_validate_files(a: Archive) -> DataFrame:
    return files.validate_files(a.proposals.select(F.col("filename").alias("name"), (F.col("proposal_id") % 60000000).alias("size")))


@query()
def s1_read_files(a: Archive) -> DataFrame:
    """The files of the given tables and what identifies them."""
    return files.identify_files(a.spark, f"{a.dir}/*.parquet").select("name", "size", "sha256")


def _with_bad_bytes(a: Archive) -> DataFrame:
    """Texts as bytes, one of which is wrong."""
    return a.texts.select("doc_id", F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("20C3A9FF20656E64"))).alias("content"))


@query("SELECT doc_id, sha256(text || ' é' || chr(65533) || ' end') AS digest FROM documents")
def s3_decode_text(a: Archive) -> DataFrame:
    return _with_bad_bytes(a).select("doc_id", F.sha2(files.decoded(F.col("content")), 256).alias("digest"))


@query()
def s3_read_text(a: Archive) -> DataFrame:
    """Decoded and cleaned; SQL has no such normal form."""
    return files.read_text(_with_bad_bytes(a)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT CAST(year(decided_at) AS INT) AS decision_year, CAST(month(decided_at) AS INT) AS decision_month, decision, count(*) AS n, CAST(sum(proposal_id) AS BIGINT) AS ids FROM decisions GROUP BY ALL")
def s6_append_ledger(a: Archive) -> DataFrame:
    """The ledger after two appends."""
    path = f"{shared_dir(a.spark)}/ledger-{uuid.uuid4().hex}"
    for rows in (a.decisions.where("decision = 'approved'"), a.decisions.where("decision <> 'approved'")):
        tables.append_ledger(rows, path)
    return a.spark.read.parquet(path).groupBy("decision_year", "decision_month", "decision").agg(F.count("*").alias("n"), F.sum("proposal_id").cast("bigint").alias("ids"))


@query("SELECT proposal_id, status, error_stage FROM proposals WHERE status IN ('failed', 'skipped')")
def s7_append_audit(a: Archive) -> DataFrame:
    """The audit rows after an append for failures and one for skipped proposals."""
    path = f"{shared_dir(a.spark)}/audit-{uuid.uuid4().hex}"
    for status in ("failed", "skipped"):
        tables.append_audit(a.proposals.where(F.col("status") == status).select("proposal_id", "status", "error_stage"), path)
    return a.spark.read.parquet(path)


@query("""SELECT proposal_id, CASE WHEN proposal_id % 3 = 0 THEN NULL ELSE status END AS status,
    CASE WHEN proposal_id % 3 = 0 THEN 9 ELSE retry_count END AS retry_count FROM proposals""")
def s5_apply_patch(a: Archive) -> DataFrame:
    base = a.proposals.select("proposal_id", "status", "retry_count")
    patch = base.where("proposal_id % 3 = 0").select("proposal_id", F.lit(None).cast("string").alias("status"), F.lit(9).alias("retry_count"), F.lit(1).alias("unknown"), F.array(F.lit("status"), F.lit("retry_count")).alias("fields"))
    return tables.apply_patch(base, patch, "proposal_id")


@query("""SELECT 'proposals' AS name, count(*) AS n FROM proposals WHERE proposal_id % 7 <> 0
    UNION ALL SELECT 'evaluations', count(*) FROM evaluations WHERE proposal_id % 7 <> 0
    UNION ALL SELECT 'decisions', count(*) FROM decisions WHERE proposal_id % 7 <> 0
    UNION ALL SELECT 'matches', count(*) FROM proposals WHERE proposal_id % 7 <> 0 AND (proposal_id + 1) % 7 <> 0""")
def s8_cascade_delete(a: Archive) -> DataFrame:
    matches = a.proposals.select("proposal_id", (F.col("proposal_id") + 1).alias("matched_id"))
    # ids past the table, so that matches with absent partners lose them too
    ids = a.proposals.where("proposal_id % 7 = 0").select("proposal_id").unionAll(a.proposals.where("(proposal_id + 1) % 7 = 0").select(F.col("proposal_id") + 1))
    kept = tables.cascade_delete(a.proposals, a.evaluations, a.decisions, matches, ids)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("proposals", "evaluations", "decisions", "matches"), kept)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY {NEWEST}) AS place FROM evaluations WHERE status = 'completed')
    SELECT p.proposal_id, coalesce(p.latest_score, r.score) AS latest_score, CASE WHEN p.latest_score IS NULL AND r.place = 1 THEN r.recommendation ELSE p.latest_recommendation END AS latest_recommendation,
           CASE WHEN p.latest_score IS NULL AND r.place = 1 THEN r.run_id ELSE p.latest_evaluation_id END AS latest_evaluation_id,
           CASE WHEN p.latest_score IS NULL AND r.place = 1 THEN coalesce(r.completed_at, r.created_at) ELSE p.evaluated_at END AS evaluated_at
    FROM proposals p LEFT JOIN r ON p.proposal_id = r.proposal_id AND r.place = 1""")
def s9_backfill_verdict(a: Archive) -> DataFrame:
    newest = L.latest_per_key(a.evaluations.where("status = 'completed'"), "proposal_id", *newest_run())
    return tables.backfill_verdict(a.proposals, newest).select("proposal_id", *tables.VERDICT)


@query("SELECT proposal_id, status, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DOUBLE) AS confidence FROM proposals")
def s10_widen_schema(a: Archive) -> DataFrame:
    extra = T.StructType().add("status", T.IntegerType()).add("note", T.StringType()).add("confidence", T.DoubleType())
    return tables.widen_schema(a.proposals.select("proposal_id", "status"), extra)


@query("SELECT proposal_id, status FROM proposals WHERE status IN ('failed', 'queued')")
def f1_status_in(a: Archive) -> DataFrame:
    return L.status_in(a.proposals, " failed, ,queued,").select("proposal_id", "status")


@query("SELECT proposal_id FROM proposals WHERE category = '1-URGENT' AND is_evaluated")
def f2_eq_filters(a: Archive) -> DataFrame:
    return L.eq_filters(a.proposals, category="1-URGENT", is_evaluated=True, batch_id=None).select("proposal_id")


@query("SELECT proposal_id, review_decision FROM proposals WHERE review_decision <> 'skipped_duplicate'")
def f3_exclude_duplicates(a: Archive) -> DataFrame:
    return L.exclude_duplicates(a.proposals).select("proposal_id", "review_decision")


@query("SELECT proposal_id, pattern FROM proposals, (VALUES ('L 1_0'), ('District 1')) v(pattern) WHERE lower(title) LIKE '%' || lower(pattern) || '%' OR lower(filename) LIKE '%' || lower(pattern) || '%' OR lower(problem_statement) LIKE '%' || lower(pattern) || '%'")
def f4_search(a: Archive) -> DataFrame:
    found = [L.search(a.proposals, p).select("proposal_id", F.lit(p).alias("pattern")) for p in ("L 1_0", "District 1")]
    return found[0].unionAll(found[1])


LABEL = "CASE category WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Not Specified' WHEN '5-LOW' THEN 'Low' END"


@query(f"""SELECT proposal_id, title, filename, status, review_decision, latest_score, name AS company_name, {LABEL} AS category_label, batch_id
    FROM proposals LEFT JOIN companies USING (company_id)""")
def f5_listing_projection(a: Archive) -> DataFrame:
    return L.listing_projection(a.proposals, a.companies, a.categories)


@query("SELECT proposal_id, status FROM proposals WHERE NOT is_evaluated AND review_decision <> 'skipped_duplicate'")
def f6_working_list(a: Archive) -> DataFrame:
    return L.working_list(a.proposals).select("proposal_id", "status")


@query("SELECT proposal_id FROM proposals WHERE review_decision = 'pending' AND status = 'pending_review'")
def f7_review_queue(a: Archive) -> DataFrame:
    return L.review_queue(a.proposals).select("proposal_id")


@query("SELECT proposal_id, retry_count, retry_count < 3 AS can_retry FROM proposals WHERE status = 'failed'")
def f8_retry_queue(a: Archive) -> DataFrame:
    return L.retry_queue(a.proposals).select("proposal_id", "retry_count", "can_retry")


@query(f"SELECT proposal_id, {ELIGIBLE.format(forced=chr(10) + ' WHEN is_evaluated THEN ' + repr('Already evaluated'))} AS reason, {ELIGIBLE.format(forced='')} AS forced_reason FROM proposals")
def f9_eligibility(a: Archive) -> DataFrame:
    return a.proposals.select("proposal_id", L.ineligible().alias("reason"), L.ineligible(force=True).alias("forced_reason"))


@query("SELECT proposal_id, latest_score FROM proposals WHERE proposal_id IN (SELECT proposal_id FROM evaluations WHERE tokens > 90000)")
def f10_by_ids(a: Archive) -> DataFrame:
    return L.by_ids(a.proposals, a.evaluations.where("tokens > 90000")).select("proposal_id", "latest_score")


@query("SELECT proposal_id, created_at, line FROM evaluations WHERE status = 'processing' AND created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 30 MINUTE")
def f11_stale_runs(a: Archive) -> DataFrame:
    return L.stale_runs(a.evaluations, "1998-06-01 00:00:00").select("proposal_id", "created_at", "line")


@query("SELECT proposal_id, created_at, score FROM evaluations WHERE status = 'failed'")
def f12_evaluations_list(a: Archive) -> DataFrame:
    return L.newest_first(L.eq_filters(a.evaluations, status="failed"), "created_at", "proposal_id").select("proposal_id", "created_at", "score")


@query("SELECT proposal_id, l AS line FROM (SELECT proposal_id, parameter AS l FROM answers GROUP BY ALL) WHERE l <> 1")
def f14_scoreable_sections(a: Archive) -> DataFrame:
    from ..operators.sections import scoreable_sections

    keys = F.when(F.col("parameter") == 1, "identity").otherwise(F.col("parameter").cast("string"))
    parts = a.answers.select("proposal_id", keys.alias("section")).distinct()
    return scoreable_sections(parts).select("proposal_id", F.col("section").cast("int").alias("line"))


@query("""SELECT proposal_id, latest_score, CAST(row_number() OVER (ORDER BY latest_score ASC NULLS LAST, created_at DESC, proposal_id DESC) AS INT) AS position FROM proposals
    ORDER BY position LIMIT 200""")
def o1_sort_listing(a: Archive) -> DataFrame:
    first = L.sort_listing(a.proposals, "score", descending=False).limit(200)  # the feature: a page of a sorted list
    order = [F.col("latest_score").asc_nulls_last(), F.desc("created_at"), F.desc("proposal_id")]
    from pyspark.sql import Window as W

    return first.select("proposal_id", "latest_score", F.row_number().over(W.orderBy(*order)).alias("position"))


@query("""SELECT 'words' AS by, proposal_id FROM (SELECT proposal_id FROM proposals ORDER BY total_words DESC NULLS LAST, created_at DESC, proposal_id DESC LIMIT 50)
    UNION ALL SELECT 'evaluated_at', proposal_id FROM (SELECT proposal_id FROM proposals ORDER BY evaluated_at DESC NULLS LAST, created_at DESC, proposal_id DESC LIMIT 50)
    UNION ALL SELECT 'updated_at', proposal_id FROM (SELECT proposal_id FROM proposals ORDER BY updated_at DESC NULLS LAST, created_at DESC, proposal_id DESC LIMIT 50)
    UNION ALL SELECT 'pages', proposal_id FROM (SELECT proposal_id FROM proposals ORDER BY total_pages DESC NULLS LAST, created_at DESC, proposal_id DESC LIMIT 50)
    UNION ALL SELECT 'latest_score', proposal_id FROM (SELECT proposal_id FROM proposals ORDER BY created_at DESC, proposal_id DESC LIMIT 50)""")
def o1_sort_keys(a: Archive) -> DataFrame:
    """First pages by other keys; a name that is no key sorts by creation."""
    pages = [L.sort_listing(a.proposals, by).limit(50).select(F.lit(by).alias("by"), "proposal_id") for by in ("words", "evaluated_at", "updated_at", "pages", "latest_score")]
    return reduce(DataFrame.unionAll, pages)


@query("""SELECT proposal_id, CAST((SELECT count(*) FROM proposals) AS BIGINT) AS total, CAST(ceil((SELECT count(*) FROM proposals) / 25.0) AS BIGINT) AS pages
    FROM (SELECT proposal_id FROM proposals ORDER BY created_at DESC, proposal_id DESC LIMIT 25 OFFSET 50)""")
def o3_page(a: Archive) -> DataFrame:
    rows, total, pages = L.page(L.sort_listing(a.proposals), 3, 25)
    return rows.select("proposal_id", F.lit(total).cast("bigint").alias("total"), F.lit(pages).cast("bigint").alias("pages"))


@query("""SELECT proposal_id, latest_score FROM proposals p WHERE latest_score IS NOT NULL AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.proposal_id = p.proposal_id)
    ORDER BY latest_score DESC, proposal_id LIMIT 10""")
def o4_top_k(a: Archive) -> DataFrame:
    return L.top_k(a.proposals, a.decisions).select("proposal_id", "latest_score")


@query(f"SELECT proposal_id, score, tokens FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY {NEWEST}) AS place FROM evaluations WHERE status = 'completed') WHERE place = 1")
def o5_latest_per_key(a: Archive) -> DataFrame:
    return L.latest_per_key(a.evaluations.where("status = 'completed'"), "proposal_id", *newest_run()).select("proposal_id", "score", "tokens")


@query(f"SELECT proposal_id, score, CAST(row_number() OVER (PARTITION BY proposal_id ORDER BY {NEWEST}) AS INT) AS position FROM evaluations")
def o6_run_history(a: Archive) -> DataFrame:
    return L.run_history(a.evaluations, "proposal_id", *newest_run()).select("proposal_id", "score", "position")


@query(f"SELECT category, {LABEL} AS label FROM proposals GROUP BY ALL ORDER BY label")
def o8_list_categories(a: Archive) -> DataFrame:
    return L.by_ids(a.categories, a.proposals, "category").orderBy("label")


@query(f"SELECT proposal_id, name AS company_name, {LABEL} AS category_label FROM proposals LEFT JOIN (SELECT * FROM companies WHERE company_id % 5 <> 0) USING (company_id)")
def j1_with_dims(a: Archive) -> DataFrame:
    return L.with_dims(a.proposals, a.companies.where("company_id % 5 <> 0"), a.categories).select("proposal_id", "company_name", "category_label")


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN category <> '5-LOW' THEN category END AS category FROM decisions) WHERE category IS NOT NULL GROUP BY category")
def j2_inner_dim_join(a: Archive) -> DataFrame:
    blanked = a.decisions.withColumn("category", F.when(F.col("category") != "5-LOW", F.col("category")))
    return blanked.join(a.categories, "category").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT proposal_id FROM proposals WHERE proposal_id NOT IN (SELECT proposal_id FROM decisions)")
def j3_anti_join(a: Archive) -> DataFrame:
    return a.proposals.join(a.decisions.select("proposal_id"), "proposal_id", "left_anti").select("proposal_id")


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical_id FROM documents""")
def j5_exact_duplicates(a: Archive) -> DataFrame:
    return L.exact_duplicates(a.texts, "doc_id", F.sha2("text", 256))


@query("""WITH q AS (SELECT DISTINCT parameter, question FROM answers), p AS (SELECT DISTINCT proposal_id FROM answers)
    SELECT p.proposal_id, q.parameter, q.question, a.raw_score, coalesce(a.evidenced, false) AS evidenced
    FROM p CROSS JOIN q LEFT JOIN answers a ON a.proposal_id = p.proposal_id AND a.parameter = q.parameter AND a.question = q.question""")
def j8_questions_and_answers(a: Archive) -> DataFrame:
    from ..operators.scoring import asked

    questions = a.answers.select("parameter", "question").distinct()
    return asked(a.answers.select("proposal_id").distinct(), questions, a.answers.select("proposal_id", "parameter", "question", "raw_score", "evidenced"))


