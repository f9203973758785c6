"""The duplicate gate, interning and decisions over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Archive
from ..functions.text import normalize_company, slugify
from ..operators import decisions as G
from ..operators import dedup as D
from ..operators import listing as L
from ..registry import query
from .analytics import APPROVED, MATCHES, gate_matches
from .relational import newest_run

DOT = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
NEAR = f"""SELECT id, matched, similarity, place FROM (
    SELECT x.vec_id AS id, y.vec_id AS matched, round({DOT}, 4) AS similarity, CAST(row_number() OVER (PARTITION BY x.vec_id ORDER BY {DOT} DESC, y.vec_id) AS INT) AS place
    FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND {DOT} >= 0.3) WHERE place <= 5"""


@query(f"SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 4) AS before, 1.0::DOUBLE AS after FROM embeddings")
def d0_unit_normalise(a: Archive) -> DataFrame:
    unit = D.unit_normalise(F.col("vec"))
    return a.vectors.select("id", F.round(F.sqrt(D.dot(F.col("vec"), F.col("vec"))), 4).alias("before"), F.round(F.sqrt(D.dot(unit, unit)), 4).alias("after"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) <> doc_id AS duplicate FROM documents")
def d1_dedup_exact(a: Archive) -> DataFrame:
    return L.exact_duplicates(a.texts, "doc_id", F.sha2("text", 256)).select("doc_id", (F.col("canonical_id") != F.col("doc_id")).alias("duplicate"))


@query(NEAR)
def j6_knn_cosine(a: Archive) -> DataFrame:
    return D.knn_cosine(a.vectors, a.vectors, k=5, threshold=0.3)


@query(f"""WITH m AS ({NEAR}) SELECT v.vec_id AS id, m.matched, m.similarity, CASE WHEN m.id IS NULL THEN 'queued' ELSE 'pending_review' END AS status,
    CASE WHEN m.id IS NULL THEN 'approved_for_eval' ELSE 'pending' END AS review_decision FROM embeddings v LEFT JOIN m ON v.vec_id = m.id AND m.place = 1""")
def d2_similarity_gate(a: Archive) -> DataFrame:
    return D.similarity_gate(a.vectors, D.knn_cosine(a.vectors, a.vectors, threshold=0.3))


@query(f"""WITH m AS ({NEAR}) SELECT m.id, m.matched, CAST(floor(similarity * 100 + 0.5) AS BIGINT) || '% similar;' || CASE WHEN x.label = y.label THEN 'Same organisation' ELSE 'Different organisation' END || ';Category: kind ' || m.matched % 5
    || CASE WHEN m.matched % 2 = 0 THEN ';Already evaluated' ELSE '' END AS reasons FROM m JOIN embeddings x ON x.vec_id = m.id JOIN embeddings y ON y.vec_id = m.matched""")
def d3_match_reasons(a: Archive) -> DataFrame:
    near = D.knn_cosine(a.vectors, a.vectors, threshold=0.3)
    rows = a.vectors.select("id", "company", F.concat(F.lit("kind "), (F.col("id") % 5).cast("string")).alias("category"), (F.col("id") % 2 == 0).alias("evaluated"))
    pairs = L.match_pairs(near.select(F.col("id").alias("a"), F.col("matched").alias("b"), "similarity"), rows, "id", ("company", "category", "evaluated"))
    return D.match_reasons(pairs).select(F.col("a").alias("id"), F.col("b").alias("matched"), F.array_join("reasons", ";").alias("reasons"))


@query(f"WITH m AS ({NEAR}) SELECT m.id AS a, m.matched AS b, similarity, x.label AS company_a, y.label AS company_b FROM m JOIN embeddings x ON x.vec_id = m.id JOIN embeddings y ON y.vec_id = m.matched")
def j4_match_pairs(a: Archive) -> DataFrame:
    near = D.knn_cosine(a.vectors, a.vectors, threshold=0.3).select(F.col("id").alias("a"), F.col("matched").alias("b"), "similarity")
    return L.match_pairs(near, a.vectors, "id", ("company",))


@query(f"""WITH m AS ({MATCHES}), n AS (SELECT proposal_id, proposal_id + 1 + proposal_id % 2 AS matched_id FROM m)
    SELECT proposal_id, matched_id, status FROM m UNION ALL SELECT DISTINCT proposal_id, matched_id, 'pending' FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.proposal_id = n.proposal_id AND m.matched_id = n.matched_id)""")
def d4_record_matches(a: Archive) -> DataFrame:
    old = gate_matches(a)
    return D.record_matches(old, old.select("proposal_id", (F.col("proposal_id") + 1 + F.col("proposal_id") % 2).alias("matched_id")))


RULINGS = "SELECT proposal_id, CASE WHEN proposal_id % 5 < 2 THEN 'evaluate' ELSE 'skip' END AS ruling FROM proposals WHERE status = 'pending_review' AND proposal_id % 5 <> 4"


@query(f"""WITH m AS ({MATCHES}), r AS ({RULINGS}) SELECT m.proposal_id, CASE WHEN status = 'pending' AND ruling = 'evaluate' THEN 'dismissed' WHEN status = 'pending' AND ruling = 'skip' THEN 'confirmed_duplicate' ELSE status END AS match_status,
    p.status2 AS status FROM m LEFT JOIN r USING (proposal_id) JOIN (SELECT p.proposal_id, CASE ruling WHEN 'evaluate' THEN 'queued' WHEN 'skip' THEN 'skipped' ELSE p.status END AS status2 FROM proposals p LEFT JOIN r ON r.proposal_id = p.proposal_id) p ON p.proposal_id = m.proposal_id""")
def d5_resolve_reviews(a: Archive) -> DataFrame:
    held = a.proposals.where("status = 'pending_review' AND proposal_id % 5 <> 4")
    rulings = held.select("proposal_id", F.when(F.col("proposal_id") % 5 < 2, "evaluate").otherwise("skip").alias("ruling"))
    p, m = D.resolve_reviews(a.proposals, gate_matches(a), rulings)
    return m.select("proposal_id", F.col("status").alias("match_status")).join(p.select("proposal_id", "status"), "proposal_id")


#: Rulings on proposals and on ids that are there or not; every fifth takes a ruling back.
RULED = f"""r AS (SELECT proposal_id * 2 AS proposal_id, proposal_id % 5 > 0 AS is_duplicate, CASE WHEN proposal_id % 7 > 0 THEN proposal_id + proposal_id % 3 END AS original_id FROM proposals),
    w AS (SELECT r.*, CASE WHEN p.proposal_id IS NULL THEN 'Not found' WHEN is_duplicate AND p.is_evaluated THEN 'Already evaluated' WHEN is_duplicate AND r.original_id IS NOT NULL AND o.proposal_id IS NULL THEN 'Original not found'
        WHEN is_duplicate AND r.original_id = r.proposal_id THEN 'Same proposal' END AS reason FROM r LEFT JOIN proposals p ON p.proposal_id = r.proposal_id LEFT JOIN proposals o ON o.proposal_id = r.original_id),
    ok AS (SELECT * FROM w WHERE reason IS NULL), m AS ({MATCHES})"""


def _marked(a: Archive) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = F.col("proposal_id")
    rulings = a.proposals.select((p * 2).alias("proposal_id"), (p % 5 > 0).alias("is_duplicate"), F.when(p % 7 > 0, p + p % 3).alias("original_id"))
    return D.mark_duplicates(a.proposals, gate_matches(a), rulings)


@query(f"WITH {RULED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM w GROUP BY 1")
def d6_mark_duplicates(a: Archive) -> DataFrame:
    return _marked(a)[2].groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {RULED} SELECT p.proposal_id, CASE WHEN ok.proposal_id IS NULL THEN p.status WHEN is_duplicate THEN 'skipped' ELSE 'queued' END AS status,
    CASE WHEN ok.proposal_id IS NULL THEN p.review_decision WHEN is_duplicate THEN 'skipped_duplicate' ELSE 'approved_for_eval' END AS review_decision, CASE WHEN is_duplicate THEN original_id END AS duplicate_of_id
    FROM proposals p LEFT JOIN ok USING (proposal_id)""")
def d6_marked_proposals(a: Archive) -> DataFrame:
    return _marked(a)[0].select("proposal_id", "status", "review_decision", "duplicate_of_id")


@query(f"""WITH {RULED} SELECT m.proposal_id, m.matched_id, CASE WHEN m.status = 'pending' AND ok.proposal_id IS NOT NULL THEN CASE WHEN is_duplicate THEN 'confirmed_duplicate' ELSE 'dismissed' END ELSE m.status END AS status
    FROM m LEFT JOIN ok USING (proposal_id)""")
def d6_marked_matches(a: Archive) -> DataFrame:
    return _marked(a)[1]


SPELT = "'Client ' || lpad(CAST(company_id % 100 AS VARCHAR), 3, '0') || CASE company_id % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' PRIVATE LIMITED' WHEN 2 THEN ', Inc' ELSE '' END"


def spelt(a: Archive) -> DataFrame:
    """Organisations under a hundred names, each in four spellings."""
    suffix = F.when(F.col("company_id") % 4 == 0, " Pvt. Ltd.").when(F.col("company_id") % 4 == 1, " PRIVATE LIMITED").when(F.col("company_id") % 4 == 2, ", Inc").otherwise("")
    name = F.concat(F.lit("Client "), F.lpad((F.col("company_id") % 100).cast("string"), 3, "0"), suffix)
    return a.companies.select("company_id", name.alias("name"), F.when(F.col("company_id") % 3 == 0, F.concat(F.lit("mail"), F.col("company_id").cast("string"))).otherwise("").alias("email"))


@query("SELECT company_id, 'client ' || lpad(CAST(company_id % 100 AS VARCHAR), 3, '0') AS key FROM companies")
def x25_normalize_company(a: Archive) -> DataFrame:
    return spelt(a).select("company_id", normalize_company(F.col("name")).alias("key"))


@query("SELECT DISTINCT category, trim(regexp_replace(regexp_replace(lower(category), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', '-', 'g')) AS slug FROM proposals")
def x26_slugify(a: Archive) -> DataFrame:
    return a.proposals.select("category").distinct().select("category", slugify(F.col("category")).alias("slug"))


@query(f"""WITH s AS (SELECT company_id, {SPELT} AS name, CASE WHEN company_id % 3 = 0 THEN 'mail' || company_id ELSE '' END AS email, 'client ' || lpad(CAST(company_id % 100 AS VARCHAR), 3, '0') AS key, company_id % 10 < 5 AS old FROM companies)
    SELECT key, 'c-' || substr(sha256(key), 1, 16) AS id, arg_min(name, (CASE WHEN old THEN 0 ELSE 1 END) * 100000000 + company_id) AS name,
           arg_min(email, (CASE WHEN old THEN 0 ELSE 1 END) * 100000000 + company_id) FILTER (WHERE email <> '') AS email FROM s GROUP BY key""")
def d7_intern_companies(a: Archive) -> DataFrame:
    rows = spelt(a).withColumn("seen_at", F.col("company_id"))
    old, new = rows.where("company_id % 10 < 5").drop("company_id"), rows.where("company_id % 10 >= 5").drop("company_id")
    return D.intern_companies(old, new).select("key", "id", "name", "email")


@query("""SELECT key, 'k-' || substr(sha256(key), 1, 16) AS id, arg_min(category, proposal_id) AS name FROM (
    SELECT proposal_id, category, regexp_replace(regexp_replace(lower(category), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', '-', 'g') AS key FROM proposals) GROUP BY key""")
def d8_intern_categories(a: Archive) -> DataFrame:
    rows = a.proposals.select(F.col("category").alias("name"), F.col("proposal_id").alias("seen_at"))
    return D.intern_categories(rows.limit(0), rows).select("key", "id", "name")


@query(f"""WITH c AS (SELECT category, count(DISTINCT proposal_id) AS n FROM ({APPROVED}) GROUP BY 1), k AS (SELECT company_id, count(DISTINCT proposal_id) AS n FROM ({APPROVED}) GROUP BY 1)
    SELECT p.proposal_id, coalesce(c.n, 0) AS in_category, coalesce(k.n, 0) AS of_company FROM proposals p LEFT JOIN c USING (category) LEFT JOIN k ON k.company_id = p.company_id""")
def g1_conflicts(a: Archive) -> DataFrame:
    return G.conflicts(a.proposals, a.decisions).select("proposal_id", "in_category", "of_company")


def batch(a: Archive) -> DataFrame:
    """All proposals as candidates for approval; one in ten acknowledged. Categories are split by day, so that some are free."""
    category = F.concat("category", F.lit("/"), F.date_format("created_at", "yyyy-MM-dd"))
    return a.proposals.select("proposal_id", F.col("proposal_id").alias("seq"), F.lit("approved").alias("decision"), (F.col("proposal_id") % 10 == 0).alias("acknowledged"), "is_evaluated", category.alias("category"), "company_id")


@query()
def g2_decide_batch(a: Archive) -> DataFrame:
    return G.decide_batch(batch(a), a.decisions)


@query("SELECT d.proposal_id, coalesce(CASE WHEN d.proposal_id % 2 = 0 THEN d.category END, p.category) AS category, p.company_id, CAST(year(decided_at) AS INT) AS decision_year, CAST(month(decided_at) AS INT) AS decision_month FROM decisions d JOIN proposals p USING (proposal_id)")
def g3_freeze_dims(a: Archive) -> DataFrame:
    blank = a.decisions.withColumn("category", F.when(F.col("proposal_id") % 2 == 0, F.col("category"))).withColumn("company_id", F.lit(None).cast("bigint"))
    return G.freeze_dims(blank, a.proposals).select("proposal_id", "category", "company_id", "decision_year", "decision_month")


@query(f"""WITH k AS (SELECT company_id, count(DISTINCT proposal_id) AS n FROM ({APPROVED}) GROUP BY 1)
    SELECT p.proposal_id, 'decision_approved' AS action, CASE WHEN k.n > 0 THEN '{{"overridden":["category","company"]}}' ELSE '{{"overridden":["category"]}}' END AS payload FROM proposals p LEFT JOIN k ON k.company_id = p.company_id""")
def g4_override_audit(a: Archive) -> DataFrame:
    return G.override_audit(G.conflicts(a.proposals.withColumn("decision", F.lit("approved")), a.decisions))


@query()
def g5_funding(a: Archive) -> DataFrame:
    """All proposals with a selection in the ledger's place; selecting goes through the conflict check."""
    return G.funding(batch(a), a.decisions.where("decision = 'selected_for_funding'"), a.decisions.where("decision = 'approved'"))


@query("""WITH h AS (SELECT proposal_id, count(*) AS runs, max(created_at) AS latest FROM evaluations GROUP BY 1), d AS (SELECT proposal_id, max(decided_at) AS decided_at, count(*) AS decisions FROM decisions GROUP BY 1)
    SELECT p.proposal_id, p.status, coalesce(h.runs, 0) AS runs, h.latest, coalesce(d.decisions, 0) AS decisions, d.decided_at FROM proposals p LEFT JOIN h USING (proposal_id) LEFT JOIN d USING (proposal_id)""")
def g6_proposal_detail(a: Archive) -> DataFrame:
    history = L.run_history(a.evaluations, "proposal_id", *newest_run()).groupBy("proposal_id").agg(F.count("*").alias("runs"), F.max(F.when(F.col("position") == 1, F.col("created_at"))).alias("latest"))
    ruled = a.decisions.groupBy("proposal_id").agg(F.count("*").alias("decisions"), F.max("decided_at").alias("decided_at"))
    out = a.proposals.join(history, "proposal_id", "left").join(ruled, "proposal_id", "left")
    return out.select("proposal_id", "status", F.coalesce("runs", F.lit(0)).alias("runs"), "latest", F.coalesce("decisions", F.lit(0)).alias("decisions"), "decided_at")
