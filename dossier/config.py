"""Config tables: the rubric, the section taxonomy, stages, bands and pairs, as plain values and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lifecycle stages in order.
STAGES = ("uploaded", "extracting", "extracted", "metadata_ready", "pending_review", "queued", "evaluating", "evaluated", "skipped", "failed")
# Half-open score bands and their labels.
BANDS = ((0, 40, "0-40"), (40, 55, "40-55"), (55, 70, "55-70"), (70, 85, "70-85"), (85, 101, "85-100"))
# Decisions that approve, and the whole vocabulary.
APPROVING = ("approved", "selected_for_funding")
VERBS = ("approved", "rejected", "selected_for_funding", "unselected")
# Parameter, label, weight, sections in reading order, question prefix and how many questions.
RUBRIC = (
    ("problem_relevance", "Problem & Relevance", 0.15, ("problem", "vision", "adoption"), "pr", 4),
    ("solution_readiness", "Solution & Technology Readiness", 0.20, ("solution", "pilot", "compliance"), "sr", 5),
    ("pilot_design", "Pilot Design & Feasibility", 0.20, ("pilot", "financial", "adoption"), "pd", 5),
    ("farmer_adoption", "Farmer Adoption & Inclusion", 0.15, ("adoption", "business_model", "problem"), "fa", 5),
    ("scaleup", "Business Model & Scale-up", 0.15, ("business_model", "financial", "solution"), "su", 5),
    ("team_capacity", "Team & Capacity", 0.10, ("team", "identity"), "tc", 4),
    ("compliance", "Compliance & Governance", 0.05, ("compliance", "solution"), "cp", 4),
)
# Pairs of parameters that must not lie GAP apart; other debate thresholds.
CONFLICT_PAIRS = (("scaleup", "farmer_adoption"), ("solution_readiness", "pilot_design"), ("pilot_design", "team_capacity"), ("solution_readiness", "problem_relevance"))
SPREAD, HIGH_WITH_FLAG, GAP = 30.0, 70.0, 25.0
# Section keys in order, with their keywords.
TAXONOMY = (
    ("identity", ("name", "email", "contact", "phone", "mobile", "address", "website", "entity", "type", "registration", "incorporation", "cin", "dipp", "startup name", "company name", "applicant", "authorized person", "application track")),
    ("problem", ("problem", "challenge", "pain point", "need", "relevance", "context", "motivation", "issue")),
    ("solution", ("solution", "technology", "technical", "innovation", "trl", "readiness", "product", "platform", "architecture", "algorithm", "machine learning", "patent", "intellectual property", "prototype", "data source", "approach")),
    ("pilot", ("pilot", "workplan", "work plan", "milestone", "timeline", "schedule", "deliverable", "implementation", "deployment", "rollout", "duration", "risk", "mitigation", "feasibility", "district", "phase")),
    ("financial", ("financial", "budget", "cost", "funding", "investment", "capital", "expenditure", "unit economics", "margin", "valuation", "projection", "grant", "fund", "expense", "outlay")),
    ("business_model", ("business model", "revenue", "pricing", "price", "market", "customer", "traction", "go-to-market", "gtm", "commercial", "monetisation", "monetization", "scale", "scalability", "scale-up", "growth", "sustainability", "partnership", "sales")),
    ("adoption", ("farmer", "adoption", "beneficiary", "benefit", "affordability", "training", "capacity building", "extension", "gender", "inclusion", "women", "youth", "smallholder", "outreach", "awareness")),
    ("team", ("team", "founder", "co-founder", "employee", "staff", "personnel", "leadership", "management", "advisor", "credential", "qualification", "experience", "background", "organisation", "organization", "cv", "resume", "profile")),
    ("compliance", ("compliance", "dpdp", "privacy", "data protection", "governance", "regulation", "regulatory", "legal", "certification", "standard", "ethic", "safety", "responsible ai", "consent", "security", "audit")),
    ("vision", ("vision", "mission", "objective", "goal", "aim", "impact", "outcome", "strategic", "significance", "purpose", "about us", "overview", "executive summary", "introduction", "synopsis")),
)
# Patterns that mark financial and technical text (two different ones are needed).
FINANCIAL = (r"\$\d", "revenue", "profit", "cost", "budget", "funding", "investment", r"roi\b", "burn rate", "valuation", "arpu", r"cac\b", r"ltv\b", r"mrr\b", r"arr\b", "unit economics", "financial", "capital", "expenditure", "margin")
TECHNICAL = (r"api\b", "cloud", "architecture", "database", "algorithm", "machine learning", r"ml\b", r"ai\b", "infrastructure", "scalab", "microservice", "docker", "kubernetes", "framework", "technology", "platform", "integration", "deploy", "devops", "pipeline", r"iot\b", "sensor")
# Words that say nothing about who an organisation is.
SUFFIXES = ("pvt", "private", "ltd", "limited", "llp", "inc", "incorporated", "corp", "corporation", "co", "company", "technologies", "technology", "tech", "solutions", "labs", "laboratories", "industries", "enterprises", "ventures", "innovations", "agritech", "agro")
# File formats that are taken, and the largest size.
FORMATS = ("pdf", "docx", "doc", "pptx", "ppt", "txt", "png", "jpg", "jpeg", "tiff", "bmp")
# The format that a media type stands for, where a name has no extension.
MEDIA_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.ms-powerpoint": "ppt",
    "text/plain": "txt",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/tiff": "tiff",
    "image/bmp": "bmp",
}
MAX_BYTES = 50 * 1024 * 1024


def rubric_table(spark: SparkSession) -> DataFrame:
    """One row a question: ordinal, parameter, label, weight, sections, question_id. The weights must add up to 1."""
    if abs(sum(r[2] for r in RUBRIC) - 1) > 1e-9:
        raise ValueError("the rubric's weights must add up to 1")
    rows = [(i, key, label, weight, list(sections), f"{prefix}{n}") for i, (key, label, weight, sections, prefix, count) in enumerate(RUBRIC) for n in range(1, count + 1)]
    return spark.createDataFrame(rows, "ordinal int, parameter string, label string, weight double, sections array<string>, question_id string")


def taxonomy_table(spark: SparkSession, taxonomy=TAXONOMY) -> DataFrame:
    """One row a keyword: section, position, keyword, weight (its words)."""
    rows = [(key, i, word, float(len(word.split()))) for i, (key, words) in enumerate(taxonomy) for word in words]
    return spark.createDataFrame(rows, "section string, position int, keyword string, weight double")
