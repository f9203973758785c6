"""Scores of the archive's answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Archive
from ..config import CONFLICT_PAIRS, RUBRIC, rubric_table
from ..functions.hooks import answer
from ..operators import listing as L
from ..operators import scoring as R
from ..registry import query
from ..sources.tables import VERDICT
from .relational import NEWEST, newest_run

WEIGHTS = ", ".join(f"({i + 1}, {r[2]}, '{r[1]}')" for i, r in enumerate(RUBRIC))
NUMBER = {r[0]: i + 1 for i, r in enumerate(RUBRIC)}
PAIRS = ", ".join(f"({NUMBER[a]}, {NUMBER[b]})" for a, b in CONFLICT_PAIRS)
PARAMETERS = """SELECT a.proposal_id, a.parameter,
        CASE WHEN max(f.parameter) IS NULL THEN round(CAST(sum(CASE WHEN evidenced THEN CAST(raw_score AS DECIMAL(20,4)) END) AS DOUBLE) / count(CASE WHEN evidenced THEN 1 END) * 10, 2) END AS score,
        count(CASE WHEN evidenced THEN 1 END) AS evidenced, count(*) AS asked, count(*) FILTER (WHERE red_flag) AS red_flags,
        CASE WHEN max(f.parameter) IS NOT NULL THEN 'failed' WHEN count(CASE WHEN evidenced THEN 1 END) = 0 THEN 'unevidenced' ELSE 'scored' END AS status
    FROM answers a LEFT JOIN failed_parameters f ON a.proposal_id = f.proposal_id AND a.parameter = f.parameter GROUP BY a.proposal_id, a.parameter"""
VERDICTS = f"""SELECT proposal_id,
        coalesce(round(CAST(sum(CASE WHEN status = 'scored' THEN CAST(score AS DECIMAL(12,4)) * CAST(weight AS DECIMAL(10,4)) END) AS DOUBLE) / CAST(sum(CASE WHEN status = 'scored' THEN CAST(weight AS DECIMAL(10,4)) END) AS DOUBLE), 2), 0.0) AS weighted_score,
        coalesce(round(sum(CASE WHEN status <> 'failed' THEN evidenced END) / sum(CASE WHEN status <> 'failed' THEN asked END), 3), 0.0) AS coverage,
        coalesce(string_agg(CASE WHEN status = 'unevidenced' THEN label END, '|' ORDER BY label), '') AS unevidenced, coalesce(string_agg(CASE WHEN status = 'failed' THEN label END, '|' ORDER BY label), '') AS failed,
        count(*) FILTER (WHERE status = 'failed') > 0 AS is_partial
    FROM ({PARAMETERS}) JOIN (VALUES {WEIGHTS}) w(parameter, weight, label) USING (parameter) GROUP BY proposal_id"""


def weights(a: Archive) -> DataFrame:
    return a.spark.createDataFrame([(i + 1, r[2], r[1]) for i, r in enumerate(RUBRIC)], "parameter int, weight double, label string")


def scored_answers(a: Archive) -> DataFrame:
    return a.answers.withColumn("score", R.downgraded(F.col("raw_score"), F.col("evidenced"), F.lit(True)))


def parameters(a: Archive) -> DataFrame:
    return R.parameter_status(R.parameter_scores(scored_answers(a)), a.failed_parameters)


def verdicts(a: Archive) -> DataFrame:
    return R.verdicts(parameters(a), weights(a))


@query()
def r1_rubric_of_answers(a: Archive) -> DataFrame:
    """Answers beside the rubric's parameter and weight."""
    rubric = rubric_table(a.spark).select((F.col("ordinal") + 1).alias("parameter"), F.col("parameter").alias("name"), "weight").distinct()
    return a.answers.join(F.broadcast(rubric), "parameter").groupBy("parameter", "name", "weight").agg(F.count("*").alias("answers"))


@query("""SELECT doc_id, least(len(q), 5) AS citations, coalesce(length(q[1]), 0) AS first_length, sha256(coalesce(array_to_string(q[1:5], chr(10)), '')) AS digest FROM (
    SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 10), lambda x: substr(x, 1, 1200)) AS q FROM documents)""")
def r2_parse_citations(a: Archive) -> DataFrame:
    quotes = R.parse_citations(F.split("text", "\n"))
    first = F.coalesce(F.length(F.get(quotes, F.lit(0))), F.lit(0)).cast("bigint")
    return a.texts.select("doc_id", F.size(quotes).cast("bigint").alias("citations"), first.alias("first_length"), F.sha2(F.array_join(quotes, "\n"), 256).alias("digest"))


FOLD = "trim(regexp_replace(translate(lower({0}), '‘’“”–— ', '''''\"\"-- '), '\\s+', ' ', 'g'))"


@query(f"""WITH q AS MATERIALIZED (SELECT item_id, {FOLD.format('text')} AS quote FROM benchmark), t AS MATERIALIZED (SELECT doc_id, {FOLD.format('text')} AS body FROM documents)
    SELECT item_id, doc_id FROM q JOIN t ON contains(body, quote) WHERE length(quote) >= 10""")
def r3_find_quotes(a: Archive) -> DataFrame:
    return R.find_quotes(a.table("benchmark"), a.texts)


@query(f"""WITH t AS (SELECT doc_id, {FOLD.format('text')} AS body, {FOLD.format("coalesce(string_split(text, chr(10))[2], 'no such line in this text at all')")} AS quote FROM documents)
    SELECT doc_id, contains(body, quote) OR (length(substr(quote, 1, 80)) >= 40 AND contains(body, substr(quote, 1, 80))) AS grounded FROM t""")
def r3_ground_quotes(a: Archive) -> DataFrame:
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("no such line in this text at all"))
    return R.ground_quotes(a.texts.select("doc_id", second.alias("quote")), a.texts).select("doc_id", "grounded")


def first_words():
    """A stand-in for a reader that answers two questions about each text: one with the text's own first words, one with words of its own making."""

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["text"].notna()]
        own = pd.DataFrame({"doc_id": known["doc_id"], "question": 1, "raw_score": [str(len(t) % 14 - 2) for t in known["text"]], "quote": [t[:60] for t in known["text"]]})
        return pd.concat([own, own.assign(question=2, raw_score="9", quote="words that nobody has written anywhere")])

    return model


@query("""SELECT doc_id, CAST(1 AS INT) AS question, CAST(least(greatest(length(text) % 14 - 2, 0), 10) AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 2, CASE WHEN contains(lower(text), 'words that nobody has written anywhere') THEN 9.0 END::DOUBLE FROM documents WHERE text IS NOT NULL""")
def r4_answers_of_a_model(a: Archive) -> DataFrame:
    """A caller's answers: only those whose quote stands in the text keep their score."""
    given = answer(a.texts, first_words, "doc_id bigint, question int, raw_score string, quote string")
    checked = R.ground_quotes(given, a.texts)
    return checked.select("doc_id", "question", R.downgraded(F.col("raw_score"), F.lit(True), F.col("grounded")).alias("score"))


@query("SELECT proposal_id, parameter, question, CASE WHEN evidenced THEN least(greatest(raw_score, 0.0), 10.0) END AS score FROM answers")
def r4_downgrade(a: Archive) -> DataFrame:
    return scored_answers(a).select("proposal_id", "parameter", "question", "score")


@query(f"SELECT proposal_id, parameter, round(CAST(sum(CASE WHEN evidenced THEN CAST(raw_score AS DECIMAL(20,4)) END) AS DOUBLE) / count(CASE WHEN evidenced THEN 1 END) * 10, 2) AS score FROM answers GROUP BY ALL")
def r5_parameter_scores(a: Archive) -> DataFrame:
    return R.parameter_scores(scored_answers(a)).select("proposal_id", "parameter", "score")


@query(f"SELECT proposal_id, parameter, score, status FROM ({PARAMETERS})")
def r6_parameter_status(a: Archive) -> DataFrame:
    return parameters(a).select("proposal_id", "parameter", "score", "status")


@query(f"SELECT proposal_id, weighted_score FROM ({VERDICTS})")
def r7_weighted_score(a: Archive) -> DataFrame:
    return verdicts(a).select("proposal_id", "weighted_score")


@query(f"SELECT proposal_id, coverage FROM ({VERDICTS})")
def r8_coverage(a: Archive) -> DataFrame:
    return verdicts(a).select("proposal_id", "coverage")


@query(f"SELECT proposal_id, unevidenced, failed, is_partial FROM ({VERDICTS})")
def r9_gaps(a: Archive) -> DataFrame:
    return verdicts(a).select("proposal_id", F.array_join("unevidenced", "|").alias("unevidenced"), F.array_join("failed", "|").alias("failed"), "is_partial")


@query(f"SELECT proposal_id, CASE WHEN proposal_id % 3 = 2 THEN weighted_score ELSE least(greatest(least(greatest(proposal_id % 101, weighted_score - 8), weighted_score + 8), 0), 100) END AS adjusted FROM ({VERDICTS})")
def r10_apply_adjustment(a: Archive) -> DataFrame:
    proposed = F.when(F.col("proposal_id") % 3 == 2, "not a number").otherwise((F.col("proposal_id") % 101).cast("string"))
    return verdicts(a).select("proposal_id", R.adjusted(F.col("weighted_score"), proposed).alias("adjusted"))


LEVELS = "CASE WHEN {0} >= 80 THEN 'Highly Recommended' WHEN {0} >= 65 THEN 'Recommended' WHEN {0} >= 45 THEN 'Conditionally Recommended' ELSE 'Not Recommended' END"


@query(f"SELECT proposal_id, CASE WHEN proposal_id % 4 = 0 THEN 'Recommended' ELSE {LEVELS.format('weighted_score')} END AS recommendation, CASE WHEN proposal_id % 2 = 0 THEN 'High' ELSE 'Medium' END AS risk FROM ({VERDICTS})")
def r11_recommendation(a: Archive) -> DataFrame:
    supplied = F.when(F.col("proposal_id") % 4 == 0, "Recommended").otherwise("Maybe")
    risk = F.when(F.col("proposal_id") % 2 == 0, "High").otherwise("Terrible")
    return verdicts(a).select("proposal_id", R.recommendation_of(F.col("weighted_score"), supplied).alias("recommendation"), R.risk_of(risk).alias("risk"))


@query(f"""WITH p AS ({PARAMETERS}), s AS (SELECT * FROM p WHERE score IS NOT NULL), e AS (SELECT proposal_id, max(score) - min(score) AS spread FROM s GROUP BY 1 HAVING count(*) >= 3),
    r AS (SELECT proposal_id, 'spread' AS reason FROM e WHERE spread > 30 UNION ALL SELECT proposal_id, 'flagged:' || parameter FROM p WHERE score >= 70 AND red_flags > 0
      UNION ALL SELECT x.proposal_id, 'apart:' || x.parameter || '-' || y.parameter FROM (VALUES {PAIRS}) c(a, b) JOIN s x ON x.parameter = c.a JOIN s y ON y.parameter = c.b AND x.proposal_id = y.proposal_id WHERE abs(x.score - y.score) >= 25)
    SELECT proposal_id, string_agg(reason, '|' ORDER BY reason) AS reasons FROM r SEMI JOIN e USING (proposal_id) GROUP BY 1""")
def r12_debate_triggers(a: Archive) -> DataFrame:
    pairs = [(NUMBER[x], NUMBER[y]) for x, y in CONFLICT_PAIRS]
    return R.debate_triggers(parameters(a), pairs).select("proposal_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"""SELECT proposal_id, parameter, score AS before, CASE WHEN score IS NOT NULL AND proposal_id % 2 = 0 AND abs(least(greatest(proposal_id % 120 - 10.0, 0.0), 100.0) - score) >= 0.5 THEN least(greatest(proposal_id % 120 - 10.0, 0.0), 100.0)::DOUBLE ELSE score END AS score FROM ({PARAMETERS})""")
def r13_apply_debate(a: Archive) -> DataFrame:
    p = parameters(a)
    moves = p.where("proposal_id % 2 = 0").select("proposal_id", "parameter", (F.col("proposal_id") % 120 - F.lit(10.0)).alias("proposed"))
    return R.apply_debate(p, moves).select("proposal_id", "parameter", "before", "score")


LABELLED = f"SELECT *, CASE WHEN status = 'failed' THEN 'Not assessed' WHEN score IS NULL THEN 'Not addressed' ELSE printf('%.1f', score) END AS score_label FROM ({PARAMETERS})"


@query(f"SELECT proposal_id, parameter, status, score_label, 'flag' AS flags FROM ({LABELLED})")
def r14_blind_view(a: Archive) -> DataFrame:
    full = parameters(a).withColumn("company", F.lit("secret")).withColumn("quotes", F.array(F.lit("q" * 300))).withColumn("flags", F.array(F.lit("flag")))
    return R.blind_view(full).select("proposal_id", "parameter", "status", "score_label", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT proposal_id, parameter, score_label FROM ({LABELLED})")
def r15_score_label(a: Archive) -> DataFrame:
    return parameters(a).select("proposal_id", "parameter", R.score_label(F.col("status"), F.col("score")).alias("score_label"))


@query(f"""WITH p AS ({PARAMETERS}), t AS (SELECT proposal_id, sum(tokens) AS tokens FROM evaluations GROUP BY 1)
    SELECT v.proposal_id, v.weighted_score, CAST(coalesce(t.tokens, 0) AS BIGINT) AS tokens, (SELECT count(*) FROM p WHERE p.proposal_id = v.proposal_id) AS parameters FROM ({VERDICTS}) v LEFT JOIN t USING (proposal_id)""")
def r16_compose_report(a: Archive) -> DataFrame:
    report = R.compose_report(verdicts(a), parameters(a), a.evaluations)
    return report.select("proposal_id", "weighted_score", "tokens", F.size("parameters").cast("bigint").alias("parameters"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY {NEWEST}) AS place FROM evaluations WHERE status = 'completed')
    SELECT p.proposal_id, CASE WHEN r.place IS NULL THEN p.latest_score ELSE r.score END AS latest_score, CASE WHEN r.place IS NULL THEN p.status ELSE 'evaluated' END AS status, CASE WHEN r.place IS NULL THEN p.evaluated_at ELSE coalesce(r.completed_at, r.created_at) END AS evaluated_at,
    CASE WHEN r.place IS NULL THEN p.latest_recommendation ELSE r.recommendation END AS latest_recommendation, CASE WHEN r.place IS NULL THEN p.latest_evaluation_id ELSE r.run_id END AS latest_evaluation_id,
    r.place IS NOT NULL OR p.is_evaluated AS is_evaluated, CASE WHEN r.place IS NULL THEN p.error_stage END AS error_stage
    FROM proposals p LEFT JOIN r ON r.proposal_id = p.proposal_id AND r.place = 1""")
def r17_publish_verdict(a: Archive) -> DataFrame:
    newest = L.latest_per_key(a.evaluations.where("status = 'completed'"), "proposal_id", *newest_run())
    return R.publish_verdict(a.proposals, newest).select("proposal_id", *VERDICT, "status", "is_evaluated", "error_stage")


@query("SELECT proposal_id FROM proposals WHERE proposal_id NOT IN (SELECT proposal_id FROM evaluations WHERE status = 'completed')")
def r17_to_evaluate(a: Archive) -> DataFrame:
    return R.to_evaluate(a.proposals, a.evaluations).select("proposal_id")


@query(f"SELECT proposal_id, parameter, CAST(parameter - 1 AS INT) AS ordinal FROM (SELECT DISTINCT proposal_id, parameter FROM answers)")
def o7_canonical_order(a: Archive) -> DataFrame:
    rubric = a.spark.createDataFrame([(i + 1, i) for i in range(len(RUBRIC))], "parameter int, ordinal int")
    return R.canonical_order(a.answers.select("proposal_id", "parameter").distinct(), rubric)


@query(f"SELECT proposal_id, CAST(sum(red_flags) AS BIGINT) AS red_flags, count(score) AS scored FROM ({PARAMETERS}) GROUP BY 1")
def a26_verdict_facts(a: Archive) -> DataFrame:
    from ..operators.analytics import verdict_facts

    return verdict_facts(parameters(a))
