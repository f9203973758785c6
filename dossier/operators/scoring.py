"""Evidence-checked scores: quotes are grounded, unevidenced answers lose their score, and no gap counts as zero.

Answers are rows (proposal_id, parameter, question, raw_score, evidenced); a score that was not given is null all the way, a parameter that
failed is told apart from one without evidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GAP, HIGH_WITH_FLAG, SPREAD
from ..functions.text import fold
from ..session import written
from ..sources.tables import with_verdicts

QUOTE_LEAST, QUOTE_MOST, QUOTES, HEAD, HEAD_LEAST = 10, 1200, 5, 80, 40
GRAM = 4  # characters of an anchor
MOST_QUESTIONS = 1000


def asked(proposals: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question of the rubric for every proposal: unasked answers go, missing ones count as unevidenced.

    The rubric is a config table (some dozen questions, MOST_QUESTIONS at most), repeated beside each proposal.
    """
    rows = [r.asDict() for r in questions.limit(MOST_QUESTIONS + 1).collect()]
    if len(rows) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions")
    listed = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in questions.dtypes]) for r in rows])
    wanted = proposals.select("proposal_id", F.inline(listed))
    out = wanted.join(answers, ["proposal_id", *questions.columns], "left")
    return out.withColumn("evidenced", F.coalesce("evidenced", F.lit(False)))


def parse_citations(quotes: Column) -> Column:
    """Trimmed quotes; short ones dropped, long ones cut, the first few kept."""
    kept = F.filter(F.transform(quotes, lambda x: F.trim(x)), lambda q: F.length(q) >= QUOTE_LEAST)
    return F.slice(F.transform(kept, lambda q: F.substring(q, 1, QUOTE_MOST)), 1, QUOTES)


def _within(text: Column, quote: Column) -> Column:
    head = F.substring(quote, 1, HEAD)
    return text.contains(quote) | ((F.length(head) >= HEAD_LEAST) & text.contains(head))


def ground_quotes(citations: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``citations`` (key, quote) with ``grounded``: whether the text of that key holds the quote, or its beginning."""
    rows = citations.join(texts.select(key, F.col("text").alias("_text")), key, "left")
    return rows.withColumn("grounded", F.coalesce(_within(fold(F.col("_text")), fold(F.col("quote"))), F.lit(False))).drop("_text")


def _grams(text: Column | str) -> Column:
    """The different stretches of GRAM characters in a row."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _words(text: Column | str) -> Column:
    """The different words of a folded text, which stand between single spaces."""
    return F.array_distinct(F.split(text, " "))


def _inner_words(quote: str) -> Column:
    """The words of a folded quote but for the first and the last: those have a space on either side, so a text that holds the quote has them as words."""
    words = F.split(quote, " ")
    return F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))


def _candidates(own: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, quote, _doc): quotes (item_id, quote, part) with the texts (doc_id, part) that have the quote's rarest part. A quote with a part that no text has is dropped."""
    counts = held.join(own.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "part", "left").groupBy("item_id", "quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("a"))
    anchors = written(rarest.where("a.n > 0").select("item_id", "quote", "a.part"), "anchors")
    return held.join(anchors, "part").select("item_id", "quote", F.col("doc_id").alias("_doc"))


def find_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) wherever a quote of at least ten folded characters stands in a text; a repeated quote of one item counts once.

    A quote can only stand where all its inner words do. Of these it is looked for by the one that the fewest texts hold, which is counted on the texts
    first: quotes and texts meet by equality on that anchor, then the whole quote is checked. Quotes of one or two words have stretches of GRAM characters for words; texts are cut into
    these only where there are such quotes. What moves are ids and parts that occur in quotes; texts move once, to be checked against their candidates.
    """
    folded = quotes.select("item_id", fold(F.col("text")).alias("quote")).where(F.length("quote") >= QUOTE_LEAST).distinct()
    q = written(folded.withColumn("inner", _inner_words("quote")), "quotes")
    t = texts.select("doc_id", fold(F.col("text")).alias("body"))
    inner = q.select("item_id", "quote", F.explode("inner").alias("part"))
    pairs = _candidates(inner, t.select("doc_id", F.explode(_words("body")).alias("part")))
    short = q.where(F.size("inner") == 0)
    if not short.isEmpty():
        grams = short.select("item_id", "quote", F.explode(_grams("quote")).alias("part"))
        pairs = pairs.unionByName(_candidates(grams, t.select("doc_id", F.explode(_grams("body")).alias("part"))))
    return pairs.distinct().join(t, F.col("_doc").eqNullSafe(F.col("doc_id"))).where(F.col("body").contains(F.col("quote"))).select("item_id", "doc_id")


def downgraded(score: Column, evidenced: Column, grounded: Column) -> Column:
    """The score within 0 to 10, or null without evidence, without a grounded quote, or if it is no number."""
    number = score.cast("string").try_cast("double")
    return F.when(evidenced & grounded & number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(0.0)), F.lit(10.0)))


def parameter_scores(answers: DataFrame, score: str = "score") -> DataFrame:
    """Per parameter: ten times the mean of its evidenced scores, how many these are, and how many were asked."""
    total = F.sum(F.col(score).cast("decimal(20,4)")).cast("double")
    return answers.groupBy("proposal_id", "parameter").agg(
        F.round(total / F.count(score) * 10, 2).alias("score"),
        F.count(score).alias("evidenced"),
        F.count("*").alias("asked"),
        F.count_if(F.coalesce("red_flag", F.lit(False))).alias("red_flags") if "red_flag" in answers.columns else F.lit(0).cast("bigint").alias("red_flags"),
    )


def parameter_status(parameters: DataFrame, failed: DataFrame) -> DataFrame:
    """failed, unevidenced or scored; a failed parameter has no score and is never unevidenced.

    A proposal's failed parameters (a handful) are met as one row, so that tables dealt by proposal stay where they are.
    """
    marks = failed.groupBy("proposal_id").agg(F.collect_set("parameter").alias("_failed"))
    out = parameters.join(marks, "proposal_id", "left").withColumn("_failed", F.array_contains("_failed", F.col("parameter")))
    status = F.when(F.col("_failed"), "failed").when(F.col("score").isNull(), "unevidenced").otherwise("scored")
    return out.withColumn("status", status).withColumn("score", F.when(status != "failed", F.col("score"))).drop("_failed")


def verdicts(parameters: DataFrame, weights: DataFrame) -> DataFrame:
    """Per proposal: the weighted score over scored parameters only, coverage over those that did not fail, and the gaps by name.

    No scored parameter gives 0.0; ``is_partial`` if any failed. ``weights``: parameter, weight, label.
    """
    rows = parameters.join(F.broadcast(weights), "parameter")
    scored, ok = F.col("status") == "scored", F.col("status") != "failed"
    weight = F.col("weight").cast("decimal(10,4)")
    points = F.sum(F.when(scored, (F.col("score").cast("decimal(12,4)") * weight))).cast("double")
    mass = F.sum(F.when(scored, weight)).cast("double")
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("label"))))
    cover = F.sum(F.when(ok, F.col("evidenced"))) / F.sum(F.when(ok, F.col("asked")))
    return rows.groupBy("proposal_id").agg(
        F.coalesce(F.round(points / mass, 2), F.lit(0.0)).alias("weighted_score"),
        F.coalesce(F.round(cover, 3), F.lit(0.0)).alias("coverage"),
        names("unevidenced").alias("unevidenced"),
        names("failed").alias("failed"),
        (F.count_if(~ok) > 0).alias("is_partial"),
    )


def adjusted(weighted: Column, proposed: Column, band: float = 8.0) -> Column:
    """A proposed score, held within the band around the weighted one and within 0 to 100; no number: the weighted one."""
    number = proposed.cast("string").try_cast("double")
    held = F.least(F.greatest(number, weighted - band), weighted + band)
    return F.when(number.isNull() | F.isnan(number), weighted).otherwise(F.least(F.greatest(held, F.lit(0.0)), F.lit(100.0)))


# Labels from the best down, with the scores that reach them.
RECOMMENDATIONS = ((80, "Highly Recommended"), (65, "Recommended"), (45, "Conditionally Recommended"), (None, "Not Recommended"))
RISKS = ("Low", "Medium", "High", "Critical")


def recommendation_of(score: Column, supplied: Column | None = None) -> Column:
    bands = reduce(lambda c, b: c.when(score >= b[0], b[1]), RECOMMENDATIONS[:-1], F.when(F.lit(False), F.lit(""))).when(score.isNotNull(), RECOMMENDATIONS[-1][1])
    return bands if supplied is None else F.when(supplied.isin(*[r[1] for r in RECOMMENDATIONS]), supplied).otherwise(bands)


def risk_of(supplied: Column) -> Column:
    return F.when(supplied.isin(*RISKS), supplied).otherwise("Medium")


def debate_triggers(parameters: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    """(proposal_id, reasons): why scores of one proposal look contradictory; only those with three scored parameters or more.

    ``pairs`` are two parameters that must not lie far apart. A proposal has a handful of parameters; they are looked at together, in one shuffle.
    """
    rows = parameters.groupBy("proposal_id").agg(F.collect_list(F.struct("parameter", "score", "red_flags")).alias("all"))
    rows = rows.withColumn("scored", F.filter("all", lambda x: x["score"].isNotNull())).where(F.size("scored") >= 3)
    scores = F.transform("scored", lambda x: x["score"])
    by_name = F.map_from_entries(F.transform("scored", lambda x: F.struct(x["parameter"], x["score"])))
    rows = rows.withColumn("spread", F.array_max(scores) - F.array_min(scores)).withColumn("by", by_name)
    flagged = F.transform(F.filter("scored", lambda x: (x["score"] >= HIGH_WITH_FLAG) & (x["red_flags"] > 0)), lambda x: F.concat(F.lit("flagged:"), x["parameter"].cast("string")))
    apart = [F.when(F.abs(F.try_element_at("by", F.lit(a)) - F.try_element_at("by", F.lit(b))) >= GAP, f"apart:{a}-{b}") for a, b in pairs]
    reasons = F.array_sort(F.array_compact(F.concat(F.array(F.when(F.col("spread") > SPREAD, "spread"), *apart), flagged)))
    return rows.select("proposal_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def apply_debate(parameters: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Moves scored parameters to (proposal_id, parameter, proposed) within 0 to 100; moves under half a point are ignored. Keeps both scores."""
    out = parameters.join(adjustments, ["proposal_id", "parameter"], "left")
    held = F.when(F.col("proposed").isNotNull(), F.least(F.greatest(F.col("proposed"), F.lit(0.0)), F.lit(100.0)))  # else least() would skip the null
    moves = F.col("score").isNotNull() & held.isNotNull() & (F.abs(held - F.col("score")) >= 0.5)
    return out.withColumns({"before": F.col("score"), "score": F.when(moves, held).otherwise(F.col("score")), "moved": F.coalesce(moves, F.lit(False))}).drop("proposed")


def score_label(status: Column, score: Column) -> Column:
    return F.when(status == "failed", "Not assessed").when(score.isNull(), "Not addressed").otherwise(F.format_string("%.1f", score))


BLIND = ("parameter", "label", "status", "score_label", "quotes", "flags")


def blind_view(report: DataFrame) -> DataFrame:
    """What a second reader may see: no identity, two quotes of 280 characters, four flags."""
    out = report.withColumn("score_label", score_label(F.col("status"), F.col("score")))
    cut = F.transform(F.slice("quotes", 1, 2), lambda q: F.substring(q, 1, 280))
    return out.withColumn("quotes", cut).withColumn("flags", F.slice("flags", 1, 4)).select("proposal_id", *[c for c in BLIND if c in out.columns])


def compose_report(verdict: DataFrame, parameters: DataFrame, tokens: DataFrame) -> DataFrame:
    """One nested row a proposal: its verdict, its parameters in rubric order and the tokens of all runs."""
    nested = parameters.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("parameter", "score", "status"))).alias("parameters"))
    spent = tokens.groupBy("proposal_id").agg(F.sum("tokens").alias("tokens"))
    return verdict.join(nested, "proposal_id").join(spent, "proposal_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def publish_verdict(proposals: DataFrame, newest: DataFrame) -> DataFrame:
    """Newest completed run onto its proposal: score, label, id and time; clears the error. Proposals without one stay."""
    out = with_verdicts(proposals, newest, only_missing=False)
    done = F.col("filled")
    cleared = {c: F.when(~done, F.col(c)) for c in ("error_stage", "error_message") if c in proposals.columns}
    return out.withColumns({"status": F.when(done, "evaluated").otherwise(F.col("status")), "is_evaluated": done | F.col("is_evaluated"), **cleared}).drop("filled")


def to_evaluate(proposals: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Proposals that need a run: those with a completed one are reused unless forced."""
    return proposals if force else proposals.join(runs.where("status = 'completed'").select("proposal_id"), "proposal_id", "left_anti")


def canonical_order(parameters: DataFrame, rubric: DataFrame) -> DataFrame:
    """Rows with their place in the rubric; nested lists are sorted by it."""
    return parameters.join(F.broadcast(rubric.select("parameter", "ordinal").distinct()), "parameter").orderBy("proposal_id", "ordinal")
