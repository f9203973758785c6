"""Documents as lines, headings, blocks and sections.

A document's lines are one array column, so cutting and joining keep their order without a shuffle. Only
scoring blocks against keywords makes rows: blocks times the keywords that occur.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

MOST_CENTROIDS = 200

def drop_repeated_lines(df: DataFrame, text: str = "text") -> DataFrame:
    left = lambda lines: X.once(X.repeated_lines(lines), lambda again: F.when(F.size(again) > 0, F.array_join(F.filter(lines, lambda x: ~F.array_contains(again, X.strip(x))), "\n")))
    return df.withColumn(text, F.coalesce(X.once(F.split(text, "\n"), left), F.col(text)))


def clean_text(df: DataFrame, text: str = "text", is_ocr: bool = False) -> DataFrame:
    """All cleaning steps in order; a null text becomes empty."""
    df = df.withColumn(text, X.drop_page_markers(X.strip_control(X.nfkc(F.coalesce(F.col(text), F.lit(""))))))
    df = drop_repeated_lines(df, text)
    if is_ocr:
        df = df.withColumn(text, X.fix_ocr(F.col(text)))
    return df.withColumn(text, X.collapse_ws(X.fix_line_breaks(F.col(text))))


# The shapes of a heading.
HEADINGS = (r"^\d+(?:\.\d+)*\.?\s+[A-Z].{3,80}$", r"^[A-Z][A-Z\s&/,]{5,60}$", r"^[A-Z][a-zA-Z\s&/:,–-]{5,60}$")


def _is_heading(line: Column) -> Column:
    shape = line.rlike(HEADINGS[0]) | line.rlike(HEADINGS[1]) | line.rlike(HEADINGS[2])
    late_digit = F.size(F.filter(F.array_distinct(F.regexp_extract_all(line, F.lit(r"(\d)"), F.lit(1))), lambda d: F.instr(line, d) > 6)) > 0
    return shape & (X.word_count(line) >= 2) & ~line.endswith(".") & ~late_digit


def detect_headings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, heading): the first line that has each heading of a document."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "heading"))
    hits = lines.withColumn("heading", X.strip(F.col("heading"))).where(_is_heading(F.col("heading")))
    return hits.groupBy(key, "heading").agg(F.min("line").alias("line"))


def doc_profile(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    words = X.word_count(F.col(text))
    return df.select(key, words.alias("words"), F.length(text).alias("chars"), F.size(F.split(text, "\n")).alias("lines"), X.est_tokens(F.col(text)).alias("tokens"))


def split_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(key, block, heading, body, start): a document cut at its ``## `` lines.

    Text before the first heading is block 0 if it has ``least`` characters or there is no heading at all. ``start`` is the
    character at which the block begins.
    """
    parts = F.split(F.col(text), r"(?m)(?=^##\s+\S)")
    start = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, x: s + F.length(x)))
    rows = df.select(key, F.posexplode(F.arrays_zip(parts.alias("part"), start.alias("start"))).alias("block", "p"), F.size(parts).alias("n"))
    raw = F.col("p.part")
    marked = raw.rlike(r"^##\s+\S")
    heading = F.when(marked, F.trim(F.regexp_extract(raw, r"^##\s+([^\n]+)", 1))).otherwise("")
    body = (F.regexp_replace(F.when(marked, F.regexp_replace(raw, r"^##[^\n]*\n?", "")).otherwise(raw), r"^\s+|\s+$", ""))
    out = rows.select(key, "block", heading.alias("heading"), body.alias("body"), F.col("p.start").alias("start"), "n")
    return out.where((F.col("heading") != "") | (F.length("body") >= least) | ((F.col("n") == 1) & (F.col("body") != ""))).drop("n")


WORD = r"\p{L}\p{N}_"


def held_keywords(text: Column, keywords: list[str], gap: int) -> Column:
    """Those of ``keywords`` (in small letters) that stand in a text, whole words of it in any case; ``gap``: how many characters may stand between two words of a keyword.

    Stretches of one length are cut out by one pattern, and only those that are keywords are kept: the work follows the text, whatever the number of keywords.
    """
    by_words: dict[int, list[str]] = {}
    for word in keywords:
        by_words.setdefault(len(re.findall(r"\w+", word)), []).append(word)
    held = []
    for n, listed in sorted(by_words.items()):
        stretch = f"[{WORD}]+" if n == 1 else f"(?<![{WORD}])(?=([{WORD}]++(?:[^{WORD}]{{1,{gap}}}[{WORD}]++){{{n - 1}}}))"
        held.append(F.array_intersect(F.transform(F.regexp_extract_all(text, F.lit(stretch), F.lit(min(n - 1, 1))), F.lower), F.array(*map(F.lit, listed))))
    return F.concat(*held) if held else F.array().cast("array<string>")


def keyword_scores(blocks: DataFrame, taxonomy: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, section, position, score): three times the heading's keywords and half those of the body's first 600 characters.

    A keyword stands between word boundaries, in any case, and counts once in each. The taxonomy is a config table of a few hundred keywords, each of which begins and ends with a word
    character; they go out with the plan, and only keywords that a block holds become rows.
    """
    listed = taxonomy.select(F.lower("keyword").alias("phrase"), F.col("keyword").rlike(f"^[{WORD}](.*[{WORD}])?$").alias("sound")).distinct().collect()
    if not all(r.sound for r in listed):
        raise ValueError("keywords must begin and end with a letter, a digit or an underscore")
    words = sorted(r.phrase for r in listed)
    gap = max((len(g) for w in words for g in re.findall(r"\W+", w)), default=1)
    found = lambda text, times: F.transform(held_keywords(text, words, gap), lambda p: F.struct(p.alias("phrase"), F.lit(times).alias("times")))
    both = F.concat(found(F.coalesce("heading", F.lit("")), 3.0), found(F.substring(F.coalesce("body", F.lit("")), 1, 600), 0.5))
    hits = blocks.select(key, "block", F.inline(both)).join(F.broadcast(taxonomy.withColumn("phrase", F.lower("keyword"))), "phrase")
    return hits.groupBy(key, "block", "section", "position").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def classify_keyword(scores: DataFrame, key: str = "doc_id", least: float = 3.0) -> DataFrame:
    """(key, block, section, confidence): the best section of each block that reaches ``least``, ties to the earlier one."""
    order = W.partitionBy(key, "block").orderBy(F.desc("score"), "position")
    ranked = scores.withColumn("place", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    sure = F.least(F.lit(1.0), (F.col("score") - F.col("second")) / F.greatest("score", F.lit(1.0)) + 0.5)
    return ranked.where((F.col("place") == 1) & (F.col("score") >= least)).select(key, "block", "section", F.round(sure, 4).alias("confidence"))


def classify_semantic(blocks: DataFrame, centroids: DataFrame, key: str = "doc_id", least: float = 0.3, default: str = "vision") -> DataFrame:
    """(key, block, section, confidence, method) by the cosine to the nearest of a few centroids (section, position, centre); ``vec`` is the block's unit vector.

    There is one centroid a section, MOST_CENTROIDS at most; they come to the driver and go out with the plan, so blocks are not shuffled.
    """
    from .dedup import dot

    few = centroids.select("section", F.col("position").cast("bigint"), F.col("centre").cast("array<double>")).limit(MOST_CENTROIDS + 1).collect()
    if len(few) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    scored = [
        F.struct(F.round(dot(F.col("vec"), F.lit(c.centre)) / (sum(x * x for x in c.centre) ** 0.5 or 1.0), 9).alias("score"), F.lit(-c.position).alias("early"), F.lit(c.section).alias("section"))
        for c in few
    ]
    best = blocks.select(key, "block", F.array_max(F.array(*scored)).alias("b"))
    sure = F.col("b.score") >= least
    return best.select(key, "block", F.when(sure, F.col("b.section")).otherwise(default).alias("section"), F.round("b.score", 4).alias("confidence"), F.when(sure, "semantic").otherwise("default").alias("method"))


def sectionise(blocks: DataFrame, taxonomy: DataFrame, semantic: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, section, text, blocks): blocks filed by keyword, else too short ones as identity, else by meaning, and joined in order.

    ``semantic``: what classify_semantic gives for the blocks; without it the rest goes to the general section.
    """
    kept = blocks.where((F.length("body") >= 40) | (F.col("heading") != ""))
    filed = kept.join(classify_keyword(keyword_scores(kept, taxonomy, key), key).select(key, "block", F.col("section").alias("by_word")), [key, "block"], "left")
    if semantic is not None:
        filed = filed.join(semantic.select(key, "block", F.col("section").alias("by_sense")), [key, "block"], "left")
    else:
        filed = filed.withColumn("by_sense", F.lit(None).cast("string"))
    section = F.coalesce("by_word", F.when(F.length("body") < 120, "identity"), "by_sense", F.lit("vision"))
    shown = F.when(F.col("heading") != "", F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.col("body"))).otherwise(F.col("body"))
    parts = F.array_sort(F.collect_list(F.struct("block", shown.alias("shown"))))
    return filed.groupBy(key, section.alias("section")).agg(F.array_join(parts["shown"], "\n\n").alias("text"), F.count("*").alias("blocks"))


def sections_to_map(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    return sections.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "text"))))).alias("sections"))


def sections_from_map(maps: DataFrame, key: str = "doc_id") -> DataFrame:
    """Back to rows; empty texts are dropped."""
    parsed = maps.select(key, F.explode(F.from_json("sections", "map<string,string>")).alias("section", "text"))
    return parsed.where(F.trim("text") != "")


def scoreable_sections(sections: DataFrame) -> DataFrame:
    return sections.where(F.col("section") != "identity")


def route_sections(sections: DataFrame, rubric: DataFrame, key: str = "doc_id", budget: int = 5000, least: int = 500) -> DataFrame:
    """(key, parameter, position, section, given): what of each section a parameter's reader gets.

    In the parameter's order, until the budget of tokens is used up; the first that overflows is cut if more than ``least`` tokens are left, and
    nothing follows it.
    """
    wanted = rubric.select("parameter", "sections").distinct().select("parameter", F.posexplode("sections").alias("position", "section"))
    rows = scoreable_sections(sections).join(F.broadcast(wanted), "section").withColumn("tokens", X.est_tokens(F.col("text")))
    order = W.partitionBy(key, "parameter").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    rest = budget - F.col("used")
    given = F.when(F.col("tokens") <= rest, F.col("tokens")).when(rest > least, rest)
    return rows.withColumn("given", given.cast("bigint")).where("given IS NOT NULL").select(key, "parameter", "position", "section", "given")
