"""Texts, sections, forms and layout of the archive's documents."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Archive
from ..config import FINANCIAL, TAXONOMY, TECHNICAL, taxonomy_table
from ..functions import text as X
from ..functions.hooks import embed
from ..operators import forms as Q
from ..operators import layout as P
from ..operators import sections as S
from ..registry import query
from ..sources.files import safe_key

MARKERS = ((r"(?m)^\s*[-–—]?\s*\d+\s*[-–—]?\s*$", ""), (r"(?mi)^\s*page\s+\d+\s*(of\s+\d+)?\s*$", ""), (r"(?mi)^\s*confidential\s*$", ""), (r"(?mi)^\s*draft\s*$", ""))
#: A marked text: a few lines that the cleaning rules are for, around a document.
NOISY = "concat('Page 3 of 9\n- 12 -\nDRAFT\n', text, '\nl\nw0rd a1b0c ..... x ---- y\nexam-\nple  of\t\tit\n\n\n\nend  ')"


def sql_chain(column: str, rules) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


def noisy(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", F.expr(NOISY).alias("text"))


@query()
def x1_nfkc(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", F.sha2(X.nfkc(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(regexp_replace(text || chr(7) || chr(9) || chr(8203), '[^\\P{C}\\n\\t\\r]', '', 'g')) AS digest FROM documents")
def x2_strip_control(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", F.sha2(X.strip_control(F.concat("text", F.lit("\x07\t​"))), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({sql_chain(NOISY, (('[^\\S\\n]+', ' '), ('\\n{3,}', chr(10) * 2), ('^\\s+|\\s+$', '')))}) AS digest FROM documents")
def x3_collapse_ws(a: Archive) -> DataFrame:
    return noisy(a).select("doc_id", F.sha2(X.collapse_ws(F.col("text")), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({sql_chain(NOISY, MARKERS)}) AS digest FROM documents")
def x4_drop_page_markers(a: Archive) -> DataFrame:
    return noisy(a).select("doc_id", F.sha2(X.drop_page_markers(F.col("text")), 256).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    c AS (SELECT doc_id, trim(line, ' ') AS line FROM l GROUP BY ALL HAVING count(*) >= 3 AND length(trim(line, ' ')) > 3), n AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) >= 20)
    SELECT l.doc_id, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL OR n.doc_id IS NULL), '')) AS digest
    FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.line = trim(l.line, ' ') LEFT JOIN n ON n.doc_id = l.doc_id GROUP BY 1""")
def x5_drop_repeated_lines(a: Archive) -> DataFrame:
    return S.drop_repeated_lines(a.texts).select("doc_id", F.sha2("text", 256).alias("digest"))


OCR = ((r"(?m)^\s*[|Il]\s*$", ""), ("([a-z])0([a-z])", r"\1o\2"), ("([a-z])0([a-z])", r"\1o\2"), ("([a-z])1([a-z])", r"\1l\2"), ("([a-z])1([a-z])", r"\1l\2"), ("[.]{4,}", " "), ("[-]{4,}", " "))


@query(f"SELECT doc_id, sha256({sql_chain(NOISY, OCR)}) AS digest FROM documents")
def x6_fix_ocr(a: Archive) -> DataFrame:
    return noisy(a).select("doc_id", F.sha2(X.fix_ocr(F.col("text")), 256).alias("digest"))


@query(f"""WITH j AS (SELECT doc_id, list_transform(string_split(regexp_replace({NOISY}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), chr(10)), lambda x: trim(x, ' ')) AS l FROM documents)
    SELECT doc_id, sha256(array_to_string(list_transform(l, lambda x, i: CASE WHEN x = '' THEN '' ELSE x || CASE WHEN length(x) > 20 AND NOT regexp_matches(x, '[.!?:;"'')]$') AND NOT regexp_matches(x, '^[-•*–—]') AND NOT regexp_matches(x, '^\\d+[.)]\\s')
        AND coalesce(l[i + 1], '') <> '' THEN ' ' ELSE chr(10) END END), '')) AS digest FROM j""")
def x7_fix_line_breaks(a: Archive) -> DataFrame:
    return noisy(a).select("doc_id", F.sha2(X.fix_line_breaks(F.col("text")), 256).alias("digest"))


@query()
def x8_clean_text(a: Archive) -> DataFrame:
    return S.clean_text(a.texts, is_ocr=True).select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


MARKED = ((r"<style>[^<]*</style>|<script>[^<]*</script>|<head>", ""), ("<h1>", "\n## "), ("</h1>|<p>", "\n"), ("<[^>]*>", ""))
PAGE_LINES = f"regexp_replace({sql_chain('html', MARKED)}, '(^|\\n)## ', chr(10), 'g')"


def page_text(a: Archive, marked: bool = True) -> DataFrame:
    """The pages' text: paragraphs as lines, first headings as lines of their own, marked or not."""
    text = F.col("html")
    for pattern, new in MARKED if marked else (*MARKED, (r"(^|\n)## ", "\n")):
        text = F.regexp_replace(text, pattern, new)
    return a.table("pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS heading, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM (SELECT page_id AS doc_id, {PAGE_LINES} AS text FROM pages))
    SELECT doc_id, heading, min(line) AS line FROM l
    WHERE (regexp_matches(heading, '^\\d+(?:\\.\\d+)*\\.?\\s+[A-Z].{{3,80}}$') OR regexp_matches(heading, '^[A-Z][A-Z\\s&/,]{{5,60}}$') OR regexp_matches(heading, '^[A-Z][a-zA-Z\\s&/:,–-]{{5,60}}$'))
      AND len(list_filter(regexp_split_to_array(heading, '\\s+'), lambda w: w <> '')) >= 2 AND NOT ends_with(heading, '.')
      AND len(list_filter(regexp_extract_all(heading, '\\d'), lambda d: instr(heading, d) > 6)) = 0 GROUP BY ALL""")
def x9_detect_headings(a: Archive) -> DataFrame:
    return S.detect_headings(page_text(a, marked=False))


def sql_flags(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in patterns) + " >= 2"


@query(f"SELECT doc_id, {sql_flags(FINANCIAL)} AS financial, {sql_flags(TECHNICAL)} AS technical FROM documents")
def x10_flags(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", X.flag_financial(F.col("text")).alias("financial"), X.flag_technical(F.col("text")).alias("technical"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def x11_est_tokens(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", X.est_tokens(F.col("text")).alias("tokens"))


WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {WORDS} >= 20 AS readable FROM documents")
def x12_readable(a: Archive) -> DataFrame:
    return a.texts.select("doc_id", X.readable(F.col("text")).alias("readable"))


@query(f"SELECT doc_id, CAST({WORDS} AS INT) AS words, CAST(length(text) AS INT) AS chars, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def x13_doc_profile(a: Archive) -> DataFrame:
    return S.doc_profile(a.texts)


BLOCKS = f"""SELECT doc_id, CAST(i - 1 AS INT) AS block, CASE WHEN i = 1 THEN '' ELSE trim(regexp_extract(part, '^[^\\n]+'), ' ') END AS heading,
        regexp_replace(CASE WHEN i = 1 THEN part ELSE regexp_replace(part, '^[^\\n]*\\n?', '') END, '^\\s+|\\s+$', '', 'g') AS body
    FROM (SELECT page_id AS doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT page_id, string_split({sql_chain('html', MARKED)}, chr(10) || '## ') AS p FROM pages))"""
BLOCKS = f"SELECT * FROM ({BLOCKS}) WHERE heading <> '' OR length(body) >= 10"


def blocks(a: Archive) -> DataFrame:
    """Blocks of the pages: first headings as marked lines, paragraphs as lines."""
    return S.split_blocks(page_text(a))


@query(f"SELECT doc_id, block, heading, sha256(body) AS digest FROM ({BLOCKS})")
def x14_split_blocks(a: Archive) -> DataFrame:
    return blocks(a).select("doc_id", "block", "heading", F.sha2("body", 256).alias("digest"))


#: The documents' words are invented, so the demonstration's sections are made of frequent ones.
DEMO = (("grammar", ("the", "of the", "and")), ("french", ("le", "la", "elle")), ("german", ("der", "die", "und")), ("spanish", ("que", "los", "de la")))


def taxonomy_rows(taxonomy) -> str:
    """Sections, positions, keywords with each word in marks, weights."""
    words = [(s, i, w) for i, (s, listed) in enumerate(taxonomy) for w in listed]
    return ", ".join(f"('{s}', {i}, '{re.sub(r'(\w+)', r'«\1»', w)}', {len(w.split())}.0)" for s, i, w in words)


def word_marks(text: str) -> str:
    """Each word of a text in marks, so that a keyword between word boundaries is a plain part of it."""
    return f"regexp_replace(lower({text}), '([\\p{{L}}\\p{{N}}_]+)', '«\\1»', 'g')"


SCORES = f"""SELECT doc_id, block, section, position, sum(weight * (3 * CAST(contains(h, keyword) AS INT) + 0.5 * CAST(contains(b, keyword) AS INT))) AS score
    FROM (SELECT doc_id, block, {word_marks("heading")} AS h, {word_marks("substr(body, 1, 600)")} AS b FROM ({BLOCKS})), (VALUES {taxonomy_rows(DEMO)}) t(section, position, keyword, weight) WHERE contains(h, keyword) OR contains(b, keyword) GROUP BY ALL"""


@query(f"SELECT doc_id, block, section, CAST(score AS DOUBLE) AS score FROM ({SCORES})")
def x15_keyword_scores(a: Archive) -> DataFrame:
    return S.keyword_scores(blocks(a), taxonomy_table(a.spark, DEMO)).select("doc_id", "block", "section", "score")


#: The real keywords, on addresses as headings and markup as bodies: names, types and prices stand there.
REAL_SCORES = f"""SELECT page_id, CAST(0 AS INT) AS block, section, CAST(position AS INT) AS position, CAST(sum(weight * (3 * CAST(contains(h, keyword) AS INT) + 0.5 * CAST(contains(b, keyword) AS INT))) AS DOUBLE) AS score
    FROM (SELECT page_id, {word_marks("url")} AS h, {word_marks("substr(html, 1, 600)")} AS b FROM pages), (VALUES {taxonomy_rows(TAXONOMY)}) t(section, position, keyword, weight) WHERE contains(h, keyword) OR contains(b, keyword) GROUP BY ALL"""


def real_scores(a: Archive) -> DataFrame:
    rows = a.table("pages").select("page_id", F.lit(0).alias("block"), F.col("url").alias("heading"), F.col("html").alias("body"))
    return S.keyword_scores(rows, taxonomy_table(a.spark), key="page_id")


@query(REAL_SCORES)
def x15_keyword_scores_of_pages(a: Archive) -> DataFrame:
    return real_scores(a)


@query(f"""SELECT page_id, block, section, CAST(round(least(1.0, (score - second) / greatest(score, 1.0) + 0.5), 4) AS DOUBLE) AS confidence FROM (
    SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0.0) AS second FROM ({REAL_SCORES}) WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, position)) WHERE place = 1 AND score >= 0.5""")
def x16_classify_pages(a: Archive) -> DataFrame:
    return S.classify_keyword(real_scores(a), key="page_id", least=0.5)


CLASSIFIED = f"""SELECT doc_id, block, section, CAST(round(least(1.0, (score - second) / greatest(score, 1.0) + 0.5), 4) AS DOUBLE) AS confidence FROM (
    SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0.0) AS second FROM (SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM ({SCORES})) WINDOW w AS (PARTITION BY doc_id, block ORDER BY score DESC, position)) WHERE place = 1 AND score >= 3"""


@query(CLASSIFIED)
def x16_classify_keyword(a: Archive) -> DataFrame:
    return S.classify_keyword(S.keyword_scores(blocks(a), taxonomy_table(a.spark, DEMO)))


@query("""WITH m AS (SELECT label AS position, i, sum(CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) / count(*) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    c AS (SELECT position, 's' || position AS section, list(x ORDER BY i) AS centre, sqrt(sum(x * x)) AS size FROM m GROUP BY ALL),
    s AS (SELECT vec_id AS doc_id, section, position, round(list_sum(list_transform(list_zip(embedding, centre), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / size, 9) AS score FROM embeddings, c)
    SELECT doc_id, CASE WHEN score >= 0.3 THEN section ELSE 'vision' END AS section, round(score, 4) AS confidence, CASE WHEN score >= 0.3 THEN 'semantic' ELSE 'default' END AS method
    FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) = 1""")
def x17_classify_semantic(a: Archive) -> DataFrame:
    """The nearest of the labels' mean vectors; whole numbers are added up, so that the order of rows has no say."""
    parts = a.vectors.select(F.col("company").alias("position"), F.posexplode("vec").alias("i", "x"))
    means = parts.groupBy("position", "i").agg((F.sum(F.floor(1024 * F.col("x").cast("double")).cast("bigint")) / F.count("*")).alias("x"))
    listed = means.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    centroids = listed.select(F.concat(F.lit("s"), F.col("position").cast("string")).alias("section"), "position", "centre")
    rows = a.vectors.select(F.col("id").alias("doc_id"), F.lit(0).alias("block"), "vec")
    return S.classify_semantic(rows, centroids).drop("block")


@query(f"""WITH b AS (SELECT * FROM ({BLOCKS}) WHERE length(body) >= 40 OR heading <> ''), k AS ({CLASSIFIED})
    SELECT b.doc_id, coalesce(k.section, CASE WHEN length(body) < 120 THEN 'identity' END, 'vision') AS section, count(*) AS blocks,
           sha256(string_agg(CASE WHEN heading <> '' THEN '## ' || heading || chr(10) || body ELSE body END, chr(10) || chr(10) ORDER BY b.block)) AS digest
    FROM b LEFT JOIN k USING (doc_id, block) GROUP BY 1, 2""")
def x18_sectionise(a: Archive) -> DataFrame:
    out = S.sectionise(blocks(a), taxonomy_table(a.spark, DEMO))
    return out.select("doc_id", "section", "blocks", F.sha2("text", 256).alias("digest"))


LETTERS = "aeiounrstl"


def letter_counts():
    """A stand-in for a model of meaning: how often each of ten letters stands in a text, at unit length."""

    def model(texts: list[str]) -> np.ndarray:
        counts = np.array([[t.lower().count(c) for c in LETTERS] for t in texts], dtype=float).reshape(-1, len(LETTERS))
        return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)

    return model


COUNTS_SQL = "[" + ", ".join(f"length(lower({{0}})) - length(replace(lower({{0}}), '{c}', ''))" for c in LETTERS) + "]"
SENSE = f"""SELECT doc_id, block, CASE WHEN score >= 0.9 THEN section ELSE 'vision' END AS sense FROM (
    SELECT doc_id, block, section, position, coalesce(round(list_sum(list_transform(list_zip(v, c), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(v, lambda x: x * x))) / sqrt(list_sum(list_transform(c, lambda x: x * x))), 9), 0) AS score
    FROM (SELECT doc_id, block, {COUNTS_SQL.format("body")} AS v FROM b), (SELECT section, position, {COUNTS_SQL.format("words")} AS c FROM (VALUES {", ".join(f"('{s}', {i}, '{', '.join(w)}')" for i, (s, w) in enumerate(TAXONOMY))}) t(section, position, words)))
    QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY score DESC, position) = 1"""


@query(f"""WITH b AS MATERIALIZED (SELECT * FROM ({BLOCKS}) WHERE length(body) >= 40 OR heading <> ''), k AS ({CLASSIFIED}), m AS ({SENSE})
    SELECT b.doc_id, coalesce(k.section, CASE WHEN length(body) < 120 THEN 'identity' END, sense, 'vision') AS section, count(*) AS blocks,
           sha256(string_agg(CASE WHEN heading <> '' THEN '## ' || heading || chr(10) || body ELSE body END, chr(10) || chr(10) ORDER BY b.block)) AS digest
    FROM b LEFT JOIN k USING (doc_id, block) LEFT JOIN m USING (doc_id, block) GROUP BY 1, 2""")
def x18_sectionise_by_meaning(a: Archive) -> DataFrame:
    """Blocks that no keyword files go to the section whose keywords are nearest by the caller's vectors."""
    vector = embed(letter_counts)
    centres = a.spark.createDataFrame([(s, i, ", ".join(w)) for i, (s, w) in enumerate(TAXONOMY)], "section string, position int, words string").select("section", "position", vector("words").alias("centre"))
    rows = blocks(a)
    sense = S.classify_semantic(rows.select("doc_id", "block", vector("body").alias("vec")), centres, least=0.9)
    out = S.sectionise(rows, taxonomy_table(a.spark, DEMO), sense)
    return out.select("doc_id", "section", "blocks", F.sha2("text", 256).alias("digest"))


NAMES = ("problem", "vision", "adoption", "solution", "pilot", "identity")
LINES = "SELECT doc_id, [" + ", ".join(f"'{n}'" for n in NAMES) + "][1 + (i - 1) % 6] AS section, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY ALL HAVING trim(string_agg(line, chr(10) ORDER BY i), ' ') <> ''"


def line_sections(a: Archive) -> DataFrame:
    """The lines of whole documents, dealt out in turn to six sections and joined in order."""
    names = F.array(*map(F.lit, NAMES))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i % len(NAMES)).alias("at"), line.alias("line")))
    own = lambda i: F.transform(F.filter("lines", lambda x: x["at"] == i), lambda x: x["line"])
    rows = a.texts.select("doc_id", lines.alias("lines")).select("doc_id", F.explode(F.transform(names, lambda name, i: F.struct(name.alias("section"), F.array_join(own(i), "\n").alias("text")))).alias("s"))
    return rows.select("doc_id", "s.section", "s.text").where(F.trim("text") != "")


@query(f"SELECT doc_id, section, text FROM ({LINES})")
def x19_sections_map_and_back(a: Archive) -> DataFrame:
    return S.sections_from_map(S.sections_to_map(line_sections(a)))


@query(f"""WITH s AS (SELECT doc_id, section, greatest(1, length(text) // 4) AS tokens FROM ({LINES}) WHERE section <> 'identity'),
    w AS (SELECT * FROM (VALUES ('a', 0, 'problem'), ('a', 1, 'vision'), ('a', 2, 'adoption'), ('b', 0, 'solution'), ('b', 1, 'identity'), ('b', 2, 'problem')) t(parameter, position, section)),
    r AS (SELECT doc_id, parameter, position, section, tokens, coalesce(sum(tokens) OVER (PARTITION BY doc_id, parameter ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s JOIN w USING (section))
    SELECT doc_id, parameter, CAST(position AS INT) AS position, section, CAST(CASE WHEN tokens <= 60 - used THEN tokens ELSE 60 - used END AS BIGINT) AS given FROM r WHERE tokens <= 60 - used OR 60 - used > 15""")
def x20_route_sections(a: Archive) -> DataFrame:
    rubric = a.spark.createDataFrame([("a", ["problem", "vision", "adoption"]), ("b", ["solution", "identity", "problem"])], "parameter string, sections array<string>")
    return S.route_sections(line_sections(a), rubric, budget=60, least=15)


@query("SELECT proposal_id, CASE WHEN proposal_id % 3 = 0 THEN 'fallback of ' || filename ELSE title || CASE WHEN proposal_id % 2 = 0 THEN chr(10) || category ELSE '' END END AS identity FROM proposals")
def x21_identity_text(a: Archive) -> DataFrame:
    title = F.when(F.col("proposal_id") % 3 != 0, F.concat(F.lit(" "), "title")).otherwise("  ")
    problem = F.when((F.col("proposal_id") % 2 == 0) & (F.col("proposal_id") % 3 != 0), F.col("category"))
    return a.proposals.select("proposal_id", X.identity_text(title, problem, fallback=F.concat(F.lit("fallback of "), "filename")).alias("identity"))


@query(f"""WITH s AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY list_position(['identity', 'problem', 'solution', 'team', 'vision'], section)) AS parts FROM ({LINES}) WHERE section IN ('identity', 'problem', 'solution', 'vision') GROUP BY 1)
    SELECT d.doc_id, sha256(source || '.txt' || chr(10) || chr(10) || coalesce(parts, substr(text, 1, 12000))) AS digest FROM documents d LEFT JOIN s USING (doc_id)""")
def x22_metadata_input(a: Archive) -> DataFrame:
    names = a.table("documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("filename"), "text")
    return Q.metadata_input(line_sections(a), names).select("doc_id", F.sha2("input", 256).alias("digest"))


@query("""SELECT proposal_id, CASE WHEN proposal_id % 3 <> 0 THEN title END AS title, CASE WHEN proposal_id % 2 = 1 THEN CAST(retry_count + 2000 AS INT) END AS year,
    CASE WHEN proposal_id % 12 BETWEEN 1 AND 9 THEN CAST(proposal_id % 12 AS INT) END AS level, CASE WHEN proposal_id % 7 = 0 THEN 0.0 ELSE least(retry_count / 2.0, 1.0) END::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS company, 'a|b' AS categories,
    'sensors|' || category AS technology_used FROM proposals""")
def x23_clean_metadata(a: Archive) -> DataFrame:
    p = F.col("proposal_id")
    raw = a.proposals.select(
        "proposal_id",
        F.when(p % 6 == 0, " N/A ").when(p % 6 == 3, "Not Stated").otherwise(F.concat(F.lit("  "), "title")).alias("title"),
        F.lit("none").alias("company"),
        F.when(p % 2 == 1, (F.col("retry_count") + 2000).cast("string")).otherwise("soon").alias("year"),
        (p % 12).cast("string").alias("level"),
        F.when(p % 7 == 0, "high").otherwise((F.col("retry_count") / 2).cast("string")).alias("confidence"),
        F.array(F.lit(" a "), F.lit("Not stated"), F.lit("b\t"), F.lit("c")).alias("categories"),
        F.array(F.lit("sensors"), F.lit("not found"), F.concat(F.lit(" "), "category")).alias("technology_used"),
    )
    return Q.clean_metadata(raw).select("proposal_id", "title", "company", "year", "level", "confidence", F.array_join("categories", "|").alias("categories"), F.array_join("technology_used", "|").alias("technology_used"))


@query()
def x24_repair_json(a: Archive) -> DataFrame:
    e = a.table("events")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done }"))).otherwise(F.lit("nothing"))
    return e.select("event_id", X.repair_json(wrapped).alias("props"))


@query("SELECT page_id, 'originals/' || page_id || '/' || substr(regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '[^A-Za-z0-9._-]', '_', 'g'), 1, 60) || '.' || substr(regexp_replace(lower(split_part(url, '.', -1)), '[^A-Za-z0-9]', '', 'g'), 1, 10) AS key FROM pages")
def x27_safe_key(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", safe_key("originals", F.col("page_id"), F.col("url")).alias("key"))


@query(r"""WITH t AS (SELECT proposal_id, printf('%,d', CAST(floor(latest_score * 5000) AS BIGINT)) AS a FROM proposals WHERE latest_score IS NOT NULL),
    v AS (SELECT proposal_id, regexp_extract(a, '^\d{1,3}(,\d{2})*(,\d{3})?') AS v, 'Total cost: INR ' || a || ' in all, Rs. ' || proposal_id % 100 || ' a day' AS t FROM t)
    SELECT proposal_id, CAST(0 AS INT) AS place, replace(v, ',', '') AS value, trim(substr(t, 1, 16 + length(v) + 20)) AS context FROM v
    UNION ALL SELECT proposal_id, 1, CAST(proposal_id % 100 AS VARCHAR), trim(substr(t, greatest(1, strpos(t, 'Rs. ') - 50), least(50, strpos(t, 'Rs. ') - 1) + 100)) FROM v""")
def x28_extract_amounts(a: Archive) -> DataFrame:
    """Two amounts that stand close, so that their contexts overlap."""
    text = F.concat(F.lit("Total cost: INR "), F.format_number(F.floor(F.col("latest_score") * 5000), 0), F.lit(" in all, Rs. "), (F.col("proposal_id") % 100).cast("string"), F.lit(" a day"))
    rows = a.proposals.where("latest_score IS NOT NULL").select("proposal_id", text.alias("text"))
    return Q.extract_amounts(rows, "proposal_id")


#: The lines of documents with their places, for the SQL of forms and layout.
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
LINE_WORDS = "len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))"
#: The markup of pages, a tag or a text a line, is the nearest thing to a form among the given tables: names, states and stages stand in it.
FORM_LINES = "SELECT page_id, unnest(string_split(replace(html, '>', '>' || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(html, '>', '>' || chr(10)), chr(10)), 1) - 1 AS pos FROM pages"
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
ANY_LABEL = "|".join(f"(?:{Q.label_pattern(x)})" for x in Q.LABELS)
LABELS_SQL = ", ".join("{'label': '" + x + "', 'pattern': '" + Q.label_pattern(x) + "'}" for x in Q.LABELS)
QA = f"""WITH named AS MATERIALIZED (SELECT page_id, pos, line, CASE WHEN regexp_matches(line, '{ANY_LABEL}') THEN list_filter([{LABELS_SQL}], lambda p: regexp_matches(line, p.pattern))[1].label END AS known
        FROM (SELECT page_id, pos, trim(line, {WHITE_SQL}) AS line FROM ({FORM_LINES})) WHERE line <> ''),
    asked AS (SELECT *, known IS NOT NULL OR (line LIKE '%?' AND length(line) < 300) OR (line LIKE '%)' AND length(line) < 200 AND {LINE_WORDS} <= 30)
        OR (length(line) < 120 AND {LINE_WORDS} <= 15 AND regexp_matches(line, '^\\p{{Lu}}') AND line NOT LIKE '%.' AND len(list_filter([{", ".join(f"'{w}'" for w in Q.LABEL_WORDS)}], lambda w: contains(lower(line), w))) > 0) AS asks FROM named),
    placed AS (SELECT *, sum(CAST(asks AS INT)) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS place FROM asked),
    qa AS (SELECT page_id, CAST(place AS BIGINT) AS place, coalesce(max(line) FILTER (WHERE asks), 'Preamble') AS question, max(known) FILTER (WHERE asks) AS known,
        string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT asks) AS answer FROM placed GROUP BY 1, 2)
    SELECT page_id, place, coalesce(known, question) AS field, question, answer FROM qa WHERE answer <> ''"""


def form_answers(a: Archive) -> DataFrame:
    return Q.qa_pairs(a.table("pages").select("page_id", F.regexp_replace("html", ">", ">\n").alias("text")), key="page_id")


@query(QA)
def x29_qa_pairs(a: Archive) -> DataFrame:
    return form_answers(a)


@query(f"SELECT page_id, field, string_agg(answer, chr(10) ORDER BY place) AS answer FROM ({QA}) GROUP BY 1, 2")
def x30_field_map(a: Archive) -> DataFrame:
    return Q.field_map(form_answers(a), key="page_id")


@query(f"""WITH widths AS (SELECT doc_id, len(list_filter(string_split(line, '|'), lambda c: trim(c, ' ') <> '')) AS width FROM ({LINES}) WHERE contains(line, '|')),
    counted AS (SELECT doc_id, width, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, width DESC) AS place FROM widths WHERE width > 0 GROUP BY 1, 2)
    SELECT doc_id, CAST(width AS INT) AS width, CAST(n - 1 AS INT) AS n_rows FROM counted WHERE place = 1 AND n >= 2""")
def x31_pipe_tables(a: Archive) -> DataFrame:
    return Q.pipe_tables(a.texts.withColumn("place", F.lit(0)), text="text").select("doc_id", "width", F.size("rows").alias("n_rows"))


@query()
def x32_aligned_tables(a: Archive) -> DataFrame:
    spaced = a.texts.select("doc_id", F.lit(0).alias("place"), F.regexp_replace("text", r" ?\| ?", "    ").alias("answer"))
    return Q.aligned_tables(spaced).select("doc_id", "columns", F.size("rows").alias("n_rows"))


@query()
def x33_people_blocks(a: Archive) -> DataFrame:
    return Q.people_blocks(a.texts.withColumnRenamed("text", "answer"))


@query(f"""WITH f AS (SELECT DISTINCT page_id, field FROM ({QA})), k AS (SELECT unnest([{", ".join(f"'{w}'" for w in Q.KEY_FIELDS)}]) AS w),
    h AS (SELECT DISTINCT page_id, w FROM f JOIN k ON contains(lower(field), lower(w)))
    SELECT page_id, round(count(w) / {len(Q.KEY_FIELDS)}, 4) AS completeness FROM (SELECT DISTINCT page_id FROM f) LEFT JOIN h USING (page_id) GROUP BY 1""")
def x34_form_completeness(a: Archive) -> DataFrame:
    return Q.form_completeness(Q.field_map(form_answers(a), key="page_id"), key="page_id")


@query(f"""SELECT doc_id, CAST(CASE WHEN count(*) > 1 THEN arg_min(width, pos) ELSE 0 END AS INT) AS columns, CAST(CASE WHEN count(*) > 1 THEN count(*) - 1 ELSE 1 END AS INT) AS n_rows
    FROM (SELECT doc_id, pos, len(string_split(line, '|')) AS width FROM ({LINES}) WHERE replace(replace(line, '|', ''), ' ', '') <> '') GROUP BY 1 HAVING max(width) > 1""")
def x35_normalise_table(a: Archive) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r"\|"))
    out = Q.normalise_table(a.texts.select("doc_id", rows.alias("rows")))
    return out.select("doc_id", F.size("headers").alias("columns"), F.size("rows").alias("n_rows"))


SPANS = """SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"""
SPANS = f"SELECT *, pos // 40 AS page, 9.0 + length(text) % 5 AS size, pos % 3 = 0 AS bold FROM ({SPANS})"
SQL_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
BODY = f"SELECT doc_id, arg_max(size, n * 1000000 - first_at) AS body FROM (SELECT doc_id, size, count(*) AS n, min(pos) AS first_at FROM ({SPANS}) WHERE {SQL_WORDS} > 3 GROUP BY ALL) GROUP BY 1"
BODY = f"SELECT d.doc_id, coalesce(b.body, 10.0)::DOUBLE AS body FROM documents d LEFT JOIN ({BODY}) b USING (doc_id)"


def spans(a: Archive) -> DataFrame:
    """The lines of the documents as spans, 40 a page, half of them in a right column on odd pages."""
    rows = a.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    right = ((F.floor(F.col("at") / 40) % 2 == 1) & (F.col("at") % 2 == 1)).cast("int")
    return rows.select("doc_id", "at", "text", F.floor(F.col("at") / 40).alias("page"), (F.length("text") % 5 + 9.0).alias("size"), (F.col("at") % 3 == 0).alias("bold"), (right * 300.0).alias("x0"), ((F.col("at") % 40) * 10.0).alias("y0"), (right * 300.0 + 250).alias("x1"), ((F.col("at") % 40) * 10.0 + 8).alias("y1"))


@query(BODY)
def l1_body_size(a: Archive) -> DataFrame:
    return P.body_size(spans(a))


@query(f"""SELECT doc_id, count(*) AS headings, CAST(sum(pos) AS BIGINT) AS places FROM ({SPANS}) JOIN ({BODY}) USING (doc_id)
    WHERE {SQL_WORDS} BETWEEN 1 AND 14 AND NOT regexp_matches(trim(text, ' '), '[.,;]$') AND (size >= 1.15 * body OR (bold AND size >= body)) GROUP BY 1""")
def l2_mark_headings(a: Archive) -> DataFrame:
    return P.mark_headings(spans(a)).where("heading").groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum("at").cast("bigint").alias("places"))


@query(f"""WITH s AS (SELECT doc_id, pos, pos // 40 AS page, CASE WHEN (pos // 40) % 2 = 1 AND pos % 2 = 1 THEN 1 ELSE 0 END AS side FROM ({LINES})),
    t AS (SELECT *, sum(side) OVER p >= 3 AND sum(1 - side) OVER p >= 3 AS two FROM s WINDOW p AS (PARTITION BY doc_id, page))
    SELECT doc_id, page, CAST(pos AS INT) AS at, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN side ELSE 0 END, pos) AS INT) AS position FROM t""")
def l3_reading_order(a: Archive) -> DataFrame:
    return P.reading_order(spans(a), 600.0).select("doc_id", "page", "at", "position")


@query(f"""WITH p AS (SELECT doc_id, page, sum({SQL_WORDS}) AS words, page % 2 AS images FROM ({SPANS}) GROUP BY doc_id, page), n AS (SELECT doc_id, count(*) AS n, greatest(1, count(*) // 5) AS step FROM p GROUP BY 1)
    SELECT doc_id, count(*) FILTER (WHERE images > 0 AND words < 20) >= count(*) * 0.6 AS scanned FROM p JOIN n USING (doc_id) WHERE page % step = 0 AND page // step < 5 GROUP BY 1""")
def l4_is_scanned(a: Archive) -> DataFrame:
    pages = spans(a).groupBy("doc_id", "page").agg(F.sum(X.word_count(F.col("text"))).alias("words")).withColumn("images", F.col("page") % 2)
    return P.is_scanned(pages)


@query("SELECT doc_id FROM documents WHERE n_chars % 300 >= 50 AND doc_id % 200 >= 50")
def l5_usable_images(a: Archive) -> DataFrame:
    images = a.table("documents").select("doc_id", (F.col("n_chars") % 300).alias("width"), (F.col("doc_id") % 200).alias("height"))
    return P.usable_images(images).select("doc_id")


@query("SELECT doc_id, sha256(string_agg(CASE WHEN pos % 10 = 0 THEN '## ' ELSE '' END || trim(text, ' '), chr(10) ORDER BY pos)) AS digest FROM (" + SPANS + ") GROUP BY 1")
def l6_emit_marked_text(a: Archive) -> DataFrame:
    marked = spans(a).withColumn("heading", F.col("at") % 10 == 0).withColumn("position", F.col("at"))
    return P.emit_marked_text(marked).select("doc_id", F.sha2("text", 256).alias("digest"))
