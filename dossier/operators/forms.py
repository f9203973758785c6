"""Forms in plain text: questions with their answers, fields, tables, people, amounts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import AMOUNT, known_or_null, once, strip, word_count

# Words that make a short title line a label.
LABEL_WORDS = ("name", "email", "address", "state", "website", "stage", "status", "level", "model", "plan", "strategy", "no.", "registration", "gstin", "cin", "employees")
# The labels of the form, in the order in which a line is compared with them.
LABELS = (
    "Application Id", "Problem Statements", "Choose Application Track", "Name", "Email", "Contact Number", "Company Name", "CIN/Registration No", "GSTIN",
    "Startup India / DPIIT Recognition No", "UDYAM Registration", "State", "Registered Address", "Operational Address", "Website", "Year of Incorporation", "Employees", "Stage",
    "Revenue", "Funding raised till date", "Unit economics", "Committed pipeline or LOIs", "Upload financial documents",
    "Project/Product Name", "Solution Synopsis", "Explain the technology you are using in detail", "TRL Level", "IP Status", "Current Customers/Pilots", "Data Sources Used",
    "Unique Value Proposition", "Farmer-centric Benefits", "Farmer\u2011centric Benefits", "Number of farmers expected to be impacted", "How many farmers, farmer groups, or land plots",
    "Please explain your pricing strategy", "Revenue Model", "Sustainability of the Business", "Strength of Business Model", "Market size", "Total Addressable Market", "Go-to-market Strategy", "Prior Govt. Collaboration",
    "Proposed Project Duration", "Total Project Cost", "Workplan & Milestones", "Risk Assessment & Mitigation", "Training & Capacity-Building Plan", "Training & Capacity\u2011Building Plan",
    "Output expected through this project", "Proposed Project Districts", "Please specify the baseline values",
    "Founders Background", "Core Team and Leadership",
    "Describe how the solution ensures compliance with data governance", "DPDP Act", "practices do you use to evaluate model safety", "Does your project incorporate any open-source technologies",
    "Gender and Social Inclusion Plan", "Strategic impact on Maharashtra", "We confirm the accuracy",
)
# Fields that a complete form has.
KEY_FIELDS = (
    "Solution Synopsis", "TRL Level", "IP Status", "Current Customers/Pilots", "Proposed Project Duration", "Total Project Cost", "Revenue Model", "Go-to-market Strategy",
    "Unique Value Proposition", "Risk Assessment & Mitigation", "Training & Capacity-Building Plan", "Gender and Social Inclusion Plan", "Strategic impact on Maharashtra",
)


@F.pandas_udf(T.ArrayType(T.StructType().add("value", T.StringType()).add("context", T.StringType())))
def _amounts(text: pd.Series) -> pd.Series:
    """Amounts with 50 characters before and 20 after; contexts of neighbours overlap, which Spark's pattern functions can't give."""
    sign = re.compile(AMOUNT)
    around = lambda t, m: t[max(0, m.start() - 50) : m.end() + 20].strip()
    return text.map(lambda t: None if t is None else [{"value": m[1].replace(",", ""), "context": around(t, m)} for m in sign.finditer(t)])


def extract_amounts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, value, context): amounts after a currency sign, with 50 characters before and 20 after. Only texts that hold a sign go to Python."""
    held = df.where(F.col(text).rlike(AMOUNT)).select(key, F.col(text).alias("_text"))
    return held.select(key, F.posexplode(_amounts("_text")).alias("place", "a")).select(key, "place", "a.value", "a.context")


def label_pattern(label: str) -> str:
    """A label in any case, with white space or dashes between its words, and dots that may be left out."""
    loose = {" ": r"[\s\-–]+", ".": r"\.?"}
    return "(?i)" + "".join(loose.get(c, c if c.isalnum() else re.escape(c) if c.isascii() else c) for c in label)


def qa_pairs(df: DataFrame, labels: tuple[str, ...] = LABELS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, field, question, answer): a line that is a question, and the lines up to the next one.

    Lines before the first question answer ``Preamble``. Questions without an answer are dropped. Lines stay in one array per document until they are
    grouped, so their order is that of the text.
    """
    lines = df.select(key, F.posexplode(F.transform(F.split(text, "\n"), strip)).alias("at", "line")).where("line <> ''")
    line, low = F.col("line"), F.lower("line")
    # one pattern tells whether any label is there; only then is it asked which is the first
    which = F.filter(F.array(*(F.struct(F.lit(x).alias("label"), F.lit(label_pattern(x)).alias("pattern")) for x in labels)), lambda p: F.rlike(line, p["pattern"])) if labels else None
    known = line.rlike("|".join(f"(?:{label_pattern(x)})" for x in labels)) if labels else F.lit(False)
    field = F.when(known, F.get(which, F.lit(0))["label"]) if labels else F.lit(None).cast("string")
    title = (F.length(line) < 120) & (word_count(line) <= 15) & line.rlike(r"^\p{Lu}") & ~line.endswith(".")
    labelled = F.lit(False)
    for word in LABEL_WORDS:
        labelled = labelled | F.contains(low, F.lit(word))
    asks = field.isNotNull() | (line.endswith("?") & (F.length(line) < 300)) | (line.endswith(")") & (F.length(line) < 200) & (word_count(line) <= 30)) | (title & labelled)
    marked = lines.select(key, "at", "line", field.alias("known"), asks.alias("asks"))
    order = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("place", F.sum(F.col("asks").cast("int")).over(order))
    grouped = marked.groupBy(key, "place").agg(
        F.max(F.when(F.col("asks"), F.struct("line", "known"))).alias("q"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("asks"), F.struct("at", "line"))))["line"], "\n").alias("answer"),
    )
    question = F.coalesce("q.line", F.lit("Preamble"))
    return grouped.where("answer <> ''").select(key, "place", F.coalesce("q.known", question).alias("field"), question.alias("question"), "answer")


def field_map(qa: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, answer): answers of one field joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("place", "answer")))
    return qa.groupBy(key, "field").agg(F.array_join(parts["answer"], "\n").alias("answer"))


def pipe_tables(qa: DataFrame, key: str = "doc_id", text: str = "answer", place: str = "place") -> DataFrame:
    """(key, place, width, headers, rows): answers with two lines of cells or more; rows of the commonest width (the larger of equals)."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    rows = F.filter(F.transform(F.filter(F.split(F.trim(text), "\n"), lambda x: F.contains(x, F.lit("|"))), cells), lambda r: F.size(r) > 0)
    counted = lambda widths: F.array_max(F.transform(F.array_distinct(widths), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("times"), w.alias("width"))))["width"]
    table = lambda width, kept: F.struct(width.alias("width"), F.get(kept, F.lit(0)).alias("headers"), F.slice(kept, F.lit(2), F.size(kept)).alias("rows"))
    found = lambda every, width: once(F.filter(every, lambda r: F.size(r) == width), lambda kept: F.when(F.size(kept) >= 2, F.array(table(width, kept))))
    # a list of one table or none, so that no condition on it is computed apart from it
    tables = once(rows, lambda every: once(once(F.transform(every, lambda r: F.size(r)), counted), lambda width: found(every, width)))
    return qa.select(key, place, F.inline(tables))


TOLERANCE = 2  # characters that starts of one column may lie apart


def _columns_of(lines: list[str]) -> list[int]:
    """Where columns begin: word starts that half of the lines share. A start counts for the first place, in order of appearance, that it lies near to."""
    votes: dict[int, int] = {}
    first_near: dict[int, int] = {}  # for each place near to one that votes, the first such one
    for line in lines:
        for start in (m.start() for m in re.finditer(r"[^ ]+", line)):
            if start not in first_near:
                votes[start] = 0
                for place in range(start - TOLERANCE, start + TOLERANCE + 1):
                    first_near.setdefault(place, start)
            votes[first_near[start]] += 1
    return sorted(at for at, n in votes.items() if 2 * n >= len(lines))


def aligned_tables(qa: DataFrame, key: str = "doc_id", text: str = "answer", place: str = "place") -> DataFrame:
    """(key, place, columns, rows): answers of three lines or more in which three columns or more begin at the same places in half of the lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p, t in zip(batch["k"], batch["p"], batch["t"]):
                lines = (t or "").strip().split("\n")
                starts = _columns_of(lines) if len(lines) >= 3 else []
                if len(starts) >= 3:
                    cells = [[line[a:b].strip() for a, b in zip(starts, [*starts[1:], None])] for line in lines]
                    rows = [row for row in cells if any(row)]
                    if len(rows) >= 2:
                        out.append((k, p, len(starts), rows))
            yield pd.DataFrame(out, columns=[key, "place", "columns", "rows"])

    kind = dict(qa.dtypes)[key]
    return qa.select(F.col(key).alias("k"), F.col(place).cast("int").alias("p"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, place int, columns int, rows array<array<string>>")


# What tells a degree and a school, a role and a field of expertise.
DEGREES = r"(?i)Ph\.?D|M\.?Tech|B\.?Tech|MBA|M\.?Sc|B\.?Sc|M\.?S\.|B\.?E\.?"
SCHOOLS = "(?i)IIT|IIM|NIT|BITS|Stanford|MIT|Harvard|Cambridge"
ROLES = ("CEO", "CTO", "COO", "CFO", "Founder", "Co-founder", "Director", "Lead", "Head", "Manager", "Advisor", "Chief", "Officer", "VP", "President")
EXPERTISE = ("AI/ML", "Machine Learning", "Deep Learning", "Computer Vision", "NLP", "Data Science", "Agronomy", "Agriculture", "Remote Sensing", "IoT", "Satellite", "GIS", "Product", "Engineering", "Business")
PROFILE = r"https?://(?:www\.)?linkedin\.com/\S+"


def people_blocks(df: DataFrame, key: str = "doc_id", text: str = "answer") -> DataFrame:
    """(key, place, name, role, years, qualification, expertise, profile): one row a person; what is not told is empty, the profile null.

    Blocks end at a profile's address; without any, a line that begins with two capitalised words begins one. A block's first line is the name, if it is two to
    six words without digits and below 60 characters; blocks without a name are left out. The role is the first of the next three lines that holds a word for one.
    """
    has = F.col(text).rlike(PROFILE)
    by_profile = F.split(text, PROFILE)
    ends = F.regexp_extract_all(text, F.lit(f"({PROFILE})"), F.lit(1))
    with_end = F.transform(F.slice(by_profile, F.lit(1), F.size(ends)), lambda b, i: F.struct(F.concat(b, F.get(ends, i)).alias("text"), F.get(ends, i).alias("profile")))
    by_name = F.transform(F.split(text, r"\n(?=[A-Z][a-z]+ [A-Z])"), lambda b: F.struct(b.alias("text"), F.lit(None).cast("string").alias("profile")))
    rows = df.select(key, F.posexplode(F.when(has, with_end).otherwise(by_name)).alias("place", "block")).withColumn("block_text", strip(F.col("block.text"))).where(F.length("block_text") >= 10)
    lines = F.filter(F.transform(F.split("block_text", "\n"), strip), lambda x: x != "")
    rows = rows.withColumn("lines", lines)
    first, rest = F.get("lines", F.lit(0)), F.array_join(F.slice("lines", F.lit(2), F.size("lines")), " ")
    named = word_count(first).between(2, 6) & ~first.rlike(r"\p{Nd}") & (F.length(first) < 60)
    holds = lambda line, words: reduce(Column.__or__, (F.contains(F.lower(line), F.lit(w.lower())) for w in words))
    skills = F.filter(F.array(*map(F.lit, EXPERTISE)), lambda w: F.contains(F.lower(F.col("rest")), F.lower(w)))
    out = rows.where(named).select(key, "place", first.alias("name"), "lines", rest.alias("rest"), F.col("block.profile").alias("profile"))
    role = F.get(F.filter(F.slice("lines", 2, 3), lambda line: holds(line, ROLES)), F.lit(0))
    return out.select(
        key,
        "place",
        "name",
        F.coalesce(role, F.lit("")).alias("role"),
        F.regexp_extract("rest", r"(?i)\d+\+?\s*(?:years?|yrs?)", 0).alias("years"),
        F.trim(F.concat_ws(" ", F.regexp_extract("rest", DEGREES, 0), F.regexp_extract("rest", SCHOOLS, 0))).alias("qualification"),
        F.array_join(skills, ", ").alias("expertise"),
        "profile",
    )


def form_completeness(fields: DataFrame, key: str = "doc_id", wanted: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """(key, completeness): the share of wanted labels that some field's name contains."""
    low = F.lower("field")
    hits = [F.max(F.contains(low, F.lit(w.lower())).cast("int")) for w in wanted]
    return fields.groupBy(key).agg(F.round(sum(hits[1:], hits[0]) / len(wanted), 4).alias("completeness"))


def normalise_table(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Cells trimmed and on one line, empty rows gone, the first row as headers if more follow; tables of one column are dropped."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    out = df.withColumn("_rows", clean).where(F.coalesce(F.array_max(F.transform("_rows", lambda r: F.size(r))), F.lit(0)) > 1)
    several = F.size("_rows") > 1
    headers = F.when(several, F.element_at("_rows", 1)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("headers", headers).withColumn(rows, F.when(several, F.slice("_rows", F.lit(2), F.size("_rows"))).otherwise(F.col("_rows"))).drop("_rows")


METADATA_TEXTS = ("title", "company", "contact_email", "website", "category", "theme", "problem_statement", "solution_summary", "target_beneficiaries")
METADATA_LISTS = {"categories": 2, "technology_used": None, "districts": None}  # how many stay


def clean_metadata(df: DataFrame) -> DataFrame:
    """Words for nothing become null, in texts and in lists; of categories two stay; years are numbers, levels 1 to 9, the confidence is 0 to 1 (0 where it is no number).

    Whichever of the known columns are there are cleaned: METADATA_TEXTS, METADATA_LISTS, year, level and confidence.
    """
    number = lambda c, t: strip(F.col(c).cast("string")).try_cast(t)
    out = {c: known_or_null(F.col(c)) for c in METADATA_TEXTS}
    for c, most in METADATA_LISTS.items():
        kept = F.array_compact(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), known_or_null)) if c in df.columns else None
        out[c] = F.slice(kept, 1, most) if most and kept is not None else kept
    if "level" in df.columns:
        level = number("level", "int")
        out["level"] = F.when(level.between(1, 9), level)
    if "year" in df.columns:
        out["year"] = number("year", "int")
    if "confidence" in df.columns:
        out["confidence"] = F.least(F.greatest(F.coalesce(number("confidence", "double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: v for c, v in out.items() if c in df.columns})


def metadata_input(sections: DataFrame, names: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("identity", "problem", "solution", "team", "vision")) -> DataFrame:
    """(key, input): the file's name, then the listed sections in order; without any of these the first 12000 characters of the text."""
    listed = F.array(*[F.lit(s) for s in order])
    kept = sections.where(F.col("section").isin(*order)).withColumn("place", F.array_position(listed, F.col("section")))
    joined = kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "text")))["text"], "\n\n").alias("_parts"))
    out = names.join(joined, key, "left")
    return out.select(key, F.concat_ws("\n\n", "filename", F.coalesce("_parts", F.substring("text", 1, 12000))).alias("input"))
