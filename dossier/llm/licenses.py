"""Licence scan of a file tree, with DataFrame functions only.

Every sentence of every file is a possible header. Its TF-IDF cosine to each licence template is
computed sparsely: a sentence goes on only if the template terms it has could reach the threshold
at all (by Cauchy-Schwarz the cosine is at most the length of the template's shared part), and of
these few the terms are exploded, weighted by a join with the templates' table and summed up.
The templates are a fixed list of a few dozen terms, so their table is broadcast.

Licences are also written as headers of several lines and as whole files: ``licence_texts`` holds the standard headers and whole texts
by SPDX name. Every file's whole text is scored against the whole texts, and every run of as many words as a header has
that starts at a line against the headers. Files go on only if they can reach the threshold: the different terms that they share with a template, looked up in
an inverted table, are long enough (as for sentences), then the run shares enough different terms. An SPDX tag names its licence and counts as a header.

A file's licence is that of its best header or whole text, else that of its best sentence; "All rights reserved" stands for none
where the text grants a permission. A file that is called like one (LICENSE, COPYING, NOTICE) or whose
notice makes up a third of it is a licence file and speaks for its directory. Files without a licence
of their own inherit that of the nearest directory above them that has one; the directories, not
the files, are joined with their ancestors.

Null texts and null paths have no licence; a null path inherits none. Ties go to the licence that comes first by name. Files that
repeat a path count as one file with several texts: the best notice of any holds for all. Empty texts have no licence, texts of any length are scored whole, and an empty table
gives an empty result. Other columns stay, whatever they are called, but for ``text`` and those that the result's own replace.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Wordings of notices, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Words that carry no weight.
STOPWORDS = ("a", "and", "are", "by", "for", "in", "is", "of", "or", "the", "this", "to", "with", "without")
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
PERMISSION = r"(?i)permission\s+to\s+use|permission\s+is\s+hereby\s+granted|redistribution\s+and\s+use\s+in"
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"
THRESHOLD = 0.8
WORD = r"[\p{L}\p{N}]+"


def _terms_of(text: str) -> Counter:
    return Counter(w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOPWORDS)


def template_weights(templates=TEMPLATES) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Each term's inverse document frequency, that of an unknown term, and unit vectors by licence."""
    terms = {name: _terms_of(text) for name, text in templates}
    n = len(terms)
    found = Counter(w for t in terms.values() for w in t)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in found.items()}
    units = {}
    for name, count in terms.items():
        weights = {w: k * idf[w] for w, k in count.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        units[name] = {w: x / norm for w, x in weights.items()}
    return idf, math.log(1 + n) + 1, units


def _could_reach(terms: Column, units: dict[str, dict[str, float]], threshold: float) -> Column:
    """Whether the terms shared with some template are long enough for the threshold."""
    any_of = F.lit(False)
    for unit in units.values():
        shared = sum((F.when(F.array_contains(terms, w), u * u).otherwise(0.0) for w, u in sorted(unit.items())), F.lit(0.0))
        any_of = any_of | (shared + 1e-9 >= threshold * threshold)
    return any_of


@cache
def passage_templates() -> dict[str, str]:
    """Headers and whole texts by file name, which is SPDX name, kind and .txt."""
    return {f.name: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _licence_of(name: str) -> str:
    return name.removesuffix(".txt").rsplit(".", 1)[0]


def _least_shared(unit: dict[str, float], threshold: float) -> int:
    """How many different terms a text must share with a template at least to reach it."""
    shared = 0.0
    for n, u in enumerate(sorted(unit.values(), reverse=True), 1):
        shared += u * u
        if shared + 1e-9 >= threshold * threshold:
            return n
    return len(unit)


def _reaches_any(known: Column, units: dict[str, dict[str, float]], threshold: float) -> Column:
    """Whether the terms, all of them some template's, are long enough for a template.

    What a term adds to each template is looked up in a constant, an inverted table: by its first two letters, then whole.
    """
    table: dict[str, dict[str, list]] = {}
    for i, unit in enumerate(units.values()):
        for w, u in sorted(unit.items()):
            table.setdefault(w[:2], {}).setdefault(w, []).append({"i": i, "square": u * u})
    inverted = F.from_json(F.lit(json.dumps(table)), "map<string,map<string,array<struct<i:int,square:double>>>>")
    added = F.flatten(F.transform(known, lambda w: F.element_at(F.element_at(inverted, F.substring(w, 1, 2)), w)))
    none = F.array_repeat(F.lit(0.0), len(units))
    # all sums in one pass over what the terms add
    sums = F.aggregate(added, none, lambda n, x: F.transform(n, lambda s, i: F.when(i == x["i"], s + x["square"]).otherwise(s)))
    return F.array_max(sums) + 1e-9 >= threshold * threshold


def passages(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, share): every header and whole text in each file that is at the threshold."""
    texts = passage_templates()
    idf, unknown, units = template_weights(tuple(texts.items()))
    spark = files.sparkSession
    whole = [n for n in texts if ".whole." in n]
    weights = F.broadcast(spark.createDataFrame([(w, idf[w], [(n, u[w]) for n, u in units.items() if w in u]) for w in sorted(idf)], "word string, idf double, units array<struct<name:string,unit:double>>"))
    headers = [(n, sum(1 for _ in re.finditer(r"[^\W_]+", t)), sorted(units[n]), _least_shared(units[n], threshold)) for n, t in texts.items() if n not in whole]
    headers = F.broadcast(spark.createDataFrame(headers, "name string, long int, terms array<string>, least int"))

    def words(column: str) -> Column:
        return F.filter(F.col(column), lambda w: ~w.isin(*STOPWORDS))

    def scored(rows: DataFrame, *keys: str) -> DataFrame:
        """Cosine and length of the shared terms for each template of which rows (keys, words) have a term."""
        counted = rows.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("tf"))
        weighed = counted.join(weights, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
        one = F.struct(F.lit("").alias("name"), F.lit(0.0).alias("unit"))  # carries the norm
        long = weighed.select(*keys, "w", F.explode(F.concat(F.array(one), F.coalesce("units", F.array().cast("array<struct<name:string,unit:double>>")))).alias("u"))
        u = F.col("u.unit")
        sums = long.groupBy(*keys, F.col("u.name").alias("template")).agg(F.sum(F.col("w") * u).alias("dot"), F.sum(u * u).alias("shared"), F.sum(F.col("w") * F.col("w")).alias("square"))
        # one row a text: its templates beside its norm
        listed = sums.groupBy(*keys).agg(F.max(F.when(F.col("template") == "", F.sqrt("square"))).alias("norm"), F.collect_list(F.when(F.col("template") != "", F.struct("template", "dot", "shared"))).alias("t"))
        return listed.select(*keys, F.explode(F.filter("t", lambda t: t["shared"] + 1e-9 >= threshold * threshold)).alias("t"), "norm").select(
            *keys, "t.template", F.round(F.col("t.dot") / F.col("norm"), 6).alias("score"))

    # in the row, before any text is shuffled: a file goes on only if the different terms that it shares with some template are long enough
    low = F.lower("text")
    known = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: w.isin(*sorted(idf))))
    rows = files.where(F.col("path").isNotNull()).select("path", "text", low.alias("low"), known.alias("known"))
    rows = rows.where(F.size("known") >= min(_least_shared(u, threshold) for u in units.values())).where(_reaches_any(F.col("known"), units, threshold)).drop("known")
    # dealt by file once: all that is grouped below has the file among its keys and is not dealt again
    rows = rows.select("path", F.md5("text").alias("key"), "low").groupBy("path", "key").agg(F.max("low").alias("low"))
    split = rows.withColumn("words", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    near = scored(split.select("path", "key", words("words").alias("words")), "path", "key")
    wholes = near.where(F.col("template").isin(*whole) & (F.col("score") >= threshold)).select("path", "template", "score", F.lit(1.0).alias("share"))

    wanted = near.join(headers, F.col("template") == F.col("name")).select("path", "key", "template", "long", "terms", "least")
    by_line = F.transform(F.split("low", "\n"), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    marked = F.flatten(F.transform(by_line, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), (i == 0).alias("first")))))
    lined = rows.select("path", "key", F.length("low").alias("chars"), marked.alias("m")).join(wanted, ["path", "key"])
    starts = F.filter(F.transform("m.first", lambda first, i: F.when(first, i)), lambda i: i.isNotNull())
    begun = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice(F.col("m.w"), at + 1, F.col("long")).alias("run")))
    enough = F.filter(begun, lambda r: F.size(F.array_intersect(r["run"], F.col("terms"))) >= F.col("least"))
    runs = lined.select("path", "key", "template", "chars", F.inline(enough))  # chosen in the row, so that no row carries the whole text beside a run
    share = F.least(F.lit(1.0), F.length(F.array_join("run", " ")) / F.col("chars"))
    runs = runs.select("path", "key", "at", F.col("template").alias("header"), share.alias("share"), words("run").alias("words"))
    hits = scored(runs, "path", "key", "at", "header", "share").where((F.col("template") == F.col("header")) & (F.col("score") >= threshold))

    licence = F.element_at(F.create_map(*[F.lit(x) for n in texts for x in (n, _licence_of(n))]), F.col("template"))
    return wholes.unionByName(hits.select("path", "template", "score", "share")).select("path", licence.alias("licence"), "score", "share")


def tagged(files: DataFrame) -> DataFrame:
    """(path, licence, score, share): the licences that SPDX tags name, without what says whether later versions hold too."""
    rows = files.where(F.col("path").isNotNull() & F.contains("text", F.lit("SPDX-License-Identifier:")))
    names = rows.select("path", F.length("text").alias("chars"), F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("name"))
    licence = F.regexp_replace("name", r"(-only|-or-later|\+)$", "")
    return names.select("path", licence.alias("licence"), F.lit(1.0).alias("score"), ((F.length("name") + 25) / F.col("chars")).alias("share"))


def notices(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, share): the best notice of each file that has one at the threshold; headers and whole texts go before sentences.

    ``share``: that notice's part of the whole text.
    """
    idf, unknown, units = template_weights(templates)
    spark = files.sparkSession
    names = sorted(units)
    known = sorted({w for unit in units.values() for w in unit})
    any_known = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(known) + r")(?![\p{L}\p{N}])"
    rows = files.where(F.col("path").isNotNull() & F.col("text").rlike(any_known)).select("path", "text")
    sentences = F.filter(F.split("text", r"\n|(?<=[.!?])\s+"), lambda s: s.rlike(any_known))
    rows = rows.select("path", F.length("text").alias("chars"), F.col("text").rlike(PERMISSION).alias("granted"), F.posexplode(sentences).alias("at", "sentence"))
    words = F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    rows = rows.withColumn("words", words).where(_could_reach(F.col("words"), units, threshold))

    weights = spark.createDataFrame([(w, idf[w], {n: units[n][w] for n in names if w in units[n]}) for w in known], "word string, idf double, unit map<string,double>")
    counted = rows.select("path", "at", "granted", (F.length("sentence") / F.col("chars")).alias("share"), F.explode("words").alias("word"))
    counted = counted.groupBy("path", "at", "granted", "share", "word").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(weights), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    dots = [F.sum(F.col("w") * F.coalesce(F.element_at("unit", F.lit(n)), F.lit(0.0))).alias(n) for n in names]
    sums = weighed.groupBy("path", "at", "granted", "share").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    scored = F.array(*[F.struct(F.round(F.col(f"`{n}`") / F.col("norm"), 6).alias("score"), F.lit(n).alias("licence")) for n in names])
    long = sums.select("path", "granted", "share", F.explode(scored).alias("s")).where((F.col("s.score") >= threshold) & ~(F.col("granted") & (F.col("s.licence") == "Proprietary")))
    headers = passages(files, threshold).unionByName(tagged(files)).withColumn("level", F.lit(0))
    found = long.select("path", F.lit(1).alias("level"), "s.licence", "s.score", "share").unionByName(headers)
    best = found.groupBy("path").agg(F.min(F.struct("level", (-F.col("score")).alias("less"), "licence", (-F.col("share")).alias("part"))).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"), (-F.col("b.part")).alias("share"))


def _directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, notice_share: float = 1 / 3) -> DataFrame:
    """``files`` (path, text and any other columns but ``text`` in the result) with its licences.

    Adds licence, origin (``notice``, ``inherited`` or ``none``), score (of its own notice) and governed_by (the directory inherited from).
    """
    own = written(notices(files, templates, threshold), "notices")  # read twice
    speaks = F.col("path").rlike(LICENCE_FILE) | (F.col("share") >= notice_share)
    ranked = F.struct((-F.col("score")).alias("less"), F.col("licence").alias("licence"))
    heads = own.where(speaks).groupBy(_directory(F.col("path")).alias("above")).agg(F.min(ranked)["licence"].alias("inherited"))

    folders = files.where(F.col("path").isNotNull()).select(_directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = folders.select("folder", F.explode(F.array_distinct(above)).alias("above")).join(heads, "above")
    nearest = chain.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "inherited")).alias("n"))
    nearest = nearest.select("folder", F.col("n.above").alias("governed_by"), "n.inherited")

    rest = [c for c in files.columns if c.lower() not in ("text", "licence", "origin", "score", "governed_by")]
    # other columns travel in a struct, so that no name can clash
    kept = files.select(F.col("path").alias("_path"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row")).withColumn("_folder", _directory(F.col("_path")))
    out = kept.join(own.select(F.col("path").alias("_path"), F.col("licence").alias("_own"), F.col("score").alias("_score")), "_path", "left")
    out = out.join(nearest.withColumnRenamed("folder", "_folder"), "_folder", "left")
    origin = F.when(F.col("_own").isNotNull(), "notice").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    governed = F.when(F.col("_own").isNull(), F.col("governed_by"))
    columns = [F.col("_row").getField(c).alias(c) for c in rest]
    return out.select(*columns, F.coalesce("_own", "inherited").alias("licence"), origin.alias("origin"), F.col("_score").alias("score"), governed.alias("governed_by"))
