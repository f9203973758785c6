"""Page layout from spans (doc_id, page, text, size, bold, x0, y0, x1, y1) and facts of pages and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count

DEFAULT_SIZE, HEADING_RATIO, HEADING_WORDS = 10.0, 1.15, 14


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body): the commonest size of spans of more than three words, the first seen of equals; 10 if there are none.

    ``at`` is a span's place in its document.
    """
    long = spans.where((F.col("size") > 0) & (word_count(F.col("text")) > 3))
    sizes = long.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = sizes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "size"))["size"].alias("body"))
    return spans.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(DEFAULT_SIZE)).alias("body"))


def mark_headings(spans: DataFrame) -> DataFrame:
    """``spans`` with ``heading``: few words, no closing sign, and larger than the body or bold at its size."""
    out = spans.join(body_size(spans), "doc_id")
    stands_out = (F.col("size") >= HEADING_RATIO * F.col("body")) | (F.col("bold") & (F.col("size") >= F.col("body")))
    return out.withColumn("heading", word_count(F.col("text")).between(1, HEADING_WORDS) & ~F.trim("text").rlike(r"[.,;]$") & stands_out)


def reading_order(spans: DataFrame, width: float) -> DataFrame:
    """``spans`` with ``position`` in their page: by columns if two stand apart, else by line and from the left."""
    left, right = F.col("x1") < width / 2 * 1.05, F.col("x0") > width / 2 * 0.95
    sides = spans.groupBy("doc_id", "page").agg(F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.count("*").alias("n"))
    two = (F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("n") - F.col("l") - F.col("r") <= 0.2 * F.col("n"))
    out = spans.join(sides.select("doc_id", "page", two.alias("two")), ["doc_id", "page"])
    out = out.where(~F.col("two") | left | right)
    column = F.when(F.col("two") & right & ~left, 1).otherwise(0)
    line = F.when(F.col("two"), F.col("y0")).otherwise(F.round("y0", 1))
    across = F.when(~F.col("two"), F.col("x0"))
    return out.withColumn("position", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(column, line, across, "at"))).drop("two")


def is_scanned(pages: DataFrame, sample: int = 5) -> DataFrame:
    """(doc_id, scanned): of up to five evenly spaced pages, six in ten have images and fewer than 20 words. Pages: doc_id, page from 0, words, images."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / sample))
    picked = pages.join(counts, "doc_id").where((F.col("page") % step == 0) & (F.col("page") / step < sample))
    low = F.count_if((F.col("images") > 0) & (F.col("words") < 20))
    return picked.groupBy("doc_id").agg((low >= F.count("*") * 0.6).alias("scanned"))


def usable_images(images: DataFrame, least: int = 50) -> DataFrame:
    return images.where((F.col("width") >= least) & (F.col("height") >= least))


def emit_marked_text(spans: DataFrame) -> DataFrame:
    """(doc_id, text): spans in order as lines, headings marked. Needs heading and position."""
    line = F.concat(F.when(F.col("heading"), "## ").otherwise(""), F.trim("text"))
    parts = F.array_sort(F.collect_list(F.struct("page", "position", line.alias("line"))))
    return spans.groupBy("doc_id").agg(F.array_join(parts["line"], "\n").alias("text"))
