"""Line dedup by site-relative frequency, with DataFrame functions only.

A line (its text without spaces at the ends) is boilerplate of a host if it stands on more than
``ratio`` of that host's pages, and on ``min_pages`` of them at least. Boilerplate lines are
dropped from the host's pages, wherever and however often they stand there.

Lines go through the shuffle as 64-bit hashes, once a page, and are counted before it, so a host
or a line that holds a third of all rows arrives as one row a task. A host has at most (mean lines
of its pages) / ``ratio`` such lines. Their table is broadcast while it is small, which is looked
at; beyond that it is joined by host, where adaptive execution splits large hosts.

Blank lines are never dropped. Null texts stay null; pages whose host is null form no site and stay as they
are. A page that loses all its lines keeps an empty text. Repeated rows count as pages of their own. Texts of any length are
taken whole. A line at the ratio exactly stays. An empty table gives an empty result. Other columns stay, whatever they are called, but for n_lines and
n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_at_most, written

BROADCAST_LINES = 50_000  # 8 bytes each and the host's name: some MB


def _key(line):
    return F.xxhash64(F.trim(line))


def _lines(text: str):
    return F.split(F.col(f"`{text}`"), "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, key, pages, share): the boilerplate lines of each host, by hash."""
    sites = pages.where(F.col(f"`{host}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    totals = sites.groupBy("host").agg(F.count("*").alias("total"))
    own = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: F.trim(x) != ""), _key))
    counted = sites.select("host", F.explode(own).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages"))
    shares = counted.where(F.col("pages") >= min_pages).join(totals, "host").withColumn("share", F.col("pages") / F.col("total"))
    return shares.where(F.col("share") > ratio).select("host", "key", "pages", "share")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``pages`` with the text of its kept lines, plus ``n_lines`` and ``n_dropped`` (null for a null text; they replace columns of those names)."""
    found = written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    by_host = found.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    if is_at_most(found, BROADCAST_LINES):
        by_host = F.broadcast(by_host)
    # a page's columns travel as one, so their names meet no others
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{host}`").alias("of_host"), _lines(text).alias("lines"))
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("keys"), _key(x))))
    out = rows.join(by_host, F.col("of_host") == F.col("host"), "left").withColumn("kept", kept)
    size = F.when(F.col("lines").isNotNull(), F.size("lines"))
    new = {"n_lines": size, "n_dropped": size - F.size("kept"), text: F.array_join("kept", "\n")}
    names = [*pages.columns, *[n for n in new if n not in pages.columns]]
    return out.select(*[new.get(c, F.col(f"page.`{c}`")).alias(c) for c in names])
