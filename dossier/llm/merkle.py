"""Document fingerprints as Merkle trees, with DataFrame functions only.

A text is cut into sections (at an empty line), these into paragraphs (lines), these into pieces of ``PIECE`` characters,
counted from the paragraph's start. A leaf is the SHA-256 of a piece; the node of a paragraph, a section and the root is the SHA-256 of
its children's nodes. The cuts lose nothing, so two roots are equal only if the texts are. An edit leaves alone the leaves before it in its
paragraph and all other paragraphs, so the share of common leaves says how alike two texts are, and differing nodes where they differ.

The fingerprint is a string: the root, then the nodes of sections and paragraphs (16 digits each) and
the leaves (8 digits each), the four parts parted by dots. Likeness is the Jaccard similarity of two fingerprints' leaves.

Null texts count as empty; an empty text has one empty section with one empty paragraph and no leaves. Two texts without leaves are alike (1). Texts of any
length are taken whole. Rows with a null id are ordered first; rows with one id by a hash of id and text. Rows that repeat both id and text are
fingerprinted once and given as often as they came: each is followed by the next repeat, the last by the next row. An empty table gives an empty result. Other columns, whatever they are called, are left out.

Texts move once, by a hash of id and text, so no id is hot. Their order is found on numbers alone: rows are numbered over ranges of ids,
and each sends its leaves and the characters that are asked for to the row before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sharding import numbered

PIECE = 32


def leaves(text: Column) -> Column:
    """The leaves of each paragraph, by section and paragraph."""
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), cut))


def pieces(nested: Column) -> Column:
    """All leaves in order, 8 digits each."""
    return F.transform(F.flatten(F.flatten(nested)), lambda x: F.substring(x, 1, 8))


def paragraph_nodes(nested: Column) -> Column:
    """The node of each paragraph over its leaves, by section."""
    return F.transform(nested, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ","), 256)))


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.array_join(s, ","), 256))


def root_node(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ","), 256)


def _short(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.substring(n, 1, 16)), "")


def with_fingerprint(df: DataFrame, text: str, out: str, pieces_column: str) -> DataFrame:
    """``df`` with the fingerprint of a text column and, in another column, its pieces. Each leaf is hashed once."""
    df = df.withColumn("_leaves", leaves(F.col(text)))
    df = df.withColumn(pieces_column, pieces(F.col("_leaves"))).withColumn("_paragraphs", paragraph_nodes(F.col("_leaves"))).drop("_leaves")
    df = df.withColumn("_sections", section_nodes(F.col("_paragraphs")))
    parts = [root_node(F.col("_sections")), _short(F.col("_sections")), _short(F.flatten("_paragraphs")), F.array_join(pieces_column, "")]
    return df.withColumn(out, F.concat_ws(".", *parts)).drop("_paragraphs", "_sections")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two fingerprints' pieces; 1 for two without any."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def _nodes(fingerprint: Column, part: int) -> Column:
    return F.regexp_extract_all(F.split(fingerprint, r"\.")[part], F.lit(".{16}"), F.lit(0))


def differing(left: Column, right: Column) -> Column:
    """Where two fingerprints differ: struct of the numbers (from 0) of sections and of paragraphs.

    Equal roots give empty lists; otherwise nodes are compared place by place, and places that only one has differ.
    """

    def places(part: int) -> Column:
        a, b = _nodes(left, part), _nodes(right, part)
        pairs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
        return F.filter(F.transform(pairs, lambda differs, i: F.when(differs, i)), lambda i: i.isNotNull())

    same = F.split(left, r"\.")[0] == F.split(right, r"\.")[0]
    none = F.array().cast("array<int>")
    return F.struct(F.when(same, none).otherwise(places(1)).alias("sections"), F.when(same, none).otherwise(places(2)).alias("paragraphs"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, times, head, next_leaves) of each different row of key and text (null: empty), which came ``times`` times.

    ``head``: the first floor(n / 4) characters of the next row's text, n the length of this one's; ``next_leaves``: the next
    row's leaves, 8 digits each, in one string. Next is the row of the next larger key; after the last comes the first. Null keys
    stand first; equal keys are ordered by a hash of key and text. Rows are told apart by 128 bits of key and text.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("a", F.xxhash64("key", "text")).withColumn("b", F.xxhash64(F.lit(PIECE), "key", "text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    ids = rows.groupBy("a", "b").agg(F.first("key").alias("key"), F.first(quarter).alias("asked"), F.count("*").alias("times"))
    placed, n_rows = numbered(ids, "key")
    at = placed.select("row_number", "row.*")
    before = at.select(F.pmod(F.col("row_number") + 1, F.lit(max(n_rows, 1))).alias("row_number"), *(F.col(c).alias(f"to_{c}") for c in ("a", "b", "asked")))
    ring = at.join(before, "row_number").drop("row_number", "asked")
    texts = rows.select("a", "b", "text").dropDuplicates(["a", "b"])  # the same columns for both joins, so that the texts are shuffled once
    sent = texts.join(ring.drop("key", "times"), ["a", "b"])
    head = F.substring("text", F.lit(1), F.col("to_asked"))
    sent = sent.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), head.alias("head"), F.array_join(pieces(leaves(F.col("text"))), "").alias("next_leaves"))
    own = texts.join(ring.select("a", "b", "key", "times"), ["a", "b"])
    return own.join(sent, ["a", "b"]).select("key", "text", "times", "head", "next_leaves")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, how alike they are, and how many sections and paragraphs the edit reaches.

    Edited: the last floor(n / 4) characters replaced by the first as many of the next document.
    """
    rows = with_next(docs, key, text).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("_m", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = with_fingerprint(rows, "text", "fingerprint", "pieces")
    last = F.struct(F.lit(1).cast("bigint").alias("rows"), F.lit(False).alias("repeat"))
    earlier = F.struct((F.col("times") - 1).alias("rows"), F.lit(True).alias("repeat"))  # rows whose next row is their repeat
    rows = rows.select("*", F.inline(F.when(F.col("times") > 1, F.array(last, earlier)).otherwise(F.array(last))))
    head = F.when(F.col("repeat"), F.substring("text", F.lit(1), F.col("_m"))).otherwise(F.col("head"))
    following = F.when(F.col("repeat"), F.col("pieces")).otherwise(F.regexp_extract_all("next_leaves", F.lit(".{8}"), F.lit(0)))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_m")).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, head)).withColumn("next_pieces", following)
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", "edited_pieces")
    rows = rows.withColumn("edits", differing(F.col("fingerprint"), F.col("edited_fingerprint")))
    rows = rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"),
        likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
        F.size("edits.sections").alias("edited_sections"),
        F.size("edits.paragraphs").alias("edited_paragraphs"),
        "rows",
    )
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).drop("rows", "_row")
