"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as a Parquet table, and all but the last give back the columns of
``documents``. Rejected documents go, boilerplate lines and repeated passages leave their texts, and of
each class of near duplicates one document stays.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables (which give empty tables). They look at the columns of
``documents`` alone: others, whatever they are called, are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from dossier.llm.common import DOCUMENT_COLUMNS, table, written
from dossier.llm.lines import drop_boilerplate
from dossier.llm.minhash import drop_near_duplicates
from dossier.llm.packing import pack_documents
from dossier.llm.quality import ACCEPT, score, train
from dossier.llm.queries import tokenizer_files
from dossier.llm.substring import dedup_passages
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENT_COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ACCEPT go. Without labels of both classes all stay; a null text is judged as an empty one."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*DOCUMENT_COLUMNS), model).where(F.col("quality_score") >= ACCEPT).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; null texts and documents without a source stay as they are."""
    return _recounted(drop_boilerplate(docs.select(*DOCUMENT_COLUMNS)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest doc_id stays, with all its rows, and rows without a doc_id. Null and empty texts are one class."""
    return drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of smaller doc_id has go; null texts and rows without a doc_id stay as they are."""
    return _recounted(dedup_passages(docs.select(*DOCUMENT_COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for every piece of every document; a null or empty text is its end mark alone."""
    return pack_documents(docs, *tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fitted classifier nor sampling, so the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
