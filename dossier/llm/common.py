"""Shared helpers of the training-data operators: tables, cuts in the lineage, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TEXTS_A_BATCH = 500
BYTES_A_BATCH = 1 << 22
BYTES_A_SLICE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all run in one process (tests)
    is a temporary folder made, once per session; elsewhere an unset one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.dossier.scratch.dir", None)
    if not own:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.dossier.scratch.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read it instead of recomputing.

    The table outlives any executor, so a lost one costs a task and not the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, rows: int = TEXTS_A_BATCH) -> None:
    """Python workers get at most so many texts at once, and no more than one row beyond BYTES_A_BATCH (Spark's own bounds are 10,000 rows and 64 MB).

    Sets the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``, unless they are smaller already. Results don't depend on them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).lower()
    if not given.rstrip("b").isdigit() or not 0 < int(given.rstrip("b")) <= BYTES_A_BATCH:  # with a unit: set to bytes
        spark.conf.set(name, str(BYTES_A_BATCH))


def in_slices(batch, texts, size: int = BYTES_A_SLICE) -> Iterator:
    """An Arrow batch in slices whose ``texts`` (an array of the batch) have about so many bytes together; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > size:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def is_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more rows than that; looks at one row more at most."""
    return df.limit(rows + 1).count() <= rows


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
