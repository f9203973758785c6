"""Files as rows: identity, acceptance and text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FORMATS, MAX_BYTES, MEDIA_TYPES
from ..operators.sections import clean_text
from ..session import shared_dir, written

WHOLE = 1 << 27  # bytes of a file that one task reads whole
PIECE = 1 << 27  # bytes of a larger file that a task hashes
CHUNK = 1 << 20  # bytes of a row with a part of a file
CODECS = "(?i)[.](gz|bz2|deflate|lz4|snappy|zst|zstd)$"  # Spark's text reader would unpack these
BOM = b"\xef\xbb\xbf"  # left out by Spark's text reader at the start of a file


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content, size and the SHA-256 of the bytes, which is a file's identity. Spark's reader lists no empty files."""
    files = _listed(spark, path)
    return files.select("path", _name(), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("name")


def _pieced() -> Column:
    """Which files are hashed in pieces. On the listing alone, so that Spark opens no others."""
    return (F.col("_metadata.file_size") > WHOLE) & ~F.col("_metadata.file_path").rlike(CODECS)


def identify_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size and the SHA-256 of files of any size, without their content.

    Files of up to WHOLE bytes are hashed as ``read_files`` does. Of larger ones no task reads more than about PIECE bytes: they are split by Spark's text
    reader, and the hash goes on from piece to piece, a round of tasks each, by its state. Larger files that the text reader would unpack (CODECS) are read whole.
    """
    files = _listed(spark, path)
    whole = files.where(~_pieced()).select("path", _name(), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(_pieced()).select("path", F.col("length").alias("size"), F.col("_metadata.file_path").alias("at"))
    if large.isEmpty():
        return whole
    large = written(large, "large")
    return whole.unionByName(_hashed_in_pieces(large, _pieces(spark, path, large)).select("path", _name(), "size", "sha256"))


def _pieces(spark: SparkSession, path: str, large: DataFrame) -> DataFrame:
    """(at, start, seq, n, data, round): the bytes of large files in rows of up to CHUNK, in the order of start and seq. A line end follows a last line that has none."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for batch in batches:
            for (at, start), lines in batch.groupby(["at", "start"], sort=False)["data"]:
                raw = b"".join(lines)
                for lo in range(0, len(raw), CHUNK):
                    data = raw[lo : lo + CHUNK]
                    yield pd.DataFrame({"at": [at], "start": [start], "seq": [seq], "n": [len(data)], "data": [data], "round": [start // PIECE]})
                    seq += 1

    schema = "at string, start bigint, seq bigint, n bigint, data binary, round bigint"
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = lines.where(_pieced()).select(
        F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data")
    )
    folder = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    lines.join(F.broadcast(large.select("at")), "at", "left_semi").mapInPandas(chunks, schema).write.partitionBy("round").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _hashed_in_pieces(large: DataFrame, pieces: DataFrame) -> DataFrame:
    """``large`` (path, size, at) with the SHA-256 of its pieces. Each file has a task of its own in each round."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None

        def state() -> pd.DataFrame:
            return pd.DataFrame({"at": [known.at], "part": [known.part], "size": [known.size], "held": [known.held], "done": [done], "state": [sha.state()], "sha256": [sha.hexdigest()]})

        for batch in batches:
            for row in batch.itertuples(index=False, name="Row"):
                if row.start < 0:  # the state stands before the file's rows
                    if known is not None:
                        yield state()
                    known, done, sha = row, row.done, Sha256(row.data)
                    data = BOM if row.data is None and row.held < row.size else b""
                else:
                    data = row.data[: known.size - done]
                sha.update(data)
                done += len(data)
        if known is not None:
            yield state()

    schema = "at string, part bigint, size bigint, held bigint, done bigint, state binary, sha256 string"
    held = pieces.groupBy("at").agg(F.sum("n").alias("held"))
    files = large.select("at", "size", (F.row_number().over(W.orderBy("at")) - 1).cast("bigint").alias("part")).join(held, "at", "left")
    states = files.select("at", "part", "size", F.coalesce("held", F.lit(0)).alias("held"), F.lit(0).cast("bigint").alias("done"), F.lit(None).cast("binary").alias("state"))
    states = written(states, "hashes")
    count, rounds = states.count(), pieces.agg(F.max("round")).first()[0]
    for number in range(rounds + 1):
        columns = [F.col("size"), F.col("held"), F.col("done")]
        first = states.select("at", "part", F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("seq"), F.col("state").alias("data"), *columns)
        rest = pieces.where(F.col("round") == number).join(F.broadcast(states.select("at", "part", *columns)), "at").select(*first.columns)
        rows = first.unionAll(rest).repartitionById(count, F.col("part").cast("int")).sortWithinPartitions("part", "start", "seq")
        states = written(rows.mapInPandas(hashed, schema), "hashes")
    complete = F.when(F.col("done") == F.col("size"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("Not read whole: "), F.col("at"))))
    return large.join(states.select("at", complete.alias("sha256")), "at")


class Sha256:
    """SHA-256 as hashlib's, but its state can be taken on by another process: OpenSSL's functions below hashlib, on a context of bytes."""

    class Context(ctypes.Structure):
        _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.library = ctypes.CDLL(_hashlib.__file__)
        self.context = self.Context() if state is None else self.Context.from_buffer_copy(state)
        if state is None:
            self.library.SHA256_Init(ctypes.byref(self.context))

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(ctypes.byref(self.context), ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), self.Context.from_buffer_copy(self.context)
        self.library.SHA256_Final(out, ctypes.byref(end))
        return out.raw.hex()


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def format_of(name: Column, media_type: Column | None = None) -> Column:
    """The extension of the name, or the format that the media type stands for where it has none."""
    if media_type is None:
        return extension(name)
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.when(F.coalesce(extension(name), F.lit("")) != "", extension(name)).otherwise(F.coalesce(known[media_type], F.lit("")))


def reject_reason(name: Column, size: Column, formats=FORMATS, most: int = MAX_BYTES) -> Column:
    """Why a file is not taken, or null."""
    return F.when(~extension(name).isin(*formats), "Unsupported format").when(size == 0, "Empty file").when(size > most, "File too large")


def validate_files(df: DataFrame, formats=FORMATS, most: int = MAX_BYTES) -> DataFrame:
    return df.withColumn("reason", reject_reason(F.col("name"), F.col("size"), formats, most))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, bad ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_text(df: DataFrame) -> DataFrame:
    """``content`` as cleaned text."""
    return clean_text(df.withColumn("text", decoded(F.col("content"))))


def safe_key(prefix: str, ident: Column, name: Column) -> Column:
    """prefix/id/name: up to 60 safe characters of the stem and 10 of the extension."""
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    stem = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9._-]", "_"), 1, 60)
    ext = F.substring(F.regexp_replace(extension(name), r"[^A-Za-z0-9]", ""), 1, 10)
    return F.concat(F.lit(prefix + "/"), ident.cast("string"), F.lit("/"), stem, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
