"""Streaming queries over the archive's events, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import Archive
from ..registry import query
from ..session import shared_dir
from ..streaming import streams


def _stream(a: Archive, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    schema = a.table(name).schema
    return a.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{a.dir}/{name}.parquet*")


def _finished(a: Archive, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result once its input is used up, from a table in the shared folder."""
    out = f"{shared_dir(a.spark)}/live-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/b={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return a.spark.read.parquet(f"{out}/rows").drop("b")


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows that a stream gave out again and again, those of the last batch a key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def st9_live_stages(a: Archive) -> DataFrame:
    rows = _finished(a, streams.live_stages(_stream(a, "events").withColumnRenamed("event_type", "status")), "complete")
    return _newest(rows, "status")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n FROM orders GROUP BY 1")
def st10_live_throughput(a: Archive) -> DataFrame:
    rows = _finished(a, streams.live_throughput(_stream(a, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))), "update")
    return _newest(rows, "period").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("""SELECT proposal_id, score, CAST(created_at AS TIMESTAMP) AS created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY created_at DESC, score DESC) AS place FROM evaluations WHERE status = 'completed') WHERE place = 1""")
def st9_live_verdicts(a: Archive) -> DataFrame:
    out = f"{shared_dir(a.spark)}/verdicts-{uuid.uuid4().hex}"
    done = a.view("evaluations", lineitem=_stream(a, "lineitem")).where("status = 'completed'").select("proposal_id", "score", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    streams.latest_verdicts(done, f"{out}/table", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.verdicts(a.spark, f"{out}/table")


@query("""SELECT event_id, CAST(sum(tokens) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM calls""")
def st6_live_budget(a: Archive) -> DataFrame:
    """The stream's windows, to the last call: a mark far in the future lets the watermark pass them all."""
    mark = f"{shared_dir(a.spark)}/mark-{uuid.uuid4().hex}"
    kinds = "event_id bigint, model string, ts timestamp, tokens bigint"
    a.spark.sql("SELECT -1L AS event_id, 'mark' AS model, TIMESTAMP '2200-01-01 00:00:00' AS ts, 0L AS tokens").write.parquet(mark)
    calls = a.view("calls", events=_stream(a, "events")).select("event_id", "model", F.col("ts").cast("timestamp").alias("ts"), "tokens")
    both = calls.unionByName(a.spark.readStream.schema(kinds).parquet(mark))
    return _finished(a, streams.rolling_usage(both, seconds=3600), "append").where("event_id >= 0").select("event_id", "used")


@query("""SELECT doc_id, 'in/' || coalesce(source, 'none') AS upload, count(*) OVER (PARTITION BY source) > 1 AS is_batch, CASE WHEN strlen(text) = 0 THEN 'Empty file' END AS reason,
    CASE WHEN strlen(text) > 0 THEN min(doc_id) OVER (PARTITION BY text) END AS first_id FROM documents""")
def st11_file_intake(a: Archive) -> DataFrame:
    """The documents as files of their sources' folders, taken in as a stream."""
    out = f"{shared_dir(a.spark)}/intake-{uuid.uuid4().hex}"
    path = F.concat_ws("/", F.lit("in"), F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    arrived = F.timestamp_seconds(F.col("doc_id"))
    rows = _stream(a, "documents").select(path.alias("path"), arrived.alias("modificationTime"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").cast("binary").alias("content"))
    streams.file_intake(rows, out, f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    ident = lambda c: F.regexp_extract(c, r"(\d+)\.txt$", 1).try_cast("bigint")
    return streams.taken_in(a.spark, out).select(ident("path").alias("doc_id"), "upload", "is_batch", "reason", ident("first_path").alias("first_id"))


@query()
def st3_live_retries(a: Archive) -> DataFrame:
    """All changes of the jobs that the stream tries again."""
    event = F.expr("CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'succeed' ELSE 'fail' END")
    stream = _stream(a, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", event.alias("event"))
    return _finished(a, streams.live_retries(stream), "append").drop("batch")


@query()
def st2_live_jobs(a: Archive) -> DataFrame:
    """The stream's states, to be equal to those of the batch fold."""
    event = F.expr("CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'succeed' ELSE 'fail' END")
    stream = _stream(a, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", event.alias("event"))
    return _newest(_finished(a, streams.live_jobs(stream), "update"), "job_id")
