"""Live forms of the archive's operators.

Each takes a streaming DataFrame and gives one back, or a writer that is ready to start; the batch operators are the truth that they must
agree with once all input has arrived.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import MOST, STALL
from ..sources.files import validate_files

LATE = "1 hour"


def live_stages(stream: DataFrame) -> DataFrame:
    """Running counts by status; for complete output mode."""
    return stream.groupBy("status").agg(F.count("*").alias("n"))


def live_throughput(stream: DataFrame, ts: str = "ts", unit: str = "month") -> DataFrame:
    """Rows a month as they arrive, for update or complete mode. State is a row a month, so none is ever forgotten and late rows count too."""
    return stream.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count("*").alias("n"))


CALLS = "at array<bigint>, event_id array<bigint>, tokens array<bigint>, own array<boolean>"
USED = "event_id bigint, model string, tokens bigint, used bigint"


def _rolling(span: int):
    """Over the calls of a model and stretch of time: each own call with the tokens of the window up to it, once the watermark has passed the stretch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, stretch = key
        held = state.get if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            held = tuple([*old, *rows[c].tolist()] for old, c in zip(held, ("at", "event_id", "tokens", "own"), strict=True))
            state.update(held)
            state.setTimeoutTimestamp((int(stretch) + 1) * span // 1000)
            return
        state.remove()
        at, event, tokens, own = (np.array(x) for x in held)
        order = np.argsort(at, kind="stable")
        at, event, tokens, own = at[order], event[order], tokens[order], own[order].astype(bool)
        total = np.concatenate([[0], np.cumsum(tokens)])
        used = total[np.searchsorted(at, at, side="right")] - total[np.searchsorted(at, at - span, side="left")]  # both ends count, ties together
        yield pd.DataFrame({"event_id": event[own], "model": model, "tokens": tokens[own], "used": used[own]})

    return run


def rolling_usage(stream: DataFrame, seconds: int = 60, late: str = LATE) -> DataFrame:
    """Calls (event_id, model, ts timestamp, tokens) with the tokens of their model in the window up to each: the rolling budget, exactly, for append mode.

    Time is cut into stretches as long as the window, as in the batch form: a call goes to its own stretch and to the next one. A stretch is settled when the watermark has passed its
    end, and then forgotten, so state holds what is newer than the watermark by two windows at most, and a busy model is many small groups. Calls without a time or a model are left out.
    """
    span = seconds * 1_000_000
    timed = stream.where("ts IS NOT NULL AND model IS NOT NULL").withWatermark("ts", late)
    copies = timed.select("event_id", "model", "ts", "tokens", F.unix_micros("ts").alias("at"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    stretch = F.expr(f"at div {span}").cast("bigint") - F.when(F.col("at") % span < 0, 1).otherwise(0) + F.when(F.col("own"), 0).otherwise(1)
    dealt = copies.withColumn("stretch", stretch.cast("bigint"))
    return dealt.groupBy("model", "stretch").applyInPandasWithState(_rolling(span), USED, CALLS, "append", GroupStateTimeout.EventTimeTimeout)


STATE = "status string, attempts int, heartbeat timestamp, queued_at timestamp, last timestamp"
OUTPUT = "job_id bigint, status string, attempts int, heartbeat timestamp, queued_at timestamp, opened int, joined int"


def _advance(state: tuple, event: str, ts) -> tuple[tuple, bool]:
    """One event onto (status, attempts, heartbeat, queued_at); whether it opened the job."""
    status, attempts, beat, queued = state
    if event == "enqueue" and status not in ("queued", "running"):
        return ("queued", 0, None, ts), True
    if event == "claim" and status == "queued":
        return ("running", attempts + 1, ts, queued), False
    if event == "heartbeat" and status == "running":
        return (status, attempts, ts, queued), False
    if event in ("succeed", "fail") and status == "running":
        return ("succeeded" if event == "succeed" else "failed", attempts, beat, queued), False
    if event == "cancel" and status == "queued":
        return ("cancelled", attempts, beat, queued), False
    return state, False


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, beat, queued, _ = state.get if state.exists else (None, 0, None, None, None)
    if state.hasTimedOut:  # no heartbeat for too long, by the watermark: the job goes back
        if status == "running":
            status = "failed" if attempts >= MOST else "queued"
            state.update((status, attempts, beat, queued, None))
            yield pd.DataFrame([(key[0], status, attempts, beat, queued, 0, 0)], columns=[c.split()[0] for c in OUTPUT.split(", ")])
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    opened = joined = 0
    for event, ts in zip(rows["event"], rows["ts"]):
        (status, attempts, beat, queued), opens = _advance((status, attempts, beat, queued), event, ts.to_pydatetime())
        opened += opens
        joined += event == "enqueue" and not opens
    state.update((status, attempts, beat, queued, rows["ts"].iloc[-1].to_pydatetime()))
    if status == "running":
        deadline = int(rows["ts"].iloc[-1].timestamp() * 1000) + STALL * 1000
        if deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
    yield pd.DataFrame([(key[0], status, attempts, beat, queued, opened, joined)], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def live_jobs(stream: DataFrame, late: str = LATE) -> DataFrame:
    """The state of each job after each batch of events (job_id, ts timestamp, event_id, event), with how many requests opened it or joined it.

    Events of a job are folded in time order within a batch; a running job without events for STALL seconds of event time goes back to the queue, or fails at its last attempt.
    """
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


RETRIES = "status string, attempts int, heartbeat timestamp, available_at timestamp"
RETRIED = "job_id bigint, status string, attempts int, available_at timestamp, at timestamp"


def _retrying(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job that is put back by itself: after a failure, and when its worker falls silent."""
    status, attempts, beat, available = state.get if state.exists else (None, 0, None, None)
    out = []

    def put_back(at: pd.Timestamp, wait: int) -> None:
        nonlocal status, available
        status, available = ("failed", None) if attempts >= MOST else ("queued", at + pd.Timedelta(seconds=wait))
        out.append((key[0], status, attempts, available, at))

    def silent_until(now: pd.Timestamp) -> None:
        """A running job without a sign for STALL seconds before ``now``."""
        if status == "running" and now > beat + pd.Timedelta(seconds=STALL):
            put_back(beat + pd.Timedelta(seconds=STALL), 0)

    if state.hasTimedOut:
        silent_until(pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"))
    else:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for event, ts in zip(rows["event"], rows["ts"], strict=True):
            silent_until(ts)
            if event == "enqueue" and status not in ("queued", "running"):
                status, attempts, available = "queued", 0, ts
            elif event == "claim" and status == "queued" and ts >= available:
                status, attempts, beat = "running", attempts + 1, ts
            elif event == "heartbeat" and status == "running":
                beat = ts
                continue
            elif event == "fail" and status == "running":
                put_back(ts, 60 * 2 ** (attempts - 1))
                continue
            elif event == "succeed" and status == "running":
                status = "succeeded"
            elif event == "cancel" and status == "queued":
                status = "cancelled"
            else:
                continue
            out.append((key[0], status, attempts, available if status == "queued" else None, ts))
    state.update((status, attempts, beat, available))
    if status == "running":
        state.setTimeoutTimestamp(max(int(beat.timestamp() * 1000) + STALL * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in RETRIED.split(", ")])


def live_retries(stream: DataFrame, late: str = LATE) -> DataFrame:
    """What becomes of jobs (job_id, ts timestamp, event_id, event) that are tried again: a row for each change, with when a queued job may be claimed.

    A failed attempt goes back to the queue after 60 seconds, doubled with each attempt, and a running job without a heartbeat for STALL seconds of event time at once; the attempt number MOST is the
    last one. A claim before the job is available has no effect. Silence is noticed by the job's next event, or by the watermark.
    """
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(_retrying, RETRIED, RETRIES, "append", GroupStateTimeout.EventTimeTimeout)


BUCKETS = 64


def latest_verdicts(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A writer that keeps a table of the newest verdict a proposal (proposal_id, score, created_at) under ``path``; ``verdicts`` reads it.

    Verdicts lie in hash buckets. A batch rewrites the buckets that it touches, under its own number, and a manifest of that number says which version of each bucket
    holds (one row a bucket). What is written follows the batch and not the table; a repeated batch writes the same files again, so nothing changes.
    """

    def patch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("proposal_id"), F.lit(buckets)).cast("int").alias("bucket")
        news = batch.select("proposal_id", "score", "created_at", bucket)
        before = {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/v={number - 1}").collect()} if number else {}
        touched = [r.bucket for r in news.select("bucket").distinct().collect()]
        old = [f"{path}/rows/v={before[b]}/bucket={b}" for b in touched if b in before]
        if old:
            news = news.unionByName(spark.read.option("basePath", f"{path}/rows").parquet(*old).select("proposal_id", "score", "created_at", "bucket"))
        newest = news.groupBy("bucket", "proposal_id").agg(F.max_by(F.struct("score", "created_at"), F.struct("created_at", "score")).alias("v"))
        newest.select("proposal_id", "v.score", "v.created_at", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={number}")
        holds = before | {b: number for b in touched}
        spark.createDataFrame(sorted(holds.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")

    return stream.writeStream.foreachBatch(patch).option("checkpointLocation", checkpoint)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``latest_verdicts`` as its last complete batch left it."""
    manifests = spark.read.parquet(f"{path}/manifest")
    last = manifests.agg(F.max("v")).first()[0]
    holds = manifests.where(F.col("v") == last).select("bucket", "version").collect()
    return spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/v={r.version}/bucket={r.bucket}" for r in holds)).select("proposal_id", "score", "created_at")


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """New files as they arrive (path, modificationTime, length, content)."""
    return spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_intake(files: DataFrame, ledger: str, checkpoint: str):
    """A writer that takes in files (path, modificationTime, length, content): each gets its hash, why it isn't taken, its upload and the first file with its content. ``taken_in`` reads them.

    The files of one folder that arrive together are one upload; more than one of them make it a batch. Contents are compared with all files ever taken in: the ledger under ``ledger`` holds hashes and
    names, a folder for each batch of the stream, written once its rows are known, so a repeated batch writes the same rows again. Of equal files the earliest is the first, then
    the first by path; files that are refused are no one's first.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.select("path", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("upload"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        checked = validate_files(named)
        several = checked.groupBy("upload").agg((F.count("*") > 1).alias("is_batch"))
        known = spark.read.schema(f"{LEDGER}, b int").parquet(f"{ledger}/rows").where(F.col("b") < number).where("reason IS NULL AND first_path = path").select("sha256", F.col("path").alias("_known")) if number else None
        first = checked.where("reason IS NULL").groupBy("sha256").agg(F.min(F.struct("modificationTime", "path")).alias("f"))
        rows = checked.join(several, "upload").join(first, "sha256", "left")
        own = F.when(F.col("reason").isNull(), F.col("f.path"))
        if known is not None:
            rows = rows.join(known, "sha256", "left")
            own = F.when(F.col("reason").isNull(), F.coalesce("_known", "f.path"))
        rows.withColumn("first_path", own).select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("overwrite").parquet(f"{ledger}/rows/b={number}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


LEDGER = "path string, name string, upload string, is_batch boolean, size bigint, sha256 string, reason string, first_path string"


def taken_in(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(f"{LEDGER}, b int").parquet(f"{ledger}/rows").drop("b")
