"""Work queues as folds over their events, and budgets of calls. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

STALL, MOST, PRIORITY = 900, 3, {"ingest": 10, "evaluate": 100}


def _time(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


STATUSES = ("", "queued", "running", "succeeded", "failed", "cancelled")  # the first: never queued
OVER = ("", "succeeded", "failed", "cancelled")
STRETCH = 11  # bits: 2048 events, or stretches, are folded at a time


def step(status: Column, event: Column) -> Column:
    """The state after an event; events that don't apply leave it."""
    return (
        F.when((event == "enqueue") & status.isin(*OVER), "queued")
        .when((event == "claim") & (status == "queued"), "running")
        .when((event == "succeed") & (status == "running"), "succeeded")
        .when((event == "fail") & (status == "running"), "failed")
        .when((event == "cancel") & (status == "queued"), "cancelled")
        .otherwise(status)
    )


def _outcome(status: Column, fresh: Column, attempts: Column, beats: Column, heartbeat: Column, queues: Column, queued_at: Column) -> Column:
    """What a stretch of events makes of one state: the state after it; attempts, counted anew (``fresh``) or on top; the last heartbeat and when it was queued, if it has set them."""
    values = {"status": status, "fresh": fresh, "attempts": attempts, "beats": beats, "heartbeat": heartbeat, "queues": queues, "queued_at": queued_at}
    return F.struct(*(v.alias(n) for n, v in values.items()))


def _untouched() -> Column:
    """The table of no events: an outcome for each state, which is the state itself."""
    no, never = F.lit(False), F.lit(None).cast("timestamp_ntz")
    return F.array(*(_outcome(F.lit(s), no, F.lit(0), no, never, no, never) for s in STATUSES))


def _after(table: Column, e: Column) -> Column:
    """The table of a stretch with one event more."""

    def moved(x: Column) -> Column:
        status = step(x["status"], e["event"])
        queued = (e["event"] == "enqueue") & (status != x["status"])
        claimed = (e["event"] == "claim") & (x["status"] == "queued")
        beat = claimed | ((e["event"] == "heartbeat") & (x["status"] == "running"))
        return _outcome(
            status,
            queued | x["fresh"],
            F.when(queued, 0).when(claimed, x["attempts"] + 1).otherwise(x["attempts"]),
            queued | beat | x["beats"],
            F.when(queued, None).when(beat, e["ts"]).otherwise(x["heartbeat"]),
            queued | x["queues"],
            F.when(queued, e["ts"]).otherwise(x["queued_at"]),
        )

    return F.transform(table, moved)


def _of(table: Column, status: Column) -> Column:
    return F.element_at(table, F.array_position(F.array(*map(F.lit, STATUSES)), status).cast("int"))


def _composed(first: Column, second: Column) -> Column:
    """The table of two stretches, one after the other."""

    def through(x: Column) -> Column:
        y = _of(second, x["status"])
        return _outcome(
            y["status"],
            x["fresh"] | y["fresh"],
            F.when(y["fresh"], y["attempts"]).otherwise(x["attempts"] + y["attempts"]),
            x["beats"] | y["beats"],
            F.when(y["beats"], y["heartbeat"]).otherwise(x["heartbeat"]),
            x["queues"] | y["queues"],
            F.when(y["queues"], y["queued_at"]).otherwise(x["queued_at"]),
        )

    return F.transform(first, through)


def _stretches(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, stretch, events in order, table): at most 2**STRETCH neighbouring events of a job; stretches are numbered in order.

    Events are range-partitioned by job and time, so a job with a third of all events is spread over many tasks.
    """
    order = [*keys, "ts", "event_id"]
    dealt = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = F.array_sort(F.collect_list(F.struct("_at", "ts", "event", F.struct(*events.columns).alias("row"))))
    grouped = dealt.groupBy(*keys, F.shiftright("_at", STRETCH).alias("stretch")).agg(rows.alias("events"))
    return grouped.withColumn("table", F.aggregate("events", _untouched(), _after))


def _joined(tables: DataFrame, keys: tuple[str, ...], stretch: Column | None) -> DataFrame:
    """Tables of stretches composed in order, by ``stretch`` (a coarser number) or to one a job. Keeps what was composed as ``parts``."""
    by = [*keys] if stretch is None else [*keys, stretch.alias("_coarse")]
    out = tables.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("stretch", "table"))).alias("parts"))
    return out.withColumn("table", F.aggregate("parts", _untouched(), lambda t, p: _composed(t, p["table"]))).withColumnRenamed("_coarse", "stretch")


def job_state(events: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Per job: status, attempts (claims), last heartbeat and when it was last queued, from its events in order.

    What a stretch of events does is a table with an outcome for each of the six states; tables compose, and that is associative. So stretches are folded
    apart, however long a job's history is, and their tables are composed in order, 2**STRETCH at a time.
    """
    tables = _stretches(events.select(*keys, "ts", "event_id", "event"), keys).select(*keys, "stretch", "table")
    coarse = _joined(tables, keys, F.shiftright("stretch", STRETCH)).select(*keys, "stretch", "table")
    last = _joined(coarse, keys, None).select(*keys, _of(F.col("table"), F.lit("")).alias("s"))
    return last.select(*keys, "s.status", "s.attempts", "s.heartbeat", "s.queued_at").where("status <> ''")


def _begun(parts: Column, start: Column) -> Column:
    """For each part, in order, the state that it begins in."""
    none = F.array().cast("array<struct<stretch: bigint, begins: string>>")
    walked = F.aggregate(
        parts,
        F.struct(start.alias("now"), none.alias("seen")),
        lambda s, p: F.struct(_of(p["table"], s["now"])["status"].alias("now"), F.concat(s["seen"], F.array(F.struct(p["stretch"].alias("stretch"), s["now"].alias("begins")))).alias("seen")),
    )
    return walked["seen"]


def enqueue_dedup(events: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Enqueue requests with ``opens``: whether each opens a job or joins the open one of its key.

    A request joins as long as the job is queued or running by the fold of ``job_state``; a job that is out of place (claimed twice, cancelled while it runs) changes nothing.
    The state that each stretch of events begins in comes from the tables of those before it, coarse stretches first.
    """
    stretches = written(_stretches(events, keys), "stretches")
    coarse = written(_joined(stretches.select(*keys, "stretch", "table"), keys, F.shiftright("stretch", STRETCH)), "coarse")
    whole = _joined(coarse.select(*keys, "stretch", "table"), keys, None)
    begun = whole.select(*keys, F.inline(_begun(F.col("parts"), F.lit(""))))
    begun = coarse.join(begun, [*keys, "stretch"]).select(*keys, F.inline(_begun(F.col("parts"), F.col("begins"))))
    kind = stretches.schema["events"].dataType.elementType["row"].dataType.simpleString()
    none = F.array().cast(f"array<struct<row: {kind}, opens: boolean>>")

    def walk(s: Column, e: Column) -> Column:
        asked = F.array(F.struct(e["row"].alias("row"), s["now"].isin(*OVER).alias("opens")))
        return F.struct(step(s["now"], e["event"]).alias("now"), F.when(e["event"] == "enqueue", F.concat(s["out"], asked)).otherwise(s["out"]).alias("out"))

    judged = F.aggregate("events", F.struct(F.col("begins").alias("now"), none.alias("out")), walk)["out"]
    return stretches.join(begun, [*keys, "stretch"]).select(F.inline(judged)).select("row.*", "opens")


def stalled(jobs: DataFrame, now: str, seconds: int = STALL, most: int = MOST) -> DataFrame:
    """Running jobs without a recent heartbeat: requeued, or failed at the last attempt."""
    cutoff = _time(now) - F.expr(f"INTERVAL {seconds} SECONDS")
    dead = (F.col("status") == "running") & (F.col("heartbeat").isNull() | (F.col("heartbeat") < cutoff))
    return jobs.where(dead).withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("queued"))


def retry_schedule(jobs: DataFrame, now: str, most: int = MOST) -> DataFrame:
    """Failed attempts with attempts left: queued again after 60 seconds, doubled each time; else failed."""
    again = F.col("attempts") < most
    wait = F.expr("make_dt_interval(0, 0, 0, 60 * power(2, greatest(attempts, 1) - 1))")
    return jobs.withColumn("status", F.when(again, "queued").otherwise("failed")).withColumn("available_at", F.when(again, _time(now) + wait))


def claim_order(jobs: DataFrame, now: str, n: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The next n queued and available jobs, by priority, then by how long they have been available."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= _time(now)))
    if kinds is not None:
        ready = ready.where(F.col("kind").isin(*kinds))
    return ready.orderBy("priority", "available_at", "job_id").limit(n)


def rolling_budget(calls: DataFrame, seconds: int = 60, limit: float = 12_000, share: float = 0.9) -> DataFrame:
    """Calls with the tokens of their model in the window up to each (both ends included), whether that is over budget, and whether one call alone is.

    Time is cut into stretches as long as the window. A window reaches no further than the stretch before, so each call also enters the next
    stretch, and leaves it again where windows no longer reach it. What is used is then a running sum per model and stretch: a busy model is many small tasks, and a busy
    stretch costs no more a call than a quiet one. ``tokens`` are whole numbers; a window without any is null.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(F.col("_at") / F.lit(span)).cast("bigint")
    step = lambda later, shift, sign: F.struct(F.lit(later).alias("_later"), F.lit(shift).cast("bigint").alias("_shift"), F.lit(sign).alias("_sign"))
    steps = F.when(F.col("_at").isNull(), F.array(step(0, 0, 1))).otherwise(F.array(step(0, 0, 1), step(1, 0, 1), step(1, span + 1, -1)))
    trail = W.partitionBy("model", "_stretch").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    dealt = calls.withColumn("_at", at).select("*", F.inline(steps)).withColumn("_stretch", own + F.col("_later")).withColumn("_at", F.col("_at") + F.col("_shift"))
    known = F.sum(F.when(F.col("tokens").isNotNull(), F.col("_sign"))).over(trail)
    out = dealt.withColumn("used", F.when(known > 0, F.sum(F.col("tokens") * F.col("_sign")).over(trail))).where("_shift = 0 AND _later = 0").drop("_at", "_later", "_shift", "_sign", "_stretch")
    return out.withColumn("over", F.col("used") > limit * share).withColumn("too_large", F.col("tokens") > limit * share)


def reconcile(calls: DataFrame) -> DataFrame:
    """Reserved tokens replaced by actual ones, only downwards."""
    return calls.withColumn("tokens", F.when(F.col("actual").isNull(), F.col("reserved")).otherwise(F.least("reserved", "actual")))


def purge(jobs: DataFrame, now: str, days: int = 30, ts: str = "finished_at") -> DataFrame:
    """What is left: succeeded and cancelled jobs past the time go, failed ones are kept."""
    old = F.col("status").isin("succeeded", "cancelled") & (F.col(ts) < _time(now) - F.expr(f"INTERVAL {days} DAYS"))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Per kind: jobs in each status, pending ones (queued or running) and when the oldest queued one was queued."""
    states = ("queued", "running", "succeeded", "failed", "cancelled")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in states]
    return jobs.groupBy("kind").agg(*counts, F.count_if(F.col("status").isin("queued", "running")).alias("pending"), F.min(F.when(F.col("status") == "queued", F.col("queued_at"))).alias("oldest_queued"))


def run_lifecycle(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs as opened, then completed or failed by their end (proposal_id, outcome, error); errors are cut to 4000 characters.

    Errors are far longer than a planner takes strings to be, so the join sorts both sides and never broadcasts the ends.
    """
    cut = ends.select("proposal_id", "outcome", F.substring("error", 1, 4000).alias("error")).hint("merge")
    out = runs.select("proposal_id").join(cut, "proposal_id", "left")
    status = F.when(F.col("outcome").isNull(), "processing").otherwise(F.col("outcome"))
    return out.select("proposal_id", status.alias("status"), "error")


def retry_batch(df: DataFrame, most: int = 3) -> DataFrame:
    """Failed rows with retries left go back to uploaded, their error cleared; others keep their state and get a reason."""
    reason = F.when(F.col("status") != "failed", "Not failed").when(F.col("retry_count") >= most, "Retries used up")
    return df.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "uploaded").otherwise(F.col("status"))).withColumn("error_stage", F.when(reason.isNotNull(), F.col("error_stage")))


def record_failure(df: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures (proposal_id, stage, error) onto their rows: one more retry, the error cut; rows are never dropped. Errors are never broadcast (see ``run_lifecycle``)."""
    news = failures.select("proposal_id", F.col("stage").alias("_stage"), F.substring("error", 1, 4000).alias("_error")).hint("merge")
    out = df.join(news, "proposal_id", "left")
    hit = F.col("_stage").isNotNull()
    return out.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "error_stage": F.when(hit, F.col("_stage")).otherwise(F.col("error_stage")),
        "error": F.col("_error"),
        "retry_count": F.col("retry_count") + hit.cast("int"),
    }).drop("_stage", "_error")
