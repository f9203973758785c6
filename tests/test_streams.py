"""Streams against their batch operators, over several batches, repeated ones and late ones."""

import datetime as dt
import random

import numpy as np
import pytest
from dossier.functions.hooks import answer, embed
from dossier.operators.jobs import MOST, STALL, rolling_budget
from dossier.streaming import streams
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


class Source:
    """A folder that a stream reads, filled batch by batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, str(folder / "in"), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def appended(stream, folder):
    """Runs to the end of the input; results of all runs so far."""

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out").drop("b")


def verdict_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in folder.glob("rows/v=*/bucket=*/*.parquet")}


def test_verdicts_are_rewritten_by_bucket(spark, tmp_path):
    source = Source(spark, tmp_path, "proposal_id int, score double, created_at timestamp")
    table, state = tmp_path / "table", str(tmp_path / "state")
    run = lambda: streams.latest_verdicts(source.stream(), str(table), state, 32).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for rows in ([(i, float(i), DAY) for i in range(2000)], [(7, 1.5, DAY + dt.timedelta(1)), (8, 99.0, DAY - dt.timedelta(1)), (5000, 2.0, DAY)], []):
        if rows:
            source.add(rows)
        before = verdict_files(table)
        run()
        for i, x, at in rows:
            want[i] = max(want.get(i, (at, x)), (at, x))
        assert {r.proposal_id: (r.created_at, r.score) for r in streams.verdicts(spark, str(table)).collect()} == want
        new = {k: v for k, v in verdict_files(table).items() if k not in before}
        if len(rows) == 3:  # three rows touch three buckets of 32 at most
            assert len({k.split("/")[2] for k in new}) <= 3 and sum(new.values()) < sum(before.values()) / 5
        elif not rows:
            assert not new


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, table = Source(spark, tmp_path, "proposal_id int, score double, created_at timestamp"), tmp_path / "table"
    held = []
    for n in (0, 1):
        source.add([(i, float(i + n), DAY + dt.timedelta(n)) for i in range(n, 50)])
    batch = spark.read.schema(source.schema).parquet(source.path)
    for _ in (0, 1):  # a new checkpoint: the same batch number once more
        streams.latest_verdicts(source.stream(), str(table), str(tmp_path / f"state{len(held)}"), 4).trigger(availableNow=True).start().awaitTermination()
        held.append(sorted(map(tuple, streams.verdicts(spark, str(table)).collect())))
    assert held[0] == held[1] and len(held[0]) == batch.select("proposal_id").distinct().count()


@pytest.mark.parametrize("seed", [1, 2])
def test_budget_stream_is_exact(spark, tmp_path, seed):
    rng = random.Random(seed)
    source = Source(spark, tmp_path, "event_id bigint, model string, ts timestamp, tokens bigint")
    rows = [(i, rng.choice(["large", "large", "small"]), DAY + dt.timedelta(seconds=rng.choice([0, 0, 59, 60, 61, 119, 120]) + 60 * rng.randrange(40)), rng.randrange(100)) for i in range(400)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(900)))  # out of order by less than the watermark allows
    stream = lambda: streams.rolling_usage(source.stream(), seconds=60, late="20 minutes")
    for at in range(0, 400, 150):
        source.add(rows[at : at + 150])
        appended(stream(), str(tmp_path))
    source.add([(9999, "mark", DAY + dt.timedelta(999), 0)])
    got = {r.event_id: r.used for r in appended(stream(), str(tmp_path)).where("event_id < 9999").collect()}
    calls = spark.createDataFrame(rows, source.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert got == {r.event_id: r.used for r in rolling_budget(calls, seconds=60).collect()} and len(got) == 400


def plain_retries(events, until):
    """What becomes of one job, one event after the other."""
    status, attempts, beat, available, out = None, 0, None, None, []

    def put_back(at, wait):
        nonlocal status, available
        status, available = ("failed", None) if attempts >= MOST else ("queued", at + dt.timedelta(seconds=wait))
        out.append((status, attempts, available, at))

    for ts, _, event in [*sorted(events), (until, 0, "end")]:
        if status == "running" and ts > beat + dt.timedelta(seconds=STALL):
            put_back(beat + dt.timedelta(seconds=STALL), 0)
        change = True
        if event == "enqueue" and status not in ("queued", "running"):
            status, attempts, available = "queued", 0, ts
        elif event == "claim" and status == "queued" and ts >= available:
            status, attempts, beat = "running", attempts + 1, ts
        elif event == "succeed" and status == "running":
            status = "succeeded"
        elif event == "cancel" and status == "queued":
            status = "cancelled"
        else:
            change = False
            if event == "heartbeat" and status == "running":
                beat = ts
            elif event == "fail" and status == "running":
                put_back(ts, 60 * 2 ** (attempts - 1))
        if change:
            out.append((status, attempts, available if status == "queued" else None, ts))
    return out


def test_retries_have_a_limit_and_wait_longer_each_time(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    source = Source(spark, tmp_path, "job_id bigint, ts timestamp, event_id bigint, event string")
    one = [(0, "enqueue"), (10, "claim"), (20, "fail"), (30, "claim"), (80, "claim"), (90, "fail"), (200, "claim"), (210, "claim"), (220, "fail"), (230, "claim"), (300, "enqueue")]
    rows = [(1, at(s), i, e) for i, (s, e) in enumerate(one)] + [(2, at(0), 100, "enqueue"), (2, at(5), 101, "claim")]
    rng = random.Random(4)
    rows += [(3 + i % 5, at(rng.randrange(5000)), 1000 + i, rng.choice(["enqueue", "claim", "claim", "heartbeat", "fail", "fail", "succeed", "cancel"])) for i in range(300)]
    source.add([r for r in rows if r[1] < at(2500)])
    appended(streams.live_retries(source.stream()), str(tmp_path))
    source.add([r for r in rows if r[1] >= at(2500)])
    appended(streams.live_retries(source.stream()), str(tmp_path))
    source.add([(99, at(90_000), 9999, "enqueue")])  # lets the watermark pass everything
    got = {}
    for r in appended(streams.live_retries(source.stream()), str(tmp_path)).where("job_id < 99").collect():
        got.setdefault(r.job_id, []).append((r.status, r.attempts, r.available_at, r.at))
    want = {j: plain_retries([r[1:] for r in rows if r[0] == j], at(80_000)) for j in {r[0] for r in rows}}
    assert {j: sorted(x, key=str) for j, x in got.items()} == {j: sorted(x, key=str) for j, x in want.items()}
    steps = [(s, n, a) for s, n, a, _ in want[1]]
    assert ("queued", 1, at(80)) in steps and ("queued", 2, at(210)) in steps and ("failed", 3, None) in steps
    assert want[2][-1] == ("queued", 1, at(5 + STALL), at(5 + STALL))


def test_intake_knows_all_files_ever_seen(spark, tmp_path):
    source = Source(spark, tmp_path, streams.FILES)
    file = lambda path, day, body: (path, DAY + dt.timedelta(day), len(body), bytearray(body))
    ledger, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for batch in (
        [file("up/1/a.txt", 0, b"one"), file("up/1/b.txt", 0, b"two"), file("up/2/c.txt", 1, b"one"), file("up/3/d.exe", 0, b"three"), file("up/4/e.txt", 0, b"")],
        [file("up/5/f.txt", 30, b"two"), file("up/6/g.txt", 31, b"three"), file("up/6/h.txt", 30, b"three")],
    ):
        source.add(batch)
        streams.file_intake(source.stream(), ledger, state).trigger(availableNow=True).start().awaitTermination()
    got = {r.name: (r.upload, r.is_batch, r.reason, r.first_path) for r in streams.taken_in(spark, ledger).collect()}
    assert got == {
        "a.txt": ("up/1", True, None, "up/1/a.txt"), "b.txt": ("up/1", True, None, "up/1/b.txt"), "c.txt": ("up/2", False, None, "up/1/a.txt"), "d.exe": ("up/3", False, "Unsupported format", None),
        "e.txt": ("up/4", False, "Empty file", None), "f.txt": ("up/5", False, None, "up/1/b.txt"), "g.txt": ("up/6", True, None, "up/6/h.txt"), "h.txt": ("up/6", True, None, "up/6/h.txt"),
    }
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "x.txt").write_bytes(b"one")
    streams.file_intake(streams.arriving_files(spark, str(tmp_path / "drop")), str(tmp_path / "l2"), str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()
    assert streams.taken_in(spark, str(tmp_path / "l2")).first().name == "x.txt"


def test_hooks_are_set_up_once_and_see_batches(spark, tmp_path):
    seen = str(tmp_path / "setups")

    def lengths():
        with open(seen, "a") as f:
            f.write("x")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "t" * i) for i in range(600)], "i int, text string").coalesce(1)
    got = {r.i: r.v for r in rows.select("i", embed(lengths)("text").alias("v")).collect()}
    assert got == {i: None if i % 10 == 0 else [float(i), 1.0] for i in range(600)} and len(open(seen).read()) == 1
    wrong = rows.select(embed(lambda: lambda texts: np.zeros((1, 2)))("text"))
    with pytest.raises(Exception, match="vectors"):
        wrong.collect()
    sizes = answer(rows, lambda: lambda batch: batch.assign(n=len(batch))[["i", "n"]], "i int, n int").collect()
    assert len(sizes) == 600 and max(r.n for r in sizes) == 256
