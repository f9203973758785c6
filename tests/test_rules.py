"""Rules of the archive on small rows that tell them from their near misses."""

import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from dossier.config import TAXONOMY, taxonomy_table
from dossier.operators import analytics as A
from dossier.operators import decisions as G
from dossier.operators import dedup as D
from dossier.operators import forms as Q
from dossier.operators import jobs as J
from dossier.operators import listing as L
from dossier.operators import scoring as R
from dossier.operators import sections as S
from dossier.sources import files, tables
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 5, 1)
PROPOSALS = "proposal_id int, status string, is_evaluated boolean, review_decision string, latest_score double, latest_recommendation string, latest_evaluation_id string, evaluated_at timestamp_ntz, error_stage string"
RUNS = "proposal_id int, run_id string, score double, recommendation string, completed_at timestamp_ntz, created_at timestamp_ntz"


def proposals(spark):
    rows = [(1, "evaluated", True, "approved_for_eval", 70.0, "Old label", "old", DAY, None), (2, "failed", False, "approved_for_eval", None, None, None, None, "scoring"), (3, "queued", False, "pending", None, None, None, None, None)]
    return spark.createDataFrame(rows, PROPOSALS)


def runs(spark):
    rows = [(1, "new", 50.0, "New label", DAY + dt.timedelta(9), DAY + dt.timedelta(8)), (2, "r2", 60.0, "Recommended", None, DAY + dt.timedelta(3))]
    return spark.createDataFrame(rows, RUNS)


def test_backfill_fills_whole_verdicts_and_only_where_there_is_none(spark):
    got = {r.proposal_id: tuple(r[c] for c in tables.VERDICT) for r in tables.backfill_verdict(proposals(spark), runs(spark)).collect()}
    assert got == {1: (70.0, "Old label", "old", DAY), 2: (60.0, "Recommended", "r2", DAY + dt.timedelta(3)), 3: (None,) * 4}


def test_publishing_copies_the_whole_verdict(spark):
    got = {r.proposal_id: r for r in R.publish_verdict(proposals(spark), runs(spark)).collect()}
    assert [tuple(got[i][c] for c in tables.VERDICT) for i in (1, 2)] == [(50.0, "New label", "new", DAY + dt.timedelta(9)), (60.0, "Recommended", "r2", DAY + dt.timedelta(3))]
    assert (got[2].status, got[2].is_evaluated, got[2].error_stage) == ("evaluated", True, None) and (got[3].status, got[3].is_evaluated) == ("queued", False)


def test_gates_look_at_the_review_decision(spark):
    rows = [(1, "queued", False, "pending"), (2, "metadata_ready", False, "approved_for_eval"), (3, "evaluating", False, "approved_for_eval"), (4, "extracted", False, "approved_for_eval"), (5, "failed", True, "approved_for_eval"), (6, "queued", True, "skipped_duplicate")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "proposal_id int, status string, is_evaluated boolean, review_decision string, batch_id int")
    reasons = {r.proposal_id: (r.a, r.b) for r in frame.select("proposal_id", L.ineligible().alias("a"), L.ineligible(force=True).alias("b")).collect()}
    assert reasons[1] == ("Awaiting duplicate review",) * 2 and reasons[2] == reasons[3] == (None, None) and reasons[4][0] == "Still in processing"
    assert reasons[5] == ("Already evaluated", "Processing failed") and reasons[6][0] == "Ruled a duplicate"
    assert A.pipeline_stages(frame).first().actionable == 3
    state, part = A.batch_state(frame).first(), A.batch_partition(frame).first()
    assert (state.evaluated, state.awaiting, state.failed, state.in_progress) == (2, 1, 1, 3)
    assert (part.ready, part.blocked, part.skipped, part.already) == (3, 1, 1, 2)


def test_saved_tokens_are_rounded_once(spark):
    frame = spark.createDataFrame([("skipped_duplicate",)] * 3, "review_decision string")
    matches = spark.createDataFrame([(1, "dismissed")], "proposal_id int, status string")
    spent = spark.createDataFrame([("completed", 10), ("completed", 11), ("failed", 500)], "status string, tokens bigint")
    assert A.duplicate_gate_report(frame, matches, spent).first().tokens_saved == 31
    assert A.duplicate_gate_report(frame, matches, spent.limit(0)).first().tokens_saved is None


def test_files(spark):
    frame = spark.createDataFrame([("a.BMP", "x"), ("b.md", "text/plain"), ("c", "image/tiff"), ("d", "video/mp4"), ("e", None)], "name string, kind string")
    reason = files.reject_reason(F.col("name"), F.lit(5))
    got = {r.name: (r.reason, r.form) for r in frame.select("name", reason.alias("reason"), files.format_of(F.col("name"), F.col("kind")).alias("form")).collect()}
    assert got == {"a.BMP": (None, "bmp"), "b.md": ("Unsupported format", "md"), "c": ("Unsupported format", "tiff"), "d": ("Unsupported format", ""), "e": ("Unsupported format", "")}
    raw = spark.createDataFrame([(bytearray("ﬁrst \t line\nPage 2 of 9\n\n\n\nend ".encode() + b"\xff"),)], "content binary")
    assert files.read_text(raw).first().text == "first line\nend \ufffd"


def test_listing_keys_and_search(spark):
    frame = spark.createDataFrame([(1, DAY, 5, None, "A title", "a.pdf", "Locusts eat the crop"), (2, DAY, 9, 3.0, "B", "b.pdf", None), (3, DAY, None, 7.0, "locust C", "c.pdf", "")], "proposal_id int, created_at timestamp_ntz, total_words int, latest_score double, title string, filename string, problem_statement string")
    order = lambda by, down: [r.proposal_id for r in L.sort_listing(frame, by, down).collect()]
    assert order("words", True) == [2, 1, 3] and order("score", False) == [2, 3, 1] and order("latest_score", True) == [3, 2, 1]
    assert sorted(r.proposal_id for r in L.search(frame, "LOCUST").collect()) == [1, 3]


def test_metadata(spark):
    row = (" Not Found ", "not stated", [" x ", "N/A", "-", "y", "z"], ["a", "unknown", " b\t"], " 2019 ", "11", "sure")
    got = Q.clean_metadata(spark.createDataFrame([row], "title string, theme string, categories array<string>, districts array<string>, year string, level string, confidence string")).first()
    assert tuple(got) == (None, None, ["x", "y"], ["a", "b"], 2019, None, 0.0)
    kept = Q.clean_metadata(spark.createDataFrame([("not available", 7.5)], "title string, confidence double")).first()
    assert tuple(kept) == ("not available", 1.0)


def test_contexts_of_close_amounts_overlap(spark):
    text = "Cost INR 5,000 then INR 6,000 and Rs. 7,000 in all of the three years"
    got = Q.extract_amounts(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id int, text string")).collect()
    want = [(m[1].replace(",", ""), text[max(0, m.start() - 50) : m.end() + 20].strip()) for m in re.finditer(r"(?:₹|INR|Rs\.?)\s*(\d{1,3}(?:,\d{2})*(?:,\d{3})?)", text)]
    assert [(r.value, r.context) for r in got] == want and [r.place for r in got] == [0, 1, 2]


def test_columns_begin_at_any_word(spark):
    text = "Name Role Years\nAnna Lead 12\nCarl  Aide 3\nEve  Head 41"
    got = Q.aligned_tables(spark.createDataFrame([(1, 0, text), (2, 0, "two lines\nonly here")], "doc_id int, place int, answer string")).collect()
    assert [(r.doc_id, r.columns, r.rows) for r in got] == [(1, 3, [["Name", "Role", "Years"], ["Anna", "Lead", "12"], ["Carl", "Aide", "3"], ["Eve", "Head", "41"]])]


def test_people(spark):
    text = "Anna Maria Berg\nCo-founder and CEO\nPh.D, IIT, 12+ years in Machine Learning and GIS\nhttps://www.linkedin.com/in/anna\nCarl 7 Dahl\nCTO\nhttps://linkedin.com/in/carl\nrest"
    got = Q.people_blocks(spark.createDataFrame([(1, text), (2, "Eve Holm\nadvises on agronomy\nFinn Lund\nHead of Product, MBA, 3 yrs"), (3, "x"), (4, None)], "doc_id int, answer string")).orderBy("doc_id", "place").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("Anna Maria Berg", "Co-founder and CEO", "12+ years", "Ph.D IIT", "Machine Learning, GIS", "https://www.linkedin.com/in/anna"),
        ("Eve Holm", "", "", "", "Agronomy", None),
        ("Finn Lund", "Head of Product, MBA, 3 yrs", "3 yrs", "MBA", "Product", None),
    ]


def test_reasons_of_a_match(spark):
    rows = [(0.814, "Acme Pvt Ltd", "ACME limited", "Soil", True), (0.75, "Acme", "Other", None, False), (0.9, None, "Other", "Soil", None)]
    got = [r.reasons for r in D.match_reasons(spark.createDataFrame(rows, "similarity double, company_a string, company_b string, category_b string, evaluated_b boolean")).collect()]
    assert got == [["81% similar", "Same organisation", "Category: Soil", "Already evaluated"], ["75% similar", "Different organisation"], ["90% similar", "Category: Soil"]]


def test_duplicate_rulings_are_applied_and_taken_back(spark):
    rows = [(1, "queued", False, "approved_for_eval"), (2, "evaluated", True, "approved_for_eval"), (3, "skipped", False, "skipped_duplicate"), (4, "queued", False, "pending"), (5, "queued", None, "pending")]
    frame = spark.createDataFrame(rows, "proposal_id int, status string, is_evaluated boolean, review_decision string")
    matches = spark.createDataFrame([(1, 9, "pending"), (1, 8, "dismissed"), (3, 1, "pending"), (4, 1, "pending")], "proposal_id int, matched_id int, status string")
    rulings = spark.createDataFrame([(1, True, 2), (2, True, 1), (3, False, None), (4, True, 99), (5, True, 5), (77, True, None)], "proposal_id int, is_duplicate boolean, original_id int")
    p, m, report = D.mark_duplicates(frame, matches, rulings)
    assert {r.proposal_id: r.reason for r in report.collect()} == {1: None, 2: "Already evaluated", 3: None, 4: "Original not found", 5: "Same proposal", 77: "Not found"}
    got = {r.proposal_id: (r.status, r.review_decision, r.duplicate_of_id) for r in p.collect()}
    assert got == {1: ("skipped", "skipped_duplicate", 2), 2: ("evaluated", "approved_for_eval", None), 3: ("queued", "approved_for_eval", None), 4: ("queued", "pending", None), 5: ("queued", "pending", None)}
    assert {(r.proposal_id, r.matched_id): r.status for r in m.collect()} == {(1, 9): "confirmed_duplicate", (1, 8): "dismissed", (3, 1): "dismissed", (4, 1): "pending"}
    again = D.mark_duplicates(p, m, spark.createDataFrame([(1, False, None)], rulings.schema))[0]
    assert {r.proposal_id: r.status for r in again.collect()}[1] == "queued"


CANDIDATES = "proposal_id int, seq int, decision string, acknowledged boolean, is_evaluated boolean, category string, company_id int"
LEDGER = "proposal_id int, decision string, category string, company_id int, decided_at timestamp_ntz"


def test_funding_goes_through_the_conflict_check(spark):
    rows = [(1, 1, "", False, True, "a", 1), (2, 2, "", False, True, "a", 2), (3, 3, "", False, False, "b", 3), (4, 4, "", False, False, "c", 4), (5, 5, "", False, True, "z", 5)]
    selected = spark.createDataFrame([(1,), (2,), (3,), (5,)], "proposal_id int")
    ledger = spark.createDataFrame([(9, "approved", "z", 99, DAY)], LEDGER)
    got = {r.proposal_id: (r.decision, r.accepted) for r in G.funding(spark.createDataFrame(rows, CANDIDATES), selected, ledger).collect()}
    fund = "selected_for_funding"
    assert got == {1: (fund, True), 2: (fund, False), 3: (fund, False), 4: ("unselected", True), 5: (fund, False)}


@pytest.mark.parametrize("block", [G.BLOCK, 700])
def test_a_long_chain_takes_few_tables(spark, monkeypatch, block):
    n = 5_000 if block > n_chain() else 2_000
    rows = [(i, i, "approved", False, True, f"k{i // 2}", (i + 1) // 2) for i in range(n)]
    made = []
    monkeypatch.setattr(G, "written", lambda df, name, keep=G.written: made.append(name) or keep(df, name))
    got = {r.seq: r.accepted for r in G.decide_batch(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([], LEDGER), block).collect()}
    taken, want = [set(), set()], {}
    for _, seq, _, _, _, category, company in rows:
        want[seq] = category not in taken[0] and company not in taken[1]
        if want[seq]:
            taken[0].add(category)
            taken[1].add(company)
    assert got == want and len(made) < 20


def n_chain():
    return 5_000


def plain_fold(events):
    """(status, attempts, heartbeat, queued_at) and which requests open a job, one event after the other."""
    status, attempts, beat, queued, opens = None, 0, None, None, {}
    for ts, i, e in sorted(events):
        over = status in (None, "succeeded", "failed", "cancelled")
        if e == "enqueue":
            opens[i] = over
        if e == "enqueue" and over:
            status, attempts, beat, queued = "queued", 0, None, ts
        elif e == "claim" and status == "queued":
            status, attempts, beat = "running", attempts + 1, ts
        elif e == "heartbeat" and status == "running":
            beat = ts
        elif e in ("succeed", "fail") and status == "running":
            status = e + "ed" if e != "succeed" else "succeeded"
        elif e == "cancel" and status == "queued":
            status = "cancelled"
    return (status, attempts, beat, queued), opens


@pytest.mark.parametrize("bits", [2, J.STRETCH])
def test_histories_are_folded_in_stretches(spark, monkeypatch, bits):
    monkeypatch.setattr(J, "STRETCH", bits)
    rng = random.Random(bits)
    kinds = ["enqueue", "claim", "heartbeat", "succeed", "fail", "cancel"]
    rows = [(0 if i % 3 else rng.randrange(1, 9), DAY + dt.timedelta(seconds=rng.randrange(500)), i, rng.choice(kinds)) for i in range(1500)]  # one job has two thirds
    rows += [(50, DAY, 9001, "enqueue"), (50, DAY, 9002, "claim"), (50, DAY, 9003, "cancel"), (50, DAY, 9004, "enqueue"), (60, DAY, 9005, "claim")]
    frame = spark.createDataFrame(rows, "job_id int, ts timestamp_ntz, event_id int, event string").repartition(7)
    want = {j: plain_fold([r[1:] for r in rows if r[0] == j]) for j in {r[0] for r in rows}}
    assert {r.job_id: tuple(r)[1:] for r in J.job_state(frame).collect()} == {j: s for j, (s, _) in want.items() if s[0]}
    opens = {r.event_id: r.opens for r in J.enqueue_dedup(frame).collect()}
    assert opens == {i: x for _, o in want.values() for i, x in o.items()} and opens[9004] is False


def test_neighbours_are_pruned_and_exact(spark):
    """Clustered vectors: the same as comparing all, with ever fewer of all pairs the more clusters there are."""
    shares = []
    for clusters in (8, 32):
        rng = np.random.default_rng(clusters)
        centres = rng.normal(size=(clusters, 16))
        vec = np.concatenate([c + rng.normal(scale=0.12, size=(40, 16)) for c in centres])
        vec /= np.linalg.norm(vec, axis=1, keepdims=True)
        vec = np.concatenate([vec, vec[:5], np.zeros((2, 16))])  # copies, and vectors without a direction
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)] + [(9999, None)], "id int, vec array<double>")
        like = np.round(vec @ vec.T, 12)
        want = set()
        for i in range(len(vec)):
            best = sorted((-like[i, j], j) for j in range(len(vec)) if j != i and like[i, j] >= 0.72)[:5]
            want |= {(i, j, place) for place, (_, j) in enumerate(best, 1)}
        got = D.knn_cosine(rows, rows, k=5, threshold=0.72, part=40)
        assert {(r.id, r.matched, r.place) for r in got.collect()} == want
        shares.append(D.nearest_pairs(rows, rows, 5, 0.72, 40)[1] / len(vec) ** 2)
    print("share of all pairs that were multiplied, 8 and 32 clusters:", shares)
    assert shares[1] < shares[0] < 0.5 and shares[1] < 0.15


def test_neighbours_of_odd_rows(spark):
    schema = "id int, vec array<double>"
    zero, none = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], schema), spark.createDataFrame([(3, None)], schema)
    assert D.knn_cosine(zero, zero).count() == 0 and D.knn_cosine(none, zero).count() == 0 and D.knn_cosine(zero, none).count() == 0
    assert {(r.id, r.matched) for r in D.knn_cosine(zero, zero, threshold=0.0).collect()} == {(1, 2), (2, 1)}


def test_keywords_meet_phrases(spark):
    blocks = spark.createDataFrame([(1, 0, "Go-to-Market plan", "Our unit economics, and the Scale-up; costs of a co-founder. Cost cost"), (1, 1, "", "x" * 598 + " aim"), (2, 0, None, None), (2, 1, "Machine  learning", "machine learning")], "doc_id int, block int, heading string, body string")
    got = {(r.doc_id, r.block, r.section): r.score for r in S.keyword_scores(blocks, taxonomy_table(spark)).collect()}

    def plain(heading, body):
        out = {}
        for section, words in TAXONOMY:
            for w in words:
                hit = re.compile(rf"(?<!\w){re.escape(w)}(?!\w)", re.I)
                score = len(w.split()) * (3.0 * bool(hit.search(heading or "")) + 0.5 * bool(hit.search((body or "")[:600])))
                out[section] = out.get(section, 0) + score
        return {s: x for s, x in out.items() if x}

    want = {(r.doc_id, r.block, s): x for r in blocks.collect() for s, x in plain(r.heading, r.body).items()}
    assert got == want and got[1, 0, "business_model"] == 7.0
    plan = S.keyword_scores(blocks, taxonomy_table(spark))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_scratch_folder_must_be_named_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from dossier.session import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    for master in ("spark://host:7077", "local-cluster[3,2,3000]", "yarn", ""):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=Conf({"spark.master": master})))
    assert shared_dir(SimpleNamespace(conf=Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"}))) == "hdfs://x/y"
    own = SimpleNamespace(conf=Conf({"spark.master": "local[8]"}))
    assert shared_dir(own).startswith("file://") and shared_dir(own) == shared_dir(own)


def test_long_errors_are_never_broadcast(spark):
    runs = spark.range(6).withColumnRenamed("id", "proposal_id")
    ends = spark.createDataFrame([(1, "failed", "e" * 5000), (2, "completed", None)], "proposal_id bigint, outcome string, error string")
    out = J.run_lifecycle(runs, ends)
    assert sorted((r.proposal_id, r.status, r.error) for r in out.collect()) == [(0, "processing", None), (1, "failed", "e" * 4000), (2, "completed", None), *((i, "processing", None) for i in (3, 4, 5))]
    rows = runs.selectExpr("proposal_id", "'queued' AS status", "'' AS error_stage", "0 AS retry_count")
    failed = J.record_failure(rows, ends.select("proposal_id", F.lit("metadata").alias("stage"), "error"))
    for df in (out, failed):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_words_of_flags_end_at_letters_beyond_ascii(spark):
    from dossier.functions import text as X

    texts = ["roié, cacñ", "roi cac", "roix cacx", "roi_ cac9", "mlß aiü", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.flag_financial(F.col("t")).alias("f"), X.flag_technical(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.f for r in rows] == [True, True, False, False, False, None]
    assert [r.t for r in rows] == [False, False, False, False, True, None]


def test_only_held_keywords_become_rows(spark):
    """Overlapping keywords of one to three words are all found; stretches that are none are not handed on."""
    texts = [(0, "A go-to-market plan: CO-FOUNDER, machine  learning machine learning"), (1, "to market"), (2, ""), (3, "market_x co founder")]
    words = ["go-to-market", "market", "machine learning", "learning", "co-founder", "founder"]
    rows = spark.createDataFrame(texts, "i int, t string").select("i", S.held_keywords(F.col("t"), words, 1).alias("k")).collect()
    assert {r.i: sorted(r.k) for r in rows} == {0: sorted(words), 1: ["market"], 2: [], 3: ["founder"]}


def test_columns_of_a_long_line_take_the_first_near_place():
    rng = random.Random(3)
    for _ in range(30):
        lines = [" ".join("x" * rng.randint(1, 4) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        votes = {}
        for line in lines:
            for start in (m.start() for m in re.finditer("[^ ]+", line)):
                near = next((at for at in votes if abs(at - start) <= Q.TOLERANCE), start)
                votes[near] = votes.get(near, 0) + 1
        assert Q._columns_of(lines) == sorted(at for at, n in votes.items() if 2 * n >= len(lines))
    started = time.process_time()
    Q._columns_of([" ".join(["ab"] * 60_000)] * 2)
    assert time.process_time() - started < 5  # compared with all places, this takes minutes


def test_windows_of_a_busy_hour_are_running_sums(spark):
    start = dt.datetime(2024, 1, 1, 10, 30)
    rng = random.Random(4)
    calls = [(i, "ab"[i % 2], start + dt.timedelta(microseconds=rng.choice([0, 1, 59_999_999, 60_000_000, 60_000_001, rng.randrange(400_000_000)])), rng.choice([None, -3, 5, 9])) for i in range(400)]
    calls += [(1000, "a", None, 7), (1001, "a", None, 8), (1002, "c", start, None), (1003, None, start, 4), (1004, "b", dt.datetime(1969, 12, 31, 23, 59, 59), 2), (1005, "b", dt.datetime(1970, 1, 1), 3)]
    out = J.rolling_budget(spark.createDataFrame(calls, "event_id int, model string, ts timestamp_ntz, tokens bigint"), seconds=60)
    minute = dt.timedelta(seconds=60)

    def used(model, ts):
        held = [n for _, m, at, n in calls if m == model and ((at is None) == (ts is None)) and (ts is None or ts - minute <= at <= ts) and n is not None]
        return sum(held) if held else None

    assert {r.event_id: r.used for r in out.collect()} == {i: used(m, ts) for i, m, ts, _ in calls}
    assert out.columns == ["event_id", "model", "ts", "tokens", "used", "over", "too_large"]
    assert "RangeFrame, -" not in out._jdf.queryExecution().analyzed().toString()  # a moving frame is added up anew for each call


def test_quotes_are_found_by_inner_words_and_cut_words_too(spark, monkeypatch):
    texts = [(1, "The  Quick brown fox jumps over the lazy dog"), (2, "a quick brown foxglove"), (3, "unquick brown"), (4, None), (5, ""), (6, "quick  quick quick brown fox"), (None, "the lazy dog's den")]
    long = [(1, "ick brown fox ju"), (2, "quick brown fox"), (2, "QUICK brown fox"), (3, "he lazy dog"), (4, "quick brown absent fox"), (None, "the lazy dog"), (5, None), (6, "quick quick")]
    cut = [(7, "uick brown"), (8, "quick brow"), (9, "foxglovexx"), (10, "short")]
    rows = spark.createDataFrame(texts, "doc_id int, text string")
    fold = lambda s: re.sub(r"\s+", " ", s.lower()).strip()

    def found(quotes):
        return sorted(map(tuple, R.find_quotes(spark.createDataFrame(quotes, "item_id int, text string"), rows).collect()), key=str)

    def plain(quotes):
        return sorted(((i, d) for i, q in {(i, fold(q)) for i, q in quotes if q} if len(q) >= 10 for d, t in texts if t and q in fold(t)), key=str)

    assert found(long + cut) == plain(long + cut)
    more_words = [q for q in long if q[0] != 6]
    with monkeypatch.context() as m:  # where all quotes have inner words, texts are never cut into stretches of characters
        m.setattr(R, "_grams", lambda text: 1 / 0)
        assert found(more_words) == plain(more_words)
