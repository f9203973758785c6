"""The archive's rules on small hand-made rows."""

import datetime as dt
import json
import random
import time
import tracemalloc
import uuid

import numpy as np
import pandas as pd
import pytest
from dossier.config import RUBRIC, rubric_table
from dossier.functions import text as X
from dossier.operators import decisions as G
from dossier.operators import dedup as D
from dossier.operators import forms as Q
from dossier.operators import jobs as J
from dossier.operators import layout as P
from dossier.operators import listing as L
from dossier.operators import scoring as R
from dossier.operators import sections as S
from dossier.sources import files, tables
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


def test_rubric(spark):
    rows = rubric_table(spark).collect()
    assert len(rows) == 32 and len({r.parameter for r in rows}) == 7 and abs(sum(r[2] for r in RUBRIC) - 1) < 1e-9


@pytest.mark.parametrize(
    "raw, want",
    [("Acme Agri Pvt Ltd", "acme agri"), ("ACME AGRI private limited.", "acme agri"), (" acme-agri, Inc", "acme agri"), ("Agritech Solutions", "agritech solutions"), ("", "")],
)
def test_company_keys(spark, raw, want):
    assert one(spark, raw, X.normalize_company) == want


def test_slug(spark):
    assert one(spark, " Crop & Soil  Care! ", X.slugify) == "crop-soil-care" and one(spark, "!!", X.slugify) == "uncategorized"


def test_cleaning(spark):
    assert one(spark, "ﬁne ①", X.nfkc) == "fine 1"
    assert one(spark, "a\x07b​c\td\ne", X.strip_control) == "abc\td\ne"
    assert one(spark, " a \t b\n\n\n\nc ", X.collapse_ws) == "a b\n\nc"
    assert one(spark, "a\n - 12 -\nPage 3 of 9\nCONFIDENTIAL\nb", X.drop_page_markers).split() == ["a", "b"]
    assert one(spark, "w0rd and a1b\n|\nx....y", X.fix_ocr) == "word and alb\n\nx y"
    long = "this line is surely longer than twenty"
    assert one(spark, f"{long}\nnext exam-\nple.\n- {long}\nx", X.fix_line_breaks) == f"{long} next example.\n- {long}\nx\n"
    assert one(spark, "abc", X.est_tokens) == 1 and one(spark, "x" * 43, X.est_tokens) == 10


def test_repeated_lines_go_from_long_texts_only(spark):
    body = [f"line {i}" for i in range(18)]
    rows = [(1, "\n".join(body + ["head"] * 3)), (2, "\n".join(["head"] * 3)), (3, "\n".join(body + ["abc"] * 4)), (4, None)]
    got = dict(map(tuple, S.drop_repeated_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()))
    assert "head" not in got[1] and got[2] == "head\nhead\nhead" and got[3].count("abc") == 4 and got[4] is None
    assert S.clean_text(spark.createDataFrame([(1, None)], "doc_id int, text string")).first().text == ""


def test_sections(spark):
    from dossier.config import taxonomy_table

    text = "Cover page of it\n## Budget breakdown\n" + "money " * 30 + "\n## Founders Background\n" + "people " * 30 + "\n## Email\nx@y.z\n## Zebra\nno\n## Zoo\n" + "animals " * 30
    blocks = S.split_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [r.heading for r in blocks.orderBy("block").collect()] == ["", "Budget breakdown", "Founders Background", "Email", "Zebra", "Zoo"]
    got = {r.section: r.text for r in S.sectionise(blocks, taxonomy_table(spark)).collect()}
    assert "Budget" in got["financial"] and "Founders" in got["team"] and "Email" in got["identity"] and "Zebra" in got["identity"] and "Zoo" in got["vision"]
    assert not any("Cover page" in t for t in got.values())
    assert S.scoreable_sections(spark.createDataFrame([("identity",), ("team",)], "section string")).count() == 1


def test_json_repair(spark):
    assert json.loads(one(spark, '```json\n{"a": 1}\n```', X.repair_json)) == {"a": 1}
    assert json.loads(one(spark, 'so: {"a": "}{", "b": {"c": 2}} and more }', X.repair_json)) == {"a": "}{", "b": {"c": 2}}
    assert one(spark, "nothing", X.repair_json) is None and one(spark, '{"a": ', X.repair_json) is None and one(spark, None, X.repair_json) is None


def test_evidence(spark):
    texts = spark.createDataFrame([(1, "We  reached ‘12’ villages – and sold 300 units in the first year of the pilot, which ended in May last year."), (2, None)], "doc_id int, text string")
    quotes = ["we reached '12' villages - and", "we sold 900 units", "We reached 12 villages"]
    long = "We reached '12' villages - and sold 300 units in the first year of the pilot, which ended in June"
    cited = spark.createDataFrame([(1, q) for q in [*quotes, long]] + [(2, "anything at all")], "doc_id int, quote string")
    got = {r.quote: r.grounded for r in R.ground_quotes(cited, texts).collect()}
    assert got == {quotes[0]: True, quotes[1]: False, quotes[2]: False, long: True, "anything at all": False}
    rows = [("7", True, True), ("12", True, True), ("-1", True, True), ("7", False, True), ("7", True, False), ("good", True, True), (None, True, True), ("nan", True, True)]
    scores = spark.createDataFrame(rows, "s string, e boolean, g boolean").select(R.downgraded(F.col("s"), F.col("e"), F.col("g"))).collect()
    assert [r[0] for r in scores] == [7.0, 10.0, 0.0, None, None, None, None, None]


def test_quotes_are_found_by_their_rarest_stretch(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=80)) + (" Ünrest’s" if i % 3 == 0 else "")) for i in range(30)] + [(40, "short"), (41, ""), (42, None), (43, "a common passage " * 40), (44, "a common passage " * 40)]
    quotes = [(i, r[1][5 * i : 5 * i + n]) for i, (r, n) in enumerate(zip(rows, [10, 11, 14, 20, 33, 70] * 5))]
    quotes += [(99, "w1 nowhere to be found in any of these texts"), (100, "short"), (101, None), (102, "ÜNREST'S w"), (103, "A common  passage a"), (104, "ünrest's"), (103, "A common  passage a")]
    fold = lambda t: " ".join(t.lower().replace("’", "'").split())
    want = sorted({(i, d) for i, q in quotes if q and len(fold(q)) >= 10 for d, t in rows if t and fold(q) in fold(t)})
    frame, texts = spark.createDataFrame(quotes, "item_id int, text string"), spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted(map(tuple, R.find_quotes(frame, texts).collect())) == want and len(want) >= 30
    many = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit("a passage numbered "), "id").alias("text"))
    assert "NestedLoop" not in R.find_quotes(many, texts)._jdf.queryExecution().toString()


def test_scores(spark):
    answers = spark.createDataFrame([(1, "a", 8.0), (1, "a", None), (1, "b", None), (1, "c", 4.0), (1, "c", 5.0)], "proposal_id int, parameter string, score double")
    failed = spark.createDataFrame([(1, "c")], "proposal_id int, parameter string")
    params = R.parameter_status(R.parameter_scores(answers), failed)
    got = {r.parameter: (r.score, r.status) for r in params.collect()}
    assert got == {"a": (80.0, "scored"), "b": (None, "unevidenced"), "c": (None, "failed")}
    weights = spark.createDataFrame([("a", 0.2, "A"), ("b", 0.5, "B"), ("c", 0.3, "C")], "parameter string, weight double, label string")
    v = R.verdicts(params, weights).first()
    assert (v.weighted_score, v.coverage, v.unevidenced, v.failed, v.is_partial) == (80.0, 0.333, ["B"], ["C"], True)
    nothing = R.verdicts(params.where("parameter = 'b'"), weights).first()
    assert nothing.weighted_score == 0.0 and nothing.coverage == 0.0
    labels = [r[0] for r in params.orderBy("parameter").select(R.score_label(F.col("status"), F.col("score"))).collect()]
    assert labels == ["80.0", "Not addressed", "Not assessed"]


def test_adjustment_stays_in_its_band(spark):
    rows = [(70.0, "90"), (70.0, "72.5"), (70.0, "x"), (70.0, None), (97.0, "200"), (3.0, "-9")]
    got = [r[0] for r in spark.createDataFrame(rows, "w double, p string").select(R.adjusted(F.col("w"), F.col("p"))).collect()]
    assert got == [78.0, 72.5, 70.0, 70.0, 100.0, 0.0]


def test_debate(spark):
    schema = "proposal_id int, parameter string, score double, red_flags int"
    rows = [(1, "a", 90.0, 0), (1, "b", 50.0, 0), (1, "c", 60.0, 0), (2, "a", 75.0, 2), (2, "b", 74.0, 0), (2, "c", None, 0), (3, "a", 71.0, 1), (3, "b", 70.0, 0), (3, "c", 69.0, 0)]
    pairs = [("a", "b"), ("b", "c")]
    got = {r.proposal_id: r.reasons for r in R.debate_triggers(spark.createDataFrame(rows, schema), pairs).collect()}
    assert got == {1: ["apart:a-b", "spread"], 3: ["flagged:a"]}
    moves = spark.createDataFrame([(1, "a", 120.0), (1, "b", 50.3), (2, "c", 40.0)], "proposal_id int, parameter string, proposed double")
    after = {(r.proposal_id, r.parameter): (r.before, r.score, r.moved) for r in R.apply_debate(spark.createDataFrame(rows, schema), moves).collect()}
    assert after[1, "a"] == (90.0, 100.0, True) and after[1, "b"] == (50.0, 50.0, False) and after[2, "c"] == (None, None, False) and after[3, "a"] == (71.0, 71.0, False)


def sequential(rows, categories, companies):
    """Decides one row after the other."""
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        ok = r["decision"] in ("approved", "rejected", "selected_for_funding", "unselected")
        if ok and r["decision"] in ("approved", "selected_for_funding"):
            taken = r["category"] in categories or r["company_id"] in companies
            ok = r["is_evaluated"] and (r["acknowledged"] or not taken)
            if ok:
                categories.add(r["category"])
                companies.add(r["company_id"])
        out[r["seq"]] = ok
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_are_decided_in_order(spark, seed):
    rng = random.Random(seed)
    schema = "proposal_id int, seq int, decision string, acknowledged boolean, is_evaluated boolean, category string, company_id int"
    rows = [dict(proposal_id=i, seq=i, decision=rng.choice(["approved"] * 5 + ["rejected", "nonsense"]), acknowledged=rng.random() < 0.15, is_evaluated=rng.random() < 0.9, category=f"k{rng.randrange(12)}", company_id=rng.randrange(14)) for i in range(60)]
    ledger = spark.createDataFrame([(900, "approved", "k0", 3, dt.datetime(2024, 1, 1))], "proposal_id int, decision string, category string, company_id int, decided_at timestamp_ntz")
    got = {r.seq: r.accepted for r in G.decide_batch(spark.createDataFrame(rows, schema), ledger).collect()}
    assert got == sequential(rows, {"k0"}, {3})


def test_listing(spark):
    rows = [(i, s, dt.datetime(2024, 1, 1 + i)) for i, s in enumerate([5.0, None, 9.0, None])]
    frame = spark.createDataFrame(rows, "proposal_id int, latest_score double, created_at timestamp_ntz")
    assert [r.proposal_id for r in L.sort_listing(frame, "score").collect()] == [2, 0, 3, 1]
    assert [r.proposal_id for r in L.sort_listing(frame, "score", descending=False).collect()] == [0, 2, 3, 1]
    assert [r.proposal_id for r in L.sort_listing(frame, "no such key").collect()] == [3, 2, 1, 0]
    assert L.page(L.sort_listing(frame), 1, 0)[2] == 0 and L.page(L.sort_listing(frame), 2, 3)[1:] == (4, 2)
    assert L.status_in(frame.withColumn("status", F.lit("a")), " , ").count() == 4


def test_knn_meets_every_part(spark, small_dir):
    v = spark.read.parquet(f"{small_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows = v.unionAll(v.where("id % 5 = 0").select((F.col("id") + 100_000).alias("id"), "vec")).unionAll(v.limit(1).select(F.lit(-1).cast("bigint"), F.lit(None).cast("array<float>")))
    one, many = (sorted(map(tuple, D.knn_cosine(rows, rows, threshold=0.3, part=part).collect())) for part in (20_000, 17))
    vectors = {r.id: np.array(r.vec, float) for r in rows.collect() if r.vec is not None}
    want = []
    for i, x in vectors.items():
        near = sorted((-round(float(x @ y), 9), j) for j, y in vectors.items() if j != i and x @ y >= 0.3)[:5]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
    assert one == many and [(i, j, n) for i, j, _, n in one] == sorted(want, key=lambda w: (w[0], w[1])) and len(want) > 100
    zero = spark.createDataFrame([([0.0, 0.0],)], "vec array<double>").select(D.unit_normalise(F.col("vec"))).first()[0]
    assert zero == [0.0, 0.0]


def test_patches(spark):
    base = spark.createDataFrame([(1, "a", "old", "old"), (2, "b", "t", "t")], "id int, status string, text string, preview string")
    patch = spark.createDataFrame([(1, None, "n" * 3000, 5, ["status", "text"]), (9, "z", None, 5, ["status"])], "id int, status string, text string, junk int, fields array<string>")
    got = {r.id: r for r in tables.apply_patch(base, patch, "id").collect()}
    assert got[1].status is None and len(got[1].text) == 3000 and len(got[1].preview) == 2000 and got[2].status == "b" and len(got) == 2


def test_ledger_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, "approved", dt.datetime(2023, 5, 6)), (2, "rejected", dt.datetime(2024, 7, 8))], "proposal_id int, decision string, decided_at timestamp_ntz")
    path = str(tmp_path / "ledger")
    tables.append_ledger(rows, path)
    tables.append_ledger(rows.limit(1), path)
    read = spark.read.parquet(path)
    assert read.count() == 3 and read.where("decision_year = 2024 AND decision_month = 7").count() == 1
    assert tables.append_audit(rows, str(tmp_path / "audit"))
    (tmp_path / "file").write_text("x")
    assert not tables.append_audit(rows, str(tmp_path / "file" / "below"))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "a" / "y.exe").write_bytes(b"1")
    rows = {r.name: r for r in files.read_text(files.validate_files(files.read_files(spark, str(tmp_path)))).collect()}
    assert rows["x.TXT"].reason is None and rows["x.TXT"].text == "café � end" and rows["y.exe"].reason == "Unsupported format"
    assert spark.createDataFrame([("a.txt", 0)], "name string, size int").select(files.reject_reason(F.col("name"), F.col("size"))).first()[0] == "Empty file"
    key = spark.createDataFrame([("Ünser Plan (v2).final.PDF", 7)], "n string, i int").select(files.safe_key("originals", F.col("i"), F.col("n"))).first()[0]
    assert key == "originals/7/_nser_Plan__v2_.final.pdf"


def test_forms(spark):
    text = "intro line\nWhat is it?\nA thing.\nStill.\nCompany Name\nAcme\nTeam (list)\nWho | What\nA B | CEO\nC D | CTO\nodd"
    qa = Q.qa_pairs(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = {r.question: r.answer for r in qa.collect()}
    assert got == {"Preamble": "intro line", "What is it?": "A thing.\nStill.", "Company Name": "Acme", "Team (list)": "Who | What\nA B | CEO\nC D | CTO\nodd"}
    table = Q.pipe_tables(qa).first()
    assert table.headers == ["Who", "What"] and table.rows == [["A B", "CEO"], ["C D", "CTO"]]
    aligned = "Name      Role      Years\nAnna B    CEO       12\nCarl D    CTO       7"
    t = Q.aligned_tables(spark.createDataFrame([(1, 0, aligned)], "doc_id int, place int, answer string")).first()
    assert t.columns == 4 and t.rows[1] == ["Anna", "B", "CEO", "12"]  # every word start counts
    amounts = Q.extract_amounts(spark.createDataFrame([(1, "cost Rs. 50000 or ₹ 13,22 and inr 5")], "doc_id int, text string")).collect()
    assert [a.value for a in amounts] == ["500", "1322"] and "cost" in amounts[0].context
    cells = spark.createDataFrame([(1, [[" a ", "b\nc"], ["", None], ["1", "2"]]), (2, [["x"], ["y"]])], "i int, rows array<array<string>>")
    rows = Q.normalise_table(cells).collect()
    assert len(rows) == 1 and rows[0].headers == ["a", "b c"] and rows[0].rows == [["1", "2"]]


def test_layout(spark):
    schema = "doc_id int, page int, at int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"
    left = [(1, 0, i, "four words are here", 10.0, False, 10.0, 10.0 * (4 - i), 200.0, 0.0) for i in range(4)]
    right = [(1, 0, 4 + i, "Big title" if i == 0 else "and four more words", 14.0 if i == 0 else 10.0, False, 320.0, 10.0 * i, 500.0, 0.0) for i in range(4)]
    spans = spark.createDataFrame(left + right, schema)
    assert P.body_size(spans).first().body == 10.0
    marked = P.mark_headings(P.reading_order(spans, 600.0))
    assert [r.at for r in marked.orderBy("position").collect()] == [3, 2, 1, 0, 4, 5, 6, 7]
    assert "## Big title" in P.emit_marked_text(marked).first().text
    assert P.body_size(spans.where("text = 'Big title'")).first().body == 10.0


def events(rows):
    start = dt.datetime(2024, 1, 1)
    return [(j, start + dt.timedelta(seconds=s), i, e) for i, (j, s, e) in enumerate(rows)]


def test_jobs(spark):
    rows = events([(1, 0, "enqueue"), (1, 5, "enqueue"), (1, 10, "claim"), (1, 20, "heartbeat"), (2, 0, "claim"), (2, 1, "enqueue"), (2, 2, "cancel"), (3, 0, "enqueue"), (3, 1, "claim"), (3, 2, "fail"), (3, 3, "succeed"), (3, 4, "enqueue")])
    frame = spark.createDataFrame(rows, "job_id int, ts timestamp_ntz, event_id int, event string")
    state = {r.job_id: (r.status, r.attempts) for r in J.job_state(frame).collect()}
    assert state == {1: ("running", 1), 2: ("cancelled", 0), 3: ("queued", 0)}
    opens = {r.event_id: r.opens for r in J.enqueue_dedup(frame).collect()}
    assert opens == {0: True, 1: False, 5: True, 7: True, 11: True}
    late = J.stalled(J.job_state(frame), "2024-01-01 01:00:00").collect()
    assert [(r.job_id, r.status) for r in late] == [(1, "queued")]


def test_budget_counts_the_edge(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "m", start + dt.timedelta(seconds=s), n) for i, (s, n) in enumerate([(0, 50), (60, 50), (61, 10), (200, 95)])]
    got = J.rolling_budget(spark.createDataFrame(rows, "event_id int, model string, ts timestamp_ntz, tokens bigint"), 60, 100).orderBy("event_id").collect()
    assert [r.used for r in got] == [50, 100, 60, 95] and [r.over for r in got] == [False, True, False, True] and [r.too_large for r in got] == [False, False, False, True]


def test_budget_agrees_with_every_earlier_call(spark):
    from collections import defaultdict

    calls = [(i, f"m{i % 3}", (i * i * 7919) % 5000 if i % 50 else None, i % 17) for i in range(600)]
    start = dt.datetime(1969, 12, 31, 23, 30)  # stretches before the epoch too
    frame = spark.createDataFrame([(i, m, None if s is None else start + dt.timedelta(seconds=s), n) for i, m, s, n in calls], "event_id int, model string, ts timestamp_ntz, tokens bigint")
    of = defaultdict(list)
    for _, m, s, n in calls:
        of[m].append((s, n))
    got = {r.event_id: r.used for r in J.rolling_budget(frame, 300, 100).collect()}
    assert got == {i: sum(n for t, n in of[m] if (t is None if s is None else t is not None and s - 300 <= t <= s)) for i, m, s, _ in calls}


def test_given_files(spark, small_dir, tmp_path):
    import hashlib
    from pathlib import Path

    from dossier import registry

    registry.load()
    given = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(small_dir).glob("*.parquet")}
    assert {tuple(r) for r in registry.QUERIES["s1_read_files"](spark, small_dir).collect()} == given
    from dossier.streaming import streams

    streams.file_intake(streams.arriving_files(spark, small_dir), str(tmp_path / "ledger"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    arrived = streams.taken_in(spark, str(tmp_path / "ledger")).collect()
    assert {(r.name, r.size, r.sha256) for r in arrived} == given and {r.reason for r in arrived} == {"Unsupported format"}


def test_large_files_are_hashed_in_pieces(spark, small_dir, tmp_path, monkeypatch):
    """Files that the reader of whole files refuses (here above 4,000 bytes), in splits and pieces that end within lines."""
    import hashlib
    import random
    from pathlib import Path

    from dossier import registry

    registry.load()
    monkeypatch.setattr(files, "WHOLE", 3000)
    monkeypatch.setattr(files, "PIECE", 5500)
    monkeypatch.setattr(files, "CHUNK", 700)
    held = random.Random(5).randbytes(20_000)
    contents = {
        "small": b"a\nb", "as many as one task reads": held[:3000], "one more": held[:3001], "random": held, "a % of lines.txt": held.replace(b"\n", b"") + b"\n", "no line end": b"x" * 9000,
        "line ends": b"\n" * 9000, "carriage returns": b"a\r\n\rb\r" * 1500 + b"\r", "mark": b"\xef\xbb\xbf" + held[:9000] + b"\n", "mark without line end": b"\xef\xbb\xbf" + held[:9000] + b"x", "mark and line end": b"\xef\xbb\xbf\n" + held[:5000],
        "two marks": b"\xef\xbb\xbf" * 2 + held[:7000] + b"\n", "part of a mark": b"\xef\xbb" + held[:7000], "packed.gz": held[:3900], "sub/packed.json.BZ2": held[:3500], "sub/random": held,
    }
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    settings = {"spark.sql.sources.binaryFile.maxLength": "4000", "spark.sql.files.maxPartitionBytes": "1900", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = sorted((r.path.removeprefix(f"file:{tmp_path}/"), r.name, r.size, r.sha256) for r in files.identify_files(spark, str(tmp_path)).collect())
        assert got == sorted((n, n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items())
        monkeypatch.setattr(files, "PIECE", 250_000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
        given = sorted((p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(small_dir).glob("*.parquet"))
        assert sorted(map(tuple, registry.QUERIES["s1_read_files"](spark, small_dir).collect())) == given
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_hash_goes_on_from_its_state():
    import hashlib

    data = bytes(range(256)) * 5
    for cut in (0, 1, 63, 64, 65, 1000):
        one = files.Sha256()
        one.update(data[:cut])
        two = files.Sha256(one.state())
        two.update(data[cut:])
        assert one.hexdigest() == hashlib.sha256(data[:cut]).hexdigest() and two.hexdigest() == hashlib.sha256(data).hexdigest()


def test_live_jobs_agree_with_the_fold(spark, small_dir):
    from dossier import registry
    from dossier.bindings import Archive

    registry.load()
    live = {r.job_id: (r.status, r.attempts, r.heartbeat, r.queued_at) for r in registry.QUERIES["st2_live_jobs"](spark, small_dir).collect() if r.status}
    fold = {r.job_id: (r.status, r.attempts, r.heartbeat, r.queued_at) for r in J.job_state(Archive(spark, small_dir).job_events).collect()}
    assert live.keys() == fold.keys()
    # the stream also puts back running jobs that nothing was heard of for too long
    assert all(live[k] == v or (v[0] == "running" and live[k] == ("failed" if v[1] >= J.MOST else "queued", *v[1:])) for k, v in fold.items())


def test_lines_are_cut_once_a_text(spark):
    """Columns that a lambda names are computed anew for each line that it sees: a text of many lines took hours."""
    lines = [f"{'again and again' if i % 4 == 0 else f'a line that stands here but once and is long {i}'}" for i in range(30_000)]
    frame = spark.createDataFrame([(1, 0, "\n".join(lines)), (2, 0, "\n".join(f"{i} | {i % 3 or ''} | x" for i in range(30_000)))], "doc_id int, place int, answer string")
    began = time.monotonic()
    kept = S.drop_repeated_lines(frame, "answer").select("answer").first()[0]
    assert kept.split("\n") == [x for x in lines if x != "again and again"]
    joined = frame.select(X.fix_line_breaks(F.col("answer")).alias("t")).first().t
    assert joined.count("\n") == 7_501  # a long line without an end goes on in the next one, a short one stops
    table = Q.pipe_tables(frame).select("width", F.size("rows").alias("n"), "headers").collect()
    assert [tuple(r) for r in table] == [(3, 19_999, ["1", "1", "x"])]
    assert time.monotonic() - began < 60


def test_vectors_meet_in_products_of_bounded_size():
    """256 new rows met a part of any size at a time: one worker held hundreds of MB."""
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(20_512, 16))
    asks = np.arange(len(vec)) >= 20_000
    rows = pd.DataFrame({"cell": 0, "part": 0, "deal": 0, "asks": asks, "id": np.arange(len(vec)), "vec": list(vec), "floor": -1e9})
    tracemalloc.start()
    got = [x for x in D._nearest(3)(iter([rows]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = pd.concat(got).groupby("id").matched.apply(set)
    like = vec[asks] @ vec[~asks].T
    assert [found[i] for i in np.flatnonzero(asks)] == [set(x) for x in np.argpartition(like, -3, axis=1)[:, -3:].tolist()]
    assert peak < 40 << 20, peak


def test_lines_of_scores_are_dealt_by_size(spark, small_dir, monkeypatch):
    """A task of the score queries gets about so many lines, and nothing after that is dealt again by another key."""
    from dossier import bindings
    from dossier.plans import scoring

    monkeypatch.setattr(bindings, "ROWS_A_TASK", 300, raising=False)
    a = bindings.Archive(spark, small_dir)
    total = a.table("lineitem").count()
    tasks = [r["count"] for r in a.answers.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= total // 300 and max(tasks) < 600
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.verdicts(a)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt)  # answers and failed parameters, by order


def test_routed_vectors_leave_a_few_at_a_time():
    """A vector that reaches all cells is repeated for each; a frame of them holds PRODUCT numbers at most, and none is lost."""
    class Asked:
        schema = {"id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})}
        mapInPandas = staticmethod(lambda run, kind: run)

    rng = np.random.default_rng(3)
    vec, pivots = rng.normal(size=(600, 64)), np.eye(64)
    cells = pd.DataFrame({"cell": range(64), "low": 0.0, "high": 3.2, "longest": 1.0})
    asked = pd.DataFrame({"id": range(600), "vec": list(vec), "home": 5, "floor": 0.0})
    frames = list(D._routed(Asked, pivots, cells)(iter([asked])))
    assert max(len(f) for f in frames) <= D.PRODUCT // 64
    got = pd.concat(frames)
    assert sorted(zip(got["id"], got["cell"])) == [(i, c) for i in range(600) for c in range(64) if c != 5]
    assert all((v == vec[i]).all() for i, v in zip(got["id"], got["vec"]))
