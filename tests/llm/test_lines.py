"""Boilerplate lines against brute force."""

import random
from collections import Counter, defaultdict

from dossier.llm import lines
from dossier.llm.lines import drop_boilerplate


def brute(rows, ratio, least):
    pages, counts = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        if host is not None:
            pages[host] += 1
            counts[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, None, None))
            continue
        own = text.split("\n")
        kept = [x for x in own if host is None or not x.strip(" ") or not (counts[host][x.strip(" ")] >= least and counts[host][x.strip(" ")] / pages[host] > ratio)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    common = [f"menu {i}" for i in range(8)] + ["  padded ", ""]
    rows = []
    for i in range(300):
        own = [rng.choice(common) if rng.random() < 0.3 else f"text {rng.randrange(2000)}" for _ in range(rng.randrange(0, 12))]
        rows.append((i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice(["\n".join(own)] * 20 + [None, ""])))
    rows += [(7, "b", "menu 1"), (7, "b", "menu 1"), (None, "tiny", "menu 1"), (400, "tiny", "menu 1")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id int, source string, text string, host string")
    for ratio, least in ((0.1, 5), (0.02, 2)):
        got = drop_boilerplate(frame, ratio=ratio, min_pages=least)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, ratio, least)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate(frame, ratio=0.02, min_pages=2).collect()), key=str) == brute(rows, 0.02, 2)
    assert got.columns == ["doc_id", "source", "text", "host", "n_lines", "n_dropped"]
    assert drop_boilerplate(frame.limit(0)).count() == 0


def test_clashing_names_and_long_texts(spark):
    long = "\n".join([*(f"own {i}" for i in range(200_000)), "menu"])
    frame = spark.createDataFrame([(i, "h", "menu\nx" + str(i), i) for i in range(20)] + [(20, "h", long, 20)], "doc_id int, source string, text string, own int")
    frame = frame.selectExpr("doc_id", "source", "text", *[f"own AS `{n}`" for n in ("_keys", "_host", "_kept", "n_lines", "keys", "host", "a.b", "page", "lines")])
    got = {r.doc_id: r for r in drop_boilerplate(frame).collect()}
    assert got[3].text == "x3" and got[3]._keys == got[3]["a.b"] == got[3].page == got[3].lines == 3 and got[3].n_lines == 2
    assert got[20].n_lines == 200_001 and got[20].n_dropped == 1 and len(got[20].text) == len(long) - 5
    assert drop_boilerplate(frame).columns == [*frame.columns, "n_dropped"]
