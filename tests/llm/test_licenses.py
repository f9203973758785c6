"""Licence scan against a plain version, and inheritance by directories."""

import math
import re
from collections import Counter

from dossier.llm.licenses import STOPWORDS, TEMPLATES, THRESHOLD, notices, passage_templates, scan


def plain(text):
    """Best (score, licence) of a text's sentences."""
    terms = lambda t: Counter(w for w in re.findall(r"[^\W_]+", t.lower()) if w not in STOPWORDS)
    templates = {n: terms(t) for n, t in TEMPLATES}
    df = Counter(w for t in templates.values() for w in t)
    idf = lambda w: math.log((1 + len(templates)) / (1 + df[w])) + 1
    best = []
    for sentence in re.split(r"\n|(?<=[.!?])\s+", text or ""):
        own = terms(sentence)
        norm = math.sqrt(sum((k * idf(w)) ** 2 for w, k in own.items()))
        for name, t in templates.items():
            n = math.sqrt(sum((k * idf(w)) ** 2 for w, k in t.items()))
            dot = sum(k * idf(w) * own[w] * idf(w) for w, k in t.items())
            if norm and dot / norm / n >= THRESHOLD:
                best.append((-round(dot / norm / n, 6), name))
    return min(best, default=None)


def test_scores(spark):
    texts = [
        "Hello world.\nReleased under the MIT License.", "mit der und die", "It is licensed under Apache License, version 2.0. Bye", "All rights reserved", "ALL RIGHTS RESERVED! The MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "license", None, "", "x " * 30000 + "Released under the MIT License.", "Released under the MIT License agreement of the big company of the town",
    ]
    frame = spark.createDataFrame([(f"d/{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (-r.score, r.licence) for r in notices(frame).collect()}
    want = {f"d/{i}": plain(t) for i, t in enumerate(texts) if plain(t)}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a/x.txt", "text"), ("a/b/LICENSE.md", "word. " * 50 + gpl), ("a/b/y.txt", "t"), ("a/b/c/d/z.txt", None), ("a/b/own.txt", "word. " * 50 + "All rights reserved."),
        ("top.txt", "t"), (None, mit), ("q/long.txt", "word. " * 200 + mit), ("q/other.txt", "t"), ("a/x.txt", "text"),
    ]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, licence string")
    got = {(r.path, r.licence, r.origin, r.governed_by) for r in scan(frame).collect()}
    assert scan(frame).count() == len(rows)
    assert got >= {
        ("LICENSE", "MIT", "notice", None), ("a/x.txt", "MIT", "inherited", ""), ("a/b/y.txt", "GPL-3.0", "inherited", "a/b"), ("a/b/c/d/z.txt", "GPL-3.0", "inherited", "a/b"),
        ("a/b/own.txt", "Proprietary", "notice", None), ("top.txt", "MIT", "inherited", ""), (None, None, "none", None), ("q/long.txt", "MIT", "notice", None), ("q/other.txt", "MIT", "inherited", ""),
    }
    assert scan(frame.limit(0)).count() == 0


def test_headers_and_whole_texts(spark):
    known = passage_templates()
    mit, bsd, gpl, apache = (known[f"{n}.txt"] for n in ("MIT.header", "BSD-3-Clause.header", "GPL-3.0.header", "Apache-2.0.header"))
    rights = "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n"
    code = "\n".join(f"value{i} = compute{i}(alpha{i}, beta{i})" for i in range(60))
    comment = lambda t, mark: "".join(f"{mark}{line}\n" for line in t.splitlines())
    rows = [
        ("m/LICENSE", mit.replace("The MIT License\n", "MIT License\n\nCopyright (c) 2019 Jane Doe\n"), "MIT"), ("n/LICENSE", mit.split("\n", 1)[1], "MIT"),
        ("b/LICENSE", rights + bsd, "BSD-3-Clause"), ("b2/LICENSE", rights + known["BSD-2-Clause.header.txt"], "BSD-2-Clause"),
        ("g/COPYING", known["GPL-3.0.whole.txt"], "GPL-3.0"), ("h/COPYING", known["GPL-2.0.whole.txt"], "GPL-2.0"), ("l/COPYING.LESSER", known["LGPL-3.0.whole.txt"], "LGPL-3.0"),
        ("a/LICENSE", known["Apache-2.0.whole.txt"], "Apache-2.0"), ("p/LICENSE", known["MPL-2.0.whole.txt"], "MPL-2.0"),
        ("s/gpl.py", comment("Copyright (C) 2020 Jane Doe\n\n" + gpl, "# ") + code, "GPL-3.0"), ("s/apache.java", "/*\n" + comment("Copyright 2020 Jane Doe. All rights reserved.\n" + apache, " * ") + " */\n" + code, "Apache-2.0"),
        ("s/gpl2.py", comment(known["GPL-2.0.header2.txt"], "// ") + code, "GPL-2.0"), ("s/plain.py", code, None), ("s/own.py", rights + code, "Proprietary"),
    ]
    got = {r.path: r.licence for r in notices(spark.createDataFrame(rows, "path string, text string, want string")).collect()}
    assert got == {path: want for path, _, want in rows if want}


def test_short_headers_tags_and_permissions(spark):
    known = passage_templates()
    rights = "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n"
    code = "\n".join(f"value{i} = compute{i}(alpha{i}, beta{i})" for i in range(60))
    rows = [
        ("i/LICENSE", rights + known["ISC.header.txt"], "ISC"), ("u/own.txt", rights + "Permission to use this text in school plays is given to anyone who asks.", None),
        ("t/a.py", "# SPDX-License-Identifier: Apache-2.0\n" + code, "Apache-2.0"), ("t/b.c", "/* SPDX-License-Identifier:GPL-2.0-or-later */\n" + code, "GPL-2.0"), ("t/c.c", "// SPDX-License-Identifier:\n" + code, None),
        *[(f"p/{n}.py", "".join(f"# {line}\n" for line in known[n].splitlines()) + code, n.rsplit(".", 2)[0]) for n in ("GPL-3.0.header2.txt", "GPL-2.0.header3.txt", "LGPL-3.0.header2.txt", "LGPL-2.1.header3.txt", "AGPL-3.0.header2.txt")],
        ("e", "", None), ("n", None, None), ("z", "word " * 300_000, None),
    ]
    frame = spark.createDataFrame([(p, t, w, "f", "s", 1, "x") for p, t, w in rows], "path string, text string, want string, folder string, share string, inherited int, `a.b` string")
    out = scan(frame)
    assert out.columns == ["path", "want", "folder", "share", "inherited", "a.b", "licence", "origin", "score", "governed_by"]
    got = {r.path: (r.licence if r.origin == "notice" else None, r.folder, r.share, r.inherited) for r in out.collect()}
    assert got == {p: (w, "f", "s", 1) for p, _, w in rows}
