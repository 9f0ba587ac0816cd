"""Licence scan of small trees, against public licence texts, brute force and SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from lexibond.llm import licenses
from lexibond.llm.licence_texts import TEXTS, templates

SF = "/root/testdata/sf0.001"
PROSE = "It was a fine day by the sea. The license of the poet is wide and so is the sky.\nNothing else was said."
FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("src/a.py", PROSE),
    ("src/deep/er/b.py", None),
    ("src/deep/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("src/deep/c.py", f"{PROSE}\nLicensed under the Apache License, Version 2.0.\n{PROSE}"),
    ("src/deep/d.py", "x" * 300_000),
    ("src/deeper/e.py", ""),
    ("docs/license-notes.md", PROSE),
    ("top.py", "spdx-license-identifier: MIT"),
    (None, "Released under the MIT License."),
    ("top.py", "spdx-license-identifier: MIT"),
]


def frame(spark, rows):
    return spark.createDataFrame([(p, t, "s", "l", "o", 0) for p, t in rows], "path string, text string, score string, license string, origin string, n int").repartition(3)


def test_scan(spark):
    rows = licenses.scan(frame(spark, FILES)).collect()
    assert len(rows) == len(FILES)
    got = {r["path"]: (r["license"], r["origin"], r["license_path"]) for r in rows}
    assert got == {
        "LICENSE": ("MIT", "own", None), "src/a.py": ("MIT", "inherited", "LICENSE"), "src/deep/er/b.py": ("GPL-3.0", "inherited", "src/deep/COPYING.txt"),
        "src/deep/COPYING.txt": ("GPL-3.0", "own", None), "src/deep/c.py": ("Apache-2.0", "own", None), "src/deep/d.py": ("GPL-3.0", "inherited", "src/deep/COPYING.txt"),
        "src/deeper/e.py": ("MIT", "inherited", "LICENSE"), "docs/license-notes.md": ("MIT", "inherited", "LICENSE"), "top.py": ("MIT", "own", None), None: (None, "none", None),
    }
    assert licenses.scan(frame(spark, FILES).limit(0)).count() == 0


def commented(text, mark, width=60):
    """A header as a source file has it: wrapped, a comment mark on each line."""
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += w + " "
    return "\n".join(f"{mark} {x}" for x in [*lines, line])


REAL = {
    "bsd": ("BSD-3-Clause", "Copyright (c) 2019, Some Person and the other authors\nAll rights reserved.\n\n" + TEXTS["BSD-3-Clause"][0].replace("the\n        copyright holder", "Some Person")),
    "bsd2": ("BSD-2-Clause", "Copyright 2001 Someone\n\n" + TEXTS["BSD-2-Clause"][0]),
    "mit": ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A. N. Other <a@b.c>\n\n" + TEXTS["MIT"][0]),
    "isc": ("ISC", "Copyright 2012 X\n" + TEXTS["ISC"][0]),
    "gpl3-file": ("GPL-3.0", "                    " + TEXTS["GPL-3.0"][1] + " By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program. " + "We want more words that no template has. " * 50),
    "gpl2-file": ("GPL-2.0", TEXTS["GPL-2.0"][1] + " Terms and more terms. " * 80),
    "gpl3-header": ("GPL-3.0", commented(f"Some program that does things. Copyright (C) 2020 Someone. {TEXTS['GPL-3.0'][0]}", "#") + "\nimport os\n" + "x = 1\n" * 100),
    "gpl2-header": ("GPL-2.0", commented(TEXTS["GPL-2.0"][0], " *") + "\nint main() { return 0; }"),
    "lgpl-header": ("LGPL-2.1", commented(TEXTS["LGPL-2.1"][0], "//", 40)),
    "agpl-header": ("AGPL-3.0", commented(TEXTS["AGPL-3.0"][0], "--")),
    "mpl-header": ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;"),
    "apache-header": ("Apache-2.0", commented("Copyright 2021 The Authors. " + TEXTS["Apache-2.0"][0], "//") + "\npackage main"),
    "apache-file": ("Apache-2.0", "\n\n" + TEXTS["Apache-2.0"][1] + ' For the purposes of this definition, "control" means more. ' * 30),
    "tag": ("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-only\nint x;"),
    "tag2": ("LGPL-3.0", "# SPDX-License-Identifier: LGPL-3.0-or-later"),
    "tag3": ("MPL-2.0", "/* SPDX-License-Identifier: MPL-2.0 */"),
    "sentence": ("MIT", "Some words first. Distributed under the MIT License. And so on."),
    "wrapped": ("Apache-2.0", "# Released under the Apache\n# License, Version 2.0.\n"),
    "denied": (None, "This is not licensed under the MIT License."),
    "denied2": (None, "It was never released under the GNU General Public License, version 3."),
    "near": (None, "Permission to enter the garden is granted to any person of this town, and the sale of copies is not."),
    "talk": (None, "The license of a driver is no license to drive as one wants. Apache is a town in Oklahoma; GNU is an animal."),
    "prose": (None, PROSE * 20),
}


@pytest.fixture(scope="module")
def real(spark):
    filler = [(f"n{i}/prose.txt", " ".join(f"word{(i * 7 + j) % 90}" for j in range(80)) + " the of and to in is under public license") for i in range(60)]
    rows = licenses.scan(frame(spark, [(f"{k}/x.txt", t) for k, (_, t) in REAL.items()] + filler)).collect()
    return {r["path"].split("/")[0]: (r["license"], r["score"]) for r in rows}


@pytest.mark.parametrize("name", REAL)
def test_real_texts(real, name):
    assert real[name][0] == REAL[name][0], real[name]


def test_every_template_is_its_own_best(spark):
    rows = [(f"f{i}.txt", t, k) for i, (k, _, t) in enumerate(templates())]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, k string")).collect()}
    assert [(p, got[p]["license"]) for p, _, _ in rows] == [(p, k) for p, _, k in rows]
    assert all(got[p]["score"] == 1 for p, _, t in rows)


def brute(files):
    """Best licence of each text over all windows, without the conditions that spare some."""
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", (t or "").lower())
    own = [(k, words(t)) for k, _, t in templates()]
    vocabulary = {w for _, ws in own for w in ws}
    df = Counter(w for t in files for w in vocabulary.intersection(words(t)))
    idf = lambda w: math.log((len(files) + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    ours = [(k, ws, v, norm(v)) for k, ws in own for v in [vector(ws)]]
    out = []
    for t in files:
        toks, best = words(t), []
        for k, ws, v, n in ours:
            for s in range(0, len(toks), max(1, len(ws) // licenses.GRID)):
                if len(ws) <= licenses.SAYING and not set(ws) & set(licenses.DENIES) and set(toks[max(0, s - licenses.BEFORE - len(ws) // 2) : s + len(ws)]) & set(licenses.DENIES):
                    continue
                own_v = vector(toks[s : s + len(ws)])
                score = round(sum(x * v.get(w, 0) for w, x in own_v.items()) / norm(own_v) / n, 6)
                if score >= licenses.COSINE:
                    best.append((-score, k))
        out.append((min(best)[1], -min(best)[0]) if best else (None, None))
    return out


def test_equals_all_windows(spark):
    texts = [t for _, t in REAL.values()] + [None, "", "license " * 400, "permission is hereby granted " * 40]
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.scan(frame(spark, [(f"{i}/x", t) for i, t in enumerate(texts)])).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[f"{i}/x"][0] == want[0] and (want[1] is None or abs(got[f"{i}/x"][1] - want[1]) < 2e-6)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(licenses.oracle()).df()
    df = licenses.scan_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = df.toPandas()
    columns = sorted(want.columns)
    table = lambda x: sorted(x[columns].astype(str).itertuples(index=False, name=None))
    assert sorted(got.columns) == columns and table(got) == table(want)
