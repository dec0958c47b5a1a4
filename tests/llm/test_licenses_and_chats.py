import math
import os
import re
from collections import Counter

import pytest

from hoopframe.llm import license_scan
from hoopframe.llm.chat_format import format_preferences
from hoopframe.llm.license_scan import scan_licenses


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_licenses(texts, known):
    """{id: (license, score)} of the best block of lines of each text, over all blocks and templates."""
    lines = {d: [words(x) for x in t.split("\n")] for d, t in texts.items()}
    all_lines = [x for own in lines.values() for x in own if x]
    has = Counter(w for x in all_lines for w in set(x))
    vocabulary = {w for _, t in [*known, *license_scan.TITLES] for w in words(t)}
    def weights(ws):
        return {w: c * (math.log((len(all_lines) + 1) / ((has[w] if w in vocabulary else 0) + 1)) + 1) for w, c in Counter(ws).items()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    made = [(name, weights(words(t))) for name, t in known]
    out = {}
    for d, own in lines.items():
        best = None
        for i in range(len(own)):
            for size in license_scan.BLOCKS:
                v = weights([w for x in own[i : i + size] for w in x])
                if v and (size == 1 or i + size <= len(own)):
                    for name, t in made:
                        score = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6)
                        if score >= license_scan.THRESHOLD and (best is None or (-score, name) < (-best[1], best[0])):
                            best = (name, score)
        out[d] = best or (None, None)
    return out


def test_scores_equal_brute_force(spark):
    known = license_scan.TEMPLATES
    texts = {i: "\n".join(re.findall(r".{1,70}(?:\s|$)", t)) for i, (_, t) in enumerate(known)}  # wrapped
    texts |= {100 + i: f"some code\n\n{t}\nmore code and words of it" for i, (_, t) in enumerate(known)}
    texts |= {200: "version of the license\nfree software", 201: "nothing at all\n" * 40}
    files = spark.createDataFrame([(d, f"src/{d}.txt", t) for d, t in texts.items()], "doc_id long, path string, text string").repartition(3)
    got = {r.doc_id: (r.license, r.score) for r in scan_licenses(files).collect()}
    want = brute_licenses(texts, known)
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1], abs=0.02) if want[d][1] else got[d][1] is None for d in texts)
    assert sum(got[i][0] == name for i, (name, _) in enumerate(known)) >= len(known) - 2


#: Titles as their texts begin, laid out as they are, over text that holds the headers of other licences.
FIRST_LINES = {
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "GFDL-1.2": "                GNU Free Documentation License\n                  Version 1.2, November 2002\n",
    "GPL-1.0": "\n\n                    GNU GENERAL PUBLIC LICENSE\n                     Version 1, February 1989\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "LGPL-2.0": "                  GNU LIBRARY GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "MPL-1.1": "                          MOZILLA PUBLIC LICENSE\n                                Version 1.1\n                              ---------------",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "Artistic-1.0": "\t\t\t The \"Artistic License\"\n\t\t\t\tPreamble\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n",
    None: "My Own Licence For Things\nFifth edition\n",
}
COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_titles_go_before_passages(spark):
    clause = "The licensee agrees to section {0} of these terms, under which copies of the covered work are conveyed on paper or otherwise.\n"
    passage = "permitted for the purposes of this document and any work that you license under version three of the general terms of it\n"
    rows = [(k, f"d{k}/LICENSE", first + "\n" + "".join(clause.format(j) for j in range(60)) + passage) for k, first in enumerate(FIRST_LINES.values())]
    rows += [(100 + k, f"d{k}/file.txt", "nothing of the kind") for k in range(len(rows))]
    rows.append((200, "own/LICENSE", "Fifth edition of it\n" + "".join(clause.format(j) for j in range(60)) + dict(license_scan.TEMPLATES)["GPL-2.0"]))
    got = {r.doc_id: (r.license, r.how) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(FIRST_LINES):
        assert got[k] == ((name, "file") if name else (None, "none")), name
        assert got[100 + k] == ((name, "inherited") if name else (None, "none"))
    assert got[200] == ("GPL-2.0", "header")  # a passage that is surely a header


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_usual_licence_texts(spark):
    texts = [(k, f"{f}/LICENSE", open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for k, f in enumerate(COMMON)]
    got = {r.path.split("/")[0]: (r.license, r.how) for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, path string, text string")).collect()}
    assert got == {f: (name, "file") for f, name in COMMON.items()}


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "src/LICENSE", mit),
        (2, "src/a/b/c.txt", "nothing here"),
        (3, "src/a/LICENSE.md", f"intro words\n{apache}\n"),
        (4, "src/a/b/d.txt", "some prose\n" * 500 + mit),
        (5, "other/x.txt", ""),
        (6, "other/y.txt", None),
        (7, None, mit.upper()),
        (8, "srcx/z.txt", "the of the under the"),
        (8, "srcx/z.txt", "the of the under the"),
        (9, "src/e.txt", "x"),
    ]
    files = spark.createDataFrame([(*r, "GPL") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.how, r.from_dir) for r in scan_licenses(files).collect()}
    assert got[1] == ("MIT", "file", None) and got[3] == ("Apache-2.0", "header", None)
    assert got[2] == ("Apache-2.0", "inherited", "src/a") and got[4] == ("MIT", "header", None)
    assert got[9] == ("MIT", "inherited", "src") and got[7] == ("MIT", "header", None)
    assert got[5] == got[6] == got[8] == (None, "none", None)
    assert scan_licenses(files).count() == len(rows)
    assert scan_licenses(files.limit(0)).collect() == []


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "no"),
        (3, 0, "user", "hi"),
        (4, 0, None, None), (4, None, "user", "x"),
        (None, 0, "user", "lost"),
    ]
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, prompt string")


def test_preferences(spark, turns):
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, 3), (4, 1), (9, 1), (None, 1)], "chosen_id long, rejected_id long")
    got = {(r.chosen_id, r.rejected_id): r for r in format_preferences(turns, pairs).collect()}
    assert set(got) == {(1, 2), (1, 3), (3, 3), (4, 1)}
    r = got[1, 2]
    assert r.n_prompt == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert r.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["yes<|end|>\n"]
    assert got[1, 3].rejected == "" and got[3, 3].n_prompt == 1 and got[3, 3].chosen == ""
    assert got[4, 1].n_prompt == 0 and got[4, 1].chosen.startswith("<|user|>\nx<|end|>\n<||>\n")
    assert format_preferences(turns.limit(0), pairs).collect() == []
