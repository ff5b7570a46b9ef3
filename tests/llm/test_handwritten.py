import itertools

import numpy as np

from claimweave.llm import handwritten as H

MIN = "!function(e,t){" + "e.p=function(s,d){return s?d(s):void 0};t.g={v:!0,n:!1};" * 20 + "}(this,{});"
NUMBERS = "module.exports = [" + ",".join(str(i * 7) for i in range(200)) + "];"
CASES = [
    (1, "o_r", "src/a.py", "x = 1\n", False), (2, "o_r", "src/b.py", "# Code generated by gen v1. DO NOT EDIT.\nx = 1\n", True), (3, "o_r", "src/c.js", MIN, True), (4, "o_r", "vendor/lib/deep/d.go", "package a\n", True), (5, "o_r", "src/vendor_portal/e.go", "package a\n", False),
    (6, "o_r", "src/f.js", NUMBERS, True), (7, "o_r", "web/package-lock.json", "{}", True), (8, "o_r", "src/g.java", "// Copyright (c) 2020 The Others. All rights reserved.\nclass A {}\n", True), (9, "o_r", "src/h.java", "// Copyright (c) 2020 o. All rights reserved.\nclass A {}\n", False),
    (10, "o_r", "src/i.py", "# Please do not edit the generated stubs from here, change the schema instead.\nx = 1\n", False), (11, "o_r", "src/j.py", "x = 1\n\n\n\n\n\n\ny = 2\nz = 3\nq = 4\nr = 5\nHEADER = '# Code generated by x. DO NOT EDIT.'\n", False), (12, "o_r", "src/k.json", None, False),
    (13, "o_r", "src/l.txt", "", False), (14, None, None, None, False), (15, "o_r", "dist/app.js.map", '{"version": 3, "sources": [], "mappings": "AAAA"}', True),
]


def frame(spark, cases):
    rows = [(i, r, p, p and p.rsplit("/", 1)[-1], None, c, "x") for i, r, p, c, _ in cases]
    return spark.createDataFrame(rows, "file_id bigint, repo_id string, path string, name string, language string, content string, label string")


def test_cases(spark):
    got = {r.file_id for r in H.not_handwritten(frame(spark, CASES + CASES[1:3])).collect()}
    assert got == {i for i, *_, bad in CASES if bad}
    assert H.not_handwritten(frame(spark, CASES).limit(0)).count() == 0


def test_messages_give_the_marginals(spark):
    """Marginals against the sum over all joint labels of directories and groups of siblings of a small tree."""
    cases = [(1, "r_x", "vendor/a.js", "x", 0), (2, "r_x", "vendor/s/b.js", "// Copyright (c) 2020 r. Mine\n", 0), (3, "r_x", "p/c.js", "y", 0), (4, "r_x", "p/d.js", MIN, 0)]
    files = frame(spark, cases)
    ev = {r.file_id: np.array([r[f"e{i}"] for i in range(5)]) for r in H.file_evidence(files).collect()}
    dirs = ["", "vendor", "vendor/s", "p"]
    up = {"vendor": "", "vendor/s": "vendor", "p": ""}
    held = {d: [i for i, _, p, _, _ in cases if p.rpartition("/")[0] == d] for d in dirs[1:]}
    sums = {i: np.zeros(5) for i in ev}
    for d in itertools.product(range(5), repeat=4):
        lab = dict(zip(dirs, d))
        base = sum(H.DIR_PRIOR[x] + (H.NAMED if k == "vendor" and x == 3 else 0) for k, x in lab.items())
        base += sum(H.BETWEEN[lab[p]][lab[k]] for k, p in up.items() if k != "vendor")
        for g in itertools.product(range(5), repeat=3):
            joint = base + sum(H.GROUP[lab[x]][y] for x, y in zip(dirs[1:], g))
            one = {i: np.exp(ev[i] + np.array(H.SIBLING[y])) for x, y in zip(dirs[1:], g) for i in held[x]}
            for i in ev:
                sums[i] += np.exp(joint) * one[i] * np.prod([v.sum() for j, v in one.items() if j != i])
    want = {i: (int(v.argmax()), round(float(np.log(v.max()) - np.log(v[0])), 3)) for i, v in sums.items()}
    got = {r.file_id: (H.LABELS.index(r.label), round(r.log_odds, 3)) for r in H.beliefs(files).collect()}
    assert got == want and {x for x, _ in got.values()} == {0, 2, 3}


def test_siblings_decide_a_file_without_evidence(spark):
    """One unmarked file among many generated, minified or data files of its kind goes with them; next to few it does not."""
    sibling = {"generated": ("go", "// Code generated by gen v1. DO NOT EDIT.\npackage a\n"), "minified": ("js", MIN), "blob": ("js", NUMBERS)}
    cases, want, n = [], {}, 0
    for label, (kind, text) in sibling.items():
        for many in (3, 40):
            for k in range(many):
                n += 1
                cases.append((n, f"r_{many}", f"src/{label}{many}/f{k}.{kind}", text, True))
            n += 1
            cases.append((n, f"r_{many}", f"src/{label}{many}/plain.{kind}", "x = 1\n", False))
            want[n] = label if many == 40 else "handwritten"
    got = {r.file_id: r.label for r in H.beliefs(frame(spark, cases)).collect()}
    assert {i: got[i] for i in want} == want


def test_evidence_grows_with_size_and_share():
    label = lambda path, text, **k: max(range(5), key=H.evidence("o_r", path, path, text, **k).__getitem__)
    hexes = "class T {\n static final int[] D = {\n" + "  0x6f, 0x30, 0x4b, 0xd6,\n" * 60 + " };\n}\n"
    assert label("T.java", hexes) == 4 and label("a.js", "x = [1, 2, 3];\n") == 0
    few, many = (H.evidence("o_r", "a.js", "a.js", "D = [" + "7, " * k + "]")[4] for k in (20, 40))
    assert few < many
    assert H.evidence("o_r", "a.go", "a.go", "x", is_test=True)[0] > H.evidence("o_r", "a.go", "a.go", "x", is_test=False)[0]
    assert H.evidence("o_r", "a.go", "a.go", None, size=9e9)[1] > H.evidence("o_r", "a.go", "a.go", None, size=None)[1]


def test_marks_count_wherever_their_comment_stands():
    licence = "/*\n" + " * Words of the licence of this repository, which say nothing about origin.\n" * 14 + " */\n"
    code = "".join(f"x{i} = {i}\n" for i in range(60))
    lock = '{\n' + "".join(f'  "k{i}": "some text that fills the head",\n' for i in range(40)) + '  "lockfileVersion": 3\n}\n'
    label = lambda path, text: max(range(5), key=H.evidence("o_r", path, path, text).__getitem__)
    assert label("a.go", licence + "// Code generated by gen v1. DO NOT EDIT.\n\npackage a\n") == 1
    assert label("a.py", code + "# Code generated by gen v1. DO NOT EDIT.\n") == 1
    assert label("a.py", '#!/usr/bin/env python\n"""Long.\n' + "words\n" * 50 + '"""\n# Copyright (c) 2020 The Others. All rights reserved.\n') == 3
    assert label("deps.json", lock) == 1
    assert label("a.py", code + "HEADER = '# Code generated by x. DO NOT EDIT.'\n") == 0
    assert label("a.py", code + "KEY = '\"lockfileVersion\": 3'\n") == 0
