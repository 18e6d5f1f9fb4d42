"""Files nobody wrote, and stuffed pages, on hand-made cases."""

import random

import pytest

from tidemark.llm.source_files import GENERATED_NOTICES, LITERALS, by_path, measure, unwritten_files
from tidemark.llm.stuffing import stuffed_pages, stuffing
from pyspark.sql import functions as F

HAND = "def load(path):\n    with open(path) as f:\n        return parse(f.read())\n\n\ndef parse(text):\n    # keep the order of the lines\n    return [x.strip() for x in text.splitlines() if x]\n"
LIB = "\n".join(f"int step_{w}(struct {w} *p) {{ return mix({w}, p->next_{w}, {i}); }}" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()))
MIN = "!function(a,b){c.d=e||{}}(this,f);var g=h(1),i=j.k;function l(m,n){return o.p(q)||3}for(var r=0;s<t.length;u++)v(w[x]);" * 3

FILES = {
    "p/src/a.py": (HAND, False),
    "p/src/b.py": ("# Code generated by toolx. DO NOT EDIT.\n" + HAND, True),
    "p/src/c.py": (HAND + "\n# end of output of toolx, regenerate with `toolx --write c`\n", True),
    "p/src/d.py": ("# the script puts \"DO NOT EDIT\" at the top\n" + HAND, False),
    "p/src/e.py": ('header = "@generated by toolx"\n' + HAND, False),
    "p/src/f.py": ("# used to be generated, kept by hand since\n" + HAND, False),
    "p/src/g.py": (HAND + "    # code generated by the compiler is kept\n" + HAND, False),
    "p/src/h.js": (MIN, True),
    "p/src/i.min.js": (HAND, True),
    "p/third_party/lib/i.c": (HAND, True),
    "p/src/third_party_login.py": (HAND, False),
    "p/deps/lib-1.2.3/x.c": (HAND, True),
    "p/libs/ledger/x.c": (HAND, False),
    "p/tools/generator/x.py": (HAND, False),
    "p/yarn.lock": ("", True),
    "p/src/j.c": (LIB, True),
    "p/src/k.c": (LIB.replace("alpha", "omega"), True),
    "p/src/l.py": ("DATA = [\n" + "\n".join(f"  0x{i:02x}, 0x{i + 1:02x}, 0x{i + 2:02x}," for i in range(40)) + "\n]\n", True),
    "p/src/m.py": (HAND + "WEIGHTS = [1, 2, 3, 5, 8]\n", False),
    "p/src/n.rs": ("\n".join(f"    OPCODE_{i:04d} = {i}," for i in range(30)), True),
    "p/src/o.c": ("/* quill 1.2.3 - https://quill.example/ */\n" + HAND, True),
    "p/src/q.c": ("// not vendored: we wrote this after reading their paper\n" + HAND, False),
    "p/src/r.py": ("", False),
    "p/src/u.py": ("# Automatically generated from the inputs, do not edit\n" + HAND, True),
    "p/src/v.c": ("/*\nTHIS FILE IS GENERATED BY toolx\n*/\n" + HAND, True),
    "p/src/w.py": ('"""\nTables of the parser.\n\nCode generated by toolx. DO NOT EDIT.\n"""\n' + HAND, True),
    "p/lic/a.go": ("// Licensed under the Apache License 2.0, see https://www.apache.org/licenses/LICENSE-2.0\n" + HAND, False),
    "p/lic/b.go": ("// SPDX-License-Identifier: GPL-2.0 Copyright Acme\n" + HAND, False),
    "p/lic/c.c": ("/*\n * Copyright (c) 2020 Acme\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\n" + HAND, False),
    "p/lic/d.c": ("// MIT License. Copyright (c) 2019 The Authors\n// SPDX-License-Identifier: Apache-2.0 OR MIT\n" + HAND, False),
    "p/lic/e.py": ("# Requires Python 3.11, see https://docs.example/ (c) us\n# This program is free software under the GNU General Public License version 3.0 or later\n" + HAND, False),
    "p/lic/f.js": ("// Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed, obtain one at https://mozilla.example/MPL/2.0/.\n" + HAND, False),
    "p/gen/a.go": ("// Code generated by stringer; adds String methods. DO NOT EDIT.\n" + HAND, True),
    "p/gen/b.py": ("# This file is generated, it puts the rows in order\n" + HAND, True),
    "p/gen/c.go": ("// DO NOT EDIT.\n" + HAND, True),
    "p/gen/d.py": ("# This file is no longer automatically generated\n" + HAND, False),
    "p/gen/e.py": ("# It was not automatically generated. Do not edit while the server runs.\n" + HAND, False),
    "p/gen/f.py": ("# Generated from api.yaml - do not modify\n" + HAND, True),
    "p/ven/a.c": ("// quill v1.2.3 | (c) quill contributors | MIT\n" + HAND, True),
    "p/ven/b.c": ("# copied from quill 1.2.3 (upstream: https://code.example/quill); local changes: none\n" + HAND, True),
    "p/src/x.py": ('"""\nLoads files.\n"""\n' + HAND + 'HEAD = """\nCode generated by toolx. DO NOT EDIT.\n"""\n' + HAND, False),
}


def test_files(spark):
    rows = [(p, t, "clash") for p, (t, _) in FILES.items()] + [("p/src/a.py", HAND, "x"), ("p/src/s.py", HAND, "x"), ("p/src/s.py", "# @generated\n", "x"), (None, MIN, "x"), ("p/src/t.py", None, "x")]
    df = spark.createDataFrame(rows, "file_path string, content string, reason string")
    known = spark.createDataFrame([(LIB,), (None,)], "content string")
    got = {r.path for r in unwritten_files(df, known).collect()}
    assert got == {p for p, (_, yes) in FILES.items() if yes} | {"p/src/s.py"}
    assert unwritten_files(df.limit(0), known).count() == 0 and unwritten_files(df, known.limit(0)).count() == len(got) - 2


def test_known_sources_beyond_the_bound(spark):
    df = spark.createDataFrame([(p, t) for p, (t, _) in FILES.items()] * 2 + [("p/none", None)], "file_path string, content string")
    known = spark.createDataFrame([(LIB,), (None,)], "content string")
    assert {tuple(r) for r in unwritten_files(df, known, most_known=3).collect()} == {tuple(r) for r in unwritten_files(df, known).collect()}


LONG = {
    "numbers": "-0.30594, -0.37448, -0.86617, " * 10_000, "cut": "-0.30594, " * 10_000 + "-", "digits": "7" * 100_000 + "!", "quotes": "'" * 50_001 + '"', "blocks": "/*" * 50_000 + "1.2 (c)",
    "versions": "// " + "1.2 " * 30_000 + "!", "names": "// " + "a-1" * 30_000 + "!", "licences": "// " + "apache " * 20_000 + "1.2", "froms": "// copy of 1 " + "origin: upstream: " * 6_000, "nots": "# " + "not " * 25_000,
    "opens": "/* open\n" * 12_000, "docs": "\"\"\" x\n" * 12_001, "hits": "# do not edit by hand " * 5_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_lines_take_linear_time(name):
    import time

    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(GENERATED_NOTICES):
        automaton.add_word(phrase, i)
    automaton.make_automaton()
    began = time.process_time()
    measure(LONG[name], automaton, frozenset())
    assert time.process_time() - began < 1.5


def test_literal_lines():
    for text, yes in {"-0.30594, -0.37448, -": True, "[0x1F, 'a\\'b', null],": True, "x = 1": False, "nullable, 1": False, "-0.3059, -0.37448 !": False, '"open, 1': False, "{'a': 1.5e-7}": True}.items():
        assert bool(LITERALS.fullmatch(text)) == yes, text


def test_paths(spark):
    cases = {"a\\vendor\\x\\y.c": "vendored", "a/b_pb2.py": "generated", "a/x.pb.go": "generated", "a/Cargo.lock": "lockfile", "a/bundle.js": None, "a/app.bundle.js": "minified", "a/externals/x.c": None, "a/min_heap.go": None, "a/report_generated_at.py": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert [r[0] for r in df.select(by_path(F.col("p"))).collect()] == list(cases.values())


PROSE = "The retry queue took 300 requests under heavy load, so we renamed it. Nobody noticed that the lock file had stopped behind the gateway."
STUFFED = {
    "soup": "cheap hosting coupon " * 30,
    "cities": "\n".join(f"hosting best {c}ville - cheap hosting" for c in "Alt Bel Lake Mill West Oak Fair Nord".split()) * 2,
    "products": "\n".join(f"SKU-{i}83 coupon {w} M red {i}5.99 cheap" for i, w in enumerate("lamp desk chair mug pen bag hat belt".split())),
    "links": "\n".join(f"- https://www.site{i}.example/?id={i} deal" for i in range(20)),
    "tags": "Tags: " + " ".join(f"#{a}-{b}" for a in ("cheap", "hosting", "deal") for b in ("one", "two", "three", "four")),
    "html": "".join(f'<a href="https://x{i}.example/">cheap deal</a> ' for i in range(20)),
    "sentences": "With cheap deal you save on cheap deal, and cheap deal near you is cheap deal at its best. " * 8,
    "hidden": "che\u200bap ho\u200bsting cou\u200bpon " * 30,
    "wide": "ｃｈｅａｐ ｈｏｓｔｉｎｇ ｃｏｕｐｏｎ " * 30,
    "leet": "che@p h0st1ng c0up0n " * 30,
    "zh": "折扣 免费下载 推荐 便宜 " * 30,
    "mostly": PROSE + "\n\n" + "cheap hosting coupon " * 60,
}
FINE = {
    "prose": PROSE * 3,
    "log": "\n".join(f"2024-01-0{i % 9 + 1}T10:00:0{i % 9}Z INFO worker_pool: flush took {i * 37} ms (batch={i})" for i in range(30)),
    "table": "| name | limit | owner |\n|---|---|---|\n" + "\n".join(f"| {a} | {i} rows | {b} team |" for i, (a, b) in enumerate(zip("quota lease token slot edge".split(), "data web core ops docs".split()))),
    "code": "```c\n" + "\n".join(f"static int step{i}(int a) {{ return a + {i}; }}" for i in range(20)) + "\n```",
    "glossary": "\n".join(f"**{w}**: The {w} is read by the {v} and written when the lock of the {v} is free." for w, v in zip("quota lease token slot edge note".split(), "worker loader parser writer reader timer".split())),
    "references": "\n".join(f"- [Notes on {w}](https://x.example/{w}): We moved the {w} and then it was fast again after the release." for w in "quota lease token slot edge note".split()),
    "mostly prose": PROSE * 4 + "\n\ncheap hosting coupon",
    "short": "ok",
    "german": "Die Ursache lag beim Suchlauf, nicht beim Auftrag. Ohne den Auftrag läuft der Abgleich nicht durch. Bitte den Suchlauf erst sichern, dann löschen. " * 3,
    "blank": " \n\t ", "empty": "", "null": None,
}


@pytest.mark.parametrize("name", STUFFED)
def test_stuffed(name):
    assert stuffing(STUFFED[name]) > 0.5


@pytest.mark.parametrize("name", FINE)
def test_fine(name):
    assert stuffing(FINE[name]) <= 0.5


def test_pages(spark):
    rows = [(i, t, 0.5) for i, t in enumerate([*STUFFED.values(), *FINE.values()])] + [(0, STUFFED["soup"], 0.1), (None, STUFFED["soup"], 0.1), (99, "a" * 200_000, 0.1)]
    df = spark.createDataFrame(rows, "doc long, text string, share double")
    got = sorted((r.doc is not None, r.doc) for r in stuffed_pages(df, "doc", "text").collect())
    assert [d for _, d in got] == [None, *range(len(STUFFED))]
    assert stuffed_pages(df.limit(0), "doc", "text").count() == 0


@pytest.mark.parametrize("keywords", [30, 100, 1000])
@pytest.mark.parametrize("times", [3, 10, 50])
def test_stuffed_with_many_keywords(keywords, times):
    rng = random.Random(keywords + times)
    words = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(keywords)]
    said = words * times
    rng.shuffle(said)
    assert stuffing("\n".join(", ".join(said[i : i + 10]) for i in range(0, len(said), 10))) > 0.9
    glued = ["#" + w + rng.choice(words) for w in said]
    assert stuffing("\n".join(" ".join(glued[i : i + 10]) for i in range(0, len(glued), 10))) > 0.9


@pytest.mark.parametrize("lines", [30, 300, 3000])
def test_long_lists_are_fine(lines):
    rng = random.Random(lines)
    words = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(4, 9))) for _ in range(50_000)]
    titles = rng.choices(words, [1 / (i + 10) for i in range(len(words))], k=lines * 7)
    assert stuffing("\n".join("- " + " ".join(titles[i : i + 7]) for i in range(0, len(titles), 7))) <= 0.5


@pytest.mark.parametrize("text", [" " * 200_000 + "x", "f(" * 60_000, "a " * 20_000 + "(", "<" * 100_000, "<b" * 50_000, "." * 100_000, "= " * 60_000, "1" * 150_000 + "a", "x / " * 40_000, ";" * 100_000, "---\n" * 30_000, ", " * 60_000])
def test_long_pages_take_linear_time(text):
    import time

    began = time.process_time()
    stuffing(text)
    assert time.process_time() - began < 1.5
