import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.llm import licenses as L
from wardline.llm.license_texts import NOTICES, TEXTS

MIT, GPL, APACHE, MPL = NOTICES["MIT"][0], NOTICES["GPL-3.0"][0], NOTICES["Apache-2.0"][0], NOTICES["MPL-2.0"][0]
FILLER = "The parser reads every token of the stream and writes rows, then it closes the file and counts what was written. "
ROWS = [
    (1, "a/LICENSE", MIT), (2, "a/b/c/x.py", "code\nmore code"), (3, "a/b/LICENSE.txt", "Head\n" + GPL + "\nend"), (4, "a/b/y.py", "// Licensed under the Apache License, version 2.0\nx"),
    (5, "z/x.py", "no licence of any kind"), (6, None, MIT), (7, "a/q.py", None), (8, "", ""), (9, "top.py", "x"), (10, "a/b/c/COPYING", "unknown words only"), (11, "ab/x.py", "x"),
    (13, "n/x.py", "release 3.5 of license.2020 and the work.3"), (14, "n/y.py", "This work is licensed under the GNU General Public License,\nversion 3."),
    (12, "a/d/x.py", "the license under version\n" * 300), (2, "a/b/c/x.py", "code\nmore code"),
    (15, "m/LICENSE", "The MIT License\n\nCopyright (c) 2020 A. Person\n\n" + TEXTS["MIT"][0]), (16, "m/src/deep/x.c", "int main"), (17, "k/x.c", FILLER * 5 + "\n" + TEXTS["Apache-2.0"][0].replace(" ", "\n * ", 40) + "\n" + FILLER * 5),
    (18, "k/y.c", "# SPDX-License-Identifier: MIT\nx = 1"), (19, "k/z.c", "# SPDX-License-Identifier: Foo-1.0\nx = 1"), (20, "k/w.c", TEXTS["GPL-3.0"][0]), (21, "k/v.c", "// SPDX-License-Identifier: Apache-2.0"), (22, "k/u.c", FILLER * 40 + MPL + " " + FILLER * 40),
]


def brute(rows):
    """Cosines of every line, every template's best window and the whole text, with all weights counted from all rows."""
    templates = L.templates_of()
    df = Counter(t for *_, x in rows for t in set(L.terms(x or "")))
    idf = lambda t: math.log((len(rows) + 1) / (df[t] + 1)) + 1
    weigh = lambda w: {t: (1 + math.log(c)) * idf(t) for t, c in Counter(w).items()}

    def cosine(a, b):
        u, v = weigh(a), weigh(b)
        norm = math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
        return sum(x * v.get(t, 0) for t, x in u.items()) / norm if norm else 0.0

    split = [(name, L.terms(t), least) for name, t, least in templates]
    own = {}
    for i, _, text in rows:
        words, best = L.terms(text or ""), (0.0, None)
        parts = [L.terms(p) for p in (text or "").split("\n") if p] + [words]
        for name, t, least in split:
            heavy, windows = weigh(t), []
            if len(t) < len(words):
                sums = [round(sum(heavy.get(w, 0) ** 2 for w in words[a : a + len(t)]), 6) for a in range(len(words) - len(t) + 1)]
                windows = [words[sums.index(max(sums)) :][: len(t)]]
            others = {w for n, o, _ in split if n != name and len(o) < 40 for w in o}
            for p in parts + windows:
                if (len(t) >= 40 or (not set(t) - others) or (set(t) - others) & set(p)) and (c := cosine(p, t)) >= least and (-c, name) < (-best[0], best[1] or "~"):
                    best = (c, name)
        own[i] = (best[1], best[0])
    return own


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, p, t, 1, 2) for i, p, t in ROWS], "doc_id int, path string, text string, license int, `row` int").repartition(2)
    return L.scan_licenses(docs).cache()


def test_scan_equals_brute_force(scanned):
    got, wanted = scanned.collect(), brute(ROWS)
    assert len(got) == len(ROWS) and {r["row"] for r in got} == {2}
    for r in got:
        assert r.own_license == wanted[r.doc_id][0] and math.isclose(r.cosine, wanted[r.doc_id][1], abs_tol=1e-5), r


def test_whole_texts_wrapped_headers_and_tags(scanned):
    own = {r.doc_id: r.own_license for r in scanned.collect()}
    assert own[15] == "MIT" and own[17] == "Apache-2.0" and own[18] == "MIT" and own[19] is None and own[20] == "GPL-3.0" and own[21] == "Apache-2.0" and own[22] == "MPL-2.0"


def test_nearest_ancestor(scanned):
    got = {r.doc_id: (r.license, r.license_from) for r in L.inherit(scanned).collect()}
    assert got[1] == ("MIT", "own") and got[2] == ("GPL-3.0", "a/b") and got[4] == ("Apache-2.0", "own") and got[7] == ("MIT", "a") and got[16] == ("MIT", "m")
    assert got[10] == ("GPL-3.0", "a/b") and got[6] == ("MIT", "own") and all(got[i] == (None, None) for i in (5, 8, 9, 11))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, path string, text string")
    assert L.inherit(L.scan_licenses(docs)).collect() == []


def test_conflicting_licence_files(spark):
    rows = [(1, "d/LICENSE", MIT), (2, "d/COPYING", MPL), (3, "d/x", "x")]
    got = L.inherit(L.scan_licenses(spark.createDataFrame(rows, "doc_id int, path string, text string"))).where(F.col("doc_id") == 3).first()
    assert got.license == "MIT" and got.license_from == "d"


def test_a_common_word_beside_a_notice_costs_little_at_any_size():
    """A line with one more everyday word keeps its cosine as the corpus grows a thousandfold, shares of documents being equal."""
    line = L.terms("Code released under the MIT License.")
    found = []
    for n in (10_000, 10_000_000):
        shares = {"released": 0.001, "under": 0.3, "the": 0.9, "mit": 0.001, "license": 0.01, "code": 0.5}
        scanner = L.Scanner(L.templates_of(), n, {t: int(n * s) for t, s in shares.items()}, n / 100)
        ps = [p for p in scanner.passage(line, True, list(range(len(scanner.names)))) if scanner.names[p["template"]] == "MIT" and not p["rare"]]
        found.append(max(p["dot"] / math.sqrt(p["square"]) for p in ps))
    assert min(found) > 0.9


def test_frequencies_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, path string, text string").repartition(3)
    assert {r.term: r.df for r in L.document_frequencies(docs, "text").collect()} == Counter(t for _, _, x in ROWS for t in set(L.terms(x or "")))


def test_no_hopeful_text_is_passed_over():
    import random

    rng = random.Random(1)
    df = {"the": 900, "license": 20, "under": 300, "version": 30, "work": 200}
    scanner = L.Scanner(L.templates_of(), 1000, df, 10)
    words = [w for ts in NOTICES.values() for t in ts for w in t.split()] + ["other", "words"] * 20
    for _ in range(1000):
        text = L.terms(" ".join(rng.choices(words, k=rng.randint(1, 14))))
        v = {t: (1 + math.log(c)) * scanner.idf.get(t, scanner.least_rare) for t, c in Counter(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        for i, tv in enumerate(scanner.vectors):
            if sum(x * tv.get(t, 0) for t, x in v.items()) / norm >= scanner.least[i] and (not scanner.needed[i] or scanner.needed[i] & set(text)):
                assert i in scanner.hopeful(set(text))
