import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from wardline.functions import splitters as P
from wardline.operators import dictionary as D

TEXTS = ["", "   ", "One. Two! Three? " * 30, "para one\n\npara two is longer\n\n\n\n" * 9, "x" * 900, "INTRO: a\nMETHODS: b c\n1. first\n2. second " + "w " * 300 + "\n# Head\nbody", "é ü. " * 100 + "\n\n" + "last"]


def random_texts(n):
    rng = random.Random(8)
    return TEXTS + ["".join(rng.choice(["word ", "longerword", ". ", "! ", "\n", "\n\n", "A: ", "1. ", "## T\n", "é", " "]) for _ in range(rng.randint(0, 400))) for _ in range(n)]


def plain_groups(parts, size, overlap, joint):
    """The rule on lists: a group closes before the part that would exceed `size`, the next begins with its last parts of `overlap` together."""
    groups, now = [], []
    for part in parts:
        if now and sum(map(len, now)) + len(part) > size:
            groups.append(now)
            k = next((k for k in range(len(now) + 1) if sum(map(len, now[k:])) <= overlap), len(now))
            now = now[k:] if overlap >= 0 else []
        now = [*now, part]
    return [joint.join(g) for g in [*groups, now] if g]


@pytest.mark.parametrize("size, overlap", [(60, 0), (60, 20), (200, 50)])
def test_sentences_and_paragraphs(size, overlap):
    for t in random_texts(40):
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]
        assert P.by_sentence(t, size, overlap) == plain_groups(sentences, size, overlap, " ")
        paragraphs = [p.strip() for p in t.split("\n\n") if p.strip()]
        assert P.by_paragraph(t, size) == plain_groups(paragraphs, size, -1, "\n\n")


def test_sentence_overlap_by_hand():
    assert P.by_sentence("aaaa. bbbb. cccc. dddd.", 10, 5) == ["aaaa. bbbb.", "bbbb. cccc.", "cccc. dddd."]
    assert P.by_sentence("aaaa. bbbb. cccc.", 10, 0) == ["aaaa. bbbb.", "cccc."] and P.by_sentence("a" * 30 + ". bb.", 10, 5) == ["a" * 30 + ".", "bb."]


def plain_recursive(text, size, overlap, separators):
    """The same rule by recursion: joins what is small, descends into what is not."""
    mark = next((s for s in separators if s == "" or s in text), None)
    if mark is None or mark == "":
        if len(text) <= size or mark is None:
            return [text.strip()] if text.strip() else []
        return [w.strip() for w in (text[i : i + size] for i in range(0, max(len(text) - overlap, 1), size - overlap)) if w.strip()]
    head, *rest = text.split(mark)
    pieces = ([head] if head else []) + [mark + p for p in rest]
    later, out, group = separators[separators.index(mark) + 1 :], [], []

    def close():
        if "".join(group).strip():
            out.append("".join(group).strip())

    for p in pieces:
        if len(p) > size:
            close()
            group = []
            out += plain_recursive(p, size, overlap, later)
            continue
        if group and len("".join(group)) + len(p) > size:
            close()
            while group and (len("".join(group)) > overlap or len("".join(group)) + len(p) > size):
                group = group[1:]
        group = [*group, p]
    close()
    return out


@pytest.mark.parametrize("size, overlap", [(40, 0), (40, 10), (150, 30)])
def test_separators_equal_recursion(size, overlap):
    for t in random_texts(60):
        got = P.by_separator(t, size, overlap)
        assert got == plain_recursive(t, size, overlap, list(P.SEPARATORS))
        assert all(len(c) <= size for c in got) and re.sub(r"\s", "", t) == "" or got


def test_sections_and_windows():
    text = "Intro text\nMETHODS: how\n1. one\n## Part\nABSTRACT here " + "s. " * 100
    assert [c[:8] for c in P.by_section(text, 1000, 100)] == ["Intro te", "METHODS:", "1. one", "## Part", "ABSTRACT"]
    assert P.by_section("plain", 10, 2) == ["plain"] and len(P.by_section("A: x\nB: " + "y. " * 100, 50, 10)) > 5


def test_headers_inherit_titles():
    text = "before\n# A\none\n## B ##\ntwo\n### C\n## D\nthree\n# E\n#not a header"
    assert P.header_sections(text) == [([], "before"), (["A"], "one"), (["A", "B"], "two"), (["A", "B", "C"], ""), (["A", "D"], "three"), (["E"], "#not a header")]
    assert P.by_header("# T\n" + "w " * 60, 50, 10)[0] == (["T"], ("w " * 25).strip()) and P.by_header("# only", 50, 10) == [(["only"], "")]


def test_ten_megabytes_in_seconds():
    text = ("Sentence number one is here. And two!\n" * 30 + "\n") * 8800
    assert len(text) > 10_000_000
    for name, split in P.STRATEGIES.items():
        began = time.time()
        assert split(text, 1000, 200) and time.time() - began < 15, name
    assert len(P.by_separator("x" * 10_000_000, 1000, 200)) == 12_500


def test_the_dispatcher(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (1, "# H\nx")], "doc_id int, text string")
    for strategy, split in P.STRATEGIES.items():
        got = P.chunked(docs, strategy, 50, 10).collect()
        assert {r.doc_id for r in got} == {1} and all(r.chunk_id == f"1_chunk_{r['index']}" and r.total >= 1 for r in got)
        assert sorted(r.content for r in got) == sorted(c[1] if strategy == "header" else c for t in ("One. Two.", "# H\nx") for c in split(t, 50, 10))
    assert P.chunked(docs, "header", 50, 10).where("content = 'x'").first().titles == ["H"]
    for bad in ({"strategy": "other"}, {"size": 5, "overlap": 5}):
        with pytest.raises(ValueError):
            P.chunked(docs, **bad)


def test_chunks_go_on_in_small_batches(spark, monkeypatch):
    docs, held = spark.createDataFrame([], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (held.append(f), self.sparkSession.createDataFrame([], schema))[1])
    P.chunked(docs, "sentence")
    texts = [f"Sentence {i} is here. " * 1000 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sizes = 0
    for out in held[0](iter([batch])):
        rows, sizes = rows + len(out), max(sizes, out.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 20_000_000 and sizes < 2 * P.BATCH and peak < 6 * P.BATCH
    assert rows == sum(len(P.by_sentence(t, 1000, 200)) for t in texts)


def brute_spans(text, terms, words):
    """All places and terms by plain comparison, then the longest from the left."""
    low, out, at = D._lowered(text), [], 0
    edge = lambda i: i in (0, len(low)) or not (D._word(low[i - 1]) and D._word(low[i]))
    while at < len(low):
        fits = [t for t in terms if low.startswith(t, at) and (not words or (edge(at) and edge(at + len(t))))]
        if fits:
            t = max(fits, key=len)
            out.append((at, at + len(t), t))
            at += len(t)
        else:
            at += 1
    return out


@pytest.mark.parametrize("block", [D.BLOCK, 5])
@pytest.mark.parametrize("words", [True, False])
def test_spans_equal_brute_force(spark, block, words):
    rng = random.Random(2)
    terms = ["heart", "heart failure", "failure", "mi", "a", "ab", "aba", "été", "t2dm", "heart failure acute", "x-ray"]
    texts = [" ".join(rng.choice(["Heart", "failure", "acute", "MI", "mime", "ababab", "ÉTÉ", "T2DM,", "x-ray", "İa", "a"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id int, text string").repartition(3)
    known = spark.createDataFrame([(t, t.upper()) for t in [*terms, "heart"]] + [(None, "n"), ("", "e")], "term string, code string")
    got = sorted((r.doc_id, r.start, r.stop, r.term) for r in D.occurrences(docs, known, words=words, block=block).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) for s in brute_spans(t, terms, words))
    joined = D.meanings(D.occurrences(docs, known, words=words, block=block), known.distinct()).collect()
    assert len(joined) == len(got) and all(r.code == r.term.upper() for r in joined)


def test_no_terms(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id int, text string")
    assert D.occurrences(docs, spark.createDataFrame([], "term string")).collect() == []
