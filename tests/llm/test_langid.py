import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import langid
from wardline.llm.common import crc_bucket, table

PARTS = {"aa": ["tion", "the", "ing", "with", "er"], "bb": ["schaft", "ung", "ein", "über", "keit"], "cc": ["ción", "que", "los", "mente", "ñar"]}


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(PARTS))
        yield i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 120))), lang


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.createDataFrame(list(texts(300, 1)), "doc_id bigint, text string, lang string")
    return langid.fit(docs, F.lit(True), per_label=80, steps=120, batch=48, span=48)


def test_held_out_accuracy_on_new_texts(spark, net):
    docs = spark.createDataFrame(list(texts(200, 2)), "doc_id bigint, text string, truth string")
    got = langid.identify_language(docs, net).collect()
    assert np.mean([r.language.label == r.truth for r in got]) > 0.97
    assert all(0 <= r.language.score <= 1 for r in got)


def test_nulls_empty_long_and_clashing_columns(spark, net):
    rows = [(1, None), (2, ""), (3, "123 ... 456"), (4, "tion the ing " * 20000), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, 0.5, "zz") for i, t in rows], "doc_id bigint, text string, score double, lang string")
    got = {r.doc_id: r.language for r in langid.identify_language(docs, net).collect()}
    assert [got[i].label for i in (1, 2, 3)] == ["und"] * 3 and got[4].label == "aa" and got[5].label != "und"
    assert langid.identify_language(docs.where("false"), net).collect() == []
    clash = langid.identify_language(docs.select("*", F.lit(1).alias("language"), F.lit(2).alias("c0")), net).where("doc_id = 4").first()
    assert clash.language.label == "aa" and clash["c0"] == 2


def test_every_position_is_labelled(spark, net):
    docs = spark.createDataFrame([(1, "tion the ing " * 100 + "ción que mente los " * 100), (2, "")], "doc_id bigint, text string")
    runs = {r.doc_id: r.language.runs for r in langid.identify_language(docs, net, runs=True).collect()}
    spans = [(s.start, s.end) for s in runs[1]]
    assert spans[0][0] == 0 and spans[-1][1] == len(("tion the ing " * 100 + "ción que mente los " * 100).encode())
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and runs[2] == []
    assert runs[1][0].label == "aa" and runs[1][-1].label == "cc"


def test_windows_do_not_change_probabilities_much(net):
    raw = np.frombuffer(("tion the ing with " * 90).encode(), np.uint8)
    whole = [p.sum(1) for *_, p in langid.label_positions(net, raw, np.array([0]), np.array([len(raw)]), window=4096)]
    cut = sum(p.sum((1, 2)) for *_, p in langid.label_positions(net, raw, np.array([0]), np.array([len(raw)]), window=100))
    assert np.allclose(whole[0][:, 0] / len(raw), cut / len(raw), atol=0.02)


def test_training_separates_two_alphabets():
    rng = random.Random(3)
    windows = ["".join(rng.choices("ab", k=30)).encode() for _ in range(20)] + ["".join(rng.choices("yz", k=30)).encode() for _ in range(20)]
    net = langid.train(windows, np.array([0] * 20 + [1] * 20), ["p", "q"], hidden=4, steps=60, batch=20, span=20)
    for text, label in ((b"abab" * 10, 0), (b"zyzy" * 10, 1)):
        raw = np.frombuffer(text, np.uint8)
        p = sum(q.sum((1, 2)) for *_, q in langid.label_positions(net, raw, np.array([0]), np.array([len(raw)])))
        assert p.argmax() == label


def plain_probabilities(net, raw):
    """Label probabilities of every byte of one text, gate by gate and byte by byte."""
    clip = lambda v, a, b: np.minimum(np.maximum(v, a), b)

    def run(d, line):
        h, out = np.zeros(net.U.shape[2]), []
        for c in line:
            r = clip(net.E[d, 0, c] + h @ net.U[d, 0], 0, 1)
            z = clip(net.E[d, 1, c] + h @ net.U[d, 1], 0, 1)
            n = clip(net.E[d, 2, c] + r * (h @ net.U[d, 2]), -1, 1)
            h = z * h + (1 - z) * n
            out.append(h)
        return np.array(out)

    logits = run(0, raw) @ net.W[0] + run(1, raw[::-1])[::-1] @ net.W[1] + net.b
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_forward_pass_equals_brute_force(net):
    texts = ["tion the ing with".encode(), "über keit ción".encode(), b"x", ("los mente " * 30).encode()]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    got = np.zeros((len(texts), len(net.labels)))
    for text, _, _, p in langid.label_positions(net, raw, np.cumsum(lengths) - lengths, lengths):
        np.add.at(got, text, p.sum(1).T)
    for i, t in enumerate(texts):
        assert np.allclose(got[i] / len(t), plain_probabilities(net, np.frombuffer(t, np.uint8)).mean(0), atol=1e-4)


def test_every_label_is_learnt_and_the_sample_is_bounded(spark):
    alphabets = {f"l{i:02d}": chr(0x100 + 4 * i) + chr(0x101 + 4 * i) for i in range(70)}
    docs = spark.createDataFrame([(k, (c + " ") * 30, k) for k, c in alphabets.items()] + [(f"x{i}", f"ab {i}", "l00") for i in range(900)], "doc_id string, text string, lang string")
    texts, names = langid.training_sample(docs, F.lit(True), "text", "lang", 200, 700, 5)
    assert set(names) == set(alphabets) and len(texts) <= 2 * 10 * 70 and names.count("l00") < 60
    assert langid.fit(docs, F.lit(True), bound=700, steps=2).labels == sorted(alphabets)


def test_nothing_learnt_gives_und(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    net = langid.fit(docs, F.lit(True))
    assert langid.identify_language(docs, net).first().language.label == "und"


def test_held_out_accuracy_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    held = crc_bucket("doc_id", 4) == 2
    net = langid.fit(docs, ~held, per_label=100, steps=150)
    got = langid.identify_language(docs.where(held), net, keep=("lang",)).where("language.label <> 'und'").collect()
    assert np.mean([r.language.label == r.lang for r in got]) > 0.95
