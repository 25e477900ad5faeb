import random

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import quality
from wardline.llm.common import crc_bucket, table


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = crc_bucket("doc_id", 3) == 1
    net = quality.fit(docs, labels, ~held)
    got = quality.score_quality(docs.join(labels.where(held), "doc_id").select("doc_id", "text", "quality"), net, keep=("quality",)).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in got]) > 0.93


def test_junk_late_in_a_long_text_counts_and_cases_are_defined(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=80)) for _ in range(60)]
    bad = [g.replace(" ", "### ") for g in good]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id bigint, quality int")
    net = quality.fit(docs, labels, F.lit(True))
    rows = [(1, good[0] * 40), (2, bad[0] * 40), (3, None), (4, ""), (5, good[0]), (5, good[0])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    got = {r.doc_id: r.quality_score for r in quality.score_quality(frame, net).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.score_quality(frame.where("false"), net).collect() == []
    clash = quality.score_quality(frame.select("*", F.lit(1).alias("quality_score"), F.lit(2).alias("c0")), net).where("doc_id = 1").first()
    assert abs(clash.quality_score - got[1]) < 1e-9 and clash["c0"] == 2


def plain_score(net, text):
    """One text's score by loops over its chunks, places and bytes."""
    raw = (text or "").encode()
    starts = [0] + [s for s in range(quality.STEP, len(raw), quality.STEP) if s < len(raw) - (quality.CHUNK - quality.STEP)]
    vectors = []
    for a in starts:
        x = list(raw[a : a + quality.CHUNK]) + [quality.PAD] * quality.CHUNK
        spots = [sum(net.tables[j][x[i + j]].astype(float) for j in range(quality.WIDTH)) for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        vectors.append(np.maximum(np.max(spots, axis=0), 0))
    pooled = np.concatenate([np.mean(vectors, axis=0), np.max(vectors, axis=0), np.min(vectors, axis=0)])
    return 1 / (1 + np.exp(-np.clip(pooled @ net.w.astype(float) + net.b, -30, 30)))


def test_scores_equal_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = quality.fit(docs, labels, F.lit(True), bound=60)
    texts = [r.text for r in docs.select("text").limit(12).collect()] + [None, "", "x" * 255, "y" * 256, "ü" * 300, "z" * 481]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for r in quality.score_quality(frame, net, keep=("doc_id",)).collect():
        assert abs(r.quality_score - plain_score(net, texts[r.doc_id])) < 1e-4


def test_chunks_cover_the_text_and_overlap():
    lengths = np.array([0, 1, 255, 256, 257, 480, 481, 5000])
    doc, at, size = quality.cut_chunks(np.zeros(6000, np.uint8), np.zeros(8, np.int64), lengths)
    for i, n in enumerate(lengths):
        spans = [(a, a + s) for d, a, s in zip(doc, at, size) if d == i]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_one_class_and_no_labels():
    net = quality.train([b"abc", b"def"], np.array([1.0, 1.0]))
    assert net.b > 0
    assert quality.train([], np.zeros(0)).tables.shape[0] == quality.WIDTH


def test_the_bound_holds_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(3, f"copy {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1)] * 50, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y: seen.append((texts, y)))
    quality.fit(docs, labels, F.lit(True), bound=10)
    quality.fit(docs, labels.where("doc_id = 3"), F.lit(True), bound=10)
    assert len(seen[0][0]) == len(seen[0][1]) <= 10 and len(seen[1][0]) == 1
