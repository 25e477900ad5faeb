import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import retrieval as R
from wardline.operators.inverted import Index
from wardline.operators.vectors import VectorIndex, recall

WORDS = [f"w{i}" for i in range(40)] + ["été", "the", "The"]
ASKED = [(1, "the w3 w3"), (2, "w7 été nothing"), (3, "absent"), (4, ""), (5, " ".join(WORDS))]


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, None if i == 4 else " ".join(rng.choice(WORDS[: rng.randint(1, 43)]) for _ in range(rng.choice([0, 3, 20, 300])))) for i in range(n)]


def plain(rows, asked, k1=1.5, b=0.75):
    """BM25 by loops."""
    import re

    docs = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    mean = max(sum(map(len, docs.values())) / max(len(docs), 1), 1.0)
    out = {}
    for q, text in asked:
        for w in re.findall(r"\w+", text.lower()):
            df = sum(w in d for d in docs.values())
            idf = max(0.0, (len(docs) - df + 0.5) / (df + 0.5))
            for i, d in docs.items():
                if tf := d.count(w):
                    out[q, i] = out.get((q, i), 0.0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
    return out


def same(got, want):
    assert set(got) == set(want) and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Built, then some replaced, some added, some taken out, and one that was taken out comes again."""
    made = Index(spark, f"{tmp_path_factory.mktemp('index')}/i", parts=4)
    now = dict(texts(1, 150))
    made.upsert(frame(spark, list(now.items()) + [(7, "zzz repeated row")]))
    now[7] = min(now[7], "zzz repeated row")
    changes = {i: t for i, t in texts(2, 200) if i % 7 == 0 or i >= 150}
    made.upsert(frame(spark, [*changes.items(), (None, "no id")]))
    now |= changes
    made.delete(frame(spark, [(i, "") for i in [10, 11, 160, 9999]]))
    for i in (10, 11, 160):
        del now[i]
    made.upsert(frame(spark, [(11, "the w3 again")]))
    now[11] = "the w3 again"
    return made, now


def test_scores_equal_loops_after_changes(spark, index):
    made, now = index
    same({(r.query_id, r.doc_id): r.score for r in made.search(ASKED, k=None).collect()}, plain(now.items(), ASKED))
    docs = frame(spark, list(now.items()))
    same({(r.query_id, r.doc_id): r.score for r in R.keyword_scores(docs, [(q, t) for q, t in ASKED if q != 1]).collect()}, plain(now.items(), ASKED[1:]))


@pytest.mark.parametrize("k", [1, 5, 60, 1000])
def test_early_stop_finds_the_same_best(index, k):
    made, now = index
    want = {}
    for (q, i), s in plain(now.items(), ASKED).items():
        want.setdefault(q, []).append((-round(s, 9), i))
    got = {}
    for r in made.search(ASKED, k=k).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    assert set(got) == set(want)
    for q in want:
        assert [s for s, _ in sorted(got[q])] == [s for s, _ in sorted(want[q])[:k]]


def test_early_stop_leaves_blocks_out(spark, tmp_path, monkeypatch):
    import wardline.operators.inverted as V

    monkeypatch.setattr(V, "IN_BLOCK", 16)
    rows = [(i, "common " * (1 + i % 50) + "filler " * (400 if i % 50 < 45 else 1)) for i in range(2000)] + [(5000 + i, f"other text {i}") for i in range(3000)]
    made = Index(spark, f"{tmp_path}/i", parts=4)
    made.upsert(frame(spark, rows))
    made.search([(1, "common")], k=5).collect()
    every = made.postings(["common"]).select("block").distinct().count()
    assert made.useful_blocks.count() <= every / 2


def test_only_the_asked_terms_are_read(index):
    made, _ = index
    plan = made.postings(["w3"])._jdf.queryExecution().executedPlan().toString()
    part = made.spark.range(1).select(made._part(F.lit("w3"))).first()[0]
    assert f"part#" in plan and f"= {part})" in plan.replace("IN (", "= ") or f"IN ({part})" in plan or f"= {part}" in plan
    assert "PushedFilters: [" in plan and "EqualTo(term,w3)" in plan


def test_unfinished_writes_are_not_seen_and_compaction_keeps_scores(spark, tmp_path):
    made = Index(spark, f"{tmp_path}/i", parts=2)
    assert made.search(ASKED).collect() == []
    rows = texts(5, 60)
    made.upsert(frame(spark, rows))
    made.upsert(frame(spark, rows[:20]))
    before = {(r.query_id, r.doc_id): r.score for r in made.search(ASKED, k=None).collect()}
    for name in ("postings", "frequencies"):  # what a write that failed before its facts leaves behind
        spark.read.parquet(f"{tmp_path}/i/{name}/gen=0").write.partitionBy("part").parquet(f"{tmp_path}/i/{name}/gen=2")
    same({(r.query_id, r.doc_id): r.score for r in made.search(ASKED, k=None).collect()}, before)
    made.compact()
    same({(r.query_id, r.doc_id): r.score for r in made.search(ASKED, k=None).collect()}, before)


def test_a_row_a_term_and_block_and_no_shuffle_of_texts(spark, tmp_path, monkeypatch):
    import re
    from collections import Counter

    import wardline.operators.inverted as V

    monkeypatch.setattr(V, "IN_BLOCK", 16)
    rows = [(i, t) for i, t in texts(8, 3000) if t]
    docs = frame(spark, rows).localCheckpoint()
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    Index(spark, f"{tmp_path}/i", parts=4).upsert(docs)
    assert shuffled() - before < sum(len(t) for _, t in rows) / 10
    counts = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in rows}
    stored, seen = spark.read.parquet(f"{tmp_path}/i/postings").collect(), {}
    for r in stored:
        assert len(r.ids) == r.df <= 16 and r.tf == max(r.tfs) and r.length == min(r.lengths)
        for i, tf, length in zip(r.ids, r.tfs, r.lengths):
            assert length == sum(counts[i].values())
            seen[i, r.term] = tf
    assert seen == {(i, w): n for i, c in counts.items() for w, n in c.items()} and sum(len(r.ids) for r in stored) == len(seen)
    assert len({(r.term, r.block) for r in stored}) == len(stored)


@pytest.mark.parametrize("few", [0, 10])
def test_of_repeated_ids_the_least_text_stays(spark, tmp_path, monkeypatch, few):
    import wardline.operators.inverted as V

    monkeypatch.setattr(V, "FEW", few)
    made = Index(spark, f"{tmp_path}/i", parts=2)
    made.upsert(frame(spark, [(1, "b b"), (1, "a"), (2, "b"), (3, None), (3, "c")]))
    assert sorted((r.id, r.term, r.tf) for r in made.postings(["a", "b", "c"]).collect()) == [(1, "a", 1), (2, "b", 1)]


def test_blocks_end_after_many_words():
    import pyarrow as pa

    import wardline.operators.inverted as V

    from unittest import mock

    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 3)):
        given = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["b", "a", "b"], [], ["c"] * 9, ["a"]])], ["id", "t"])
        out = [x for b in V._counted(2, 256, 4)(iter([given])) for x in b.to_pylist()]
    base = (2 << 40) + (3 << 20)
    assert [(x["id"], x["length"], x["block"] - base, [(p["term"], p["tf"]) for p in x["t"]]) for x in out] == [
        (2, 0, 0, []), (4, 1, 0, [("a", 1)]), (1, 3, 0, [("a", 1), ("b", 2)]), (3, 9, 1, [("c", 9)])]


def vectors(seed, n, groups=12):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(groups)]
    rows = [(i, [m + rng.gauss(0, 0.35) for m in rng.choice(middles)]) for i in range(n)]
    return rows + [(100_000 + i, middles[0]) for i in range(n // 3)] + [(200_000, None), (200_001, [0.0] * 16)]


def test_vector_recall_and_exact_search(spark, tmp_path, monkeypatch):
    import numpy as np

    import wardline.operators.vectors as V

    monkeypatch.setattr(V, "BLOCK", 200)  # the hot cell, a third of all vectors, is several blocks
    rows = vectors(1, 3000)
    frame = spark.createDataFrame(rows, "doc_id int, v array<float>").repartition(4)
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(frame)
    asked = frame.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v")
    exact = index.search(asked, 10, exact=True, own=False).cache()
    some = [r for r in rows if r[1] is not None]
    x = np.array([v for _, v in some], np.float32).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    ids = np.array([i for i, _ in some])
    got = {}
    for r in exact.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for j in range(0, len(some)):
        if ids[j] % 20 == 0:
            scores = np.round(x @ x[j], 9)
            scores[j] = -np.inf
            best = sorted(zip(-scores, ids))[:10]
            assert [-s for s, _ in best] == pytest.approx([s for _, _, s in sorted(got[ids[j]])], abs=1e-8)
    near = index.search(asked, 10, own=False).cache()
    # Copies tie, so what is found counts if it is as good as the last of the exact ones.
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"))
    assert near.join(last, "query_id").where("score >= least - 1e-9").count() >= 0.9 * exact.count()


def test_recall_on_the_table(spark, tmp_path):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(frame)
    asked = frame.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v")
    exact = index.search(asked, 10, exact=True, own=False).cache()
    assert exact.count() == 10 * asked.count() and recall(index.search(asked, 10, own=False), exact) >= 0.9


def test_a_query_goes_to_a_block_once(spark, tmp_path, monkeypatch):
    """Probed cells that share a block are one row of a query, and its results are those of the probed cells alone."""
    import numpy as np
    import pandas as pd

    import wardline.operators.vectors as V

    monkeypatch.setattr(V, "SCORES", 500)
    rows = [r for r in vectors(3, 900) if r[1] is not None]
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(spark.createDataFrame(rows, "doc_id int, v array<double>").repartition(2), cells=30)
    assert V._packed({0: 5, 1: 30, 2: 4, 3: 4, 4: 3}, 10) == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 4, 1), (4, 5, 1)]
    given = pd.DataFrame({"query_id": [i for i, _ in rows[:300]], "v": [v for _, v in rows[:300]]})
    counts = {r.cell: r["count"] for r in spark.read.parquet(f"{tmp_path}/v/vectors").groupBy("cell").count().collect()}
    sent = pd.concat(index._sender(V._packed(counts, 300), 20)(iter([given])))
    assert not sent.duplicated(["query_id", "block"]).any() and len(sent) <= 300 * (1 + max(first + parts for _, first, parts in V._packed(counts, 300)))
    asked = spark.createDataFrame(given)
    got = {}
    for r in index.search(asked, 5, probes=4, own=False).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    cell = {r.id: r.cell for r in spark.read.parquet(f"{tmp_path}/v/vectors").select("id", "cell").collect()}
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    near = {r.query_id: r.cells for b in index._placer(4)(iter([given])) for r in b.itertuples()}
    for i, v in rows[:300]:
        want = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, w in rows if j != i and cell[j] in near[i])[:5]
        assert [-s for s, _ in want] == pytest.approx([s for _, _, s in sorted(got[i])], abs=1e-8)


def test_best_scores_with_ties():
    import numpy as np

    from wardline.operators.vectors import _best

    scores = np.array([[1.0, 2.0, 2.0, 2.0], [-np.inf, -np.inf, 3.0, 3.0], [0.0] * 4, [-np.inf] * 4])
    row, column = _best(scores, 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert len(_best(scores, 9)[0]) == 10


def test_no_vectors(spark, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(spark.createDataFrame([(1, None)], "doc_id int, v array<float>"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id int, v array<float>"), exact=True).collect() == []
