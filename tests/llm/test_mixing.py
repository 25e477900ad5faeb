import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight; sources over their cap stop there, and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, rest, free = {}, share * sum(sizes.values()), set(names)
    while True:
        total = sum(w[n] for n in free)
        over = [n for n in free if rest * w[n] / total >= cap * sizes[n]]
        if not over:
            return out | {n: rest * w[n] / total for n in free}
        for n in over:
            out[n] = cap * sizes[n]
            free.discard(n)
        rest = share * sum(sizes.values()) - sum(out.values())
        if not free:
            return out


def rows_of(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "Z", None]), " ".join(["w"] * rng.randint(0, 60))) for i in range(n)]
    return rows + [(None, "b", "x y z"), (None, "b", "x y z"), (7, "b", None), (8, "tiny", "one"), (9, "empty", ""), (10, "a", "very long " * 5000)]


def check(spark, rows):
    frame = spark.createDataFrame([(i, s, t, 0) for i, s, t in rows], "doc_id bigint, source string, text string, size int").repartition(3)
    got = mixing.mix_sources(frame, keep=("source",)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(((i, s, size(t)) for i, s, t in rows), key=str)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6 * want[s]
    assert all((r.slot is None) == (r.taken == 0) for r in got)
    return sorted(((r.doc_id, r.source, r["size"], r.taken) for r in got), key=str)


def test_targets_and_taken_words(spark):
    first = check(spark, rows_of(1))
    assert first == check(spark, rows_of(1))  # reruns agree


def test_a_hot_source_and_few_rows(spark):
    check(spark, [(i, "hot" if i % 3 else f"s{i}", "w " * (i % 9)) for i in range(300)])
    check(spark, [(1, "only", "a b c")])
    check(spark, [(1, "only", None)])


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id bigint, source string, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 500), min_size=1, max_size=9))
def test_water_filling_sums_to_the_share(sizes):
    want = brute_targets(sizes)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9, abs_tol=1e-9)


def test_schedule_is_balanced_at_every_prefix(spark):
    sizes = spark.createDataFrame([("a", 10, 1000), ("b", 10, 4000), ("c", 5, 800)], "source string, n bigint, source_size bigint")
    targets = mixing.source_targets(sizes, (3, 1, 2), 1.5, 2)
    slots = mixing.schedule(targets, 2000, 3).orderBy("slot").collect()
    share = {r.idx: r.target / (1.5 * 5800) for r in targets.collect()}
    assert [r.slot for r in slots] == list(range(2000))
    seen = dict.fromkeys(share, 0)
    for k, r in enumerate(slots, 1):
        assert r["rank"] == seen[r.idx]
        seen[r.idx] += 1
        assert all(abs(seen[i] - k * share[i]) < 2 + math.log2(k + 1) for i in share)


def test_small_sources_beside_large_ones_reach_their_targets(spark):
    rows = [(i, f"small{i % 6}", "w " * (1 + i % 6)) for i in range(24)] + [(100 + i, "large", "word " * 4000) for i in range(500)]
    check(spark, rows)


def test_documents_by_slot_are_the_mix_at_any_length(spark):
    rows = [(i, "abc"[i % 3], "w " * (5 + i % 7)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((r for r in mixing.mix_sources(frame, keep=("source", "size", "text")).collect() if r.slot is not None), key=lambda r: r.slot)
    targets = {r.source: r.target for r in got}
    for part in (300, 1000, 2000):
        words = {s: sum(min(r["size"], r.taken) for r in got[:part] if r.source == s) for s in "abc"}
        for s in "abc":
            assert abs(words[s] / sum(words.values()) - targets[s] / sum(targets.values())) < 0.03


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a", "x y", 5, 6)], "doc_id bigint, source string, text string, SIZE int, other int")
    got = mixing.mix_sources(frame, keep=("SIZE", "other")).collect()
    assert got[0].asDict() == {"doc_id": 1, "other": 6, "size": 2, "source_size": 2, "target": 3.0, "taken": 3, "slot": 0}
