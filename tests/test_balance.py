import hashlib
import random

from wardline.functions import fixed
from wardline.operators import balance as B

NAMES = ["DIABETES", "HYPERTENSION", "RENAL", "CARDIOVASCULAR", "SEPSIS", "OTHER"]


def people(seed, n):
    rng = random.Random(seed)
    return [(i, rng.sample(NAMES[:5], rng.choice([1, 1, 2, 2, 3, 4])) if rng.random() < 0.9 else rng.choice([[], ["OTHER"]])) for i in range(n)]


def test_quotas_sum_to_the_size():
    for size in (1, 7, 100, 333, 5000):
        got = B.quotas(size)
        assert sum(got.values()) == size and all(abs(got["+".join(sorted(k))] - v * size) < 1 for k, v in fixed.TARGET_MIX.items())


def test_supersets_fill_what_exact_matches_lack():
    got = B.assignment({"A": 5, "A+B": 10, "A+B+C": 4, "D": 9}, {"A": 8, "A+B": 6, "C": 9, "E": 3})
    per = {}
    for c, t, a, b in got:
        per[c, t] = b - a
    assert per == {("A", "A"): 5, ("A+B", "A+B"): 6, ("A+B", "A"): 3, ("A+B+C", "C"): 4}
    for c, n in {"A": 5, "A+B": 10, "A+B+C": 4}.items():
        spans = sorted((a, b) for x, _, a, b in got if x == c)
        assert all(y[0] == x[1] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= n


def brute(rows, size, seed="balance"):
    """The same sample by lists: (id, target)."""
    digest = lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i)
    groups = {}
    for i, dx in rows:
        groups.setdefault("+".join(sorted(dx)) if dx else "OTHER", []).append(i)
    for ids in groups.values():
        ids.sort(key=digest)
    out = {}
    for c, t, a, b in B.assignment({c: len(ids) for c, ids in groups.items()}, B.quotas(size)):
        out |= {i: t for i in groups[c][a:b]}
    for i in sorted((i for i, _ in rows if i not in out), key=digest)[: size - len(out)]:
        out[i] = "fill"
    return out


def test_samples_equal_lists(spark):
    for n, size in ((400, 150), (1000, 999), (60, 7)):
        rows = people(n, n)
        frame = spark.createDataFrame(rows, "patient_id int, diagnoses array<string>").repartition(4)
        got = B.balance(frame, size).collect()
        assert {r.patient_id: r.target for r in got} == brute(rows, size) and len(got) == size


def test_too_few_rows_repeat(spark):
    frame = spark.createDataFrame(people(1, 30), "patient_id int, diagnoses array<string>")
    got = B.balance(frame, 100).collect()
    assert len(got) == 100 and {r.patient_id for r in got} == set(range(30)) and max(r.replica for r in got) == 3
    assert B.balance(frame, 30).count() == 30 and B.balance(frame, 0).count() == 0 and B.balance(frame.where("false"), 10).count() == 0


def test_null_and_empty_diagnoses_are_other(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else []) for i in range(50)], "patient_id int, diagnoses array<string>")
    got = B.balance(frame, 20).collect()
    assert len({r.patient_id for r in got}) == 20 and {r.target for r in got} == {"OTHER", "fill"}
