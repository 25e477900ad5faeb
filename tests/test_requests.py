import re

from pyspark.sql import functions as F

from wardline.plans import nl


def test_filters_of_requests(spark):
    rows = spark.createDataFrame([(1, "Generate 20 elderly female patients with diabetes and sepsis in icu who survived, high-risk"), (2, "anything"), (3, None)], "i int, q string").select("i", nl.parsed(F.col("q")).alias("p"))
    got = {r.i: r for r in rows.select("i", nl.suggested_filters(F.col("p")).alias("f"), nl.recognised(F.col("p")).alias("c"), nl.is_complex(F.col("p")).alias("x")).collect()}
    assert got[1].f == ["Diagnosis: DIABETES", "Diagnosis: SEPSIS", "Age: 65-100", "Gender: f", "ICU Stay: Required", "Mortality: No", "Risk Level: high"] and got[1].c == 1 and got[1].x
    assert got[2].f == [] and got[2].c == 1 / 7 and not got[2].x


def test_filters_from_documents(spark):
    docs = spark.createDataFrame([
        ("a", 2, "Elderly cohort with renal failure, mortality and risk"), ("a", 1, "No ages here; sepsis"), ("a", 3, "aged 30 to 50, diabetes"), ("b", 1, "patients aged 40 with cancer in the ICU"), ("b", 2, None), ("c", 1, None), ("d", 1, "pediatric trauma")], "q string, doc_id int, content string")
    got = {r.q: tuple(r)[1:] for r in nl.from_documents(docs, "q").collect()}
    assert got["a"] == (["DIABETES", "RENAL", "SEPSIS"], 65, 100, ["mortality", "risk"]) and got["b"] == (["CANCER"], 40, 50, ["icu"])
    assert got["c"] == ([], None, None, []) and got["d"] == (["TRAUMA"], 0, 18, [])


def test_the_best_chains_go_on(spark):
    from wardline.operators import retrieval as R

    links = [("a", f"n{i}", i / 10) for i in range(8)] + [(f"n{i}", f"m{j}", 0.1 * j) for i in range(8) for j in range(4)] + [("n7", "a", 1.0)]
    frame, start = spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame([("a",)], "topic string")
    every = {tuple(r.path): r.confidence for r in R.hops(start, frame, 2).collect()}
    assert len(every) == 8 + 32
    best = {tuple(r.path): r.confidence for r in R.hops(start, frame, 2, width=3).collect()}
    assert set(best) == {("a", "n7"), ("a", "n6"), ("a", "n5"), ("a", "n7", "m3"), ("a", "n7", "m2"), ("a", "n6", "m3")} and all(every[p] == c for p, c in best.items())


def test_enhanced_requests_are_spread_and_keep_the_first_word(spark, sf):
    from wardline.functions import fixed
    from wardline.plans import catalog

    assert catalog.queries()["enhanced_requests"](spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    texts = [" and ".join(ws) for words, _, _ in fixed.MEDICAL_TERMS.values() for ws in (words[-1:], words[-1:] + words[:3], words[2:4][::-1])] + ["diabetess", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").select("i", nl.enhanced(F.col("q")).alias("p")).collect()
    named = lambda w, t: re.search(rf"\b(?:{w})\b", t)
    for r in got:
        first = {n: next((w for w in words if named(w, texts[r.i] or "")), None) for n, (words, _, _) in fixed.MEDICAL_TERMS.items()}
        assert [(e.condition, e.confidence) for e in r.p.entities] == [(n, 0.9 if len(w) > 3 else 0.7) for n, w in first.items() if w]
