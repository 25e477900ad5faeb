import math

import pytest
from pyspark.sql import functions as F

from wardline.operators import evidence as E
from wardline.operators import validation as V

TEXTS = [
    (1, "a", "The prevalence of diabetes was 31.5 % and prevalence hypertension 0%. Average age of 61 years."),
    (2, "b", "12% of patients had renal failure; 40 % patients with Diabetes; sepsis was present in 7.5%"),
    (3, "b", "Mean age was 55.5 years, mean age 60. Anemia in 30%. 100% of patients had cancer"),
    (4, "c", None), (5, "c", ""), (1, "a", "prevalence of car was 5%"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, source string, content string")


def test_statistics_of_texts(docs):
    got = sorted((r.doc_id, r.condition, round(r.rate, 6)) for r in E.prevalences(docs).collect())
    assert got == [(1, "CARDIOVASCULAR", 0.05), (1, "DIABETES", 0.315), (2, "DIABETES", 0.4), (2, "RENAL", 0.12), (2, "SEPSIS", 0.075)]
    assert sorted(r.age for r in E.mean_ages(docs).collect()) == [55.5, 60.0, 61.0]


def test_merging_and_comparing(spark, docs):
    got = {r.condition: r for r in E.merged(E.prevalences(docs)).collect()}
    assert math.isclose(got["DIABETES"].rate, (0.25 + (0.315 + 0.4) / 2) / 2) and math.isclose(got["DIABETES"].low, 0.8 * 0.25) and got["DIABETES"].sources == 2
    assert (got["CANCER"].rate, got["CANCER"].low, got["CANCER"].n) == (0.10, 0.08, 0) and set(got) == set(V.PREVALENCE)
    only = E.merged(spark.createDataFrame([("GOUT", 0.2, "x")], "condition string, rate double, source string")).where("condition = 'GOUT'").first()
    assert math.isclose(only.low, 0.14) and math.isclose(only.high, 0.26)
    rows = spark.createDataFrame([(["DIABETES", "DIABETES"],), (["RENAL"],), ([],), (["CANCER"],)], "diagnoses array<string>")
    seen = {r.condition: r for r in E.compared(rows, E.merged(E.prevalences(docs))).collect()}
    assert seen["DIABETES"].observed == 0.25 and seen["SEPSIS"].observed == 0 and seen["DIABETES"].within and not seen["CANCER"].within
    flags = spark.createDataFrame([("critical",), ("high",), ("low",)], "severity string")
    base = E.literature_confidence(E.compared(rows, E.merged(E.prevalences(docs)))).first().confidence
    assert 0.8 <= base <= 0.95 + 1e-9 and math.isclose(E.literature_confidence(E.compared(rows, E.merged(E.prevalences(docs))), flags).first().confidence, base - 0.17)


def test_six_checks(spark, docs):
    rows = spark.createDataFrame(
        [(70, "f", ["DIABETES", "RENAL"], 1954, 90.0), (30, "m", ["SEPSIS"], 1980, 700.0), (50, "x", ["CANCER", "DIABETES"], None, None), (60, None, [], 1964, 100.0)], "age int, gender string, diagnoses array<string>, birth_year int, glucose double")
    got = {r.check: (r.passed, round(r.confidence, 6)) for r in E.cross_checks(rows, docs, (40, 80)).collect()}
    # the texts support diabetes, renal, sepsis, hypertension and cancer; diabetes comes with renal once, renal with diabetes, cancer has no list
    assert got["conditions"] == (True, round(4 / 5, 6)) and got["ages"] == (False, 0.75) and got["values"] == (False, round(2 / 3, 6))
    assert got["comorbidity"] == (True, round(2 / 3, 6)) and got["coverage"] == (True, 1.0) and got["consistency"] == (False, 0.5)
    report = E.cross_report(E.cross_checks(rows, docs, (40, 80))).first()
    assert report.passed == 3 and report.checks == 6 and report.recommendations == ["review the data for inconsistencies"]


def test_without_texts_or_rows(spark, docs):
    rows = spark.createDataFrame([(30, "f", ["DIABETES"])], "age int, gender string, diagnoses array<string>")
    got = {r.check: (r.passed, r.confidence) for r in E.cross_checks(rows, docs.where("false")).collect()}
    assert got["conditions"] == (False, 0.3) and got["coverage"] == (False, 0.0) and got["values"] == (True, 0.5) and got["ages"] == (True, 0.8) and got["comorbidity"] == (True, 0.6)
    assert "no reference documents" in E.cross_report(E.cross_checks(rows, docs.where("false"))).first().recommendations
    assert len(E.cross_checks(rows.where("false"), docs).collect()) == 6
    assert E.merged(E.prevalences(docs.where("false"))).agg(F.max("n")).first()[0] == 0


def test_alignment_with_what_texts_state(spark, docs):
    rows = spark.createDataFrame([(80, ["DIABETES"]), (90, ["DIABETES"]), (85, []), (85, ["HYPERTENSION"])], "age int, diagnoses array<string>")
    got = {r.what: r for r in E.literature_alignment(rows, docs).collect()}
    # "40 % patients with Diabetes" and "12% of patients had renal failure": only diabetes is known to this check
    assert set(got) == {"DIABETES", "age"} and got["DIABETES"].expected == 0.4 and got["DIABETES"].score == 1 and got["age"].score == 0.4 and got["age"].severity == "warning"
    assert E.literature_alignment(rows, docs.where("false")).collect() == []


def test_assessment(spark):
    checks = spark.createDataFrame([("ranges", 0.5, 1.5, False, 0, 1, 4), ("comorbidity", 1.0, 1.2, True, 0, 0, 0), ("literature", 0.3, 1.5, False, 3, 0, 3)], "check string, score double, weight double, passed boolean, errors int, critical int, issues long")
    got = E.assessment(checks, 100).first()
    assert math.isclose(got.score, (0.75 + 1.2 + 0.45) / 4.2) and not got.valid and math.isclose(got.confidence, 0.6 * 0.8 + 0.15) and got.errors == 3
    assert got.recommendations == ["review the generation of clinical values", "verify the source data against the literature", "improve: literature, ranges"]


def test_plausibility_currency_and_consistency(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.gauss(0, 1), 1000.0 if i == 0 else float(i % 2), 5.0, float(i) if i % 3 == 0 else 7.0, "2020-01-01" if i < 30 else "1990-01-01", i % 2, 3 if i == 4 else 1, 200 if i < 10 else 40) for i in range(100)], "x double, y double, z double, m double, d string, has_a int, is_b int, age int")
    got = {r.column: r for r in E.plausibility(rows, ["x", "y", "z", "m"]).collect()}
    assert got["x"].score == 1 and got["y"].score == 0.7 and got["z"].score == 1 and got["m"].score == 0.75 and got["m"].kinds == 35
    assert E.plausibility(rows.limit(5), ["x"]).collect() == []
    assert math.isclose(E.currency(rows, ["d"], 2024).first().currency, 0.3) and math.isclose(E.currency(rows, ["d"], 2019).first().currency, (0.3 + 0.5) / 2)
    assert E.currency(rows, [], 2024).first().currency == 0.8
    assert math.isclose(E.logical_consistency(rows).first().consistency, 1 - (10 + 1) / 300)
    assert E.logical_consistency(rows.select("x")).first().consistency == 0.8
