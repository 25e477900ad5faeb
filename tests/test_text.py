import re

from pyspark.sql import functions as F

from wardline.functions import text as X


def test_cleaning(spark):
    cases = {"<p>A&amp;B <script>x<y</script>see https://x.y/z</p>": "AB see", "mail me@x.org now": "mail now", "a  ,b ;c": "a, b; c", "x ★ y": "x  y", "": ""}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", X.clean_text(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == cases


def test_hash_ignores_case_and_space(spark):
    rows = spark.createDataFrame([("A  b\n",), ("a b",), (" A B",)], "t string").select(X.content_hash(F.col("t")).alias("h")).distinct()
    assert rows.count() == 1


def test_entities(spark):
    t = "Lisinopril and aspirin; MRI and dialysis. BMI: 27.5, 5 mg. Diabetic with heart failure"
    r = spark.createDataFrame([(t,)], "t string").select(X.drugs(F.col("t")).alias("d"), X.procedures(F.col("t")).alias("p"), X.diseases(F.col("t")).alias("c"), X.measurements(F.col("t")).alias("m")).first()
    assert r.d == ["aspirin", "lisinopril"] and r.p == ["dialysis", "mri"] and r.c == ["diabetes", "cardiovascular", "renal"] and sorted(r.m) == [5.0, 27.5]


def test_chunks(spark):
    t = "One two. Three four! Five six? " * 20
    r = spark.createDataFrame([(t,)], "t string").select(X.stride_chunks(F.col("t"), 100, 20).alias("s")).first()
    assert r.s[0] == t[:100] and all(a[-20:] == b[:20] for a, b in zip(r.s, r.s[1:])) and "".join([r.s[0]] + [c[20:] for c in r.s[1:]]) == t


def test_snapping_ends():
    assert X.snapped("", 10, 2) == [] and X.snapped("abc", 10, 2) == ["abc"]
    assert X.snapped("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9]


def test_highlights(spark):
    t = " ".join(f"w{i}" for i in range(40)).replace("w20", "Stroke,")
    got = spark.createDataFrame([(t,)], "t string").select(X.highlights(F.col("t"), F.array(F.lit("stroke")), 3).alias("h")).first().h
    assert got == ["w17 w18 w19 Stroke, w21 w22 w23"]


def test_highlights_are_of_different_words(spark):
    t = "stroke a stroke b stroke c insulin d stroke"
    got = spark.createDataFrame([(t,)], "t string").select(X.highlights(F.col("t"), F.array(F.lit("stroke"), F.lit("insulin")), 1).alias("h")).first().h
    assert got == ["stroke a", "c insulin d"]
