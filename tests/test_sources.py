import json

import pytest

from wardline.operators import etl
from wardline.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def extract(tmp_path):
    write(tmp_path / "PATIENTS.csv", "row_id,subject_id,gender,dob,dod\n1,10,F,1950-03-02 00:00:00,\n2,11,M,1990-01-01 00:00:00,2020-06-01 00:00:00\n3,12,M,2015-01-01 00:00:00,\n")
    write(tmp_path / "ADMISSIONS.csv", "subject_id,admittime,dischtime,admission_type,insurance,ethnicity\n10,2020-01-01 00:00:00,2020-01-04 12:00:00,EMERGENCY,Medicare,WHITE\n10,2021-01-01 00:00:00,2021-01-02 00:00:00,ELECTIVE,Odd,WHITE\n")
    write(tmp_path / "DIAGNOSES_ICD.csv", "subject_id,icd9_code\n10,038\n10,4280\n11,V30\n")
    write(tmp_path / "PROCEDURES_ICD.csv", "subject_id\n10\n10\n")
    write(tmp_path / "PRESCRIPTIONS.csv", "subject_id\n11\n")
    write(tmp_path / "ICUSTAYS.csv", "subject_id,icustay_id,intime,outtime\n10,1,2020-01-01 00:00:00,2020-01-03 00:00:00\n10,2,2021-01-01 00:00:00,2021-01-01 12:00:00\n")
    return str(tmp_path)


def test_raw_extract_to_patient_table(spark, extract):
    tables = readers.source(spark, extract, readers.ICU_EXTRACT)
    rows = {r.patient_id: r for r in etl.patient_table(readers.ExtractViews(tables), "2026-01-01").collect()}
    assert set(rows) == {10, 11}
    a, b = rows[10], rows[11]
    assert (a.age, a.diagnoses, a.hospital_los_days, a.admission_type, a.icu_los_days, a.num_procedures, a.insurance) == (75, ["CARDIOVASCULAR", "SEPSIS"], 1.0, "Elective", 2.5, 2, "Private")
    assert (b.age, b.diagnoses, b.hospital_los_days, b.admission_type, b.mortality, b.num_medications, b.insurance) == (30, ["OTHER"], 3.0, "Emergency", 1, 1, "Medicare")


def test_missing_files(spark, extract, tmp_path):
    (tmp_path / "ICUSTAYS.csv").unlink()
    assert readers.missing(spark, extract, readers.ICU_EXTRACT) == ["ICUSTAYS"]
    with pytest.raises(FileNotFoundError):
        readers.source(spark, extract, readers.ICU_EXTRACT)


def test_articles_trials_feeds_and_texts(spark, tmp_path):
    write(tmp_path / "a.xml", '<Set><Article><PMID>7</PMID><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText>two</AbstractText></Abstract><Journal><Title>J</Title><Year>2020</Year></Journal><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList></Article></Set>')
    r = readers.articles(spark, str(tmp_path / "a.xml")).first()
    assert (r.source_id, r.content, r.authors, r.year) == ("7", "AIM: one two", ["F L"], 2020)
    write(tmp_path / "t.json", json.dumps({"nctId": "N1", "title": "x", "conditions": ["c"], "interventions": [{"type": "DRUG", "name": "Metformin"}], "startDate": "March 2020", "eligibility": {"minimumAge": "18 Years", "criteria": "Inclusion Criteria:\n- adult\n* ill\nExclusion Criteria:\n- pregnant"}}))
    t = readers.trials(spark, str(tmp_path / "t.json"))
    row = t.first()
    assert (row.minimum_age, row.maximum_age, row.inclusion, row.exclusion) == (18, None, ["adult", "ill"], ["pregnant"])
    assert readers.trials_for(t, 40, "metformin").count() == 1 and readers.trials_for(t, 10).count() == 0
    write(tmp_path / "f.xml", "<rss><item><title>N</title><link>u</link><description>&lt;b&gt;bold&lt;/b&gt; text</description><pubDate>Mon, 06 Jan 2020 10:00:00 +0000</pubDate></item></rss>")
    n = readers.feed(spark, str(tmp_path / "f.xml")).first()
    assert n.content == "bold  text" and n.published.year == 2020
    write(tmp_path / "docs/x/y.md", "hello")
    write(tmp_path / "docs/z.bin", "no")
    assert [r.content for r in readers.texts(spark, str(tmp_path / "docs")).collect()] == ["hello"]
    assert readers.search_text(["Diabetes"], (65, 90), "f") == '("diabetes") AND aged AND female'


def test_collection_versions(spark, tmp_path):
    c = sinks.Collection(spark, str(tmp_path / "c"))
    assert c.read() is None
    rows = lambda *r: spark.createDataFrame(r, "id string, content string")
    assert c.upsert(rows(("a", "1"), ("b", "1"))) == 1
    assert c.upsert(rows(("b", "2"), ("c", "2"))) == 2
    assert {tuple(r) for r in c.read().collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    assert c.delete(rows(("a", "")).select("id")) == 3 and c.read().count() == 2
    assert c.get(rows(("c", "")).select("id")).first().content == "2"
    assert c.rollback(1) == 4 and {r.id for r in c.read().collect()} == {"a", "b"} and c.log().count() == 4
    with pytest.raises(LookupError):
        c.rollback(99)


def test_csv_and_json_output(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1.239, ["a", "b"], None)], "id string, x double, dx array<string>, n int")
    assert json.loads(sinks.as_records(rows).first().json) == {"id": "p", "x": 1.24, "dx": ["a", "b"], "n": None}
    sinks.save_csv(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().id == "p"
