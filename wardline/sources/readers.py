"""Readers of raw extracts and literature files; all schemas are given, none inferred.

Network services are not called: a reader takes the files that a download left in any store Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.clinical import parse_age, parse_date

#: Files of the two raw sources, with the columns that are used.
SYNTHETIC_EHR = {
    "patients": "Id string, BIRTHDATE date, DEATHDATE date, GENDER string, ETHNICITY string", "conditions": "PATIENT string, DESCRIPTION string",
    "procedures": "PATIENT string", "medications": "PATIENT string", "encounters": "PATIENT string", "observations": "PATIENT string",
}
ICU_EXTRACT = {
    "PATIENTS": "subject_id bigint, gender string, dob timestamp, dod timestamp",
    "ADMISSIONS": "subject_id bigint, admittime timestamp, dischtime timestamp, admission_type string, insurance string, ethnicity string",
    "DIAGNOSES_ICD": "subject_id bigint, icd9_code string", "PROCEDURES_ICD": "subject_id bigint", "PRESCRIPTIONS": "subject_id bigint",
    "ICUSTAYS": "subject_id bigint, icustay_id bigint, intime timestamp, outtime timestamp",
}
ARTICLES = """PMID string, ArticleTitle string, Abstract struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
  Journal struct<Title: string, Year: int>, AuthorList struct<Author: array<struct<LastName: string, ForeName: string>>>, Keyword array<string>"""
TRIALS = """nctId string, title string, status string, conditions array<string>, interventions array<struct<type: string, name: string>>,
  eligibility struct<criteria: string, minimumAge: string, maximumAge: string, gender: string>, startDate string"""
FEED = "title string, link string, description string, pubDate string"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files of a folder, through Spark's own file systems; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def missing(spark: SparkSession, folder: str, names: dict[str, str]) -> list[str]:
    """Names of the wanted CSV files that the folder doesn't have."""
    there = {r.n for r in files(spark, folder, "*.csv").select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("n")).collect()}
    return [n for n in names if n not in there]


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of a CSV file by the names of its header, whatever else it has and in any order; bad values become null."""
    text = spark.read.option("header", True).csv(path)
    by_name = {c.lower(): c for c in text.columns}
    picked = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        picked.append((F.col(f"`{by_name[name.lower()]}`").try_cast(kind) if name.lower() in by_name else F.lit(None).cast(kind)).alias(name))
    return text.select(*picked)


def source(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a raw source by lower-case name; a missing file is an error."""
    if gone := missing(spark, folder, names):
        raise FileNotFoundError(", ".join(gone))
    return {n.lower(): csv(spark, f"{folder}/{n}.csv", s) for n, s in names.items()}


class ExtractViews:
    """The views of the patient ETL over the tables of the ICU extract."""

    def __init__(self, tables: dict[str, DataFrame]):
        t = {k: v.withColumnRenamed("subject_id", "patient_id") for k, v in tables.items()}
        about = t["admissions"].groupBy("patient_id").agg(F.max_by("ethnicity", "admittime").alias("ethnicity"), F.max_by("insurance", "admittime").alias("insurance"))
        known = F.col("insurance").isin("Medicare", "Medicaid", "Private", "Government", "Self Pay")
        self.patients = t["patients"].join(about, "patient_id", "left").select(
            "patient_id", F.to_date("dob").alias("birthdate"), F.to_date("dod").alias("deathdate"), F.lower("gender").alias("gender"),
            F.coalesce("ethnicity", F.lit("Unknown")).alias("ethnicity"), F.when(F.col("insurance").isNull(), "Medicare").when(known, F.col("insurance")).otherwise("Private").alias("insurance"))
        minutes = lambda a, b: F.timestamp_diff("MINUTE", F.col(a), F.col(b)).cast("int")
        self.admissions = t["admissions"].select(F.xxhash64("patient_id", "admittime").alias("admission_id"), "patient_id", "admittime", minutes("admittime", "dischtime").alias("stay_minutes"), "admission_type")
        self.icustays = t["icustays"].select("patient_id", "icustay_id", "intime", minutes("intime", "outtime").alias("icu_minutes"))
        self.diagnoses, self.procedures, self.prescriptions = t["diagnoses_icd"], t["procedures_icd"], t["prescriptions"]


def articles(spark: SparkSession, path: str, tag: str = "Article") -> DataFrame:
    """Literature XML as documents: labelled abstract parts joined, authors, journal and year."""
    raw = spark.read.format("xml").option("rowTag", tag).schema(ARTICLES).load(path)
    label = lambda p: F.concat(F.coalesce(F.concat(p["_Label"], F.lit(": ")), F.lit("")), p["_VALUE"])
    return raw.select(
        F.lit("pubmed").alias("source"), F.col("PMID").alias("source_id"), F.col("ArticleTitle").alias("title"),
        F.array_join(F.transform("Abstract.AbstractText", label), " ").alias("content"),
        F.transform("AuthorList.Author", lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"])).alias("authors"), F.col("Journal.Title").alias("journal"),
        F.col("Journal.Year").alias("year"), F.col("Keyword").alias("keywords"))


def trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial JSON as one row a study, with ages in years and inclusion and exclusion criteria (at most ten each)."""
    raw = spark.read.schema(TRIALS).json(path)
    return raw.select(
        F.col("nctId").alias("trial_id"), "title", "status", "conditions", F.transform("interventions", lambda i: i["name"]).alias("interventions"),
        parse_age(F.col("eligibility.minimumAge")).alias("minimum_age"), parse_age(F.col("eligibility.maximumAge")).alias("maximum_age"), F.col("eligibility.gender").alias("gender"),
        criteria("eligibility.criteria", "inclusion").alias("inclusion"), criteria("eligibility.criteria", "exclusion").alias("exclusion"), parse_date(F.col("startDate")).alias("start_date"))


def criteria(column: str, which: str, most: int = 10):
    """Lines after the last heading of that name, up to the next heading, without bullets."""
    other = "exclusion" if which == "inclusion" else "inclusion"
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))

    def step(acc, line):
        low = F.lower(line)
        heading, off = low.contains(f"{which} criteria"), low.contains(f"{other} criteria")
        inside = F.when(heading, True).when(off, False).otherwise(acc["inside"])
        text = F.regexp_replace(F.trim(line), r"^[-*•\d.]+\s*", "")
        return F.struct(inside.alias("inside"), F.when(inside & ~heading & ~off & (text != ""), F.array_append(acc["lines"], text)).otherwise(acc["lines"]).alias("lines"))

    return F.slice(F.aggregate(F.split(F.coalesce(F.col(column), F.lit("")), "\n"), start, step)["lines"], 1, most)


def trials_for(trials: DataFrame, age: int | None = None, intervention: str | None = None) -> DataFrame:
    """Trials whose age bounds (0 and 150 where not given) hold an age, and that use an intervention."""
    out = trials
    if age is not None:
        out = out.where(F.lit(age).between(F.coalesce("minimum_age", F.lit(0)), F.coalesce("maximum_age", F.lit(150))))
    if intervention is not None:
        out = out.where(F.exists("interventions", lambda i: F.lower(i).contains(intervention.lower())))
    return out


def feed(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """RSS items as documents: markup removed, content cut to `most` characters, newest first by `order_by`."""
    from wardline.functions.text import without_markup

    raw = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    day = F.regexp_extract("pubDate", r"(\d+ \w+ \d{4} [\d:]+)", 1)
    zone = F.regexp_extract("pubDate", r"([+-]\d{4})$", 1)
    when = F.coalesce(F.try_to_timestamp(F.concat(day, F.lit(" "), zone), F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss")))
    return raw.select(F.lit("medical_news").alias("source"), F.col("link").alias("url"), "title", F.substring(F.trim(without_markup(F.col("description"))), 1, most).alias("content"), when.alias("published"))


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """Health indicator JSON: the latest value of each country and indicator."""
    raw = spark.read.schema("IndicatorCode string, SpatialDim string, TimeDim int, NumericValue double").json(path)
    return raw.groupBy("IndicatorCode", "SpatialDim").agg(F.max_by("NumericValue", "TimeDim").alias("value"), F.max("TimeDim").alias("year"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every md, txt and json file below a folder as a document, with its path."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,json}").text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("content"))


def search_text(conditions: list[str], age: tuple[int, int] | None = None, gender: str | None = None, words: list[str] | None = None) -> str:
    """A Boolean literature query."""
    parts = ["(" + " OR ".join(f'"{c.lower()}"' for c in conditions) + ")"] if conditions else []
    if age:
        parts += ["aged"] if age[0] >= 65 else ["child"] if age[1] <= 18 else ["adult"]
    return " AND ".join(parts + ([{"f": "female", "m": "male"}[gender[0]]] if gender else []) + (words or []))


def snake_case(rows: DataFrame) -> DataFrame:
    """Columns renamed to lower case with underscores."""
    import re

    return rows.toDF(*[re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower()).strip("_") for c in rows.columns])


def find_column(rows: DataFrame, *names: str) -> str | None:
    """The first column that has one of the names in any case."""
    there = {c.lower(): c for c in reversed(rows.columns)}
    return next((there[n.lower()] for n in names if n.lower() in there), None)
