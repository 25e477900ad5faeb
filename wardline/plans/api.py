"""One function for each request that a service would answer; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import etl
from wardline.operators import retrieval as R
from wardline.operators import sampling as S
from wardline.operators import validation as V
from wardline.plans import nl


def generate(patients: DataFrame, text: str, size: int = 100, seed: str = "generate") -> DataFrame:
    """Patients for a cohort description: rows that meet it, with replicas (column `replica`) where there are too few."""
    cohort = nl.parse(patients.sparkSession, text)
    want = min(max(cohort.size or size, 1), 10_000)
    fit = S.clinically_constrained(patients.where(nl.predicate(cohort)))
    have = fit.count()
    if not have:
        return fit.withColumn("replica", F.lit(0))
    rounds = -(-want // have)
    copies = fit.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = F.md5(F.concat_ws(":", F.col("patient_id").cast("string"), F.lit(seed)))
    return copies.withColumn("__h", order).orderBy("replica", "__h", "patient_id").limit(want).drop("__h")


def original(patients: DataFrame, text: str, most: int = 50) -> DataFrame:
    """Up to `most` rows of the data itself that meet a description, by patient id."""
    return patients.where(nl.predicate(nl.parse(patients.sparkSession, text))).orderBy("patient_id").limit(most)


def similar(patients: DataFrame, age: int, diagnoses: tuple[str, ...], gender: str | None = None, most: int = 10) -> DataFrame:
    """Patients within ten years of age with any of the conditions, those with most of them in common first."""
    cohort = nl.Cohort(diagnoses=diagnoses, age=(age - 10, age + 10), gender=gender)
    common = F.size(F.array_intersect("diagnoses", F.array(*[F.lit(d) for d in diagnoses])))
    return patients.where(nl.predicate(cohort)).withColumn("common", common).orderBy(F.desc("common"), F.abs(F.col("age") - age), "patient_id").limit(most)


def validate(patients: DataFrame) -> DataFrame:
    """(check, score, weight, passed) of the clinical checks."""
    return V.report(patients)


def statistics(patients: DataFrame) -> DataFrame:
    """(group, column, n, mean, std, min, median, max) of the numeric columns."""
    return etl.numeric_summary(patients, ["age", "num_diagnoses", "hospital_los_days", "icu_los_days", "comorbidity_score"])


def outcomes(patients: DataFrame) -> DataFrame:
    """One row: mortality, intensive care, emergency and high complexity rates."""
    return patients.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_rate") for c in ("mortality", "has_icu_stay", "emergency_admission", "high_complexity")])


def search(docs: DataFrame, text: str, k: int = 10) -> DataFrame:
    """(doc_id, score, rank) of the best documents for a text by keywords."""
    return R.top_k(R.keyword_scores(docs, [(1, text)]), k).select("doc_id", "score", "rank")


def hybrid(docs: DataFrame, vectors: DataFrame, text: str, vector: list[float], k: int = 10) -> DataFrame:
    """(doc_id, score, rank) by both keywords and vectors, fused by rank."""
    words = R.top_k(R.keyword_scores(docs, [(1, text)]), 2 * k)
    near = R.top_k(R.vector_scores(vectors, [(1, vector)]), 2 * k)
    return R.top_k(R.reciprocal_rank_fusion([words, near]), k).select("doc_id", "score", "rank")
