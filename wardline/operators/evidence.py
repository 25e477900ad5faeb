"""Evidence from retrieved texts: statistics that they state, merged with published values and held against a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import validation as V
from wardline.operators.constraints import Constraint
from wardline.operators.quantiles import normal_two_sided

# Words by which a text supports a condition or an age group.
CONDITION_WORDS = {
    "DIABETES": r"\b(diabetes|diabetic|glucose|insulin|hba1c)\b",
    "HYPERTENSION": r"\b(hypertension|hypertensive|blood pressure|bp)\b",
    "CARDIOVASCULAR": r"\b(cardiovascular|heart|cardiac|coronary|myocardial)\b",
    "RESPIRATORY": r"\b(respiratory|pulmonary|lung|copd|asthma)\b",
    "RENAL": r"\b(renal|kidney|nephro|dialysis|creatinine)\b",
    "SEPSIS": r"\b(sepsis|septic|infection|bacteremia)\b",
    "NEUROLOGICAL": r"\b(neurological|stroke|brain|cerebral)\b",
    "CANCER": r"\b(cancer|tumor|oncolog|malignant|carcinoma)\b",
}
AGE_WORDS = {
    "elderly": r"\b(elderly|geriatric|aged|older adult|65\+|over 65)\b",
    "adult": r"\b(adult|middle.aged|working.age)\b",
    "pediatric": r"\b(pediatric|child|adolescent|infant|neonatal)\b",
}
# How a text states a prevalence (pattern, group of the condition, group of the percentage) and a mean age.
PREVALENCE_FORMS = [
    (r"(?i)prevalence\s+(?:of\s+)?(\w+)\s+(?:was\s+)?(\d+(?:\.\d+)?)\s*%", 1, 2),
    (r"(?i)(\d+(?:\.\d+)?)\s*%\s+(?:of\s+)?patients?\s+(?:had|with)\s+(\w+)", 2, 1),
    (r"(?i)(\w+)\s+(?:was\s+)?(?:present\s+)?in\s+(\d+(?:\.\d+)?)\s*%", 1, 2),
]
AGE_FORMS = [r"(?i)mean\s+age\s+(?:was\s+)?(\d+(?:\.\d+)?)", r"(?i)average\s+age\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*years?"]
STANDARD = ["DIABETES", "HYPERTENSION", "CARDIOVASCULAR", "RESPIRATORY", "RENAL", "SEPSIS", "CANCER"]
# Valid clinical values, and partners that a condition is expected to come with, of the reference checks.
VALID = {
    "heart_rate": (40, 200), "blood_pressure_systolic": (60, 250), "blood_pressure_diastolic": (40, 150), "temperature": (35.0, 42.0), "respiratory_rate": (8, 40),
    "oxygen_saturation": (70, 100), "glucose": (30, 600), "creatinine": (0.1, 15),
}
PARTNERS = {
    "DIABETES": ["HYPERTENSION", "CARDIOVASCULAR", "RENAL"], "HYPERTENSION": ["CARDIOVASCULAR", "DIABETES", "RENAL"], "CARDIOVASCULAR": ["HYPERTENSION", "DIABETES"],
    "RESPIRATORY": ["CARDIOVASCULAR"], "RENAL": ["DIABETES", "HYPERTENSION", "CARDIOVASCULAR"], "SEPSIS": ["RESPIRATORY", "RENAL"],
}


def prevalences(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, source, condition, rate): every prevalence that a text states of a standard condition, one row each time.

    A stated word means the conditions whose name holds it, or that it holds. Rates of 0 and from 100 % say
    nothing; null texts state nothing.
    """
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    found = F.concat(*[
        F.zip_with(F.regexp_extract_all(content, F.lit(p), F.lit(c)), F.regexp_extract_all(content, F.lit(p), F.lit(r)), lambda word, pct: F.struct(F.upper(word).alias("word"), (pct.cast("double") / 100).alias("rate")))
        for p, c, r in PREVALENCE_FORMS])
    rows = docs.select(docs[key].alias(key), docs["source"].alias("source"), F.explode(found).alias("f")).where("f.rate > 0 and f.rate < 1")
    means = F.filter(F.array(*[F.lit(s) for s in STANDARD]), lambda s: F.col("f.word").contains(s) | s.contains(F.col("f.word")))
    return rows.select(key, "source", F.explode(means).alias("condition"), "f.rate")


def mean_ages(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, source, age): every mean age that a text states."""
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in AGE_FORMS])
    return docs.select(docs[key].alias(key), docs["source"].alias("source"), F.explode(F.transform(found, lambda x: x.cast("double"))).alias("age"))


def merged(stated: DataFrame) -> DataFrame:
    """(condition, rate, low, high, n, sources): published prevalences, averaged with the mean of what is stated of them.

    Bounds then reach a fifth below the lower and above the higher of the two; of a condition that only texts
    state, three tenths to either side. Without evidence the published bounds stay.
    """
    means = stated.groupBy("condition").agg(F.avg("rate").alias("mean"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    published = stated.sparkSession.createDataFrame([(c, *v) for c, v in V.PREVALENCE.items()], "condition string, rate double, low double, high double")
    both = published.withColumnRenamed("rate", "known").join(means, "condition", "full")
    known, mean = F.col("known"), F.col("mean")
    return both.select(
        "condition", F.coalesce((known + mean) / 2, known, mean).alias("rate"),
        F.when(mean.isNull(), F.col("low")).when(known.isNull(), 0.7 * mean).otherwise(0.8 * F.least(known, mean)).alias("low"),
        F.when(mean.isNull(), F.col("high")).when(known.isNull(), 1.3 * mean).otherwise(1.2 * F.greatest(known, mean)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sources", F.lit(0)).alias("sources"))


def compared(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(condition, observed, expected, low, high, n, z, p, within): the cohort's prevalences against `merged` ones; a condition nobody has counts as 0."""
    counts = rows.select(F.explode(F.array_distinct("diagnoses")).alias("condition")).groupBy("condition").agg(F.count("*").alias("have"))
    total = rows.agg(F.count("*").alias("total"))
    both = evidence.join(counts, "condition", "left").crossJoin(F.broadcast(total))  # one row
    out = both.select("condition", (F.coalesce("have", F.lit(0)) / F.col("total")).alias("observed"), F.col("rate").alias("expected"), "low", "high", "n", "total")
    z = (F.col("observed") - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("total"))
    return out.withColumn("z", z).withColumn("p", normal_two_sided(F.col("z"))).withColumn("within", F.col("observed").between(F.col("low"), F.col("high"))).drop("total")


def literature_confidence(comparisons: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One row: .5 and .05 for each comparison up to .8, .15 for the share that does not differ (p from .05), less .1, .05 or .02 for each flag (severity)."""
    out = comparisons.agg(F.least(0.5 + 0.05 * F.count("*"), F.lit(0.8)).alias("base"), F.coalesce(F.avg((F.col("p") >= 0.05).cast("double")), F.lit(0.0)).alias("same"))
    penalty = F.lit(0.0)
    if flags is not None:
        fined = flags.agg(F.coalesce(F.sum(F.when(F.col("severity") == "critical", 0.1).when(F.col("severity") == "high", 0.05).otherwise(0.02)), F.lit(0.0)).alias("fine"))
        out, penalty = out.crossJoin(F.broadcast(fined)), F.col("fine")  # one row each
    return out.select(F.greatest(F.least(F.col("base") + 0.15 * F.col("same") - penalty, F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def supported(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row: the conditions and age groups that any text supports, the sources, and the number of texts."""
    low = F.lower(F.coalesce(docs[text].cast("string"), F.lit("")))
    tests = {f"{kind}|{name}": F.max(low.rlike(p)) for kind, words in (("c", CONDITION_WORDS), ("a", AGE_WORDS)) for name, p in words.items()}
    one = docs.agg(*[t.alias(n) for n, t in tests.items()], F.count("*").alias("texts"), F.countDistinct("source").alias("sources"))
    named = lambda kind, words: F.array_compact(F.array(*[F.when(F.col(f"`{kind}|{n}`"), n) for n in words]))
    return one.select(named("c", CONDITION_WORDS).alias("conditions"), named("a", AGE_WORDS).alias("age_groups"), "texts", "sources")


def cross_checks(rows: DataFrame, docs: DataFrame, ages: tuple[int, int] | None = None, year: int = 2024) -> DataFrame:
    """(check, passed, confidence): a cohort against reference texts, by six checks over all rows.

    conditions: shared by cohort and texts, of all of either, from .3 (a text that supports none: failed, .3).
    ages: within `ages`, from .8; without bounds .8 if the mean is 18 to 85, else failed with .5. values: in
    valid ranges, over .95 (.5 where there are none). comorbidity: conditions that come with an expected partner,
    among patients of two or more, from .3 (.6 without any). coverage: 1, .8 or .5 for three, two or one source. consistency:
    rows without a gender that is none, or a birth year that misses the age by over two years, from .9.
    """
    s = lambda test: F.avg(test.cast("double"))
    has = F.col("diagnoses")
    expected = {c: F.when((F.size(has) >= 2) & F.array_contains(has, c), F.arrays_overlap(has, F.array(*[F.lit(p) for p in ps])).cast("int")) for c, ps in PARTNERS.items()}
    clinical = {c: F.when(F.col(c).isNotNull(), (~F.col(c).between(*r)).cast("int")) for c, r in VALID.items() if c in rows.columns}
    wrong = ~F.lower(F.coalesce("gender", F.lit(""))).isin("male", "female", "m", "f", "")
    if "birth_year" in rows.columns:
        wrong = wrong | F.coalesce(F.abs(F.col("age") - (year - F.col("birth_year"))) > 2, F.lit(False))
    total = lambda columns, f: sum((f(c) for c in columns.values()), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = rows.agg(
        F.array_distinct(F.flatten(F.collect_set("diagnoses"))).alias("mine"), s(F.col("age").between(*(ages or (0, 0)))).alias("in_range"), F.avg("age").alias("mean_age"),
        total(expected, zero).alias("kept"), total(expected, F.count).alias("patterns"), total(clinical, zero).alias("out"), total(clinical, F.count).alias("checked"), s(wrong).alias("wrong"))
    wide = facts.crossJoin(F.broadcast(supported(docs)))  # one row each
    both, either = F.size(F.array_intersect("mine", "conditions")), F.size(F.array_union("mine", "conditions"))
    empty = lambda c: F.size(c) == 0
    shared = F.when(empty("mine") & empty("conditions"), 0.5).when(empty("conditions"), 0.3).when(empty("mine"), 0.6).otherwise(both / F.greatest(either, F.lit(1)))
    plausible = F.col("mean_age").between(18, 85)
    aged = F.col("in_range") if ages else F.when(plausible, 0.8).otherwise(0.5)
    valid = F.when(F.col("checked") > 0, 1 - F.col("out") / F.col("checked"))
    partnered = F.when(F.col("patterns") > 0, F.col("kept") / F.col("patterns"))
    covered = F.when(F.col("sources") >= 3, 1.0).when(F.col("sources") == 2, 0.8).when(F.col("sources") == 1, 0.5).otherwise(0.0)
    sound = 1 - F.coalesce("wrong", F.lit(0.0))
    checks: list[tuple[str, Column, Column]] = [
        ("conditions", F.when(empty("conditions"), empty("mine")).when(empty("mine"), True).otherwise(shared >= 0.3), shared),
        ("ages", F.coalesce(aged >= 0.8, F.lit(True)), F.coalesce(aged, F.lit(0.5))), ("values", F.coalesce(1 - valid < 0.05, F.lit(True)), F.coalesce(valid, F.lit(0.5))),
        ("comorbidity", F.coalesce(partnered >= 0.3, F.lit(True)), F.coalesce(partnered, F.lit(0.6))), ("coverage", F.col("sources") >= 1, covered), ("consistency", sound >= 0.9, sound),
    ]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed"), c.cast("double").alias("confidence")) for n, p, c in checks])).alias("x")).select("x.*")


def cross_report(checks: DataFrame) -> DataFrame:
    """One row: mean confidence, checks passed, and what is recommended."""
    out = checks.agg(F.avg("confidence").alias("score"), F.count_if("passed").alias("passed"), F.count("*").alias("checks"), F.min(F.when(F.col("check") == "coverage", F.col("confidence"))).alias("coverage"))
    advice = F.array_compact(F.array(
        F.when(F.col("score") < 0.5, "add reference documents"), F.when(F.col("coverage") == 0, "no reference documents"), F.when(F.col("passed") < 0.7 * F.col("checks"), "review the data for inconsistencies")))
    return out.select("score", "passed", "checks", advice.alias("recommendations"))


# How a text states a condition's share, and the conditions that this check knows.
SHARE_FORM = r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:of\s+)?(?:patients?\s+)?(?:with\s+|had\s+)?(\w+)"
KNOWN = ["DIABETES", "HYPERTENSION", "CARDIOVASCULAR", "RESPIRATORY"]
STATED_AGE = r"(?i)(?:mean|average)\s+age\s+(?:was\s+)?(\d+(?:\.\d+)?)"


def literature_alignment(rows: DataFrame, docs: DataFrame, text: str = "content") -> DataFrame:
    """(what, expected, actual, score, severity): a cohort's shares and mean age against the means of what texts state.

    Shares score 1 within a factor of two, .7 (a warning) within four, else .3 (an error); ages 1 within 10
    years, .7 within 20, else .4 (a warning). What no text states has no row.
    """
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(content, F.lit(SHARE_FORM), F.lit(2)), F.regexp_extract_all(content, F.lit(SHARE_FORM), F.lit(1)), lambda w, p: F.struct(F.upper(w).alias("word"), (p.cast("double") / 100).alias("rate")))
    stated = docs.select(F.explode(pairs).alias("f")).where("f.rate > 0 and f.rate < 1")
    stated = stated.select(F.explode(F.filter(F.array(*[F.lit(s) for s in KNOWN]), lambda s: F.col("f.word").contains(s) | s.contains(F.col("f.word")))).alias("what"), "f.rate")
    expected = stated.groupBy("what").agg(F.avg("rate").alias("expected"))
    mine = rows.agg(*[F.avg(F.coalesce(F.array_contains("diagnoses", c), F.lit(False)).cast("double")).alias(c) for c in KNOWN], F.avg("age").alias("age"))
    facts = mine.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("actual")) for c in [*KNOWN, "age"]])).alias("x")).select("x.*")
    ages = docs.select(F.explode(F.regexp_extract_all(content, F.lit(STATED_AGE), F.lit(1))).alias("a")).agg(F.lit("age").alias("what"), F.avg(F.col("a").cast("double")).alias("expected")).where("expected is not null")
    both = expected.unionByName(ages).join(facts, "what").where("actual is not null")
    ratio, gap = F.col("actual") / F.greatest("expected", F.lit(0.01)), F.abs(F.col("actual") - F.col("expected"))
    is_age = F.col("what") == "age"
    score = F.when(is_age, F.when(gap <= 10, 1.0).when(gap <= 20, 0.7).otherwise(0.4)).otherwise(F.when(ratio.between(0.5, 2), 1.0).when(ratio.between(0.25, 4), 0.7).otherwise(0.3))
    severity = F.when(F.col("score") == 0.3, "error").when((F.col("score") == 0.4) | (~is_age & (F.col("score") == 0.7)), "warning")
    return both.select("what", "expected", "actual", score.alias("score")).withColumn("severity", severity)


def contextual(rows: DataFrame, docs: DataFrame | None = None, alignment: DataFrame | None = None) -> DataFrame:
    """(check, score, weight, passed, errors, critical, issues): the clinical checks but completeness, beside literature and request.

    `alignment` has the request's checks (check, actual, score). Literature weighs 1.5 and passes from .6 (.7
    where texts state nothing), the request 1.4 from .7 (.8 where it asks nothing). `issues` counts what a check found.
    """
    base = V.report(rows).where("check <> 'completeness'")
    fields = [c for c in ("age", "hospital_los_days", "icu_los_days", "glucose", "creatinine", "heart_rate", "temperature") if c in rows.columns]
    found = V.range_checks(rows, fields).agg(F.count_if(F.col("out_of_range") > 0).alias("n")).select(F.lit("ranges").alias("check"), "n")
    people = V.demographic_checks(rows).select(F.lit("demographics").alias("check"), ((F.col("bad_ages") > 0).cast("int") + (~F.coalesce("mean_age_ok", F.lit(True))).cast("int") + (~F.coalesce("balance_ok", F.lit(True))).cast("int")).cast("bigint").alias("n"))
    partners = V.comorbidity_checks(rows).agg(F.count_if(F.col("with_partner") == 0).alias("n")).select(F.lit("comorbidity").alias("check"), "n")
    issues = found.unionByName(people).unionByName(partners)
    out = base.join(issues, "check", "left").select("check", "score", "weight", "passed", "errors", "critical", F.coalesce("n", F.lit(0)).cast("bigint").alias("issues"))

    def added(name: str, checks: DataFrame, weight: float, least: float, without: float, wrong: Column) -> DataFrame:
        one = checks.agg(F.coalesce(F.avg("score"), F.lit(without)).alias("score"), F.count_if(wrong).cast("int").alias("errors"), F.count_if(F.col("score") < 1).alias("issues"))
        return one.select(F.lit(name).alias("check"), "score", F.lit(weight).alias("weight"), (F.col("score") >= least).alias("passed"), "errors", F.lit(0).alias("critical"), "issues")

    if docs is not None:
        out = out.unionByName(added("literature", literature_alignment(rows, docs), 1.5, 0.6, 0.7, F.col("severity") == "error"))
    if alignment is not None:
        wrong = (F.col("check").startswith("prevalence") & (F.col("actual") < 0.2)) | ((F.col("check") == "age") & (F.col("actual") < 0.5))
        out = out.unionByName(added("request", alignment, 1.4, 0.7, 0.8, F.coalesce(wrong, F.lit(False))))
    return out


def assessment(checks: DataFrame, texts: int = 0) -> DataFrame:
    """One row of `contextual` checks: weighted score, whether valid (from .7, at most two errors, nothing critical), confidence and recommendations.

    Confidence is the mean score, less a fifth for each critical issue, and .02 for each text more, up to .15, at most 1.
    """
    n = lambda check: F.coalesce(F.sum(F.when(F.col("check") == check, F.col("issues"))), F.lit(0))
    out = checks.agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.avg("score").alias("mean"), F.sum("errors").alias("errors"), F.sum("critical").alias("critical"),
        *[n(c).alias(c) for c in ("ranges", "comorbidity", "demographics", "literature")], F.array_sort(F.collect_list(F.when(F.col("score") < 0.6, F.col("check")))).alias("low"))  # a handful of checks
    advice = F.array_compact(F.array(
        F.when(F.col("ranges") > 3, "review the generation of clinical values"), F.when(F.col("comorbidity") > 0, "add correlations of comorbidities"), F.when(F.col("demographics") > 0, "check the balance of demographics"),
        F.when(F.col("literature") > 2, "verify the source data against the literature"), F.when(F.size("low") > 0, F.concat(F.lit("improve: "), F.array_join("low", ", ")))))
    confidence = F.least(F.greatest(F.least(F.col("mean") * F.pow(F.lit(0.8), "critical"), F.lit(1.0)), F.lit(0.0)) + min(0.02 * texts, 0.15), F.lit(1.0))
    valid = (F.col("score") >= 0.7) & (F.col("errors") <= 2) & (F.col("critical") == 0)
    return out.select("score", valid.alias("valid"), confidence.alias("confidence"), "errors", "critical", advice.alias("recommendations"))


def plausibility(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kurtosis, mode_share, kinds, score): how plausible the columns' distributions are; those of under ten values have no row.

    The mean of two scores: excess kurtosis of -2 to 7 is 1, of -5 to 15 .7, else .4 (1 for a constant column); a value that
    more than half of the rows have is .5 where there are over five different ones, else 1. Values are counted first.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    moments = long.groupBy("column").agg(F.count("*").alias("n"), F.kurtosis("v").alias("kurtosis")).where("n >= 10")
    modes = long.groupBy("column", "v").agg(F.count("*").alias("c")).groupBy("column").agg(F.max("c").alias("mode"), F.count("*").alias("kinds"))
    k = F.col("kurtosis")
    peaked = F.when(k.isNull() | F.isnan(k) | k.between(-2, 7), 1.0).when(k.between(-5, 15), 0.7).otherwise(0.4)
    dominant = F.when((F.col("mode") / F.col("n") > 0.5) & (F.col("kinds") > 5), 0.5).otherwise(1.0)
    return moments.join(modes, "column").select("column", "kurtosis", (F.col("mode") / F.col("n")).alias("mode_share"), "kinds", ((peaked + dominant) / 2).alias("score"))


def currency(rows: DataFrame, columns: list[str], year: int) -> DataFrame:
    """One row (currency): the mean, over the date columns that have dates, of the share of the last five years, with .5 more to
    average where over a hundredth lies in the future; .8 without dates."""
    if not columns:
        return rows.agg(F.lit(0.8).alias("currency"))
    years = {c: F.year(F.col(c).cast("date")) for c in columns}
    one = rows.agg(*[f(F.when(y.isNotNull(), (y >= year - 5 if n == "r" else y > year).cast("double"))).alias(f"{n}{i}") for i, y in enumerate(years.values()) for n, f in (("r", F.avg), ("f", F.avg))])
    scores = F.array_compact(F.array(*[s for i in range(len(columns)) for s in (F.col(f"r{i}"), F.when(F.col(f"f{i}") > 0.01, 0.5))]))
    return one.select(F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.8).alias("currency"))


def logical_consistency(rows: DataFrame) -> DataFrame:
    """One row (consistency): 1 less violations by rows and checks: longer in intensive care than in hospital, ages out of 0 to 120, and each has_ or is_ column with a value but 0 and 1; .8 without checks."""
    checks, found = 0, F.lit(0).cast("bigint")
    if {"icu_los_days", "hospital_los_days"} <= set(rows.columns):
        checks, found = checks + 1, found + F.count_if(F.col("icu_los_days") > F.col("hospital_los_days"))
    if "age" in rows.columns:
        checks, found = checks + 1, found + F.count_if(~F.col("age").between(0, 120))
    for c in [c for c in rows.columns if c.startswith(("has_", "is_"))]:
        checks, found = checks + 1, found + F.coalesce(F.max(F.when(~F.coalesce(F.col(c).cast("double").isin(0.0, 1.0), F.lit(False)), 1)), F.lit(0))
    if not checks:
        return rows.agg(F.lit(0.8).alias("consistency"))
    return rows.agg((1 - found / F.greatest(F.count("*") * checks, F.lit(1))).alias("consistency"))


def confidence(rows: DataFrame, docs: DataFrame, columns: list[str], dates: list[str], year: int) -> DataFrame:
    """One row: clinical, plausible, literature, current, consistent, overall (.30, .25, .20, .10, .15), level and recommendations.

    Clinical is the verdict's score, literature the share of prevalences within the bounds of `merged` evidence;
    each is measured on the rows and texts given.
    """
    parts = [
        V.verdict(V.report(rows)).select(F.col("score").alias("clinical")), plausibility(rows, columns).agg(F.coalesce(F.avg("score"), F.lit(0.7)).alias("plausible")),
        compared(rows, merged(prevalences(docs))).agg(F.coalesce(F.avg(F.col("within").cast("double")), F.lit(0.6)).alias("literature")), currency(rows, dates, year).withColumnRenamed("currency", "current"), logical_consistency(rows).withColumnRenamed("consistency", "consistent")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    overall = 0.30 * F.col("clinical") + 0.25 * F.col("plausible") + 0.20 * F.col("literature") + 0.10 * F.col("current") + 0.15 * F.col("consistent")
    out = out.withColumn("overall", overall)
    level = F.when(F.col("overall") >= 0.9, "very_high").when(F.col("overall") >= 0.75, "high").when(F.col("overall") >= 0.5, "medium").when(F.col("overall") >= 0.25, "low").otherwise("very_low")
    advice = F.array_compact(F.array(
        F.when(F.col("clinical") < 0.6, "review values against clinical ranges"), F.when(F.col("plausible") < 0.6, "check for collapsed distributions"), F.when(F.col("literature") < 0.5, "retrieve more reference documents"),
        F.when(F.col("consistent") < 0.7, "verify relationships between fields")))
    return out.withColumn("level", level).withColumn("recommendations", advice)


def constraints_of(docs: DataFrame, asked: tuple[str, ...] = (), confidence: float = 0.7) -> tuple[Constraint, ...]:
    """Constraints on has_ columns from what texts state: the mean share of each standard condition that they state (seven at most), but those `asked` for."""
    found = prevalences(docs).groupBy("condition").agg(F.avg("rate").alias("rate"), F.min("source").alias("source")).orderBy("condition").collect()
    return tuple(Constraint(r.condition.lower(), f"has_{r.condition.lower()}", "distribution", share=r.rate, source=r.source or "", confidence=confidence) for r in found if r.condition not in asked)
