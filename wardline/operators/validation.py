"""Dataset validation: rule checks as one-pass aggregates, reports as rows, and real-versus-synthetic fidelity."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators.quantiles import normal_two_sided, t_tail

# Plausible ranges by field.
RANGES = {
    "age": (0, 120), "heart_rate": (30, 220), "blood_pressure_systolic": (50, 300), "blood_pressure_diastolic": (30, 180), "temperature": (32.0, 43.0),
    "respiratory_rate": (6, 60), "oxygen_saturation": (50, 100), "glucose": (20, 800), "hba1c": (3.0, 18.0), "creatinine": (0.1, 20), "bmi": (10, 70),
    "hospital_los_days": (0, 365), "icu_los_days": (0, 180),
}
# Partners that a condition is expected to come with.
EXPECTED_PARTNERS = {
    "DIABETES": ["HYPERTENSION", "CARDIOVASCULAR", "RENAL", "OBESITY"],
    "HYPERTENSION": ["CARDIOVASCULAR", "DIABETES", "RENAL", "STROKE"],
    "CARDIOVASCULAR": ["HYPERTENSION", "DIABETES", "HYPERLIPIDEMIA"],
    "RESPIRATORY": ["CARDIOVASCULAR", "SMOKING_RELATED"],
    "RENAL": ["DIABETES", "HYPERTENSION", "CARDIOVASCULAR"],
    "CANCER": ["ANEMIA", "MALNUTRITION"],
}
# Published prevalence (rate, low, high), mortality and co-occurrence.
PREVALENCE = {
    "DIABETES": (0.25, 0.20, 0.30), "HYPERTENSION": (0.45, 0.40, 0.50), "CARDIOVASCULAR": (0.30, 0.25, 0.35), "RESPIRATORY": (0.15, 0.12, 0.18),
    "RENAL": (0.12, 0.10, 0.15), "SEPSIS": (0.08, 0.06, 0.10), "CANCER": (0.10, 0.08, 0.12),
}
CO_OCCURRENCE = {
    ("DIABETES", "HYPERTENSION"): 0.65, ("DIABETES", "CARDIOVASCULAR"): 0.40, ("DIABETES", "RENAL"): 0.35,
    ("HYPERTENSION", "CARDIOVASCULAR"): 0.55, ("RESPIRATORY", "CARDIOVASCULAR"): 0.30, ("SEPSIS", "RENAL"): 0.45,
}
MORTALITY = {"overall_icu": (0.15, 0.12, 0.18), "sepsis": (0.25, 0.20, 0.30), "respiratory_failure": (0.20, 0.15, 0.25)}
# Combinations that cannot or hardly ever be, and how grave they are.
IMPLAUSIBLE_PAIRS = [("PEDIATRIC", "ALZHEIMER", "critical"), ("TYPE1_DIABETES", "TYPE2_DIABETES", "critical"), ("PREGNANCY", "MALE", "critical")]
IMPLAUSIBLE_AGES = [("COPD", 30, "high"), ("MENOPAUSE", 40, "medium")]
LIVING_DISPOSITIONS = ["home", "rehabilitation", "snf"]
# Outdated terms and how grave they are.
OUTDATED = {
    "thiazolidinedione": "medium", "rosiglitazone": "high", "glyburide": "medium", "chlorpropamide": "high", "phenformin": "critical", "troglitazone": "critical",
    "cisapride": "critical", "rofecoxib": "critical", "juvenile diabetes": "low", "adult-onset diabetes": "low", "non-insulin dependent": "low", "borderline diabetes": "low",
    "cva": "low", "niddm": "low", "iddm": "low", "tight glycemic control in icu": "high", "routine stress ulcer prophylaxis": "medium", "pulmonary artery catheter routine": "medium",
}
SEVERITY_WEIGHTS = {"critical": 0.2, "high": 0.1, "medium": 0.05, "low": 0.02}


def share(test: Column) -> Column:
    """Share of rows for which the test holds; null counts as not."""
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def range_for(column: str) -> tuple[float, float] | None:
    """The first range whose name is part of the column's, or the other way round."""
    return next((r for name, r in RANGES.items() if name in column or column in name), None)


def range_checks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, out_of_range, score, critical) in one pass; critical where over a tenth is out."""
    known = [(c, range_for(c)) for c in columns if range_for(c)]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), (~F.col(c).between(*r)).alias("out")) for c, r in known])).alias("x"))
    out = long.groupBy(F.col("x.column").alias("column")).agg(F.count("x.v").alias("n"), F.count_if("x.out").alias("out_of_range"))
    rate = F.try_divide(F.col("out_of_range"), F.col("n"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - 5 * rate)).withColumn("critical", rate > 0.1)


def demographic_checks(rows: DataFrame) -> DataFrame:
    """One row: bad ages, mean age within 30 to 75, and the smaller gender's share of at least a fifth."""
    male = share(F.col("gender") == "m")
    out = rows.agg(F.count_if(~F.col("age").between(0, 120)).alias("bad_ages"), F.avg("age").alias("mean_age"), F.least(male, 1 - male).alias("minority"))
    return out.withColumn("mean_age_ok", F.col("mean_age").between(30, 75)).withColumn("balance_ok", F.col("minority") >= 0.2)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, share_of_a): patients with both conditions, for each ordered pair; arrays hold at most the ten categories."""
    pairs = rows.select(F.explode("diagnoses").alias("a"), "diagnoses").select("a", F.explode("diagnoses").alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    whole = counts.where("a = b").select("a", F.col("n").alias("n_a"))
    return counts.where("a <> b").join(whole, "a").select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("share_of_a"))


def comorbidity_checks(rows: DataFrame, least: int = 10) -> DataFrame:
    """(condition, n, with_partner, share): conditions of at least `least` cases with an expected partner."""
    tests = [
        F.struct(F.lit(c).alias("condition"), F.array_contains("diagnoses", c).alias("has"), F.arrays_overlap("diagnoses", F.array(*[F.lit(p) for p in ps])).alias("partner"))
        for c, ps in EXPECTED_PARTNERS.items()
    ]
    long = rows.select(F.explode(F.array(*tests)).alias("x")).where("x.has")
    out = long.groupBy(F.col("x.condition").alias("condition")).agg(F.count("*").alias("n"), F.count_if("x.partner").alias("with_partner")).where(F.col("n") >= least)
    return out.withColumn("share", F.col("with_partner") / F.col("n"))


def consistency(rows: DataFrame) -> DataFrame:
    """One row of violations: longer in intensive care than in hospital, flags against days, emergency flag against type."""
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("icu_los_days") > F.col("hospital_los_days")).alias("icu_over_hospital"),
        F.count_if((F.col("has_icu_stay") == 0) & (F.col("icu_los_days") > 0)).alias("days_without_stay"), F.count_if(F.size("diagnoses") == 0).alias("no_diagnosis"),
        F.count_if((F.col("emergency_admission") == 1) & (F.col("admission_type") != "Emergency")).alias("emergency_mismatch"))


def clinical_consistency(rows: DataFrame) -> DataFrame:
    """One row: stays longer in intensive care than in hospital (an error), dead patients discharged as living (critical),
    diabetic patients with glucose under 70 and whether they are over three tenths (a warning), and the score, passed from .9.

    A rule whose columns are missing finds nothing.
    """
    has = lambda *cs: all(c in rows.columns for c in cs)
    longer = F.count_if(F.col("icu_los_days") > F.col("hospital_los_days")) if has("icu_los_days", "hospital_los_days") else F.lit(0).cast("bigint")
    living = F.lower("discharge_disposition").isin(LIVING_DISPOSITIONS) if has("discharge_disposition") else F.lit(False)
    diabetic = F.array_contains("diagnoses", "DIABETES")
    low = diabetic & (F.col("glucose") < 70) if has("glucose") else F.lit(False)
    out = rows.agg(
        F.count("*").alias("n"), longer.alias("icu_over_hospital"), F.count_if((F.col("mortality") == 1) & living).alias("dead_but_discharged"),
        F.count_if(low).alias("low_glucose"), F.count_if(diabetic).alias("diabetic"))
    score = F.greatest(F.lit(0.0), 1 - (F.col("icu_over_hospital") + F.col("dead_but_discharged")) / F.greatest("n", F.lit(1)))
    return out.select("n", "icu_over_hospital", "dead_but_discharged", "low_glucose", (F.col("low_glucose") > 0.3 * F.col("diabetic")).alias("glucose_flagged"), score.alias("score"), (score >= 0.9).alias("passed"))


def completeness(rows: DataFrame) -> DataFrame:
    """(column, nulls, null_rate, flagged) of every column, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("missing")) for c in rows.columns])).alias("x"))
    out = long.groupBy(F.col("x.column").alias("column")).agg(F.count_if("x.missing").alias("nulls"), share(F.col("x.missing")).alias("null_rate"))
    return out.withColumn("flagged", F.col("null_rate") > 0.5)


def prevalence_test(rows: DataFrame) -> DataFrame:
    """(condition, observed, expected, z, p, within): one-proportion z test of each published prevalence."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("condition"), F.lit(r).alias("expected"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array_contains("diagnoses", c).cast("double").alias("has")) for c, (r, lo, hi) in PREVALENCE.items()])).alias("x")).select("x.*")
    out = long.groupBy("condition", "expected", "lo", "hi").agg(F.avg("has").alias("observed"), F.count("*").alias("n"))
    z = (F.col("observed") - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("n"))
    return out.withColumn("z", z).withColumn("p", normal_two_sided(F.col("z"))).withColumn("within", F.col("observed").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def co_occurrence_test(rows: DataFrame) -> DataFrame:
    """(a, b, observed, expected, plausible): P(b | a) within half and twice the published rate."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(r).alias("expected"), F.array_contains("diagnoses", a).alias("has"), F.array_contains("diagnoses", b).cast("double").alias("both")) for (a, b), r in CO_OCCURRENCE.items()])).alias("x")).select("x.*").where("has")
    out = long.groupBy("a", "b", "expected").agg(F.avg("both").alias("observed"))
    ratio = F.col("observed") / F.col("expected")
    return out.withColumn("plausible", ratio.between(0.5, 2.0))


def implausible(rows: DataFrame) -> DataFrame:
    """(rule, severity, n): patients (age, gender, `conditions` in upper case) with conditions that exclude one another, their sex, or their age.

    PEDIATRIC and MALE are conditions too, but also known from the age group and the gender.
    """
    def has(name: str) -> Column:
        test = F.exists("conditions", lambda c: c.contains(name))
        return test | (F.col("gender") == "m") if name == "MALE" else test | (F.col("age") < 18) if name == "PEDIATRIC" else test

    rules = [(f"{a}+{b}", s, has(a) & has(b)) for a, b, s in IMPLAUSIBLE_PAIRS] + [(f"{c}<{age}", s, has(c) & (F.col("age") < age)) for c, age, s in IMPLAUSIBLE_AGES]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"), F.coalesce(v, F.lit(False)).alias("broken")) for k, s, v in rules])).alias("x"))
    return long.groupBy(F.col("x.rule").alias("rule"), F.col("x.severity").alias("severity")).agg(F.count_if("x.broken").alias("n"))


def mortality_bounds(rows: DataFrame) -> DataFrame:
    """(cohort, observed, n, expected, flagged): mortality in intensive care, with sepsis and with respiratory disease; flagged under half the low or over twice the high published bound."""
    cohorts = {"overall_icu": F.col("has_icu_stay") == 1, "sepsis": F.array_contains("diagnoses", "SEPSIS"), "respiratory_failure": F.array_contains("diagnoses", "RESPIRATORY")}
    long = rows.select("mortality", F.explode(F.array(*[
        F.when(cohorts[c], F.struct(F.lit(c).alias("cohort"), F.lit(r).alias("expected"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for c, (r, lo, hi) in MORTALITY.items()])).alias("x")).where("x is not null").select("mortality", "x.*")
    out = long.groupBy("cohort", "expected", "lo", "hi").agg(F.avg("mortality").alias("observed"), F.count("*").alias("n"))
    return out.select("cohort", "observed", "n", "expected", ((F.col("observed") < 0.5 * F.col("lo")) | (F.col("observed") > 2 * F.col("hi"))).alias("flagged"))


def outdated_terms(rows: DataFrame, text: Column) -> DataFrame:
    """(term, severity, n): rows that hold an outdated term; the terms are literals, so it is one pass."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(low.contains(t), F.struct(F.lit(t).alias("term"), F.lit(s).alias("severity"))) for t, s in OUTDATED.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("x")).groupBy(F.col("x.term").alias("term"), F.col("x.severity").alias("severity")).agg(F.count("*").alias("n"))


def temporal_violations(rows: DataFrame, as_of: str) -> DataFrame:
    """(rule, n): admission after discharge, death before admission, dates after `as_of` or before 1900; a missing date breaks nothing."""
    rules = {
        "admission_after_discharge": F.col("admittime") > F.col("dischtime"), "death_before_admission": F.col("deathdate") < F.to_date("admittime"),
        "after_reference": F.to_date("dischtime") > F.lit(as_of).cast("date"), "before_1900": F.year("admittime") < 1900,
    }
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("broken")) for k, v in rules.items()])).alias("x"))
    return long.groupBy(F.col("x.rule").alias("rule")).agg(F.count_if("x.broken").alias("n"))


def currency_score(terms: DataFrame, rows: int) -> DataFrame:
    """One row: 1 less each outdated term's weight, times ten of its share at most 1."""
    weight = F.lit(0.0)
    for s, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    return terms.agg(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(weight * F.least(10.0 * F.col("n") / rows, F.lit(1.0))), F.lit(0.0))).alias("currency"))


def outlier_shares(rows: DataFrame, columns: list[str], sigmas: float = 4.0) -> DataFrame:
    """(column, mean, std, outliers, share, kurtosis): two passes, the first for the moments."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    moments = long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.kurtosis("v").alias("kurtosis"))
    far = long.join(F.broadcast(moments), "column")  # one row a column
    return far.groupBy("column", "mean", "std", "kurtosis").agg(F.count_if(F.abs(F.col("v") - F.col("mean")) > sigmas * F.col("std")).alias("outliers"), F.count("v").alias("n")).withColumn("share", F.col("outliers") / F.col("n"))


def record_confidence(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with `confidence`: 1 less a share of mean |z| (3 and beyond count full), and its level."""
    facts = rows.agg(*[f(F.col(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    wide = rows.crossJoin(F.broadcast(facts))  # one row
    zs = F.array(*[F.least(F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"__m_{c}")), F.col(f"__s_{c}")), F.lit(0.0)), F.lit(3.0)) for c in columns])
    value = 1 - F.aggregate(zs, F.lit(0.0), lambda a, z: a + z) / (3.0 * len(columns))
    level = F.when(F.col("confidence") >= 0.9, "very_high").when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.5, "medium").when(F.col("confidence") >= 0.25, "low").otherwise("very_low")
    return wide.withColumn("confidence", value).withColumn("level", level).select(*rows.columns, "confidence", "level")


def mean_std_difference(real: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(column, real and other mean and std, relative differences)."""
    def moments(rows: DataFrame, name: str) -> DataFrame:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
        return long.groupBy(F.col("x.column").alias("column")).agg(F.avg("x.v").alias(f"{name}_mean"), F.stddev_samp("x.v").alias(f"{name}_std"))

    both = moments(real, "real").join(moments(other, "other"), "column")
    return both.withColumn("mean_diff", F.try_divide(F.abs(F.col("real_mean") - F.col("other_mean")), F.abs(F.col("real_mean")))).withColumn("std_diff", F.try_divide(F.abs(F.col("real_std") - F.col("other_std")), F.col("real_std")))


def category_distances(real: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(column, overlap, tvd): the sum of the lesser shares, and half the sum of the differences."""
    def shares(rows: DataFrame, name: str) -> DataFrame:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        return counts.join(counts.groupBy("column").agg(F.sum("n").alias("all")), "column").select("column", "value", (F.col("n") / F.col("all")).alias(name))

    a, b = shares(real, "p"), shares(other, "q").withColumnsRenamed({"column": "c2", "value": "v2"})
    both = a.join(b, (a.column == b.c2) & a.value.eqNullSafe(b.v2), "full").select(F.coalesce("column", "c2").alias("column"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    return both.groupBy("column").agg(F.sum(F.least("p", "q")).alias("overlap"), (0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tvd"))


def ks_statistic(real: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks): the largest distance of the two distribution functions of each column.

    Values are counted first; running counts are taken within ranges of the value and then over the
    ranges (by percentiles, 256 a column), so no task holds a whole column.
    """
    def counted(rows: DataFrame, which: int) -> DataFrame:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
        return long.groupBy("column", "v").agg(F.count("*").alias("n")).select("column", "v", F.when(F.lit(which) == 0, F.col("n")).otherwise(0).alias("a"), F.when(F.lit(which) == 1, F.col("n")).otherwise(0).alias("b"))

    values = counted(real, 0).unionByName(counted(other, 1)).groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cuts = values.groupBy("column").agg(F.array_distinct(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 2048)).alias("cuts"), F.sum("a").alias("na"), F.sum("b").alias("nb")).localCheckpoint()  # found once: they depend on the order of merging
    placed = values.join(F.broadcast(cuts), "column")  # one row a column
    halves = F.array(*[F.lit(1 << k) for k in range(7, -1, -1)])  # a binary search for the number of cuts below the value
    part = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get("cuts", at + half - 1) < F.col("v"), half).otherwise(0))
    placed = placed.withColumn("part", part).drop("cuts")
    sums = placed.groupBy("column", "part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    w = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("column", "part", F.coalesce(F.sum("sa").over(w), F.lit(0)).alias("fa"), F.coalesce(F.sum("sb").over(w), F.lit(0)).alias("fb"))
    inside = Window.partitionBy("column", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("ra", F.sum("a").over(inside)).withColumn("rb", F.sum("b").over(inside)).join(before, ["column", "part"])
    gap = F.abs((F.col("ra") + F.col("fa")) / F.col("na") - (F.col("rb") + F.col("fb")) / F.col("nb"))
    return run.groupBy("column").agg(F.max(gap).alias("ks"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of the upper triangle, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def correlation_similarity(real: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """One row: Pearson correlation of the two upper triangles."""
    a, b = correlations(real, columns), correlations(other, columns).withColumnRenamed("r", "s")
    return a.join(b, ["a", "b"]).agg(F.corr("r", "s").alias("similarity"))


def closest_records(real: DataFrame, sample: DataFrame, columns: list[str], key: str, block: int = 1 << 15, own: bool = False) -> DataFrame:
    """(key, distance): the z-scaled Euclidean distance of each row of `sample` to the nearest real one.

    With `own` the sample's rows are real ones themselves, and each is held against all others: where another
    row has the same values the distance is 0, else the nearest other point counts (null if there is none).

    Equal rows are folded into points on both sides. The sample's points are broadcast in blocks of `block`;
    the real points stream past each block, and a task returns one least distance for each point of the block.
    A null counts as the real rows' mean. With no real rows the result is empty.
    """
    facts = real.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    scaled = [F.coalesce((F.col(c).cast("double") - (facts[f"m_{c}"] or 0.0)) / (facts[f"s_{c}"] or 1.0), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    names = [f"x{i}" for i in range(len(columns))]
    counted = real.select(*scaled).groupBy(*names).agg(F.count("*").alias("n"))
    points, asked = counted.select(*names), sample.select(F.col(key).alias("k"), *scaled)
    context, found, some = real.sparkSession.sparkContext, [], []

    def least(rows: list) -> DataFrame:
        given = context.broadcast(np.array(rows, dtype=np.float64))

        def scan(batches):
            here, best = given.value, None
            for b in batches:
                x = b[names].to_numpy(np.float64)
                for at in range(0, len(x), 256):
                    d = ((here[:, None, :] - x[None, at : at + 256]) ** 2).sum(2)
                    d = (np.where(d == 0, np.inf, d) if own else d).min(1)
                    best = d if best is None else np.minimum(best, d)
            if best is not None:
                yield pd.DataFrame({**{n: here[:, i] for i, n in enumerate(names)}, "d": best})

        return points.mapInPandas(scan, ", ".join(f"{n} double" for n in [*names, "d"]))

    for row in asked.select(*names).distinct().toLocalIterator():
        some.append(tuple(row))
        if len(some) == block:
            found, some = [*found, least(some)], []
    found += [least(some)] if some else []
    if not found:
        return asked.select(F.col("k").alias(key), F.lit(0.0).alias("distance")).limit(0)
    nearest = reduce(DataFrame.unionByName, found).groupBy(*names).agg(F.sqrt(F.min("d")).alias("distance"))
    if own:
        nearest = nearest.join(counted, names).withColumn("distance", F.when(F.col("n") > 1, 0.0).when(F.col("distance") < float("inf"), F.col("distance"))).drop("n")
    return asked.join(nearest, names).select(F.col("k").alias(key), "distance")


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, n): equal bins between the least and the largest value; the largest belongs to the last."""
    edges = rows.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).select(  # one row
        F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(column) - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0).alias("bin"), "__lo", width.alias("__w"))
    return placed.groupBy("bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("low")).agg(F.count("*").alias("n"))


def uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, repeated rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n"), F.count("*").alias("distinct_keys"), F.count_if(F.col("c") > 1).alias("repeated_keys"))


def report(rows: DataFrame) -> DataFrame:
    """(check, score, weight, passed, errors, critical): the five clinical checks, as rows; `verdict` weighs them.

    Comorbidity is the mean over the conditions of ten patients or more: 1 if any expected partner comes with
    it in any patient, else .5; .8 if no condition has as many. Over a tenth of values out of range is
    critical, and so is a dead patient discharged as living; longer in intensive care than in hospital is an error.
    """
    bad = {c: share(~F.col(c).between(*RANGES[c])) for c in ("age", "hospital_los_days")}
    male = share(F.col("gender") == "m")
    partners = {c: (F.count_if(F.array_contains("diagnoses", c)), F.count_if(F.array_contains("diagnoses", c) & F.arrays_overlap("diagnoses", F.array(*[F.lit(p) for p in ps])))) for c, ps in EXPECTED_PARTNERS.items()}
    pattern = F.filter(F.array(*[F.when(n >= 10, F.when(k > 0, 1.0).otherwise(0.5)) for n, k in partners.values()]), lambda x: x.isNotNull())
    living = (F.col("mortality") == 1) & F.lower("discharge_disposition").isin(LIVING_DISPOSITIONS) if "discharge_disposition" in rows.columns else F.lit(False)
    longer, dead, n = F.count_if(F.col("icu_los_days") > F.col("hospital_los_days")), F.count_if(living), F.greatest(F.count("*"), F.lit(1))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in rows.columns), F.lit(0)) / (n * len(rows.columns))
    out = rows.agg(
        (1 - 5 * share(~F.col("age").between(*RANGES["age"]) | ~F.col("hospital_los_days").between(*RANGES["hospital_los_days"]))).alias("ranges"), F.greatest(*bad.values()).alias("worst"),
        (F.when(F.avg("age").between(30, 75), 1.0).otherwise(0.7) - F.when(F.least(male, 1 - male) < 0.2, 0.2).otherwise(0.0)).alias("demographics"), pattern.alias("pattern"),
        (1 - (longer + dead) / n).alias("consistency"), (1 - nulls).alias("completeness"), longer.alias("longer"), dead.alias("dead"))
    mean = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + x) / F.size("pattern")
    out = out.withColumn("comorbidity", F.when(F.size("pattern") == 0, 0.8).otherwise(mean))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    checks = [
        ("ranges", 1.5, 0.7, F.lit(0), flag(F.col("worst") > 0.1)), ("demographics", 1.0, 0.7, F.lit(0), F.lit(0)), ("comorbidity", 1.2, 0.7, F.lit(0), F.lit(0)),
        ("consistency", 1.3, 0.9, flag(F.col("longer") > 0), flag(F.col("dead") > 0)), ("completeness", 0.8, 0.7, F.lit(0), F.lit(0)),
    ]
    long = out.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("check"), F.greatest(F.lit(0.0), F.col(k)).alias("score"), F.lit(w).alias("weight"), (F.greatest(F.lit(0.0), F.col(k)) >= least).alias("passed"), e.alias("errors"), c.alias("critical"))
        for k, w, least, e, c in checks])).alias("x"))
    return long.select("x.*")


def verdict(checks: DataFrame) -> DataFrame:
    """One row: weighted score, failed checks, errors, critical issues; valid from .7 with at most two errors and nothing critical."""
    out = checks.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"), F.count_if(~F.col("passed")).alias("failed"), F.sum("errors").alias("errors"), F.sum("critical").alias("critical"))
    return out.withColumn("valid", (F.col("score") >= 0.7) & (F.col("errors") <= 2) & (F.col("critical") == 0))


def utility(train: DataFrame, test: DataFrame, columns: list[str], label: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """One row (accuracy, f1): a random forest trained on one table and tested on the other."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    pick = lambda d: d.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label")).dropna()
    steps = [VectorAssembler(inputCols=columns, outputCol="features"), RandomForestClassifier(numTrees=trees, seed=seed)]
    guessed = Pipeline(stages=steps).fit(pick(train)).transform(pick(test))
    measure = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(guessed)
    return train.sparkSession.createDataFrame([(measure("accuracy"), measure("f1"))], "accuracy double, f1 double")


def ks_probability(ks: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided probability of a two-sample KS statistic (Kolmogorov's series)."""
    size = F.sqrt(n * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * ks
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 8)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


# Published mean age and deviation by condition.
AGES = {"DIABETES_TYPE2": (62, 15), "HYPERTENSION": (58, 18), "CARDIOVASCULAR": (65, 12), "STROKE": (70, 14), "COPD": (68, 10)}
#: The category that holds a condition, where categories are coarser.
CATEGORY = {"DIABETES_TYPE2": "DIABETES", "STROKE": "NEUROLOGICAL", "COPD": "RESPIRATORY"}


def age_test(rows: DataFrame) -> DataFrame:
    """(condition, n, mean, t, p, aligned): mean ages against the published ones; aligned within 10 years.

    p is Student's, two-sided, with n - 1 degrees of freedom.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(float(m)).alias("published"), F.when(F.array_contains("diagnoses", CATEGORY.get(c, c)), F.col("age").cast("double")).alias("age")) for c, (m, _) in AGES.items()])).alias("x")).select("x.*")
    out = long.groupBy("condition", "published").agg(F.count("age").alias("n"), F.avg("age").alias("mean"), F.stddev_samp("age").alias("std"))
    t = F.try_divide(F.col("mean") - F.col("published"), F.col("std") / F.sqrt("n"))
    return out.withColumn("t", t).withColumn("p", t_tail(F.col("t"), F.col("n") - 1)).withColumn("aligned", F.abs(F.col("mean") - F.col("published")) <= 10)


def mean_bands(rows: DataFrame, columns: list[str], z: float = 1.96) -> DataFrame:
    """(column, mean, low, high): means with bands of `z` standard errors."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    out = long.groupBy(F.col("x.column").alias("column")).agg(F.avg("x.v").alias("mean"), (z * F.stddev_samp("x.v") / F.sqrt(F.count("x.v"))).alias("half"))
    return out.select("column", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def quality_tier(deviation: Column) -> Column:
    """Tier of a mean deviation from the target mix."""
    return F.when(deviation <= 0.03, "excellent").when(deviation <= 0.05, "good").otherwise("needs_improvement")
