"""Reproducible sampling and synthetic rows: all draws are keyed by row, not by partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import clinical as C
from wardline.functions import fixed


def icu_chance(age: Column, dx: Column) -> Column:
    """Chance of intensive care: the highest of the conditions', by age, and a tenth more for each further one, at most .9."""
    each = F.transform(dx, lambda d: _looked_up(d, fixed.ICU_CHANCE, 0.2))
    factor = F.when(age >= 80, 1.3).when(age >= 65, 1.2).when(age < 40, 0.8).otherwise(1.0)
    return F.least(F.array_max(each) * factor * (1.0 + (F.size(dx) - 1) * 0.1), F.lit(0.9))


def _looked_up(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(value == k, v).otherwise(out)
    return out


def choice(u: Column, options: dict[str, float]) -> Column:
    """The option at a uniform number by cumulative probability."""
    out, total = F.lit(list(options)[-1]), sum(options.values())
    acc = total
    for name in list(options)[-2::-1]:
        acc -= options[list(options)[list(options).index(name) + 1]]
        out = F.when(u < acc / total, name).otherwise(out)
    return out


def erlang(shape: int, scale: float, *keys: Column | str) -> Column:
    """A gamma draw of whole shape: the sum of exponentials."""
    draws = [-F.log(F.greatest(1 - C.keyed_uniform(*keys, f"gamma{i}"), F.lit(1e-12))) for i in range(shape)]
    return scale * sum(draws[1:], draws[0])


def normal(*keys: Column | str) -> Column:
    """A standard normal draw (Box and Muller)."""
    u, v = F.greatest(C.keyed_uniform(*keys, "radius"), F.lit(1e-12)), C.keyed_uniform(*keys, "angle")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def gamma(shape: float, scale: float, *keys: Column | str) -> Column:
    """A gamma draw of whole or half shape, exactly: a half is half a squared normal draw more."""
    whole, half = int(shape), shape != int(shape)
    return erlang(whole, scale, *keys) + scale * F.pow(normal(*keys), 2) / 2 if half else erlang(whole, scale, *keys)


def laplace(scale: Column | float, *keys: Column | str) -> Column:
    """A Laplace draw by the inverse distribution."""
    u = C.keyed_uniform(*keys, "laplace") - 0.5
    return -scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def simulated_stays(rows: DataFrame) -> DataFrame:
    """`rows` with simulated intensive care and hospital stays, admission type and insurance."""
    who = F.col("patient_id")
    icu = (C.keyed_uniform(who, "icu") < icu_chance(F.col("age"), F.col("diagnoses"))).cast("int")
    has = lambda d: F.array_contains("diagnoses", d)
    days = (
        F.when(has("SEPSIS"), gamma(2, 3.0, who, "icu")).when(has("NEUROLOGICAL"), gamma(3, 4.0, who, "icu")).when(has("RESPIRATORY"), gamma(3.5, 2.5, who, "icu"))
        .when(has("CARDIOVASCULAR"), gamma(2, 1.5, who, "icu")).otherwise(gamma(2.5, 1.8, who, "icu"))
    )
    out = rows.withColumn("has_icu_stay", icu).withColumn("icu_los_days", F.when(F.col("has_icu_stay") == 1, F.round(C.clip(days, 1, 30), 1)).otherwise(0.0))
    hospital = F.when(F.col("icu_los_days") > 0, F.col("icu_los_days") + gamma(2, 3.0, who, "los")).otherwise(gamma(2.5, 1.5, who, "los"))
    u, v = C.keyed_uniform(who, "admission"), C.keyed_uniform(who, "insurance")
    kind = F.when(F.col("has_icu_stay") == 1, choice(u, {"Emergency": 0.7, "Urgent": 0.2, "Elective": 0.1})).otherwise(choice(u, {"Emergency": 0.4, "Urgent": 0.3, "Elective": 0.3}))
    payer = (
        F.when(F.col("age") >= 65, choice(v, {"Medicare": 0.8, "Medicaid": 0.1, "Private": 0.08, "Self Pay": 0.02}))
        .when(F.col("age") >= 18, choice(v, {"Medicare": 0.1, "Medicaid": 0.3, "Private": 0.55, "Self Pay": 0.05})).otherwise(choice(v, {"Medicare": 0.05, "Medicaid": 0.4, "Private": 0.5, "Self Pay": 0.05}))
    )
    out = out.withColumn("hospital_los_days", F.round(C.clip(hospital, 1, 60), 1)).withColumn("admission_type", kind).withColumn("insurance", payer)
    return out.withColumn("emergency_admission", (F.col("admission_type") == "Emergency").cast("int"))


def generation_multiplier(conditions: Column, age_span: Column, has_gender: Column, critical: Column) -> Column:
    """How many times more rows to draw than asked for, at most 10."""
    return F.least(2 + conditions + F.when(age_span < 20, 2).otherwise(0) + has_gender.cast("int") + F.when(critical, 2).otherwise(0), F.lit(10))


def bootstrap(rows: DataFrame, n: int, seed: str = "bootstrap", key: str = "patient_id") -> DataFrame:
    """About `n` rows drawn with replacement: each row gets a keyed Poisson number of replicas (replica, from 0).

    The total is near `n`; no row is numbered and nothing is sorted, so it stays one pass and a count.
    """
    rate = n / max(1, rows.count())
    if rate > 100:  # then the normal draw is as good, and the ladder of probabilities would be long
        copies = F.greatest(F.round(rate + math.sqrt(rate) * normal(F.col(key), seed)), F.lit(0)).cast("int")
    else:  # by inversion: the number of cumulative probabilities at or below u
        u, p, cumulative, ladder = C.keyed_uniform(F.col(key), seed), math.exp(-rate), 0.0, []
        for k in range(int(rate + 12 * math.sqrt(rate) + 12)):
            cumulative += p
            ladder.append(F.when(u >= cumulative, 1).otherwise(0))
            p *= rate / (k + 1)
        copies = sum(ladder[1:], ladder[0])
    return rows.withColumn("__n", copies).where("__n > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def exact_sample(rows: DataFrame, n: int, seed: str = "sample", key: str = "patient_id") -> DataFrame:
    """The `n` rows with the least keyed digest: a top-k, without replacement."""
    return rows.withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))).orderBy("__h", key).limit(n).drop("__h")


def gender_quota(rows: DataFrame, n: int, share: float, seed: str = "quota") -> DataFrame:
    """`n` rows of which `share` are female as far as there are enough, the rest male."""
    female = exact_sample(rows.where("gender = 'f'"), round(n * share), seed)
    return female.unionByName(exact_sample(rows.where("gender = 'm'"), n - round(n * share), seed))


def training_features(rows: DataFrame) -> DataFrame:
    """The patient columns with the primary diagnosis and a 0/1 column for each category."""
    flags = [F.array_contains("diagnoses", n).cast("int").alias(f"has_{n.lower()}") for n in fixed.KEYWORDS]
    return rows.select(
        "patient_id", C.clip(F.col("age"), 18, 100).cast("int").alias("age"), "gender", "ethnicity", "insurance", "admission_type", "num_diagnoses", "num_procedures", "num_medications",
        C.clip(F.col("hospital_los_days"), 0, 60).alias("hospital_los_days"), C.clip(F.col("icu_los_days"), 0, 30).alias("icu_los_days"), "has_icu_stay", "mortality", "emergency_admission",
        "age_group", "comorbidity_score", "high_complexity", "risk_level", "utilization_category", F.coalesce(F.get("diagnoses", F.lit(0)), F.lit("OTHER")).alias("primary_diagnosis"), *flags)


def clinically_constrained(rows: DataFrame) -> DataFrame:
    """Repairs synthetic rows: bounds, intensive care within the hospital stay, flags in line with days."""
    icu = F.round(C.clip(F.col("icu_los_days"), 0, 30), 1)
    out = rows.withColumn("age", C.clip(F.col("age"), 18, 100).cast("int")).withColumn("icu_los_days", icu)
    out = out.withColumn("hospital_los_days", F.greatest(F.round(C.clip(F.col("hospital_los_days"), 1, 60), 1), F.col("icu_los_days")))
    return out.withColumn("has_icu_stay", (F.col("icu_los_days") > 0).cast("int"))


def shifted_and_scaled(rows: DataFrame, column: str, mean: float, std: float) -> DataFrame:
    """The column moved to a mean and standard deviation."""
    facts = rows.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    out = rows.crossJoin(F.broadcast(facts))  # one row
    return out.withColumn(column, F.when(F.col("__s") > 0, (F.col(column) - F.col("__m")) / F.col("__s") * std + mean).otherwise(F.lit(mean))).drop("__m", "__s")


def noisy(rows: DataFrame, column: str, epsilon: float, low: float, high: float, key: str = "patient_id") -> DataFrame:
    """Laplace noise of scale range / epsilon on one column, kept in bounds. Not a privacy guarantee."""
    return rows.withColumn(column, C.clip(F.col(column) + laplace((high - low) / epsilon, F.col(key), column), low, high))


def augmented(rows: DataFrame, flag: str, least: float = 0.3, key: str = "patient_id") -> DataFrame:
    """Rows with `flag` = 1 repeated until they are `least` of the others (column `replica`)."""
    n = rows.agg(F.count_if(F.col(flag) == 1).alias("p"), F.count_if(F.col(flag) == 0).alias("q")).first()
    whole, part = divmod(max(1.0, least * n.q / n.p) if n.p else 1.0, 1.0)
    copies = F.when(F.col(flag) == 1, int(whole) + (C.keyed_uniform(F.col(key), f"augment:{flag}") < part).cast("int")).otherwise(1)
    return rows.withColumn("replica", F.explode(F.sequence(F.lit(0), copies - 1)))


def outcomes_redrawn(rows: DataFrame) -> DataFrame:
    """Mortality drawn anew by age (.05, from 50 .15, from 70 .30), emergency by intensive care (.80, else .45), and stays longer with comorbidity.

    Stays grow by three tenths for each score point above one, and are kept at least as long as those in intensive care.
    """
    who, age = F.col("patient_id"), F.col("age")
    chance = F.when(age >= 70, 0.30).when(age >= 50, 0.15).otherwise(0.05)
    longer = F.col("hospital_los_days") * (1 + 0.3 * F.greatest(F.col("comorbidity_score") - 1, F.lit(0)))
    out = rows.withColumn("mortality", (C.keyed_uniform(who, "mortality") < chance).cast("int"))
    out = out.withColumn("emergency_admission", (C.keyed_uniform(who, "emergency") < F.when(F.col("has_icu_stay") == 1, 0.8).otherwise(0.45)).cast("int"))
    return out.withColumn("hospital_los_days", F.greatest(F.round(C.clip(longer, 1, 60), 1), F.col("icu_los_days")))


def forced(rows: DataFrame, diagnoses: tuple[str, ...]) -> DataFrame:
    """Rows that all have the wanted conditions."""
    return rows.withColumn("diagnoses", C.specific_categories(F.array_union("diagnoses", F.array(*[F.lit(d) for d in diagnoses]))))


def discrete_columns(rows: DataFrame, most: int = 10) -> list[str]:
    """Columns to treat as categories: text, and whole numbers of at most `most` values, in one pass."""
    whole = [f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "short", "byte")]
    kinds = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in whole]).first() if whole else {}
    return [f.name for f in rows.schema if f.dataType.typeName() == "string" or f.name in whole and kinds[f.name] <= most]


# Levels of categorical columns, and what stands for any other.
LEVELS = {"gender": (["male", "female", "unknown"], "unknown"), "risk_level": (["low", "medium", "high", "critical"], "medium"), "utilization_category": (["low", "medium", "high"], "medium")}


def rebuilt_diagnoses(rows: DataFrame, flags: list[str]) -> DataFrame:
    """`rows` with diagnoses and their number rebuilt from 0/1 columns has_...; none is OTHER."""
    found = F.array_compact(F.array(*[F.when(F.col(c) == 1, c.removeprefix("has_").upper()) for c in flags]))
    listed = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("OTHER")))
    return rows.withColumn("diagnoses", listed).withColumn("num_diagnoses", F.size("diagnoses"))


def repaired_categories(rows: DataFrame) -> DataFrame:
    """`rows` with unknown levels of categorical columns set to their default, and the age group derived from the age."""
    out = rows.withColumns({c: F.when(F.col(c).isin(levels), F.col(c)).otherwise(default) for c, (levels, default) in LEVELS.items() if c in rows.columns})
    return out.withColumn("age_group", C.age_group(F.col("age"))) if {"age", "age_group"} <= set(rows.columns) else out
