"""Patient ETL: from raw extracts to the combined patient table, and its reports.

Every per-patient figure is one aggregation by patient joined to the demographics; a child table is
reduced before it is joined, so the joins stay one row to one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import clinical as C
from wardline.functions import fixed
from wardline.operators.quantiles import exact_quantiles


def demographics(patients: DataFrame, as_of: str, age_at_death: bool = True, adults: tuple[int, int] = (18, 100)) -> DataFrame:
    """Age at death (or at `as_of`), group and mortality of patients within the age bounds."""
    now = F.lit(as_of).cast("date")
    on = F.coalesce("deathdate", now) if age_at_death else now
    out = patients.withColumn("age", C.age_in_years(F.col("birthdate"), on)).where(F.col("age").between(*adults))
    return out.withColumn("age_group", C.age_group(F.col("age"))).withColumn("mortality", F.col("deathdate").isNotNull().cast("int"))


def patient_diagnoses(events: DataFrame, categories: Column) -> DataFrame:
    """(patient_id, diagnoses): distinct specific categories of a patient's events; `categories` is an array column."""
    sets = events.select("patient_id", F.explode(categories).alias("c")).groupBy("patient_id").agg(F.collect_set("c").alias("dx"))
    return sets.select("patient_id", C.specific_categories(F.col("dx")).alias("diagnoses"))


def coded_diagnoses(diagnoses: DataFrame) -> DataFrame:
    return patient_diagnoses(diagnoses, F.array(C.icd9_category(F.col("icd9_code"))))


def described_diagnoses(conditions: DataFrame) -> DataFrame:
    return patient_diagnoses(conditions, C.condition_categories(F.col("description")))


def counted(events: DataFrame, name: str) -> DataFrame:
    return events.groupBy("patient_id").agg(F.count("*").alias(name))


def latest_admission(admissions: DataFrame) -> DataFrame:
    """The last admission of every patient (of simultaneous ones that of the lowest id), mapped to the common vocabulary."""
    los = F.round(C.stay_days(F.col("admittime"), F.col("dischtime")), 1)
    what = F.struct(los.alias("hospital_los_days"), F.col("admission_type").alias("t"), F.col("admittime").alias("last_admission"))
    last = admissions.groupBy("patient_id").agg(F.max_by(what, F.struct("admittime", (-F.col("admission_id")).alias("i"))).alias("a"))
    kind = F.when(F.col("a.t") == "URGENT", "Urgent").when(F.col("a.t") == "ELECTIVE", "Elective").otherwise("Emergency")
    out = last.select("patient_id", "a.hospital_los_days", kind.alias("admission_type"), "a.last_admission")
    return out.withColumn("emergency_admission", (F.col("admission_type") == "Emergency").cast("int"))


def icu_summary(stays: DataFrame) -> DataFrame:
    """Summed days and number of stays in intensive care."""
    days = C.stay_days(F.col("intime"), F.col("outtime"))
    return stays.groupBy("patient_id").agg(F.round(F.sum(days), 1).alias("icu_los_days"), F.count("*").alias("icu_stays"))


def patient_table(v, as_of: str, coded: bool = True) -> DataFrame:
    """The processed patient table of one source, from views named patients, diagnoses, conditions, admissions and so on.

    Only patients with diagnoses stay. A patient without admissions counts as 3 days, Emergency.
    """
    dx = coded_diagnoses(v.diagnoses) if coded else described_diagnoses(v.conditions)
    stays = v.icustays.withColumn("outtime", F.expr("timestampadd(minute, icu_minutes, intime)"))
    admissions = v.admissions.withColumn("dischtime", F.expr("timestampadd(minute, stay_minutes, admittime)"))
    out = demographics(v.patients, as_of).join(dx, "patient_id")
    for part in (latest_admission(admissions), icu_summary(stays), counted(v.procedures, "num_procedures"), counted(v.prescriptions, "num_medications"), counted(v.admissions, "num_encounters")):
        out = out.join(part, "patient_id", "left")
    out = out.fillna({"hospital_los_days": 3.0, "admission_type": "Emergency", "emergency_admission": 1, "icu_los_days": 0.0, "icu_stays": 0, "num_procedures": 0, "num_medications": 0, "num_encounters": 0})
    out = out.withColumn("has_icu_stay", (F.col("icu_stays") > 0).cast("int"))
    return derived(out).withColumn("source", F.lit("mimic" if coded else "synthea"))


def derived(rows: DataFrame) -> DataFrame:
    """Recomputes what follows from diagnoses, age and stays."""
    dx = F.col("diagnoses")
    out = rows.withColumn("num_diagnoses", F.size(dx)).withColumn("comorbidity_score", C.comorbidity_score(dx))
    return (
        out.withColumn("risk_level", C.risk_level(F.col("age"), dx, F.col("comorbidity_score")))
        .withColumn("utilization_category", C.utilization_category(F.col("hospital_los_days"), F.col("icu_los_days"), F.col("num_procedures"), F.col("num_medications")))
        .withColumn("high_complexity", C.high_complexity(dx, F.col("comorbidity_score"), F.col("icu_los_days")))
    )


def standardised(rows: DataFrame) -> DataFrame:
    """The combined columns in order; missing ones get a default by their kind of name."""
    def default(name: str) -> Column:
        if name == "diagnoses":
            return F.array().cast("array<string>")
        if name.endswith("_days"):
            return F.lit(0.0)
        whole = name.startswith(("num_", "has_")) or name in ("age", "mortality", "emergency_admission", "comorbidity_score", "high_complexity")
        return F.lit(0) if whole else F.lit("Unknown")

    picked = [F.col(c) if c in rows.columns else default(c).alias(c) for c in fixed.COMBINED]
    return rows.select(*picked).withColumn("patient_id", F.col("patient_id").cast("string")).withColumn("age", F.col("age").cast("int"))


def combined(*tables: DataFrame) -> DataFrame:
    """Union of standardised tables with new ids PT000000, PT000001 and so on by source and old id.

    Numbers come from a count of each range of (source, id) plus the place within it. A range has the ids that
    share all but the last digits, as many as make some √n ranges of √n rows, so no single task sees all rows.
    """
    rows = standardised(tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(standardised(t))
    digits = max(1, math.ceil(math.log10(max(rows.count(), 1)) / 2))
    wide = F.when(F.length("patient_id") < 20, F.lpad("patient_id", 20, "0")).otherwise(F.col("patient_id"))
    rows = rows.withColumn("__bucket", F.substr(wide, F.lit(1), F.greatest(F.length(wide) - digits, F.lit(1))))
    within = F.row_number().over(Window.partitionBy("source", "__bucket").orderBy(wide))
    sizes = rows.groupBy("source", "__bucket").agg(F.count("*").alias("__n"))
    per_source = sizes.groupBy("source").agg(F.sum("__n").alias("__all"))
    base = per_source.withColumn("__base", F.coalesce(F.sum("__all").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("__before", before).join(base, "source").select("source", "__bucket", (F.col("__before") + F.col("__base")).alias("__start"))
    numbered = rows.withColumn("__nth", within - 1).join(starts, ["source", "__bucket"])
    return numbered.withColumn("patient_id", F.format_string("PT%06d", F.col("__start") + F.col("__nth"))).select(*fixed.COMBINED)


def combination(dx: Column) -> Column:
    return F.array_join(F.array_sort(dx), "+")


def category_counts(rows: DataFrame, total: int | None = None) -> DataFrame:
    """(category, n, share): patients with each category, and their share of all."""
    everyone = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode("diagnoses").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(everyone)).select("category", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def combination_counts(rows: DataFrame) -> DataFrame:
    everyone = rows.agg(F.count("*").alias("total"))
    counts = rows.groupBy(combination(F.col("diagnoses")).alias("combination")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(everyone)).select("combination", "n", (F.col("n") / F.col("total")).alias("share"))


def mapping_quality(rows: DataFrame) -> DataFrame:
    """Shares of patients with OTHER only, no, and several diagnoses; good below 20 % OTHER only."""
    only = (F.size("diagnoses") == 1) & F.array_contains("diagnoses", "OTHER")
    out = rows.agg(F.count("*").alias("patients"), F.avg(only.cast("double")).alias("only_other"), F.avg((F.size("diagnoses") == 0).cast("double")).alias("none"), F.avg((F.size("diagnoses") > 1).cast("double")).alias("several"))
    return out.withColumn("quality", F.when(F.col("only_other") < 0.2, "good").otherwise("needs_review"))


def enriched(rows: DataFrame, seed: str = "enrich") -> DataFrame:
    """Adds co-occurring conditions with their chance, changed by age; draws are keyed by patient and condition."""
    have, who = F.col("diagnoses"), F.col("patient_id")
    added = []
    for cause, effects in fixed.CO_OCCURRENCE.items():
        for effect, chance in effects.items():
            factor = F.lit(1.0)
            for band, factors in fixed.AGE_MODIFIERS.items():
                if effect in factors:
                    factor = F.when(F.col("age_group") == band, factors[effect]).otherwise(factor)
            drawn = C.keyed_uniform(who, f"{seed}:{cause}:{effect}") < F.least(chance * factor, F.lit(1.0))
            added.append(F.when(F.array_contains(have, cause) & ~F.array_contains(have, effect) & drawn, F.lit(effect)))
    more = F.array_union(have, F.array_compact(F.array(*added)))
    return rows.withColumn("diagnoses", C.specific_categories(more))


def target_mix(spark) -> DataFrame:
    return spark.createDataFrame([("+".join(k), v) for k, v in sorted(fixed.TARGET_MIX.items())], "combination string, target double")


def target_deviation(rows: DataFrame) -> DataFrame:
    """(combination, target, actual, deviation, off): off where it differs by over 5 points."""
    out = target_mix(rows.sparkSession).join(combination_counts(rows), "combination", "left")
    out = out.select("combination", "target", F.coalesce("share", F.lit(0.0)).alias("actual"))
    return out.withColumn("deviation", F.abs(F.col("target") - F.col("actual"))).withColumn("off", F.col("deviation") > 0.05)


def balanced(rows: DataFrame, size: int, seed: str = "balance") -> DataFrame:
    """A sample of `size` rows in the target mix: for each combination exact matches, filled up with replicas.

    (replica, rows...): replica 0 is the row itself. A combination nobody has is left out; the rest of
    `size` is not filled. Ranks are by a keyed digest, within buckets of it first, so no task orders a
    whole combination.
    """
    target = target_mix(rows.sparkSession).withColumn("want", F.round(F.col("target") * size).cast("bigint"))
    ranked = rows.withColumn("combination", combination(F.col("diagnoses"))).withColumn("__h", F.md5(F.concat_ws(":", F.col("patient_id").cast("string"), F.lit(seed))))
    ranked = ranked.withColumn("__b", F.substring("__h", 1, 3))
    within = F.row_number().over(Window.partitionBy("combination", "__b").orderBy("__h", "patient_id")) - 1
    sizes = ranked.groupBy("combination", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("combination").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_of = sizes.groupBy("combination").agg(F.sum("__n").alias("have"))
    ranked = ranked.withColumn("__w", within).join(sizes.withColumn("__before", before).drop("__n"), ["combination", "__b"])
    ranked = ranked.withColumn("place", F.col("__w") + F.col("__before")).join(all_of.join(target, "combination"), "combination")
    times = F.floor((F.col("want") - F.col("place") - 1 + F.col("have")) / F.col("have"))
    out = ranked.withColumn("copies", times).where("copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    return out.select(*rows.columns, "combination", "replica")


def numeric_summary(rows: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Long form (group, column, n, mean, std, min, median, max) of numeric columns; medians are exact, from ranked value counts."""
    stacked = rows.select(*([F.col(by).alias("group")] if by else [F.lit("all").alias("group")]), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    out = stacked.groupBy("group", F.col("x.column").alias("column")).agg(
        F.count("x.v").alias("n"), F.avg("x.v").alias("mean"), F.stddev_samp("x.v").alias("std"), F.min("x.v").alias("min"), F.max("x.v").alias("max"))
    medians = exact_quantiles(rows, columns, [0.5], by).select(F.col("group").alias("g"), F.col("column").alias("c"), F.col("value").alias("median"))
    out = out.join(medians, F.col("group").cast("string").eqNullSafe(F.col("g")) & (F.col("column") == F.col("c")), "left")
    return out.select("group", "column", "n", "mean", "std", "min", "median", "max")


def value_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (column, value, n, share) of categorical columns."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    counts = stacked.groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def within_dates(rows: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows whose text or date in `column` parses and lies within the bounds; it becomes a timestamp."""
    return rows.withColumn(column, F.try_to_timestamp(F.col(column).cast("string"))).where(F.col(column).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))


def cleaned(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    """`rows` without repeated rows; a required column that is missing is an error."""
    if missing := [c for c in required or [] if c not in rows.columns]:
        raise ValueError(f"missing required columns: {missing}")
    return rows.dropDuplicates()
