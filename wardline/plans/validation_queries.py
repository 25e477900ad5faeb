"""Queries of validation, fidelity and sampling, over the patient table and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import clinical as C
from wardline.operators import sampling as S
from wardline.operators import validation as V
from wardline.plans.base_sql import BASE
from wardline.plans.etl_queries import patients
from wardline.plans.registry import registry
from wardline.sources.views import AS_OF, Views, with_clauses

QUERIES, SQL, query = registry()
NUMBERS = ["age", "hospital_los_days", "icu_los_days", "comorbidity_score"]


def rounded(rows, *columns, to=6):
    return rows.withColumns({c: F.round(F.col(c), to) for c in columns})


def _unpivot(source: str, columns, name="column_name") -> str:
    cast = ", ".join(f"cast({c} as double) as {c}" for c in columns)
    return f"(unpivot (select {cast} from {source}) on {', '.join(columns)} into name {name} value v)"


@query(BASE + f"""select column_name as "column", count(v) as n, count_if(case when column_name = 'age' then v not between 0 and 120 when column_name = 'hospital_los_days' then v not between 0 and 365 when column_name = 'icu_los_days' then v not between 0 and 180 end) as out_of_range,
  round(greatest(0, 1 - 5.0 * count_if(case when column_name = 'age' then v not between 0 and 120 when column_name = 'hospital_los_days' then v not between 0 and 365 when column_name = 'icu_los_days' then v not between 0 and 180 end) / count(v)), 6) as score, false as critical
from {_unpivot('pt', NUMBERS[:3])} group by 1""")
def clinical_ranges(spark, sf_dir):
    return rounded(V.range_checks(patients(spark, sf_dir), NUMBERS[:3]), "score")


@query(BASE + "select count_if(age not between 0 and 120) as bad_ages, round(avg(age), 6) as mean_age, round(least(avg(cast(gender = 'm' as double)), 1 - avg(cast(gender = 'm' as double))), 6) as minority, avg(age) between 30 and 75 as mean_age_ok, least(avg(cast(gender = 'm' as double)), 1 - avg(cast(gender = 'm' as double))) >= 0.2 as balance_ok from pt")
def demographic_checks(spark, sf_dir):
    return rounded(V.demographic_checks(patients(spark, sf_dir)), "mean_age", "minority")


@query(BASE + """, p as (select a, unnest(diagnoses) as b from (select unnest(diagnoses) as a, diagnoses from pt)), c as (select a, b, count(*) as n from p group by 1, 2)
select c.a, c.b, c.n, round(c.n / w.n, 6) as share_of_a from c join c w on w.a = c.a and w.b = c.a where c.a <> c.b""")
def comorbidity_pairs(spark, sf_dir):
    return rounded(V.pair_counts(patients(spark, sf_dir)), "share_of_a")


# Literals of the SQL's own, so that a cut list of the library shows.
_EXPECTED = {
    "DIABETES": ["HYPERTENSION", "CARDIOVASCULAR", "RENAL", "OBESITY"], "HYPERTENSION": ["CARDIOVASCULAR", "DIABETES", "RENAL", "STROKE"], "CARDIOVASCULAR": ["HYPERTENSION", "DIABETES", "HYPERLIPIDEMIA"],
    "RESPIRATORY": ["CARDIOVASCULAR", "SMOKING_RELATED"], "RENAL": ["DIABETES", "HYPERTENSION", "CARDIOVASCULAR"], "CANCER": ["ANEMIA", "MALNUTRITION"],
}
_PARTNERS = " union all ".join(f"select '{c}' as condition, count(*) as n, count_if(list_has_any(diagnoses, {ps})) as with_partner from pt where list_contains(diagnoses, '{c}')" for c, ps in _EXPECTED.items())


@query(BASE + f"select *, round(with_partner / n, 6) as share from ({_PARTNERS}) where n >= 10")
def comorbidity_checks(spark, sf_dir):
    return rounded(V.comorbidity_checks(patients(spark, sf_dir)), "share")


@query(BASE + "select count(*) as n, count_if(icu_los_days > hospital_los_days) as icu_over_hospital, count_if(has_icu_stay = 0 and icu_los_days > 0) as days_without_stay, count_if(len(diagnoses) = 0) as no_diagnosis, count_if(emergency_admission = 1 and admission_type <> 'Emergency') as emergency_mismatch from pt")
def consistency_checks(spark, sf_dir):
    return V.consistency(patients(spark, sf_dir))


_SPARSE = ["deathdate", "gender", "last_admission", "insurance"]


@query(BASE + "select * from (" + " union all ".join(f"""select '{c}' as "column", count_if({c} is null) as nulls, round(avg(cast({c} is null as double)), 6) as null_rate, avg(cast({c} is null as double)) > 0.5 as flagged from pt""" for c in _SPARSE) + ")")
def completeness(spark, sf_dir):
    return rounded(V.completeness(patients(spark, sf_dir).select(*_SPARSE)), "null_rate")


_PREV = " union all ".join(f"select '{c}' as condition, {r}::double as expected, {lo}::double as lo, {hi}::double as hi, avg(cast(list_contains(diagnoses, '{c}') as double)) as observed, count(*) as n from pt" for c, (r, lo, hi) in V.PREVALENCE.items())


@query(BASE + f"select condition, expected, round(observed, 6) as observed, n, round((observed - expected) / sqrt(expected * (1 - expected) / n), 6) as z, observed between lo and hi as within from ({_PREV})")
def prevalence_ztest(spark, sf_dir):
    return rounded(V.prevalence_test(patients(spark, sf_dir)).drop("p"), "observed", "z")


_CO = " union all ".join(f"select '{a}' as a, '{b}' as b, {r}::double as expected, avg(cast(list_contains(diagnoses, '{b}') as double)) as observed from pt where list_contains(diagnoses, '{a}') having count(*) > 0" for (a, b), r in V.CO_OCCURRENCE.items())


@query(BASE + f"select a, b, expected, round(observed, 6) as observed, observed / expected between 0.5 and 2.0 as plausible from ({_CO})")
def cooccurrence(spark, sf_dir):
    return rounded(V.co_occurrence_test(patients(spark, sf_dir)), "observed")


_TAGS = [("normal pregnancy", "PREGNANCY"), ("diabetes mellitus (type 2)", "TYPE2_DIABETES"), ("acute bronchitis", "COPD"), ("seizure", "MENOPAUSE"), ("stroke", "ALZHEIMER")]
_TAG_SQL = ", ".join(f"max(case when contains(lower(description), '{w}') then '{t}' end)" for w, t in _TAGS)


def _tagged(spark, sf_dir):
    """Patients with conditions as tags; the descriptions of the test data stand for those that the rules name."""
    v = Views(spark, sf_dir)
    tags = v.conditions.groupBy("patient_id").agg(F.array_compact(F.array(*[F.max(F.when(F.lower("description").contains(w), t)) for w, t in _TAGS])).alias("conditions"))
    typed = F.when(F.col("patient_id") % 9 == 0, F.array_append("conditions", "TYPE1_DIABETES")).otherwise(F.col("conditions"))
    young = F.year(F.lit(AS_OF).cast("date")) - F.year("birthdate")
    return v.patients.join(tags, "patient_id").select("gender", young.alias("age"), typed.alias("conditions"))


@query(f"""with {with_clauses('patients', 'conditions')}, t as (select patient_id, list_filter([{_TAG_SQL}], lambda x: x is not null) as l from conditions group by 1),
r as (select gender, 2026 - year(birthdate) as age, case when patient_id % 9 = 0 then list_append(l, 'TYPE1_DIABETES') else l end as c from patients join t using (patient_id))
select * from (select 'PEDIATRIC+ALZHEIMER' as rule, 'critical' as severity, count_if(age < 18 and list_contains(c, 'ALZHEIMER')) as n from r
union all select 'TYPE1_DIABETES+TYPE2_DIABETES', 'critical', count_if(list_contains(c, 'TYPE1_DIABETES') and list_contains(c, 'TYPE2_DIABETES')) from r
union all select 'PREGNANCY+MALE', 'critical', count_if(list_contains(c, 'PREGNANCY') and gender = 'm') from r
union all select 'COPD<30', 'high', count_if(list_contains(c, 'COPD') and age < 30) from r union all select 'MENOPAUSE<40', 'medium', count_if(list_contains(c, 'MENOPAUSE') and age < 40) from r)""")
def implausible_rules(spark, sf_dir):
    return V.implausible(_tagged(spark, sf_dir))


@query(BASE + """select 'overall_icu' as cohort, round(avg(mortality), 6) as observed, count(*) as n, 0.15::double as expected, avg(mortality) < 0.06 or avg(mortality) > 0.36 as flagged from pt where has_icu_stay = 1 having count(*) > 0
union all select 'sepsis', round(avg(mortality), 6), count(*), 0.25, avg(mortality) < 0.10 or avg(mortality) > 0.60 from pt where list_contains(diagnoses, 'SEPSIS') having count(*) > 0
union all select 'respiratory_failure', round(avg(mortality), 6), count(*), 0.20, avg(mortality) < 0.075 or avg(mortality) > 0.50 from pt where list_contains(diagnoses, 'RESPIRATORY') having count(*) > 0""")
def mortality_bounds(spark, sf_dir):
    return rounded(V.mortality_bounds(patients(spark, sf_dir)), "observed")


_DISPOSED = ", e as (select *, case patient_id % 5 when 0 then 'Home' when 1 then 'SNF' when 2 then 'Rehabilitation' else 'Expired' end as discharge_disposition, 50 + patient_id * 37 % 200 as glucose from pt)"


def _disposed(spark, sf_dir):
    k = F.col("patient_id") % 5
    return patients(spark, sf_dir).withColumn("discharge_disposition", F.when(k == 0, "Home").when(k == 1, "SNF").when(k == 2, "Rehabilitation").otherwise("Expired")).withColumn("glucose", 50 + F.col("patient_id") * 37 % 200)


@query(BASE + _DISPOSED + """, f as (select count(*) as n, count_if(icu_los_days > hospital_los_days) as icu_over_hospital, count_if(mortality = 1 and lower(discharge_disposition) in ('home', 'rehabilitation', 'snf')) as dead_but_discharged,
  count_if(list_contains(diagnoses, 'DIABETES') and glucose < 70) as low_glucose, count_if(list_contains(diagnoses, 'DIABETES')) as d from e)
select n, icu_over_hospital, dead_but_discharged, low_glucose, low_glucose > 0.3 * d as glucose_flagged, round(greatest(0, 1 - (icu_over_hospital + dead_but_discharged) / n), 6) as score, 1 - (icu_over_hospital + dead_but_discharged) / n >= 0.9 as passed from f""")
def clinical_consistency(spark, sf_dir):
    return rounded(V.clinical_consistency(_disposed(spark, sf_dir)), "score")


_MEDS = "meds as (select p_partkey as id, concat('on ', case p_size % 6 when 0 then 'Glyburide' when 1 then 'rosiglitazone' when 2 then 'metformin' when 3 then 'Cisapride for NIDDM' when 4 then 'juvenile diabetes care' else 'aspirin' end) as note from {part})"
_OUT = " union all ".join(f"select '{t}' as term, '{s}' as severity, count(*) as n from meds where contains(lower(note), '{t}') having count(*) > 0" for t, s in V.OUTDATED.items())


def _meds(spark, sf_dir):
    return spark.sql(f"with {_MEDS} select * from meds", part=Views(spark, sf_dir).part)


@query(f"with {_MEDS.format(part='part')} select * from ({_OUT})")
def outdated_terms(spark, sf_dir):
    return V.outdated_terms(_meds(spark, sf_dir), F.col("note"))


@query(f"with {_MEDS.format(part='part')} select round(greatest(0, 1 - sum(case severity when 'critical' then 0.2::double when 'high' then 0.1 when 'medium' then 0.05 else 0.02 end * least(10.0 * n / (select count(*) from meds), 1))), 6) as currency from ({_OUT})")
def currency_score(spark, sf_dir):
    meds = _meds(spark, sf_dir)
    return rounded(V.currency_score(V.outdated_terms(meds, F.col("note")), meds.count()), "currency")


@query(f"with {with_clauses('patients', 'admissions')}, a as (select *, admittime + to_minutes(stay_minutes) as dischtime from admissions join patients using (patient_id)) " + """select * from (select 'admission_after_discharge' as rule, count_if(admittime > dischtime) as n from a
union all select 'death_before_admission', count_if(deathdate < cast(admittime as date)) from a union all select 'after_reference', count_if(cast(dischtime as date) > date '1998-07-15') from a union all select 'before_1900', count_if(year(admittime) < 1900) from a)""")
def temporal_rules(spark, sf_dir):
    v = Views(spark, sf_dir)
    rows = v.admissions.withColumn("dischtime", F.expr("timestampadd(minute, stay_minutes, admittime)")).join(v.patients, "patient_id")
    return V.temporal_violations(rows, "1998-07-15")


@query(f"""with m as (select column_name as "column", avg(v) as mean, stddev_samp(v) as std, kurtosis_pop(v) as kurtosis from {_unpivot('lineitem', ['l_quantity', 'l_extendedprice', 'l_tax'])} group by 1)
select m."column", round(mean, 6) as mean, round(std, 6) as std, round(kurtosis, 6) as kurtosis, count_if(abs(v - mean) > 1.5 * std) as outliers, count(v) as n, round(count_if(abs(v - mean) > 1.5 * std) / count(v), 6) as share
from {_unpivot('lineitem', ['l_quantity', 'l_extendedprice', 'l_tax'])} u join m on m."column" = u.column_name group by 1, mean, std, kurtosis""")
def outlier_share(spark, sf_dir):
    out = V.outlier_shares(Views(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice", "l_tax"], 1.5)
    return rounded(out, "mean", "std", "kurtosis", "share")


@query(BASE + """, f as (select avg(age) as m1, stddev_samp(age) as s1, avg(hospital_los_days) as m2, stddev_samp(hospital_los_days) as s2 from pt), g as (select age, hospital_los_days, count(*) as n from pt group by all)
select s.patient_id, round(min(case when s.age = p.age and s.hospital_los_days = p.hospital_los_days then case when p.n > 1 then 0.0 end
  else sqrt(power((s.age - p.age) / s1, 2) + power((s.hospital_los_days - p.hospital_los_days) / s2, 2)) end), 6) as distance from (select * from pt where patient_id % 20 = 0) s, g p, f group by 1""")
def closest_record(spark, sf_dir):
    """Every patient whose number is divisible by 20, against all others."""
    rows = patients(spark, sf_dir).select("patient_id", "age", "hospital_los_days")
    return rounded(V.closest_records(rows, rows.where("patient_id % 20 = 0"), ["age", "hospital_los_days"], "patient_id", own=True), "distance")


@query("""with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) as bigint) as bin, round(lo + least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20), 6) as low, count(*) as n from lineitem, e group by 1, 2""")
def histogram20(spark, sf_dir):
    return rounded(V.histogram(Views(spark, sf_dir).lineitem, "l_extendedprice"), "low")


@query("select cast(sum(c) as bigint) as n, count(*) as distinct_keys, count_if(c > 1) as repeated_keys from (select l_orderkey, count(*) as c from lineitem group by 1)")
def uniqueness(spark, sf_dir):
    return V.uniqueness(Views(spark, sf_dir).lineitem, "l_orderkey")


_REPORTED = ["age", "gender", "insurance", "deathdate", "diagnoses", "hospital_los_days", "icu_los_days", "mortality", "discharge_disposition"]
_PATTERN = ", ".join(f"case when count_if(list_contains(diagnoses, '{c}')) >= 10 then case when count_if(list_contains(diagnoses, '{c}') and list_has_any(diagnoses, {ps})) > 0 then 1.0::double else 0.5 end end" for c, ps in _EXPECTED.items())
_REPORT = BASE + _DISPOSED + f""", r as (select greatest(0, 1 - 5 * avg(cast(age not between 0 and 120 or hospital_los_days not between 0 and 365 as double))) as a, greatest(avg(cast(age not between 0 and 120 as double)), avg(cast(hospital_los_days not between 0 and 365 as double))) > 0.1 as far,
  case when avg(age) between 30 and 75 then 1.0::double else 0.7 end - case when least(avg(cast(gender = 'm' as double)), 1 - avg(cast(gender = 'm' as double))) < 0.2 then 0.2 else 0 end as b, coalesce(list_avg(list_filter([{_PATTERN}], lambda x: x is not null)), 0.8) as c,
  count_if(icu_los_days > hospital_los_days) as longer, count_if(mortality = 1 and lower(discharge_disposition) in ('home', 'rehabilitation', 'snf')) as dead, 1 - ({' + '.join(f'count_if({c} is null)' for c in _REPORTED)}) / (count(*) * {len(_REPORTED)}.0::double) as e, count(*) as n from e),
k as (select 'ranges' as "check", a as score, 1.5::double as weight, a >= 0.7 as passed, 0 as errors, cast(far as integer) as critical from r union all select 'demographics', b, 1.0, b >= 0.7, 0, 0 from r union all select 'comorbidity', c, 1.2, c >= 0.7, 0, 0 from r
  union all select 'consistency', greatest(0, 1 - (longer + dead) / n), 1.3, 1 - (longer + dead) / n >= 0.9, cast(longer > 0 as integer), cast(dead > 0 as integer) from r union all select 'completeness', e, 0.8, e >= 0.7, 0, 0 from r)"""


@query(_REPORT + """ select "check", round(score, 6) as score, weight, passed, errors, critical from k""")
def validation_report(spark, sf_dir):
    return rounded(V.report(_disposed(spark, sf_dir).select(*_REPORTED)), "score")


@query(_REPORT + " select round(sum(score * weight) / sum(weight), 6) as score, count_if(not passed) as failed, cast(sum(errors) as bigint) as errors, cast(sum(critical) as bigint) as critical, sum(score * weight) / sum(weight) >= 0.7 and sum(errors) <= 2 and sum(critical) = 0 as valid from k")
def validation_verdict(spark, sf_dir):
    return rounded(V.verdict(V.report(_disposed(spark, sf_dir).select(*_REPORTED))), "score")


@query(BASE + "select round(avg(rk), 6) as mean_rank, count(*) as n from (select patient_id, (rank() over (order by hospital_los_days) + (count(*) over (partition by hospital_los_days) - 1) / 2.0) / count(*) over () as rk from pt)")
def percentile_band(spark, sf_dir):
    """Mean percentile of score by value counts, so equal stays share a rank."""
    from pyspark.sql.window import Window

    counts = patients(spark, sf_dir).groupBy("hospital_los_days").agg(F.count("*").alias("c"))
    w = Window.orderBy("hospital_los_days").rowsBetween(Window.unboundedPreceding, -1)  # one row for each tenth of a day
    ranks = counts.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return ranks.agg(F.round(F.sum(F.col("c") * (F.col("below") + 1 + (F.col("c") - 1) / 2.0) / F.col("n")) / F.first("n"), 6).alias("mean_rank"), F.first("n").alias("n"))


@query(BASE + """select patient_id, primary_diagnosis, has_diabetes + has_cancer as flags from (select patient_id, coalesce(diagnoses[1], 'OTHER') as primary_diagnosis, cast(list_contains(diagnoses, 'DIABETES') as integer) as has_diabetes, cast(list_contains(diagnoses, 'CANCER') as integer) as has_cancer from pt)""")
def training_features(spark, sf_dir):
    return S.training_features(patients(spark, sf_dir)).select("patient_id", "primary_diagnosis", (F.col("has_diabetes") + F.col("has_cancer")).alias("flags"))


@query(BASE + "select patient_id, greatest(round(least(greatest(hospital_los_days, 1), 60), 1), round(least(greatest(icu_los_days, 0), 30), 1)) as hospital_los_days, round(least(greatest(icu_los_days, 0), 30), 1) as icu_los_days from pt")
def constraint_clip(spark, sf_dir):
    return S.clinically_constrained(patients(spark, sf_dir)).select("patient_id", "hospital_los_days", "icu_los_days")


@query(BASE + ", f as (select avg(age) as m, stddev_samp(age) as s from pt) select patient_id, round((age - m) / s * 10 + 60, 6) as age from pt, f")
def distribution_shift(spark, sf_dir):
    return rounded(S.shifted_and_scaled(patients(spark, sf_dir).select("patient_id", F.col("age").cast("double").alias("age")), "age", 60.0, 10.0), "age")


_H = "md5(cast(patient_id as varchar) || ':quota')"


@query(BASE + f"select patient_id, gender from ((select * from pt where gender = 'f' order by {_H}, patient_id limit 150) union all (select * from pt where gender = 'm' order by {_H}, patient_id limit 50))")
def soft_gender_quota(spark, sf_dir):
    return S.gender_quota(patients(spark, sf_dir), 200, 0.75).select("patient_id", "gender")


@query()
def bootstrap_fill(spark, sf_dir):
    return S.bootstrap(patients(spark, sf_dir).select("patient_id", "age"), 3000)


@query(BASE + "select gender, count_if(cast('0x' || substr(md5(cast(patient_id as varchar) || ':coin'), 1, 8) as bigint) / 4294967296.0 < 0.3) as heads, count(*) as n from pt group by 1")
def seeded_bernoulli(spark, sf_dir):
    return patients(spark, sf_dir).groupBy("gender").agg(F.count_if(C.keyed_uniform(F.col("patient_id"), "coin") < 0.3).alias("heads"), F.count("*").alias("n"))


@query()
def laplace_noise(spark, sf_dir):
    rows = patients(spark, sf_dir).select("patient_id", F.col("hospital_los_days"))
    return S.noisy(rows, "hospital_los_days", 1.0, 0.0, 60.0)


@query()
def simulated_stays(spark, sf_dir):
    rows = patients(spark, sf_dir).select("patient_id", "age", "diagnoses")
    return S.simulated_stays(rows).drop("diagnoses")


@query()
def augmented_training(spark, sf_dir):
    return S.augmented(patients(spark, sf_dir).select("patient_id", "mortality"), "mortality")


@query()
def rf_utility(spark, sf_dir):
    rows = patients(spark, sf_dir)
    return V.utility(rows.where("patient_id % 2 = 0"), rows.where("patient_id % 2 = 1"), ["age", "num_diagnoses", "hospital_los_days", "icu_los_days"], "high_complexity")
