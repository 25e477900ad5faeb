"""Queries of the patient ETL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import clinical as C
from wardline.functions import fixed
from wardline.operators import balance, etl
from wardline.plans import nl
from wardline.plans.base_sql import BASE, ICD9, SPECIFIC
from wardline.plans.registry import registry
from wardline.sources.views import AS_OF, Views, with_clauses

QUERIES, SQL, query = registry()
PLAIN = ["patient_id", "age", "gender", "ethnicity", "insurance", "age_group", "mortality", "hospital_los_days", "icu_los_days", "icu_stays", "num_procedures", "num_medications", "num_encounters",
         "num_diagnoses", "comorbidity_score", "risk_level", "utilization_category", "high_complexity", "admission_type", "emergency_admission", "has_icu_stay"]


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.patient_table(Views(spark, sf_dir), AS_OF)


@query(BASE + """select age_group, count(*) as patients, round(avg(age), 6) as mean_age, round(avg(hospital_los_days), 6) as mean_los,
  round(avg(case when risk_level in ('high', 'critical') then 1.0 else 0.0 end), 6) as high_risk_share
from pt where list_has_any(diagnoses, ['CARDIOVASCULAR', 'DIABETES']) group by 1""")
def patient_360(spark, sf_dir):
    spec = nl.Cohort(diagnoses=("CARDIOVASCULAR", "DIABETES"))
    return patients(spark, sf_dir).where(nl.predicate(spec)).groupBy("age_group").agg(
        F.count("*").alias("patients"), F.round(F.avg("age"), 6).alias("mean_age"), F.round(F.avg("hospital_los_days"), 6).alias("mean_los"),
        F.round(F.avg(F.when(F.col("risk_level").isin("high", "critical"), 1.0).otherwise(0.0)), 6).alias("high_risk_share"))


@query(BASE + f"select {', '.join(PLAIN)}, array_to_string(diagnoses, '+') as combination from pt")
def patient_table(spark, sf_dir):
    return patients(spark, sf_dir).select(*PLAIN, etl.combination(F.col("diagnoses")).alias("combination"))


@query(BASE + "select patient_id, age, age_group, mortality from grouped")
def demographics_by_death(spark, sf_dir):
    return etl.demographics(Views(spark, sf_dir).patients, AS_OF).select("patient_id", "age", "age_group", "mortality")


@query(f"with {with_clauses('patients')}" + f""", a as (
  select patient_id, cast(deathdate is not null as integer) as mortality, greatest(0, year(date '{AS_OF}') - year(birthdate)
    - case when month(date '{AS_OF}') * 100 + day(date '{AS_OF}') < month(birthdate) * 100 + day(birthdate) then 1 else 0 end) as age from patients)
select * from a where age between 18 and 100""")
def demographics_as_of(spark, sf_dir):
    return etl.demographics(Views(spark, sf_dir).patients, AS_OF, age_at_death=False).select("patient_id", "mortality", "age")


@query(BASE + "select age_group, count(*) as n, min(age) as youngest, max(age) as oldest, cast(sum(mortality) as bigint) as deaths from grouped group by 1")
def age_group_ladder(spark, sf_dir):
    return etl.demographics(Views(spark, sf_dir).patients, AS_OF).groupBy("age_group").agg(
        F.count("*").alias("n"), F.min("age").alias("youngest"), F.max("age").alias("oldest"), F.sum("mortality").alias("deaths"))


@query(f"with {with_clauses('diagnoses')} select icd9_code, {ICD9} as category, count(*) as n from diagnoses group by 1, 2")
def icd9_ladder(spark, sf_dir):
    return Views(spark, sf_dir).diagnoses.groupBy("icd9_code").agg(F.count("*").alias("n")).withColumn("category", C.icd9_category(F.col("icd9_code")))


_HITS = ", ".join(
    f"case when {' or '.join(f'''contains(t, '{w}')''' for w in dict.fromkeys(fixed.KEYWORDS[n] + [p for p, c in fixed.PHRASES.items() if c == n]))} then '{n}' end" for n in sorted(fixed.KEYWORDS))
_DESCRIBED = f"""with {with_clauses('conditions')}, plain as (
  select *, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as t from conditions
), named as (select *, list_filter([{_HITS}], lambda x: x is not null) as found from plain),
cats as (select *, case when len(found) > 0 then found else ['OTHER'] end as c from named)"""


@query(_DESCRIBED + " select array_to_string(c, '+') as categories, count(*) as n from cats group by 1")
def condition_keywords(spark, sf_dir):
    return Views(spark, sf_dir).conditions.groupBy(F.array_join(C.condition_categories(F.col("description")), "+").alias("categories")).agg(F.count("*").alias("n"))


@query(_DESCRIBED + f" select patient_id, array_to_string({SPECIFIC}, '+') as combination from (select patient_id, list(distinct u) as l from (select patient_id, unnest(c) as u from cats) group by 1)")
def described_diagnoses(spark, sf_dir):
    return etl.described_diagnoses(Views(spark, sf_dir).conditions).select("patient_id", etl.combination(F.col("diagnoses")).alias("combination"))


@query(BASE + "select patient_id, array_to_string(diagnoses, '+') as combination, len(diagnoses) as n from dx")
def patient_diagnoses(spark, sf_dir):
    return etl.coded_diagnoses(Views(spark, sf_dir).diagnoses).select("patient_id", etl.combination(F.col("diagnoses")).alias("combination"), F.size("diagnoses").alias("n"))


@query(BASE + "select category, count(*) as n, round(count(*) / (select count(*) from dx), 6) as share from (select unnest(diagnoses) as category from dx) group by 1")
def category_stats(spark, sf_dir):
    return etl.category_counts(etl.coded_diagnoses(Views(spark, sf_dir).diagnoses)).withColumn("share", F.round("share", 6))


@query(BASE + "select array_to_string(diagnoses, '+') as combination, count(*) as n, round(count(*) / (select count(*) from dx), 6) as share from dx group by 1 order by n desc, combination limit 20")
def combo_stats(spark, sf_dir):
    return etl.combination_counts(etl.coded_diagnoses(Views(spark, sf_dir).diagnoses)).withColumn("share", F.round("share", 6)).orderBy(F.desc("n"), "combination").limit(20)


@query(BASE + """, q as (select count(*) as patients, avg(case when diagnoses = ['OTHER'] then 1.0 else 0 end) as only_other,
  avg(case when len(diagnoses) = 0 then 1.0 else 0 end) as none, avg(case when len(diagnoses) > 1 then 1.0 else 0 end) as several from dx)
select patients, round(only_other, 6) as only_other, round(none, 6) as none, round(several, 6) as several, case when only_other < 0.2 then 'good' else 'needs_review' end as quality from q""")
def mapping_quality(spark, sf_dir):
    out = etl.mapping_quality(etl.coded_diagnoses(Views(spark, sf_dir).diagnoses))
    return out.select("patients", *[F.round(c, 6).alias(c) for c in ("only_other", "none", "several")], "quality")


@query(BASE + "select patient_id, num_procedures, num_medications, num_encounters from joined")
def utilization_counts(spark, sf_dir):
    return patients(spark, sf_dir).select("patient_id", "num_procedures", "num_medications", "num_encounters")


@query(BASE + "select patient_id, hospital_los_days, admission_type, cast(last_admission as varchar) as last_admission from adm")
def latest_admission(spark, sf_dir):
    admissions = Views(spark, sf_dir).admissions.withColumn("dischtime", F.expr("timestampadd(minute, stay_minutes, admittime)"))
    return etl.latest_admission(admissions).select("patient_id", "hospital_los_days", "admission_type", F.date_format("last_admission", "yyyy-MM-dd HH:mm:ss").alias("last_admission"))


@query(BASE + "select patient_id, icu_los_days, icu_stays from icu")
def icu_summary(spark, sf_dir):
    return etl.icu_summary(Views(spark, sf_dir).icustays.withColumn("outtime", F.expr("timestampadd(minute, icu_minutes, intime)")))


@query(BASE + "select risk_level, utilization_category, high_complexity, count(*) as n, round(avg(comorbidity_score), 6) as mean_score from pt group by 1, 2, 3")
def risk_and_utilization(spark, sf_dir):
    return patients(spark, sf_dir).groupBy("risk_level", "utilization_category", "high_complexity").agg(F.count("*").alias("n"), F.round(F.avg("comorbidity_score"), 6).alias("mean_score"))


def _two_sources(spark, sf_dir):
    v = Views(spark, sf_dir)
    return etl.combined(etl.patient_table(v, AS_OF), etl.described_diagnoses(v.conditions).join(etl.demographics(v.patients, AS_OF), "patient_id").withColumn("source", F.lit("synthea")))


@query(BASE.replace("with ", "with ", 1) + f""", cats as (select patient_id, list_filter([{_HITS}], lambda x: x is not null) as f
  from (select patient_id, trim(regexp_replace(regexp_replace(lower(description), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as t from ({with_clauses('conditions')[len('conditions as ('):]})),
b as (select patient_id, list(distinct u) as l from (select patient_id, unnest(case when len(f) > 0 then f else ['OTHER'] end) as u from cats) group by 1),
two as (
  select 'mimic' as source, cast(patient_id as varchar) as old, age, gender, num_diagnoses, hospital_los_days, admission_type from pt
  union all select 'synthea', cast(patient_id as varchar), age, gender, 0, 0.0, 'Unknown' from b join grouped using (patient_id)
)
select 'PT' || lpad(cast(row_number() over (order by source, lpad(old, 20, '0')) - 1 as varchar), 6, '0') as patient_id, source, age, gender, num_diagnoses, hospital_los_days, admission_type from two""")
def combine_sources(spark, sf_dir):
    return _two_sources(spark, sf_dir).select("patient_id", "source", "age", "gender", "num_diagnoses", "hospital_los_days", "admission_type")


_MIX = "(values " + ", ".join(f"('{'+'.join(k)}', {v}::double)" for k, v in sorted(fixed.TARGET_MIX.items())) + ") m(combination, target)"


@query(BASE + f""", c as (select array_to_string(diagnoses, '+') as combination, count(*) / (select count(*) from pt) as share from pt group by 1)
select m.combination, target, round(coalesce(share, 0), 6) as actual, round(abs(target - coalesce(share, 0)), 6) as deviation, abs(target - coalesce(share, 0)) > 0.05 as off
from {_MIX} left join c using (combination)""")
def target_vs_actual(spark, sf_dir):
    return etl.target_deviation(patients(spark, sf_dir)).withColumn("actual", F.round("actual", 6)).withColumn("deviation", F.round("deviation", 6))


@query(BASE + f""", r as (
  select patient_id, array_to_string(diagnoses, '+') as combination,
    row_number() over (partition by array_to_string(diagnoses, '+') order by md5(cast(patient_id as varchar) || ':balance'), patient_id) - 1 as place,
    count(*) over (partition by array_to_string(diagnoses, '+')) as have from pt
), w as (select r.*, cast(round(target * 1000) as bigint) as want from r join {_MIX} using (combination))
select patient_id, combination, cast(unnest(range((want - place - 1 + have) // have)) as integer) as replica from w where (want - place - 1 + have) // have > 0""")
def balanced_sample(spark, sf_dir):
    return etl.balanced(patients(spark, sf_dir), 1000).select("patient_id", "combination", "replica")


@query(BASE + f""", m as (select combination, target * 500 as t, floor(target * 500 + 1e-9) as whole from {_MIX}),
q as (select combination, cast(whole as bigint) + case when row_number() over (order by round(t - whole, 9) desc, combination) <= (select cast(round(sum(t)) - sum(whole) as bigint) from m) then 1 else 0 end as quota from m),
c as (select array_to_string(list_sort(diagnoses), '+') as combination, count(*) as have from pt group by 1)
select combination, quota, least(quota, coalesce(have, 0)) as exact, (select least(500, count(*)) from pt) as distinct_rows, 500::bigint as n from q left join c using (combination)""")
def balance_report(spark, sf_dir):
    """A sample of 500 patients in the target mix: what each combination is due and gets by exact matches, and that the size is met by different rows."""
    rows = patients(spark, sf_dir).select("patient_id", "diagnoses")
    taken = balance.balance(rows, 500)
    own = taken.where((F.col("target") == etl.combination(F.col("diagnoses"))) & (F.col("replica") == 0)).groupBy(F.col("target").alias("combination")).agg(F.countDistinct("patient_id").alias("exact"))
    due = spark.createDataFrame(list(balance.quotas(500).items()), "combination string, quota long")
    whole = taken.agg(F.countDistinct("patient_id").alias("distinct_rows"), F.count("*").alias("n"))
    return due.join(own, "combination", "left").na.fill(0, ["exact"]).crossJoin(F.broadcast(whole)).select("combination", "quota", "exact", "distinct_rows", "n")  # one row


@query(BASE + """select column_name as "column", value, count(*) as n, round(count(*) / sum(count(*)) over (partition by column_name), 6) as share from (
  unpivot (select gender, age_group, insurance, risk_level from pt) on gender, age_group, insurance, risk_level into name column_name value value) group by 1, 2""")
def processing_report(spark, sf_dir):
    return etl.value_shares(patients(spark, sf_dir), ["gender", "age_group", "insurance", "risk_level"]).withColumn("share", F.round("share", 6))


@query(BASE + """select grp as "group", column_name as "column", count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.5), 6) as median, max(value) as max from (
  unpivot (select age_group as grp, cast(age as double) as age, cast(hospital_los_days as double) as hospital_los_days, cast(icu_los_days as double) as icu_los_days, cast(comorbidity_score as double) as comorbidity_score from pt) on age, hospital_los_days, icu_los_days, comorbidity_score into name column_name value value) group by 1, 2""")
def summary_stats(spark, sf_dir):
    out = etl.numeric_summary(patients(spark, sf_dir), ["age", "hospital_los_days", "icu_los_days", "comorbidity_score"], by="age_group")
    return out.select("group", "column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", F.round("median", 6).alias("median"), "max")


@query("""select year(o_orderdate) as y, count(*) as n from orders where o_orderdate between timestamp '1994-01-01' and timestamp '1996-12-31' group by 1""")
def date_range_filter(spark, sf_dir):
    rows = etl.within_dates(Views(spark, sf_dir).orders.select("o_orderdate"), "o_orderdate", "1994-01-01", "1996-12-31")
    return rows.groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


_U = "cast('0x' || substr(md5({k}), 1, 8) as bigint) / 4294967296.0"
_RULES = ", ".join(
    "case when list_contains(diagnoses, '{c}') and not list_contains(diagnoses, '{e}') and {u} < least({p}::double * (case {w} else 1.0 end), 1.0) then '{e}' end".format(
        c=c, e=e, p=p, u=_U.format(k=f"cast(patient_id as varchar) || ':enrich:{c}:{e}'"),
        w=" ".join(f"when age_group = '{b}' then {f[e]}::double" for b, f in fixed.AGE_MODIFIERS.items() if e in f) or "when false then 1.0")
    for c, es in fixed.CO_OCCURRENCE.items() for e, p in es.items())


@query(BASE + f", more as (select patient_id, list_distinct(list_concat(diagnoses, list_filter([{_RULES}], lambda x: x is not null))) as l from pt) select patient_id, array_to_string({SPECIFIC}, '+') as combination from more")
def enriched_comorbidities(spark, sf_dir):
    return etl.enriched(patients(spark, sf_dir)).select("patient_id", etl.combination(F.col("diagnoses")).alias("combination"))


_ICU = " ".join(f"when '{n}' then {p}" for n, p in fixed.ICU_CHANCE.items())
_P = f"""least(list_max(list_transform(diagnoses, lambda d: cast(case d {_ICU} else 0.2 end as double))) * case when age >= 80 then 1.3::double when age >= 65 then 1.2 when age < 40 then 0.8 else 1.0 end * (1.0::double + (len(diagnoses) - 1) * 0.1::double), 0.9::double)"""


@query(BASE + f", p as (select patient_id, {_P} as chance from pt) select patient_id, round(chance, 6) as chance, cast({_U.format(k='''cast(patient_id as varchar) || ':icu' ''')} < chance as integer) as has_icu_stay from p")
def simulated_icu(spark, sf_dir):
    from wardline.operators.sampling import icu_chance

    chance = icu_chance(F.col("age"), F.col("diagnoses"))
    out = patients(spark, sf_dir).select("patient_id", chance.alias("chance"))
    return out.select("patient_id", F.round("chance", 6).alias("chance"), (C.keyed_uniform(F.col("patient_id"), "icu") < F.col("chance")).cast("int").alias("has_icu_stay"))


@query(BASE + """select patient_id, combination from (select patient_id, array_to_string(diagnoses, '+') as combination, age, gender, has_icu_stay, diagnoses from pt)
where list_has_all(diagnoses, ['CANCER', 'TRAUMA']) and age between 40 and 80 and gender = 'f' and has_icu_stay = 1""")
def cohort_filter_and(spark, sf_dir):
    spec = nl.Cohort(diagnoses=("CANCER", "TRAUMA"), every=True, age=(40, 80), gender="f", icu=True)
    return patients(spark, sf_dir).where(nl.predicate(spec)).select("patient_id", etl.combination(F.col("diagnoses")).alias("combination"))


@query(BASE + "select patient_id, risk_level from pt where list_has_any(diagnoses, ['RENAL', 'SEPSIS']) and mortality = 0 and risk_level = 'high' and high_complexity = 1")
def cohort_filter_or(spark, sf_dir):
    spec = nl.Cohort(diagnoses=("RENAL", "SEPSIS"), mortality=False, risk="high", complexity="high")
    return patients(spark, sf_dir).where(nl.predicate(spec)).select("patient_id", "risk_level")


_TEXTS = """texts as (select c_custkey as query_id, concat(
  case c_custkey % 5 when 0 then 'Generate 25 elderly patients with ' when 1 then '40 records of women aged 30-55 with ' when 2 then 'young men with ' when 3 then 'ICU cases, age 60 - 75, who died, with ' else 'high risk survivors with ' end,
  case c_custkey % 7 when 0 then 'diabetes and kidney disease' when 1 then 'heart failure or stroke' when 2 then 'sepsis' when 3 then 'copd with hypertension' when 4 then 'a fracture, either open or closed' when 5 then 'lung cancer and complex needs' else 'no listed condition' end) as q from {customer})"""
_WORDS = ", ".join(f"case when regexp_matches(t, '\\b(?:{'|'.join(ws)})\\b') then '{n}' end" for n, ws in fixed.COHORT_WORDS.items())


@query("with " + _TEXTS.format(customer="customer") + f""", p as (select query_id, lower(q) as t from texts),
d as (select *, list_filter([{_WORDS}], lambda x: x is not null) as dx from p),
n as (select *, regexp_extract(t, '(?:aged?|age)\\s*(\\d+)\\s*-\\s*(\\d+)', 1) as a1, regexp_extract(t, '(?:aged?|age)\\s*(\\d+)\\s*-\\s*(\\d+)', 2) as a2 from d)
select query_id, diagnoses, every, cast(age_low as varchar) as age_low, cast(age_high as varchar) as age_high, gender, cast(icu as varchar) as icu, cast(mortality as varchar) as mortality, risk, complexity, cast(size as varchar) as size from (
select query_id, array_to_string(dx, '+') as diagnoses,
  len(dx) > 1 and ((regexp_matches(t, ' and | with | plus | alongside | combined with | having both ') and not regexp_matches(t, ' or | either | any of | one of ')) or (contains(t, ' and ') and len(dx) = 2)) as every,
  cast(case when a1 <> '' then try_cast(a1 as integer) when regexp_matches(t, '\\b(?:elderly|old|geriatric)\\b') then 65 when regexp_matches(t, '\\b(?:young|adult|adults)\\b') then 18 when regexp_matches(t, '\\b(?:pediatric|child|children)\\b') then 0 end as integer) as age_low,
  cast(case when a2 <> '' then try_cast(a2 as integer) when regexp_matches(t, '\\b(?:elderly|old|geriatric)\\b') then 100 when regexp_matches(t, '\\b(?:young|adult|adults)\\b') then 65 when regexp_matches(t, '\\b(?:pediatric|child|children)\\b') then 18 end as integer) as age_high,
  case when regexp_matches(t, '\\b(female|women)\\b') then 'f' when regexp_matches(t, '\\b(male|men)\\b') then 'm' end as gender,
  case when regexp_matches(t, '\\bicu\\b|intensive care|\\bcritical\\b') then true end as icu,
  case when regexp_matches(t, '\\b(?:mortality|death|died)\\b') then true when regexp_matches(t, '\\b(?:survived|survivors?)\\b') then false end as mortality,
  case when regexp_matches(t, 'high[ -]risk|\\bsevere\\b') then 'high' when regexp_matches(t, 'low[ -]risk|\\bmild\\b') then 'low' end as risk,
  case when regexp_matches(t, '\\b(?:complex|multiple|comorbid)\\b') then 'high' end as complexity,
  cast(try_cast(coalesce(nullif(regexp_extract(t, '(\\d+)\\s*(?:patients?|records?|cases?|samples?)', 1), ''), nullif(regexp_extract(t, '(?:generate|create)\\s*(\\d+)', 1), '')) as integer) as integer) as size
from n)""")
def nl_parse(spark, sf_dir):
    texts = spark.sql("select * from (with " + _TEXTS + " select * from texts)", customer=Views(spark, sf_dir).customer)
    p = nl.parsed(F.col("q"))
    return texts.select("query_id", p.alias("p")).select(
        "query_id", F.array_join("p.diagnoses", "+").alias("diagnoses"), "p.every", F.col("p.age_low").cast("string").alias("age_low"), F.col("p.age_high").cast("string").alias("age_high"), "p.gender",
        F.col("p.icu").cast("string").alias("icu"), F.col("p.mortality").cast("string").alias("mortality"), "p.risk", "p.complexity", F.col("p.size").cast("string").alias("size"))


@query(f"""select query_id, array_to_string(list_concat(list_transform(string_split(diagnoses, '+'), lambda d: case when d <> '' then 'Diagnosis: ' || d end), [case when age_low is not null then 'Age: ' || age_low || '-' || age_high end, 'Gender: ' || gender,
  case when icu = 'true' then 'ICU Stay: Required' end, case mortality when 'true' then 'Mortality: Yes' when 'false' then 'Mortality: No' end, 'Risk Level: ' || risk]), '; ') as filters,
  round(least((1 + cast(diagnoses <> '' as int) + cast(age_low is not null as int) + cast(gender is not null as int) + cast(icu is not null as int) + cast(mortality is not null as int) + cast(risk is not null as int) + cast(complexity is not null as int)) / 7, 1), 6) as confidence,
  diagnoses <> '' or age_low is not null or gender is not null or risk is not null as complex from ({SQL["nl_parse"]})""")
def request_filters(spark, sf_dir):
    """What each request filters by, how much of it was recognised, and whether steps of reasoning can follow it."""
    texts = spark.sql("select * from (with " + _TEXTS + " select * from texts)", customer=Views(spark, sf_dir).customer)
    p = texts.select("query_id", nl.parsed(F.col("q")).alias("p"))
    return p.select("query_id", F.array_join(nl.suggested_filters(F.col("p")), "; ").alias("filters"), F.round(nl.recognised(F.col("p")), 6).alias("confidence"), nl.is_complex(F.col("p")).alias("complex"))



@query(BASE + """select gender, insurance, round(avg(age), 6) as mean_age, count(*) as n, grouping(gender) as g1, grouping(insurance) as g2 from pt group by cube (gender, insurance)""")
def cube_demographics(spark, sf_dir):
    return patients(spark, sf_dir).cube("gender", "insurance").agg(
        F.round(F.avg("age"), 6).alias("mean_age"), F.count("*").alias("n"), F.grouping("gender").cast("bigint").alias("g1"), F.grouping("insurance").cast("bigint").alias("g2"))


@query(BASE + """select patient_id, insurance, hospital_los_days, rank() over (partition by insurance order by hospital_los_days desc, patient_id) as r from pt qualify r <= 5""")
def longest_stays(spark, sf_dir):
    w = Window.partitionBy("insurance").orderBy(F.desc("hospital_los_days"), "patient_id")
    return patients(spark, sf_dir).select("patient_id", "insurance", "hospital_los_days", F.rank().over(w).cast("bigint").alias("r")).where("r <= 5")


@query(f"with {with_clauses('procedures', 'prescriptions')} select 'both' as which, count(*) as n from (select patient_id from procedures intersect select patient_id from prescriptions) union all select 'only_procedures', count(*) from (select patient_id from procedures except select patient_id from prescriptions)")
def intersect_except(spark, sf_dir):
    v = Views(spark, sf_dir)
    a, b = v.procedures.select("patient_id"), v.prescriptions.select("patient_id")
    return a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("which"), "n").unionByName(a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("only_procedures").alias("which"), "n"))
