"""Queries of quantiles, tail probabilities, the copula sampler and the constraint table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import constraints as K
from wardline.operators import copula
from wardline.operators import evidence as E
from wardline.operators import sampling as S
from wardline.operators import validation as V
from wardline.operators.quantiles import exact_quantiles, normal_two_sided, t_tail
from wardline.plans import alignment_queries
from wardline.plans.base_sql import BASE
from wardline.plans.etl_queries import patients
from wardline.plans.registry import registry
from wardline.plans.validation_queries import rounded
from wardline.sources.views import Views

QUERIES, SQL, query = registry()

_PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
_QUANTILES = " union all ".join(f"""select l_returnflag as "group", '{c}' as "column", unnest({_PROBS}) as prob, unnest(quantile_cont({c}::double, {_PROBS})) as value from lineitem group by 1""" for c in ("l_quantity", "l_extendedprice"))


@query(f'select "group", "column", prob::double as prob, round(value, 6) as value from ({_QUANTILES})')
def quantiles_exact(spark, sf_dir):
    out = exact_quantiles(Views(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice"], _PROBS, by="l_returnflag")
    return out.withColumn("value", F.round("value", 6))


# Student's tail by Simpson's rule over 2000 steps of t / sqrt(df) = tan(angle), the normal one over 2000 steps to 10.
_T = """(select list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * power(cos(a + (pi() / 2 - a) * i / 2000), df - 1))) * (pi() / 2 - a) / 6000
  * 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()))"""
_Z = "(select list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-power(b + (12 - b) * i / 2000, 2) / 2))) * (12 - b) / 6000 * 2 / sqrt(2 * pi()))"
_MEANS = {"DIABETES": 62.0, "HYPERTENSION": 58.0, "CARDIOVASCULAR": 65.0, "RESPIRATORY": 68.0}
_ROWS = " union all ".join(f"select '{c}' as condition, count(*) as n, avg(age) as mean, stddev_samp(age) as std, {m}::double as published from pt where list_contains(diagnoses, '{c}')" for c, m in _MEANS.items())


@query(BASE + f""", f as (select *, (mean - published) / (std / sqrt(n)) as t, (n - 1)::double as df from ({_ROWS}) where n > 0), g as (select *, atan(abs(t) / sqrt(df)) as a, least(abs(t), 12) as b from f)
select condition, n, round(t, 6) as t, round({_T}, 6) as p_student, round({_Z}, 6) as p_normal from g""")
def tail_probabilities(spark, sf_dir):
    """Mean ages against published ones: two-sided tails of Student's t and of the normal distribution."""
    long = patients(spark, sf_dir).select("age", F.explode("diagnoses").alias("condition")).where(F.col("condition").isin(*_MEANS))
    out = long.groupBy("condition").agg(F.count("*").alias("n"), F.avg("age").alias("mean"), F.stddev_samp("age").alias("std"))
    published = F.create_map(*[F.lit(x) for kv in _MEANS.items() for x in kv])[F.col("condition")]
    out = out.withColumn("t", (F.col("mean") - published) / (F.col("std") / F.sqrt("n")))
    out = out.select("condition", "n", "t", t_tail(F.col("t"), F.col("n") - 1).alias("p_student"), normal_two_sided(F.col("t")).alias("p_normal"))
    return rounded(out, "t", "p_student", "p_normal")


_NUMERIC, _CATEGORICAL = ["age", "hospital_los_days", "icu_los_days", "comorbidity_score", "num_diagnoses"], ["gender", "insurance", "risk_level", "mortality"]
_BOUNDS = " union all ".join([f"""select 'ks' as measure, '{c}' as "column", count({c}) > 0 as within from pt""" for c in _NUMERIC] + [f"select 'tvd', '{c}', count({c}) > 0 from pt" for c in _CATEGORICAL] + ["select 'correlation', 'all', count(*) > 0 from pt"])


@query(BASE + f"select * from ({_BOUNDS})")
def copula_fidelity(spark, sf_dir):
    """As many rows as patients, at least 5000, drawn from their copula: whether KS and total variation stay within .05, and the correlations' similarity over .95."""
    rows = patients(spark, sf_dir).select("patient_id", *_NUMERIC, *_CATEGORICAL).localCheckpoint()  # read some ten times
    drawn = copula.sample(spark, copula.fit(rows, _NUMERIC, _CATEGORICAL), max(5000, rows.count()))
    ks = V.ks_statistic(rows, drawn, _NUMERIC).select(F.lit("ks").alias("measure"), "column", (F.col("ks") <= 0.05).alias("within"))
    tvd = V.category_distances(rows, drawn, _CATEGORICAL).select(F.lit("tvd").alias("measure"), "column", (F.col("tvd") <= 0.05).alias("within"))
    like = V.correlation_similarity(rows, drawn, _NUMERIC).select(F.lit("correlation").alias("measure"), F.lit("all").alias("column"), (F.col("similarity") > 0.95).alias("within"))
    return ks.unionByName(tvd).unionByName(like)


_A = "(((((-39.69683028665376 * r + 220.9460984245205) * r - 275.9285104469687) * r + 138.3577518672690) * r - 30.66479806614716) * r + 2.506628277459239)"
_B = "(((((-54.47609879822406 * r + 161.5858368580409) * r - 155.6989798598866) * r + 66.80131188771972) * r - 13.28068155288572) * r + 1)"
_C = "(((((-0.007784894002430293 * q - 0.3223964580411365) * q - 2.400758277161838) * q - 2.549732539343734) * q + 4.374664141464968) * q + 2.938163982698783)"
_D = "((((0.007784695709041462 * q + 0.3224671290700398) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1)"


@query(BASE + f""", u as (select patient_id, age, icu_los_days, list_contains(diagnoses, 'DIABETES') as diabetic, list_contains(diagnoses, 'SEPSIS') as septic, 4 + patient_id % 9 * 0.5 as hba1c,
  ('0x' || md5(concat_ws(':', patient_id, 'k:1:hba1c'))[1:8])::bigint / 4294967296.0::double as u1, ('0x' || md5(concat_ws(':', patient_id, 'k:2:icu_los_days'))[1:8])::bigint / 4294967296.0::double as u2 from pt),
p as (select *, 0.0807566592337711::double + u1 * (1 - 0.0807566592337711::double) as p from u), x as (select *, (p - 0.5) * (p - 0.5) as r, sqrt(-2 * ln(least(p, 1 - p))) as q from p),
z as (select *, case when p < 0.02425 then {_C} / {_D} when p > 1 - 0.02425 then -{_C} / {_D} else {_A} * (p - 0.5) / {_B} end as z from x)
select patient_id, least(greatest(age, 18), 100)::bigint as age, round(case when diabetic and hba1c < 5.7 then greatest(8.5 + 2 * z, 5.7) else hba1c end, 6) as hba1c,
  round(case when septic then least(case when icu_los_days < 2 then 2 + u2 * 2 * 0.2 else icu_los_days end, 30) else icu_los_days end, 6) as icu_los_days from z""")
def constrained_patients(spark, sf_dir):
    """The published constraints imposed on patients with a made-up HbA1c: bounds, keyed draws from a truncated normal distribution, and draws above a bound."""
    rows = patients(spark, sf_dir).select(
        "patient_id", "age", "icu_los_days", (4 + F.col("patient_id") % 9 * 0.5).alias("hba1c"), *[F.array_contains("diagnoses", d).cast("int").alias(f"has_{d.lower()}") for d in ("DIABETES", "SEPSIS")])
    some = tuple(c for field in ("age", "hba1c", "icu_los_days") for c in K.PUBLISHED if c.field == field and c.kind in ("range", "conditional") and (c.low is not None or c.high is not None))
    out = K.applied(rows, some, key="patient_id", seed="k")
    return out.select("patient_id", F.col("age").cast("bigint").alias("age"), F.round("hba1c", 6).alias("hba1c"), F.round("icu_los_days", 6).alias("icu_los_days"))


@query()
def generated_cohort(spark, sf_dir):
    """Elderly female patients with diabetes, as many as there are patients, from the copula of all under the published constraints."""
    rows = S.training_features(patients(spark, sf_dir))
    model = copula.fit(rows, ["age", "hospital_los_days", "icu_los_days", "num_procedures", "num_medications"], ["gender", "insurance", "mortality", "has_diabetes", "has_sepsis"])
    asked = (F.col("age") >= 65) & (F.col("gender") == "f") & (F.col("has_diabetes") == 1)
    return K.generate(spark, model, rows.count(), asked, K.PUBLISHED, finish=S.clinically_constrained)


_ASKED_FOR = "DIABETES"


@query("with " + alignment_queries._STATED + f""", e as (select condition, avg(rate) as expected from stated where condition <> '{_ASKED_FOR}' group by 1)
select condition, round(expected, 6) as expected, true as within from e union all select '{_ASKED_FOR}', 1.0::double, true union all select 'n', 4000.0::double, true""")
def guided_cohort(spark, sf_dir):
    """4000 patients with diabetes from the copula, whose other conditions come as often as texts state (within .03)."""
    rows = S.training_features(patients(spark, sf_dir))
    flags = ["has_diabetes", "has_hypertension", "has_renal", "has_sepsis"]
    model = copula.fit(rows, ["age", "hospital_los_days", "icu_los_days"], ["gender", *flags])
    stated = E.constraints_of(alignment_queries._texts(spark, sf_dir), (_ASKED_FOR,))
    out = K.generate(spark, model, 4000, F.col("has_diabetes") == 1, (*K.PUBLISHED, *stated), finish=S.clinically_constrained)
    one = out.agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in flags])
    wanted = {"has_diabetes": 1.0} | {c.field: c.share for c in stated}
    checks = [F.struct(F.lit(f.removeprefix("has_").upper()).alias("condition"), F.lit(float(v)).alias("expected"), (F.abs(F.col(f) - v) <= 0.03).alias("within")) for f, v in wanted.items()]
    checks.append(F.struct(F.lit("n").alias("condition"), F.lit(4000.0).alias("expected"), (F.col("n") == 4000).alias("within")))
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.condition", F.round("c.expected", 6).alias("expected"), "c.within")
