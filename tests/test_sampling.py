from pyspark.sql import functions as F

from wardline.operators import etl, sampling as S, validation as V
from wardline.operators.quantiles import normal_two_sided
from wardline.plans import nl
from wardline.plans.etl_queries import patients
from wardline.sources import readers


def test_samples_are_reproducible_and_of_the_size(spark, sf):
    rows = patients(spark, sf).select("patient_id", "gender", "age").cache()
    a, b = (sorted(r.patient_id for r in S.exact_sample(d, 20).collect()) for d in (rows, rows.repartition(5)))
    assert a == b and len(a) == 20
    boot = S.bootstrap(rows, 600)
    assert 450 < boot.count() < 750 and sorted(map(tuple, boot.collect())) == sorted(map(tuple, S.bootstrap(rows.repartition(4), 600).collect()))
    quota = S.gender_quota(rows, 40, 0.75)
    assert quota.where("gender = 'f'").count() == 30 and quota.count() == 40


def test_simulated_rows_keep_the_bounds(spark, sf):
    rows = patients(spark, sf)
    got = S.simulated_stays(rows.select("patient_id", "age", "diagnoses"))
    bad = got.where("hospital_los_days < 1 or hospital_los_days > 60 or icu_los_days > 30 or (has_icu_stay = 1) <> (icu_los_days > 0) or (admission_type = 'Emergency') <> (emergency_admission = 1)")
    assert bad.count() == 0 and 0.2 < got.agg(F.avg("has_icu_stay")).first()[0] < 0.95
    redrawn = S.outcomes_redrawn(rows)
    assert redrawn.where("hospital_los_days < icu_los_days or hospital_los_days > 60 and icu_los_days < 60").count() == 0
    assert S.forced(rows, ("CANCER",)).where("not array_contains(diagnoses, 'CANCER') or array_contains(diagnoses, 'OTHER')").count() == 0


def test_gamma_choice_and_noise(spark):
    rows = spark.range(4000).select("id", S.erlang(2, 3.0, F.col("id"), "g").alias("g"), S.choice((F.col("id") % 1000) / 1000.0, {"a": 0.7, "b": 0.2, "c": 0.1}).alias("c"), S.laplace(2.0, F.col("id"), "l").alias("l"))
    r = rows.agg(F.avg("g").alias("g"), F.var_samp("g").alias("v"), F.avg((F.col("c") == "a").cast("double")).alias("a"), F.avg((F.col("c") == "c").cast("double")).alias("c"), F.avg("l").alias("l"), F.avg(F.abs("l")).alias("s")).first()
    assert abs(r.g - 6) < 0.3 and abs(r.v - 18) < 3 and abs(r.a - 0.7) < 0.01 and abs(r.c - 0.1) < 0.01 and abs(r.l) < 0.2 and abs(r.s - 2) < 0.15


def test_augmenting_reaches_the_share(spark, sf):
    rows = patients(spark, sf).withColumn("rare", (F.col("patient_id") % 20 == 0).cast("int"))
    got = S.augmented(rows.select("patient_id", "rare"), "rare", 0.3)
    assert 0.2 < got.where("rare = 1").count() / got.where("rare = 0").count() < 0.4
    assert "rare" in S.discrete_columns(rows.select("patient_id", "rare", "gender")) and "gender" in S.discrete_columns(rows.select("gender", "rare"))


def test_balance_fills_up_with_replicas(spark, sf):
    rows = patients(spark, sf)
    got = etl.balanced(rows, 500).groupBy("combination").agg(F.count("*").alias("n"), F.countDistinct("patient_id").alias("d")).collect()
    want = {r.combination: round(r.target * 500) for r in etl.target_mix(spark).collect()}
    assert got and all(r.n == want[r.combination] for r in got)


def test_fidelity_of_equal_and_disjoint_samples(spark):
    a, b = spark.range(100).selectExpr("cast(id as double) as x", "id % 3 as c"), spark.range(200, 300).selectExpr("cast(id as double) as x", "7 as c")
    assert V.ks_statistic(a, a, ["x"]).first().ks == 0 and V.ks_statistic(a, b, ["x"]).first().ks == 1
    same, apart = V.category_distances(a, a, ["c"]).first(), V.category_distances(a, b, ["c"]).first()
    assert (same.tvd, round(same.overlap, 9)) == (0, 1) and (apart.tvd, apart.overlap) == (1, 0)
    p = spark.range(1).select(V.ks_probability(F.lit(0.0), F.lit(100.0), F.lit(100.0)).alias("a"), V.ks_probability(F.lit(1.0), F.lit(100.0), F.lit(100.0)).alias("b"), normal_two_sided(F.lit(1.96)).alias("z")).first()
    assert p.a == 1 and p.b < 1e-6 and abs(p.z - 0.05) < 1e-4


def test_checked_cohorts_and_columns(spark):
    c = nl.checked(nl.Cohort(diagnoses=("CANCER", "NONE"), age=(150, -3), gender="female", risk="odd", size=99999))
    assert (c.diagnoses, c.age, c.gender, c.risk, c.size) == (("CANCER",), (0, 120), "f", None, 10000)
    rows = spark.range(1).selectExpr("id as patientId", "id as `Hospital LOS (days)`")
    assert readers.snake_case(rows).columns == ["patient_id", "hospital_los_days"] and readers.find_column(rows, "x", "PATIENTID") == "patientId"
