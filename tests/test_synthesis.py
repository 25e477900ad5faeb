import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import constraints as K
from wardline.operators import copula, quantiles
from wardline.operators import validation as V


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1e6), float(rng.randint(0, 5)), float(rng.randint(-3, 3))]), None if rng.random() < 0.3 else rng.random()) for g in ["a", "b", None] for _ in range(rng.randint(1, 400))]
    rows += [("hot", 7.0, 1.0)] * 500 + [("empty", None, None), ("nan", float("nan"), 2.0)]
    frame = spark.createDataFrame(rows, "g string, x double, `column` double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.group, r.column, r.prob): r.value for r in quantiles.exact_quantiles(frame, ["x", "column"], probs, by="g").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "column")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i])]
            if values:
                want |= {(g, c, p): float(q) for p, q in zip(probs, np.quantile(values, probs), strict=True)}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    lower = {r.prob: r.value for r in quantiles.exact_quantiles(frame.where("g = 'a'"), ["x"], probs, interpolated=False).collect()}
    assert lower == {p: float(np.quantile([r[1] for r in rows if r[0] == "a"], p, method="lower")) for p in probs}
    assert quantiles.exact_quantiles(frame.where("false"), ["x"], probs).collect() == []


def test_quantiles_do_not_depend_on_how_approximate_percentiles_merge(spark, monkeypatch):
    plain = F.percentile_approx
    moved = F.udf(lambda cuts: [c + random.uniform(-50, 50) for c in cuts], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(plain(*a)))
    rows = spark.range(3000).select((F.col("id") * 7 % 3000).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    got = {(r.column, r.v): (r.n, r.before) for r in quantiles.ranked_values(rows, ["x"]).collect()}
    assert got == {("x", float(v)): (1, v) for v in range(3000)}
    found = {(r.group, r.prob): r.value for r in quantiles.exact_quantiles(rows, ["x"], [0.0, 0.5, 1.0], by="g").collect()}
    assert found == {("0", 0.0): 0.0, ("0", 0.5): 1499.0, ("0", 1.0): 2998.0, ("1", 0.0): 1.0, ("1", 0.5): 1500.0, ("1", 1.0): 2999.0}
    assert [r.ks for r in V.ks_statistic(rows, rows, ["x"]).collect()] == [0.0]


#: Published two-sided tail areas: t, degrees of freedom, p.
TABLE = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (3.169, 10, 0.01), (2.086, 20, 0.05), (2.750, 30, 0.01), (1.980, 120, 0.05), (2.617, 120, 0.01)]


def test_tails_against_published_tables_and_integration(spark):
    cases = [(t, float(df)) for t, df, _ in TABLE] + [(0.0, 7.0), (0.3, 19_999.0), (4.0, 19_999.0), (4.0, 20_001.0), (1.0, 1e7), (-2.0, 8.0), (30.0, 3.0)]
    rows = spark.createDataFrame(cases, "t double, df double").select("t", "df", quantiles.t_tail(F.col("t"), F.col("df")).alias("p"), quantiles.normal_two_sided(F.col("t")).alias("z")).collect()
    none = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (None, 5.0), (2.0, None)], "t double, df double").select(quantiles.t_tail(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in none] == [None] * 4
    for r, (_, _, p) in zip(rows, TABLE):
        assert abs(r.p - p) < 5e-5  # the tables' points have four digits
    for r in rows:
        a, n = math.atan(abs(r.t) / math.sqrt(r.df)), 20_000
        end = min(math.pi / 2, a + 60 / math.sqrt(r.df))
        x = np.linspace(a, end, n + 1)
        w = np.ones(n + 1)
        w[1:-1:2], w[2:-1:2] = 4, 2
        scale = math.exp(math.lgamma((r.df + 1) / 2) - math.lgamma(r.df / 2)) / math.sqrt(math.pi) * 2
        assert abs(r.p - (w * np.cos(x) ** (r.df - 1)).sum() * (end - a) / n / 3 * scale) < 1e-6
        assert math.isclose(r.z, math.erfc(abs(r.t) / math.sqrt(2)), rel_tol=1e-8)


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        z = rng.gauss(0, 1)
        x, k = math.exp(z), max(0, round(3 + 2 * (0.8 * z + 0.6 * rng.gauss(0, 1))))
        rows.append((i, x, k, "high" if z + rng.gauss(0, 0.5) > 0.7 else "rest", None if rng.random() < 0.2 else 5.0, 1))
    return spark.createDataFrame(rows, "id int, x double, k int, level string, holes double, one int").cache()


def test_copula_keeps_distributions_and_correlations(spark, source):
    model = copula.fit(source, ["x", "k", "holes"], ["level", "one"])
    drawn = copula.sample(spark, model, 20_000).cache()
    assert drawn.dtypes[1:] == [("x", "double"), ("k", "int"), ("holes", "double"), ("level", "string"), ("one", "int")]
    assert all(r.ks < 0.03 for r in V.ks_statistic(source, drawn, ["x", "k"]).collect())
    assert all(r.tvd < 0.03 for r in V.category_distances(source, drawn, ["level", "one"]).collect())
    ranks = lambda rows: [np.argsort(np.argsort([r[c] for r in rows])) for c in ("x", "k")]
    want, got = (np.corrcoef(*ranks(rows.select("x", "k").collect()))[0, 1] for rows in (source, drawn))
    assert abs(want - got) < 0.04
    high = lambda rows: rows.where("level = 'high'").agg(F.expr("median(x)")).first()[0]
    assert abs(math.log(high(source)) - math.log(high(drawn))) < 0.25
    holes = drawn.agg(F.avg(F.col("holes").isNull().cast("double"))).first()[0]
    assert abs(holes - 0.2) < 0.02 and drawn.where("holes <> 5").isEmpty()


def test_draws_do_not_depend_on_partitions_or_order(spark, source):
    model = copula.fit(source, ["x", "k"], ["level"])
    again = copula.fit(source.repartition(7), ["x", "k"], ["level"])
    assert np.allclose(model.correlation, again.correlation)
    whole = copula.sample(spark, model, 300).orderBy("synthetic_id").collect()
    parts = copula.sample(spark, model, 100).collect() + copula.sample(spark, model, 200, start=100).repartition(5).orderBy("synthetic_id").collect()
    assert whole == sorted(parts, key=lambda r: r.synthetic_id) and whole != copula.sample(spark, model, 300, seed="b").orderBy("synthetic_id").collect()


def test_copula_of_little(spark):
    empty = copula.fit(spark.createDataFrame([], "x double, c string"), ["x"], ["c"])
    assert [tuple(r)[1:] for r in copula.sample(spark, empty, 2).collect()] == [(None, None)] * 2
    one = copula.fit(spark.createDataFrame([(3.5, "a")], "x double, c string"), ["x"], ["c"])
    assert [tuple(r)[1:] for r in copula.sample(spark, one, 2).collect()] == [(3.5, "a")] * 2
    with pytest.raises(ValueError):
        copula.fit(spark.range(20), [], ["id"], most_levels=10)


def test_constraints_are_met_and_truncated_draws_follow_their_distribution(spark):
    rows = spark.range(20_000).select(F.col("id").alias("synthetic_id"), (F.col("id") % 130).cast("int").alias("age"), F.lit(1.0).alias("hba1c"), (F.col("id") % 2).cast("int").alias("has_diabetes"), (F.col("id") % 3).cast("int").alias("has_sepsis"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).cast("int").alias("icu_los_days"))
    done = K.applied(rows, K.PUBLISHED).cache()
    assert done.dtypes == rows.dtypes and done.count() == 20_000
    assert {r.outside for r in K.violations(done, K.PUBLISHED).collect()} == {0}
    assert sum(r.outside for r in K.violations(rows, K.PUBLISHED).collect()) > 10_000
    assert done.where("has_diabetes = 0 and hba1c <> 1").isEmpty() and done.where("has_sepsis <> 1 and icu_los_days > 30").count() > 0
    shares = K.share_below(done.where("has_diabetes = 1"), "hba1c", [6.5, 8.0, 9.5, 11.0], 8.5, 2.0, 5.7, 100.0).collect()
    assert len(shares) == 4 and all(abs(r.observed - r.expected) < 0.02 for r in shares)
    assert done.where("icu_los_days is null").count() == rows.where("icu_los_days is null").count()


def test_distributions_and_shares(spark):
    rows = spark.range(5000).select(F.col("id").alias("synthetic_id"), (F.col("id") % 10).cast("double").alias("x"), F.lit(0).alias("flag"))
    done = K.applied(rows, (K.Constraint("t", "x", "distribution", mean=50.0, std=3.0), K.Constraint("t", "flag", "distribution", share=0.3), K.Constraint("t", "missing", "range", low=1)))
    facts = done.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.avg("flag").alias("p")).first()
    assert math.isclose(facts.m, 50, abs_tol=1e-9) and math.isclose(facts.s, 3, abs_tol=1e-9) and abs(facts.p - 0.3) < 0.03
    with pytest.raises(ValueError):
        K.applied(rows, (K.Constraint("t", "x", "other"),))


def test_refill_until_enough_rows_are_kept(spark, source):
    model = copula.fit(source, ["x", "k"], ["level"])
    rare = (F.col("level") == "high") & (F.col("k") >= 5)
    got = K.generate(spark, model, 700, rare, (K.Constraint("t", "x", "range", high=2.0),))
    rows = got.collect()
    assert len(rows) == 700 and all(r.level == "high" and r.k >= 5 and r.x <= 2 and r.replica == 0 for r in rows)
    assert len({r.synthetic_id for r in rows}) == 700
    assert K.generate(spark, model, 50, F.lit(False)).count() == 0
    short = K.generate(spark, model, 300, F.col("synthetic_id") < 7, rounds=2).collect()
    assert len(short) == 300 and len({r.synthetic_id for r in short}) == 7
    assert K.generate(spark, model, 0).count() == 0


def test_rare_rows_are_drawn_once_and_fast(spark, source, monkeypatch):
    model, asked, plain = copula.fit(source, ["x", "k"], ["level"]), [], copula.sample
    monkeypatch.setattr(copula, "sample", lambda spark, model, n, seed="copula", start=0: (asked.append((start, n)), plain(spark, model, n, seed, start))[1])
    began = time.time()
    rare = (F.col("level") == "high") & (F.col("k") >= 9)
    rows = K.generate(spark, model, 4000, rare).collect()
    took = time.time() - began
    assert len({r.synthetic_id for r in rows}) == len(rows) == 4000 and {r.replica for r in rows} == {0}
    rounds = asked[:-2]  # then the block of the last row, and the rows themselves
    assert len(rounds) > 1 and all(a + n == b for (a, n), (b, _) in zip(rounds, rounds[1:]))
    first = sorted(r.synthetic_id for r in plain(spark, model, asked[-1][1], "generate").where(rare).collect())[:4000]
    assert sorted(r.synthetic_id for r in rows) == first and asked[-1][1] > 100_000 and took < 30


def test_repeats_are_dealt_in_turn(spark, source):
    model = copula.fit(source, ["x"], ["level"])
    got = sorted((r.replica, r.synthetic_id) for r in K.generate(spark, model, 17, F.col("synthetic_id") < 5, rounds=1).collect())
    assert got == [(k, i) for k in range(3) for i in range(5)] + [(3, 0), (3, 1)]


def test_inverse_normal(spark):
    ps = [1e-9, 0.001, 0.02, 0.03, 0.3, 0.5, 0.9, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(K.normal_inverse(F.col("p")).alias("z")).collect()
    assert all(math.isclose(r.z, statistics.NormalDist().inv_cdf(p), rel_tol=1e-7, abs_tol=1e-7) for r, p in zip(got, ps))


def test_typicality(spark):
    rows = spark.createDataFrame([(40, 1, 1, 1), (30, 1, 0, 0), (20, 0, 1, 0), (90, 0, 1, 1)], "age int, has_diabetes int, has_sepsis int, mortality int")
    got = {(r.topic, r.field): r for r in K.typicality(rows).collect()}
    assert got["diabetes", "age"].typical == 0.5 and got["diabetes", "age"]["shift"] == 35 - 45 and math.isclose(got["sepsis", "mortality"].ones, 2 / 3) and got["sepsis", "mortality"].ones_ok is False


def test_fidelity_reads_the_patients_once(spark, sf):
    from wardline.plans import catalog

    assert "parquet" not in catalog.queries()["copula_fidelity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
