"""Exact quantiles of columns of any size: values are counted, then ranked within ranges and over the ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (group, column) pairs up to which their cuts are broadcast (about 2 KB each).
FEW = 10_000


def below(cuts: Column | str, value: Column | str, bits: int = 8, equal: bool = False) -> Column:
    """How many of at most 2^bits - 1 ascending `cuts` are less than `value` (or, with `equal`, at most it), by halves."""
    cuts, value = (F.col(c) if isinstance(c, str) else c for c in (cuts, value))
    halves = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
    step = (lambda c: c <= value) if equal else (lambda c: c < value)
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(step(F.get(cuts, at + half - 1)), half).otherwise(0))


def ranked_values(rows: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(group, column, v, n, before, total): each different value of `columns` as a double, its number of rows, and those less than it.

    Nulls and NaN are left out; `group` is `by` as text, "all" without it. Values are counted map-side; running
    counts are taken within 256 ranges of a column's values and then over the ranges, so no task and
    no buffer holds a whole column.
    """
    group = F.col(by).cast("string") if by else F.lit("all")
    long = rows.select(group.alias("group"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    values = long.select("group", "x.column", "x.v").where("v is not null and not isnan(v)").groupBy("group", "column", "v").agg(F.count("*").alias("n"))
    keys = ["group", "column"]
    # Approximate percentiles depend on the order of merging: both sides below have to get the same, so they are found once.
    cuts = values.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 2048))).alias("cuts"), F.sum("n").alias("total")).localCheckpoint()
    small = F.broadcast(cuts) if by is None or cuts.count() <= FEW else cuts
    same = F.col("v.group").eqNullSafe(F.col("c.group")) & (F.col("v.column") == F.col("c.column"))
    placed = values.alias("v").join(small.alias("c"), same).select("v.group", "v.column", "v.v", "v.n", "c.total", below("c.cuts", "v.v").alias("part"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "part").agg(F.sum("n").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("p")
    on = F.col("p.group").eqNullSafe(F.col("s.group")) & (F.col("p.column") == F.col("s.column")) & (F.col("p.part") == F.col("s.part"))
    return run.join(sums.alias("s"), on).select("p.group", "p.column", "p.v", "p.n", (F.col("run") + F.col("base")).alias("before"), "total")


def exact_quantiles(rows: DataFrame, columns: list[str], probs: list[float], by: str | None = None, interpolated: bool = True) -> DataFrame:
    """(group, column, prob, value) of `columns` at `probs`, exactly, as doubles.

    `interpolated` between the two values next to the rank, else the lesser of them. Columns and groups
    without values have no rows. A value is asked only for the ranks that it holds.
    """
    ranked = ranked_values(rows, columns, by)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    low = lambda p: F.floor(p * (F.col("total") - 1))
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    high = lambda p: F.ceil(p * (F.col("total") - 1))
    held = ranked.withColumn("prob", F.explode(F.filter(wanted, lambda p: holds(low(p)) | holds(high(p)))))
    p = F.col("prob")
    part = p * (F.col("total") - 1) - low(p)
    ends = held.groupBy("group", "column", "prob").agg(F.max(F.when(holds(low(p)), F.col("v"))).alias("lo"), F.max(F.when(holds(high(p)), F.col("v"))).alias("hi"), F.max(part).alias("part"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part") if interpolated else F.col("lo")
    return ends.select("group", "column", "prob", value.alias("value"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 1e-15: a series near 0, a continued fraction in the tails."""
    x = F.abs(z)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), lambda a, k: F.struct((a["term"] * x * x / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * x * x / (2 * k + 1)).alias("sum")), lambda a: a["sum"])
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    far = F.greatest(x, F.lit(3.0))  # where the fraction counts, and never 0
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), far, lambda a, k: far + k / a)
    upper = F.when(x < 3, 0.5 - density * series).when(x < 39, density / fraction).otherwise(0.0)
    return F.when(z < 0, upper).when(z >= 0, 1 - upper)  # null for null


#: Coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number."""
    y = x - 1
    total = sum((F.lit(c) / (y + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz); a and b up to some 10^5."""
    def fraction(a: Column, b: Column, x: Column) -> Column:
        tiny = 1e-300
        away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        d0 = 1 / away(1 - (a + b) * x / (a + 1))

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            one = F.struct((1 / away(1 + even * s["d"])).alias("d"), away(1 + even / s["c"]).alias("c"), s["h"].alias("h"))
            two = lambda t: F.struct((1 / away(1 + odd * t["d"])).alias("d"), away(1 + odd / t["c"]).alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))
            last = lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))
            return F.element_at(F.transform(F.transform(F.array(one), two), last), 1)

        start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    swap = x > (a + 1) / (a + b + 2)
    inner = F.when(swap, 1 - front * fraction(b, a, 1 - x) / b).otherwise(front * fraction(a, b, x) / a)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided probability of Student's t beyond |t|: exact up to 20000 degrees of freedom, then by a normal draw corrected to order 1/df (error below 1e-9)."""
    t, df = t.cast("double"), F.when(df > 0, df.cast("double"))  # null without degrees of freedom
    exact = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    near = F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df <= 20_000, exact).otherwise(2 * (1 - normal_cdf(near)))


def normal_two_sided(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))
