"""Constraints on synthetic rows as a table: ranges, conditional bounds, distributions and shares, compiled to column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import clinical as C
from wardline.operators import copula
from wardline.operators.quantiles import normal_cdf


@dataclass(frozen=True)
class Constraint:
    """One row: what holds of `field` where `condition` (SQL text over the row; none: everywhere) does.

    range: values are cut to [low, high]. conditional: a value under `low` is drawn anew, from a normal
    distribution of `mean` and `std` within the bounds where these are given, else up to a fifth above it; one
    over `high` becomes it. distribution: the column is moved to `mean` and scaled to `std`; a 0/1 column
    gets `share` ones. Nulls stay null. What is `typical`, the range of `shares` of ones, and a `shift` of the
    mean against all rows are not imposed; `typicality` reports them.
    """

    topic: str
    field: str
    kind: str
    condition: str | None = None
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None
    share: float | None = None
    typical: tuple[float | None, float | None] | None = None
    shares: tuple[float, float] | None = None
    shift: float | None = None
    source: str = ""
    confidence: float = 1.0


# Published constraints by topic.
PUBLISHED = (
    Constraint("age", "age", "range", low=18, high=100, source="Adult patient cohort", confidence=1.0),
    Constraint("diabetes", "hba1c", "conditional", "has_diabetes = 1", low=5.7, mean=8.5, std=2.0, source="ADA Standards 2024", confidence=0.9),
    Constraint("diabetes", "age", "conditional", "has_diabetes = 1", typical=(35, None), shift=10, source="UKPDS Study", confidence=0.85),
    Constraint("hypertension", "blood_pressure_systolic", "conditional", "has_hypertension = 1", low=130, typical=(140, 180), source="ACC/AHA Guidelines 2023", confidence=0.9),
    Constraint("cardiovascular", "age", "conditional", "has_cardiovascular = 1", typical=(45, None), shift=15, source="Framingham Heart Study", confidence=0.9),
    Constraint("sepsis", "mortality", "conditional", "has_sepsis = 1", shares=(0.20, 0.35), source="Surviving Sepsis Campaign 2021", confidence=0.85),
    Constraint("sepsis", "icu_los_days", "conditional", "has_sepsis = 1", low=2, mean=8, high=30, source="Sepsis-3 Epidemiology", confidence=0.8),
    Constraint("renal", "creatinine", "conditional", "has_renal = 1", low=1.5, typical=(2.0, 8.0), source="KDIGO Guidelines", confidence=0.9),
    Constraint("respiratory", "oxygen_saturation", "conditional", "has_respiratory = 1", typical=(88, 94), source="GOLD Report 2024", confidence=0.85),
)

# Coefficients of Acklam's approximation of the inverse normal distribution (relative error 1.15e-9).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_inverse(p: Column) -> Column:
    """The normal score at a probability in (0, 1)."""
    middle, tail = 0.02425, lambda q: _polynomial(ACKLAM_C, q) / (_polynomial(ACKLAM_D, q) * q + 1)
    r = (p - 0.5) * (p - 0.5)
    centre = _polynomial(ACKLAM_A, r) * (p - 0.5) / (_polynomial(ACKLAM_B, r) * r + 1)
    return F.when(p < middle, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - middle, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(centre)


def truncated_normal(u: Column, mean: float, std: float, low: float | None, high: float | None) -> Column:
    """The draw at a uniform number of a normal distribution within bounds, by its inverse."""
    normal = lambda x: 0.5 * math.erfc(-(x - mean) / std / math.sqrt(2))
    a, b = 0.0 if low is None else normal(low), 1.0 if high is None else normal(high)
    p = F.greatest(F.least(a + u * (b - a), F.lit(1 - 1e-12)), F.lit(1e-12))
    value = mean + std * normal_inverse(p)
    value = F.greatest(value, F.lit(float(low))) if low is not None else value
    return F.least(value, F.lit(float(high))) if high is not None else value


def applied(rows: DataFrame, constraints: tuple[Constraint, ...], key: str = "synthetic_id", seed: str = "constraints") -> DataFrame:
    """`rows` with all constraints met whose field, and whose condition's columns, are there, in order; draws are keyed by row.

    Distributions need the column's mean and deviation: one aggregate each, in order; all else is a projection.
    Whole-number columns stay whole.
    """
    out = rows
    for i, c in enumerate(constraints):
        needed = {c.field} | ({x for x in _columns(c.condition) if x} if c.condition else set())
        if not needed <= set(out.columns):
            continue
        kind, value, u = out.schema[c.field].dataType, F.col(c.field), C.keyed_uniform(F.col(key), f"{seed}:{i}:{c.field}")
        holds = F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True)
        whole = kind.typeName() in ("integer", "long", "short", "byte")
        if c.kind == "range":
            new = value if c.low is None else F.greatest(value, F.lit(c.low))
            new = new if c.high is None else F.least(new, F.lit(c.high))
        elif c.kind == "conditional":
            new = value
            if c.low is not None:
                drawn = truncated_normal(u, c.mean, c.std, c.low, c.high) if c.mean is not None and c.std else c.low + u * abs(c.low) * 0.2
                new = F.when(value < c.low, F.ceil(drawn) if whole else drawn).otherwise(new)
            if c.high is not None:
                new = F.when(value > c.high, F.lit(c.high)).otherwise(new)
                new = F.least(new, F.lit(c.high))
        elif c.kind == "distribution" and c.share is not None:
            new = (u < c.share).cast("int")
        elif c.kind == "distribution":
            facts = out.where(holds).agg(F.avg(c.field).cast("double").alias("m"), F.stddev_samp(c.field).cast("double").alias("s")).first()
            if facts.m is None:
                continue
            scale = c.std / facts.s if c.std is not None and facts.s else 1.0
            new = (value - facts.m) * scale + (facts.m if c.mean is None else c.mean)
        else:
            raise ValueError(f"no constraint of kind {c.kind}")
        out = out.withColumn(c.field, F.when(holds & value.isNotNull(), F.round(new) if whole and c.kind == "distribution" else new).otherwise(value).cast(kind))
    return out


def _columns(condition: str) -> list[str]:
    """The names that a condition of the form "column operator value [and ...]" reads."""
    return [part.strip().split()[0] for part in condition.replace(" AND ", " and ").split(" and ")]


def violations(rows: DataFrame, constraints: tuple[Constraint, ...]) -> DataFrame:
    """(topic, field, n, outside): rows of each range or conditional constraint, and those out of its bounds, in one pass."""
    tests = []
    for c in constraints:
        if c.kind in ("range", "conditional") and {c.field, *(_columns(c.condition) if c.condition else [])} <= set(rows.columns):
            holds = F.expr(c.condition) if c.condition else F.lit(True)
            out = F.coalesce(F.col(c.field) < c.low if c.low is not None else F.lit(False), F.lit(False)) | F.coalesce(F.col(c.field) > c.high if c.high is not None else F.lit(False), F.lit(False))
            tests.append(F.struct(F.lit(c.topic).alias("topic"), F.lit(c.field).alias("field"), (holds & F.col(c.field).isNotNull()).alias("here"), out.alias("out")))
    if not tests:
        return rows.sparkSession.createDataFrame([], "topic string, field string, n long, outside long")
    long = rows.select(F.explode(F.array(*tests)).alias("x"))
    return long.groupBy("x.topic", "x.field").agg(F.count_if("x.here").alias("n"), F.count_if(F.col("x.here") & F.col("x.out")).alias("outside"))


def typicality(rows: DataFrame, constraints: tuple[Constraint, ...] = PUBLISHED) -> DataFrame:
    """(topic, field, n, typical, shift, wanted_shift, ones, ones_ok): of the rows of a condition, the share within what is typical,
    the distance of their mean from all rows' and the share of ones; null where the constraint doesn't say."""
    one, found = [], []
    for i, c in enumerate(constraints):
        if not (c.typical or c.shares or c.shift) or not {c.field, *(_columns(c.condition) if c.condition else [])} <= set(rows.columns):
            continue
        value, none = F.col(c.field).cast("double"), F.lit(None).cast("double")
        here = (F.expr(c.condition) if c.condition else F.lit(True)) & value.isNotNull()
        low, high = c.typical or (None, None)
        inside = (value >= low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))
        one += [F.count_if(here).alias(f"n{i}"), F.avg(F.when(here, inside.cast("double"))).alias(f"t{i}"), F.avg(F.when(here, value)).alias(f"m{i}"), F.avg(value).alias(f"a{i}")]
        ones = F.col(f"m{i}") if c.shares else none
        found.append(F.struct(
            F.lit(c.topic).alias("topic"), F.lit(c.field).alias("field"), F.col(f"n{i}").alias("n"), (F.col(f"t{i}") if c.typical else none).alias("typical"), (F.col(f"m{i}") - F.col(f"a{i}") if c.shift else none).alias("shift"),
            F.lit(c.shift).cast("double").alias("wanted_shift"), ones.alias("ones"), (ones.between(*c.shares) if c.shares else F.lit(None).cast("boolean")).alias("ones_ok")))
    return rows.agg(*one).select(F.explode(F.array(*found)).alias("r")).select("r.*")


#: Blocks of a round of drawing, at most: the driver gets a count of each.
BLOCKS = 1000


def generate(
    spark: SparkSession, model: copula.Copula, n: int, keep: Column | None = None, constraints: tuple[Constraint, ...] = (),
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows, multiplier: int = 2, rounds: int = 5, seed: str = "generate",
) -> DataFrame:
    """`n` rows drawn from the model of which `keep` holds, under the constraints, then finished.

    Rows are numbered and keyed, so a longer draw begins with the shorter one: each round draws on by as many
    as are missing, by the share kept so far (at first `multiplier` times `n`), and counts what is kept by
    block of numbers. The number of the last row asked for is looked up in its block, so that nothing is sorted.
    After `rounds` rounds the rows kept repeat, in turn (column `replica`, from 0); with none kept the
    result is empty.
    """
    kept = (lambda rows: rows.where(keep)) if keep is not None else (lambda rows: rows)
    blocks: list[tuple[int, int, int]] = []  # start, size and rows kept
    drawn, more, have = 0, n * multiplier, 0
    for _ in range(rounds if n else 0):
        size = max(1, -(-more // BLOCKS))
        found = kept(copula.sample(spark, model, more, seed, drawn)).groupBy(F.floor((F.col("synthetic_id") - drawn) / size).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
        blocks += [(drawn + r.b * size, min(size, more - r.b * size), r.n) for r in found]
        drawn, have = drawn + more, sum(k for _, _, k in blocks)
        if have >= n:
            break
        more = max(n, math.ceil((n - have) * drawn / have * 1.2)) if have else drawn * 2

    def last(k: int) -> int:
        """The number of the k-th row kept."""
        for start, size, here in blocks:
            if k <= here:
                return kept(copula.sample(spark, model, size, seed, start)).select("synthetic_id").orderBy("synthetic_id").limit(k).agg(F.max("synthetic_id")).first()[0]
            k -= here
        raise LookupError("fewer rows are kept")

    whole, rest = divmod(n, have) if have else (0, 0)
    end = 0 if not have else last(n) + 1 if have >= n else drawn
    rows = finish(applied(kept(copula.sample(spark, model, end, seed)), constraints, seed=seed))
    if whole == 0 or (whole, rest) == (1, 0):
        return rows.withColumn("replica", F.lit(0))
    copies = F.lit(whole) if not rest else F.when(F.col("synthetic_id") <= last(rest), whole + 1).otherwise(whole)
    return rows.withColumn("replica", F.explode(F.sequence(F.lit(0), copies - 1)))


def share_below(rows: DataFrame, column: str, at: list[float], mean: float, std: float, low: float, high: float) -> DataFrame:
    """(x, observed, expected): the shares of a column at or under some points beside those of a truncated normal distribution."""
    cdf = lambda x: normal_cdf(F.lit((x - mean) / std))
    one = rows.where(F.col(column).isNotNull()).agg(*[F.avg((F.col(column) <= x).cast("double")).alias(f"p{i}") for i, x in enumerate(at)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"p{i}").alias("observed"), ((cdf(x) - cdf(low)) / (cdf(high) - cdf(low))).alias("expected")) for i, x in enumerate(at)])).alias("r")).select("r.*")
