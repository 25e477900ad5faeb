"""Synthetic tables from a Gaussian copula: the columns' own distributions, joined by the correlation of their normal scores."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.operators.quantiles import below, exact_quantiles


@dataclass
class Marginal:
    """A column's distribution: `values` at equal steps of probability, or with `upto`, up to a probability each; null with probability `nulls`."""

    name: str
    kind: str
    values: list
    upto: list[float] | None = None
    nulls: float = 0.0


@dataclass
class Copula:
    marginals: list[Marginal]
    correlation: np.ndarray = field(default_factory=lambda: np.eye(0))

    def factor(self) -> np.ndarray:
        """The Cholesky factor of the nearest correlation matrix that has one (eigenvalues of at least 1e-6)."""
        if not len(self.correlation):
            return self.correlation
        values, vectors = np.linalg.eigh(self.correlation)
        fixed = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
        scale = 1 / np.sqrt(np.diag(fixed))
        return np.linalg.cholesky(fixed * scale[:, None] * scale[None, :])


def _numbers(values: list[float]) -> Column:
    """An array of doubles, in one expression: a call for each would take seconds."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def _scores(steps: int) -> list[float]:
    """Normal scores of the middle of a value that `i` grid values are less than or equal to and `j` less than, by i + j."""
    normal = NormalDist()
    return [normal.inv_cdf(min(max(k / (2 * (steps + 1)), 0.25 / (steps + 1)), 1 - 0.25 / (steps + 1))) for k in range(2 * (steps + 1) + 1)]


def _score(m: Marginal) -> Column:
    """The normal score of a row's value, by the middle of its share of the distribution; null for null."""
    if m.upto is None:
        grid, value = _numbers(m.values), F.col(m.name).cast("double")
        bits = len(m.values).bit_length()
        place = below(grid, value, bits) + below(grid, value, bits, equal=True)
        return F.when(value.isNotNull(), F.get(_numbers(_scores(len(m.values) - 1)), place))
    normal, starts = NormalDist(), [0.0, *m.upto[:-1]]
    middles = [x for v, a, b in zip(m.values, starts, m.upto, strict=True) for x in (F.lit(v), F.lit(normal.inv_cdf(min(max((a + b) / 2, 1e-9), 1 - 1e-9))))]
    return F.try_element_at(F.create_map(*middles), F.col(m.name).cast("string"))


def _attenuation(m: Marginal) -> float:
    """The correlation of a normal variable with the score of the step of `m` that it falls on: 1 but for ties."""
    normal = NormalDist()
    if m.upto is None:
        _, counts = np.unique(np.array(m.values), return_counts=True)
        upto = np.cumsum(counts) / len(m.values)
    else:
        upto = np.array(m.upto)
    edges = np.concatenate([[0.0], upto])
    scores = np.array([normal.inv_cdf(min(max((a + b) / 2, 1e-9), 1 - 1e-9)) for a, b in zip(edges, edges[1:])])
    density = np.array([normal.pdf(normal.inv_cdf(p)) if 1e-12 < p < 1 - 1e-12 else 0.0 for p in edges])
    share = np.diff(edges)
    spread = math.sqrt(max((share * scores**2).sum() - (share * scores).sum() ** 2, 0.0))
    return float((scores * -np.diff(density)).sum() / spread) if spread > 0 else 1.0


def fit(rows: DataFrame, numeric: list[str], categorical: list[str], steps: int = 1000, most_levels: int = 1000) -> Copula:
    """The copula of the columns: distributions from exact counts, and one aggregate for all correlations of normal scores.

    Columns with few values have scores with ties, which weaken correlations; they are divided by how much
    a normal variable's own correlation with its tied scores is weakened (as for polyserial correlation).

    The driver gets `steps` + 1 quantiles of a numeric column, the levels of a categorical one (an error
    over `most_levels`: it is no category), and one row of correlations. Nulls are a share of their own;
    a column with nulls only stays null. An empty table gives null columns.
    """
    facts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n{i}") for i, c in enumerate([*numeric, *categorical])]).first()
    nulls = {c: 1 - facts[f"n{i}"] / facts["n"] if facts["n"] else 1.0 for i, c in enumerate([*numeric, *categorical])}
    marginals = []
    quantiles: dict[str, dict[float, float]] = {}
    if numeric:
        for r in exact_quantiles(rows, numeric, [i / steps for i in range(steps + 1)], interpolated=False).collect():
            quantiles.setdefault(r.column, {})[r.prob] = r.value
    for c in numeric:
        marginals.append(Marginal(c, rows.schema[c].dataType.simpleString(), [v for _, v in sorted(quantiles.get(c, {}).items())], None, nulls[c]))
    stacked = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical)])
    counted = rows.select(F.explode(stacked).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").agg(F.count("*").alias("n")) if categorical else None
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where(F.col("place") <= most_levels + 1).orderBy("i", "v").collect() if categorical else []
    for i, c in enumerate(categorical):
        levels = [r for r in first if r.i == i]
        if len(levels) > most_levels:
            raise ValueError(f"{c} has over {most_levels} levels")
        counts = np.cumsum([r.n for r in levels])
        marginals.append(Marginal(c, rows.schema[c].dataType.simpleString(), [r.v for r in levels], [float(k) for k in counts / counts[-1]] if len(counts) else [], nulls[c]))
    known = [i for i, m in enumerate(marginals) if m.values]
    scored = rows.select(*[_score(marginals[i]).alias(f"z{i}") for i in known])
    pairs = [(a, b) for k, a in enumerate(known) for b in known[k + 1 :]]

    def correlation(a: str, b: str) -> Column:
        """Null where either is constant over the rows that have both."""
        spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
        return F.try_divide(F.covar_pop(a, b), spread)

    found = scored.agg(F.lit(0).alias("none"), *[correlation(f"z{a}", f"z{b}").alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    matrix, ties = np.eye(len(marginals)), {i: max(_attenuation(marginals[i]), 0.1) for i in known}
    for a, b in pairs:
        r = found[f"{a}|{b}"]
        if r is not None and r == r:
            matrix[a, b] = matrix[b, a] = np.clip(r / (ties[a] * ties[b]), -0.999, 0.999)
    return Copula(marginals, matrix)


def _uniform(ids: np.ndarray, salt: str) -> np.ndarray:
    """Numbers in (0, 1), one for each id and salt: SplitMix64 of the id, from a start that is the salt's md5."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(hashlib.md5(salt.encode()).hexdigest()[:16], 16))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _drawn(m: Marginal, z: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The values at normal scores, null where `gone` is: doubles of a numeric column, texts of a categorical one."""
    kind = pa.float64() if m.upto is None else pa.string()
    if not m.values:
        return pa.nulls(len(z), kind)
    u = np.fromiter(map(math.erfc, (z / -math.sqrt(2)).tolist()), np.float64, len(z)) / 2
    if m.upto is not None:
        place = np.minimum(np.searchsorted(m.upto, u, side="right"), len(m.values) - 1)
        return pa.array(m.values, kind).take(pa.array(place, mask=gone))
    grid, at = np.array(m.values, np.float64), u * (len(m.values) - 1)
    if m.kind in ("double", "float") or m.kind.startswith("decimal"):
        low = np.floor(at).astype(np.int64)
        value = grid[low] + (grid[np.minimum(low + 1, len(grid) - 1)] - grid[low]) * (at - low)
    else:
        value = grid[np.floor(at + 0.5).astype(np.int64)]
    return pa.array(value, kind, mask=gone)


def sample(spark: SparkSession, model: Copula, n: int, seed: str = "copula", start: int = 0, key: str = "synthetic_id") -> DataFrame:
    """`n` rows (key, the model's columns), numbered from `start`; every row's draws are keyed by its number, so any part can be drawn again.

    Numbers of fractional columns lie between neighbouring quantiles, others are values of the source. No
    shuffle: each row is drawn from its number and the seed, in Arrow batches.
    """
    factor, marginals = model.factor(), model.marginals

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            radius = lambda j: np.sqrt(-2 * np.log(_uniform(ids, f"{seed}:{j}:radius")))  # noqa: E731, B023
            normal = np.array([radius(j) * np.cos(2 * math.pi * _uniform(ids, f"{seed}:{j}:angle")) for j in range(len(marginals))])
            columns = []
            for i, m in enumerate(marginals):
                gone = _uniform(ids, f"{seed}:null{i}") < m.nulls if m.nulls > 0 else np.zeros(len(ids), bool)
                columns.append(_drawn(m, factor[i, : i + 1] @ normal[: i + 1], gone))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[f"c{i}" for i in range(len(columns) + 1)])

    kinds = ["c0 bigint", *[f"c{i} {'double' if m.upto is None else 'string'}" for i, m in enumerate(marginals, 1)]]
    drawn = spark.range(start, start + n).mapInArrow(draw, ", ".join(kinds))
    return drawn.select(F.col("c0").alias(key), *[F.col(f"c{i}").cast(m.kind).alias(m.name) for i, m in enumerate(marginals, 1)])
