"""A sample in a target mix of diagnosis combinations: exact matches, then supersets, then random rows, of exactly the size asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import fixed
from wardline.operators.etl import combination

FILL = "fill"


def quotas(size: int, mix: dict[tuple[str, ...], float] = fixed.TARGET_MIX) -> dict[str, int]:
    """Rows for each combination by largest remainders (ties by name), so that they sum to `size` times the shares' sum, rounded."""
    names = {"+".join(sorted(k)): v * size for k, v in mix.items()}
    out = {k: math.floor(v + 1e-9) for k, v in names.items()}
    rest = round(sum(names.values())) - sum(out.values())
    for k in sorted(names, key=lambda k: (-round(names[k] - out[k], 9), k))[: max(rest, 0)]:
        out[k] += 1
    return out


def assignment(counts: dict[str, int], wanted: dict[str, int]) -> list[tuple[str, str, int, int]]:
    """(combination, target, from, to): which of a combination's ranked rows go to which target, over the lattice of combinations.

    Every target takes its exact matches first. Then those that lack rows take of the combinations that
    contain them, larger targets first, from the smallest combination on, what nobody has taken.
    """
    left, taken, out = dict(counts), dict.fromkeys(counts, 0), []

    def take(source: str, target: str, most: int) -> int:
        n = min(most, left.get(source, 0))
        if n > 0:
            out.append((source, target, taken[source], taken[source] + n))
            taken[source] += n
            left[source] -= n
        return n

    parts = lambda name: frozenset(name.split("+"))
    lacks = {t: w - take(t, t, w) for t, w in wanted.items()}
    for t in sorted(lacks, key=lambda t: (-len(parts(t)), t)):
        for c in sorted((c for c in counts if parts(t) < parts(c)), key=lambda c: (len(parts(c)), c)):
            if lacks[t] <= 0:
                break
            lacks[t] -= take(c, t, lacks[t])
    return out


def _ranked(rows: DataFrame, by: str | None, digest: str, key: str) -> DataFrame:
    """`rows` with `__place`, their rank from 0 by a keyed digest, over `by` or all: within buckets of the digest and then over the buckets."""
    keys = [by] if by else []
    rows = rows.withColumn("__b", F.substring(digest, 1, 4))
    within = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(digest, key)) - 1
    sizes = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65536 buckets
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    return rows.withColumn("__w", within).join(sizes, [*keys, "__b"]).withColumn("__place", F.col("__w") + F.col("__before")).drop("__b", "__w", "__before")


def balance(rows: DataFrame, size: int, mix: dict[tuple[str, ...], float] = fixed.TARGET_MIX, seed: str = "balance", key: str = "patient_id") -> DataFrame:
    """`rows` with `target` and `replica`: exactly `size` of them (none of an empty table).

    `target` is the combination that a row stands for, or "fill" for the random rows that make up the size; rows
    without diagnoses are OTHER. Rows are distinct where there are enough; of fewer than `size`, all come, and
    again as replica 1, 2 and so on, in keyed order. Combinations are subsets of a few categories, so
    their counts come to the driver; rows are ranked by a keyed digest, and no task orders a whole combination.
    """
    dx = F.when(F.size("diagnoses") > 0, F.col("diagnoses")).otherwise(F.array(F.lit("OTHER")))
    named = rows.withColumn("__c", F.coalesce(combination(dx), F.lit("OTHER"))).withColumn("__h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))))
    counts = {r["__c"]: r["n"] for r in named.groupBy("__c").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total or size <= 0:
        return rows.where("false").select("*", F.lit(None).cast("string").alias("target"), F.lit(0).alias("replica"))
    if total <= size:  # every row comes; some once more than others
        whole, more = divmod(size, total)
        exact = {t for t in quotas(size, mix)}
        out = _ranked(named, None, "__h", key)
        copies = whole + (F.col("__place") < more).cast("int")
        out = out.withColumn("target", F.when(F.col("__c").isin(sorted(exact)), F.col("__c")).otherwise(FILL))
        return out.withColumn("replica", F.explode(F.sequence(F.lit(0), copies - 1))).select(*rows.columns, "target", "replica")
    spans = assignment(counts, quotas(size, mix))
    table = rows.sparkSession.createDataFrame(spans, "__c string, target string, __from long, __to long")
    ranked = _ranked(named, "__c", "__h", key)
    placed = ranked.alias("r").join(F.broadcast(table).alias("t"), (F.col("r.__c") == F.col("t.__c")) & (F.col("__place") >= F.col("__from")) & (F.col("__place") < F.col("__to")), "left").select("r.*", "target")
    lack = size - sum(b - a for _, _, a, b in spans)
    rest = _ranked(placed.where("target is null").drop("__place", "target"), None, "__h", key).where(F.col("__place") < lack).withColumn("target", F.lit(FILL))
    out = placed.where("target is not null").unionByName(rest)
    return out.select(*rows.columns, "target", F.lit(0).alias("replica"))
