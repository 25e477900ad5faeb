"""Audit of how filters interact: what every order of a set of filters keeps, removes and duplicates.

Failure flags are counted once a part, and SQL's CUBE over the flags and the part does the rest: the
grouping-set row whose selected flags are all false counts the survivors of that subset of filters,
in any order. A step of an order goes from one subset to the next, so its row joins two of them.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import NOT_SPACE, cut, lookup

COUNTS = ("docs", "good", "toxic")


def quality_flags(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({NOT_SPACE})"), 1)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * F.size(words).cast("bigint"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, docs): the number of documents by part, failures and labels.

    E is true where a smaller id has the same text (null is empty); a null id is neither smaller than another
    nor larger. Equal texts are equal SHA-256 digests. Repeated rows count each, and E treats them alike; they
    are folded first, and then rows are folded by text and labels, so that a text that a third of all rows
    have is a few rows: of those, what has the least id holds what E leaves. A document is good, or toxic, if any of its labels says so; null ids
    and ids without labels are neither.
    """
    text = docs[text_col].cast("string")
    flags = quality_flags(text)
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("same"), *[c.alias(k) for k, c in flags.items()],
    )
    rows = cut(rows.groupBy("id", "part", "same", *flags).agg(F.count("*").alias("n")))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = lookup(rows, cut(marks), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["same", "part", *flags, "good", "toxic"]
    # By text and labels: all rows, those without an id, the least id, and the rows that have it.
    least = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = least.groupBy("same").agg(F.min("least").alias("first"))
    both = least.join(first, "same")
    unique = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = both.withColumn("cases", F.explode(F.array(F.struct(F.lit(False).alias("E"), unique.alias("docs")), F.struct(F.lit(True).alias("E"), (F.col("n") - unique).alias("docs")))))
    return both.select("part", *flags, "cases.E", "good", "toxic", "cases.docs").groupBy("part", *flags, "E", "good", "toxic").agg(F.sum("docs").alias("docs"))


def survivors(cells: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(part, subset, docs, good, toxic): what each subset of `filters` leaves of each part, from one CUBE.

    `subset` has a bit for each filter, the first filter's lowest. Cells are few (32 a part and label),
    so the 2^6 grouping sets of the CUBE expand next to nothing. What has no survivors has no row.
    """
    view = cells.groupBy("part", *filters).agg(
        F.sum("docs").alias("docs"), F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"))
    subset = " + ".join(f"if(grouping({f}) = 0, {1 << i}, 0)" for i, f in enumerate(filters))
    return cells.sparkSession.sql(
        f"""select part, subset, {", ".join(COUNTS)} from (
          select part, {", ".join(filters)}, {subset} as subset, grouping(part) as all_parts, {", ".join(f"sum({c}) as {c}" for c in COUNTS)}
          from {{view}} group by cube({", ".join(filters)}, part))
        where all_parts = 0 and {" and ".join(f"({f} is null or not {f})" for f in filters)}""",
        view=view,
    )


def audit(cells: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """One row for every part, order of `filters` and step, with the counts of that step; see `op13`.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all bigint, zeros included.
    `cells` are as `flagged` gives them; parts are those that they have, so an empty table has no rows.
    """
    spark, n, everything = cells.sparkSession, len(filters), (1 << len(filters)) - 1
    cells = cut(cells)
    found = survivors(cells, filters)
    parts = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(everything))))
    whole = cut(parts.join(found, ["part", "subset"], "left").na.fill(0, list(COUNTS)))
    steps = [("".join(order), i + 1, sum(1 << filters.index(f) for f in order[:i]), 1 << filters.index(order[i])) for order in permutations(filters) for i in range(n)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")  # 5! * 5 rows
    pairs = [(a, 1 << i, math.factorial(bin(a).count("1")) * math.factorial(n - 1 - bin(a).count("1"))) for i in range(n) for a in range(1 << n) if not a >> i & 1]
    pairs = spark.createDataFrame(pairs, "before int, bit int, orders long")

    def side(name: str, *columns: str) -> DataFrame:
        return whole.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    moved = F.broadcast(pairs).join(side("before", *COUNTS), "before").withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    moved = moved.join(side("after", *COUNTS), ["part", "after"])
    moved = moved.select("part", "before", "bit", "orders", F.col("after_docs").alias("kept"), *[(F.col(f"before_{c}") - F.col(f"after_{c}")).alias(f"{c}_lost") for c in COUNTS])
    per_filter = moved.groupBy("part", "bit").agg(
        F.sum(F.col("orders") * F.col("docs_lost")).alias("shapley"), F.max(F.when(F.col("before") == 0, F.col("docs_lost"))).alias("fails"),
        F.max(F.when(F.col("before").bitwiseOR(F.col("bit")) == everything, F.col("docs_lost"))).alias("unique_fails"))
    return moved.join(F.broadcast(steps), ["before", "bit"]).join(per_filter, ["part", "bit"]).select(
        "part", "filter_order", "step", *[c.cast("bigint").alias(name) for name, c in {
            "kept": F.col("kept"), "removed": F.col("docs_lost"), "redundant": F.col("fails") - F.col("docs_lost"), "unique_fails": F.col("unique_fails"),
            "good_lost": F.col("good_lost"), "toxic_lost": F.col("toxic_lost"), "shapley": F.col("shapley")}.items()],
    )
