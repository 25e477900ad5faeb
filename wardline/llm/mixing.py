"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from weights by water-filling. A golden-ratio sequence of slots is mapped through the
cumulative targets to sources, slots are ranked within their source, and slot r of a source takes
the r-th block of that source's shuffled documents, which come at most `cap` times over. A source's
blocks have equal token counts, its target divided by its slots, so its words come to its target
however small it is. Positions in a source's line of documents and ranks of slots are two-level prefix sums (buckets,
then rows of a bucket), so a source with most of the rows is still spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import NOT_SPACE, cut, named

GRID = 1 << 31  #: resolution of the sequence; products of two grid numbers fit in a bigint
GOLDEN = int(GRID * (math.sqrt(5) - 1) / 2) | 1


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, n, source_size, idx, target, lo, hi) from one row a source (source, n, source_size).

    `idx` numbers sources by code point, null last; weights repeat over them. The mix has `share` times
    all words; a target stops at `cap` times its source's words and the excess is shared again by
    weight. [lo, hi) is the source's part of the grid. One row a source meets in one task here.
    """
    everything, by_ratio, by_idx = Window.partitionBy(), Window.orderBy("ratio", "idx"), Window.orderBy("idx")
    out = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    out = out.withColumn("w", weight).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    out = out.withColumn("total", share * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("level", (F.col("total") - before) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    out = out.withColumn("target", F.when(F.col("ratio") <= F.col("level"), F.col("most")).otherwise(F.col("w") * level))
    out = out.withColumn("hi", F.coalesce(F.floor(F.try_divide(F.sum("target").over(by_idx.rowsBetween(Window.unboundedPreceding, 0)), F.col("total")) * GRID), F.lit(0)))
    out = out.withColumn("hi", F.when(F.col("idx") == F.max("idx").over(everything), F.lit(GRID)).otherwise(F.col("hi")).cast("bigint"))
    return out.withColumn("lo", F.coalesce(F.lag("hi").over(by_idx), F.lit(0))).select("source", "n", "source_size", "idx", "target", "lo", "hi")


def _prefix(rows: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """(key, part, before): the sum of `value` over the key's smaller parts."""
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(key, part).agg(F.sum(value).alias("__v")).select(key, part, F.coalesce(F.sum("__v").over(w), F.lit(0)).alias("before"))


def schedule(targets: DataFrame, slots: int, n_sources: int) -> DataFrame:
    """(slot, idx, rank): the source of every slot of the golden-ratio sequence, and its rank there from 0."""
    cells = 1 << max(8, math.ceil(math.log2(4 * n_sources + 1)))
    width, chunk = GRID // cells, max(256, math.isqrt(slots))
    points = targets.sparkSession.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % GRID * GOLDEN % GRID).alias("u")
    ).withColumn("cell", F.expr(f"u div {width}"))
    parts = targets.where("hi > lo").select("idx", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    placed = points.join(parts, "cell").where("u >= lo and u < hi").select("slot", "idx", F.expr(f"slot div {chunk}").alias("chunk"), F.lit(1).alias("one"))
    within = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1
    return placed.withColumn("within", within).join(_prefix(placed, "idx", "chunk", "one"), ["idx", "chunk"]).select(
        "slot", "idx", (F.col("before") + F.col("within")).alias("rank")
    )


def _start_of(block: str) -> Column:
    """Where a block of a source starts in its line: `m` blocks of `due` words, whose sizes differ by one at most."""
    return F.expr(f"cast({block} as decimal(18)) * cast(due as decimal(18)) div cast(m as decimal(18))")


def _block_of(place: str) -> Column:
    return F.expr(f"(cast({place} + 1 as decimal(18)) * cast(m as decimal(18)) - 1) div cast(due as decimal(18))")


def mix_sources(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix", slots: int | None = None,
) -> DataFrame:
    """One row for every row of `docs`: id, `keep`, `size`, `source_size`, `target`, `taken`, `slot`.

    `taken` counts the words the mix takes of the document, repeats included; it is at most `cap` times
    its size, and a source's sum is its target, rounded. `slot` is the first slot of the schedule that takes
    of the document (null if none does), so documents ordered by it are the mix at any length. By default
    there are as many slots as rows, at least 131072 (and at most one a word); a source that gets none has
    one after the last. Reruns agree: the order within a source is by md5 of id, size and `seed`.
    A null source is a source of its own, ordered last; null and empty texts have size 0 and are never
    taken; null ids are ids like others; repeated rows share what falls to them in any order. An empty
    table gives an empty result. Only the named columns are read; one of `keep` that is named like
    a result gives way to it.
    """
    keep = named(docs, keep, (id_col, "size", "source_size", "target", "taken", "slot"))
    kept = [f"__keep_{c}" for c in keep]
    rows = docs.select(docs[source_col].alias("__source"), docs[id_col].alias("__id"), *[docs[c].alias(k) for c, k in zip(keep, kept, strict=True)], count_words(docs[text_col].cast("string")).alias("__size"))
    rows = cut(rows)
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n"), F.sum("__size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, cap))
    facts = targets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.count("*").alias("sources")).first()
    total = math.ceil(share * facts.words)
    count = max(1, min(slots or max(131072, facts.n), total))
    placed = cut(schedule(targets, count, facts.sources))
    plan = targets.join(placed.groupBy("idx").agg(F.count("*").alias("m")), "idx", "left").withColumn("due", F.floor(F.col("target") + 0.5).cast("bigint"))
    plan = cut(plan.withColumn("late", F.col("m").isNull()).fillna(1, ["m"]))
    late = plan.where("late").select((F.lit(count) + F.col("idx")).cast("bigint").alias("slot"), "idx", F.lit(0).alias("rank"))
    uses = placed.unionByName(late).select("idx", F.col("rank").cast("bigint").alias("cell"), "slot")

    buckets = max(1, math.isqrt(facts.n))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("__id").cast("string"), F.lit("")), F.col("__size").cast("string"), F.lit(seed)))
    line = rows.join(plan.select("source", "idx", "source_size", "target", "due", "m"), F.col("__source").eqNullSafe(F.col("source"))).drop("source", "__source")
    line = line.withColumn("__order", digest).withColumn("__bucket", F.expr(f"cast(conv(left(__order, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    inside = Window.partitionBy("idx", "__bucket").orderBy("__order", "__id", "__size")
    line = line.withColumn("__nth", F.row_number().over(inside)).withColumn("__run", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    line = line.join(_prefix(line, "idx", "__bucket", "__size"), ["idx", "__bucket"])
    line = line.withColumn("__start", F.col("before") + F.col("__run"))
    passes = F.when((F.col("__size") > 0) & (F.col("__start") < F.col("due")), F.expr(f"sequence(0, least({cap - 1}, (due - 1 - __start) div source_size))"))
    line = line.withColumn("__pass", F.explode_outer(passes)).withColumn("__from", F.col("__start") + F.col("__pass") * F.col("source_size"))
    line = line.withColumn("__to", F.least(F.col("__from") + F.col("__size"), "due"))
    pieces = line.withColumn("cell", F.explode_outer(F.when(F.col("__pass").isNotNull(), F.sequence(_block_of("__from"), _block_of("__to - 1")))))
    words = F.least("__to", _start_of("cell + 1")) - F.greatest("__from", _start_of("cell"))
    got = pieces.join(uses, ["idx", "cell"], "left").withColumn("__got", F.when(F.col("slot").isNotNull(), words).otherwise(0))
    summed = got.groupBy("idx", "__bucket", "__nth").agg(
        *[F.first(c).alias(c) for c in ("__id", *kept, "__size", "source_size", "target")], F.sum("__got").alias("taken"), F.min("slot").alias("slot")
    )
    return summed.select(
        F.col("__id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)],
        F.col("__size").alias("size"), "source_size", "target", F.col("taken").cast("bigint").alias("taken"), "slot",
    )
