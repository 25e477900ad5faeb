"""Keyword and vector retrieval, fusion and ranking, over a bounded set of queries and all documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import text as X

# How far sources are trusted; any other counts .5.
SOURCE_WEIGHTS = {"pubmed": 1.0, "clinical_trials": 0.95, "who": 0.9, "medlineplus": 0.85, "medical_news": 0.7}


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The `k` best rows of each query with their rank.

    Rows are first cut to the best k of each of 64 salts per query, so no task sees all rows of a query.
    """
    order = [F.desc(score), tie]
    salted = scored.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).where(F.col("rank") <= k).drop("__salt")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def keyword_scores(docs: DataFrame, queries: list[tuple[int, str]], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): BM25 with idf = max(0, (N - df + .5) / (df + .5)), without a logarithm.

    The first pass counts documents, their mean length and those with each word of the queries, in one
    aggregate of one row that comes to the driver; the second scores every document by itself, so nothing is
    shuffled. Of a document's words only those of the queries are counted. `queries` is a caller's list, so it
    is a literal in the plan.
    """
    asked = {q: _tokens(text) for q, text in queries}
    vocabulary = sorted({t for ts in asked.values() for t in ts})
    empty = docs.sparkSession.createDataFrame([], "query_id int, doc_id string, score double")
    if not vocabulary:
        return empty.select("query_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")
    words = docs.select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    base = words.select("doc_id", F.size("t").alias("length"), F.filter("t", lambda w: w.isin(vocabulary)).alias("hits"))
    facts = base.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.array_contains("hits", v)).alias(f"df{i}") for i, v in enumerate(vocabulary)]).first()
    idf = {v: max(0.0, (facts.n - facts[f"df{i}"] + 0.5) / (facts[f"df{i}"] + 0.5)) for i, v in enumerate(vocabulary)}
    counted = base.where(F.size("hits") > 0).select("doc_id", "length", *[F.size(_only("hits", v)).alias(f"n{i}") for i, v in enumerate(vocabulary)])
    at = {v: i for i, v in enumerate(vocabulary)}
    wide = k1 * (1 - b + b * F.col("length") / max(facts.mean or 0.0, 1.0))
    part = lambda v: idf[v] * F.col(f"n{at[v]}") * (k1 + 1) / (F.col(f"n{at[v]}") + wide)
    scores = F.array(*[
        F.when(reduce(lambda x, y: x | y, [F.col(f"n{at[v]}") > 0 for v in ts]), F.struct(F.lit(q).alias("query_id"), reduce(lambda x, y: x + y, [part(v) for v in ts]).alias("score")))
        for q, ts in asked.items() if ts])
    return counted.select("doc_id", F.explode(F.array_compact(scores)).alias("s")).select("s.query_id", "doc_id", "s.score")


def _only(words: str, word: str) -> Column:
    return F.filter(words, lambda w: w == word)


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(r"\w+", text.lower())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def vector_scores(vectors: DataFrame, queries: list[tuple[int, list[float]]], metric: str = "cosine") -> DataFrame:
    """(query_id, doc_id, score) of every vector (doc_id, v) for a caller's list of query vectors, in one scan."""
    lists = F.array(*[F.struct(F.lit(q).alias("query_id"), F.array(*[F.lit(float(x)) for x in v]).alias("q")) for q, v in queries])
    pairs = vectors.select("doc_id", F.col("v").cast("array<double>").alias("v"), F.explode(lists).alias("x")).select("doc_id", "v", "x.query_id", "x.q")
    product = dot(F.col("v"), F.col("q"))
    score = product if metric == "inner" else F.try_divide(product, norm(F.col("v")) * norm(F.col("q")))
    return pairs.select("query_id", "doc_id", score.alias("score"))


def reciprocal_rank_fusion(ranked: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): the sum of 1 / (k + rank) over lists (query_id, doc_id, rank)."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in ranked])
    return both.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted_fusion(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.7) -> DataFrame:
    """(query_id, doc_id, score): each list's scores over its best, weighed alpha and 1 - alpha."""
    def scaled(rows: DataFrame, weight: float) -> DataFrame:
        best = F.max("score").over(Window.partitionBy("query_id"))
        return rows.select("query_id", "doc_id", F.when(best > 0, weight * F.col("score") / best).otherwise(0.0).alias("score"))

    return scaled(semantic, alpha).unionByName(scaled(keyword, 1 - alpha)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def reranked(scored: DataFrame, docs: DataFrame, query_tokens: Column) -> DataFrame:
    """Scores raised by a tenth for each distinct query word in the text, relative to the number of query words."""
    rows = scored.join(docs.select("doc_id", "text"), "doc_id")
    overlap = F.size(F.array_intersect(F.array_distinct(X.tokens(F.col("text"))), query_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))
    return rows.select(*[c for c in scored.columns if c != "score"], (F.col("score") * (1 + 0.1 * overlap)).alias("score"))


def first_of_each(rows: DataFrame, key: Column, *order) -> DataFrame:
    """One row for each key: the first in an explicit order; by an aggregate, so equal rows combine before the shuffle."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(key.alias("__key")).agg(best).select("r.*")


def source_rank(docs: DataFrame, as_of: str) -> DataFrame:
    """Relevance by trust in the source, with bonuses for recency, length, authors and address, at most 1."""
    weight = F.lit(0.5)
    for name, w in SOURCE_WEIGHTS.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    old = F.datediff(F.lit(as_of).cast("date"), F.col("publication_date"))
    recent = F.when(old < 365, 0.1).when(old < 3 * 365, 0.05).otherwise(0.0)
    content = F.when(F.length("content") > 1000, 0.05).otherwise(0.0) + F.when(F.size("authors") > 0, 0.03).otherwise(0.0) + F.when(F.length("url") > 0, 0.02).otherwise(0.0)
    return docs.withColumn("relevance", F.least(F.col("relevance_score") * weight + F.coalesce(recent, F.lit(0.0)) + content, F.lit(1.0)))


def source_summary(docs: DataFrame, titles: int = 5) -> DataFrame:
    """(source, n, mean_score, titles): the best titles of each source, kept to a few while counting."""
    ranked = top_k(docs.select("source", "doc_id", "title", "score"), titles, by="source")
    best = ranked.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("titles"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).join(best, "source")


def frontier(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within `depth` steps of the seeds over edges (src, dst), with the least number of steps."""
    seen = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    last = seen
    for d in range(1, depth + 1):
        last = last.join(edges, last.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"))
        seen = seen.unionByName(last)
    return seen


def retrieval_confidence(scores: DataFrame, by: str = "query_id") -> DataFrame:
    """Mean score, up to .2 for five results, and .1 for the share of long texts (column `length`), at most 1."""
    value = F.avg("score") + 0.2 * F.least(F.count("*") / 5.0, F.lit(1.0)) + 0.1 * F.avg((F.col("length") > 500).cast("double"))
    return scores.groupBy(by).agg(F.least(value, F.lit(1.0)).alias("confidence"), F.count("*").alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def l2_normalised(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, norm(v)))


def pooled(vectors: DataFrame, by: str, how: str = "mean") -> DataFrame:
    """(by, v): the mean, largest or first (`position` least) of each component over a key's vectors (v, position)."""
    if how == "cls":
        return vectors.groupBy(by).agg(F.min_by("v", "position").alias("v"))
    parts = vectors.select(by, F.posexplode("v").alias("i", "x"))
    value = (F.avg if how == "mean" else F.max)("x")
    return parts.groupBy(by, "i").agg(value.alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def citations(docs: DataFrame, most: int = 10) -> DataFrame:
    """At most `most` documents (type, title, score, doc_id), one for each type and beginning of the title, best first."""
    key = F.concat_ws("|", "type", F.substring("title", 1, 50))
    return first_of_each(docs.select("doc_id", "type", "title", "score"), key, (-F.col("score")).alias("a"), F.col("doc_id").alias("b")).orderBy(F.desc("score"), "doc_id").limit(most)


def generation_confidence(matched: Column, relevance: Column, hops: Column, rows: Column) -> Column:
    """.7, a tenth for a match, up to .15 for relevance and .1 for hops, less a fifth for under ten rows."""
    base = 0.5 + 0.1 + 0.1 * matched.cast("int") + F.least(0.2 * relevance, F.lit(0.15)) + F.least(0.1 * hops, F.lit(0.1))
    return F.least(base * F.when(rows < 10, 0.8).otherwise(1.0), F.lit(1.0))


def hops(start: DataFrame, links: DataFrame, steps: int = 3, width: int | None = None) -> DataFrame:
    """(topic, step, path, confidence): chains over weighted links (src, dst, weight), without coming back; confidence is the mean weight.

    All chains, so their number grows with the links of a node to the power of the steps; with `width` only
    the best `width` of each topic go on from a step (by confidence, then path).
    """
    last = start.select("topic", F.lit(0).alias("step"), F.array("topic").alias("path"), F.lit(0.0).alias("total"))
    out = last
    for k in range(1, steps + 1):
        step = last.join(links, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        last = step.select("topic", F.lit(k).alias("step"), F.array_append("path", F.col("dst")).alias("path"), (F.col("total") + F.col("weight")).alias("total"))
        last = top_k(last, width, score="total", by="topic", tie="path").drop("rank") if width else last
        out = out.unionByName(last)
    return out.where("step > 0").select("topic", "step", "path", F.try_divide("total", "step").alias("confidence"))


def across_collections(found: dict[str, DataFrame], k: int) -> DataFrame:
    """(query_id, doc_id, score, collection, rank): the `k` best of each query over collections' results (query_id, doc_id, score); ties by id."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score").withColumn("collection", F.lit(name)) for name, r in found.items()])
    return top_k(rows, k)


def relevance(score: Column, rank: Column) -> Column:
    """A result's relevance: a similarity within 0 and 1, a distance over 1 inverted, and without a score a tenth less for each rank."""
    return F.coalesce(F.when(score > 1, 1 / (1 + score)).otherwise(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))), F.greatest(F.lit(0.0), 1 - 0.1 * (rank - 1)))


def enhanced_confidence(results: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, confidence): half the `base` confidence, .3 of the mean `relevance`, .05 a `source` up to .15 and .05 a result up to .1, within 0 and 1."""
    value = 0.5 * F.max("base") + 0.3 * F.avg("relevance") + F.least(0.05 * F.countDistinct("source"), F.lit(0.15)) + F.least(F.count("*") / 20, F.lit(0.1))
    return results.groupBy(by).agg(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("confidence"))
