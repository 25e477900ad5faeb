"""Queries of retrieval, ranking and graphs, over the documents, embeddings and customer tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.operators import retrieval as R
from wardline.operators.inverted import Index
from wardline.operators.vectors import VectorIndex
from wardline.plans.registry import registry
from wardline.sources.sinks import shared_folder
from wardline.sources.views import Views

QUERIES, SQL, query = registry()

ASKED = [(1, "the thing that was"), (2, "de la ción"), (3, "und der heit schau"), (4, "absent zzz")]


def _bm25_sql(asked) -> str:
    rows = ", ".join(f"({q}, '{t}')" for q, text in asked for t in text.split())
    return f"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as token from documents),
len as (select documents.doc_id, count(token) as length from documents left join tok using (doc_id) group by 1),
tf as (select doc_id, token, count(*) as tf from tok group by 1, 2), df as (select token, count(*) as df from tf group by 1),
facts as (select count(*) as n, avg(length) as mean from len), q as (select * from (values {rows}) v(query_id, token)),
bm as (select query_id, doc_id, sum(greatest(0, (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1)))) as score
  from q join tf using (token) join df using (token) join len using (doc_id) cross join facts group by 1, 2)"""


_BM = _bm25_sql(ASKED)
_TOP = "row_number() over (partition by query_id order by round(score, 9) desc, doc_id)"


def _bm25(spark, sf_dir):
    return R.keyword_scores(Views(spark, sf_dir).documents, ASKED).withColumn("score", F.round("score", 9))


@query(f"{_BM} select query_id, doc_id, round(score, 6) as score, {_TOP} as rank from bm qualify rank <= 10")
def bm25(spark, sf_dir):
    return R.top_k(_bm25(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"{_BM} select query_id, doc_id, round(score, 6) as score, {_TOP} as rank from bm qualify rank <= 10")
def bm25_stored(spark, sf_dir):
    """The same searches from a stored index: built with other words in every tenth document, which are then replaced by its own."""
    docs = Views(spark, sf_dir).documents.select("doc_id", "text")
    index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", parts=16)
    index.upsert(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("the thing that zzz was absent")).otherwise(F.col("text"))))
    index.upsert(docs.where("doc_id % 10 = 0"))
    found = index.search(ASKED, k=12).withColumn("score", F.round("score", 9))
    return R.top_k(found.drop("rank"), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark, sf_dir):
    return Views(spark, sf_dir).embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


SEEDS = [3, 17, 42]


def _asked_vectors(spark, sf_dir):
    """The query vectors: three rows, fetched by id."""
    rows = _vectors(spark, sf_dir).where(F.col("doc_id").isin(SEEDS)).orderBy("doc_id").collect()
    return [(r.doc_id, r.v) for r in rows]


_COS = f"""with e as (select vec_id as doc_id, embedding::double[] as v, label from embeddings),
vs as (select q.doc_id as query_id, e.doc_id, round(list_cosine_similarity(q.v, e.v), 9) as score, e.label from e join e q on q.doc_id in ({', '.join(map(str, SEEDS))}))"""


@query(f"{_COS} select query_id, doc_id, round(score, 5) as score from vs qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10")
def vector_topk(spark, sf_dir):
    scores = R.vector_scores(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return R.top_k(scores, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"{_COS} select query_id, doc_id, round(score, 5) as score from vs where query_id <> doc_id and label = 3 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5")
def similar_documents(spark, sf_dir):
    near = _vectors(spark, sf_dir).where("label = 3")
    scores = R.vector_scores(near, _asked_vectors(spark, sf_dir)).where("query_id <> doc_id").withColumn("score", F.round("score", 9))
    return R.top_k(scores, 5).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"{_COS.replace('list_cosine_similarity', 'list_inner_product')} select query_id, doc_id, round(score, 4) as score from vs where score >= 0.2 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10")
def inner_product_threshold(spark, sf_dir):
    scores = R.vector_scores(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), "inner").withColumn("score", F.round("score", 9)).where("score >= 0.2")
    return R.top_k(scores, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"))


def _index(spark, sf_dir) -> VectorIndex:
    index = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.build(_vectors(spark, sf_dir))
    return index


def _twentieths(spark, sf_dir):
    return _vectors(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v")


@query("""with e as (select vec_id as id, embedding::double[] as v from embeddings)
select q.id as query_id, e.id, round(list_cosine_similarity(q.v, e.v), 5) as score, row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, e.v), 9) desc, e.id) as rank
from e q join e on q.id % 20 = 0 and q.id <> e.id qualify rank <= 10""")
def vector_index_exact(spark, sf_dir):
    """Every 20th vector against all others, through the stored index in all its cells."""
    found = _index(spark, sf_dir).search(_twentieths(spark, sf_dir), 10, exact=True, own=False)
    return found.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query()
def vector_index_topk(spark, sf_dir):
    """Every 20th vector against all others in the cells that are probed; recall is held against the exact way in the tests."""
    return _index(spark, sf_dir).search(_twentieths(spark, sf_dir), 10, own=False)


_IN = "vs where label in (1, 2, 3) qualify row_number() over (partition by query_id, label order by score desc, doc_id) <= 5"


@query(f"{_COS} select query_id, doc_id, round(score, 5) as score, cast(label as varchar) as collection, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select * from {_IN}) qualify rank <= 8")
def multi_collection_topk(spark, sf_dir):
    """The best of three collections' five best."""
    rows, asked = _vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)
    found = {str(n): R.top_k(R.vector_scores(rows.where(F.col("label") == n), asked).withColumn("score", F.round("score", 9)), 5) for n in (1, 2, 3)}
    return R.across_collections(found, 8).select("query_id", "doc_id", F.round("score", 5).alias("score"), "collection", F.col("rank").cast("bigint").alias("rank"))


_RELEVANT = f"""{_COS}, r as (select query_id, doc_id, label, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from vs qualify rank <= 10),
x as (select query_id, doc_id, label, rank, case doc_id % 3 when 0 then null when 1 then score else 1 + abs(score) * 4 end as raw from r),
v as (select *, coalesce(case when raw > 1 then 1 / (1 + raw) else greatest(least(raw, 1), 0) end, greatest(0, 1 - 0.1::double * (rank - 1))) as rel from x)"""


def _relevant(spark, sf_dir):
    """The ten best of each query; a third without a score, a third with a distance for one."""
    rows = _vectors(spark, sf_dir)
    top = R.top_k(R.vector_scores(rows, _asked_vectors(spark, sf_dir)).withColumn("score", F.round("score", 9)), 10).join(rows.select("doc_id", "label"), "doc_id")
    raw = F.when(F.col("doc_id") % 3 == 1, F.col("score")).when(F.col("doc_id") % 3 == 2, 1 + F.abs("score") * 4)
    return top.withColumn("relevance", R.relevance(raw, F.col("rank")))


@query(f"{_RELEVANT} select query_id, doc_id, round(rel, 5) as relevance from v")
def result_relevance(spark, sf_dir):
    return _relevant(spark, sf_dir).select("query_id", "doc_id", F.round("relevance", 5).alias("relevance"))


@query(f"{_RELEVANT} select query_id, round(greatest(least(0.5 * 0.6 + 0.3 * avg(rel) + least(0.05 * count(distinct label), 0.15) + least(count(*) / 20, 0.1), 1), 0), 5) as confidence from v group by 1")
def enhanced_confidence(spark, sf_dir):
    found = _relevant(spark, sf_dir).select("query_id", "relevance", F.col("label").alias("source"), F.lit(0.6).alias("base"))
    return R.enhanced_confidence(found).withColumn("confidence", F.round("confidence", 5))


_VQ = f"""{_BM}, kw as (select query_id, doc_id, round(score, 9) as score, {_TOP} as rank from bm qualify rank <= 20),
e as (select vec_id as doc_id, embedding::double[] as v from embeddings), sem as (select case q.doc_id when 3 then 1 when 17 then 2 else 3 end as query_id, e.doc_id, round(list_cosine_similarity(q.v, e.v), 9) as score,
  row_number() over (partition by q.doc_id order by round(list_cosine_similarity(q.v, e.v), 9) desc, e.doc_id) as rank from e join e q on q.doc_id in (3, 17, 42) qualify rank <= 20)"""


def _both(spark, sf_dir):
    kw = R.top_k(_bm25(spark, sf_dir), 20)
    asked = [(i + 1, v) for i, (_, v) in enumerate(_asked_vectors(spark, sf_dir))]
    sem = R.top_k(R.vector_scores(_vectors(spark, sf_dir), asked).withColumn("score", F.round("score", 9)), 20)
    return sem, kw


@query(f"{_VQ}, f as (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from (select query_id, doc_id, rank from kw union all select query_id, doc_id, rank from sem) group by 1, 2) select query_id, doc_id, round(score, 6) as score from f qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 10")
def rrf_hybrid(spark, sf_dir):
    fused = R.reciprocal_rank_fusion(list(_both(spark, sf_dir))).withColumn("score", F.round("score", 9))
    return R.top_k(fused, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"{_VQ}, f as (select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 0.3 * score / max(score) over (partition by query_id) as score from kw union all select query_id, doc_id, 0.7 * score / max(score) over (partition by query_id) from sem) group by 1, 2) select query_id, doc_id, round(score, 6) as score from f qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 10")
def weighted_hybrid(spark, sf_dir):
    fused = R.weighted_fusion(*_both(spark, sf_dir), alpha=0.7).withColumn("score", F.round("score", 9))
    return R.top_k(fused, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""{_BM}, w as (select query_id, count(*) as words, list(token) as ts from q group by 1), top as (select query_id, doc_id, round(score, 9) as score from bm qualify {_TOP} <= 10)
select query_id, doc_id, round(score * (1 + 0.1 * len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')), ts)) / words), 6) as score from top join w using (query_id) join documents using (doc_id)""")
def rerank_overlap(spark, sf_dir):
    top = R.top_k(_bm25(spark, sf_dir), 10).select("query_id", "doc_id", "score")
    words = F.lit(None).cast("array<string>")
    for q, text in ASKED:
        words = F.when(F.col("query_id") == q, F.array(*[F.lit(t) for t in text.split()])).otherwise(words)
    return R.reranked(top, Views(spark, sf_dir).documents, words).withColumn("score", F.round("score", 6))


_ARTICLES = """articles as (select doc_id, case doc_id % 6 when 0 then 'pubmed' when 1 then 'clinical_trials' when 2 then 'who' when 3 then 'medlineplus' when 4 then 'medical_news' else 'blog' end as source,
  substr(text, 1, 40) as title, text as content, case when doc_id % 4 <> 0 then concat('https://example.org/', cast(doc_id as string)) end as url, doc_id % 3 as n_authors,
  date '2020-01-01' + cast(doc_id * 13 % 2100 as int) as publication_date, (doc_id * 37 % 100) / 100.0 as relevance_score from {documents})"""


def _articles(spark, sf_dir):
    rows = spark.sql("with " + _ARTICLES + " select * from articles", documents=Views(spark, sf_dir).documents)
    return rows.withColumn("authors", F.when(F.col("n_authors") > 0, F.sequence(F.lit(1), F.col("n_authors").cast("int"))).otherwise(F.array().cast("array<int>"))).withColumn("relevance_score", F.col("relevance_score").cast("double"))


_ART = "with " + _ARTICLES.format(documents="documents") + """, ranked as (select *, least(cast(relevance_score as double) * case source when 'pubmed' then 1.0 when 'clinical_trials' then 0.95 when 'who' then 0.9 when 'medlineplus' then 0.85 when 'medical_news' then 0.7 else 0.5 end
  + case when date '2026-01-01' - publication_date < 365 then 0.1 when date '2026-01-01' - publication_date < 1095 then 0.05 else 0 end
  + case when length(content) > 1000 then 0.05 else 0 end + case when n_authors > 0 then 0.03 else 0 end + case when length(url) > 0 then 0.02 else 0 end, 1.0) as relevance from articles)"""


@query(_ART + " select doc_id, round(relevance, 6) as relevance from ranked")
def source_rank(spark, sf_dir):
    return R.source_rank(_articles(spark, sf_dir), "2026-01-01").select("doc_id", F.round("relevance", 6).alias("relevance"))


@query(_ART + """, t as (select source, doc_id, title, row_number() over (partition by source order by round(relevance, 9) desc, doc_id) as r from ranked)
select source, count(*) as n, round(avg(round(relevance, 9)), 6) as mean_score, (select string_agg(title, '|' order by r) from t where t.source = ranked.source and r <= 3) as titles from ranked group by 1""")
def source_summary(spark, sf_dir):
    ranked = R.source_rank(_articles(spark, sf_dir), "2026-01-01").withColumn("score", F.round("relevance", 9))
    return R.source_summary(ranked, 3).select("source", "n", F.round("mean_score", 6).alias("mean_score"), F.array_join("titles", "|").alias("titles"))


@query(_ART + " select doc_id, source from articles qualify row_number() over (partition by md5(lower(trim(title)) || lower(trim(substr(content, 1, 500)))) order by relevance_score desc, doc_id) = 1")
def source_dedup(spark, sf_dir):
    rows = _articles(spark, sf_dir).select("doc_id", "source", "title", F.substring("content", 1, 500).alias("head"), "relevance_score")
    key = F.md5(F.concat(F.lower(F.trim("title")), F.lower(F.trim("head"))))
    return R.first_of_each(rows, key, (-F.col("relevance_score")).alias("a"), F.col("doc_id").alias("b")).select("doc_id", "source")


_EDGES = "edges as (select c_custkey as src, c_custkey * 31 % 1009 + 1 as dst from {customer} union select c_custkey, c_custkey * 17 % 997 + 1 from {customer})"


@query(f"""with recursive {_EDGES.format(customer='customer')}, walk as (select cast(5 as bigint) as node, 0 as depth union select dst, depth + 1 from walk join edges on node = src where depth < 4)
select node, min(depth) as depth from walk group by 1""")
def citation_frontier(spark, sf_dir):
    edges = spark.sql(f"with {_EDGES} select * from edges", customer=Views(spark, sf_dir).customer)
    return R.frontier(edges, spark.range(5, 6).withColumnRenamed("id", "node"), 4)


@query(f"{_BM}, top as (select query_id, doc_id, round(score, 9) as score from bm qualify {_TOP} <= 10) select query_id, round(least(avg(score) + 0.2 * least(count(*) / 5.0, 1) + 0.1 * avg(case when length(text) > 500 then 1.0 else 0 end), 1.0), 6) as confidence, count(*) as n from top join documents using (doc_id) group by 1")
def retrieval_confidence(spark, sf_dir):
    top = R.top_k(_bm25(spark, sf_dir), 10).join(Views(spark, sf_dir).documents.select("doc_id", F.length("text").alias("length")), "doc_id")
    return R.retrieval_confidence(top).withColumn("confidence", F.round("confidence", 6))


@query(f"{_BM}, top as (select query_id, doc_id, text from bm join documents using (doc_id) qualify {_TOP} <= 5) select query_id, doc_id, length(text) as chars from top")
def retrieve_texts(spark, sf_dir):
    top = R.top_k(_bm25(spark, sf_dir), 5)
    return top.join(Views(spark, sf_dir).documents.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", F.length("text").cast("bigint").alias("chars"))


@query()
def result_highlights(spark, sf_dir):
    top = R.top_k(_bm25(spark, sf_dir), 5).join(Views(spark, sf_dir).documents.select("doc_id", "text"), "doc_id")
    words = F.array(*[F.lit(t) for t in sorted({t for _, text in ASKED for t in text.split()})])
    return top.select("query_id", "doc_id", X.highlights(F.col("text"), words).alias("snippets"))


@query("""with s as (select l_orderkey % 50 as a, list(distinct l_partkey % 40) as l from lineitem group by 1), p as (select x.a, y.a as b, x.l as l1, y.l as l2 from s x join s y on y.a = x.a + 1)
select a, b, round(len(list_intersect(l1, l2)) / len(list_distinct(list_concat(l1, l2))), 6) as jaccard from p""")
def jaccard_neighbours(spark, sf_dir):
    s = Views(spark, sf_dir).lineitem.groupBy((F.col("l_orderkey") % 50).alias("a")).agg(F.collect_set(F.col("l_partkey") % 40).alias("l"))
    t = s.select(F.col("a").alias("b"), F.col("l").alias("m"))
    return s.join(t, F.col("b") == F.col("a") + 1).select("a", "b", F.round(R.jaccard(F.col("l"), F.col("m")), 6).alias("jaccard"))
