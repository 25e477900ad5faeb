"""Queries of text processing, over the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import splitters as P
from wardline.functions import text as X
from wardline.plans.registry import registry
from wardline.sources.views import Views

QUERIES, SQL, query = registry()

_TEMPLATES = """notes as (select p_partkey as note_id, concat('Patient ', cast(p_partkey as string), ' on ', case p_size % 4 when 0 then 'Lisinopril and metformin' when 1 then 'insulin' when 2 then 'Atorvastatin' else 'no drugs' end,
  ' with ', case p_size % 5 when 0 then 'diabetes and renal disease' when 1 then 'coronary heart disease' when 2 then 'lung cancer' when 3 then 'stroke' else 'a fever' end,
  ' had ', case p_size % 3 when 0 then 'an MRI' when 1 then 'dialysis' else 'bypass surgery' end, '. BMI: ', cast(p_size as string), ' and ', cast(p_size * 5 as string), ' mg daily. Diabetes prevalence of ', cast(p_size as string), '.5%. Mean age was ', cast(p_size + 20 as string), '.') as note from {part})"""


def notes(spark, sf_dir):
    """Clinical sentences made from numbers, as the documents have none."""
    return spark.sql("with " + _TEMPLATES + " select * from notes", part=Views(spark, sf_dir).part)


_N = "with " + _TEMPLATES.format(part="part")
_ALL = "list_sort(list_distinct(list_transform(list_concat({}), lambda x: lower(x))))"


def _all(patterns):
    return _ALL.format(", ".join(f"regexp_extract_all(note, '(?i){p}')" for p in patterns))


_CATS = ", ".join(f"case when regexp_matches(lower(note), '{p}') then '{n}' end" for n, p in X.DISEASES.items())


@query(f"{_N} select note_id, array_to_string({_all(X.DRUGS)}, ',') as drugs, array_to_string({_all(X.PROCEDURES)}, ',') as procedures, array_to_string(list_filter([{_CATS}], lambda x: x is not null), ',') as diseases from notes")
def entity_extraction(spark, sf_dir):
    n = F.col("note")
    return notes(spark, sf_dir).select("note_id", F.array_join(X.drugs(n), ",").alias("drugs"), F.array_join(X.procedures(n), ",").alias("procedures"), F.array_join(X.diseases(n), ",").alias("diseases"))


@query(f"{_N}, d as (select unnest({_all(X.DRUGS)}) as entity from notes) select entity, count(*) as n from d group by 1 order by n desc, entity limit 20")
def entity_counts(spark, sf_dir):
    d = notes(spark, sf_dir).select(F.explode(X.drugs(F.col("note"))).alias("entity"))
    return d.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20)


@query(f"{_N}, m as (select note_id, unnest(list_concat({', '.join(f'''regexp_extract_all(note, '(?i){p}', 1)''' for p in X.MEASUREMENTS)})) as v from notes) select note_id, count(*) as n, round(sum(cast(v as double)), 6) as total from m group by 1")
def measurements(spark, sf_dir):
    m = notes(spark, sf_dir).select("note_id", F.explode(X.measurements(F.col("note"))).alias("v"))
    return m.groupBy("note_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"""{_N} select lower(regexp_extract(note, '(?i)([a-z]+) (?:prevalence|rate) (?:of|was|is) (\\d+(?:\\.\\d+)?)\\s*%', 1)) as condition, count(*) as n,
  round(avg(cast(regexp_extract(note, '(?i)([a-z]+) (?:prevalence|rate) (?:of|was|is) (\\d+(?:\\.\\d+)?)\\s*%', 2) as double)), 6) as percent,
  round(avg(cast(regexp_extract(note, '(?i)mean age (?:of|was|is) (\\d+(?:\\.\\d+)?)', 1) as double)), 6) as mean_age from notes group by 1""")
def text_statistics(spark, sf_dir):
    rows = notes(spark, sf_dir).select(F.explode(X.prevalence(F.col("note"))).alias("p"), X.mean_age(F.col("note")).alias("a"))
    return rows.groupBy(F.col("p.condition").alias("condition")).agg(F.count("*").alias("n"), F.round(F.avg("p.percent"), 6).alias("percent"), F.round(F.avg("a"), 6).alias("mean_age"))


_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, 'https?://\\S+|www\\.\\S+', '', 'g'),
  '\\S+@\\S+\\.\\S+', '', 'g'), '\\s+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s\\-.,;:()/%]', '', 'g'), '\\s+([.,;:])', '\\1', 'g'), '([.,;:])\\s*', '\\1 ', 'g'))"""
_MARKUP = """case when contains(html, '<') and contains(html, '>') then replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') else html end"""


@query(f"select page_id, md5({_CLEAN.replace('{t}', _MARKUP)}) as digest from pages")
def clean_pages(spark, sf_dir):
    return Views(spark, sf_dir).pages.select("page_id", F.md5(X.clean_text(F.col("html"))).alias("digest"))


_HASH = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"


@query(f"select min(doc_id) as doc_id, count(*) as copies from documents group by {_HASH}")
def content_hash_dedup(spark, sf_dir):
    docs = Views(spark, sf_dir).documents
    return docs.groupBy(X.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_LETTERS = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"  # RE2 takes letters beyond ASCII for word ends
_WORDS = "list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')"


@query(f"""with w as (select doc_id, text, {_WORDS} as words from documents), q as (select *, len(words) as n, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(len(words), 1) as m,
  {' + '.join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in X.DISEASES.values())} + len({_all(X.DRUGS).replace('note', _LETTERS)}) + len({_all(X.PROCEDURES).replace('note', _LETTERS)}) as e,
  {' + '.join(f"cast(regexp_matches(lower(text), '{p}') as integer)" for p in X.DISEASES.values())} as c from w)
select doc_id, round(least(case when n < 10 then 0 when n < 50 then 0.2 when n < 200 then 0.3 else 0.35 end + least(10.0 * e / greatest(n, 1), 0.25) + case when len(string_split_regex(text, '[.!?]+')) >= 3 then 0.1 else 0 end
  + least(c * 0.05, 0.2) + case when m between 4 and 8 then 0.1 else 0 end, 1.0), 6) as quality from q""")
def quality_score(spark, sf_dir):
    return Views(spark, sf_dir).documents.select("doc_id", F.round(X.quality_score(F.col("text")), 6).alias("quality"))


@query("select doc_id, len(t) as n, len(list_distinct(t)) as kinds from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+') as t from documents)")
def tokenize(spark, sf_dir):
    t = X.tokens(F.coalesce("text", F.lit("")))
    return Views(spark, sf_dir).documents.select("doc_id", F.size(t).cast("bigint").alias("n"), F.size(F.array_distinct(t)).cast("bigint").alias("kinds"))


@query("""with c as (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 100) / 400.0), 1) as bigint))) as i from documents)
select doc_id, count(*) as chunks, cast(sum(length(substr(text, cast(i * 400 + 1 as bigint), 500))) as bigint) as chars, md5(string_agg(substr(text, cast(i * 400 + 1 as bigint), 500), '|' order by i)) as digest from c group by 1""")
def chunk_fixed_stride(spark, sf_dir):
    c = X.stride_chunks(F.col("text"), 500, 100)
    return Views(spark, sf_dir).documents.select("doc_id", c.alias("c")).select(
        "doc_id", F.size("c").cast("bigint").alias("chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("""with recursive p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as parts from documents where text <> ''),
w as (select doc_id, cast(1 as bigint) as i, 0 as c, length(parts[1]) as n from p where len(parts) > 0
  union all select w.doc_id, i + 1, case when n + length(parts[i + 1]) > 1000 then c + 1 else c end, case when n + length(parts[i + 1]) > 1000 then length(parts[i + 1]) else n + length(parts[i + 1]) end from w join p using (doc_id) where i < len(parts))
select doc_id, c as index, string_agg(parts[i], chr(10) || chr(10) order by i) as content from w join p using (doc_id) group by doc_id, c""")
def chunk_paragraph(spark, sf_dir):
    docs = Views(spark, sf_dir).documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return P.chunked(docs, "paragraph").select("doc_id", "index", "content")


def _chunks(spark, sf_dir, strategy):
    return P.chunked(Views(spark, sf_dir).documents, strategy).select("doc_id", "index", "content")


@query("""with recursive q as (select doc_id, parts, list_transform(parts, lambda x: length(x)) as l from (select doc_id,
  list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as parts from documents where text <> '')),
w as (select doc_id, cast(1 as bigint) as i, 0 as c, cast(1 as bigint) as lo, l[1] as n from q where len(l) > 0
  union all select doc_id, i + 1, case when over then c + 1 else c end, case when over then k else lo end, case when over then cast(coalesce(list_sum(l[k:i]), 0) as bigint) + l[i + 1] else n + l[i + 1] end
  from (select w.*, l, n + l[i + 1] > 1000 as over, case when n + l[i + 1] > 1000 then list_min(list_filter(range(lo, i + 2), lambda k: coalesce(list_sum(l[k:i]), 0) <= 200)) end as k from w join q using (doc_id) where i < len(l)))
select doc_id, c as index, array_to_string(any_value(parts)[min(lo):max(i)], ' ') as content from w join q using (doc_id) group by doc_id, c""")
def chunk_sentence(spark, sf_dir):
    return _chunks(spark, sf_dir, "sentence")


@query()
def chunk_snapped(spark, sf_dir):
    return _chunks(spark, sf_dir, "fixed")


@query()
def chunk_section(spark, sf_dir):
    return _chunks(spark, sf_dir, "semantic")


@query()
def chunk_recursive(spark, sf_dir):
    return _chunks(spark, sf_dir, "recursive")


@query("""select host, count(*) as n, cast(round(avg(length(html)), 6) as double) as mean_length from (select regexp_extract(url, '//([^/?#:]+)', 1) as host, html from pages) group by 1""")
def pages_by_host(spark, sf_dir):
    return Views(spark, sf_dir).pages.groupBy(F.regexp_extract("url", "//([^/?#:]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("html")), 6).alias("mean_length"))


@query("""select conv_id, count(*) as turns, max_by(text, turn) filter (role = 'user') as last_question from conversations group by 1""")
def conversation_turns(spark, sf_dir):
    return Views(spark, sf_dir).conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_question"))
