"""Queries that hold a cohort, its request and the literature against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed
from wardline.operators import dictionary as D
from wardline.operators import evidence as E
from wardline.operators import retrieval as R
from wardline.operators import validation as V
from wardline.operators.quantiles import exact_quantiles
from wardline.plans import nl
from wardline.plans.base_sql import BASE
from wardline.plans.etl_queries import patients
from wardline.plans.registry import registry
from wardline.sources.views import Views, with_clauses

QUERIES, SQL, query = registry()

SETTINGS, TOPICS = fixed.SETTINGS, fixed.TOPICS
RELATED = {name: related[:3] for name, (_, related, _) in fixed.MEDICAL_TERMS.items()}  # a request is widened by three terms a condition

_REQUESTS = """requests as (select c_custkey as request_id, concat(case c_custkey % 6 when 0 then 'Emergency patients admitted for 5 days' when 1 then 'elective surgery cases, short stay' when 2 then 'hospice care, prolonged'
  when 3 then 'icu patients, 12 days' when 4 then 'clinic visits' else 'patients in the order of the ward' end, ' with ', case c_custkey % 4 when 0 then 'diabetes' when 1 then 'sepsis and renal failure' when 2 then 'stroke' else 'nothing' end) as q from {customer})"""


def _requests(spark, sf_dir):
    return spark.sql("with " + _REQUESTS + " select * from requests", customer=Views(spark, sf_dir).customer)


def setting(text: Column) -> Column:
    """The first clinical setting that a text names by whole words."""
    out = F.lit(None).cast("string")
    for name, words in reversed(SETTINGS.items()):
        out = F.when(text.rlike(rf"\b(?:{'|'.join(words)})\b"), name).otherwise(out)
    return out


_CASE = " ".join(f"when regexp_matches(t, '\\b(?:{'|'.join(ws)})\\b') then '{n}'" for n, ws in SETTINGS.items())


@query("with " + _REQUESTS.format(customer="customer") + f""", l as (select request_id, lower(q) as t from requests)
select request_id, case {_CASE} end as setting, cast(case when regexp_matches(t, '\\b(?:{'|'.join(SETTINGS['emergency'])})\\b') then true when regexp_matches(t, '\\b(?:elective|planned|scheduled|routine)\\b') then false end as varchar) as emergency,
  cast(try_cast(nullif(regexp_extract(t, '(\\d+)\\s*days?', 1), '') as integer) as varchar) as target_days, case when regexp_matches(t, 'short stay|\\bbrief\\b|\\bquick\\b') then 'short' when regexp_matches(t, 'long stay|\\bextended\\b|\\bprolonged\\b') then 'long' end as duration from l""")
def nl_context(spark, sf_dir):
    t = F.lower("q")
    word = lambda ws: t.rlike(rf"\b(?:{'|'.join(ws)})\b")
    return _requests(spark, sf_dir).select(
        "request_id", setting(t).alias("setting"), F.when(word(SETTINGS["emergency"]), True).when(word(["elective", "planned", "scheduled", "routine"]), False).cast("string").alias("emergency"),
        F.nullif(F.regexp_extract(t, r"(\d+)\s*days?", 1), F.lit("")).alias("target_days"),
        F.when(t.rlike(r"short stay|\bbrief\b|\bquick\b"), "short").when(t.rlike(r"long stay|\bextended\b|\bprolonged\b"), "long").alias("duration"))


_DX = ", ".join(f"case when regexp_matches(t, '\\b(?:{'|'.join(ws)})\\b') then '{n}' end" for n, ws in fixed.COHORT_WORDS.items())
_REL = " ".join(f"when '{n}' then {ts}" for n, ts in RELATED.items())


@query("with " + _REQUESTS.format(customer="customer") + f""", l as (select request_id, list_filter([{_DX}], lambda x: x is not null) as dx from (select request_id, lower(q) as t from requests))
select request_id, array_to_string(flatten(list_transform(dx, lambda d: case d {_REL} end))[1:10], '|') as terms, round(least(0.5 + least(0.1 * len(dx), 0.2), 1.0), 6) as confidence from l""")
def expand_terms(spark, sf_dir):
    def terms(d: Column) -> Column:
        out = F.array().cast("array<string>")
        for n, ts in RELATED.items():
            out = F.when(d == n, F.array(*[F.lit(t) for t in ts])).otherwise(out)
        return out

    p = _requests(spark, sf_dir).select("request_id", nl.parsed(F.col("q")).alias("p"))
    return p.select("request_id", F.array_join(F.slice(F.flatten(F.transform("p.diagnoses", terms)), 1, 10), "|").alias("terms"), F.round(nl.parse_confidence(F.col("p")), 6).alias("confidence"))


# The SQL's own literals.
_CODES = {
    "DIABETES": "E10 E11 E13 E08 E09", "CARDIOVASCULAR": "I20 I21 I22 I25 I50 I48 I49", "HYPERTENSION": "I10 I11 I12 I13 I15", "RENAL": "N17 N18 N19 N00 N05", "RESPIRATORY": "J44 J45 J18 J96 J80", "SEPSIS": "A41 R65.2 A40",
    "NEUROLOGICAL": "I60 I61 I63 I64 G40 G20 G30", "TRAUMA": "S00-S99 T07 T14", "CANCER": "C00-C96 D00-D09", "LIVER": "K70 K74 K72 B18", "PSYCHIATRIC": "F20 F30 F32 F41 F10-F19",
}
_CODE_VALUES = ", ".join(f"('{n}', '{c}')" for n, cs in _CODES.items() for c in cs.split())
_TERMS = {
    "emergency": "EMERGENCY", "elective surgery": "SURGERY", "surgery": "SURGERY", "icu": "ICU", "diabetes": "DIABETES", "sepsis": "SEPSIS", "renal": "RENAL", "renal failure": "RENAL", "stroke": "NEUROLOGICAL",
    "short stay": "STAY", "prolonged": "STAY", "patients": "PEOPLE", "patients admitted": "PEOPLE",
}
_ALTERNATION = "|".join(sorted(_TERMS, key=lambda t: (-len(t), t)))
_MEANT = ", ".join(f"('{t}', '{m}')" for t, m in _TERMS.items())
# Matches and the gaps between them, in turn, give the offsets.
_SPANS = _REQUESTS.format(customer="customer") + f""", cut as (select request_id, lower(q) as t, regexp_extract_all(lower(q), '\\b(?:{_ALTERNATION})\\b') as hits, regexp_split_to_array(lower(q), '\\b(?:{_ALTERNATION})\\b') as gaps from requests),
spans as (select request_id, hits[i] as term, cast(coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as bigint) as start
  from (select *, unnest(range(1, len(hits) + 1)) as i from cut)), meant as (select request_id, start, start + length(spans.term) as stop, spans.term, condition from spans join (values {_MEANT}) v(term, condition) on v.term = spans.term)"""


def _said(spark, sf_dir):
    terms = spark.createDataFrame(list(_TERMS.items()), "term string, condition string")
    return D.meanings(D.occurrences(_requests(spark, sf_dir), terms, "request_id", "q"), terms)


@query("with " + _SPANS + " select * from meant")
def term_spans(spark, sf_dir):
    """What requests say, by a dictionary of overlapping terms, with offsets."""
    return _said(spark, sf_dir).select("request_id", "start", "stop", "term", "condition")


@query("with " + _SPANS + f", codes as (select * from (values {_CODE_VALUES}) v(condition, code)) select distinct request_id, condition, code from meant join codes using (condition)")
def icd10_codes(spark, sf_dir):
    """The ICD-10 codes of the conditions that each request names."""
    found = _said(spark, sf_dir).select("request_id", "condition").distinct()
    return found.withColumn("code", F.explode(nl.icd10(F.col("condition"))))


_PREFIXED = "('elderly patients with '), ('ICU patients with '), ('high risk patients with ')"


@query("with " + _SPANS + f", c as (select distinct request_id, condition from meant where condition in ({', '.join(repr(n) for n in _CODES)})) select request_id, condition, s || lower(condition) as suggestion from c, (values {_PREFIXED}) v(s)")
def suggest_queries(spark, sf_dir):
    """Related requests for the conditions that each request names."""
    found = _said(spark, sf_dir).where(F.col("condition").isin(*fixed.ICD10)).select("request_id", "condition").distinct()
    s = F.array(*[F.lit(x) for x in ("elderly patients with ", "ICU patients with ", "high risk patients with ")])
    return found.select("request_id", "condition", F.explode(s).alias("s")).select("request_id", "condition", F.concat("s", F.lower("condition")).alias("suggestion"))


_TOPIC_WORDS = {
    "diabetes": "E11 E11.9", "hypertension": "I10 I11", "cardiovascular": "I25 I50", "heart": "I25 I51", "respiratory": "J44 J45", "copd": "J44", "asthma": "J45", "renal": "N18 N19", "kidney": "N18 N19", "sepsis": "A41",
    "cancer": "C80", "stroke": "I63 I64", "neurological": "G00 G89",
}
_TOPIC_VALUES = ", ".join(f"('{w}', '{c}')" for w, cs in _TOPIC_WORDS.items() for c in cs.split())
_TOPIC_TABLE = "topics as (select case p_partkey % 9 when 0 then 'E11' when 1 then 'E11.9' when 2 then 'N18' when 3 then 'N19' when 4 then 'A41' when 5 then 'I63' when 6 then 'I64' when 7 then 'C80' else 'J44' end as code, min(p_name) as title from {part} group by 1)"


@query("with " + _REQUESTS.format(customer="customer") + ", " + _TOPIC_TABLE.format(part="part") + f""", w as (select distinct request_id, code from requests, (values {_TOPIC_VALUES}) v(word, code) where contains(lower(q), word)),
a as (select * from w union all select request_id, 'E11' from requests where request_id not in (select request_id from w))
select request_id, a.code, title from a join topics on topics.code = a.code""")
def topic_lookup(spark, sf_dir):
    """Titles of the topics that a request's words lead to by ICD-10 codes; diabetes where they lead to none."""
    words = spark.createDataFrame([(w, c) for w, cs in fixed.TOPIC_CODES.items() for c in cs], "term string, code string")
    asked = _requests(spark, sf_dir)
    found = D.meanings(D.occurrences(asked, words, "request_id", "q", words=False), words).select("request_id", "code").distinct()
    codes = asked.select("request_id").join(found, "request_id", "left").withColumn("code", F.coalesce("code", F.lit("E11")))
    topics = spark.sql("with " + _TOPIC_TABLE + " select * from topics", part=Views(spark, sf_dir).part)
    return codes.join(topics, "code").select("request_id", "code", "title")


_ARTICLES = """articles as (select p_partkey as article_id, case p_size % 4 when 0 then 'Diabetes Mellitus, Type 2' when 1 then 'Heart Failure' when 2 then 'Hyperglycemia' else 'Infection' end as heading,
  concat('Study of ', case p_size % 3 when 0 then 'insulin and glucose' when 1 then 'coronary angina' else 'sleep' end, ' in ', p_type) as abstract, 2010 + p_size % 17 as year, p_size % 5 = 0 as trial, p_size % 7 = 0 as full_text from {part})"""


def _topic_sql(name: str) -> str:
    heads, words = TOPICS[name]
    a = " + ".join(f"case when contains(lower(heading), '{h.lower()}') or contains('{h.lower()}', lower(heading)) then 0.3::double else 0 end" for h in heads)
    b = " + ".join(f"case when contains(lower(abstract), '{w}') then 0.1::double else 0 end" for w in words)
    return f"least({a} + {b}, 1.0)"


@query("with " + _ARTICLES.format(part="part") + f" select article_id, round(least(({_topic_sql('DIABETES')} + {_topic_sql('CARDIOVASCULAR')}) / 2 + greatest(0, 0.2::double - (2026 - year) * 0.02::double) + case when trial then 0.15 else 0 end + case when full_text then 0.1 else 0 end, 1.0), 6) as score from articles")
def article_score(spark, sf_dir):
    rows = spark.sql("with " + _ARTICLES + " select * from articles", part=Views(spark, sf_dir).part)

    def topic(name: str) -> Column:
        heads, words = TOPICS[name]
        h, text = F.lower("heading"), F.lower("abstract")
        score = F.lit(0.0)
        for x in heads:
            score = score + F.when(h.contains(x.lower()) | F.lit(x.lower()).contains(h), 0.3).otherwise(0.0)
        for w in words:
            score = score + F.when(text.contains(w), 0.1).otherwise(0.0)
        return F.least(score, F.lit(1.0))

    base = (topic("DIABETES") + topic("CARDIOVASCULAR")) / 2
    bonus = F.greatest(F.lit(0.0), 0.2 - (2026 - F.col("year")) * 0.02) + F.when(F.col("trial"), 0.15).otherwise(0.0) + F.when(F.col("full_text"), 0.1).otherwise(0.0)
    return rows.select("article_id", F.round(F.least(base + bonus, F.lit(1.0)), 6).alias("score"))


def query_alignment(rows: DataFrame, cohort: nl.Cohort) -> DataFrame:
    """(check, actual, score): prevalence of each wanted condition, share within the age range, size against the wanted one."""
    facts = [F.struct(F.lit(f"prevalence:{d}").alias("check"), F.avg(F.array_contains("diagnoses", d).cast("double")).alias("actual")) for d in cohort.diagnoses]
    if cohort.age:
        facts.append(F.struct(F.lit("age").alias("check"), F.avg(F.col("age").between(*cohort.age).cast("double")).alias("actual")))
    if cohort.size:
        facts.append(F.struct(F.lit("size").alias("check"), (F.count("*") / float(cohort.size)).alias("actual")))
    long = rows.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("x")).select("x.*")
    a = F.col("actual")
    score = (
        F.when(F.col("check").startswith("prevalence"), F.when(a >= 0.5, 1.0).when(a >= 0.2, 0.6).otherwise(0.2)).when(F.col("check") == "age", F.when(a >= 0.8, 1.0).when(a >= 0.5, 0.7).otherwise(0.3))
        .otherwise(F.when(a.between(0.9, 1.1), 1.0).when(a.between(0.7, 1.3), 0.8).otherwise(0.5))
    )
    return long.withColumn("score", score)


@query(BASE + """, f as (select 'prevalence:RENAL' as "check", avg(cast(list_contains(diagnoses, 'RENAL') as double)) as actual from pt union all select 'prevalence:CANCER', avg(cast(list_contains(diagnoses, 'CANCER') as double)) from pt
union all select 'age', avg(cast(age between 30 and 70 as double)) from pt union all select 'size', count(*) / 1200.0::double from pt)
select "check", round(actual, 6) as actual, case when starts_with("check", 'prev') then case when actual >= 0.5 then 1.0::double when actual >= 0.2 then 0.6 else 0.2 end when "check" = 'age' then case when actual >= 0.8 then 1.0::double when actual >= 0.5 then 0.7 else 0.3 end
  else case when actual between 0.9 and 1.1 then 1.0::double when actual between 0.7 and 1.3 then 0.8 else 0.5 end end as score from f""")
def query_alignment_checks(spark, sf_dir):
    cohort = nl.Cohort(diagnoses=("RENAL", "CANCER"), age=(30, 70), size=1200)
    return query_alignment(patients(spark, sf_dir), cohort).withColumn("actual", F.round("actual", 6))


_RATIO = " union all ".join(f"select '{c}' as condition, avg(cast(list_contains(diagnoses, '{c}') as double)) / {r}::double as ratio from pt" for c, (r, _, _) in V.PREVALENCE.items())


@query(BASE + f"select condition, round(ratio, 6) as ratio, case when ratio between 0.5 and 2 then 1.0::double when ratio between 0.25 and 4 then 0.7 else 0.3 end as score from ({_RATIO})")
def literature_alignment(spark, sf_dir):
    ratio = F.col("observed") / F.col("expected")
    return V.prevalence_test(patients(spark, sf_dir)).select("condition", F.round(ratio, 6).alias("ratio"), F.when(ratio.between(0.5, 2), 1.0).when(ratio.between(0.25, 4), 0.7).otherwise(0.3).alias("score"))


_TEXTS = """texts as (select p_partkey as doc_id, case p_partkey % 4 when 0 then 'pubmed' when 1 then 'who' when 2 then 'clinical_trials' else 'medical_news' end as source,
  concat('Of those seen ', p_size + 2, '% of patients had ', case p_partkey % 3 when 0 then 'diabetes' when 1 then 'hypertension' else 'anemia' end, '. The prevalence of ', case p_partkey % 2 when 0 then 'Renal' else 'sepsis' end, ' was ', p_size % 30 + 1, '.5%; mean age was ', 40 + p_size % 40, ' in elderly adults.') as content from {part})"""
_STATED = """stated as (select p_partkey as doc_id, p_partkey % 4 as source, case p_partkey % 3 when 0 then 'DIABETES' else 'HYPERTENSION' end as condition, (p_size + 2) / 100.0::double as rate from part where p_partkey % 3 <> 2
  union all select p_partkey, p_partkey % 4, case p_partkey % 2 when 0 then 'RENAL' else 'SEPSIS' end, (p_size % 30 + 1.5) / 100.0::double from part)"""
_PUBLISHED = "known as (select * from (values ('DIABETES', 0.25::double, 0.20::double, 0.30::double), ('HYPERTENSION', 0.45, 0.40, 0.50), ('CARDIOVASCULAR', 0.30, 0.25, 0.35), ('RESPIRATORY', 0.15, 0.12, 0.18), ('RENAL', 0.12, 0.10, 0.15), ('SEPSIS', 0.08, 0.06, 0.10), ('CANCER', 0.10, 0.08, 0.12)) v(condition, known, l, h))"
_MERGED = _STATED + ", " + _PUBLISHED + """, means as (select condition, avg(rate) as mean, count(*) as n, count(distinct source) as sources from stated group by 1),
merged as (select condition, coalesce((known + mean) / 2, known) as rate, case when mean is null then l else 0.8 * least(known, mean) end as low, case when mean is null then h else 1.2 * greatest(known, mean) end as high, coalesce(n, 0) as n, coalesce(sources, 0) as sources from known left join means using (condition))"""


def _texts(spark, sf_dir):
    return spark.sql("with " + _TEXTS + " select * from texts", part=Views(spark, sf_dir).part)


@query("with " + _MERGED + " select condition, round(rate, 6) as rate, round(low, 6) as low, round(high, 6) as high, n, sources from merged")
def evidence_merged(spark, sf_dir):
    """What texts state of prevalences, merged with the published ones."""
    out = E.merged(E.prevalences(_texts(spark, sf_dir)))
    return out.select("condition", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")], "n", "sources")


@query(BASE + ", " + _MERGED + """, o as (select condition, rate, low, high, (select avg(cast(list_contains(diagnoses, condition) as double)) from pt) as observed, (select count(*) from pt) as total from merged)
select condition, round(observed, 6) as observed, round(rate, 6) as expected, round((observed - rate) / sqrt(rate * (1 - rate) / total), 6) as z, observed between low and high as within from o""")
def evidence_compared(spark, sf_dir):
    """The patients' prevalences against the merged ones."""
    out = E.compared(patients(spark, sf_dir), E.merged(E.prevalences(_texts(spark, sf_dir))))
    return out.select("condition", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "z")], "within")


@query("select round(avg(40 + p_size % 40), 6) as mean_age, count(*) as n from part")
def evidence_ages(spark, sf_dir):
    return E.mean_ages(_texts(spark, sf_dir)).agg(F.round(F.avg("age"), 6).alias("mean_age"), F.count("*").alias("n"))


_SIX = """, mine as (select list(distinct c) as l from (select unnest(diagnoses) as c from pt)),
ref as (select list_filter([case when count_if(p_partkey % 3 = 0) > 0 then 'DIABETES' end, case when count_if(p_partkey % 3 = 1) > 0 then 'HYPERTENSION' end, case when count_if(p_partkey % 2 = 0) > 0 then 'RENAL' end, case when count_if(p_partkey % 2 = 1) > 0 then 'SEPSIS' end], lambda x: x is not null) as r,
  count(distinct p_partkey % 4) as sources from part),
x as (select unnest(diagnoses) as c, diagnoses as d from pt where len(diagnoses) >= 2),
k as (select avg(cast(case c when 'DIABETES' then list_has_any(d, ['HYPERTENSION', 'CARDIOVASCULAR', 'RENAL']) when 'HYPERTENSION' then list_has_any(d, ['CARDIOVASCULAR', 'DIABETES', 'RENAL']) when 'CARDIOVASCULAR' then list_has_any(d, ['HYPERTENSION', 'DIABETES'])
  when 'RESPIRATORY' then list_contains(d, 'CARDIOVASCULAR') when 'RENAL' then list_has_any(d, ['DIABETES', 'HYPERTENSION', 'CARDIOVASCULAR']) when 'SEPSIS' then list_has_any(d, ['RESPIRATORY', 'RENAL']) end as double)) as p from x),
s as (select len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) as j, sources from mine, ref),
a as (select avg(cast(age between 30 and 80 as double)) as a, avg(cast(50 + patient_id * 37 % 200 > 600 as double)) as v, avg(cast(lower(gender) not in ('male', 'female', 'm', 'f', '') as double)) as w from pt),
six as (select 'conditions' as "check", j >= 0.3 as passed, j as confidence from s union all select 'ages', a >= 0.8, a from a union all select 'values', v < 0.05, 1 - v from a union all select 'comorbidity', p >= 0.3, p from k
  union all select 'coverage', sources >= 1, case when sources >= 3 then 1.0 when sources = 2 then 0.8 else 0.5 end from s union all select 'consistency', 1 - w >= 0.9, 1 - w from a)"""


def _six(spark, sf_dir):
    rows = patients(spark, sf_dir).withColumn("glucose", 50 + F.col("patient_id") * 37 % 200)
    return E.cross_checks(rows, _texts(spark, sf_dir), (30, 80))


@query(BASE + _SIX + ' select "check", passed, round(confidence, 6) as confidence from six')
def cross_validation(spark, sf_dir):
    """The patients against reference texts, by six checks."""
    return _six(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(BASE + _SIX + " select round(avg(confidence), 6) as score, count_if(passed) as passed, count(*) as checks from six")
def cross_validation_report(spark, sf_dir):
    return E.cross_report(_six(spark, sf_dir)).select(F.round("score", 6).alias("score"), "passed", "checks")


@query(BASE + _SIX + " select round(j, 6) as jaccard, j >= 0.3 as passed from s")
def cross_validate_conditions(spark, sf_dir):
    """The conditions of the patients against those that reference texts support."""
    return _six(spark, sf_dir).where("check = 'conditions'").select(F.round("confidence", 6).alias("jaccard"), "passed")


_CONTEXT = _STATED + """, lit as (select condition as what, avg(rate) as expected from stated where condition in ('DIABETES', 'HYPERTENSION') group by 1 union all select 'age', avg(40 + p_size % 40) from part),
act as (select 'DIABETES' as what, avg(cast(list_contains(diagnoses, 'DIABETES') as double)) as actual from pt union all select 'HYPERTENSION', avg(cast(list_contains(diagnoses, 'HYPERTENSION') as double)) from pt union all select 'age', avg(age) from pt),
al as (select what, expected, actual, case when what = 'age' then case when abs(actual - expected) <= 10 then 1.0::double when abs(actual - expected) <= 20 then 0.7 else 0.4 end
  when actual / greatest(expected, 0.01) between 0.5 and 2 then 1.0 when actual / greatest(expected, 0.01) between 0.25 and 4 then 0.7 else 0.3 end as score from lit join act using (what))"""


@query(BASE + ", " + _CONTEXT + " select what, round(expected, 6) as expected, round(actual, 6) as actual, score, case when score = 0.3 then 'error' when score = 0.4 or (what <> 'age' and score = 0.7) then 'warning' end as severity from al")
def literature_evidence(spark, sf_dir):
    """The patients' shares and mean age against what texts state of them."""
    out = E.literature_alignment(patients(spark, sf_dir), _texts(spark, sf_dir))
    return out.select("what", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), "score", "severity")


_ASKED = """, asked as (select avg(cast(list_contains(diagnoses, 'RENAL') as double)) as a1, avg(cast(list_contains(diagnoses, 'CANCER') as double)) as a2, avg(cast(age between 30 and 70 as double)) as a3, count(*) / 1200.0::double as a4 from pt),
four as (select (case when a1 >= 0.5 then 1.0::double when a1 >= 0.2 then 0.6 else 0.2 end + case when a2 >= 0.5 then 1.0::double when a2 >= 0.2 then 0.6 else 0.2 end + case when a3 >= 0.8 then 1.0::double when a3 >= 0.5 then 0.7 else 0.3 end
  + case when a4 between 0.9 and 1.1 then 1.0::double when a4 between 0.7 and 1.3 then 0.8 else 0.5 end) / 4 as q from asked)"""


@query(BASE + ", " + _CONTEXT + _ASKED + """ select 'literature' as "check", round(avg(score), 6) as score, avg(score) >= 0.6 as passed, count_if(score < 1) as issues from al
union all select 'request', round(q, 6), q >= 0.7, (select cast(case when a1 < 0.5 then 1 else 0 end + case when a2 < 0.5 then 1 else 0 end + case when a3 < 0.8 then 1 else 0 end + case when a4 not between 0.9 and 1.1 then 1 else 0 end as bigint) from asked) from four""")
def contextual_checks(spark, sf_dir):
    """The two checks that texts and a request add to the clinical ones."""
    rows = patients(spark, sf_dir)
    asked = query_alignment(rows, nl.Cohort(diagnoses=("RENAL", "CANCER"), age=(30, 70), size=1200))
    out = E.contextual(rows, _texts(spark, sf_dir), asked).where("check in ('literature', 'request')")
    return out.select("check", F.round("score", 6).alias("score"), "passed", "issues")


@query()
def assessment(spark, sf_dir):
    """The verdict on the patients with texts and a request in view, and what is recommended."""
    rows = patients(spark, sf_dir)
    asked = query_alignment(rows, nl.Cohort(diagnoses=("RENAL", "CANCER"), age=(30, 70), size=1200))
    return E.assessment(E.contextual(rows, _texts(spark, sf_dir), asked), 10)


_NUMBERS = ["age", "hospital_los_days", "icu_los_days", "num_procedures", "num_medications", "mortality"]
_UNPIVOT = f"(unpivot (select {', '.join(f'cast({c} as double) as {c}' for c in _NUMBERS)} from pt) on {', '.join(_NUMBERS)} into name col value v)"
_PLAUSIBLE = f""", cnt as (select col, v, count(*) as c from {_UNPIVOT} group by 1, 2), mom as (select col, count(*) as n, kurtosis_pop(v) as k from {_UNPIVOT} group by 1 having count(*) >= 10),
pla as (select mom.col, k, max(c) / any_value(n) as share, count(*) as kinds, (case when k is null or isnan(k) or k between -2 and 7 then 1.0::double when k between -5 and 15 then 0.7 else 0.4 end + case when max(c) / any_value(n) > 0.5 and count(*) > 5 then 0.5 else 1.0 end) / 2 as score from cnt join mom using (col) group by mom.col, k)"""


@query(BASE + _PLAUSIBLE + ' select col as "column", round(k, 5) as kurtosis, round(share, 6) as mode_share, kinds, score from pla')
def plausible_distributions(spark, sf_dir):
    out = E.plausibility(patients(spark, sf_dir), _NUMBERS)
    return out.select("column", F.round("kurtosis", 5).alias("kurtosis"), F.round("mode_share", 6).alias("mode_share"), "kinds", "score")


@query(BASE + ", " + _MERGED + _PLAUSIBLE + """, lit as (select avg(cast((select avg(cast(list_contains(diagnoses, condition) as double)) from pt) between low and high as double)) as l from merged),
cur as (select avg(cast(year(deathdate) >= 1993 as double)) as r, avg(cast(year(deathdate) > 1998 as double)) as f from pt where deathdate is not null),
con as (select 1 - (count_if(icu_los_days > hospital_los_days) + count_if(age not between 0 and 120) + max(case when has_icu_stay not in (0, 1) then 1 else 0 end)) / (count(*) * 3.0::double) as c from pt)
select round((select avg(score) from pla), 6) as plausible, round((select l from lit), 6) as literature, round((select case when r is null then 0.8 when f > 0.01 then (r + 0.5) / 2 else r end from cur), 6) as current, round((select c from con), 6) as consistent""")
def confidence_dimensions(spark, sf_dir):
    """The dimensions of confidence that evidence, dates and rules measure."""
    out = E.confidence(patients(spark, sf_dir), _texts(spark, sf_dir), _NUMBERS, ["deathdate"], 1998)
    return out.select(*[F.round(c, 6).alias(c) for c in ("plausible", "literature", "current", "consistent")])


@query("""select case p_partkey % 4 when 0 then 'pubmed' when 1 then 'who' when 2 then 'clinical_trials' else 'medical_news' end as source,
  array_to_string(list_filter([case when count_if(p_partkey % 3 = 0) > 0 then 'DIABETES' end, case when count_if(p_partkey % 3 = 1) > 0 then 'HYPERTENSION' end, case when count_if(p_partkey % 2 = 0) > 0 then 'RENAL' end, case when count_if(p_partkey % 2 = 1) > 0 then 'SEPSIS' end], lambda x: x is not null), '|') as conditions,
  65 as age_low, 100 as age_high, 0::bigint as factors from part group by 1""")
def filters_from_texts(spark, sf_dir):
    """What the texts of each source say to filter by."""
    out = nl.from_documents(_texts(spark, sf_dir), "source")
    return out.select("source", F.array_join("conditions", "|").alias("conditions"), "age_low", "age_high", F.size("factors").cast("bigint").alias("factors"))


_STATS = """, s as (select avg(age) as m1, stddev_samp(age) as s1, avg(hospital_los_days) as m2, stddev_samp(hospital_los_days) as s2 from pt),
d as (select greatest(0, 1 - 2 * avg(cast(abs(age - m1) > 4 * s1 or abs(hospital_los_days - m2) > 4 * s2 as double))) as clinical, avg(cast(abs(age - m1) <= 3 * s1 as double)) as plausible,
  1 - avg(cast(icu_los_days > hospital_los_days or (has_icu_stay = 1 and icu_los_days = 0) as double)) as consistent from pt, s)"""


@query(BASE + _STATS + """ select round(0.30 * clinical + 0.25 * plausible + 0.20 * 0.6 + 0.10 * 0.8 + 0.15 * consistent, 6) as overall, case when 0.30 * clinical + 0.25 * plausible + 0.2 + 0.15 * consistent >= 0.9 then 'very_high'
  when 0.30 * clinical + 0.25 * plausible + 0.2 + 0.15 * consistent >= 0.75 then 'high' when 0.30 * clinical + 0.25 * plausible + 0.2 + 0.15 * consistent >= 0.5 then 'medium' else 'low' end as level from d""")
def dataset_confidence(spark, sf_dir):
    """Weights .30, .25, .20, .10 and .15 of validity, plausibility, literature (.6 without it), currency (.8) and consistency."""
    rows = patients(spark, sf_dir)
    s = rows.agg(F.avg("age").alias("m1"), F.stddev_samp("age").alias("s1"), F.avg("hospital_los_days").alias("m2"), F.stddev_samp("hospital_los_days").alias("s2"))
    wide = rows.crossJoin(F.broadcast(s))  # one row
    far = lambda c, k, n: F.abs(F.col(c) - F.col(f"m{k}")) > n * F.col(f"s{k}")
    d = wide.agg(
        F.greatest(F.lit(0.0), 1 - 2 * V.share(far("age", 1, 4) | far("hospital_los_days", 2, 4))).alias("c"), V.share(~far("age", 1, 3)).alias("p"),
        (1 - V.share((F.col("icu_los_days") > F.col("hospital_los_days")) | ((F.col("has_icu_stay") == 1) & (F.col("icu_los_days") == 0)))).alias("k"))
    overall = 0.30 * F.col("c") + 0.25 * F.col("p") + 0.2 + 0.15 * F.col("k")
    return d.select(F.round(overall, 6).alias("overall"), F.when(overall >= 0.9, "very_high").when(overall >= 0.75, "high").when(overall >= 0.5, "medium").otherwise("low").alias("level"))


@query(BASE + """select gender, age_group, count(*) as n, round(avg(age), 6) as mean_age, round(quantile_cont(age, 0.5), 6) as median_age, round(avg(mortality), 6) as mortality_rate, round(avg(has_icu_stay), 6) as icu_rate, round(avg(emergency_admission), 6) as emergency_rate from pt group by 1, 2""")
def outcome_summary(spark, sf_dir):
    rate = lambda c, n: F.round(F.avg(c), 6).alias(n)
    rows = patients(spark, sf_dir).withColumn("pair", F.concat_ws("|", "gender", "age_group"))
    medians = exact_quantiles(rows, ["age"], [0.5], by="pair").select(F.col("group").alias("pair"), F.round("value", 6).alias("median_age"))
    out = rows.groupBy("pair", "gender", "age_group").agg(F.count("*").alias("n"), rate("age", "mean_age"), rate("mortality", "mortality_rate"), rate("has_icu_stay", "icu_rate"), rate("emergency_admission", "emergency_rate"))
    return out.join(medians, "pair").drop("pair")


@query(BASE + """select has_icu_stay, count(*) as n, round(avg(hospital_los_days), 6) as mean_los, round(avg(comorbidity_score), 6) as mean_score, round(avg(mortality), 6) as mortality from pt group by 1""")
def icu_split(spark, sf_dir):
    return patients(spark, sf_dir).groupBy("has_icu_stay").agg(*[f for f in (F.count("*").alias("n"), F.round(F.avg("hospital_los_days"), 6).alias("mean_los"), F.round(F.avg("comorbidity_score"), 6).alias("mean_score"), F.round(F.avg("mortality"), 6).alias("mortality"))])


@query(BASE + """select patient_id, 2 + len(diagnoses) + case when age < 20 then 2 else 0 end + 1 + case when risk_level = 'critical' then 2 else 0 end as wanted from pt where 2 + len(diagnoses) + case when age < 20 then 2 else 0 end + 1 + case when risk_level = 'critical' then 2 else 0 end <= 10
union all select patient_id, 10 from pt where 2 + len(diagnoses) + case when age < 20 then 2 else 0 end + 1 + case when risk_level = 'critical' then 2 else 0 end > 10""")
def generation_multiplier(spark, sf_dir):
    from wardline.operators import sampling as S

    m = S.generation_multiplier(F.size("diagnoses"), F.col("age"), F.lit(True), F.col("risk_level") == "critical")
    return patients(spark, sf_dir).select("patient_id", m.alias("wanted"))


@query(f"with {with_clauses('patients')} select ethnicity, insurance, count(*) as n from patients where gender = 'f' and deathdate is not null group by rollup (ethnicity, insurance)")
def rollup_deaths(spark, sf_dir):
    return Views(spark, sf_dir).patients.where("gender = 'f' and deathdate is not null").rollup("ethnicity", "insurance").agg(F.count("*").alias("n"))


def _u(salt: str) -> str:
    return f"cast('0x' || substr(md5(cast(patient_id as varchar) || ':{salt}'), 1, 8) as bigint) / 4294967296.0"


@query(BASE + f"""select patient_id, cast({_u('mortality')} < case when age >= 70 then 0.30 when age >= 50 then 0.15 else 0.05 end as integer) as mortality, cast({_u('emergency')} < case when has_icu_stay = 1 then 0.8 else 0.45 end as integer) as emergency_admission from pt""")
def outcomes_redrawn(spark, sf_dir):
    from wardline.operators import sampling as S

    return S.outcomes_redrawn(patients(spark, sf_dir)).select("patient_id", "mortality", "emergency_admission")


@query("""with h as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from h group by 1, 2)
select label, round(sum(x), 4) as total, round(max(x), 5) as top, count(*) as width from m group by 1""")
def pooled_vectors(spark, sf_dir):
    v = Views(spark, sf_dir).embeddings.select("label", F.col("embedding").cast("array<double>").alias("v"), F.col("vec_id").alias("position"))
    out = R.pooled(v, "label")
    return out.select("label", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("v"), 5).alias("top"), F.size("v").cast("bigint").alias("width"))


_CITED = """cited as (select p_partkey as doc_id, case p_size % 3 when 0 then 'article' when 1 then 'trial' else 'news' end as type, p_type as title, p_size / 50.0 as score from {part})"""


@query("with " + _CITED.format(part="part") + " select doc_id, type, title from (select * from cited qualify row_number() over (partition by type, substr(title, 1, 50) order by score desc, doc_id) = 1) order by score desc, doc_id limit 10")
def citation_list(spark, sf_dir):
    rows = spark.sql("with " + _CITED + " select * from cited", part=Views(spark, sf_dir).part).withColumn("score", F.col("score").cast("double"))
    return R.citations(rows).select("doc_id", "type", "title")


@query("select s_suppkey as id, round(least((0.6 + 0.1 * cast(s_suppkey % 2 = 0 as integer) + least(0.2 * (s_suppkey % 10) / 10.0, 0.15) + least(0.1 * (s_suppkey % 3), 0.1)) * case when s_suppkey % 20 < 10 then 0.8 else 1 end, 1.0), 6) as confidence from supplier")
def generation_confidence(spark, sf_dir):
    k = F.col("s_suppkey")
    value = R.generation_confidence(k % 2 == 0, (k % 10) / 10.0, k % 3, k % 20)
    return Views(spark, sf_dir).supplier.select(k.alias("id"), F.round(value, 6).alias("confidence"))


_LINKS = "links as (select distinct s_nationkey as src, (s_nationkey * 7 + 3) % 25 as dst, 0.5 + (s_nationkey % 5) / 10.0 as weight from {supplier} union select distinct s_nationkey, (s_nationkey * 3 + 1) % 25, 0.9 from {supplier})"


@query(f"""with recursive {_LINKS.format(supplier='supplier')}, w as (select n_nationkey as topic, 0 as step, [n_nationkey] as path, 0.0::double as total from nation where n_nationkey < 5
  union all select topic, step + 1, list_append(path, dst), total + weight from w join links on src = path[-1] where step < 3 and not list_contains(path, dst))
select topic, cast(step as integer) as step, array_to_string(path, '>') as path, round(total / step, 6) as confidence from w where step > 0""")
def reasoning_hops(spark, sf_dir):
    v = Views(spark, sf_dir)
    links = spark.sql(f"with {_LINKS} select src, dst, cast(weight as double) as weight from links", supplier=v.supplier)
    start = v.nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("topic"))
    links = links.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "weight")
    out = R.hops(start, links)
    return out.select("topic", "step", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


_AGES = " union all ".join(f"select '{c}' as condition, {m}::double as published, count(*) as n, avg(age) as mean, stddev_samp(age) as std from pt where list_contains(diagnoses, '{V.CATEGORY.get(c, c)}')" for c, (m, _) in V.AGES.items())


@query(BASE + f"select condition, n, round(mean, 6) as mean, round((mean - published) / (std / sqrt(n)), 6) as t, abs(mean - published) <= 10 as aligned from ({_AGES})")
def age_ttest(spark, sf_dir):
    return V.age_test(patients(spark, sf_dir)).select("condition", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), "aligned")


@query(BASE + """select 'age' as "column", round(avg(age), 6) as mean, round(avg(age) - 1.96 * stddev_samp(age) / sqrt(count(age)), 6) as low, round(avg(age) + 1.96 * stddev_samp(age) / sqrt(count(age)), 6) as high from pt""")
def mean_bands(spark, sf_dir):
    return V.mean_bands(patients(spark, sf_dir), ["age"]).select("column", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_NORM = "lower(q)"
for _words in fixed.COHORT_WORDS.values():
    _NORM = f"regexp_replace({_NORM}, '\\b(?:{'|'.join(_words[1:])})\\b', '{_words[0]}', 'g')"


@query("with " + _REQUESTS.format(customer="customer") + f" select request_id, {_NORM} as q from requests")
def normalised_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", nl.normalised(F.col("q")).alias("q"))


_SAID = """said as (select c_custkey as request_id, lower(concat(case c_custkey % 5 when 0 then 'Emergency' when 1 then 'ICU' when 2 then 'Hospice' when 3 then 'Clinic' else '' end, ' patients with ',
  case c_custkey % 8 when 0 then 'T2DM and CKD' when 1 then 'septic shock' when 2 then 'liver failure or cirrhosis' when 3 then 'depression' when 4 then 'a heart attack (MI)' when 5 then 'leukemia' when 6 then 'hip fracture after a fall' else 'nothing' end,
  case c_custkey % 7 when 0 then ', ages 40-60' when 1 then ', over 65' when 2 then ', under 30' when 3 then ', aged 50' when 4 then ', 30 years old' when 5 then ', newborn' else ', octogenarian' end, case c_custkey % 3 when 0 then ', women' when 1 then ', male' else '' end)) as t from {customer})"""
_KNOWN = ", ".join(f"case {' '.join(f"""when regexp_matches(t, '\\b{w}\\b') then struct_pack(c := '{n}', v := {0.9 if len(w) > 3 else 0.7}::double)""" for w in words)} end" for n, (words, _, _) in fixed.MEDICAL_TERMS.items())
_BRINGS = " ".join(f"when '{n}' then {c}" for n, (_, _, c) in fixed.MEDICAL_TERMS.items())
_AGED = lambda k: " ".join(f"when regexp_matches(t, '\\b(?:{'|'.join(ws)})\\b') then {r[k]}" for *r, ws in fixed.AGE_TERMS)
_RANGES = [
    ("(\\d+)\\s*[-–to]+\\s*(\\d+)", "g1", "g2"), ("(?:over|above|older than|>)\\s*(\\d+)()", "g1", "100"), ("(?:under|below|younger than|<)\\s*(\\d+)()", "0", "g1"), ("age[sd]?\\s*(\\d+)()", "g1 - 5", "g1 + 5"), ("(\\d+)\\s*(?:year|yr)s?\\s*old()", "g1 - 2", "g1 + 2"),
]


def _range_sql(k: int) -> str:
    out = []
    for pattern, *bounds in _RANGES:
        groups = [f"cast(nullif(regexp_extract(t, '{pattern}', {g}), '') as integer)" for g in (1, 2)]
        out.append(f"when regexp_matches(t, '{pattern}') then least(greatest({bounds[k].replace('g1', groups[0]).replace('g2', groups[1])}, 0), 120)")
    return f"case {' '.join(out)} {_AGED(k)} end"


@query("with " + _SAID.format(customer="customer") + f""", e as (select request_id, t, list_filter([{_KNOWN}], lambda x: x is not null) as e, {_range_sql(0)} as age_low, {_range_sql(1)} as age_high,
  case when regexp_matches(t, '\\b(?:male|men|man|boy|gentleman)\\b') then 'male' when regexp_matches(t, '\\b(?:female|women|woman|girl|lady)\\b') then 'female' end as gender, case {" ".join(f"when regexp_matches(t, '\\b(?:{'|'.join(ws)})\\b') then '{n}'" for n, ws in SETTINGS.items())} end as setting from said)
select request_id, array_to_string(list_transform(e, lambda x: x.c), '|') as conditions, age_low, age_high, gender, setting, array_to_string(flatten(list_transform(e, lambda x: case x.c {_BRINGS} end))[1:10], '|') as concepts,
  round(least(0.5::double + least(0.1 * len(e), 0.2) + case when age_low is not null then 0.1 else 0 end + case when gender is not null then 0.05 else 0 end + case when setting is not null then 0.1 else 0 end + coalesce(list_avg(list_transform(e, lambda x: x.v)), 0) * 0.1, 1.0), 6) as confidence from e""")
def enhanced_requests(spark, sf_dir):
    """Requests read with the full vocabulary: conditions with their confidence, ages in five forms or by group, gender, setting, what the conditions may bring."""
    said = spark.sql("with " + _SAID + " select * from said", customer=Views(spark, sf_dir).customer)
    said = said.repartition(4 * spark.sparkContext.defaultParallelism)  # a file of few bytes is few tasks, and a row takes long
    p = said.select("request_id", nl.enhanced(F.col("t")).alias("p")).select("request_id", "p.*")
    return p.select("request_id", F.array_join("conditions", "|").alias("conditions"), "age_low", "age_high", "gender", "setting", F.array_join("concepts", "|").alias("concepts"), F.round("confidence", 6).alias("confidence"))
