"""Queries that write with the sinks and read back with the sources, and repairs of generated rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.functions import clinical as C
from wardline.operators import etl as E
from wardline.operators import sampling as S
from wardline.plans.base_sql import BASE
from wardline.plans.etl_queries import patients
from wardline.plans.registry import registry
from wardline.sources import readers, sinks
from wardline.sources.views import Views

QUERIES, SQL, query = registry()


def _folder(spark) -> str:
    return f"{sinks.shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, sf_dir):
    """A table saved as CSV and read back with its schema."""
    rows = Views(spark, sf_dir).customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = _folder(spark)
    sinks.save_csv(rows, path)
    return readers.csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("select * from (select s_suppkey as id, case when s_suppkey % 10 = 3 then 'changed' else s_name end as name, s_acctbal as amount from supplier where s_suppkey % 7 <> 0 union all select -1, 'added', 0.0)")
def collection_changes(spark, sf_dir):
    """A collection after an insert, an upsert of every tenth row with one new row, and a delete of every seventh."""
    rows = Views(spark, sf_dir).supplier.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    c = sinks.Collection(spark, _folder(spark))
    c.upsert(rows)
    c.upsert(rows.where("id % 10 = 3").withColumn("name", F.lit("changed")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("added").alias("name"), F.lit(0.0).cast(rows.schema["amount"].dataType).alias("amount"))))
    c.delete(rows.where("id % 7 = 0").select("id"))
    return c.read()


@query("select s_suppkey as id, s_name as name from supplier where s_suppkey % 5 = 0")
def collection_rollback(spark, sf_dir):
    """Rows of the first version, by key, after a second version was rolled back."""
    rows = Views(spark, sf_dir).supplier.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"))
    c = sinks.Collection(spark, _folder(spark))
    first = c.upsert(rows)
    c.upsert(rows.withColumn("name", F.lit("overwritten")))
    c.rollback(first)
    return c.get(rows.where("id % 5 = 0").select("id")).select("id", "name")


@query(BASE + """select patient_id, case when len(l) = 0 then 'OTHER' else array_to_string(l, '|') end as diagnoses, greatest(len(l), 1) as num_diagnoses from (
  select patient_id, list_filter([case when list_contains(diagnoses, 'DIABETES') then 'DIABETES' end, case when list_contains(diagnoses, 'CANCER') then 'CANCER' end, case when list_contains(diagnoses, 'RENAL') then 'RENAL' end], lambda x: x is not null) as l from pt)""")
def rebuilt_diagnoses(spark, sf_dir):
    flags = patients(spark, sf_dir).select("patient_id", *[F.array_contains("diagnoses", d).cast("int").alias(f"has_{d.lower()}") for d in ("DIABETES", "CANCER", "RENAL")])
    out = S.rebuilt_diagnoses(flags, ["has_diabetes", "has_cancer", "has_renal"])
    return out.select("patient_id", F.array_join("diagnoses", "|").alias("diagnoses"), F.col("num_diagnoses").cast("bigint").alias("num_diagnoses"))


@query("""with g as (select c_custkey as patient_id, case c_custkey % 4 when 0 then 'male' when 1 then 'female' when 2 then 'M' end as gender, case c_custkey % 3 when 0 then 'high' when 1 then 'huge' end as risk_level, cast(c_custkey * 7 % 95 as integer) as age from customer)
select patient_id, case when gender in ('male', 'female', 'unknown') then gender else 'unknown' end as gender, case when risk_level in ('low', 'medium', 'high', 'critical') then risk_level else 'medium' end as risk_level, age,
  case when age < 18 then 'pediatric' when age < 40 then 'young_adult' when age < 65 then 'middle_aged' when age < 80 then 'elderly' else 'very_elderly' end as age_group from g""")
def repaired_categories(spark, sf_dir):
    k = F.col("c_custkey")
    rows = Views(spark, sf_dir).customer.select(
        k.alias("patient_id"), F.when(k % 4 == 0, "male").when(k % 4 == 1, "female").when(k % 4 == 2, "M").alias("gender"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "huge").alias("risk_level"),
        (k * 7 % 95).cast("int").alias("age"), F.lit("?").alias("age_group"))
    return S.repaired_categories(rows)


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def cleaned_rows(spark, sf_dir):
    return E.cleaned(Views(spark, sf_dir).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), ["l_returnflag"])


@query("""select c_custkey as id, case c_custkey % 4 when 0 then c_mktsegment || '|x' else '' end as items from customer""")
def json_lists(spark, sf_dir):
    """Lists from JSON texts of which some are null, empty or broken."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.to_json(F.array("c_mktsegment", F.lit("x")))).when(k % 4 == 1, "").when(k % 4 == 2, '["broken')
    return Views(spark, sf_dir).customer.select(k.alias("id"), F.array_join(C.json_list(text), "|").alias("items"))
