"""Clinical views over the driver tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-01-01"

VIEWS = {
    "patients": """
select c_custkey as patient_id, date '1920-01-01' + cast(c_custkey * 7919 % 35000 as int) as birthdate,
  case when c_custkey % 7 = 0 then date '2021-06-01' + cast(c_custkey * 31 % 1500 as int) end as deathdate,
  case when c_custkey % 2 = 0 then 'm' else 'f' end as gender, r_name as ethnicity,
  case c_mktsegment when 'BUILDING' then 'Medicare' when 'AUTOMOBILE' then 'Medicaid' when 'MACHINERY' then 'Private'
    when 'HOUSEHOLD' then 'Government' else 'Self Pay' end as insurance
from {customer} c join {nation} n on c_nationkey = n_nationkey join {region} r on n_regionkey = r_regionkey""",
    "admissions": """
select o_orderkey as admission_id, o_custkey as patient_id, o_orderdate as admittime, cast(o_orderkey * 7919 % 200 * 144 as int) as stay_minutes,
  case substr(o_orderpriority, 1, 1) when '1' then 'EMERGENCY' when '2' then 'URGENT' when '3' then 'NEWBORN' else 'ELECTIVE' end as admission_type
from {orders} o""",
    "diagnoses": """
select o_custkey as patient_id, lpad(cast(l_partkey * 37 % 1000 as string), 3, '0') as icd9_code
from {lineitem} l join {orders} o on l_orderkey = o_orderkey where l_linenumber = 1""",
    "conditions": """
select o_custkey as patient_id, concat(case l_partkey % 12 when 0 then 'Essential hypertension' when 1 then 'Chronic kidney disease, stage 3'
  when 2 then 'Diabetes mellitus (type 2)' when 3 then 'Viral sinusitis' when 4 then 'Fracture of forearm' when 5 then 'Malignant neoplasm of breast'
  when 6 then 'Acute bronchitis' when 7 then 'Stroke' when 8 then 'Seizure disorder' when 9 then 'Sepsis caused by virus'
  when 10 then 'Normal pregnancy' else 'Coronary heart disease' end, ' - ', p_name) as description
from {lineitem} l join {orders} o on l_orderkey = o_orderkey join {part} p on l_partkey = p_partkey where l_linenumber = 2""",
    "procedures": """
select o_custkey as patient_id, l_partkey as code from {lineitem} l join {orders} o on l_orderkey = o_orderkey where l_returnflag = 'R' and l_linenumber <= 2""",
    "prescriptions": """
select o_custkey as patient_id, l_partkey as code from {lineitem} l join {orders} o on l_orderkey = o_orderkey where l_returnflag = 'A' and l_linenumber <= 3""",
    "icustays": """
select o_custkey as patient_id, o_orderkey as icustay_id, o_orderdate as intime, cast(o_orderkey * 7907 % 90 * 144 as int) as icu_minutes
from {orders} o where o_orderkey * 104729 % 3 <= 1""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Views:
    """Tables of a folder by name, and the clinical views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            text = VIEWS[name]
            return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})
        raise AttributeError(name)


def with_clauses(*names: str) -> str:
    """The views as common table expressions over tables of the same names."""
    return ", ".join(f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
