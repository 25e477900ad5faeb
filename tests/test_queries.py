import importlib

import duckdb
import pytest

from wardline.plans import api, catalog, nl
from wardline.plans.etl_queries import patients
from wardline.sources.views import TABLES

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    want, got = con.sql(SQL[name]), catalog.queries()[name](spark, sf)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted(tuple(shown(float(x) if hasattr(x, "as_tuple") else x) for x in (r[c] for c in order)) for r in got.collect())
    b = sorted(tuple(shown(float(r[i]) if hasattr(r[i], "as_tuple") else r[i]) for i in at) for r in want.fetchall())
    assert [_same(x) for x in a] == [_same(x) for x in b]


def _same(row):
    return tuple(f"{float(x):.7g}" if x.replace(".", "").replace("-", "").replace("e", "").isdigit() else x for x in row)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    rows = catalog.queries()[name](spark, sf)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["age_group", "patients", "mean_age", "mean_los", "high_risk_share"]
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 2 = 0 and l_quantity > 10").select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "l_comment" not in plan


def test_requests(spark, sf):
    rows = patients(spark, sf).cache()
    got = api.generate(rows, "Generate 40 elderly patients with cancer or stroke").collect()
    assert len(got) == 40 and all(r.age >= 65 and {"CANCER", "NEUROLOGICAL"} & set(r.diagnoses) for r in got)
    assert got == api.generate(rows, "Generate 40 elderly patients with cancer or stroke").collect()
    near = api.similar(rows, 60, ("CANCER", "RENAL"), most=5).collect()
    assert [r.common for r in near] == sorted((r.common for r in near), reverse=True) and all(50 <= r.age <= 70 for r in near)
    assert api.original(rows, "women aged 30-55").where("gender <> 'f' or age not between 30 and 55").count() == 0
    assert api.outcomes(rows).first().n == rows.count() and api.statistics(rows).count() == 5 and api.validate(rows).count() == 5


def test_parsing_prefers_the_explicit_range(spark):
    c = nl.parse(spark, "Generate 12 old women aged 65-85 with diabetes and kidney disease")
    assert (c.age, c.gender, c.diagnoses, c.every, c.size) == ((65, 85), "f", ("DIABETES", "RENAL"), True, 12)
    assert nl.parse(spark, "admitted orders").diagnoses == () and nl.parse(spark, "").size is None
