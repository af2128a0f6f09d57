"""Every catalog query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import slugs, views
from factloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([value(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_slug_collision_where_hashes_begin_alike(spark, tmp_path):
    parts = [(10029, "new ring"), (47427, "new ring"), (35097, "new  Ring"), (40686, "old ring"), (1, "bolt"), (2, None)]  # 10029 and 47427 share eight digits
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got, want = catalog.QUERIES["slug_collision"](spark, str(tmp_path)), con.sql(catalog.ORACLES["slug_collision"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    unique = slugs.assign_slugs(spark.read.parquet(f"{tmp_path}/part.parquet"), F.col("p_name"), F.col("p_partkey").cast("string")).filter("p_name is not null")
    assert unique.select("slug").distinct().count() == 5


def test_module_names_of_a_file(spark):
    entities = spark.createDataFrame([("function", f, n, None, 1, "s") for f, n in (("a", "x"), ("a", "y"), ("b", "z"))], "entity_type string, file string, name string, container string, line_start int, signature string")
    modules = spark.createDataFrame([(f"m{i}", ["a"]) for i in (2, 1)], "name string, source_files array<string>")
    pages = spark.createDataFrame([], "source_file string, doc_path string")
    made = views.function_index(entities, modules, pages, {"n": F.size, "first": views.first_name})
    assert sorted((r.name, r.n, r.first) for r in made.collect()) == [("x", 2, "m1"), ("y", 2, "m1"), ("z", 0, None)]
    assert {r.name: r.module_names for r in views.function_index(entities, modules, pages).collect()} == {"x": ["m1", "m2"], "y": ["m1", "m2"], "z": []}


@pytest.mark.parametrize("name", ["function_index", "search_functions"])
def test_functions_carry_no_lists(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "array_join" not in plan[: plan.index("Join Left")]  # lists are joined below the joins, once per file


def test_entities_are_ranked_before_they_meet_modules(spark):
    plan = catalog.QUERIES["module_pages"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(file#" in plan and "windowspecdefinition(slug#" not in plan  # a join before would pair every module with all entities of its file


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
