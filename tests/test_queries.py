"""Every query against its SQL on the smallest tables, and that none of them is trivial."""

import os

import duckdb
import pytest

from corpusloom.plans import REGISTRY

#: Results that may be empty on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(str(flat(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_matches_sql(spark, sf, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, sf)
    got = df.collect()
    rel = duck.sql(q.sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_runs(spark, sf, name):
    assert REGISTRY[name].run(spark, sf).limit(5).collect()


def test_plans_stay_small(spark):
    """A filter on the result, and steps on steps, leave the plan linear in the steps."""
    import time

    from pyspark.sql import functions as F

    from corpusloom.functions import cleaning
    from corpusloom.operators import validation

    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, md string")
    once = validation.clean(docs).filter(F.col("out") != F.col("md"))
    began = time.perf_counter()
    sizes = [len(once._jdf.queryExecution().optimizedPlan().toString())]
    twice = docs.withColumn("out", cleaning.cleaned(cleaning.cleaned(F.col("md")))).filter(F.col("out") != F.col("md"))
    sizes.append(len(twice._jdf.queryExecution().optimizedPlan().toString()))
    assert time.perf_counter() - began < 20
    assert sizes[1] < 3 * sizes[0]


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n.startswith("clean_")))
def test_cleaning_changes_something(spark, sf, name):
    assert REGISTRY[name].run(spark, sf).filter("changed").limit(1).count() == 1
