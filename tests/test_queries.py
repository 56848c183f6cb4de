from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from presswerk.plans import registry


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.sql(f'CREATE VIEW "{p.stem}" AS SELECT * FROM \'{p}\'')
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(round(float(x), 5)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, folder, duck, name):
    df = registry.queries()[name](spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert got == table(rel.columns, rel.fetchall())


def test_core_stands_without_the_training_data_operators():
    root = Path(registry.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "presswerk.llm" not in p.read_text(), p


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark, folder):
    q = registry.queries()
    assert "TakeOrderedAndProject" in plan(q["top_sources"](spark, folder))
    scan = plan(q["scrape_queue"](spark, folder))
    assert "PushedFilters" in scan and "EqualTo(pipeline_stage,filtered)" in scan and "content" not in scan.split("ReadSchema")[1].split("\n")[0]
    for n in ("dup_sources_nested", "run_duplicates", "company_exact", "feed_stats"):
        assert "CartesianProduct" not in plan(q[n](spark, folder)) and "BroadcastNestedLoopJoin" not in plan(q[n](spark, folder))
