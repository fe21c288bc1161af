"""The driver contract, and that nothing outside needs the training-data subpackage."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert "summarize_by" in queries


def test_nothing_else_imports_the_subpackage():
    for p in ROOT.joinpath("flowspark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(import|from)\s+\S*llm|corpus_pipeline", p.read_text()), p


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_type", "total", "n"] and df.count() == 5


def test_plans_prune_and_push_down(spark):
    import contextlib
    import io

    from flowspark import queries as q

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        q.QUERIES["where_basic"](spark, "/root/testdata/sf0.001").explain("formatted")
    text = out.getvalue()
    assert "GreaterThan(value,50.0)" in text and "EqualTo(event_type,purchase)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text and "Exchange" not in text


def test_global_order_is_not_one_task(spark):
    from flowspark import queries as q

    plan = q.QUERIES["win_tumbling_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__bucket" in plan
    for line in plan.splitlines():  # what is in one partition has a row per bucket
        if "SinglePartition" in line:
            assert "__bucket" in plan[plan.index(line) :][:600]
