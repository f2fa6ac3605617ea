import pytest

import __spark_entry__
from tallyform.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert same(spark, sf, registry.queries()[name], registry.oracle_sql()[name]) > 0


def test_benchmark_run(spark, sf):
    rows = registry.queries()["benchmark_run"](spark, sf).collect()
    assert {r.candidate for r in rows} == {"mock", "tesseract", "paddleocr-vl"}
    by = {c: [r for r in rows if r.candidate == c] for c in ("mock", "paddleocr-vl")}
    assert len(by["mock"]) == len(by["paddleocr-vl"])
    assert sum(r.field_accuracy for r in by["paddleocr-vl"]) > 0.9 * len(by["paddleocr-vl"])
    assert max(r.field_accuracy for r in by["mock"]) < 0.5


def test_entry_has_rows(spark, sf):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strict_scores_run_no_python(spark, sf):
    plan = registry.queries()["score_strict"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = registry.queries()["latency_percentiles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan
