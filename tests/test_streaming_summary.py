"""The running summary against the batch one: micro-batches, restarts, nulls, closing by event time."""

import random

import pytest

from tallyform.operators import report
from tallyform.streaming import summary as live

SCHEMA = """candidate string, sample_id long, field_accuracy double, required_field_recall double, classification_correct boolean, schema_followed boolean, portrait_expected boolean, portrait_extracted boolean,
portrait_quality_score double, latency_ms double, gpu_memory_mb double, error_code string, cost_estimate string, license_status string, on_prem boolean, ts timestamp"""


def rows_of(spark, n=400, seed=3):
    rng = random.Random(seed)

    def maybe(x):
        return None if rng.random() < 0.1 else x

    rows = [
        (
            rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(101) / 100, rng.randrange(5) / 4, maybe(rng.random() < 0.5), rng.random() < 0.7, rng.random() < 0.5, rng.random() < 0.5, rng.randrange(11) / 10,
            rng.choice([0.0, 5.5, float(rng.randrange(9000))]), maybe(float(rng.randrange(9))), maybe(rng.choice(["", "INVALID_IMAGE", report.PARTIAL])), rng.choice(["low", "high"]), "approved", maybe(True), None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def in_order(df):
    cols = sorted(set(df.columns) - {"closed"})
    return sorted((repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*cols).collect()))


def test_batches_and_restarts_end_in_the_batch_summary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "RUNS", 2)
    whole = rows_of(spark)
    parts = whole.randomSplit([1.0] * 3, 5)
    for part in parts:
        part.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.keep(live.running(stream), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()  # each run goes on from the state of the last
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("batch").distinct().count() >= 6
    got = live.latest(spark, f"{tmp_path}/out")
    assert got.where("candidate is null").count() == 1
    assert in_order(got) == in_order(report.summarize(whole))


def test_candidates_without_rows_are_closed(spark, tmp_path):
    for i, (cand, minute) in enumerate([("a", 0), ("a", 1), ("b", 30), ("b", 90), ("b", 200)]):
        df = spark.sql(f"SELECT '{cand}' AS candidate, {i}L AS sample_id, 1.0D AS field_accuracy, 1.0D AS required_field_recall, true AS classification_correct, true AS schema_followed, false AS portrait_expected, false AS portrait_extracted, 0.0D AS portrait_quality_score, 7.0D AS latency_ms, CAST(NULL AS DOUBLE) AS gpu_memory_mb, '' AS error_code, 'low' AS cost_estimate, 'approved' AS license_status, true AS on_prem, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,{minute},0) AS ts")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        live.keep(live.running(stream, "ts", "10 minutes", 20 * 60_000), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out").where("closed").collect()
    assert ("a", 2) in {(r.candidate, r.n) for r in done}


def test_no_rows(spark, tmp_path):
    rows_of(spark, 0).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    live.keep(live.running(stream), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()


@pytest.mark.parametrize("counted,share,want", [([], 0.5, 0.0), ([(3.0, 1)], 0.95, 3.0), ([(1.0, 1), (2.0, 1)], 0.5, 1.5), ([(1.0, 99), (5.0, 1)], 0.95, 1.0), ([(1.0, 2), (9.0, 2)], 0.5, 5.0)])
def test_interpolation(counted, share, want):
    assert live._at(counted, share) == pytest.approx(want)
