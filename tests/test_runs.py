"""Calls of a run: bisection of failing batches, windows of calls, memory, health and ground truths; exact percentiles."""

import math
import random
import threading
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyform.operators import benchmark, image, report
from tallyform.sources import providers


def isolate(n, bad):
    calls = []

    def op(batch):
        calls.append(batch.num_rows)
        ids = batch.column("i").to_pylist()
        if hit := [i for i in ids if i in bad]:
            raise ValueError(hit[0])
        return [i * 2 for i in ids]

    return list(providers._isolated(op, pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], ["i"]))), len(calls)


@pytest.mark.parametrize("n,bad", [(0, set()), (1, set()), (1, {0}), (1000, set()), (1000, {0}), (1000, {999}), (1000, {1, 500, 501}), (64, set(range(64)))])
def test_bisection(n, bad):
    rows, calls = isolate(n, bad)
    assert [r[0] for r in rows] == [None if i in bad else i * 2 for i in range(n)]
    assert [str(r[1]) for r in rows if r[1]] == [str(i) for i in sorted(bad)]
    assert calls <= 1 + 2 * len(bad) * math.ceil(math.log2(max(n, 2)))
    assert bad or calls <= 1


def test_an_operation_that_gives_too_few_results():
    rows = list(providers._isolated(lambda b: [1] * min(b.num_rows, 3), pa.RecordBatch.from_arrays([pa.array(range(7))], ["i"])))
    assert [r[0] for r in rows] == [1] * 7


def test_batches_keep_their_columns(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "t") for i in range(10)], "i long, results2 string").repartition(3)
    out = providers.analyze_batches(df, {"a": lambda b: b.column("i").to_pylist(), "b": None})
    assert sorted((r.i, r.results["a"], r.results2, r.skipped[0], r.error) for r in out.collect()) == [(i, str(i), None if i % 2 else "t", "b", None) for i in range(10)]
    assert out.where("results['a'] <> i").count() == 0 and out.count() == 10


class Endpoint:
    """Counts calls under way; pickled with the closure, so used in this process only."""

    def __init__(self, wait=0.0):
        self.wait, self.now, self.most, self.calls, self.lock = wait, 0, 0, {}, threading.Lock()

    def __call__(self, system, user, content):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.calls[content] = tries = self.calls.get(content, 0) + 1
        try:
            time.sleep(self.wait * (1 + content[0] % 3))
            if content.startswith(b"flaky") and tries < 3:
                raise ConnectionError
            if content.startswith(b"gone"):
                raise KeyError
            if content.startswith(b"slow"):
                time.sleep(3)
            return content.decode()
        finally:
            with self.lock:
                self.now -= 1


def asked(monkeypatch, contents, endpoint, **how):
    """ask() run in this process on one batch."""
    frame = pd.DataFrame({"document_type": "nin_slip", "content": contents})
    got = {}

    class Samples:
        schema = []

        def mapInPandas(self, run, schema):
            got["rows"] = pd.concat(list(run(iter([frame, frame.iloc[:0]]))))
            return self

        def withColumn(self, *a):
            return self

        def drop(self, *a):
            return self

    providers.ask(Samples(), endpoint, **how)
    return got["rows"]


def test_answers_come_in_order_with_several_calls_under_way(spark, monkeypatch):
    contents = [bytes([65 + i % 26]) + str(i).encode() for i in range(60)]
    e = Endpoint(0.01)
    began = time.perf_counter()
    rows = asked(monkeypatch, contents, e, in_flight=6)
    fast = time.perf_counter() - began
    assert list(rows.answer) == [c.decode() for c in contents] and e.most == 6
    began = time.perf_counter()
    asked(monkeypatch, contents, Endpoint(0.01), in_flight=1)
    assert time.perf_counter() - began > 3 * fast


def test_retries_and_deadlines(spark, monkeypatch):
    e = Endpoint()
    rows = asked(monkeypatch, [b"a", b"flaky", b"gone", b"b"], e, retries=2, backoff_s=0.01)
    assert list(rows.answer) == ["a", "flaky", None, "b"] and list(rows.error) == [None, None, "extract_fields: KeyError", None]
    assert e.calls[b"flaky"] == 3 and e.calls[b"gone"] == 3 and e.calls[b"a"] == 1
    rows = asked(monkeypatch, [b"flaky"], Endpoint(), retries=5, backoff_s=10.0, deadline_s=0.5)
    assert list(rows.error) == ["extract_fields: ConnectionError"]  # no time is left for another try
    rows = asked(monkeypatch, [b"slow", b"a"], Endpoint(), deadline_s=0.3)
    assert list(rows.error) == ["extract_fields: TimeoutError", None] and list(rows.answer) == [None, "a"]


def samples(spark):
    rows = [(f"s{i}", "nin_slip", f"x/{i}.jpg", "clean", "NIN: 12345678901") for i in range(6)]
    return spark.createDataFrame(rows, "sample_id string, document_type string, image_path string, capture_condition string, text string")


def test_memory_and_health_of_a_run(spark, tmp_path):
    truth = spark.createDataFrame([(f"s{i}", {"nin": "12345678901"}, ["nin"], False) for i in range(6)], "sample_id string, fields map<string,string>, required_fields array<string>, portrait_present boolean")
    images = spark.createDataFrame([(f"x/{i}.jpg", b"ok" if i else b"") for i in range(5)], "image_path string, content binary")

    def decode(raw):
        if not raw:
            raise EOFError
        return np.zeros((2, 2))

    run = benchmark.run(samples(spark), truth, {"text": providers.labelled, "mock": providers.mock}, images=image.with_image_error(images, decode), memory=True)
    watch = report.HealthWatch(run, ["text", "mock"])
    watch.rows.write.parquet(f"{tmp_path}/e")
    done = spark.read.parquet(f"{tmp_path}/e")
    assert watch.n == 12 and watch.health().orderBy("candidate").collect() == report.run_health(done).orderBy("candidate").collect()
    by = {(r.candidate, r.sample_id): r for r in done.collect()}
    assert by["text", "s0"].error == "image load failed: EOFError" and by["text", "s5"].error == "image load failed: FileNotFoundError" and by["mock", "s0"].error_code == "INVALID_IMAGE"
    assert all((r.peak_memory_mb or 0) > 100 for r in done.where("error_code is null").collect())  # a JVM is larger than that
    assert by["text", "s1"].field_accuracy == 1.0


def test_of_several_ground_truths_the_least_counts(spark):
    rows = [("s1", {"nin": v}, ["nin"], False) for v in ("3", "12345678901", "2")]
    for order in (rows, rows[::-1]):
        truth = spark.createDataFrame(order, "sample_id string, fields map<string,string>, required_fields array<string>, portrait_present boolean").repartition(3)
        out = benchmark.run(samples(spark).where("sample_id = 's1'"), truth, {"text": providers.labelled}).collect()
        assert [r.field_accuracy for r in out] == [1.0]


@pytest.mark.parametrize("few,small", [(10_000, 0), (1, 0), (1, 1 << 40)])
def test_percentiles_are_exact(spark, monkeypatch, few, small):
    monkeypatch.setattr(report, "FEW_KEYS", few)
    monkeypatch.setattr(report, "SMALL_BYTES", small)
    monkeypatch.setattr(report, "SKETCH", 1 << 11)
    monkeypatch.setattr(report, "RANK_ERROR", 0.02)
    rng = random.Random(4)
    values = {"many": [rng.gauss(0, 1000) for _ in range(9000)], "ties": [rng.choice([1.0, 2.0, 5e9]) for _ in range(5000)], "one": [7.25], "two": [1.0, 2.0], None: [float(i) for i in range(300)], "same": [3.0] * 4000, "none": []}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("one", None), ("one", float("nan"))]
    got = report.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], F.col("v"), {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    out = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in got.collect()}
    assert out.keys() == values.keys() - {"none"}
    for k, vs in values.items():
        if vs:
            assert out[k] == pytest.approx(np.round(np.percentile(vs, [0, 50, 95, 100]), 1), abs=0.051), k


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_a_null_candidate_keeps_its_percentiles(spark, monkeypatch, small):
    monkeypatch.setattr(report, "SMALL_BYTES", small)
    e = spark.createDataFrame([(None, "s1", 10.0), (None, "s2", 20.0), ("a", "s3", 0.0)], "candidate string, sample_id string, latency_ms double")
    for c, t in {"field_accuracy": "double", "required_field_recall": "double", "classification_correct": "boolean", "schema_followed": "boolean", "portrait_extracted": "boolean", "portrait_expected": "boolean", "portrait_quality_score": "double", "gpu_memory_mb": "double", "cost_estimate": "string", "license_status": "string", "on_prem": "boolean", "error_code": "string"}.items():
        e = e.withColumn(c, F.lit(None).cast(t))
    assert {r.candidate: (r.latency_p50_ms, r.latency_p95_ms) for r in report.summarize(e).collect()} == {None: (15.0, 19.5), "a": (0.0, 0.0)}
