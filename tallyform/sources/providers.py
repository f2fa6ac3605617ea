"""Providers: functions that turn samples (DataFrame in) into runs (DataFrame out).

A provider gets one row a sample (sample_id, document_type, text, content if images were read) and
adds what it extracts: classification, text, fields, schema_followed, portrait, latency_ms, error,
error_code, skipped. Model endpoints are callables (system text, user text, image bytes) -> answer.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.operators import extract
from tallyform.plans import catalog

Provider = Callable[[DataFrame], DataFrame]


def _portrait():
    return F.struct(F.lit(False).alias("available"), F.lit(0.0).alias("quality_score"))


def _finish(df: DataFrame, ok=None) -> DataFrame:
    for name, col in {
        "portrait": _portrait(), "latency_ms": F.create_map(F.lit("total"), F.lit(0.0)), "error": F.lit(None).cast("string"), "error_code": F.lit(None).cast("string"),
        "skipped": F.array().cast("array<string>"), "image_ok": F.lit(True),
    }.items():
        if name not in df.columns:
            df = df.withColumn(name, col)
    return df


def mock(samples: DataFrame) -> DataFrame:
    """The smoke-test provider: every sample is a nin_slip, the schema's first field is MOCK VALUE."""
    first = F.create_map(*[F.lit(x) for t, f in catalog.SCHEMAS.items() for x in (t, f[0])])
    name = F.try_element_at(first, F.col("document_type"))
    return _finish(
        samples.withColumn("classification", F.struct(F.lit("nin_slip").alias("document_type"), F.lit(0.5).alias("confidence")))
        .withColumn("text", F.lit("MOCK TEXT"))
        .withColumn("fields", F.when(name.isNotNull(), F.create_map(name, F.lit("MOCK VALUE"))).otherwise(F.create_map().cast("map<string,string>")))
        .withColumn("schema_followed", F.lit(True))
    )


def plain(samples: DataFrame) -> DataFrame:
    """Reads fields from plain OCR text and classifies by keywords of the same row's text."""
    cls = extract.keyword_class("text")
    return _finish(samples.withColumn("classification", F.struct(cls["document_type"].alias("document_type"), cls["confidence"].alias("confidence"))).withColumn("fields", extract.plain_fields("text", "document_type")).withColumn("schema_followed", F.lit(False)))


def labelled(samples: DataFrame) -> DataFrame:
    """Reads fields from labelled lines of the same row's text."""
    cls = extract.keyword_class("text")
    out = samples.withColumn("fields", extract.labelled_fields("text", "document_type"))
    return _finish(out.withColumn("classification", F.struct(cls["document_type"].alias("document_type"), cls["confidence"].alias("confidence"))).withColumn("schema_followed", F.lit(False)))


def json_answers(samples: DataFrame, answer: str = "answer", class_answer: str | None = None) -> DataFrame:
    """Reads fields (and the class, if there is an answer for it) from a model's JSON answers."""
    out = extract.json_fields(samples, answer)
    out = out.withColumn("fields", F.transform_values("fields", lambda _, v: v["value"]))
    if class_answer:
        cls = extract.answer_class(class_answer)
        out = out.withColumn("classification", F.struct(cls["document_type"].alias("document_type"), cls["confidence"].alias("confidence")))
    else:
        out = out.withColumn("classification", F.lit(None).cast("struct<document_type:string,confidence:double>"))
    return _finish(out if "text" in out.columns else out.withColumn("text", F.lit("")))


def ask(samples: DataFrame, chat: extract.Chat, system: str = "You read documents.", content: str = "content", in_flight: int = 8, retries: int = 0, backoff_s: float = 0.5, deadline_s: float | None = None) -> DataFrame:
    """samples with the endpoint's `answer` for each image, its latency, and the error where a call failed.

    A task has up to in_flight calls under way at once and takes their answers in the order of its rows. A call that
    fails is made again up to `retries` times, after backoff_s and twice as long each time, while deadline_s (seconds for
    all tries of a row, from the first) is not over; one that is still under way then is given up as a TimeoutError. A
    failed call costs its row only, with code PROVIDER_PARTIAL_FAILURE. latency_ms covers all tries.
    """

    def call(kind: str, raw: bytes | None, began: list[float]) -> tuple[str | None, str | None, float]:
        began.append(time.perf_counter())
        tried = 0
        while True:
            try:
                answer, error = chat(system, f"Give these fields as one JSON object: {extract.field_prompt(kind)}", bytes(raw or b"")), None
            except Exception as e:  # noqa: BLE001  a provider may fail in any way
                answer, error = None, f"extract_fields: {type(e).__name__}"
            pause = backoff_s * 2**tried
            tried += 1
            spent = time.perf_counter() - began[0]
            if error is None or tried > retries or (deadline_s is not None and spent + pause > deadline_s):
                return answer, error, round(spent * 1000, 1)
            time.sleep(pause)

    def answered(future: Future, began: list[float]) -> tuple[str | None, str | None, float]:
        while True:
            left = None if deadline_s is None else deadline_s - (time.perf_counter() - began[0] if began else 0.0)
            try:
                return future.result(left if left is None else max(left, 0.001))
            except FutureTimeout:
                if began and time.perf_counter() - began[0] >= deadline_s:
                    return None, "extract_fields: TimeoutError", round(deadline_s * 1000, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(max_workers=in_flight)
        try:
            for pdf in batches:
                window: deque[tuple[Future, list[float]]] = deque()
                done = []
                for kind, raw in zip(pdf["document_type"], pdf[content]):
                    if len(window) == in_flight:
                        done.append(answered(*window.popleft()))
                    began: list[float] = []
                    window.append((pool.submit(call, kind, raw, began), began))
                done += [answered(*w) for w in window]
                answers, errors, took = zip(*done) if done else ([], [], [])
                yield pdf.assign(answer=answers, error=errors, _ms=took)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    out = samples.mapInPandas(run, fields + ", answer string, error string, _ms double")
    code = F.when(F.col("error").isNotNull(), "PROVIDER_PARTIAL_FAILURE")
    return out.withColumn("error_code", code).withColumn("latency_ms", F.create_map(F.lit("extract_fields"), F.col("_ms"), F.lit("total"), F.col("_ms"))).drop("_ms")


def analyze(samples: DataFrame, ops: dict[str, Callable[[dict], object]]) -> DataFrame:
    """samples with `results` (map of operation to JSON text), latency_ms, error, error_code and skipped.

    Each operation gets the sample as a dictionary and is run on its own: a failure costs its result
    only, is named in `error` and gives code PROVIDER_PARTIAL_FAILURE. An operation that is None is
    not supported and is listed in `skipped`. Latencies are in ms, one for each operation and the total.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                results, took, errors, skipped = {}, {}, [], []
                for name, op in ops.items():
                    if op is None:
                        skipped.append(name)
                        continue
                    began = time.perf_counter()
                    try:
                        results[name] = json.dumps(op(row))
                    except Exception as e:  # noqa: BLE001  an operation may fail in any way
                        errors.append(f"{name}: {type(e).__name__}: {e}")
                    took[name] = round((time.perf_counter() - began) * 1000, 1)
                took["total"] = round(sum(took.values()), 1)
                out.append((results, took, "; ".join(errors) or None, "PROVIDER_PARTIAL_FAILURE" if errors else None, skipped))
            cols = list(zip(*out)) or [[]] * 5
            yield pdf.assign(results=cols[0], latency_ms=cols[1], error=cols[2], error_code=cols[3], skipped=cols[4])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return samples.mapInPandas(run, fields + ", results map<string,string>, latency_ms map<string,double>, error string, error_code string, skipped array<string>")


BatchOp = Callable[[pa.RecordBatch], list]


def _isolated(op: BatchOp, batch: pa.RecordBatch) -> Iterator[tuple[object, Exception | None]]:
    """Result or error of every row, in order. A part that fails is cut in halves until its failing rows stand alone."""
    todo = [(0, batch.num_rows)]
    while todo:
        a, b = todo.pop()
        if a == b:
            continue
        try:
            got = op(batch.slice(a, b - a))
            if len(got) != b - a:
                raise ValueError(f"{len(got)} results for {b - a} rows")
            yield from ((x, None) for x in got)
        except Exception as e:  # noqa: BLE001  an operation may fail in any way
            if b - a == 1:
                yield None, e
            else:
                middle = (a + b) // 2
                todo += [(middle, b), (a, middle)]


def analyze_batches(samples: DataFrame, ops: dict[str, BatchOp | None]) -> DataFrame:
    """analyze() for operations on whole Arrow batches, which give a list of one result a row.

    Where a batch fails, about 2 log2 n calls more find each failing row of its n; all other rows keep their results. An
    operation has to give a row the same result in any batch. The time of a batch is shared out among its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = [name for name, op in ops.items() if op is None]
        for batch in batches:
            n = batch.num_rows
            results, took, errors = [{} for _ in range(n)], {}, [[] for _ in range(n)]
            for name, op in ops.items():
                if op is None:
                    continue
                began = time.perf_counter()
                for i, (value, error) in enumerate(_isolated(op, batch)):
                    if error is None:
                        results[i][name] = json.dumps(value)
                    else:
                        errors[i].append(f"{name}: {type(error).__name__}: {error}")
                took[name] = round((time.perf_counter() - began) * 1000 / max(n, 1), 4)
            took["total"] = round(sum(took.values()), 4)
            more = [
                pa.array([list(r.items()) for r in results], pa.map_(pa.string(), pa.string())), pa.array([list(took.items())] * n, pa.map_(pa.string(), pa.float64())),
                pa.array(["; ".join(e) or None for e in errors], pa.string()), pa.array(["PROVIDER_PARTIAL_FAILURE" if e else None for e in errors], pa.string()), pa.array([skipped] * n, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "results", "latency_ms", "error", "error_code", "skipped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return samples.mapInArrow(run, fields + ", results map<string,string>, latency_ms map<string,double>, error string, error_code string, skipped array<string>")


def probe(list_models: Callable[[], list[str]], model: str) -> tuple[bool, str | None]:
    """Whether an endpoint answers and serves the model, and the reason if not."""
    try:
        served = list_models()
    except Exception as e:  # noqa: BLE001
        return False, f"endpoint not reachable: {type(e).__name__}"
    return (True, None) if model in served else (False, f"model {model!r} is not served (served: {', '.join(served) or 'none'})")


def probe_endpoints(endpoints: DataFrame, list_models: Callable[[dict], list[str]], model: str = "model") -> DataFrame:
    """endpoints with ok and reason (see probe), asked from the tasks; list_models gets the row as a dictionary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [probe(lambda row=row: list_models(row), row[model]) for row in pdf.to_dict("records")]
            yield pdf.assign(ok=[s[0] for s in seen], reason=[s[1] for s in seen])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in endpoints.schema)
    return endpoints.mapInPandas(run, fields + ", ok boolean, reason string")


PROVIDERS: dict[str, Provider] = {"mock": mock, "plain": plain, "text": labelled, "json": json_answers}


def build(name: str) -> Provider:
    """Provider function of a catalog name, whatever its case and surrounding spaces."""
    return PROVIDERS[catalog.provider(name)[5]]
