"""A summary of evidence that keeps up with its rows: state for each candidate, updated with every micro-batch.

Rows are summed up by each task first, so a candidate with most of the rows sends one row a batch of Arrow and not
every row. The state of a candidate is its counts and sums and, for exact percentiles, its latencies with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tallyform.functions.numbers import rounded
from tallyform.operators import report

_SUMS = "n accuracy recall classified correct followed expected found extracted quality latencies latency gpus gpu errors".split()
_FIRST = "cost_estimate license_status on_prem".split()
#: Runs of counted latencies that a candidate's state holds before they are merged.
RUNS = 16
_SHARES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}


def _partial_schema(sample_id: str) -> str:
    return f"candidate string, {', '.join(f'{s} double' for s in _SUMS)}, sample_id {sample_id}, cost_estimate string, license_status string, on_prem boolean, newest timestamp, values array<double>, counts array<long>"


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums, counted latencies and the first row of each candidate in a batch."""
    for e in batches:
        code = e.error_code.fillna("")
        latency = e.latency_ms.where(e.latency_ms != 0)
        parts = {
            "n": 1.0, "accuracy": e.field_accuracy, "recall": e.required_field_recall, "classified": e.classification_correct.notna(), "correct": e.classification_correct.eq(True), "followed": e.schema_followed.eq(True),
            "expected": e.portrait_expected.eq(True) & e.portrait_extracted.notna(), "found": e.portrait_expected.eq(True) & e.portrait_extracted.eq(True), "extracted": e.portrait_extracted.eq(True) & e.portrait_quality_score.notna(),
            "quality": e.portrait_quality_score.where(e.portrait_extracted.eq(True), 0.0), "latencies": latency.notna(), "latency": latency, "gpus": e.gpu_memory_mb.notna(), "gpu": e.gpu_memory_mb, "errors": ~code.isin(["", report.PARTIAL]),
        }
        x = e[["candidate", "sample_id", *_FIRST, "newest"]].assign(**{k: pd.Series(v, e.index).fillna(0).astype(float) for k, v in parts.items()}, latency_ms=latency)
        rows = []
        for candidate, g in x.groupby("candidate", dropna=False, sort=False):
            first = g.sort_values("sample_id", kind="stable").iloc[0]
            seen = g.latency_ms.value_counts().sort_index()
            rows.append([None if pd.isna(candidate) else candidate, *g[_SUMS].sum(), first.sample_id, *first[_FIRST], g.newest.max(), list(seen.index), list(seen)])
        yield pd.DataFrame(rows, columns=["candidate", *_SUMS, "sample_id", *_FIRST, "newest", "values", "counts"])


class Totals(StatefulProcessor):
    """Adds partial rows to a candidate's state and gives its totals with each batch.

    With a gap in milliseconds, a timer closes a candidate that had no row for so long in event time: it is given once more
    as closed and its state is dropped.
    """

    def __init__(self, sample_id: str, gap: int | None) -> None:
        self.sample_id, self.gap = sample_id, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", ", ".join(f"{s} double" for s in _SUMS))
        self.first = handle.getValueState("first", f"sample_id {self.sample_id}, cost_estimate string, license_status string, on_prem boolean")
        self.seen = handle.getListState("latencies", "value array<double>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get()) if self.sums.exists() else [0.0] * len(_SUMS)
        first = tuple(self.first.get()) if self.first.exists() else None
        more: dict[float, int] = {}
        newest = None
        for part in rows:
            for r in part.itertuples(index=False):
                sums = [a + getattr(r, s) for a, s in zip(sums, _SUMS)]
                mine = (r.sample_id, *(getattr(r, c) for c in _FIRST))
                first = mine if first is None or mine[0] < first[0] else first
                newest = r.newest if newest is None else max(newest, r.newest)
                for v, c in zip(r.values, r.counts):
                    more[float(v)] = more.get(float(v), 0) + int(c)
        self.sums.update(tuple(sums))
        self.first.update(tuple(x.item() if hasattr(x, "item") else x for x in first))
        if more:
            self._add(more)
        if self.gap is not None and newest is not None and not pd.isna(newest):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(newest.timestamp() * 1000) + self.gap)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)
        for state in (self.sums, self.first, self.seen):
            state.clear()

    def _add(self, more: dict[float, int]) -> None:
        """Append a run of counted latencies; runs are merged once there are RUNS of them, so a batch does not rewrite them all."""
        runs = sum(1 for _ in self.seen.get()) if self.seen.exists() else 0
        if runs < RUNS:
            self.seen.appendValue((list(more), list(more.values())))
            return
        whole = self._merged(more)
        self.seen.put([(list(whole), list(whole.values()))])

    def _merged(self, more: dict[float, int] | None = None) -> dict[float, int]:
        out = dict(more or {})
        for values, counts in self.seen.get() if self.seen.exists() else ():
            for v, c in zip(values, counts):
                out[float(v)] = out.get(float(v), 0) + int(c)
        return out

    def _row(self, key, closed: bool) -> pd.DataFrame:
        sums, first = self.sums.get(), self.first.get()
        counted = sorted(self._merged().items())
        return pd.DataFrame([[key[0], *sums, *first, *(_at(counted, share) for share in _SHARES.values()), closed]], columns=["candidate", *_SUMS, "sample_id", *_FIRST, *_SHARES, "closed"])

    def close(self) -> None:
        pass


def _at(counted: list[tuple[float, int]], share: float) -> float:
    """The interpolated percentile of sorted counted values; 0 without any."""
    total = sum(c for _, c in counted)
    if not total:
        return 0.0
    place = (total - 1) * share
    low, found, upto = int(place), [], 0
    for v, c in counted:
        upto += c
        while len(found) < 2 and min(low + len(found), total - 1) < upto:
            found.append(v)
        if len(found) == 2:
            break
    return found[0] + (found[1] - found[0]) * (place - low)


def running(evidence: DataFrame, event_time: str | None = None, late: str = "30 minutes", gap_ms: int | None = None) -> DataFrame:
    """A stream of report.summarize rows, one for each candidate of each micro-batch, the last of which counts; closed tells the last of all.

    gap_ms needs an event_time: candidates without rows for so long are closed, and rows later than `late` behind the newest are left out.
    """
    kind = evidence.schema["sample_id"].dataType.simpleString()
    newest = F.col(event_time).cast("timestamp") if event_time else F.lit(None).cast("timestamp")
    needed = ["candidate", "sample_id", "field_accuracy", "required_field_recall", "classification_correct", "schema_followed", "portrait_expected", "portrait_extracted", "portrait_quality_score", "latency_ms", "gpu_memory_mb", "error_code", *_FIRST]
    partial = evidence.select(*needed, newest.alias("newest")).mapInPandas(_partials, _partial_schema(kind))
    if event_time:
        partial = partial.withWatermark("newest", late)
    shares = ", ".join(f"{s} double" for s in _SHARES)
    schema = f"candidate string, {', '.join(f'{s} double' for s in _SUMS)}, sample_id {kind}, cost_estimate string, license_status string, on_prem boolean, {shares}, closed boolean"
    mode = "EventTime" if gap_ms is not None else "None"
    return _finished(partial.groupBy("candidate").transformWithStateInPandas(Totals(kind, gap_ms), schema, "Update", mode))


def _finished(t: DataFrame) -> DataFrame:
    """The columns of report.summarize from totals."""
    c = F.col

    def mean(total: str, n: str) -> Column:
        return F.when(c(n) > 0, rounded(c(total) / c(n), 4))

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    out = t.select(
        "candidate", c("n").cast("long").alias("n"), zero(mean("accuracy", "n")).alias("field_accuracy"), zero(mean("recall", "n")).alias("required_recall"), mean("correct", "classified").alias("classification_accuracy"),
        zero(mean("followed", "n")).alias("schema_following_rate"), mean("found", "expected").alias("portrait_success_rate"), zero(mean("quality", "extracted")).alias("portrait_quality"), zero(mean("latency", "latencies")).alias("latency_mean_ms"),
        rounded(mean("gpu", "gpus"), 1).alias("gpu_memory_mb"), *_FIRST, zero(mean("errors", "n")).alias("error_rate"), c("sample_id").alias("first_seen"), *[rounded(c(s), 1).alias(s) for s in _SHARES], "closed",
    )
    score = report.composite(c("field_accuracy"), c("required_recall"), c("classification_accuracy"), c("schema_following_rate"), c("portrait_success_rate"), c("latency_p50_ms"), c("cost_estimate"), c("license_status"))
    return out.withColumn("composite_score", score)


def keep(summary: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each micro-batch of running() to a folder of its own, again over itself after a restart.

    The query keeps its state in RocksDB, as map state needs; the session's own state store setting is put back.
    """
    spark, provider = summary.sparkSession, "spark.sql.streaming.stateStore.providerClass"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        w = summary.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()
    finally:
        spark.conf.set(provider, before)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each candidate among the batches of keep()."""
    rows = spark.read.parquet(path)
    return rows.groupBy("candidate").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("candidate", "batch")]), "batch").alias("r")).select("candidate", "r.*")
