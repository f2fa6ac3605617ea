"""Memory readings of a run."""

from __future__ import annotations

import os
import resource
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.functions.numbers import rounded


def larger_reading(before: Column, after: Column) -> Column:
    """Larger of two readings; nulls and zeros are no readings."""
    return F.greatest(F.nullif(before, F.lit(0.0)), F.nullif(after, F.lit(0.0)))


def listing_total(listing: Column) -> Column:
    """Sum over the numeric tokens of a device listing, to one place; null if there are none."""
    numbers = F.filter(F.transform(F.split(listing, r"[ \n,]+"), lambda t: t.try_cast("double")), lambda t: t.isNotNull())
    return F.when(F.size(numbers) > 0, rounded(F.aggregate(numbers, F.lit(0.0), lambda a, t: a + t), 1))


@contextmanager
def peak_memory() -> Iterator[Callable[[], float]]:
    """Growth of this process's peak resident memory in MB inside the block, to two places and never below 0."""
    start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    yield lambda: round(max(0, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) / 1024, 2)


def _status(pid: int) -> dict[str, str]:
    return dict(line.split(":", 1) for line in Path(f"/proc/{pid}/status").read_text().splitlines() if ":" in line)


def executor_peak_mb() -> float:
    """Peak resident memory in MB, to two places, of the Python worker that calls this and of the executor's JVM above it.

    Where the system does not tell of other processes, that of the worker alone.
    """
    own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    try:
        pid = os.getppid()
        while pid > 1:
            s = _status(pid)
            if s["Name"].strip() == "java":
                return round((own + int(s["VmHWM"].split()[0])) / 1024, 2)
            pid = int(s["PPid"])
    except (OSError, KeyError, ValueError):
        pass
    return round(own / 1024, 2)


def with_peak_memory(rows: DataFrame, name: str = "peak_memory_mb") -> DataFrame:
    """rows with the peak memory of the executor that made each of them, as it was read after its batch; a column of that name is replaced."""
    rows = rows.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([executor_peak_mb()] * batch.num_rows, pa.float64())], [*batch.schema.names, name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}`{name}` double")
