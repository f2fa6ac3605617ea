"""Evidence as a stream: rows appended as JSON lines, and rolling summaries by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyform.sources import io


def read(spark: SparkSession, folder: str, schema: str = io.EVIDENCE, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines of a folder as they arrive."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(folder)


def append(evidence: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append each row as a JSON line, exactly once across restarts from the same checkpoint folder."""
    w = io.camel_case(evidence).writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false")
    return (w.trigger(availableNow=True) if once else w).start()


def rolling(evidence: DataFrame, event_time: str = "ts", width: str = "10 minutes", slide: str | None = None, late: str | None = "30 minutes") -> DataFrame:
    """Per candidate and window: rows, mean accuracy and errors. Rows later than `late` are left out and state is dropped.

    late=None keeps the watermark that the rows already have; it can be set once in a stream.
    """
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    err = F.coalesce("error_code", F.lit("")) != ""
    return (
        (evidence.withWatermark(event_time, late) if late else evidence)
        .groupBy(w, "candidate")
        .agg(F.count("*").alias("n"), F.avg("field_accuracy").alias("field_accuracy"), F.count_if(err).alias("errors"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "candidate", "n", "field_accuracy", "errors")
    )


def first_seen(evidence: DataFrame, event_time: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Each (candidate, sample_id) once, with state kept for `late` only."""
    return evidence.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["candidate", "sample_id"])
