"""A whole evaluation run: providers on samples, scored against ground truth."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyform.operators import resources, score
from tallyform.plans import catalog
from tallyform.sources.providers import Provider

OUT = ("candidate", "sample_id", "document_type", "capture_condition", "image_ok", "classification", "text", "fields", "schema_followed", "portrait", "skipped", "latency_ms", "error", "error_code")

#: What an operation leaves behind where it was not run.
BLANK = {
    "classify": {"classification": "cast(null as struct<document_type:string,confidence:double>)"},
    "extract_text": {"text": "''"},
    "extract_fields": {"fields": "cast(map() as map<string,string>)", "schema_followed": "false"},
    "extract_portrait": {"portrait": "cast(null as struct<available:boolean,quality_score:double>)"},
}


def run(
    samples: DataFrame,
    expected: DataFrame,
    providers: dict[str, Provider],
    ops: tuple[str, ...] = tuple(catalog.CAPABILITIES),
    images: DataFrame | None = None,
    capabilities: dict[str, Iterable[str]] | None = None,
    created_at: str | None = None,
    memory: bool = False,
) -> DataFrame:
    """Evidence rows of every provider on every sample, one for each row of samples, ids repeated or not.

    providers maps candidate names to functions, in the order that breaks ties; names outside the
    catalog get its defaults. An operation that is not asked for leaves no trace: no class, no text, no
    fields, no portrait. capabilities names what a provider can do, if not everything; the rest of what
    is asked for is listed as skipped. With `images` (image_path), a sample whose image is not among
    them is reported as INVALID_IMAGE. Ground truth columns that the samples happen to carry are kept
    from the providers; of several ground truths with one id the least counts, by its fields' names and values. An
    `image_error` beside images' path names what kept an image from being decoded; its samples are INVALID_IMAGE too.
    created_at is the current time by default. memory fills peak_memory_mb from the executors.
    """
    samples = samples.drop("fields", "required_fields", "portrait_present", "portrait_bbox")
    if images is not None:
        fault = F.col("image_error") if "image_error" in images.columns else F.lit(None).cast("string")
        here = images.select("image_path", fault.alias("image_error")).groupBy("image_path").agg(F.max("image_error").alias("image_error"), F.lit(True).alias("_here"))
        samples = samples.drop("image_ok", "image_error").join(here, "image_path", "left")
        missing = F.when(F.col("_here").isNull(), "FileNotFoundError")
        samples = samples.withColumn("image_error", F.coalesce("image_error", missing)).withColumn("image_ok", F.col("image_error").isNull()).drop("_here")
    truth = expected.select("sample_id", F.struct("fields", "required_fields", "portrait_present").alias("expected"))
    by = F.struct(F.array_sort(F.map_entries("expected.fields")), "expected.required_fields", "expected.portrait_present")
    truth = truth.groupBy("sample_id").agg(F.min_by("expected", by).alias("expected"))
    parts = []
    for i, (name, f) in enumerate(providers.items()):
        got = f(samples)
        got = (resources.with_peak_memory(got) if memory else got).withColumns({"candidate": F.lit(name), "ordinal": F.lit(i)})
        can = catalog.CAPABILITIES if capabilities is None else list(capabilities.get(name, catalog.CAPABILITIES))
        for op, blank in BLANK.items():
            if op not in ops or op not in can:
                got = got.withColumns({c: F.expr(x) for c, x in blank.items()})
        asked = F.array(*map(F.lit, [op for op in catalog.CAPABILITIES if op in ops])).cast("array<string>")
        lacks = score.skipped_capabilities(asked, F.array(*map(F.lit, can)).cast("array<string>"))
        got = got.withColumn("skipped", F.array_distinct(F.concat(F.coalesce("skipped", F.array().cast("array<string>")), lacks)))
        for c, kind in score.OPTIONAL.items():
            if c not in got.columns:
                got = got.withColumn(c, F.lit(None).cast(kind))
        parts.append(got.select(*OUT, *score.OPTIONAL))
    runs = reduce(DataFrame.unionByName, parts).join(truth, "sample_id", "left")
    now = created_at or datetime.now(timezone.utc).isoformat()
    return score.score_runs(runs, catalog.provider_catalog(samples.sparkSession), now).fillna({"cost_estimate": "medium", "license_status": "needs_review", "on_prem": True})
