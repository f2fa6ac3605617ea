"""Dataset checks, provider selection, and cross products of providers and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyform.plans import catalog


def duplicates(samples: DataFrame, key: str = "sample_id", order: str | None = None) -> DataFrame:
    """Rows after the first of each key, in `order`."""
    w = Window.partitionBy(key).orderBy(order or key)
    return samples.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def dataset_problems(samples: DataFrame, images: DataFrame, expected: DataFrame, order: str = "pos") -> DataFrame:
    """(pos, sample_id, problem): duplicate ids, missing images, missing ground truth; one row may raise several.

    samples has pos, sample_id and image_path, images has image_path, expected has sample_id.
    """
    base = samples.select(F.col(order).alias("pos"), "sample_id", "image_path")
    first = base.groupBy("sample_id").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    dup = base.join(first, "sample_id").where("pos > first").select("pos", "sample_id", F.lit(0).alias("k"), F.concat(F.lit("duplicate sample_id: "), "sample_id").alias("problem"))
    img = base.join(images.select("image_path").distinct(), "image_path", "left_anti").select("pos", "sample_id", F.lit(1).alias("k"), F.concat(F.lit("missing image for "), "sample_id", F.lit(": "), "image_path").alias("problem"))
    exp = base.join(expected.select("sample_id").distinct(), "sample_id", "left_anti").select("pos", "sample_id", F.lit(2).alias("k"), F.concat(F.lit("missing expected for "), "sample_id").alias("problem"))
    return dup.unionByName(img).unionByName(exp).orderBy("pos", "k").select("pos", "sample_id", "problem")


def schema_drift(expected: DataFrame) -> DataFrame:
    """(document_type, field, drift): keys of ground truth outside the catalog, and catalog fields it never has."""
    seen = expected.select("document_type", F.explode(F.map_keys("fields")).alias("field")).distinct()
    known = catalog.field_catalog(expected.sparkSession).select("document_type", "field")
    known = known.join(F.broadcast(expected.select("document_type").distinct()), "document_type", "left_semi")
    extra = seen.join(F.broadcast(known), ["document_type", "field"], "left_anti").withColumn("drift", F.lit("not in schema"))
    return extra.unionByName(known.join(seen, ["document_type", "field"], "left_anti").withColumn("drift", F.lit("never expected")))


def samples_of_type(samples: DataFrame, document_type: str) -> DataFrame:
    """Samples whose id starts with the type's name; an unknown type is an error."""
    if document_type not in catalog.DOCUMENT_TYPES:
        raise ValueError(f"unknown document type {document_type!r}")
    return samples.where(F.col("sample_id").startswith(document_type))


def select_providers(requested: str | None, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected with reason) of a comma list, or of the default list; the order of the request is kept."""
    names = [p.strip() for p in (requested or "").split(",") if p.strip()] or list(catalog.DEFAULT_PROVIDERS)
    asked = providers.sparkSession.createDataFrame(list(enumerate(names)), "asked int, candidate string")
    chosen = F.broadcast(asked).join(providers, "candidate")
    rejected = asked.join(F.broadcast(providers), "candidate", "left_anti").withColumn("reason", F.concat(F.lit("unknown provider "), "candidate"))
    return chosen, rejected


def runs_of(providers: DataFrame, samples: DataFrame) -> DataFrame:
    """Every provider with every sample; the few providers are the broadcast side."""
    return samples.crossJoin(F.broadcast(providers))


def capability_report(providers: DataFrame) -> DataFrame:
    """One row a provider with its sorted capabilities and license."""
    return providers.select("candidate", F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"), "license_name", "license_status", "cost_estimate", "on_prem")
