"""Scores of predicted against expected fields, and the evidence row of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.functions.numbers import rounded
from tallyform.functions import normalize as N
from tallyform.functions import similarity as S
from tallyform.plans import catalog

RECALL_THRESHOLD = 0.85


def _settled(field: Column, e: Column, p: Column, predicted: Column) -> tuple[Column, Column]:
    """Score of a pair (e, p: normalized) without similarity, and whether similarity decides instead."""
    missing = predicted.isNull() | (predicted == "")
    open_ = ~missing & (e != "") & (e != p) & ~N.field_kind(field).isin("number", "date")
    return F.when(missing, 0.0).when(e == "", F.when(p == "", 1.0).otherwise(0.0)).when(e == p, 1.0).otherwise(0.0), open_


def pair_scores(pairs: DataFrame, field: str = "field", expected: str = "expected", predicted: str = "predicted", fuzzy: bool = True) -> DataFrame:
    """pairs with `score`: the match of each (field, expected, predicted) in 0..1.

    In this order: no or empty prediction 0; expected normalizes to empty: 1 if the prediction does,
    else 0; equal 1; numbers and dates 0; else token-sort similarity to three places. Only pairs that
    come to the last case reach the UDF (the others hand it nulls); fuzzy=False leaves it out of the
    plan and gives such pairs 0.
    """
    e, p = F.col("_e"), F.col("_p")
    base = pairs.withColumn("_e", N.field_value(field, expected)).withColumn("_p", N.field_value(field, predicted))
    close, open_ = _settled(F.col(field), e, p, F.col(predicted))
    if not fuzzy:
        return base.withColumn("score", close).drop("_e", "_p")
    near = S.indel_ratio(F.when(open_, S.token_sort(e)), F.when(open_, S.token_sort(p)))
    return base.withColumn("score", F.coalesce(rounded(near, 3), close)).drop("_e", "_p")


def row_scores(rows: DataFrame, expected: Column, predicted: Column, scores: str = "_scores") -> DataFrame:
    """rows with a map of each expected field's score, by the rules of pair_scores.

    All pairs of a row are scored inside it: nothing is exploded or shuffled, and rows that repeat stay apart.
    """
    none = F.create_map().cast("map<string,string>")
    pairs = F.transform(F.map_entries(F.coalesce(expected, none)), lambda x: F.struct(x["key"].alias("field"), x["value"].alias("e"), F.try_element_at(F.coalesce(predicted, none), x["key"]).alias("said")))
    forms = F.transform("_pairs", lambda x: F.struct(x["field"], N.field_value(x["field"], x["e"]).alias("e"), N.field_value(x["field"], x["said"]).alias("p"), x["said"]))

    def judged(x: Column) -> Column:
        close, open_ = _settled(x["field"], x["e"], x["p"], x["said"])
        return F.struct(x["field"], close.alias("close"), F.when(open_, S.token_sort(x["e"])).alias("a"), F.when(open_, S.token_sort(x["p"])).alias("b"))

    out = rows.withColumn("_pairs", pairs).withColumn("_pairs", forms).withColumn("_pairs", F.transform("_pairs", judged))
    out = out.withColumn("_near", S.indel_ratios(F.col("_pairs.a"), F.col("_pairs.b")))
    got = F.zip_with("_pairs", "_near", lambda x, near: F.struct(x["field"], F.coalesce(rounded(near, 3), x["close"]).alias("score")))
    return out.withColumn(scores, F.map_from_entries(F.array_sort(got))).drop("_pairs", "_near")


def required_fields(expected_required: Column, document_type: Column) -> Column:
    """The sample's own list if it has one, else the schema's; empty for types without a schema."""
    own = F.coalesce(expected_required, F.array().cast("array<string>"))
    schema = F.array().cast("array<string>")
    for t, names in catalog.REQUIRED.items():
        schema = F.when(document_type == t, F.array(*map(F.lit, names))).otherwise(schema)
    return F.when(F.size(own) > 0, own).otherwise(schema)


def required_recall(scores: Column, required: Column) -> Column:
    """Share of required fields whose score reaches the threshold; a missing score counts as 0; none required: 0."""
    hit = F.size(F.filter(required, lambda f: F.coalesce(F.try_element_at(scores, f), F.lit(0.0)) >= RECALL_THRESHOLD))
    return F.when(F.size(required) > 0, rounded(hit / F.size(required), 4)).otherwise(0.0)


def field_accuracy(scores: Column) -> Column:
    """Mean of the per-field scores to four places; 0 without fields."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(scores) > 0, rounded(total / F.size(scores), 4)).otherwise(0.0)


def notes(skipped: Column, portrait_expected: Column, portrait_extracted: Column) -> Column:
    some = F.size(F.coalesce(skipped, F.array().cast("array<string>"))) > 0
    return F.array_compact(F.array(F.when(some, F.concat(F.lit("skipped: "), F.array_join(skipped, ", "))), F.when(portrait_expected & ~portrait_extracted, "expected portrait not extracted")))


def skipped_capabilities(requested: Column, supported: Column) -> Column:
    """Requested operations that a provider lacks, in request order."""
    return F.array_except(requested, supported)


#: Columns of runs that may be missing, and their type.
OPTIONAL = {"provider_version": "string", "model_version": "string", "ordinal": "int", "peak_memory_mb": "double", "gpu_memory_mb": "double", "image_error": "string"}


def score_runs(runs: DataFrame, providers: DataFrame, created_at: str | None = None) -> DataFrame:
    """Evidence rows of runs that were joined with their samples and ground truth, and `ordinal` beside them.

    runs: candidate, sample_id, document_type, capture_condition, expected (struct of fields map,
    required_fields, portrait_present; null if there is no ground truth), image_ok, classification
    (struct of document_type, confidence), text, fields (map of name to value), schema_followed,
    portrait (struct of available, quality_score), skipped, latency_ms (map), error, error_code, and the
    OPTIONAL ones. ordinal is the candidate's place in the run, by which ties are ranked (by default that
    in `providers`). Each row is scored by itself, so repeated sample ids give a row each. Rows without
    ground truth or image keep zeros and their error code; the former are reported under condition
    `clean`, as the evaluated format has it.
    """
    for name, kind in OPTIONAL.items():
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kind))
    keyed = runs.withColumn("_missing", F.col("expected").isNull()).withColumn("_bad", ~F.col("_missing") & ~F.coalesce("image_ok", F.lit(True)))
    ok = ~F.col("_missing") & ~F.col("_bad")
    keyed = row_scores(keyed, F.when(ok, F.col("expected.fields")), F.col("fields"))
    posture = providers.select("candidate", "cost_estimate", "license_status", "on_prem", F.col("ordinal").alias("_place"))
    out = keyed.join(F.broadcast(posture), "candidate", "left")
    scores = F.col("_scores")
    need = required_fields(F.col("expected.required_fields"), F.col("document_type"))
    portrait = ok & F.coalesce(F.col("portrait.available"), F.lit(False))
    wanted = ok & F.coalesce(F.col("expected.portrait_present"), F.lit(False))
    code = F.when(F.col("_missing"), "MISSING_EXPECTED").when(F.col("_bad"), "INVALID_IMAGE").otherwise(F.col("error_code"))
    text = F.when(F.col("_missing"), "missing expected ground truth").when(F.col("_bad"), F.concat_ws(": ", F.lit("image load failed"), "image_error")).otherwise(F.col("error"))
    return out.select(
        "candidate",
        "document_type",
        "sample_id",
        F.when(F.col("_missing"), "clean").otherwise(F.col("capture_condition")).alias("capture_condition"),
        F.when(ok, F.col("classification.document_type") == F.col("document_type")).alias("classification_correct"),
        F.when(ok, F.coalesce(F.col("classification.confidence"), F.lit(0.0))).otherwise(0.0).alias("classification_confidence"),
        F.when(ok, field_accuracy(scores)).otherwise(0.0).alias("field_accuracy"),
        F.when(ok, required_recall(scores, need)).otherwise(0.0).alias("required_field_recall"),
        scores.alias("per_field_scores"),
        (ok & F.coalesce("schema_followed", F.lit(False))).alias("schema_followed"),
        wanted.alias("portrait_expected"),
        portrait.alias("portrait_extracted"),
        F.when(ok, F.coalesce(F.col("portrait.quality_score"), F.lit(0.0))).otherwise(0.0).alias("portrait_quality_score"),
        F.when(ok, F.coalesce(F.length("text"), F.lit(0))).otherwise(0).alias("text_char_count"),
        F.when(ok, F.coalesce(F.try_element_at("latency_ms", F.lit("total")), F.lit(0.0))).otherwise(0.0).alias("latency_ms"),
        F.when(ok, F.col("latency_ms")).otherwise(F.create_map().cast("map<string,double>")).alias("latency_breakdown"),
        F.when(ok, F.col("peak_memory_mb")).alias("peak_memory_mb"),
        F.when(ok, F.col("gpu_memory_mb")).alias("gpu_memory_mb"),
        "cost_estimate",
        "license_status",
        "on_prem",
        text.alias("error"),
        code.alias("error_code"),
        F.when(ok, F.col("provider_version")).alias("provider_version"),
        F.when(ok, F.col("model_version")).alias("model_version"),
        F.when(ok, notes(F.col("skipped"), wanted, portrait)).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.lit(created_at).cast("string").alias("created_at"),
        F.coalesce("ordinal", "_place").alias("ordinal"),
    )
