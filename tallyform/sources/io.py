"""Readers and writers of manifests, ground truth, images, evidence and reports."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "sample_id string, document_type string, image_path string, side string, capture_condition string, source string, notes string, tags array<string>"
MANIFEST = f"name string, version string, created_at string, description string, samples array<struct<{SAMPLE.replace(' string', ':string').replace(' array', ':array')}>>"
EXPECTED = "sample_id string, document_type string, fields map<string,string>, required_fields array<string>, portrait_present boolean, portrait_bbox array<int>"
EVIDENCE = """candidate string, document_type string, sample_id string, capture_condition string, classification_correct boolean, classification_confidence double,
field_accuracy double, required_field_recall double, per_field_scores map<string,double>, schema_followed boolean, portrait_expected boolean, portrait_extracted boolean,
portrait_quality_score double, text_char_count int, latency_ms double, latency_breakdown map<string,double>, peak_memory_mb double, gpu_memory_mb double, cost_estimate string,
license_status string, on_prem boolean, error string, error_code string, provider_version string, model_version string, notes array<string>, created_at string"""
#: What a missing key of an evidence record means.
DEFAULTS = {
    "capture_condition": "clean", "classification_confidence": 0.0, "field_accuracy": 0.0, "required_field_recall": 0.0, "schema_followed": False, "portrait_expected": False, "portrait_extracted": False,
    "portrait_quality_score": 0.0, "text_char_count": 0, "latency_ms": 0.0, "cost_estimate": "medium", "license_status": "needs_review", "on_prem": True,
}
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}


_own: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, removed when the driver's Python ends.

    Where that is unset, a folder of the machine is taken, which only a local master can share with itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyform-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tallyform/{name}-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


@atexit.register
def _drop_own() -> None:
    for spark, path in _own:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
            pass


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def evidence_schema(spelling: str = "snake") -> T.StructType:
    s = T.StructType.fromDDL(EVIDENCE)
    return s if spelling == "snake" else T.StructType([T.StructField(camel(f.name), f.dataType) for f in s])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample, with its position in the manifest and the manifest's name."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    s = m.select("name", F.posexplode("samples").alias("pos", "s")).select("pos", F.col("name").alias("manifest_name"), "s.*")
    return s.fillna({"capture_condition": "clean"})


def find_manifest(dataset: str) -> str | None:
    """First manifest of a local dataset folder by name; None if there is none."""
    found = sorted(Path(dataset, "manifests").glob("*.json"))
    return str(found[0]) if found else None


def read_expected(spark: SparkSession, folder: str) -> DataFrame:
    """All ground truth files of a folder; a sample without one simply has no row."""
    return spark.read.schema(EXPECTED).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def read_images(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """(image_path relative to root, content, mime type by extension, image/jpeg if unknown)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), F.lit("image/jpeg"))
    return raw.select(rel.alias("image_path"), "content", mime.alias("mime"), F.col("length").alias("bytes"))


def data_url(content: str = "content", mime: str = "mime"):
    """data: URL of binary content; base64() breaks lines, which a URL may not have."""
    return F.concat(F.lit("data:"), F.col(mime) if isinstance(mime, str) else mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def image_path(root: str, path: str = "image_path"):
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.col(path))


def _array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of JSON arrays; one file whose lines hold whole objects, as write_array leaves it, is read by many tasks.

    A line break never stands inside a string of JSON. Other layouts, and each of several files, are read whole by
    one task. That all lines are whole is found by a pass of its own.
    """
    lines = spark.read.text(path)
    body = F.btrim("value", F.lit(" \t[],"))
    listed = F.concat(F.lit("["), body, F.lit("]"))
    if len(lines.inputFiles()) == 1:
        whole = (body == "") | (body.startswith("{") & body.endswith("}") & F.try_parse_json(listed).isNotNull())
        if lines.agg(F.coalesce(F.bool_and(whole), F.lit(True)).alias("whole")).first().whole:
            return lines.where(body != "").select(F.inline_outer(F.from_json(listed, T.ArrayType(schema))))
    return spark.read.schema(schema).option("multiLine", True).option("caseSensitive", "true").json(path)


def read_evidence(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Evidence from a JSON array or JSON lines, in either spelling of its keys, with defaults filled in."""
    snake, both = evidence_schema(), evidence_schema().fields + [f for f in evidence_schema("camel").fields if "_" not in f.name and f.name != f.name.lower()]
    schema = T.StructType(both)
    raw = _array(spark, path, schema) if multi_line else spark.read.schema(schema).option("caseSensitive", "true").json(path)
    cols = []
    for f in snake:
        alt = camel(f.name)
        got = F.col(f.name) if alt == f.name else F.coalesce(F.col(alt), F.col(f.name))
        if f.name in DEFAULTS:
            got = F.coalesce(got, F.lit(DEFAULTS[f.name]))
        elif isinstance(f.dataType, T.MapType):
            got = F.coalesce(got, F.create_map().cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType):
            got = F.coalesce(got, F.array().cast(f.dataType))
        cols.append(got.alias(f.name))
    return raw.select(*cols)


def camel_case(evidence: DataFrame) -> DataFrame:
    """Evidence with camelCase columns, without the ordinal of a run; keys inside maps stay as they are."""
    return evidence.select(*[F.col(c).alias(camel(c)) for c in evidence.columns if c != "ordinal"])


def write_jsonl(evidence: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, in as many files as there are partitions."""
    camel_case(evidence).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_array(evidence: DataFrame, path: str, in_order: bool = False) -> int:
    """One JSON array in one file, by the candidates' order in the run unless the rows are in_order; tasks write it. The number of rows."""
    from tallyform.sources.formats import write_array as write

    if "ordinal" in evidence.columns and not in_order:
        evidence = evidence.orderBy("ordinal", "sample_id")
    seen = Observation()
    write(camel_case(evidence).observe(seen, F.count("*").alias("n")), path)
    return seen.get["n"]


def write_report(summary: dict, folder: str, meta: dict | None = None) -> tuple[str, str]:
    """summary.json and report.md in a local folder."""
    from tallyform.operators.report import markdown

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "summary.json").write_text(json.dumps(summary, indent=2), encoding="utf-8")
    (out / "report.md").write_text(markdown(summary, meta), encoding="utf-8")
    return str(out / "summary.json"), str(out / "report.md")


def report_folder(spark: SparkSession, folder: str) -> dict:
    """Build the report again from results.json (and run_meta.json, if any) of a results folder."""
    from tallyform.operators.report import build_summary

    evidence = read_evidence(spark, str(Path(folder, "results.json"))).withColumn("_order", F.monotonically_increasing_id())
    meta = Path(folder, "run_meta.json")
    summary = build_summary(evidence, "_order")
    write_report(summary, folder, json.loads(meta.read_text()) if meta.exists() else None)
    return summary
