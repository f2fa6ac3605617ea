"""Command line: python -m tallyform {gen-samples,providers,validate,run,report} ...

A dataset folder has manifests/*.json, expected/<id>.json and samples/<id>.txt (transcribed text; this
library decodes no images) or samples/<id>.json (a model's answer) for providers that read JSON.
"""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyform.operators import benchmark, report, validate
from tallyform.plans import catalog
from tallyform.sources import config, generate, io, providers


def _spark() -> SparkSession:
    s = SparkSession.builder.appName("tallyform").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _names(text: str) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] or None


def _manifest(a: argparse.Namespace) -> str:
    path = a.manifest or io.find_manifest(a.dataset)
    if path is None:
        sys.exit(f"No manifest found under {a.dataset}/manifests")
    return path


def gen_samples(a: argparse.Namespace) -> None:
    out = Path(a.out)
    for d in ("samples", "expected", "manifests"):
        (out / d).mkdir(parents=True, exist_ok=True)
    samples = []
    for r in generate.dataset(_spark(), _names(a.doc_types), _names(a.conditions), a.per_type, a.seed, date.fromisoformat(a.today)).toLocalIterator():
        d = r.asDict()
        (out / f"samples/{r.sample_id}.txt").write_text(r.text, encoding="utf-8")
        truth = {k: d[k] for k in ("sample_id", "document_type", "fields", "required_fields", "portrait_present", "portrait_bbox")}
        (out / f"expected/{r.sample_id}.json").write_text(json.dumps(truth, indent=2), encoding="utf-8")
        samples.append({k: d[k] for k in ("sample_id", "document_type", "capture_condition", "source", "tags")} | {"image_path": f"samples/{r.sample_id}.txt"})
    (out / "manifests/synthetic_v1.json").write_text(json.dumps({"name": "synthetic_v1", "version": "1", "samples": samples}, indent=2), encoding="utf-8")
    print(f"{len(samples)} samples under {out}")


def list_providers(a: argparse.Namespace) -> None:
    rows = [r.asDict() for r in validate.capability_report(catalog.provider_catalog(_spark())).collect()]
    print(json.dumps(rows, indent=2) if a.json else report.table(list(rows[0]), [[str(v) for v in r.values()] for r in rows]))


def _images(spark: SparkSession, dataset: str) -> DataFrame:
    return io.read_images(spark, f"{dataset}/samples", str(Path(dataset).resolve()))


def check(a: argparse.Namespace) -> None:
    spark, path = _spark(), _manifest(a)
    problems = validate.dataset_problems(io.read_manifest(spark, path), _images(spark, a.dataset), io.read_expected(spark, f"{a.dataset}/expected")).collect()
    for p in problems:
        print(p.problem)
    if problems:
        sys.exit(1)
    print(f"OK: {path}")


def run(a: argparse.Namespace) -> None:
    spark, path = _spark(), _manifest(a)
    names = _names(a.providers) or list(config.Settings.load(os.environ).allowed_providers)
    samples = io.read_manifest(spark, path)
    if a.doc_type:
        samples = validate.samples_of_type(samples, a.doc_type)
    read = _images(spark, a.dataset)
    texts = samples.join(read.select("image_path", F.decode("content", "utf-8").alias("text")), "image_path", "left")
    stem = F.regexp_replace("image_path", r"\.[^.]*$", "")
    answers = read.where(F.col("image_path").endswith(".json")).select(stem.alias("_stem"), F.decode("content", "utf-8").alias("answer"))
    texts = texts.withColumn("_stem", stem).join(answers, "_stem", "left").drop("_stem")
    chosen, left_out = {}, {}
    for n in names:
        try:
            chosen[n] = providers.build(n)
        except KeyError as e:
            left_out[n] = str(e.args[0])
    if not chosen:
        sys.exit(f"No provider is available: {left_out}")
    off = {"classify": a.no_classify, "extract_text": a.no_text, "extract_portrait": a.no_portrait}
    ops = tuple(c for c in catalog.CAPABILITIES if not off.get(c))
    evidence = benchmark.run(texts, io.read_expected(spark, f"{a.dataset}/expected"), chosen, ops, images=read, memory=True)
    watch = report.HealthWatch(evidence.orderBy("ordinal", "sample_id"), list(chosen))
    run_id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    out = Path(a.results, run_id)
    out.mkdir(parents=True, exist_ok=True)
    n = io.write_array(watch.rows, str(out / "results.json"), in_order=True)
    meta = {"run_id": run_id, "manifest": path, "manifest_name": Path(path).stem, "platform": platform.platform(), "python": platform.python_version(), "sample_count": samples.count(), "providers_requested": names, "unavailable": left_out, "ops": list(ops)}
    (out / "run_meta.json").write_text(json.dumps(meta, indent=2), encoding="utf-8")
    for h in watch.health().collect():
        print(f"{h.candidate}: {h.status}, {h.errored} of {h.n} samples had errors, e.g. {h.example}")
    print(f"{n} rows in {out}")
    if not a.no_report:
        print(report.quick_ranking(io.report_folder(spark, str(out))))


def rebuild(a: argparse.Namespace) -> None:
    if not Path(a.folder, "results.json").exists():
        sys.exit(f"No results.json in {a.folder}")
    print(report.quick_ranking(io.report_folder(_spark(), a.folder)))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallyform")
    sub = p.add_subparsers(required=True)
    g = sub.add_parser("gen-samples")
    g.add_argument("--out", default="dataset")
    g.add_argument("--doc-types", default="")
    g.add_argument("--conditions", default="")
    g.add_argument("--per-type", type=int, default=1)
    g.add_argument("--seed", type=int, default=1000)
    g.add_argument("--today", default=date.today().isoformat())
    g.set_defaults(f=gen_samples)
    g = sub.add_parser("providers")
    g.add_argument("--json", action="store_true")
    g.set_defaults(f=list_providers)
    for name, f in (("validate", check), ("run", run)):
        g = sub.add_parser(name)
        g.add_argument("--dataset", default="dataset")
        g.add_argument("--manifest", default="")
        g.set_defaults(f=f)
    g.add_argument("--providers", default="")
    g.add_argument("--results", default="results")
    g.add_argument("--doc-type", default="")
    for flag in ("no-text", "no-portrait", "no-classify", "no-report"):
        g.add_argument(f"--{flag}", action="store_true")
    g = sub.add_parser("report")
    g.add_argument("folder")
    g.set_defaults(f=rebuild)
    a = p.parse_args(args)
    a.f(a)


if __name__ == "__main__":
    main()
