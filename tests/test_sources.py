import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyform.operators import benchmark, image, report, validate
from tallyform.plans import catalog
from tallyform.sources import generate, io, providers
from tallyform.streaming import evidence as stream


def test_catalog_sizes():
    assert len(catalog.FIELD_ROWS) == 76 and len(catalog.SCHEMAS) == 9 and len(catalog.KEY_ALIASES) >= 80
    assert catalog.provider(" Tesseract ")[1] == "low" and catalog.schema_for("other") is None
    with pytest.raises(KeyError):
        catalog.provider("none")


def test_dataset_is_repeatable_and_complete(spark):
    a = generate.dataset(spark, ["passport", "voter_id"], ["clean", "glare"], per_type=2)
    rows = {r.sample_id: r for r in a.collect()}
    assert len(rows) == 8 and rows["passport-00-clean"].fields == rows["passport-00-glare"].fields
    assert {r.sample_id: r.text for r in a.repartition(5).collect()} == {k: v.text for k, v in rows.items()}
    assert rows["passport-00-clean"].portrait_bbox == [790, 120, 950, 320]
    assert sorted(rows["voter_id-01-clean"].fields) == sorted(catalog.SCHEMAS["voter_id"])
    assert generate.dataset(spark, ["passport"], ["clean"], today=date(2030, 1, 1)).first().fields != rows["passport-00-clean"].fields


def test_labelled_provider_reads_what_was_printed(spark):
    s = generate.dataset(spark, conditions=["clean"], per_type=2)
    e = benchmark.run(s, s, {"paddleocr-vl": providers.labelled, "mock": providers.mock})
    by = {(r.candidate, r.document_type): r.field_accuracy for r in e.collect()}
    assert all(by["paddleocr-vl", t] > 0.85 for t in catalog.SCHEMAS), by
    summary = report.build_summary(e)
    assert summary["recommendation"]["default_provider"] == "paddleocr-vl" and "Recommendation" in report.markdown(summary)
    assert e.where("cost_estimate is null").count() == 0


def test_operations_can_be_left_out(spark):
    s = generate.dataset(spark, ["passport"], ["clean"])
    r = benchmark.run(s, s, {"mock": providers.mock}, ("extract_fields",)).first()
    assert r.classification_correct is None and r.text_char_count == 0


def test_endpoint_failures_cost_one_row(spark):
    s = generate.dataset(spark, ["nin_slip"], ["clean", "glare"]).withColumn("content", F.encode("capture_condition", "utf-8"))

    def chat(system, user, raw):
        if raw == b"glare":
            raise TimeoutError
        return '{"Surname": "Obi"}'

    got = {r.capture_condition: r for r in providers.json_answers(providers.ask(s.drop("fields"), chat)).collect()}
    assert got["clean"].fields == {"surname": "Obi"} and got["clean"].error_code is None
    assert got["glare"].error_code == "PROVIDER_PARTIAL_FAILURE" and got["glare"].error == "extract_fields: TimeoutError" and got["glare"].fields == {}


def test_manifest_and_validation(spark, tmp_path):
    for d in ("manifests", "expected", "samples"):
        (tmp_path / d).mkdir()
    ids = ["passport-00-clean", "passport-00-clean", "voter_id-00-clean"]
    (tmp_path / "manifests/b.json").write_text("{}")
    m = {"name": "m", "version": "1", "samples": [{"sample_id": i, "document_type": i.split("-")[0], "image_path": f"samples/{i}.jpg"} for i in ids]}
    (tmp_path / "manifests/a.json").write_text(json.dumps(m, indent=1))
    (tmp_path / f"expected/{ids[0]}.json").write_text(json.dumps({"sample_id": ids[0], "document_type": "passport", "fields": {"full_name": "x"}, "required_fields": [], "portrait_present": True}, indent=1))
    (tmp_path / f"samples/{ids[0]}.jpg").write_bytes(b"jpg")
    path = io.find_manifest(str(tmp_path))
    assert path.endswith("a.json") and io.find_manifest(str(tmp_path / "none")) is None
    samples, expected = io.read_manifest(spark, path), io.read_expected(spark, str(tmp_path / "expected"))
    assert samples.count() == 3 and samples.first().capture_condition == "clean"
    images = io.read_images(spark, str(tmp_path / "samples"), str(tmp_path))
    assert images.select("image_path", "mime", io.data_url().alias("u")).first() == (f"samples/{ids[0]}.jpg", "image/jpeg", "data:image/jpeg;base64,anBn")
    got = [(r.pos, r.problem.split()[0] + " " + r.problem.split()[1]) for r in validate.dataset_problems(samples, images, expected).collect()]
    assert got == [(1, "duplicate sample_id:"), (2, "missing image"), (2, "missing expected")]
    drift = {(r.field, r.drift) for r in validate.schema_drift(expected).collect()}
    assert ("full_name", "not in schema") in drift and ("surname", "never expected") in drift
    assert validate.samples_of_type(samples, "voter_id").count() == 1
    with pytest.raises(ValueError):
        validate.samples_of_type(samples, "ticket")


def test_stream_appends_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"candidate": "a", "sample_id": str(i), "field_accuracy": i * 1.0}) + "\n")
        stream.append(stream.read(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted(r.sampleId for r in rows) == ["0", "1"]


def test_stream_rolling_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", f"s{i}", 0.5, "x" if i == 0 else None, f"2026-01-01T00:{m:02d}:00Z") for i, m in enumerate((1, 2, 15))]
    rows += [("a", "s9", 0.5, None, "2026-01-02T00:00:00Z")]
    (src / "0.json").write_text("".join(json.dumps(dict(zip(("candidate", "sample_id", "field_accuracy", "error_code", "ts"), r))) + "\n" for r in rows))
    live = stream.read(spark, str(src), "candidate string, sample_id string, field_accuracy double, error_code string, ts timestamp")
    q = stream.rolling(stream.first_seen(live), late=None).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r.start)[11:16]: (r.n, r.errors) for r in spark.table("rolled").collect()}
    assert got == {"00:00": (2, 1), "00:10": (1, 0)}


def test_image_quality_and_degradations(spark):
    rng = np.random.default_rng(1)
    px = rng.integers(80, 180, (12, 10))
    df = spark.createDataFrame([(px.tolist(), c) for c in catalog.CAPTURE_CONDITIONS], "px array<array<int>>, capture_condition string")
    out = {r.capture_condition: np.array(r.px) for r in image.degrade_tiles(df).collect()}
    assert (out["clean"] == px).all() and (out["laminated"] == px).all() and out["cropped"].shape == (11, 9)
    assert out["low_light"].mean() < 0.4 * px.mean() and out["glare"].mean() > px.mean() and out["rotated"].shape[0] > 12
    q = df.limit(1).select(image.tile_quality("px").alias("q")).first().q
    lap, bright, lum, _ = image.gray_measures(px)
    want = round(0.4 * min(lap / 300, 1) + 0.25 * max(0, 1 - bright / 0.15) + 0.2 * min(lum / 130, 1) + 0.15, 3)
    assert q.quality_score == pytest.approx(want) and q.blur == "low"
    dark = df.limit(1).select(image.low_light("px").alias("d")).first().d
    assert np.abs(np.array(dark) - out["low_light"]).max() <= 1
    images = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"bad"),)], "content binary")

    def decode(raw):
        if raw != b"ok":
            raise ValueError
        return np.full((4, 4), 200)

    got = [r.quality for r in image.assess_images(images, decode).collect()]
    assert got[0].blur == "high" and got[1] is None
    boxes = spark.createDataFrame([([(0, 0, 2, 2), (5, 5, 1, 4), (9, 9, 1, 1)],), ([],)], "b array<struct<x:int,y:int,w:int,h:int>>")
    assert [r.p for r in boxes.select(image.pick_portrait("b").alias("p")).collect()] == [[0, 0, 2, 2], None]
