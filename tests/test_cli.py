import json

import pytest

from tallyform import __main__ as cli
from tallyform.operators import resources
from tallyform.sources import config, providers


def test_commands_from_samples_to_report(spark, tmp_path, capsys):
    d, res = str(tmp_path / "d"), str(tmp_path / "res")
    cli.main(["gen-samples", "--out", d, "--doc-types", "passport,utility_bill", "--conditions", "clean,glare", "--today", "2026-01-01"])
    cli.main(["validate", "--dataset", d])
    assert "4 samples" in (out := capsys.readouterr().out) and "OK" in out
    cli.main(["run", "--dataset", d, "--results", res, "--providers", "paddleocr-vl, mock, nothing", "--no-portrait"])
    out = capsys.readouterr().out
    assert "8 rows" in out and out.index("| paddleocr-vl |") < out.index("| mock |")
    folder = next((tmp_path / "res").iterdir())
    meta = json.loads((folder / "run_meta.json").read_text())
    assert meta["sample_count"] == 4 and "nothing" in meta["unavailable"] and "extract_portrait" not in meta["ops"]
    cli.main(["report", str(folder)])
    (tmp_path / "d/expected/passport-00-clean.json").unlink()
    with pytest.raises(SystemExit):
        cli.main(["validate", "--dataset", d])
    assert "missing expected for passport-00-clean" in capsys.readouterr().out
    cli.main(["run", "--dataset", d, "--results", str(tmp_path / "r2"), "--providers", "tesseract", "--doc-type", "passport"])
    assert "1 of 2 samples had errors" in capsys.readouterr().out
    cli.main(["providers", "--json"])
    assert len(json.loads(capsys.readouterr().out)) == 6
    with pytest.raises(SystemExit):
        cli.main(["run", "--dataset", str(tmp_path / "empty")])


def test_operations_are_isolated(spark):
    def fails(row):
        raise ValueError(row["sample_id"])

    df = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    rows = providers.analyze(df, {"classify": lambda r: {"type": r["sample_id"]}, "extract_text": fails, "extract_portrait": None}).collect()
    assert [json.loads(r.results["classify"])["type"] for r in rows] == ["a", "b"]
    assert rows[0].error == "extract_text: ValueError: a" and rows[0].error_code == "PROVIDER_PARTIAL_FAILURE" and rows[0].skipped == ["extract_portrait"]
    assert set(rows[0].latency_ms) == {"classify", "extract_text", "total"}


def test_settings_and_probe():
    s = config.Settings.load({"OCR_ALLOWED_PROVIDERS": "mock, tesseract", "OCR_GPU_QUERY_ENABLED": "false", "OCR_ENDPOINTS__GLM_OCR__BASE_URL": "http://x", "OTHER": "1"})
    assert s.allowed_providers == ("mock", "tesseract") and not s.gpu_query_enabled and s.endpoint_for("glm-ocr").base_url == "http://x" and s.endpoint_for("mock").model == ""
    assert providers.probe(lambda: ["m"], "m") == (True, None) and not providers.probe(lambda: [], "m")[0]
    assert providers.probe(lambda: 1 / 0, "m") == (False, "endpoint not reachable: ZeroDivisionError")
    with resources.peak_memory() as mb:
        pass
    assert mb() >= 0
