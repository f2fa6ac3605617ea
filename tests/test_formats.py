"""The manifest source and the JSON array sink: what they open, what they leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from tallyform.sources import formats, io


@pytest.fixture
def dataset(tmp_path):
    """900 samples; only those of type passport have ground truth that parses."""
    samples = [{"sample_id": f"s{i}", "document_type": "passport" if i % 300 == 0 else "nin_slip", "image_path": f"x/{i}.jpg", "tags": ["t"]} for i in range(900)]
    (tmp_path / "m.json").write_text(json.dumps({"name": "m", "samples": samples}))
    (tmp_path / "expected").mkdir()
    for s in samples[:-1]:
        good = s["document_type"] == "passport"
        (tmp_path / "expected" / f"{s['sample_id']}.json").write_text(json.dumps({"sample_id": s["sample_id"], "fields": {"nin": "1"}, "required_fields": ["nin"], "portrait_bbox": [1, 2, 3, 4]}) if good else "not JSON")
    return str(tmp_path / "m.json"), str(tmp_path / "expected")


def test_only_wanted_ground_truth_is_opened(spark, dataset):
    df = formats.read_samples(spark, *dataset)
    rows = df.where("document_type = 'passport'").orderBy("sample_id").collect()  # any other file opened would fail
    assert [(r.sample_id, r.fields, r.portrait_bbox, r.capture_condition) for r in rows] == [(f"s{i}", {"nin": "1"}, [1, 2, 3, 4], "clean") for i in (0, 300, 600)]
    assert df.where("sample_id IN ('s0', 's899') AND image_path IS NOT NULL").orderBy("sample_id").select("has_expected", "fields").collect() == [(True, {"nin": "1"}), (False, None)]
    assert df.where(F.col("document_type").startswith("pass")).where("size(tags) = 1").count() == 3
    with pytest.raises(Exception, match="JSON"):
        df.where("document_type = 'nin_slip'").collect()


def test_partitions_follow_the_manifest(dataset):
    reader = formats._ManifestReader(*dataset)
    assert [len(p.rows) for p in reader.partitions()] == [256, 256, 256, 132]


def test_an_empty_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "m"}')
    assert formats.read_samples(spark, str(tmp_path / "m.json"), str(tmp_path)).count() == 0


def test_array_in_order(spark, tmp_path):
    path = str(tmp_path / "a.json")
    formats.write_array(spark.range(1000, numPartitions=7).select("id", F.when(F.col("id") % 2 == 0, F.lit('q"é\n')).alias("t")), path)
    assert json.load(open(path)) == [{"id": i, "t": 'q"é\n' if i % 2 == 0 else None} for i in range(1000)]
    formats.write_array(spark.range(0).select("id"), path)  # over what is there
    assert json.load(open(path)) == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a.json")
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        formats.write_array(bad, path)
    assert list(tmp_path.iterdir()) == []


def test_evidence_counts_its_rows(spark, tmp_path):
    e = spark.createDataFrame([("a", "s1", 2), ("a", "s0", 1)], "candidate string, sample_id string, ordinal int")
    assert io.write_array(e, str(tmp_path / "r.json")) == 2
    assert [r["sampleId"] for r in json.load(open(tmp_path / "r.json"))] == ["s0", "s1"]


def test_an_array_is_read_by_many_tasks(spark, tmp_path):
    path, split = str(tmp_path / "r.json"), "spark.sql.files.maxPartitionBytes"
    e = spark.range(3000, numPartitions=3).select(F.concat(F.lit('a\n"},[{'), "id").alias("sample_id"), F.array(F.lit("[x],"), F.lit("}")).alias("notes"))
    assert io.write_array(e, path) == 3000
    size, kept = (tmp_path / "r.json").stat().st_size, spark.conf.get(split)
    spark.conf.set(split, str(size // 8))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = io.read_evidence(spark, path).select("sample_id", "notes")
        assert got.rdd.getNumPartitions() >= 8
        assert sorted(got.collect()) == sorted(e.collect())
        by_id = io.read_evidence(spark, path).select("sample_id", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
        assert [r.sample_id for r in by_id] == [r.sample_id for r in e.collect()]
    finally:
        spark.conf.set(split, kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("layout", [{"indent": 2}, {"indent": 0}, {}, {"separators": (",\n", ":")}])
def test_arrays_of_other_layouts(spark, tmp_path, layout):
    rows = [{"sampleId": f"s{i}", "notes": ["{", "}],"], "perFieldScores": {"a": i / 4}, "error": None} for i in range(40)]
    (tmp_path / "r.json").write_text(json.dumps(rows, **layout))
    got = io.read_evidence(spark, str(tmp_path / "r.json")).collect()
    assert [(r.sample_id, r.notes, r.per_field_scores, r.error) for r in got] == [(r["sampleId"], r["notes"], r["perFieldScores"], None) for r in rows]


def test_several_objects_a_line_all_count(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"sampleId": "a"}, {"sampleId": "b"},\n\t{"sampleId": "c"} ,\n {"sampleId": "d"}]\n')
    assert [r.sample_id for r in io.read_evidence(spark, str(tmp_path / "r.json")).collect()] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("text", ['[\n{"sampleId": "a", "x": [{"b": 1},\n{"b": 2}]}\n]\n', '[\n{"sampleId": "a", "x": {"b": 1},\n"c": {}}]'])
def test_objects_across_lines_stay_whole(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert [r.sample_id for r in io.read_evidence(spark, str(tmp_path / "r.json")).collect()] == ["a"]


def test_lines_read_as_the_whole_does(spark, tmp_path):
    odd = [{"sampleId": "a", "textCharCount": "x", "notes": 3}, {}, {"sample_id": "b", "latencyMs": "NaN"}, {"sampleId": 7, "perFieldScores": {"a": "y", "b": 1}}, {"sampleId": "c", "x": {"y": [1]}, "onPrem": "no"}]
    (tmp_path / "lines.json").write_text("[\n" + ",\n".join(map(json.dumps, odd)) + "\n]\n")
    (tmp_path / "whole.json").write_text(json.dumps(odd, indent=2))
    a, b = (io.read_evidence(spark, str(tmp_path / f"{n}.json")) for n in ("lines", "whole"))
    assert a.schema == b.schema and str(a.collect()) == str(b.collect()) and a.count() == 5
