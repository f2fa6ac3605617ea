import pytest
from pyspark.sql import functions as F

from tallyform.operators import extract
from tallyform.plans import catalog


def fields(spark, text, kind):
    df = spark.createDataFrame([("a", text, kind)], "id string, text string, document_type string")
    return {r.field: r.value for r in extract.text_fields(df, "id").collect()}


def test_inline_and_next_line(spark):
    assert fields(spark, "Surname: OKAFOR\nFirst Name:\nADA\nNIN: 12345678901\n", "nin_slip") == {"surname": "OKAFOR", "first_name": "ADA", "nin": "12345678901"}


def test_label_without_value_takes_nothing(spark):
    got = fields(spark, "Surname:\nBALOGUN\nAddress:\nNIN:\n11122233344\nFirst Name:\nTUNDE", "nin_slip")
    assert got == {"surname": "BALOGUN", "nin": "11122233344", "first_name": "TUNDE"}


def test_fallbacks_and_scope(spark):
    assert fields(spark, "number 12345678901 only", "nin_slip") == {"nin": "12345678901"}
    assert fields(spark, "BVN no 12345678901", "bank_mandate") == {"bvn": "12345678901", "nin": "12345678901"}
    assert "bvn" not in catalog.label_map("nin_slip") and "bvn" in catalog.label_map("bank_mandate")
    assert fields(spark, "Sex:M", "nin_slip") == {}
    assert fields(spark, "Sex: M", "nin_slip") == {"gender": "M"}
    assert fields(spark, "", "nin_slip") == {} and fields(spark, None, "nin_slip") == {}


def test_first_match_wins(spark):
    assert fields(spark, "Surname: A B\nLast Name: C D", "nin_slip") == {"surname": "A B"}


@pytest.mark.parametrize(
    "answer,want",
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('see {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("no json here", None), ("", None), (None, None), ("{broken", None), ("} {", None)],
)
def test_json_object(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string").select(extract.json_object("a").alias("x"))
    assert df.first().x == want


def coerce(spark, answer, kind):
    df = spark.createDataFrame([(answer, kind)], "answer string, document_type string")
    r = extract.json_fields(df).first()
    return {k: v.value for k, v in r.fields.items()}, r.schema_followed


def test_key_coercion(spark):
    got, ok = coerce(spark, '{"First Name": "Ada", "Sex": "F", "Date of Birth": "1990-01-01", "NIN": {"value": "1", "confidence": 0.5}}', "nin_slip")
    assert got == {"first_name": "Ada", "gender": "F", "nin": "1"} and ok
    got, _ = coerce(spark, '{"Name": "A B", "Address": "here", "Issued By": "us"}', "utility_bill")
    assert got == {"full_name": "A B", "address": "here", "issuing_authority": "us"}


def test_first_key_wins_even_if_null(spark):
    assert coerce(spark, '{"surname": null, "last_name": "X"}', "nin_slip")[0] == {}
    assert coerce(spark, '{"address": "null", "gender": ""}', "nin_slip")[0] == {}


def test_unparseable_answer(spark):
    assert coerce(spark, "nothing", "nin_slip") == ({}, False)
    assert coerce(spark, '{"zzz": 1}', "nin_slip") == ({}, True)


def test_plain_fields(spark):
    df = spark.createDataFrame([("Surname ABE\nFirst name: - Bo\nid 12345678901 x",)], "t string")
    got = df.select(extract.plain_fields("t", F.lit("nin_slip")).alias("m")).first().m
    assert got == {"surname": "ABE", "first_name": "Bo", "nin": "12345678901"}


def test_keyword_ties_and_misses(spark):
    df = spark.createDataFrame([("driver and voter",), ("nothing",), (None,)], "t string")
    got = [r.c for r in df.select(extract.keyword_class("t").alias("c")).collect()]
    assert [g.document_type for g in got] == ["drivers_license", "unknown", "unknown"]
    assert got[0].confidence == pytest.approx(0.6) and got[1].confidence == 0
