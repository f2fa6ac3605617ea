"""Relations that the queries need, derived from the driver's tables by plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyform.plans import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows from events: event types stand for candidates."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    i = F.col("event_id")
    extracted = i % 6 < 4
    return e.select(
        F.col("event_type").alias("candidate"),
        i.alias("sample_id"),
        F.concat(F.lit("type_"), F.col("user_id") % 9).alias("document_type"),
        F.concat(F.lit("cond_"), i % 10).alias("capture_condition"),
        ((F.col("k") % 101) / 100).alias("field_accuracy"),
        ((F.col("k") % 5) / 4).alias("required_field_recall"),
        F.when(i % 7 != 0, i % 3 != 0).alias("classification_correct"),
        (i % 4 != 0).alias("schema_followed"),
        (i % 2 == 0).alias("portrait_expected"),
        extracted.alias("portrait_extracted"),
        F.when(extracted, (F.col("k") % 11) / 10).otherwise(0.0).alias("portrait_quality_score"),
        F.when(i % 50 == 0, 0.0).otherwise(F.col("value") * 40).alias("latency_ms"),
        F.when(i % 5 != 0, (F.col("k") % 13) * 100.0).alias("gpu_memory_mb"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (i % 3 + 1).cast("int")).alias("cost_estimate"),
        F.element_at(F.array(F.lit("approved"), F.lit("needs_review"), F.lit("rejected")), (i % 3 + 1).cast("int")).alias("license_status"),
        (i % 2 == 1).alias("on_prem"),
        F.when(i % 40 == 0, "INVALID_IMAGE").when(i % 20 == 0, "PROVIDER_PARTIAL_FAILURE").alias("error_code"),
        F.when(i % 40 == 0, F.concat(F.lit("image load failed: event "), i)).when(i % 20 == 0, "timed out").alias("error"),
    )


EVIDENCE_SQL = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id AS i FROM events),
ev AS (
  SELECT event_type AS candidate, i AS sample_id, 'type_' || (user_id % 9) AS document_type, 'cond_' || (i % 10) AS capture_condition,
    (k % 101) / 100e0 AS field_accuracy, (k % 5) / 4e0 AS required_field_recall, CASE WHEN i % 7 <> 0 THEN i % 3 <> 0 END AS classification_correct,
    i % 4 <> 0 AS schema_followed, i % 2 = 0 AS portrait_expected, i % 6 < 4 AS portrait_extracted,
    CASE WHEN i % 6 < 4 THEN (k % 11) / 10e0 ELSE 0e0 END AS portrait_quality_score, CASE WHEN i % 50 = 0 THEN 0e0 ELSE value * 40 END AS latency_ms,
    CASE WHEN i % 5 <> 0 THEN (k % 13) * 100e0 END AS gpu_memory_mb, ['low', 'medium', 'high'][i % 3 + 1] AS cost_estimate,
    ['approved', 'needs_review', 'rejected'][i % 3 + 1] AS license_status, i % 2 = 1 AS on_prem,
    CASE WHEN i % 40 = 0 THEN 'INVALID_IMAGE' WHEN i % 20 = 0 THEN 'PROVIDER_PARTIAL_FAILURE' END AS error_code,
    CASE WHEN i % 40 = 0 THEN 'image load failed: event ' || i WHEN i % 20 = 0 THEN 'timed out' END AS error
  FROM k)"""


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document_type, text): documents in four layouts from customers and nations."""
    c, n = table(spark, sf_dir, "customer"), F.broadcast(table(spark, sf_dir, "nation"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    i, digits = F.col("c_custkey"), F.lpad((F.col("c_custkey") * 7919 + 10000000000).cast("string"), 11, "0")
    lay = [
        F.concat_ws("\n", F.concat(F.lit("Surname: "), "c_name"), F.lit("First Name:"), F.col("n_name"), F.concat(F.lit("NIN: "), digits), F.lit("Sex:M"), F.lit("Sex: F")),
        F.concat_ws("\n", F.lit("Surname:"), F.col("n_name"), F.lit("Address:"), F.lit("NIN:"), digits, F.lit("First Name"), F.col("c_name")),
        F.concat_ws("\n", F.concat(F.lit("ACCOUNT NAME: "), "c_name"), F.concat(F.lit("bvn no. "), digits), F.concat(F.lit("Phone No: 0"), digits), F.concat(F.lit("Address: "), "c_mktsegment", F.lit(", "), "n_name")),
        F.concat_ws("\n", F.concat(F.lit("Name: "), "c_name"), F.lit("  "), F.concat(F.lit("  Name: "), "n_name"), F.concat(F.lit("my id is "), digits)),
    ]
    text, kind = lay[3], F.lit("bank_mandate")
    for k in (2, 1, 0):
        text = F.when(i % 4 == k, lay[k]).otherwise(text)
    kind = F.when(i % 4 < 2, "nin_slip").otherwise("bank_mandate")
    return j.select(i.alias("id"), kind.alias("document_type"), text.alias("text"))


TEXTS_SQL = """
src AS (
  SELECT c_custkey AS id, c_name, n_name, c_mktsegment, lpad(CAST(c_custkey * 7919 + 10000000000 AS VARCHAR), 11, '0') AS d
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
texts AS (
  SELECT id, CASE WHEN id % 4 < 2 THEN 'nin_slip' ELSE 'bank_mandate' END AS document_type,
    CASE id % 4
      WHEN 0 THEN concat_ws(chr(10), 'Surname: ' || c_name, 'First Name:', n_name, 'NIN: ' || d, 'Sex:M', 'Sex: F')
      WHEN 1 THEN concat_ws(chr(10), 'Surname:', n_name, 'Address:', 'NIN:', d, 'First Name', c_name)
      WHEN 2 THEN concat_ws(chr(10), 'ACCOUNT NAME: ' || c_name, 'bvn no. ' || d, 'Phone No: 0' || d, 'Address: ' || c_mktsegment || ', ' || n_name)
      ELSE concat_ws(chr(10), 'Name: ' || c_name, '  ', '  Name: ' || n_name, 'my id is ' || d) END AS text
  FROM src)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, document_type, answer): JSON answers in prose, fences, or broken, from events."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(i % 4 == 0, F.concat(F.lit('{"Sex": "M", "NIN": {"value": "'), k, F.lit('", "confidence": 0.75}, "gender": "F", "extra": 1}')))
        .when(i % 4 == 1, F.concat(F.lit('{"First Name": "Ada'), k, F.lit('", "surname": null, "Last-Name": "Obi", "address": "null"}')))
        .when(i % 4 == 2, F.concat(F.lit('{"nin": '), k, F.lit(', "tracking": "'), "event_type", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"nin": "'), k, F.lit('"')))
    )
    text = F.when(i % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(i % 3 == 1, F.concat(F.lit("Sure! "), body, F.lit(" Bye."))).otherwise(body)
    return e.select("event_id", F.lit("nin_slip").alias("document_type"), text.alias("answer"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, shown): order dates printed in twelve formats."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd MMM yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "yyyy/MM/dd", "dd MMM, yyyy", "dd-MMM-yyyy", "dd/MM/yy"]
    shown = F.element_at(F.array(*[F.date_format(d, f) for f in formats]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 29 == 0, F.concat(F.lit("valid  till "), F.date_format(d, "dd/MM/yyyy"), F.lit(" only"))).otherwise(shown).alias("shown"), "o_orderdate")


DATES_SQL = """
shown AS (
  SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 29 = 0 THEN 'valid  till ' || strftime(o_orderdate, '%d/%m/%Y') || ' only'
    ELSE [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%d %b %Y'),
      strftime(o_orderdate, '%d %B %Y'), strftime(o_orderdate, '%b %d, %Y'), strftime(o_orderdate, '%B %d, %Y'), strftime(o_orderdate, '%Y/%m/%d'), strftime(o_orderdate, '%d %b, %Y'),
      strftime(o_orderdate, '%d-%b-%Y'), strftime(o_orderdate, '%d/%m/%y')][o_orderkey % 12 + 1] END AS shown
  FROM orders),
cleaned AS (SELECT *, trim(regexp_replace(shown, '[\\s\\p{Z}]+', ' ', 'g')) AS c FROM shown),
parsed AS (
  SELECT *, coalesce(CASE WHEN regexp_full_match(c, '\\d{1,2}/\\d{1,2}/\\d{2}') THEN try_strptime(c, '%d/%m/%y') END, try_strptime(c, '%Y-%m-%d'), try_strptime(c, '%d/%m/%Y'), try_strptime(c, '%d-%m-%Y'), try_strptime(c, '%d.%m.%Y'), try_strptime(c, '%d %b %Y'), try_strptime(c, '%d %B %Y'),
    try_strptime(c, '%b %d, %Y'), try_strptime(c, '%B %d, %Y'), try_strptime(c, '%Y/%m/%d'), try_strptime(c, '%d %b, %Y'), try_strptime(c, '%d-%b-%Y'), try_strptime(c, '%d/%m/%y'),
    try_strptime(regexp_extract(c, '\\d{1,2}[-/]\\d{1,2}[-/]\\d{4}'), '%d/%m/%Y'))::DATE AS d
  FROM cleaned)"""

ALL_FIELDS = sorted({f for own in catalog.SCHEMAS.values() for f in own})
