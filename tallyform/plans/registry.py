"""Queries over the driver's tables, each with the SQL that checks it.

Every query runs over its whole tables; a few have fixed dimensions or published figures for input and
read none. The flagship is evidence_summary.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyform.functions.numbers import rounded
from tallyform.functions import normalize as N
from tallyform.functions import similarity as S
from tallyform.operators import benchmark, codec, extract, image, report, resources, score, validate
from tallyform.plans import catalog
from tallyform.plans.inputs import DATES_SQL, EVIDENCE_SQL, TEXTS_SQL, answers, dates, evidence, labelled_texts, table
from tallyform.sources import formats, generate, io, providers
from tallyform.streaming import evidence as stream
from tallyform.streaming import summary as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- aggregation and ranking

_SUMMARY = f"""{EVIDENCE_SQL},
agg AS (
  SELECT candidate, count(*) AS n, round_even(avg(field_accuracy), 4) AS field_accuracy, round_even(avg(required_field_recall), 4) AS required_recall,
    round_even(avg(classification_correct::INT), 4) AS classification_accuracy, round_even(avg(schema_followed::INT), 4) AS schema_following_rate,
    round_even(avg(portrait_extracted::INT) FILTER (WHERE portrait_expected), 4) AS portrait_success_rate,
    coalesce(round_even(avg(portrait_quality_score) FILTER (WHERE portrait_extracted), 4), 0) AS portrait_quality,
    coalesce(round_even(quantile_cont(latency_ms, 0.5) FILTER (WHERE latency_ms <> 0), 1), 0) AS latency_p50_ms,
    coalesce(round_even(quantile_cont(latency_ms, 0.95) FILTER (WHERE latency_ms <> 0), 1), 0) AS latency_p95_ms,
    coalesce(round_even(avg(latency_ms) FILTER (WHERE latency_ms <> 0), 4), 0) AS latency_mean_ms,
    round_even(round_even(avg(gpu_memory_mb), 4), 1) AS gpu_memory_mb,
    arg_min(cost_estimate, sample_id) AS cost_estimate, arg_min(license_status, sample_id) AS license_status, arg_min(on_prem, sample_id) AS on_prem,
    round_even(avg((coalesce(error_code, '') NOT IN ('', 'PROVIDER_PARTIAL_FAILURE'))::INT), 4) AS error_rate, min(sample_id) AS first_seen
  FROM ev GROUP BY candidate),
scored AS (
  SELECT *, round_even(0.35e0 * field_accuracy + 0.15e0 * required_recall + 0.1e0 * coalesce(classification_accuracy, 0) + 0.1e0 * schema_following_rate
    + 0.1e0 * greatest(0e0, 1 - latency_p50_ms / 8000e0) + 0.1e0 * coalesce(portrait_success_rate, 0)
    + 0.05e0 * CASE cost_estimate WHEN 'low' THEN 1e0 WHEN 'medium' THEN 0.6e0 WHEN 'high' THEN 0.3e0 ELSE 0.5e0 END
    + 0.05e0 * CASE license_status WHEN 'approved' THEN 1e0 WHEN 'needs_review' THEN 0.5e0 WHEN 'rejected' THEN 0e0 ELSE 0.5e0 END, 4) AS composite_score
  FROM agg),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY composite_score DESC, first_seen, candidate) AS INTEGER) AS rank FROM scored)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rank(report.summarize(evidence(spark, sf_dir)))


@query(f"WITH {_SUMMARY} SELECT * FROM ranked")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: candidates ranked by composite score."""
    return _ranked(spark, sf_dir)


@query(
    f"""WITH {EVIDENCE_SQL} SELECT candidate, document_type, capture_condition, round_even(avg(field_accuracy), 4) AS field_accuracy, count(*) AS n
FROM ev GROUP BY GROUPING SETS ((candidate), (candidate, document_type), (candidate, capture_condition))"""
)
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over three groupings in one pass (A10)."""
    return report.grouped_accuracy(evidence(spark, sf_dir))


def _pivot_sql(column: str, values: list[str]) -> str:
    return f"WITH {EVIDENCE_SQL} SELECT candidate, " + ", ".join(f"round_even(avg(field_accuracy) FILTER (WHERE {column} = '{v}'), 4) AS {v}" for v in values) + " FROM ev GROUP BY candidate"


_TYPES, _CONDITIONS = [f"type_{i}" for i in range(9)], [f"cond_{i}" for i in range(10)]


@query(_pivot_sql("document_type", _TYPES))
def accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by document type."""
    return report.pivot_accuracy(evidence(spark, sf_dir), "document_type", _TYPES)


@query(_pivot_sql("capture_condition", _CONDITIONS))
def accuracy_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by capture condition."""
    return report.pivot_accuracy(evidence(spark, sf_dir), "capture_condition", _CONDITIONS)


@query(
    f"""WITH {EVIDENCE_SQL} SELECT candidate, document_type, round_even(quantile_cont(latency_ms, 0.5), 1) AS p50, round_even(quantile_cont(latency_ms, 0.95), 1) AS p95
FROM ev WHERE latency_ms <> 0 GROUP BY candidate, document_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles without zero latencies."""
    e = evidence(spark, sf_dir).where("latency_ms <> 0")
    return report.percentiles(e, ["candidate", "document_type"], F.col("latency_ms"), {"p50": 0.5, "p95": 0.95})


@query(
    f"""WITH {_SUMMARY}, two AS (SELECT *, CASE cost_estimate WHEN 'low' THEN 1e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END AS c FROM ranked WHERE rank <= 2)
SELECT CASE WHEN b.candidate IS NOT NULL AND a.composite_score - b.composite_score <= 0.03e0 AND b.c > a.c THEN b.candidate ELSE a.candidate END AS default_provider
FROM (SELECT * FROM two WHERE rank = 1) a LEFT JOIN (SELECT * FROM two WHERE rank = 2) b ON true"""
)
def cost_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended candidate by the cost rule."""
    return report.cost_tiebreak(_ranked(spark, sf_dir)).select("default_provider")


@query(
    f"""WITH {_SUMMARY}, keyed AS (
  SELECT candidate, rank, unnest([{{'operation': 'classify', 'v': classification_accuracy}}, {{'operation': 'extract_fields', 'v': field_accuracy}}, {{'operation': 'extract_text', 'v': field_accuracy}},
    {{'operation': 'extract_portrait', 'v': portrait_success_rate * portrait_quality}}]) AS o FROM ranked)
SELECT operation, candidate FROM (SELECT o.operation AS operation, candidate, row_number() OVER (PARTITION BY o.operation ORDER BY o.v DESC, rank) AS i FROM keyed WHERE o.v IS NOT NULL) WHERE i = 1"""
)
def operation_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of each operation."""
    return report.operation_winners(_ranked(spark, sf_dir))


@query(
    f"""WITH {EVIDENCE_SQL} SELECT candidate, count(*) AS n, count(error_code) AS errored, round_even(avg(field_accuracy), 4) AS mean_accuracy,
  CASE WHEN count(error_code) = count(*) AND avg(field_accuracy) < 0.1e0 THEN 'total_failure' ELSE 'partial' END AS status,
  substr(coalesce(arg_min(error, sample_id) FILTER (WHERE error_code IS NOT NULL AND error <> ''), ''), 1, 160) AS example
FROM ev GROUP BY candidate HAVING count(error_code) > 0"""
)
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with errors."""
    return report.run_health(evidence(spark, sf_dir))


#: Published component columns (fixed values): accuracy, recall, classification, schema, portrait, p50, cost.
_GOLDEN = (
    ("olmocr", 0.850, 0.842, 1.000, 1.000, 0.875, 811000.0, "medium"),
    ("qwen-vl", 0.668, 0.583, 0.625, 1.000, 0.875, 707000.0, "high"),
    ("glm-ocr", 0.641, 0.558, 0.125, 0.875, 0.875, 82000.0, "low"),
    ("tesseract", 0.075, 0.042, 0.500, 0.000, 0.875, 2600.0, "low"),
    ("paddleocr-vl", 0.256, 0.250, 0.000, 0.000, 0.875, 125000.0, "low"),
)


@query(
    "WITH g AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', {a}e0, {r}e0, {k}e0, {s}e0, {p}e0, {t}e0, '{cost}')" for c, a, r, k, s, p, t, cost in _GOLDEN)
    + """) t(candidate, a, r, k, s, p, t, cost))
SELECT candidate, round_even(0.35e0 * a + 0.15e0 * r + 0.1e0 * k + 0.1e0 * s + 0.1e0 * greatest(0e0, 1 - t / 8000e0) + 0.1e0 * p
  + 0.05e0 * CASE cost WHEN 'low' THEN 1e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END + 0.05e0 * 1e0, 4) AS composite_score FROM g"""
)
def composite_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of the published component columns."""
    g = spark.createDataFrame(list(_GOLDEN), "candidate string, a double, r double, k double, s double, p double, t double, cost string")
    c = F.col
    return g.select("candidate", report.composite(c("a"), c("r"), c("k"), c("s"), c("p"), c("t"), c("cost"), F.lit("approved")).alias("composite_score"))


@query(
    """WITH d AS (SELECT event_id, event_type, event_id % 3 AS m, value FROM events)
SELECT event_id, greatest(nullif(CASE WHEN m = 0 THEN NULL ELSE value END, 0), nullif(CASE WHEN m = 1 THEN 0e0 ELSE round_even(value / 2, 3) END, 0)) AS gpu_mb,
  CASE WHEN m = 2 THEN round_even(value, 1) ELSE round_even(value + 12e0, 1) END AS total_mb FROM d"""
)
def gpu_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest of two readings without nulls and zeros, and a sum over the numeric tokens of a listing."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 3
    before, after = F.when(m != 0, F.col("value")), F.when(m == 1, 0.0).otherwise(rounded(F.col("value") / 2, 3))
    listing = F.concat(F.col("value").cast("string"), F.when(m == 2, F.lit(" [N/A]")).otherwise(F.lit("\n12")))
    return e.select("event_id", resources.larger_reading(before, after).alias("gpu_mb"), resources.listing_total(listing).alias("total_mb"))


# ---------------------------------------------------------------- normalization and checks

_SP = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
_SQL_SPACE = rf"trim(regexp_replace({{c}}, '{_SP}+', ' ', 'g'))"


def _sql_space(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SP}+', ' ', 'g'))"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


@query(
    rf"""SELECT doc_id, {_sql_space('text')} AS clean, upper(replace(regexp_replace({_sql_space('text')}, '[^\p{{L}}\p{{N}}_ ''\-]', '', 'g'), 'ß', 'SS')) AS name,
  upper(replace({_sql_space('text')}, 'ß', 'SS')) AS plain FROM documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, name and plain forms of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", N.whitespace("text").alias("clean"), N.name("text").alias("name"), N.field_value(F.lit("occupation"), F.col("text")).alias("plain"))


@query(
    rf"""WITH v AS (SELECT c_custkey, c_name || ' / ' || c_acctbal::VARCHAR AS a, c_custkey::VARCHAR || '-' || c_custkey::VARCHAR AS b, '  n' || c_custkey::VARCHAR || ',000.00 ' AS c FROM customer),
u AS (SELECT c_custkey, upper({_sql_strip('a')}) AS a, upper({_sql_strip('b')}) AS b, upper({_sql_strip('c')}) AS c FROM v)
SELECT c_custkey, """
    + ", ".join(f"regexp_extract({x}, '^([A-Z]{{0,2}})', 1) || regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g') AS {n}" for x, n in (("a", "nin"), ("b", "phone"), ("c", "amount")))
    + " FROM u"
)
def normalize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity numbers, phones and money."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        N.field_value(F.lit("nin"), F.concat("c_name", F.lit(" / "), F.col("c_acctbal").cast("string"))).alias("nin"),
        N.field_value(F.lit("phone_number"), F.concat(key, F.lit("-"), key)).alias("phone"),
        N.field_value(F.lit("amount_due"), F.concat(F.lit("  n"), key, F.lit(",000.00 "))).alias("amount"),
    )


@query(f"WITH {DATES_SQL} SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso FROM parsed")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in twelve formats, read back."""
    return dates(spark, sf_dir).select("o_orderkey", N.field_value(F.lit("issue_date"), F.col("shown")).alias("iso"))


_TODAY = "1996-06-15"


@query(
    f"""WITH {DATES_SQL} SELECT o_orderkey, d >= DATE '{_TODAY}' AS ok, CASE WHEN d >= DATE '{_TODAY}' THEN 'ok' ELSE 'Document expired on ' || strftime(d, '%Y-%m-%d') END AS message FROM parsed"""
)
def expiry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry against a pinned day (V4)."""
    return dates(spark, sf_dir).select("o_orderkey", N.validate_expiry_not_past("shown", _TODAY).alias("v")).select("o_orderkey", "v.ok", "v.message")


@query(
    """WITH v AS (SELECT p_partkey, substr(p_brand, 1, 1) || lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 8 END, '0') AS p, lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 11 ELSE 10 END, '7') AS n FROM part)
SELECT p_partkey, length(n) = 11 AS nin_ok, CASE WHEN length(n) = 11 THEN 'ok' ELSE 'NIN should be 11 digits, got ' || length(n) END AS nin_message,
  CASE WHEN length(n) = 11 THEN 'ok' ELSE 'BVN should be 11 digits, got ' || length(n) END AS bvn_message,
  regexp_full_match(upper(p), '[A-Z]\\d{8}') AS passport_ok FROM v""".replace("\\\\", "\\")
)
def id_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity number checks (V1-V3)."""
    k = F.col("p_partkey").cast("string")
    passport = F.concat(F.lower(F.substring("p_brand", 1, 1)), F.when(F.col("p_partkey") % 3 == 0, F.lpad(k, 7, "0")).otherwise(F.lpad(k, 8, "0")))
    nin = F.when(F.col("p_partkey") % 2 == 0, F.lpad(k, 11, "7")).otherwise(F.lpad(k, 10, "7"))
    spaced = F.concat(F.substring(nin, 1, 3), F.lit(" "), F.substring(nin, 4, 20))
    v = table(spark, sf_dir, "part").select("p_partkey", N.validate_nin(spaced).alias("n"), N.validate_bvn(spaced).alias("b"), N.validate_passport_number(F.concat(F.lit(" "), passport)).alias("p"))
    return v.select("p_partkey", F.col("n.ok").alias("nin_ok"), F.col("n.message").alias("nin_message"), F.col("b.message").alias("bvn_message"), F.col("p.ok").alias("passport_ok"))


@query(
    rf"""WITH v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' m ' WHEN 1 THEN 'Female' WHEN 2 THEN 'F' WHEN 3 THEN 'male' ELSE 'x' END AS g, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages)
SELECT page_id, CASE WHEN upper(trim(g)) IN ('M', 'MALE') THEN 'MALE' WHEN upper(trim(g)) IN ('F', 'FEMALE') THEN 'FEMALE' ELSE upper(trim(g)) END AS gender,
  trim(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]+', ' ', 'g'), '{_SP}+', ' ', 'g')) AS label,
  regexp_replace(regexp_replace(lower({_sql_strip('t')}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM v"""
)
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genders, label phrases and keys."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id") % 5
    g = F.when(i == 0, " m ").when(i == 1, "Female").when(i == 2, "F").when(i == 3, "male").otherwise("x")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return p.select("page_id", N.field_value(F.lit("gender"), g).alias("gender"), N.label(title).alias("label"), N.key(title).alias("key"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{t}', '{f}', '{'name' if f in catalog.NAME_FIELDS else 'date' if f in catalog.DATE_FIELDS else 'number' if f in catalog.NUMBER_FIELDS + catalog.PHONE_FIELDS else 'address' if f == 'address' else 'text'}', {str(r).lower()})"
        for t, _, f, _, r, _ in catalog.FIELD_ROWS
    )
    + ") v(document_type, field, kind, required)"
)
def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field catalog with the kinds that scoring uses."""
    return catalog.field_catalog(spark).select("document_type", "field", N.field_kind("field").alias("kind"), "required")


# ---------------------------------------------------------------- extraction

_STOPS = {"en": ["the ", " of ", " and "], "fr": [" de ", " les ", " et "], "de": [" der ", " die ", " und "], "es": [" de ", " los ", " y "]}


@query(
    "WITH h AS (SELECT doc_id, source, lang, "
    + ", ".join(" + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f" AS h_{k}" for k, words in _STOPS.items())
    + " FROM documents), b AS (SELECT *, greatest("
    + ", ".join(f"h_{k}" for k in _STOPS)
    + ") AS hits FROM h), p AS (SELECT *, CASE WHEN hits = 0 THEN 'unknown' "
    + " ".join(f"WHEN h_{k} = hits THEN '{k}'" for k in _STOPS)
    + " END AS got FROM b) SELECT doc_id, got AS document_type, hits, CASE WHEN hits > 0 THEN least(0.4e0 + 0.2e0 * hits, 0.9e0) ELSE 0e0 END AS confidence, got = lang AS correct FROM p"
)
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword classifier with stop words as keywords and languages as types."""
    d = table(spark, sf_dir, "documents")
    v = d.select("doc_id", "lang", extract.keyword_class("text", _STOPS).alias("c"))
    return v.select("doc_id", "c.document_type", "c.hits", "c.confidence", (F.col("c.document_type") == F.col("lang")).alias("correct"))


_LABEL_VALUES = ", ".join(f"('{t}', '{label}', '{f}')" for t in ("nin_slip", "bank_mandate") for label, f in catalog.label_map(t).items())


@query(
    rf"""WITH {TEXTS_SQL}, labels(document_type, label, field) AS (VALUES {_LABEL_VALUES}),
raw AS (SELECT id, document_type, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
ln AS (SELECT id, document_type, text, trim(line) AS line, pos FROM raw WHERE trim(line) <> ''),
parts AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_extract(line, '^\s*([^:]{{1,40}}?):\s*(.+\S)\s*$', 1)), '[^a-z0-9_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS il,
  trim(regexp_extract(line, '^\s*([^:]{{1,40}}?):\s*(.+\S)\s*$', 2)) AS iv, trim(regexp_replace(regexp_replace(lower(rtrim(line, ':')), '[^a-z0-9_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS wl FROM ln),
tagged AS (SELECT p.*, CASE WHEN iv <> '' THEN a.field END AS inf, b.field AS wf FROM parts p LEFT JOIN labels a ON a.document_type = p.document_type AND a.label = p.il LEFT JOIN labels b ON b.document_type = p.document_type AND b.label = p.wl),
nxt AS (SELECT *, lead(line) OVER w AS nl, lead(inf IS NOT NULL OR wf IS NOT NULL) OVER w AS nlab FROM tagged WINDOW w AS (PARTITION BY id ORDER BY pos)),
hits AS (SELECT id, CASE WHEN inf IS NOT NULL THEN inf WHEN nl IS NOT NULL AND NOT nlab THEN wf END AS field, CASE WHEN inf IS NOT NULL THEN iv ELSE nl END AS value, pos FROM nxt),
named AS (SELECT id, field, arg_min(value, pos) AS value, 0 AS late FROM hits WHERE field IS NOT NULL AND value <> '' GROUP BY id, field),
fall AS (SELECT id, 'nin' AS field, regexp_extract(text, '\b(\d{{11}})\b', 1) AS value, 1 AS late FROM texts
  UNION ALL SELECT id, 'bvn', regexp_extract(text, '(?i)bvn[^0-9]{{0,16}}(\d{{11}})', 1), 1 FROM texts WHERE document_type = 'bank_mandate'),
both_ AS (SELECT * FROM named UNION ALL SELECT * FROM fall WHERE value <> '')
SELECT id, field, arg_min(value, late) AS value FROM both_ GROUP BY id, field"""
)
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from labelled lines: inline, next line, fallbacks."""
    return extract.text_fields(labelled_texts(spark, sf_dir), "id").select(F.col("key").alias("id"), "field", "value")


def _plain_sql(field: str, kind: str) -> str:
    if field in ("nin", "bvn"):
        pattern = r"\b(\d{11})\b" if field == "nin" else r"(?i)bvn[^0-9]{0,12}(\d{11})"
        return f"SELECT id, '{field}' AS field, regexp_extract(text, '{pattern}', 1) AS value FROM texts WHERE document_type = '{kind}'"
    labels = catalog.PLAIN_LABELS.get(field, [])
    if not labels:
        return ""
    after = ", ".join(f"CASE WHEN strpos(lower(line), '{x}') > 0 THEN nullif(regexp_replace(substr(line, strpos(lower(line), '{x}') + {len(x)}), '^[ :.\\-\\t]+', ''), '') END" for x in labels)
    return f"SELECT id, '{field}' AS field, arg_min(v, pos) AS value FROM (SELECT id, pos, coalesce({after}) AS v FROM ln WHERE document_type = '{kind}') WHERE v IS NOT NULL GROUP BY id"


@query(
    f"""WITH {TEXTS_SQL}, raw AS (SELECT id, document_type, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
ln AS (SELECT id, document_type, trim(line) AS line, pos FROM raw WHERE trim(line) <> ''), found AS ("""
    + " UNION ALL ".join(filter(None, (_plain_sql(f, t) for t in ("nin_slip", "bank_mandate") for f in catalog.SCHEMAS[t])))
    + ") SELECT id, field, trim(value) AS value FROM found WHERE value <> ''"
)
def plain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields after labels anywhere in a line."""
    t = labelled_texts(spark, sf_dir)
    return t.select("id", F.explode(extract.plain_fields("text", "document_type")).alias("field", "value"))


@query(
    """WITH e AS (SELECT event_id, event_id % 4 AS m, event_type, json_extract_string(props, '$.k') AS k FROM events),
r AS (SELECT event_id, m, unnest(CASE m
    WHEN 0 THEN [{'field': 'gender', 'value': 'M', 'confidence': 0e0}, {'field': 'nin', 'value': k, 'confidence': 0.75e0}]
    WHEN 1 THEN [{'field': 'first_name', 'value': 'Ada' || k, 'confidence': 0e0}]
    WHEN 2 THEN [{'field': 'nin', 'value': k, 'confidence': 0e0}, {'field': 'tracking_id', 'value': event_type, 'confidence': 0e0}]
    ELSE [{'field': NULL, 'value': NULL, 'confidence': NULL}] END) AS x FROM e)
SELECT event_id, x.field AS field, x.value AS value, x.confidence AS confidence, m <> 3 AS schema_followed FROM r"""
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from JSON answers in prose and fences."""
    out = extract.json_fields(answers(spark, sf_dir))
    return out.select("event_id", "schema_followed", F.explode_outer("fields").alias("field", "v")).select("event_id", "field", F.col("v.value").alias("value"), F.col("v.confidence").alias("confidence"), "schema_followed")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'passport' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'unknown' END AS document_type,
  CASE WHEN event_id % 3 = 2 THEN 0e0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1e0 END AS confidence FROM events"""
)
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes from JSON answers."""
    i, k = F.col("event_id") % 3, F.get_json_object("props", "$.k")
    answer = (
        F.when(i == 0, F.concat(F.lit('Type: {"documentType": " Passport ", "confidence": '), k, F.lit("}")))
        .when(i == 1, F.concat(F.lit('{"documentType": "bus pass", "confidence": "'), k, F.lit('"}')))
        .otherwise("no json here")
    )
    v = table(spark, sf_dir, "events").select("event_id", extract.answer_class(answer).alias("c"))
    return v.select("event_id", "c.document_type", "c.confidence")


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
k AS (SELECT conv_id, turn, trim(t) AS t, i, CASE WHEN i % 7 = 0 THEN -1 ELSE i * 13 % 101 END AS conf FROM w)
SELECT conv_id, turn, count(*) AS n, round_even(sum(round_even(conf / 100e0, 3)), 6) AS confidence, max(i * 10 + length(t)) AS right_edge, string_agg(t, ' ' ORDER BY i) AS joined
FROM k WHERE t <> '' AND conf >= 0 GROUP BY conv_id, turn"""
)
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of OCR words, blank and rejected words dropped."""
    c = table(spark, sf_dir, "conversations")
    words = F.transform(
        F.split("text", " "),
        lambda t, i: F.struct(t.alias("text"), F.when((i + 1) % 7 == 0, -1).otherwise((i + 1) * 13 % 101).alias("conf"), ((i + 1) * 10).alias("left"), F.lit(0).alias("top"), F.length(N.strip(t)).alias("width"), F.lit(8).alias("height")),
    )
    b = c.select("conv_id", "turn", extract.words_to_blocks(words).alias("b")).where(F.size("b") > 0)
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["confidence"])
    return b.select("conv_id", "turn", F.size("b").cast("long").alias("n"), rounded(total, 6).alias("confidence"), F.array_max(F.transform("b", lambda x: x["bbox"][2])).cast("long").alias("right_edge"), F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("joined"))


# ---------------------------------------------------------------- scoring


@query(
    f"""WITH {DATES_SQL}, c AS (SELECT *, o_orderkey % 5 AS m FROM parsed)
SELECT o_orderkey, CASE WHEN m = 1 THEN 0e0 WHEN m = 2 THEN 0e0 ELSE 1e0 END AS date_score,
  CASE WHEN m = 3 THEN 0e0 WHEN m = 4 THEN 0e0 ELSE 1e0 END AS number_score FROM c"""
)
def score_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and numbers: equal after normalization or nothing (Q1); no UDF in the plan."""
    d = dates(spark, sf_dir)
    m = F.col("o_orderkey") % 5
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = d.select("o_orderkey", F.lit("due_date").alias("f1"), iso.alias("e1"), F.when(m == 1, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")).when(m == 2, F.lit(None)).otherwise(F.col("shown")).alias("p1"),
                 F.lit("nin").alias("f2"), F.col("o_orderkey").cast("string").alias("e2"), F.when(m == 3, "").when(m == 4, F.concat(F.col("o_orderkey").cast("string"), F.lit("1"))).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" -"))).alias("p2"))
    d = score.pair_scores(d, "f1", "e1", "p1", fuzzy=False).withColumnRenamed("score", "date_score")
    return score.pair_scores(d, "f2", "e2", "p2", fuzzy=False).withColumnRenamed("score", "number_score").select("o_orderkey", "date_score", "number_score")


_LCS = """list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda r, i:
  list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, x:
    list_append(acc, CASE WHEN substr(b, x[1], 1) = substr(a, i[1], 1) THEN r[x[1]] + 1 ELSE greatest(r[x[1] + 1], acc[-1]) END), [0::BIGINT]),
  list_transform(range(length(b) + 1), lambda z: 0::BIGINT))[-1]"""


@query(
    rf"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS e, lead(p_brand || ' ' || p_name) OVER (ORDER BY p_partkey) AS q FROM part),
t AS (SELECT p_partkey, e, coalesce(q, '') AS q, upper({_sql_space('e')}) AS ne, upper({_sql_space("coalesce(q, '')")}) AS nq FROM p),
s AS (SELECT *, array_to_string(list_sort(string_split(ne, ' ')), ' ') AS a, array_to_string(list_sort(string_split(nq, ' ')), ' ') AS b FROM t)
SELECT p_partkey, CASE WHEN q = '' THEN 0e0 WHEN ne = '' THEN (nq = '')::INT::DOUBLE WHEN ne = nq THEN 1e0 ELSE round_even(2e0 * {_LCS} / (length(a) + length(b)), 3) END AS score FROM s"""
)
def score_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-sort similarity of neighbouring parts with another token order (Q1, Q2)."""
    p = table(spark, sf_dir, "part")
    # Neighbours by key, without a window over the whole table: part keys are dense.
    own = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("expected"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_brand", "p_name").alias("predicted"))
    pairs = own.join(nxt, "p_partkey", "left").withColumn("field", F.lit("occupation"))
    return score.pair_scores(pairs).select("p_partkey", "score")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 101 / 100e0 AS a, o_custkey % 101 / 100e0 AS b, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN round_even(((a >= 0.85e0)::INT + (b >= 0.85e0)::INT) / 2e0, 4) WHEN 1 THEN round_even((a >= 0.85e0)::INT / 3e0, 4)
  WHEN 2 THEN round_even((b >= 0.85e0)::INT / 3e0, 4) ELSE 0e0 END AS recall, round_even((a + b) / 2e0, 4) AS accuracy FROM o"""
)
def required_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over own or schema-required fields and mean of scores."""
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 4
    scores = F.create_map(F.lit("full_name"), F.col("o_orderkey") % 101 / 100, F.lit("nin"), F.col("o_custkey") % 101 / 100)
    own = F.when(m == 0, F.array(F.lit("full_name"), F.lit("nin"))).when(m == 1, F.array(F.lit("full_name"), F.lit("address"), F.lit("bvn")))
    kind = F.when(m == 2, "nin_slip").otherwise("other")
    return o.select("o_orderkey", score.required_recall(scores, score.required_fields(own, kind)).alias("recall"), score.field_accuracy(scores).alias("accuracy"))


@query(
    """SELECT doc_id, length(text) AS text_char_count, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'skipped: extract_text, extract_portrait' END,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'expected portrait not extracted' END], lambda x: x IS NOT NULL) AS notes FROM documents"""
)
def evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and text length of evidence rows (Q7, Q8)."""
    i = F.col("doc_id")
    asked = F.array(*map(F.lit, catalog.CAPABILITIES))
    has = F.when(i % 3 == 0, F.array(F.lit("classify"), F.lit("extract_fields"), F.lit("assess_quality"))).otherwise(asked)
    note = score.notes(score.skipped_capabilities(asked, has), i % 2 == 0, i % 5 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("text_char_count"), note.alias("notes"))


# ---------------------------------------------------------------- joins and data quality


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING_EXPECTED' END AS error_code, CASE WHEN l.doc_id IS NULL THEN 'clean' ELSE d.source END AS capture_condition,
  coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def missing_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples left-joined with their ground truth; a miss keeps its row."""
    d, t = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    miss = F.col("found").isNull()
    return d.join(t, "doc_id", "left").select("doc_id", F.when(miss, "MISSING_EXPECTED").alias("error_code"), F.when(miss, "clean").otherwise(F.col("source")).alias("capture_condition"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT conv_id, turn, CAST(i AS INTEGER) AS occurrence FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the first of each id (O1)."""
    return validate.duplicates(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(
    """WITH s AS (SELECT doc_id AS pos, CAST(doc_id // 2 AS VARCHAR) AS sample_id, source AS image_path FROM documents), i AS (SELECT DISTINCT 'src' || (page_id % 15) AS image_path FROM pages),
e AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS sample_id FROM labels),
d AS (SELECT pos, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS n FROM s)
SELECT pos, sample_id, 'duplicate sample_id: ' || sample_id AS problem FROM d WHERE n > 1
UNION ALL SELECT pos, sample_id, 'missing image for ' || sample_id || ': ' || image_path FROM s WHERE image_path NOT IN (SELECT image_path FROM i)
UNION ALL SELECT pos, sample_id, 'missing expected for ' || sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM e)"""
)
def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate ids, missing images, missing ground truth (O1)."""
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.floor(F.col("doc_id") / 2).cast("string").alias("sample_id"), F.col("source").alias("image_path"))
    i = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.col("page_id") % 15).alias("image_path"))
    return validate.dataset_problems(s, i, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id")))


@query(
    "SELECT n.n_name AS sample_id, p.candidate, p.cost_estimate FROM nation n CROSS JOIN (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}')" for p in catalog.PROVIDERS if p[0] in catalog.DEFAULT_PROVIDERS) + ") p(candidate, cost_estimate)"
)
def provider_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default providers with every sample."""
    chosen, _ = validate.select_providers(None, catalog.provider_catalog(spark))
    return validate.runs_of(chosen, table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id"))).select("sample_id", "candidate", "cost_estimate")


@query("SELECT * FROM (VALUES ('tesseract', true, NULL), ('mock', true, NULL), ('none-such', false, 'unknown provider none-such')) v(candidate, available, reason)")
def provider_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested list against the catalog."""
    chosen, rejected = validate.select_providers(" tesseract, none-such,mock ", catalog.provider_catalog(spark))
    return chosen.select("candidate", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("candidate", F.lit(False).alias("available"), "reason"))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', 'assess_quality,classify,extract_fields,extract_portrait,extract_text', '{p[2]}', '{p[3]}', '{p[1]}', {str(p[4]).lower()})" for p in catalog.PROVIDERS) + ") v(candidate, capabilities, license_name, license_status, cost_estimate, on_prem)"
)
def provider_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers with capabilities and license (O2)."""
    return validate.capability_report(catalog.provider_catalog(spark))


@query("SELECT ['passport', 'voter_id', 'bank_statement'][o_orderkey % 3 + 1] || '-' || o_orderkey AS sample_id, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def type_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a type by the prefix of their id (F1, F2)."""
    kinds = F.array(F.lit("passport"), F.lit("voter_id"), F.lit("bank_statement"))
    s = table(spark, sf_dir, "orders").select(F.concat_ws("-", F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")), F.col("o_orderkey").cast("string")).alias("sample_id"), "o_totalprice")
    return validate.samples_of_type(s, "passport")


# ---------------------------------------------------------------- images

_TILE_SQL = """t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((x::DOUBLE + 0.35e0) * 400))) AS INTEGER)) AS v FROM embeddings),
n AS (SELECT vec_id, v, list_transform(range(0, 64), lambda i:
    v[(CASE WHEN i // 8 = 0 THEN 1 ELSE i // 8 - 1 END) * 8 + i % 8 + 1] + v[(CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END) * 8 + i % 8 + 1]
    + v[(i // 8) * 8 + (CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END) + 1] + v[(i // 8) * 8 + (CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END) + 1] - 4 * v[i + 1]) AS lap FROM t),
m AS (SELECT vec_id, list_sum(list_transform(lap, lambda x: x * x)) / 64e0 - (list_sum(lap) / 64e0) * (list_sum(lap) / 64e0) AS lap,
  len(list_filter(v, lambda x: x > 245)) / 64e0 AS bright, list_sum(v) / 64e0 AS lum FROM n),
s AS (SELECT *, round_even(0.4e0 * least(lap / 300e0, 1e0) + 0.25e0 * greatest(0e0, 1 - bright / 0.15e0) + 0.2e0 * least(lum / 130e0, 1e0) + 0.15e0 * 1e0, 3) AS q,
  CASE WHEN lap < 60 THEN 'high' WHEN lap < 200 THEN 'medium' ELSE 'low' END AS blur FROM m)"""


@query(f"WITH {_TILE_SQL} SELECT vec_id, blur, CASE WHEN bright > 0.12e0 THEN 'high' WHEN bright > 0.04e0 THEN 'medium' ELSE 'low' END AS glare, blur <> 'high' AND lum >= 70 AND q > 0.45e0 AS readable, 'upright' AS orientation, q AS quality_score FROM s")
def tile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of 8 x 8 gray tiles made from vectors."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.35) * 400))).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("v"), r * 8 + 1, 8))
    t = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", rows.alias("px")).select("vec_id", image.tile_quality("px").alias("q"))
    return t.select("vec_id", "q.blur", "q.glare", "q.readable", "q.orientation", "q.quality_score")


_PIXELS = "t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((x::DOUBLE + 0.35e0) * {0}))) AS INTEGER)) AS v FROM embeddings)"
_CLAMPED = "v[greatest(0, least(7, i // 8 + ({0}))) * 8 + greatest(0, least(7, i % 8 + ({1}))) + 1]"


def _clamped(y: int, x: int) -> str:
    return _CLAMPED.format(y, x)


def _size(y: int, x: int) -> str:
    """Size of the gradient y rows down and x columns right of pixel i, 0 outside of the tile."""
    return f"(CASE WHEN i // 8 + ({y}) BETWEEN 0 AND 7 AND i % 8 + ({x}) BETWEEN 0 AND 7 THEN m[(i // 8 + ({y})) * 8 + i % 8 + ({x}) + 1] ELSE 0 END)"


_EDGE_SQL = f"""WITH RECURSIVE {_PIXELS.format(70)},
i AS (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM t),
g AS (SELECT vec_id, i, {" + ".join(f"{w} * ({_clamped(y, 1)} - {_clamped(y, -1)})" for y, w in ((-1, 1), (0, 2), (1, 1)))} AS dx,
  {" + ".join(f"{w} * ({_clamped(1, x)} - {_clamped(-1, x)})" for x, w in ((-1, 1), (0, 2), (1, 1)))} AS dy FROM i),
l AS (SELECT vec_id, list(abs(dx) + abs(dy) ORDER BY i) AS m FROM g GROUP BY vec_id),
n AS (SELECT g.vec_id, i, m, dx, dy, abs(dx) + abs(dy) AS s, abs(dy) * 32768 < abs(dx) * 13573 AS flat, abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 AS steep FROM g JOIN l USING (vec_id)),
e AS (SELECT vec_id, i, s FROM n WHERE s > 50 AND CASE WHEN flat THEN s > {_size(0, -1)} AND s >= {_size(0, 1)} WHEN steep THEN s > {_size(-1, 0)} AND s >= {_size(1, 0)}
  WHEN (dx < 0) <> (dy < 0) THEN s > {_size(-1, 1)} AND s > {_size(1, -1)} ELSE s > {_size(-1, -1)} AND s > {_size(1, 1)} END),
r AS (SELECT vec_id, i FROM e WHERE s > 150 UNION SELECT e.vec_id, e.i FROM r JOIN e ON e.vec_id = r.vec_id AND abs(e.i // 8 - r.i // 8) <= 1 AND abs(e.i % 8 - r.i % 8) <= 1)
SELECT t.vec_id, count(r.i) AS n_edges, coalesce(sum((r.i < 8)::INT + (r.i >= 56)::INT + (r.i % 8 = 0)::INT + (r.i % 8 = 7)::INT), 0) / 32e0 > 0.25e0 AS cropped FROM t LEFT JOIN r USING (vec_id) GROUP BY t.vec_id"""


def _tiles(spark: SparkSession, sf_dir: str, contrast: int) -> DataFrame:
    """8 x 8 gray tiles of the embeddings."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.35) * contrast))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8)).alias("px"))


@query(_EDGE_SQL)
def edge_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of tiles, and tiles that look cut off (I4)."""
    return image.edge_tiles(_tiles(spark, sf_dir, 70)).drop("px")


_BASIS_SQL = "b AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END) * cos((2 * x + 1) * u * pi() / 16) AS c FROM range(0, 8) a(u), range(0, 8) d(x))"


@query(
    f"""WITH {_PIXELS.format(400)}, {_BASIS_SQL}, q AS (SELECT unnest({codec.table(codec.QUALITY).ravel().tolist()}) AS s, unnest(range(0, 64)) // 8 AS u, unnest(range(0, 64)) % 8 AS w),
p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v[i + 1] - 128e0 AS v FROM (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM t)),
r AS (SELECT vec_id, y, b.u AS w, sum(v * c) AS v FROM p JOIN b ON p.x = b.x GROUP BY ALL),
f AS (SELECT vec_id, b.u, w, sum(v * c) AS v FROM r JOIN b ON r.y = b.x GROUP BY ALL),
k AS (SELECT vec_id, u, w, floor(v / s + 0.5e0 + 1e-9) * s AS v FROM f JOIN q USING (u, w)),
h AS (SELECT vec_id, b.x AS y, w, sum(v * c) AS v FROM k JOIN b ON k.u = b.u GROUP BY ALL),
o AS (SELECT vec_id, y, b.x AS x, greatest(0, least(255, floor(sum(v * c) + 128 + 0.5e0 + 1e-9))) AS v FROM h JOIN b ON h.w = b.u GROUP BY vec_id, y, b.x)
SELECT vec_id, string_agg(CAST(v AS INTEGER)::VARCHAR, ',' ORDER BY y, x) AS pixels FROM o GROUP BY vec_id"""
)
def sent_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles after the block transform of a sent image."""
    out = image.degrade_tiles(_tiles(spark, sf_dir, 400).withColumn("capture_condition", F.lit("whatsapp")))
    return out.select("vec_id", F.array_join(F.flatten("px").cast("array<string>"), ",").alias("pixels"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(greatest(0, least(255, floor((x::DOUBLE + 0.35e0) * 400))) AS INTEGER) * 0.35e0) AS INTEGER)) AS dark FROM embeddings")
def low_light_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low-light condition on pixel rows."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.35) * 400))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(image.low_light(F.array(v)), 1).alias("dark"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x, l_suppkey % 300 AS y, CAST(l_quantity AS BIGINT) AS w, CAST(l_quantity AS BIGINT) + l_linenumber AS h FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w * h DESC, l_linenumber, x, y) AS i FROM b)
SELECT l_orderkey, [x, y, x + w, y + h] AS bbox, round_even(0.6e0 * least(w / 250e0, 1e0) + 0.4e0 * least(w * h / 640000e0 / 0.1e0, 1e0), 3) AS quality_score,
  round_even(0.5e0 + 0.5e0 * round_even(0.6e0 * least(w / 250e0, 1e0) + 0.4e0 * least(w * h / 640000e0 / 0.1e0, 1e0), 3), 3) AS confidence FROM p WHERE i = 1"""
)
def portrait_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest face box and its quality."""
    li = table(spark, sf_dir, "lineitem")
    w = F.col("l_quantity").cast("long")
    box = F.struct("l_linenumber", (F.col("l_partkey") % 500).alias("x"), (F.col("l_suppkey") % 300).alias("y"), w.alias("w"), (w + F.col("l_linenumber")).alias("h"))
    boxes = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes")).withColumn("bbox", image.pick_portrait("boxes"))
    wide, high = F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1]
    return boxes.select("l_orderkey", "bbox", image.portrait_quality(wide.cast("double"), wide * high / 640000).alias("q")).select("l_orderkey", "bbox", "q.quality_score", "q.confidence")


@query("SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS url FROM pages")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content as data URLs."""
    return table(spark, sf_dir, "pages").select("page_id", io.data_url(F.col("html").cast("binary"), F.lit("text/html")).alias("url"))


# ---------------------------------------------------------------- whole runs


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic samples, as many of each type as there are nations."""
    return generate.dataset(spark, per_type=table(spark, sf_dir, "nation").count(), today=date(2026, 1, 1))


@query(
    "WITH t(t) AS (VALUES " + ", ".join(f"('{t}')" for t in catalog.SCHEMAS) + "), c(c) AS (VALUES " + ", ".join(f"('{c}')" for c in generate.DEFAULT_CONDITIONS)
    + "), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS i FROM nation) SELECT t || '-' || lpad(i, 2, '0') || '-' || c AS sample_id, t AS document_type, 'samples/' || t || '-' || lpad(i, 2, '0') || '-' || c || '.jpg' AS image_path, c AS capture_condition FROM t CROSS JOIN c CROSS JOIN n"
)
def synthetic_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of generated samples."""
    return _generated(spark, sf_dir).select("sample_id", "document_type", "image_path", "capture_condition")


@query()
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated samples through three providers, scored (S13-S16, E3-E5, J1-J8, Q1-Q9); generated_values and rendered_texts check what goes in."""
    path = io.scratch(spark, "generated")
    _generated(spark, sf_dir).write.parquet(path)
    s = spark.read.parquet(path)
    out = benchmark.run(s, s, {"mock": providers.mock, "tesseract": providers.plain, "paddleocr-vl": providers.labelled})
    return out.select("candidate", "sample_id", "document_type", "capture_condition", "classification_correct", "field_accuracy", "required_field_recall", "schema_followed", "portrait_expected", "text_char_count", "error_code")


@query("SELECT event_type AS candidate, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY event_type")
def streaming_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence read as a stream, appended as it comes, and summed from what was appended."""
    base = io.scratch(spark, "stream")
    src = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    live = spark.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.startswith("/") or Path(path).is_dir() else f"{sf_dir}/events.parq*")
    rows = live.select(F.col("event_type").alias("candidate"), F.col("event_id").alias("sample_id"), F.when(F.col("event_id") % 20 == 0, "INVALID_IMAGE").alias("error_code"))
    stream.append(rows, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    done = spark.read.schema("candidate string, sampleId long, errorCode string").json(f"{base}/out")
    return done.groupBy("candidate").agg(F.count("*").alias("n"), F.count("errorCode").alias("errors"))


@query(f"WITH {_SUMMARY} SELECT * FROM scored")
def streaming_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary kept up with evidence that arrives in several micro-batches (A1-A11 over S8)."""
    base = io.scratch(spark, "running")
    evidence(spark, sf_dir).repartition(6).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(evidence(spark, sf_dir).schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    live.keep(live.running(rows), f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return live.latest(spark, f"{base}/out").drop("closed")


# ---------------------------------------------------------------- runs over the tables

_RUN_SQL = """
s AS (SELECT CAST(d.doc_id // 2 AS VARCHAR) AS sample_id, d.doc_id, source AS image_path, CASE WHEN doc_id % 3 = 0 THEN 'passport' ELSE 'nin_slip' END AS document_type,
    CASE WHEN doc_id % 2 = 0 THEN 'glare' ELSE 'mobile' END AS capture_condition FROM documents d),
i AS (SELECT DISTINCT 'src' || (page_id % 15) AS image_path FROM pages),
e AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, max(doc_id % 4) AS m FROM labels GROUP BY doc_id),
r AS (SELECT s.*, e.sample_id IS NULL AS missing, e.sample_id IS NOT NULL AND s.image_path NOT IN (SELECT image_path FROM i) AS bad, m FROM s LEFT JOIN e USING (sample_id))"""


def _table_run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """A run of two candidates over samples with repeated ids, missing images and missing ground truth."""
    i = F.col("doc_id")
    samples = table(spark, sf_dir, "documents").select(
        F.floor(i / 2).cast("string").alias("sample_id"), F.when(i % 3 == 0, "passport").otherwise("nin_slip").alias("document_type"), F.col("source").alias("image_path"), F.when(i % 2 == 0, "glare").otherwise("mobile").alias("capture_condition")
    )
    images = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.col("page_id") % 15).alias("image_path"))
    m = i % 4
    said = F.when(m == 0, "MOCK VALUE").when(m == 1, "value mock").when(m == 2, "").otherwise("nothing")
    truth = table(spark, sf_dir, "labels").select(
        i.cast("string").alias("sample_id"), F.create_map(F.lit("surname"), said, F.lit("tracking_id"), said).alias("fields"), F.when(m < 2, F.array(F.lit("surname"), F.lit("nin"))).otherwise(F.array().cast("array<string>")).alias("required_fields"), (m != 3).alias("portrait_present")
    )
    return benchmark.run(samples, truth, {"zeta": providers.mock, "mock": providers.mock}, images=images, created_at="2026-01-01T00:00:00+00:00", **more)


#: The mock's only field is tracking_id for nin_slip and surname for passport; similarity of VALUE MOCK and NOTHING is fixed by their letters.
_FIELD_SCORE = "CASE WHEN k = 'number' THEN (m = 0)::INT::DOUBLE ELSE CASE m WHEN 0 THEN 1e0 WHEN 1 THEN {swap}e0 WHEN 2 THEN 0e0 ELSE {other}e0 END END"


@query(
    f"""WITH {_RUN_SQL}, k AS (SELECT *, CASE WHEN document_type = 'passport' THEN 'name' ELSE 'number' END AS k FROM r),
f AS (SELECT *, {_FIELD_SCORE.format(swap="1", other="0.118")} AS one FROM k),
c AS (SELECT * FROM (VALUES ('zeta', 0, 'medium', 'needs_review'), ('mock', 1, 'low', 'approved')) v(candidate, ordinal, cost_estimate, license_status))
SELECT candidate, CAST(ordinal AS INTEGER) AS ordinal, sample_id, document_type, CASE WHEN missing THEN 'clean' ELSE capture_condition END AS capture_condition,
  CASE WHEN missing THEN 'MISSING_EXPECTED' WHEN bad THEN 'INVALID_IMAGE' END AS error_code, CASE WHEN NOT missing AND NOT bad THEN document_type = 'nin_slip' END AS classification_correct,
  CASE WHEN missing OR bad THEN 0e0 ELSE round_even(one / 2, 4) END AS field_accuracy, CASE WHEN missing OR bad THEN 0e0 WHEN document_type = 'passport' AND m < 2 THEN round_even((one >= 0.85e0)::INT / 2e0, 4) ELSE 0e0 END AS required_field_recall,
  NOT missing AND NOT bad AS schema_followed, NOT missing AND NOT bad AND m <> 3 AS portrait_expected, false AS portrait_extracted, CASE WHEN missing OR bad THEN 0 ELSE 9 END AS text_char_count,
  CASE WHEN NOT missing AND NOT bad AND m <> 3 THEN ['expected portrait not extracted'] ELSE []::VARCHAR[] END AS notes, cost_estimate, license_status, '2026-01-01T00:00:00+00:00' AS created_at
FROM f CROSS JOIN c"""
)
def table_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a run with repeated sample ids, invalid images and missing ground truth."""
    return _table_run(spark, sf_dir).select(
        "candidate", "ordinal", "sample_id", "document_type", "capture_condition", "error_code", "classification_correct", "field_accuracy", "required_field_recall", "schema_followed",
        "portrait_expected", "portrait_extracted", "text_char_count", "notes", "cost_estimate", "license_status", "created_at",
    )


@query(
    f"""WITH {_RUN_SQL} SELECT c AS candidate, sample_id, document_type, CASE WHEN missing OR bad THEN []::VARCHAR[]
  WHEN m <> 3 THEN [CASE c WHEN 'mock' THEN 'skipped: extract_text' ELSE 'skipped: classify, extract_portrait' END, 'expected portrait not extracted'] ELSE [CASE c WHEN 'mock' THEN 'skipped: extract_text' ELSE 'skipped: classify, extract_portrait' END] END AS notes,
  CASE WHEN c = 'mock' AND NOT missing AND NOT bad THEN document_type = 'nin_slip' END AS classification_correct, CASE WHEN c = 'zeta' AND NOT missing AND NOT bad THEN 9 ELSE 0 END AS text_char_count
FROM r CROSS JOIN (VALUES ('zeta'), ('mock')) v(c)"""
)
def skipped_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose candidates lack operations."""
    can = {"zeta": ["extract_text", "extract_fields", "assess_quality"], "mock": ["classify", "extract_fields", "extract_portrait", "assess_quality"]}
    return _table_run(spark, sf_dir, capabilities=can).select("candidate", "sample_id", "document_type", "notes", "classification_correct", "text_char_count")


@query(
    f"""WITH {_RUN_SQL}, n AS (SELECT count(*) AS n FROM r) SELECT candidate, CAST(rank AS INTEGER) AS rank, n FROM n CROSS JOIN (VALUES ('zeta', 1), ('alpha', 2), ('mid', 3)) v(candidate, rank)"""
)
def rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with equal scores keep their order in the run, whatever their names."""
    one = _table_run(spark, sf_dir).where("candidate = 'zeta'").drop("candidate", "ordinal")
    names = spark.createDataFrame([("mid", 2), ("zeta", 0), ("alpha", 1)], "candidate string, ordinal int")
    return report.rank(report.summarize(one.crossJoin(F.broadcast(names)))).select("candidate", "rank", "n")


_KEYWORD_TEXT = "CASE p_partkey % 5 WHEN 0 THEN 'Nigeria NIN SLIP by NIMC ' WHEN 1 THEN 'driver: statement of account ' WHEN 2 THEN 'ACCOUNT OPENING mandate, BVN ' WHEN 3 THEN 'electricity bill, national id ' ELSE '' END || p_name"


@query(
    f"WITH t AS (SELECT p_partkey, lower({_KEYWORD_TEXT}) AS t FROM part), h AS (SELECT p_partkey, "
    + ", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + f") AS {k}" for k, words in catalog.KEYWORDS.items())
    + " FROM t), b AS (SELECT *, greatest(" + ", ".join(catalog.KEYWORDS) + ") AS hits FROM h) SELECT p_partkey, CASE WHEN hits = 0 THEN 'unknown' "
    + " ".join(f"WHEN {k} = hits THEN '{k}'" for k in catalog.KEYWORDS)
    + " END AS document_type, CAST(hits AS INTEGER) AS hits, CASE WHEN hits > 0 THEN least(0.4e0 + 0.2e0 * hits, 0.9e0) ELSE 0e0 END AS confidence FROM b"
)
def keyword_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword classifier with the catalog's own keywords."""
    v = table(spark, sf_dir, "part").select("p_partkey", extract.keyword_class(F.expr(_KEYWORD_TEXT)).alias("c"))
    return v.select("p_partkey", "c.document_type", "c.hits", "c.confidence")


@query(
    """WITH e AS (SELECT event_id, event_id % 10 AS m, json_extract_string(props, '$.k') AS k FROM events),
r AS (SELECT event_id, m, unnest(CASE m
    WHEN 0 THEN [{'field': 'nin', 'value': '9' || k, 'confidence': 0e0}, {'field': 'surname', 'value': 'A', 'confidence': 0e0}]
    WHEN 1 THEN [{'field': 'surname', 'value': '{' || k, 'confidence': 0e0}, {'field': 'nin', 'value': 'x', 'confidence': 0.5e0}]
    WHEN 2 THEN [{'field': 'tracking_id', 'value': k, 'confidence': 0e0}]
    WHEN 3 THEN [{'field': 'address', 'value': '{"value":"' || k || '"}', 'confidence': 0e0}]
    WHEN 4 THEN [{'field': 'nin', 'value': k, 'confidence': 0.25e0}]
    WHEN 6 THEN [{'field': 'surname', 'value': k, 'confidence': 0e0}, {'field': 'address', 'value': '{"value":"' || k || '"}', 'confidence': 0e0}]
    WHEN 7 THEN [{'field': 'surname', 'value': '{"value":"' || k || '"}', 'confidence': 0e0}]
    WHEN 8 THEN [{'field': 'surname', 'value': '{"value":"a/' || k || '"}', 'confidence': 0e0}]
    WHEN 9 THEN [{'field': 'surname', 'value': k || '.5', 'confidence': 0e0}, {'field': 'nin', 'value': 'true', 'confidence': 0.125e0}]
    ELSE [{'field': NULL, 'value': NULL, 'confidence': NULL}] END) AS x FROM e)
SELECT event_id, x.field AS field, x.value AS value, x.confidence AS confidence, m <> 5 AS schema_followed FROM r"""
)
def json_oddities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys, texts that look like objects, numbers, NaN, and text after the object in JSON answers."""
    e = table(spark, sf_dir, "events")
    m, k = F.col("event_id") % 10, F.get_json_object("props", "$.k")
    answer = (
        F.when(m == 0, F.concat(F.lit('{"nin":"1","surname":"A","nin":"9'), k, F.lit('"}')))
        .when(m == 1, F.concat(F.lit('{"surname": "{'), k, F.lit('", "nin": {"value": "x", "confidence": 0.5}}')))
        .when(m == 2, F.concat(F.lit('{"tracking": "'), k, F.lit('", "extra": NaN, "other": -Infinity}')))
        .when(m == 3, F.concat(F.lit('{"address": "{\\"value\\":\\"'), k, F.lit('\\"}"}')))
        .when(m == 4, F.concat(F.lit('{"nin": {"value": "0", "value": "'), k, F.lit('", "confidence": 0.25}}')))
        .when(m == 6, F.concat(F.lit('{"surname": {"value":"'), k, F.lit('"}, "address": "{\\"value\\":\\"'), k, F.lit('\\"}"}')))
        .when(m == 7, F.concat(F.lit('{"surname": "\\u007b\\"value\\":\\"'), k, F.lit('\\"\\u007d"}')))
        .when(m == 8, F.concat(F.lit('{"surname": "{\\"value\\":\\"a\\/'), k, F.lit('\\"}"}')))
        .when(m == 9, F.concat(F.lit('{"surname": '), k, F.lit('.50, "nin": {"value": true, "confidence": "0.125"}, "address": {"value": null}}')))
        .otherwise(F.concat(F.lit('{"nin": "'), k, F.lit('"} and {"surname": "B"}')))
    )
    out = extract.json_fields(e.select("event_id", F.lit("nin_slip").alias("document_type"), answer.alias("answer")))
    return out.select("event_id", "schema_followed", F.explode_outer("fields").alias("field", "v")).select("event_id", "field", F.col("v.value").alias("value"), F.col("v.confidence").alias("confidence"), "schema_followed")


# ---------------------------------------------------------------- files written and read back


@query(
    f"""WITH {EVIDENCE_SQL} SELECT candidate, CAST(sample_id AS VARCHAR) AS sample_id, document_type, capture_condition, field_accuracy, required_field_recall, classification_correct, schema_followed, latency_ms, gpu_memory_mb, error, error_code,
  0 AS text_char_count, 'needs_review' AS license_status FROM ev"""
)
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as JSON lines and read back, missing keys with their defaults."""
    path = io.scratch(spark, "evidence")
    io.write_jsonl(evidence(spark, sf_dir).withColumn("sample_id", F.col("sample_id").cast("string")).drop("license_status"), path)
    return io.read_evidence(spark, path, multi_line=False).select("candidate", "sample_id", "document_type", "capture_condition", "field_accuracy", "required_field_recall", "classification_correct", "schema_followed", "latency_ms", "gpu_memory_mb", "error", "error_code", "text_char_count", "license_status")


@query(
    f"""WITH {EVIDENCE_SQL} SELECT candidate, CAST(sample_id AS VARCHAR) AS sample_id, document_type, field_accuracy, classification_correct, portrait_quality_score, latency_ms, gpu_memory_mb, license_status, on_prem, error, error_code FROM ev"""
)
def evidence_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as one JSON array by its tasks, and read back."""
    path = f"{io.scratch(spark, 'array')}/results.json"
    io.write_array(evidence(spark, sf_dir).withColumn("sample_id", F.col("sample_id").cast("string")).hint("rebalance"), path)
    return io.read_evidence(spark, path).select("candidate", "sample_id", "document_type", "field_accuracy", "classification_correct", "portrait_quality_score", "latency_ms", "gpu_memory_mb", "license_status", "on_prem", "error", "error_code")


@query(
    """SELECT 's' || s_suppkey AS sample_id, 'glare' AS capture_condition, s_suppkey % 5 <> 0 AS has_expected, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS full_name, CASE WHEN s_suppkey % 5 <> 0 THEN 1 END AS required
FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 AND s_suppkey <> 3"""
)
def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a manifest with the ground truth of those that a filter asks for."""
    s, base = table(spark, sf_dir, "supplier"), io.scratch(spark, "dataset")
    k = F.col("s_suppkey")
    sample = F.struct(F.concat(F.lit("s"), k).alias("sample_id"), F.when(k % 3 == 0, "passport").otherwise("nin_slip").alias("document_type"), F.concat(F.lit("samples/"), k, F.lit(".jpg")).alias("image_path"), F.when(k % 2 == 1, "glare").alias("capture_condition"))
    s.agg(F.lit("suppliers").alias("name"), F.array_sort(F.collect_list(sample)).alias("samples")).coalesce(1).write.json(f"{base}/manifest")
    name = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{base}/manifest").select("path").first().path
    truth = s.where(k % 5 != 0).select(F.concat(F.lit("s"), k).alias("sample_id"), F.create_map(F.lit("full_name"), "s_name").alias("fields"), F.array(F.lit("full_name")).alias("required_fields"))
    formats.write_expected(truth, f"{base}/expected")
    got = formats.read_samples(spark, name, f"{base}/expected").where("document_type = 'passport' AND capture_condition IN ('glare', 'low_light')").where("sample_id <> 's3'")
    return got.select("sample_id", "capture_condition", "has_expected", F.col("fields")["full_name"].alias("full_name"), F.size("required_fields").alias("required"))


@query(
    """SELECT r_name AS manifest_name, n_name AS sample_id, 'passport' AS document_type, 'samples/' || n_nationkey || '.jpg' AS image_path, CASE WHEN n_nationkey % 2 = 0 THEN 'glare' ELSE 'clean' END AS capture_condition,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written as JSON and scanned, one a region (S1); absent conditions are clean."""
    n, r, path = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), io.scratch(spark, "manifests")
    sample = F.struct("n_nationkey", F.struct(F.col("n_name").alias("sample_id"), F.lit("passport").alias("document_type"), F.concat(F.lit("samples/"), "n_nationkey", F.lit(".jpg")).alias("image_path"), F.when(F.col("n_nationkey") % 2 == 0, "glare").alias("capture_condition")).alias("s"))
    m = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(sample)), lambda x: x["s"]).alias("samples"))
    m.write.option("maxRecordsPerFile", 1).json(path)  # a manifest is a file
    return io.read_manifest(spark, path).select("manifest_name", "sample_id", "document_type", "image_path", "capture_condition", "pos")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name || chr(10) AS content, 'image/jpeg' AS mime, CAST(length(n_name) + 1 AS BIGINT) AS bytes, 'data:image/jpeg;base64,' || to_base64(encode(n_name || chr(10))) AS url FROM nation")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written one a nation and scanned as images."""
    path = io.scratch(spark, "images")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    i = io.read_images(spark, path, path)
    key = F.regexp_extract("image_path", "n_nationkey=([0-9]+)/[^/]*$", 1).cast("int")
    return i.select(key.alias("n_nationkey"), F.decode("content", "utf-8").alias("content"), "mime", "bytes", io.data_url().alias("url"))


@query("SELECT n_name AS sample_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS VARCHAR) END AS number, CASE WHEN n_nationkey % 3 = 0 THEN 'extract_fields: KeyError: ''gone''' END AS error, CASE WHEN n_nationkey % 3 = 0 THEN 'PROVIDER_PARTIAL_FAILURE' END AS error_code, ['extract_portrait'] AS skipped FROM nation")
def operation_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation that fails costs its own result only (Q9)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("sample_id"), "n_nationkey")
    ops = {"classify": lambda r: r["sample_id"], "extract_fields": lambda r: r["n_nationkey"] if r["n_nationkey"] % 3 else {}["gone"], "extract_portrait": None}
    out = providers.analyze(n, ops)
    return out.select("sample_id", F.try_element_at("results", F.lit("extract_fields")).alias("number"), "error", "error_code", "skipped")


_SHOWN = "coalesce(format('{{:.3f}}', {0}::DOUBLE), '—')"
_RANKING_SQL = " || ' | ' || ".join(_SHOWN.format(c) for c in [*report.RANKING.values()][:8])
_SPREAD_SQL = """
h{0} AS (SELECT DISTINCT {1} AS k FROM ev),
c{0} AS (SELECT candidate, {1} AS k, round_even(avg(field_accuracy), 4) AS v FROM ev GROUP BY ALL),
s{0} AS (SELECT rank, candidate, string_agg(coalesce(format('{{:.3f}}', v), '—'), ' | ' ORDER BY k) AS cells FROM ranked CROSS JOIN h{0} LEFT JOIN c{0} USING (candidate, k) GROUP BY ALL)"""


@query(
    f"""WITH {_SUMMARY},{_SPREAD_SQL.format(1, "document_type")},{_SPREAD_SQL.format(2, "capture_condition")}
SELECT 'Candidates by composite score' AS section, 0 AS pos, '|  | Candidate | {" | ".join(report.RANKING)} |' AS line
UNION ALL SELECT 'Candidates by composite score', rank + 1, '| ' || rank || ' | ' || candidate || ' | ' || {_RANKING_SQL} || ' | ' || cost_estimate || ' | ' || license_status || ' |' FROM ranked
UNION ALL SELECT 'Accuracy by document type', 0, '| Candidate | ' || string_agg(k, ' | ' ORDER BY k) || ' |' FROM h1
UNION ALL SELECT 'Accuracy by document type', rank + 1, '| ' || candidate || ' | ' || cells || ' |' FROM s1
UNION ALL SELECT 'Accuracy by capture condition', 0, '| Candidate | ' || string_agg(k, ' | ' ORDER BY k) || ' |' FROM h2
UNION ALL SELECT 'Accuracy by capture condition', rank + 1, '| ' || candidate || ' | ' || cells || ' |' FROM s2
UNION ALL SELECT 'short', 0, '| Candidate | Total | Fields | Median ms |'
UNION ALL SELECT 'short', rank + 1, '| ' || candidate || ' | ' || format('{{:.3f}}', composite_score) || ' | ' || format('{{:.3f}}', field_accuracy) || ' | ' || format('{{:.0f}}', latency_p50_ms) || ' |' FROM ranked"""
)
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report's ranking, of accuracy by type and condition, and of the short ranking."""
    summary = report.build_summary(evidence(spark, sf_dir))
    parts = dict(p.split("\n", 1) for p in report.markdown(summary).split("\n## ")[1:])
    parts = {k: parts[k] for k in ("Candidates by composite score", "Accuracy by document type", "Accuracy by capture condition")} | {"short": report.quick_ranking(summary)}
    lines = {k: [x for x in text.split("\n") if x.startswith("|") and not x.startswith("| :--")] for k, text in parts.items()}
    return spark.createDataFrame([(k, i if i == 0 else i + 1, x) for k, xs in lines.items() for i, x in enumerate(xs)], "section string, pos int, line string")


@query(
    """SELECT n_name AS model, n_nationkey < 5 AS ok, CASE WHEN n_nationkey >= 10 THEN 'endpoint not reachable: ConnectionError'
  WHEN n_nationkey >= 5 THEN 'model ''' || n_name || ''' is not served (served: ' || (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 5) || ')' END AS reason FROM nation"""
)
def endpoint_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that serve a model, lack it, or do not answer (O3); one driver call an endpoint."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # nation has 25 rows at every size

    def gone() -> list[str]:
        raise ConnectionError

    seen = [(m, *providers.probe(gone if i >= 10 else lambda: names[:5], m)) for i, m in enumerate(names)]
    return spark.createDataFrame(seen, "model string, ok boolean, reason string")


@query("SELECT CAST(NULL AS VARCHAR) AS default_provider, 'No results.' AS rationale")
def no_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recommendation from no evidence."""
    return report.cost_tiebreak(report.rank(report.summarize(evidence(spark, sf_dir).where("candidate = 'none'"))))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{', '.join(f)}')" for t, f in catalog.SCHEMAS.items()) + ") v(document_type, prompt)"
)
def field_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a model is asked for, by document type."""
    return spark.createDataFrame([(t, extract.field_prompt(t)) for t in catalog.SCHEMAS], "document_type string, prompt string")


from tallyform.plans import runs  # noqa: E402, F401  more queries, which register themselves
