"""Queries over runs of providers: isolated batches, endpoints, run health and images that do not open."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyform.operators import benchmark, extract, image, report
from tallyform.plans import catalog
from tallyform.plans.inputs import evidence, table
from tallyform.plans.registry import ORACLES, query
from tallyform.sources import generate, io, providers


@query(
    """SELECT doc_id, CASE WHEN doc_id % 97 <> 5 THEN CAST(length(coalesce(text, '')) AS VARCHAR) END AS size, CAST(doc_id % 7 AS VARCHAR) AS class,
  CASE WHEN doc_id % 97 = 5 THEN 'extract_text: ValueError: document ' || doc_id END AS error, CASE WHEN doc_id % 97 = 5 THEN 'PROVIDER_PARTIAL_FAILURE' END AS error_code, ['extract_portrait'] AS skipped FROM documents"""
)
def batch_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on whole batches of documents, a failing row of which costs its own result only (Q9)."""

    def sizes(batch) -> list[int]:
        for i in batch.column("doc_id").to_pylist():
            if i % 97 == 5:
                raise ValueError(f"document {i}")
        return [len(t or "") for t in batch.column("text").to_pylist()]

    out = providers.analyze_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), {"extract_text": sizes, "classify": lambda b: [i % 7 for i in b.column("doc_id").to_pylist()], "extract_portrait": None})
    return out.select("doc_id", F.try_element_at("results", F.lit("extract_text")).alias("size"), F.try_element_at("results", F.lit("classify")).alias("class"), "error", "error_code", "skipped")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE CAST(strlen(coalesce(text, '')) AS VARCHAR) END AS nin, doc_id % 10 <> 3 AS schema_followed,
  CASE WHEN doc_id % 10 = 3 THEN 'extract_fields: ConnectionError' END AS error, CASE WHEN doc_id % 10 = 3 THEN 'PROVIDER_PARTIAL_FAILURE' END AS error_code FROM documents"""
)
def asked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an endpoint that is asked with several calls under way, and their fields."""

    def chat(system: str, user: str, content: bytes) -> str:
        if content.startswith(b"3"):
            raise ConnectionError
        return f'Fields: {{"NIN": {len(content) - 1}}}'

    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.lit("nin_slip").alias("document_type"), F.concat(F.right(F.col("doc_id").cast("string"), F.lit(1)), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    out = extract.json_fields(providers.ask(s, chat))
    return out.select("doc_id", F.try_element_at("fields", F.lit("nin"))["value"].alias("nin"), "schema_followed", "error", "error_code")


@query(ORACLES["run_health"])
def watched_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run health taken along while the evidence is written."""
    rows = evidence(spark, sf_dir)
    watch = report.HealthWatch(rows, ["click", "error", "purchase", "signup", "view"])
    io.write_jsonl(watch.rows.withColumn("sample_id", F.col("sample_id").cast("string")), io.scratch(spark, "watched"))
    return watch.health()


@query(
    """WITH e AS (SELECT s_name AS model, s_suppkey, s_nationkey, list(s_name) FILTER (WHERE s_suppkey % 2 = 0) OVER (PARTITION BY s_nationkey) AS served FROM supplier)
SELECT model, s_nationkey % 5 <> 0 AND s_suppkey % 2 = 0 AS ok, CASE WHEN s_nationkey % 5 = 0 THEN 'endpoint not reachable: ConnectionError'
  WHEN s_suppkey % 2 <> 0 THEN 'model ' || chr(39) || model || chr(39) || ' is not served (served: ' || coalesce(array_to_string(list_sort(served), ', '), 'none') || ')' END AS reason FROM e"""
)
def endpoint_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints asked from the tasks: those that serve a model, lack it, or do not answer (O3)."""
    s = table(spark, sf_dir, "supplier")
    served = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))).alias("served"))

    def list_models(row: dict) -> list[str]:
        if row["s_nationkey"] % 5 == 0:
            raise ConnectionError
        return list(row["served"])

    out = providers.probe_endpoints(s.select(F.col("s_name").alias("model"), "s_nationkey").join(served, "s_nationkey"), list_models)
    return out.select("model", "ok", "reason")


@query(
    """WITH i AS (SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'ValueError' WHEN html IS NULL OR html = '' THEN 'EOFError' END AS fault FROM pages)
SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, CASE WHEN i.page_id IS NULL THEN 'image load failed: FileNotFoundError' WHEN fault IS NOT NULL THEN 'image load failed: ' || fault END AS error,
  CASE WHEN i.page_id IS NULL OR fault IS NOT NULL THEN 'INVALID_IMAGE' END AS error_code, i.page_id IS NOT NULL AND fault IS NULL AS classification_known
FROM documents d LEFT JOIN i ON d.doc_id // 2 = i.page_id"""
)
def broken_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which some images are missing and some do not decode."""

    def decode(raw: bytes) -> list[int]:
        if not raw:
            raise EOFError
        if raw.startswith(b"bad"):
            raise ValueError("no image")
        return list(raw[:4])

    i = F.col("doc_id")
    samples = table(spark, sf_dir, "documents").select(i.cast("string").alias("sample_id"), F.lit("nin_slip").alias("document_type"), F.floor(i / 2).cast("string").alias("image_path"), F.lit("clean").alias("capture_condition"))
    raw = F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("bad"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    images = image.with_image_error(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("image_path"), raw.cast("binary").alias("content")), decode)
    truth = samples.select("sample_id", F.create_map(F.lit("nin"), F.lit("1")).alias("fields"), F.array().cast("array<string>").alias("required_fields"), F.lit(False).alias("portrait_present"))
    out = benchmark.run(samples, truth, {"mock": providers.mock}, images=images)
    return out.select("sample_id", "error", "error_code", F.col("classification_correct").isNotNull().alias("classification_known"))


# ---------------------------------------------------------------- generated values


class _DrawsSql:
    """The generator's draws in SQL; a column `seed` is at hand."""

    def below(self, salt: str, n: int) -> str:
        return f"(('0x' || substr(md5(seed || '|{salt}'), 1, 15))::BIGINT % {n})"

    def pick(self, salt: str, options: list[str]) -> str:
        return f"{options}[{self.below(salt, len(options))} + 1]"

    def digits(self, salt: str, n: int) -> str:
        if n > 15:
            return f"{self.digits(salt + '.1', 15)} || {self.digits(salt + '.2', n - 15)}"
        return f"lpad({self.below(salt, 10**n)}::VARCHAR, {n}, '0')"

    def days(self, start: str, sign: str, n: str) -> str:
        return f"(DATE '{start}' {sign} CAST({n} AS INTEGER))::VARCHAR"

    def field(self, field: str, kind: str, today: str = "2026-01-01") -> str:
        g = generate
        money = {"amount_due": (2000, 45000), "opening_balance": (0, 999999), "closing_balance": (0, 999999)}
        past, future = {"issue_date": 5, "registration_date": 5, "incorporation_date": 10}, {"due_date": (0, 1), "expiry_date": (1, 8)}
        lead = {"passport_number": (self.pick("p", list("ABCN")), 8), "registration_number": ("'RC'", 7), "phone_number": ("'0'", 10), "tracking_id": (f"{self.pick('t1', g.LETTERS)} || {self.pick('t2', g.LETTERS)}", 8)}
        lead["drivers_license_number"] = f"upper(substr({self.pick('surname', g.SURNAME)}, 1, 3))", 8
        if field in g.DIGITS:
            return self.digits(field, 19 if (field, kind) == ("document_number", "voter_id") else g.DIGITS[field])
        if field in g.OPTIONS:
            return self.pick(field, g.OPTIONS[field])
        if field in money:
            low, high = money[field]
            return f"'N' || format('{{:,}}', {low} + {self.below(field, high - low + 1)}) || '.00'"
        if field in past:
            return self.days(today, "-", f"30 + {self.below(field, 365 * past[field] - 29)}")
        if field in future:
            low, high = future[field]
            return self.days(today, "+", f"365 * ({low} + {self.below(field, high - low + 1)})")
        if field in lead:
            return f"{lead[field][0]} || {self.digits(field, lead[field][1])}"
        bank = self.pick(field, g.BANKS) if kind == "bank_statement" else "'Passport Office'" if kind == "passport" else "'Electric Company'"
        return {
            "full_name": " || ' ' || ".join(self.pick(f, g.OPTIONS[f]) for f in ("first_name", "middle_name", "surname")),
            "date_of_birth": self.days("1965-01-01", "+", self.below(field, 365 * 45 + 1)),
            "address": f"{self.pick('street', g.STREETS)} || ', ' || {self.pick('city', g.CITIES)}",
            "nationality": "'NIGERIAN'" if kind == "passport" else "'Nigerian'",
            "height": f"(150 + {self.below(field, 46)}) || 'cm'",
            "company_name": f"{self.pick('c1', g.COMPANY)} || ' ' || {self.pick('c2', g.TRADE)}",
            "issuing_authority": bank,
        }[field]


def _values_sql() -> str:
    """(document_type, number, field, value) of as many documents of each type as there are suppliers."""
    n = "(SELECT count(*) FROM supplier)"
    parts = [
        f"SELECT '{k}' AS document_type, number, unnest({list(fields)}) AS field, unnest([{', '.join(_DrawsSql().field(f, k) for f in fields)}]) AS value FROM (SELECT number, CAST(1001 + {t} * {n} + number AS VARCHAR) AS seed FROM s)"
        for t, (k, fields) in enumerate(catalog.SCHEMAS.items())
    ]
    return f"s AS (SELECT row_number() OVER () - 1 AS number FROM supplier), g AS ({' UNION ALL '.join(parts)})"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.base_documents(spark, per_type=table(spark, sf_dir, "supplier").count(), today=date(2026, 1, 1))


@query(f"WITH {_values_sql()} SELECT * FROM g")
def generated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values of generated documents, as many of each type as there are suppliers."""
    return _documents(spark, sf_dir).select("document_type", "number", F.explode("fields").alias("field", "value"))


def _text_sql() -> str:
    labels = " UNION ALL ".join(f"SELECT '{f}' AS field, '{label}' AS label, {i} AS pos" for i, (f, label) in enumerate(generate.PRINTED.items()))
    titles = " UNION ALL ".join("SELECT '{}' AS document_type, '{}' AS title".format(k, generate.TITLES[k].replace("'", "''").replace("\n", "' || chr(10) || '")) for k in catalog.SCHEMAS)
    both = [k for k, f in catalog.SCHEMAS.items() if "surname" in f and "first_name" in f]
    return f"""WITH {_values_sql()}, l AS ({labels}), t AS ({titles})
SELECT document_type, number, any_value(title) || chr(10) || string_agg(label || ': ' || value, chr(10) ORDER BY pos) || chr(10) || 'SPECIMEN - NOT A REAL DOCUMENT' AS text
FROM g JOIN l USING (field) JOIN t USING (document_type) WHERE NOT (field = 'full_name' AND document_type IN {tuple(both)}) GROUP BY document_type, number"""


@query(_text_sql())
def rendered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed texts of generated documents."""
    return _documents(spark, sf_dir).select("document_type", "number", "text")


# ---------------------------------------------------------------- every column of an evidence row


@query(
    """WITH s AS (SELECT doc_id AS i, doc_id % 11 <> 7 AS ok, coalesce(length(text), 0) AS n FROM documents)
SELECT CAST(i AS VARCHAR) AS sample_id, CASE WHEN ok THEN CASE WHEN i % 3 = 0 THEN 1e0 ELSE 0e0 END END AS nin_score, CASE WHEN ok THEN (i % 8) / 8e0 ELSE 0e0 END AS classification_confidence,
  ok AND i % 2 = 0 AS portrait_expected, ok AND i % 4 = 0 AS portrait_extracted, CASE WHEN ok THEN (i % 5) / 4e0 ELSE 0e0 END AS portrait_quality_score, CASE WHEN ok THEN n ELSE 0 END AS text_char_count,
  CASE WHEN ok THEN i + 0.5e0 ELSE 0e0 END AS latency_ms, CASE WHEN ok THEN i + 0e0 END AS classify_ms, CASE WHEN ok THEN 100e0 + i % 7 END AS peak_memory_mb, CASE WHEN ok AND i % 6 <> 0 THEN i % 6 * 10e0 END AS gpu_memory_mb,
  CASE WHEN ok THEN 'v' || (i % 3) END AS provider_version, CASE WHEN ok THEN 'm' || (i % 2) END AS model_version, true AS on_prem, CASE WHEN NOT ok THEN 'missing expected ground truth' WHEN i % 13 = 0 THEN 'classify: TimeoutError' END AS error,
  CASE WHEN NOT ok THEN 'MISSING_EXPECTED' WHEN i % 13 = 0 THEN 'PROVIDER_PARTIAL_FAILURE' END AS error_code, CASE WHEN ok AND i % 4 = 2 THEN ['expected portrait not extracted'] ELSE []::VARCHAR[] END AS notes FROM s"""
)
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portraits that were extracted, field scores, latencies, memory, versions and errors of evidence rows (Q6, Q8)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sample_id"), F.lit("nin_slip").alias("document_type"), F.lit("x.jpg").alias("image_path"), F.lit("clean").alias("capture_condition"), "text")
    i = F.col("doc_id")

    def provider(samples: DataFrame) -> DataFrame:
        return samples.withColumns({
            "classification": F.struct(F.lit("nin_slip").alias("document_type"), (i % 8 / 8.0).alias("confidence")),
            "fields": F.create_map(F.lit("nin"), F.when(i % 3 == 0, "123 456 789 01").otherwise("1")), "schema_followed": F.lit(True),
            "portrait": F.struct((i % 4 == 0).alias("available"), (i % 5 / 4.0).alias("quality_score")),
            "latency_ms": F.create_map(F.lit("classify"), i.cast("double"), F.lit("total"), i + 0.5), "skipped": F.array().cast("array<string>"), "image_ok": F.lit(True),
            "error": F.when(i % 13 == 0, "classify: TimeoutError"), "error_code": F.when(i % 13 == 0, "PROVIDER_PARTIAL_FAILURE"),
            "provider_version": F.concat(F.lit("v"), i % 3), "model_version": F.concat(F.lit("m"), i % 2),
            "peak_memory_mb": 100.0 + i % 7, "gpu_memory_mb": F.when(i % 6 != 0, i % 6 * 10.0),
        })

    truth = d.where(i % 11 != 7).select("sample_id", F.create_map(F.lit("nin"), F.lit("12345678901")).alias("fields"), F.array(F.lit("nin")).alias("required_fields"), (i % 2 == 0).alias("portrait_present"))
    e = benchmark.run(d, truth, {"own": provider})
    return e.select(
        "sample_id", F.try_element_at("per_field_scores", F.lit("nin")).alias("nin_score"), "classification_confidence", "portrait_expected", "portrait_extracted", "portrait_quality_score", "text_char_count",
        "latency_ms", F.try_element_at("latency_breakdown", F.lit("classify")).alias("classify_ms"), "peak_memory_mb", "gpu_memory_mb", "provider_version", "model_version", "on_prem", "error", "error_code", "notes",
    )


_TYPES = list(catalog.SCHEMAS)


@query(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {i} THEN '{', '.join(catalog.SCHEMAS[t])}'" for i, t in enumerate(_TYPES)) + " END AS asked FROM conversations"
)
def prompted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the prompt for each document's type asks for, read back from the prompt."""
    c = table(spark, sf_dir, "conversations")
    prompts = F.array(*[F.lit(extract.field_prompt(t)) for t in _TYPES])
    prompt = F.element_at(prompts, ((F.col("conv_id") + F.col("turn")) % len(_TYPES) + 1).cast("int"))
    names = F.array(*[F.lit(f) for f in sorted({f for s in catalog.SCHEMAS.values() for f in s})])
    found = F.array_sort(F.transform(F.filter(names, lambda f: F.regexp_instr(prompt, F.concat(F.lit(r"\b"), f, F.lit(r"\b")), 0) > 0), lambda f: F.struct(F.regexp_instr(prompt, F.concat(F.lit(r"\b"), f, F.lit(r"\b")), 0).alias("at"), f.alias("f"))))
    return c.select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["f"]), ", ").alias("asked"))
