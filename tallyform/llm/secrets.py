"""Secret scans by an incremental ledger of blobs.

Every version of every path is named by the SHA-256 of its content, its blob. The ledger says which
rules, by name and version, a blob was scanned with and what they found. A run scans only the pairs
of blob and rule version that the ledger lacks, appends them, and joins the findings back to all
paths, so copies and unchanged versions cost a hash and a new rule costs only its own scan.

Built-in functions only: texts move once, to meet their copies and the ledger by blob; matches are
exploded there, and running sums of the lengths of matches and of the text between them give positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "blob string, rules array<string>, found array<struct<start: bigint, stop: bigint, rule: string>>"


def either(words: str) -> str:
    """A pattern of words in either case; plain classes, as (?i) also folds letters beyond ASCII in some engines."""
    return "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least `least` characters; a span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds of the contract. Runs of 24 or more are the maximal runs that are long enough, so the pattern itself drops shorter ones.
BASE = (
    Rule("assign", rf"""({either("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats that services print. None looks back or tries a run again from its middle, so a scan takes linear time.
SERVICES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{12,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}"),
)
RULES = BASE + SERVICES


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, which is made if it is not there; rows of any run may follow each other."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<rule, gap, size, value>> of the matches: text since the last one, length, length of the group."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    cut = F.transform(F.filter(parts, lambda m: m["hit"].isNotNull()), lambda m: F.struct(F.lit(rule.name).alias("rule"), F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("size"), F.length(m["value"]).alias("value")))
    return F.when(text.rlike(rule.pattern), cut)


def scan_unseen(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks of the blobs of versions and append it: one row a blob and run, also where nothing is found.

    An append is committed as a whole; one that fails leaves no rows. Runs at the same time may write a pair twice, which changes no result.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = open_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    unseen = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    cuts = F.array(*[F.when(F.array_contains("rules", r.name), _matches(F.col("text"), r)) for r in rules])
    matches = unseen.select("blob", "rules", F.flatten(F.filter(cuts, lambda c: c.isNotNull())).alias("cut")).select("blob", "rules", F.posexplode_outer("cut").alias("at", "m"))
    before = Window.partitionBy("blob", "m.rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    span = F.struct((F.col("stop") - F.col("m.size")).alias("start"), "stop", F.col("m.rule").alias("rule"))
    enough = reduce(lambda a, r: a.when(F.col("m.rule") == r.name, F.col("m.value") >= r.least), rules, F.when(F.col("at").isNull(), False))
    rows = matches.withColumn("stop", stop).groupBy("blob").agg(F.any_value("rules").alias("rules"), F.array_sort(F.collect_list(F.when(enough, span))).alias("found"))
    rows.write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs in which one of the rules found something: found in order of start, then of the rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    ours = F.filter(F.flatten(F.collect_list("found")), lambda f: f["rule"].isin(*[r.name for r in rules]))
    ranked = F.array_sort(F.array_distinct(F.transform(ours, lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("rank"), f["stop"].alias("stop"), kinds[f["rule"]].alias("kind")))))
    rows = open_ledger(spark, ledger).where(F.size("found") > 0).groupBy("blob").agg(ranked.alias("found")).where(F.size("found") > 0)
    return rows.select("blob", F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["stop"].alias("stop"))).alias("found"))


def scan_versions(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions without the text, with blob and found (array of kind, start, stop; code points, stop exclusive).

    Rows repeat and stay, each with the findings of its blob; a null text is empty; columns named blob or found are
    replaced, other extra columns stay. A blob with very many paths makes a skewed join of narrow rows, which adaptive execution splits.
    """
    scan_unseen(versions, ledger, text, rules)
    own = [F.col(f"`{c}`") for c in versions.columns if c not in (text, "blob", "found")]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    paths = versions.select(*own, F.sha2(content, 256).alias("blob"))
    none = F.array().cast("array<struct<kind: string, start: bigint, stop: bigint>>")
    return paths.join(findings(versions.sparkSession, ledger, rules), "blob", "left").select(*own, "blob", F.coalesce("found", none).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:stop of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def _of(*kinds: str) -> Column:
    return F.filter("found", lambda f: f["kind"].isin(*kinds))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """n_<kind> of the base rules, base_sha256 of their spans and spans of all rules, in place of blob, found and columns of these names."""
    made = {"blob", "found", "base_sha256", "spans", *(f"n_{r.kind}" for r in base)}
    rest = [F.col(f"`{c}`") for c in found.columns if c not in made]
    counts = [F.size(_of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    ours = _of(*[r.kind for r in base])
    return found.select(*rest, *counts, F.sha2(joined(ours), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """SQL for the same digest over documents, without blobs or a ledger."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    one = " UNION ALL ".join(
        f"SELECT r, '{x.kind}' AS kind, {i} AS rank, {x.least} AS least, regexp_split_to_array(t, {q(x.pattern)}) AS gaps, regexp_extract_all(t, {q(x.pattern)}, 0) AS hits, regexp_extract_all(t, {q(x.pattern)}, {x.group}) AS vals FROM d"
        for i, x in enumerate(rules)
    )
    mine = ", ".join(q(x.kind) for x in base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{x.kind}') AS n_{x.kind}" for x in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({one}),
p AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT r, kind, rank, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
    length(hits[i]) AS size FROM p WHERE length(vals[i]) >= least),
g AS (
  SELECT r, {counts}, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rank) FILTER (WHERE kind IN ({mine})) AS base,
    string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
