"""Fields and document types from raw extractor output: JSON answers, labelled text, plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyform.functions.numbers import rounded
from tallyform.functions import normalize as N
from tallyform.plans import catalog

INLINE = rf"^[{N.SPACE}]*([^:]{{1,40}}?):[{N.SPACE}]*(.+[^{N.SPACE}])[{N.SPACE}]*$"
LINE_END = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def lines(text: Column | str) -> Column:
    """Non-blank stripped lines."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, LINE_END), N.strip), lambda x: x != "")


# ---------------------------------------------------------------- classification


def keyword_class(text: Column | str, keywords: dict[str, list[str]] | None = None) -> Column:
    """struct(document_type, hits, confidence): the type most of whose keywords the lower-case text holds.

    The earlier type wins ties; no hit gives `unknown` with confidence 0, n hits min(0.4 + 0.2 n, 0.9).
    Each row is judged by its own text.
    """
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    options = []
    for i, (kind, words) in enumerate((keywords or catalog.KEYWORDS).items()):
        hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        options.append(F.struct(hits.alias("hits"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*options))
    hits = best["hits"]
    return F.struct(
        F.when(hits > 0, best["kind"]).otherwise("unknown").alias("document_type"),
        hits.alias("hits"),
        F.when(hits > 0, F.least(F.lit(0.4) + F.lit(0.2) * hits, F.lit(0.9))).otherwise(0.0).alias("confidence"),
    )


def answer_class(answer: Column | str) -> Column:
    """struct(document_type, label, confidence) of a JSON answer; an unknown or missing type is `unknown`."""
    doc = F.from_json(json_object(answer), "documentType string, confidence string", _STRICT)
    label = N.strip(F.lower(F.coalesce(doc["documentType"], F.lit("unknown"))))
    return F.struct(
        F.when(label.isin(catalog.DOCUMENT_TYPES), label).otherwise("unknown").alias("document_type"),
        label.alias("label"),
        F.coalesce(doc["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
    )


# ---------------------------------------------------------------- JSON answers


#: JSON as the evaluated format takes it: double quotes only; NaN and repeated keys are allowed.
_STRICT = {"allowSingleQuotes": "false"}
#: The first object inside a code fence (fixed value).
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def _parsed(text: Column) -> Column:
    """Entries (key, value) of one JSON object in order, values as text; null if the text is not just one object.

    The object is read as the only element of an array, so that whatever follows it is an error.
    """
    return _only(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT), F.map_entries)


def _only(got: Column, then: Callable[[Column], Column]) -> Column:
    """then() of the element of an array of one, else null; a lambda's variable, so that the array is made once."""
    return F.element_at(F.transform(F.array(got), lambda g: F.when(F.size(g) == 1, then(F.element_at(g, 1)))), 1)


def _candidate(answer: Column | str) -> Column:
    """The first fenced JSON object, else what stands from the first { to the last }; null if there is neither."""
    t = F.col(answer) if isinstance(answer, str) else answer
    fenced = F.nullif(F.regexp_extract(t, FENCED, 1), F.lit(""))
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    spanned = F.when((first > 0) & (F.instr(t, "}") > 0) & (last > first), F.substring(t, first, last - first + 1))
    return F.coalesce(fenced, spanned)


def json_object(answer: Column | str) -> Column:
    """Text of the first fenced JSON object, else from the first { to the last }; null if it does not parse."""
    found = _candidate(answer)
    return F.when(_parsed(found).isNotNull(), found)


def _typed(text: Column) -> Column:
    """Entries of one JSON object in order: key, value as text and confidence; null if the text is not just one object.

    Values are variants, so an object (value and confidence inside) is told from a text by its type. Objects that
    repeat a key inside make no variant; see _untyped.
    """
    got = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", _STRICT)

    def held(m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.struct(e["key"], e["value"], F.try_variant_get(e["value"], "$", "struct<value:variant,confidence:variant>").alias("object")))

    def entry(e: Column) -> Column:
        value = F.when(e["object"].isNotNull(), e["object"]["value"]).otherwise(e["value"]).cast("string")
        return F.struct(e["key"], value.alias("value"), F.coalesce(e["object"]["confidence"].cast("string").try_cast("double"), F.lit(0.0)).alias("confidence"))

    return _only(got, lambda m: F.transform(held(m), entry))


def _untyped(text: Column) -> Column:
    """_typed for answers with objects that repeat a key, of which the last value counts; their values are parsed as text."""

    def entry(x: Column) -> Column:
        # An object stands in the answer as such; a text of the same characters stands there quoted.
        quoted = F.regexp_replace(F.to_json(F.struct(x["value"].alias("v"))), r"^\{\"v\":|\}$", "")
        object_ = F.when(F.ltrim(x["value"]).startswith("{") & ~F.contains(text, quoted) & _parsed(x["value"]).isNotNull(), x["value"])
        inner = F.from_json(object_, "value string, confidence string", _STRICT)
        value = F.when(object_.isNotNull(), inner["value"]).otherwise(x["value"])
        return F.struct(x["key"], value.alias("value"), F.coalesce(inner["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"))

    return F.transform(_parsed(text), entry)


def _targets() -> Column:
    """Map of (document_type|key) to field: own names first, then aliases whose target the schema has."""
    pairs: dict[str, str] = {}
    for t, fields in catalog.SCHEMAS.items():
        own = {a: f for a, f in catalog.KEY_ALIASES.items() if f in fields} | {f: f for f in fields}
        pairs |= {f"{t}|{k}": f for k, f in own.items()}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def json_fields(answers: DataFrame, answer: str = "answer", document_type: str = "document_type") -> DataFrame:
    """answers with `fields` (map of name to struct(value, confidence)) and `schema_followed`.

    Keys are normalized and led to the schema's fields by name or alias; the first key of a field
    wins even if its value is null, and of a key that is repeated as it is the last value counts, in
    its first place. A missing full_name is put together from its parts. Null, empty and "null" values
    are dropped; an object is told from a text by its type. schema_followed is true wherever the answer parses.
    """
    none = F.array().cast("array<struct<key:string,value:string,confidence:double>>")
    keys = F.transform("_raw", lambda x: x["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter("_raw", lambda x: x["key"] == k), -1))
    entries = F.when(F.size(F.array_distinct(keys)) < F.size("_raw"), last).otherwise(F.col("_raw"))

    def entry(x: Column) -> Column:
        field = F.try_element_at(F.col("_targets"), F.concat(F.col(document_type), F.lit("|"), N.key(x["key"])))
        return F.struct(field.alias("field"), x["value"].alias("value"), x["confidence"].alias("confidence"))

    def first_only(acc: Column, x: Column) -> Column:
        return F.when(x["field"].isNull() | F.exists(acc, lambda y: y["field"] == x["field"]), acc).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<field:string,value:string,confidence:double>>")
    out = answers.withColumn("_json", _candidate(answer)).withColumn("_typed", _typed(F.col("_json")))
    out = out.withColumn("_read", F.coalesce("_typed", _untyped(F.col("_json")))).withColumn("_raw", F.coalesce("_read", none))
    out = out.withColumn("_raw", entries).withColumn("_targets", _targets())
    out = out.withColumn("_got", F.aggregate(F.transform("_raw", entry), empty, first_only))
    def part(f: str) -> Column:
        return F.nullif(F.try_element_at(F.filter("_got", lambda y: y["field"] == f), F.lit(1))["value"], F.lit(""))

    parts = F.array_join(F.array_compact(F.array(part("first_name"), part("middle_name"), part("surname"))), " ")
    wants = F.col(document_type).isin([t for t, f in catalog.SCHEMAS.items() if "full_name" in f])
    add = wants & ~F.exists("_got", lambda y: y["field"] == "full_name") & (parts != "")
    joined = F.struct(F.lit("full_name").alias("field"), parts.alias("value"), F.lit(0.0).alias("confidence"))
    out = out.withColumn("_got", F.when(add, F.concat("_got", F.array(joined))).otherwise(F.col("_got")))
    kept = F.filter("_got", lambda y: y["value"].isNotNull() & ~y["value"].isin("", "null"))
    fields = F.map_from_entries(F.transform(kept, lambda y: F.struct(y["field"], F.struct(y["value"].alias("value"), y["confidence"].alias("confidence")))))
    return out.withColumn("fields", fields).withColumn("schema_followed", F.col("_read").isNotNull()).drop("_json", "_typed", "_read", "_raw", "_targets", "_got")


def field_prompt(document_type: str) -> str:
    """Comma-joined fields of a type, for an instruction to a model."""
    return ", ".join(catalog.SCHEMAS.get(document_type, []))


# ---------------------------------------------------------------- labelled text


def _labels_of(document_type: Column) -> Column:
    """Map of label phrase to field for the row's document type; empty for types without a schema."""
    out = F.create_map().cast("map<string,string>")
    for t in catalog.SCHEMAS:
        out = F.when(document_type == t, F.create_map(*[F.lit(x) for kv in catalog.label_map(t).items() for x in kv])).otherwise(out)
    return out


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once per row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def labelled_fields(text: Column | str, document_type: Column | str) -> Column:
    """Map of field to value by labels, row by row without a shuffle; the first match of a field wins.

    An inline `label: value` comes first; a label-only line takes the next line unless that is a
    label itself. Labels are looked up among those of the row's document type. Where no label gives
    them, nin is any 11 digits on their own and bvn 11 digits after that word.
    """
    t = F.col(text) if isinstance(text, str) else text
    kind = F.col(document_type) if isinstance(document_type, str) else document_type

    def tagged(labels: Column) -> Callable[[Column], Column]:
        def one(line: Column) -> Column:
            value = N.strip(F.regexp_extract(line, INLINE, 2))
            inline = F.when(value != "", F.try_element_at(labels, N.label(F.regexp_extract(line, INLINE, 1))))
            return F.struct(line.alias("line"), value.alias("value"), inline.alias("inline"), F.try_element_at(labels, N.label(F.regexp_replace(line, ":+$", ""))).alias("whole"))

        return one

    def hit(all_: Column) -> Callable[[Column, Column], Column]:
        def one(x: Column, i: Column) -> Column:
            nxt = F.get(all_, i + 1)
            takes = nxt["line"].isNotNull() & nxt["inline"].isNull() & nxt["whole"].isNull()
            field = F.coalesce(x["inline"], F.when(takes, x["whole"]))
            return F.struct(field.alias("key"), F.when(x["inline"].isNotNull(), x["value"]).otherwise(nxt["line"]).alias("value"))

        return one

    def first_only(acc: Column, x: Column) -> Column:
        return F.when(x["key"].isNull() | (F.coalesce(x["value"], F.lit("")) == "") | F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x)))

    def late(field: str, pattern: str) -> Column:
        types = [k for k, own in catalog.SCHEMAS.items() if field in own]
        return F.struct(F.lit(field).alias("key"), F.when(kind.isin(types), F.regexp_extract(t, pattern, 1)).alias("value"))

    # fixed values
    fall = F.array(late("nin", rf"(?<![{N.WORD}])([0-9]{{11}})(?![{N.WORD}])"), late("bvn", r"(?i)bvn[^0-9]{0,16}([0-9]{11})"))
    lines_ = _once(_labels_of(kind), lambda labels: F.transform(lines(t), tagged(labels)))
    hits = _once(lines_, lambda all_: F.concat(F.transform(all_, hit(all_)), fall))
    got = F.aggregate(hits, F.array().cast("array<struct<key:string,value:string>>"), first_only)
    return F.coalesce(F.map_from_entries(got), F.create_map().cast("map<string,string>"))


def text_fields(texts: DataFrame, key: str, text: str = "text", document_type: str = "document_type", confidence: float = 0.5) -> DataFrame:
    """(key, field, value, normalized_value, confidence) by labels; see labelled_fields."""
    got = texts.select(F.col(key).alias("key"), F.explode(labelled_fields(text, document_type)).alias("field", "value"))
    return got.select("key", "field", "value", N.field_value("field", "value").alias("normalized_value"), F.lit(confidence).alias("confidence"))


# ---------------------------------------------------------------- plain text


def plain_value(field: str, text: Column | str, split: Column | None = None) -> Column:
    """Value of one field in plain text: digits patterns for nin, bvn and passport numbers, else what follows a label.

    The first line that holds one of the field's labels as a substring and has something after it
    counts; within a line the first such label does. Null if there is none. `split` may hand over
    the text's lines.
    """
    t = F.col(text) if isinstance(text, str) else text
    patterns = {  # fixed values
        "nin": rf"(?<![{N.WORD}])([0-9]{{11}})(?![{N.WORD}])",
        "bvn": r"(?i)bvn[^0-9]{0,12}([0-9]{11})",
        "passport_number": rf"(?<![{N.WORD}])([A-Z][0-9]{{8}})(?![{N.WORD}])",
    }
    if field in patterns:
        return F.nullif(F.regexp_extract(t, patterns[field], 1), F.lit(""))

    def tail(line: Column) -> Column:
        def after(label: str) -> Column:
            at = F.instr(F.lower(line), label)
            rest = F.regexp_replace(F.substring(line, at + len(label), F.length(line)), r"^[ :.\-\t]+", "")
            return F.when((at > 0) & (rest != ""), rest)

        own = [after(x) for x in catalog.PLAIN_LABELS.get(field, [])]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    values = F.filter(F.transform(lines(t) if split is None else split, tail), lambda v: v.isNotNull())
    return N.strip(F.try_element_at(values, F.lit(1)))


def plain_fields(text: Column | str, document_type: Column | str) -> Column:
    """Map of field to value over the fields of the row's document type."""
    kind = F.col(document_type) if isinstance(document_type, str) else document_type
    names = sorted({f for own in catalog.SCHEMAS.values() for f in own})
    types = {f: [t for t, own in catalog.SCHEMAS.items() if f in own] for f in names}
    t = F.col(text) if isinstance(text, str) else text

    def read(r: Column) -> Column:  # r: the text and its lines, split once for all fields
        one = [F.struct(F.lit(f).alias("key"), F.when(kind.isin(types[f]), plain_value(f, r["text"], r["lines"])).alias("value")) for f in names]
        return F.map_from_entries(F.filter(F.array(*one), lambda x: F.coalesce(x["value"], F.lit("")) != ""))

    return _once(F.struct(t.alias("text"), lines(t).alias("lines")), read)


# ---------------------------------------------------------------- OCR words


def words_to_blocks(words: Column | str) -> Column:
    """Blocks struct(text, confidence, bbox) of OCR words struct(text, conf, left, top, width, height); blank words and conf < 0 go."""
    w = F.col(words) if isinstance(words, str) else words
    kept = F.filter(w, lambda x: (N.strip(x["text"]) != "") & (x["conf"] >= 0))
    return F.transform(kept, lambda x: F.struct(N.strip(x["text"]).alias("text"), rounded(x["conf"].cast("double") / 100, 3).alias("confidence"), F.array(x["left"], x["top"], x["left"] + x["width"], x["top"] + x["height"]).alias("bbox")))


Chat = Callable[[str, str, bytes], str]
"""A model endpoint: (system text, user text, image bytes) to answer; see sources.providers."""
