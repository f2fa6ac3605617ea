"""Column builders that bring field values to a comparable form. All are built-in expressions.

White space and word characters are spelled out as Unicode classes, since \\s and \\w of the JVM
only know ASCII.
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyform.plans import catalog

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

#: Date patterns in the order in which they are tried (fixed values).
DATE_PATTERNS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d MMM, yyyy", "d-MMM-yyyy", "d/M/yy")


def date_shape(pattern: str) -> str:
    """Regular expression that every text of a date pattern fits; parsers are slow at refusing others."""
    parts = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}"}
    return "^" + re.sub(r"[yMd]+|\.", lambda m: parts.get(m[0], r"\."), pattern) + "$"


#: Two-digit years from this one on belong to the last century.
PIVOT_YEAR = 2069


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def field_kind(field: Column | str) -> Column:
    """name, date, number, address or text: the kind that decides how a field is normalized and scored."""
    f = _col(field)
    return (
        F.when(f.isin(catalog.NAME_FIELDS), "name")
        .when(f.isin(catalog.DATE_FIELDS), "date")
        .when(f.isin(catalog.NUMBER_FIELDS + catalog.PHONE_FIELDS), "number")
        .when(f == "address", "address")
        .otherwise("text")
    )


def whitespace(c: Column | str) -> Column:
    """Runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def name(c: Column | str) -> Column:
    """White space first, then drop all but word characters, spaces, ' and -, then upper case."""
    return F.upper(F.regexp_replace(whitespace(c), rf"[^{WORD} '\-]", ""))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^\p{Nd}]", "")


def number(c: Column | str) -> Column:
    """Up to two leading capitals and all digits."""
    u = F.upper(strip(c))
    return F.concat(F.regexp_extract(u, "^([A-Z]{0,2})", 1), digits(u))


def parsed_date(c: Column | str) -> Column:
    """Date by the first pattern that fits the cleaned text, else by a date inside it; null if there is none."""
    v = whitespace(c)
    *whole, short = [F.when(v.rlike(date_shape(p)), F.try_to_date(v, p)) for p in DATE_PATTERNS]
    short = F.when(F.year(short) >= PIVOT_YEAR, F.add_months(short, -1200)).otherwise(short)

    def inner(pattern: str, y: int, m: int, d: int) -> Column:
        part = [F.regexp_extract(v, pattern, i) for i in (y, m, d)]
        joined = F.concat(F.lpad(part[0], 4, "0"), F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0"))
        return F.when(part[0] != "", joined.try_cast("date"))

    return F.coalesce(*whole, short, inner(r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", 1, 2, 3), inner(r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", 3, 2, 1))


def date_text(c: Column | str) -> Column:
    """ISO date, or the cleaned text in upper case where there is no date."""
    return F.coalesce(F.date_format(parsed_date(c), "yyyy-MM-dd"), F.upper(whitespace(c)))


def gender(c: Column | str) -> Column:
    v = F.upper(strip(c))
    return F.when(v.isin("M", "MALE"), "MALE").when(v.isin("F", "FEMALE"), "FEMALE").otherwise(v)


def field_value(field: Column | str, value: Column | str) -> Column:
    """Normalized value of a field; null counts as empty. gender and sex come before the kind."""
    f, v = _col(field), _col(value)
    kind = field_kind(f)
    out = (
        F.when(f.isin("gender", "sex"), gender(v))
        .when(kind == "name", name(v))
        .when(kind == "date", date_text(v))
        .when(kind == "number", number(v))
        .otherwise(F.upper(whitespace(v)))
    )
    return F.coalesce(F.when(v.isNull(), "").otherwise(out), F.lit(""))


def label(c: Column | str) -> Column:
    """Lower case without punctuation and with single spaces, as label phrases are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), rf"[^{WORD}{SPACE}]+", " "), f"[{SPACE}]+", " "))


def key(c: Column | str) -> Column:
    """Lower case with runs of anything but a-z and 0-9 as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# ---------------------------------------------------------------- checks: struct(ok, message)


def _check(ok: Column, message: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise(message).alias("message"))


def _eleven(c: Column | str, what: str) -> Column:
    n = F.length(digits(F.coalesce(_col(c), F.lit(""))))
    return _check(n == 11, F.concat(F.lit(f"{what} should be 11 digits, got "), n.cast("string")))


def validate_nin(c: Column | str) -> Column:
    return _eleven(c, "NIN")


def validate_bvn(c: Column | str) -> Column:
    return _eleven(c, "BVN")


def validate_passport_number(c: Column | str) -> Column:
    v = F.upper(strip(F.coalesce(_col(c), F.lit(""))))
    return _check(v.rlike(r"\A[A-Z]\p{Nd}{8}\z"), F.lit("Passport number should be 1 letter + 8 digits"))


def validate_expiry_not_past(c: Column | str, today: date | str) -> Column:
    """`today` is always given, so that results can be repeated; a document that expires today is valid."""
    day = F.lit(str(today)).cast("date")
    d = parsed_date(F.coalesce(_col(c), F.lit("")))
    return _check(d >= day, F.when(d.isNull(), "Expiry date unparseable").otherwise(F.concat(F.lit("Document expired on "), F.date_format(d, "yyyy-MM-dd"))))


def case_map(c: Column, mapping: dict[str, float], default) -> Column:
    """CASE over a small dictionary."""
    return reduce(lambda out, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(out), mapping.items(), F.lit(default))
