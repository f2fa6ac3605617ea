import pytest
from pyspark.sql import functions as F

from tallyform.functions import normalize as N
from tallyform.functions import similarity as S
from tallyform.functions.numbers import rounded


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "field,value,want",
    [
        ("surname", "  Ada   Okafor ", "ADA OKAFOR"),
        ("surname", "A . B", "A  B"),
        ("full_name", "Zoë O'Neil-Ray (jr.)", "ZOË O'NEIL-RAY JR"),
        ("dob", "14/03/1990", "1990-03-14"),
        ("dob", "14 Mar 1990", "1990-03-14"),
        ("dob", "1990-03-14", "1990-03-14"),
        ("dob", "March 14, 1990", "1990-03-14"),
        ("dob", "14/03/68", "2068-03-14"),
        ("dob", "14/03/69", "1969-03-14"),
        ("dob", "valid till 31/02/1990 or 14-03-1990", "VALID TILL 31/02/1990 OR 14-03-1990"),
        ("dob", "on 1990-03-14!", "1990-03-14"),
        ("dob", "never", "NEVER"),
        ("nin", "A 0123 4567", "A01234567"),
        ("nin", "123-456-789 01", "12345678901"),
        ("drivers_license_number", "OGU02951830", "OG02951830"),
        ("amount_due", "N12,000.00", "N1200000"),
        ("gender", "m", "MALE"),
        ("sex", " Female ", "FEMALE"),
        ("occupation", "a \t b", "A B"),
        ("occupation", None, ""),
    ],
)
def test_field_value(spark, field, value, want):
    assert one(spark, N.field_value(F.lit(field), F.lit(value).cast("string"))) == want


def test_checks(spark):
    assert one(spark, N.validate_nin(F.lit("12345678901"))).ok
    assert one(spark, N.validate_nin(F.lit("123"))).message == "NIN should be 11 digits, got 3"
    assert not one(spark, N.validate_bvn(F.lit(None).cast("string"))).ok
    assert one(spark, N.validate_passport_number(F.lit(" a01234567 "))).ok
    assert not one(spark, N.validate_passport_number(F.lit("12345"))).ok
    assert one(spark, N.validate_expiry_not_past(F.lit("01/02/2030"), "2030-02-01")).ok
    assert one(spark, N.validate_expiry_not_past(F.lit("31 Jan 2030"), "2030-02-01")).message == "Document expired on 2030-01-31"
    assert one(spark, N.validate_expiry_not_past(F.lit("x"), "2030-02-01")).message == "Expiry date unparseable"


def test_keys_and_labels(spark):
    assert one(spark, N.key(F.lit("Passport No."))) == "passport_no"
    assert one(spark, N.key(F.lit("First Name"))) == "first_name"
    assert one(spark, N.label(F.lit("Date of Birth:"))) == "date of birth"
    assert one(spark, N.label(F.lit("Sex."))) == "sex"


def test_similarity(spark):
    assert S.lcs_length("ABCBDAB", "BDCABA") == 4
    assert one(spark, S.token_sort_ratio(F.lit("Ada Okafor"), F.lit("Okafer Ada"))) == pytest.approx(0.9)
    assert one(spark, S.indel_ratio(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, S.indel_ratio(F.lit(None).cast("string"), F.lit("a"))) is None


def test_lcs_against_table():
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert S.lcs_length(a, b) == row[-1]


def test_rounding_follows_the_binary_value(spark):
    assert one(spark, rounded(F.lit(0.25), 1)) == 0.2
    assert one(spark, rounded(F.lit(0.5035), 3)) == 0.503
