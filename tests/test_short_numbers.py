"""Common forms of numbers go by compiled expressions and give what the general form gives."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars as S

TEXTS = [
    "0x0", "0x00", "0xff", "0x000000000000000000000000000000000fffffffffffffff", "0x1000000000000000", "0xFFFFFFFFFFFFFFFFFFFFFFFF", "0x-1f", "0x+1f", "0x", "0xg", "", "abc", "-", ".", "0", "-0", "-0.0",
    "00012", "12", "-12", "-12.50", "12.", ".5", "0.5", "+7", "12\n", "-12\n", "0xff\n", "7e3", "7E0", "7e-3", "7.5e1", "007e2", "1e0005", "1", "1000000000000000000", "1500000000000000000", "10", "123456789012345678901234567890",
    "100000000000000000000000000000000000000", "999", "-1500000000000000000", None,
]


@pytest.mark.parametrize("divide", [False, True])
def test_short_forms_equal_the_general_form(spark, divide, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(2)
    short = rows.select("t", S.hex_to_decimal("t", divide).alias("n")).collect()
    monkeypatch.setattr(S, "_short_text", lambda known, text, divide: known)
    assert sorted(short, key=str) == sorted(rows.select("t", S.hex_to_decimal("t", divide).alias("n")).collect(), key=str)


def test_short_forms_need_no_general_form(spark, monkeypatch):
    """Before, every value went through limbs and arrays."""
    monkeypatch.setattr(S, "_plain_text", lambda text, divide: F.raise_error(F.lit("general form")).cast("string"))
    rows = spark.createDataFrame([("0x00ff", "-12.50", "7e3")], "a string, b string, c string").repartition(1)
    assert tuple(rows.select(*[S.hex_to_decimal(c) for c in "abc"], S.hex_to_decimal(F.lit("1500000000000000000"), True)).first()) == ("255", "-12.50", "7000", "1.5")
