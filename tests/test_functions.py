import datetime as dt

import pytest
from pyspark.sql import functions as F

from stocktide import functions as E


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("num,den,want", [(6.0, 3.0, 2.0), (5.0, 0.0, None), (0.0, 0.0, None), (None, 2.0, None), (2.0, None, None)])
def test_ratio_zero_and_null(spark, num, den, want):
    assert one(spark, E.ratio(F.lit(num).cast("double"), F.lit(den).cast("double"))) == want


@pytest.mark.parametrize("value,even,up", [(0.125, 0.12, 0.13), (0.375, 0.38, 0.38), (-0.125, -0.12, -0.13), (2.5, 2.5, 2.5), (1.005, 1.0, 1.0)])
def test_rounding_rules(spark, value, even, up):
    assert one(spark, E.round_half_even(F.lit(value), 2)) == pytest.approx(even, abs=1e-12)
    assert one(spark, E.round_half_up(F.lit(value), 2)) == pytest.approx(up, abs=1e-12)


def test_round_to_integer_is_half_even(spark):
    assert [one(spark, E.round_half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_null_rules(spark):
    none = F.lit(None).cast("double")
    assert one(spark, E.floor_zero(none)) is None
    assert one(spark, E.floor_zero(F.lit(-3.0))) == 0
    assert one(spark, E.least_known(none, F.lit(4.0))) == 4.0
    assert one(spark, E.least_strict(none, F.lit(4.0))) is None
    assert one(spark, E.sum_known(none, F.lit(4.0))) == 4.0
    assert one(spark, E.sum_strict(none, F.lit(4.0))) is None
    assert one(spark, E.not_true(none >= 0)) is True
    assert one(spark, E.choose([(none > 0, F.lit(1))])) == 0


def test_text(spark):
    assert one(spark, E.first_word(F.lit("  DOVE\tSOAP BAR"))) == "DOVE"
    assert one(spark, E.first_word(F.lit("   "))) is None
    assert one(spark, E.shorten(F.lit("abcdef"), 3)) == "abc ..."
    assert one(spark, E.shorten(F.lit("abc"), 3)) == "abc"
    assert one(spark, E.percent_text(F.lit(12.345))) == "12.35%"
    assert one(spark, E.join_text(F.lit("a"), F.lit(None).cast("string"))) == "a"
    assert E.flat_name("Final\nOrder Qty.") == "Final Order Qty."
    assert one(spark, E.replace_values(F.lit(""), {"": "0"})) == "0"


def test_dates(spark):
    assert one(spark, E.parse_day(F.lit("03.02.2023"), E.DAY_DOTTED)) == dt.date(2023, 2, 3)
    assert one(spark, E.parse_day(F.lit("x"), E.DAY_DOTTED)) is None
    jan, feb = F.lit("2023-01-31").cast("date"), F.lit("2023-02-01").cast("date")
    assert one(spark, E.months_apart(jan, feb)) == 1
    assert one(spark, E.weekday_tag(F.lit("2023-03-18").cast("date"))) == "SAT"
    assert one(spark, E.day_before(F.lit("2023-03-20").cast("date"))) == "19 Mar 2023"
    assert one(spark, E.in_period(F.lit("2023-07-01").cast("date"), "2023-01-01", "2023-07-01")) is False


def test_upper_text_leaves_numbers(make, rows):
    df = make([("a", 1.0), (None, 2.0)], "s string, n double")
    assert rows(E.upper_text(df)) == [("A", 1.0), (None, 2.0)]
