from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from dqspark.functions import coerce, dates, flagbits, text, vectors


def one(spark, value, ddl, function):
    return spark.createDataFrame([(value,)], f"c {ddl}").select(function(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("o'neil 3-MEDIUM abc1def", "O'Neil 3-Medium Abc1Def"),
        ("ÉTÉ à la mer", "Été À La Mer"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, given, wanted):
    assert one(spark, given, "string", text.title_case) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [("  a \t b  c\x1d ", "a b c"), ("　", ""), ("x", "x"), (None, None)],
)
def test_clean_space(spark, given, wanted):
    assert one(spark, given, "string", text.clean_space) == wanted
    once = one(spark, given, "string", text.clean_space)
    assert one(spark, once, "string", text.clean_space) == once


@pytest.mark.parametrize(
    "given, wanted", [("A->B; C,,D|E>F ", 6), ("", 0), (None, 0), (" ; ,", 0), ("JFK", 1)]
)
def test_item_count(spark, given, wanted):
    assert one(spark, given, "string", text.item_count) == wanted


@pytest.mark.parametrize("given, wanted", [("5", 5.0), (" 5.5 ", 5.5), ("5d", None), ("x9", None), ("1e3", 1000.0), (None, None)])
def test_to_number(spark, given, wanted):
    assert one(spark, given, "string", coerce.to_number) == wanted


@pytest.mark.parametrize("given, wanted", [(" Yes", True), ("T", True), ("0", False), (None, False), ("on", False)])
def test_to_flag(spark, given, wanted):
    assert one(spark, given, "string", coerce.to_flag) is wanted


def test_to_time(spark):
    assert one(spark, "2024-01-07", "string", coerce.to_time) == datetime.datetime(2024, 1, 7)
    assert one(spark, "soon", "string", coerce.to_time) is None


def test_truncate(spark):
    assert one(spark, "x" * 300, "string", lambda c: text.truncate(c, 300)) == "x" * 300
    assert one(spark, "x" * 301, "string", lambda c: text.truncate(c, 300)) == "x" * 297 + "…"


def test_weekday(spark):
    day = datetime.date(2024, 1, 7)
    assert one(spark, day, "date", dates.weekday_name) == "Sunday"
    assert one(spark, day, "date", dates.weekday_number) == 6
    assert one(spark, day, "date", dates.year_month) == "2024-01"
    assert one(spark, datetime.date(2021, 1, 1), "date", dates.iso_week) == "2020-W53"


@pytest.mark.parametrize("ddl", ["timestamp_ntz", "timestamp"])
def test_micros_round_trip(spark, ddl):
    value = datetime.datetime(1969, 12, 31, 23, 59, 58, 123457)
    df = spark.createDataFrame([(value,)], f"c {ddl}")
    data_type = df.schema["c"].dataType
    back = df.select(dates.from_micros(dates.micros(F.col("c"), data_type), data_type).alias("r"), "c").first()
    assert back["r"] == back["c"]


def test_flag_texts(spark):
    assert one(spark, 5, "bigint", flagbits.flags_text) == "Flags: 1+4"
    assert one(spark, 0, "bigint", flagbits.flags_text) == "No flags"
    assert one(spark, 5, "bigint", flagbits.binary_text) == "101"
    assert one(spark, 5, "bigint", lambda c: flagbits.binary_text(c, 8)) == "00000101"
    assert one(spark, (1 << 62) + 1, "bigint", flagbits.set_flags) == [1, 1 << 62]
    assert [flagbits.flag_value(i) for i in (0, 1, 62)] == [1, 2, 1 << 62]
    with pytest.raises(ValueError):
        flagbits.flag_value(63)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    first, second = (r["s"] for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect())
    assert first == pytest.approx(0.5**0.5) and second is None


def test_cache_key(spark):
    assert one(spark, "  Which Month? ", "string", text.cache_key) == "q::which month?"
