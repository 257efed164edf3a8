"""Golden values of scalar functions and periods."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as s
from tallyforge.functions.periods import period_of, period_range
from tallyforge.schemas import NS_PER_DAY, NS_PER_SECOND, SCALE

D = NS_PER_DAY


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ns(seconds):
    return F.lit(seconds * NS_PER_SECOND)


def test_fixed_periods(spark):
    assert one(spark, *(s.fixed_period(F.lit(t).cast("long"), D) for t in (0, -1, D, D + 1, 2 * D))) == (0, 0, 1, 1, 2)


def test_day_periods(spark):
    assert one(spark, *(s.day_period(F.lit(t).cast("long")) for t in (0, D - 1, D, 7 * D))) == (0, 0, 1, 7)


def test_weeks_start_on_monday(spark):
    monday, sunday, next_monday = 1_704_067_200, 1_704_671_999, 1_704_672_000
    assert one(spark, s.week_period(ns(monday)), s.week_period(ns(sunday) + 999_999_999), s.week_period(ns(next_monday)), s.week_period(F.lit(0).cast("long"))) == (2818, 2818, 2819, 0)


def test_calendar_periods(spark):
    april17, april10, january1, leap = 1_776_384_000, 1_775_779_200, 1_767_225_600, 1_709_164_800
    got = one(spark, s.calendar_period(ns(april17), 1), s.calendar_period(ns(april17), 15), s.calendar_period(ns(april10), 15), s.calendar_period(ns(january1), 15), s.calendar_period(ns(leap), 1), s.calendar_period(ns(leap), 0))
    assert got == (315, 315, 314, 311, 289, 289)
    assert one(spark, s.calendar_period(F.lit(0).cast("long")), s.calendar_period(ns(100), 15), s.calendar_period(ns(947_000_000), 1)) == (0, 0, 0)


def test_civil_dates(spark):
    assert one(spark, *(s.civil_date(F.lit(x * NS_PER_SECOND)) for x in (0, 1_776_384_000, 1_709_164_800))) == (date(1970, 1, 1), date(2026, 4, 17), date(2024, 2, 29))


@pytest.mark.parametrize("kind", ["fixed", "day", "week", "calendar", "other"])
@pytest.mark.parametrize("day", [0, 1, 15, 28])
def test_driver_periods_equal_columns(spark, kind, day):
    instants = [-5, 0, 1, 3 * D, 946_684_800 * NS_PER_SECOND, 1_709_164_800 * NS_PER_SECOND + 7, 1_776_384_000 * NS_PER_SECOND, 1_705_276_800 * NS_PER_SECOND - 1]
    got = one(spark, *(s.resolve_period(F.lit(t).cast("long"), F.lit(kind), F.lit(day), F.lit(0).cast("long")) for t in instants))
    assert list(got) == [period_of(t, kind, day) for t in instants]


def test_period_range_is_half_open():
    assert period_range(D, 3 * D, "day") == (1, 2)
    assert period_range(D, D, "day") == (1, 1)
    assert period_range(5 * D, D, "day") == (5, 5)


def test_fnv1a64(spark):
    values = {"": -3750763034362895579, "api_calls": -6650755458845778815, "region": -4083174813776337699, "us": 631696951056195225}
    assert one(spark, *(s.fnv1a64(F.lit(c)) for c in values)) == tuple(values.values())

    def model(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >> 63 else h

    assert one(spark, s.fnv1a64(F.lit("größe/é"))) == (model("größe/é"),)
    assert one(spark, s.fnv1a64(F.lit("us\0rest"))) == (model("us"),)


def test_small_ones(spark):
    assert one(spark, s.uuid7_ms(F.lit("018cc251-f400-7000-8000-000000000000"))) == (0x018CC251F400,)
    assert one(spark, s.partition_of(F.lit(12345)), s.partition_of(F.lit(256)), s.partition_of(F.lit(255))) == (57, 0, 255)
    assert one(spark, s.saturated(F.lit("99999999999999999999999").cast("decimal(38,0)")))[0] == 2**64 - 1
    assert one(spark, s.scaled(F.lit(1.25)), s.descaled(F.lit(5 * SCALE))) == (1_250_000, 5.0)
    assert one(spark, s.bit_test(s.bit_set(F.lit(0).cast("long"), 3), 3), s.bit_test(F.lit(4).cast("long"), 3)) == (True, False)


def test_epoch_ns_of_times_without_zone(spark):
    assert one(spark, s.epoch_ns(F.expr("timestamp_ntz'2024-01-01 00:00:01.000002'"))) == (1_704_067_201_000_002_000,)
