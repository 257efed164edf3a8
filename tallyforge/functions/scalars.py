"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.schemas import DEFAULT_PERIOD_NS, NS_PER_DAY, NS_PER_WEEK, PARTITIONS, SCALE

#: Fixed value: the 64-bit FNV-1a offset basis, as a signed long. The prime is 2 ** 40 + 435.
FNV_BASIS = -3750763034362895579
#: Fixed value: the largest unsigned 64-bit integer.
MAX_U64 = "18446744073709551615"


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes up to its first NUL, as a signed long.

    The product with the prime is put together from 32-bit halves, as a plain one would overflow under ANSI rules.
    """
    cut = F.hex(F.encode(F.substring_index(text, "\0", 1), "utf-8"))
    places = F.when(F.length(cut) > 0, F.sequence(F.lit(1), F.greatest(F.length(cut), F.lit(2)) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(cut, i, F.lit(2)), 16, 10).cast("long"))
    low = F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        part = x.bitwiseAND(low) * 435
        high = (F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(part, 32) + F.shiftleft(x.bitwiseAND(low), 8)).bitwiseAND(low)
        return F.shiftleft(high, 32).bitwiseOR(part.bitwiseAND(low))

    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), step)


def fixed_period(ts_ns: Column, period_ns: Column | int = DEFAULT_PERIOD_NS) -> Column:
    """Number of the fixed-length period since the epoch; anything at or before it is in period 0."""
    return F.when(ts_ns <= 0, F.lit(0).cast("long")).otherwise(div(ts_ns, period_ns))


def day_period(ts_ns: Column) -> Column:
    return fixed_period(ts_ns, NS_PER_DAY)


def week_period(ts_ns: Column) -> Column:
    """Weeks that start on Monday; the epoch was a Thursday."""
    return fixed_period(ts_ns + 3 * NS_PER_DAY, NS_PER_WEEK)


def civil_date(ts_ns: Column) -> Column:
    """The UTC date, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(div(ts_ns - F.pmod(ts_ns, F.lit(NS_PER_DAY)), NS_PER_DAY)).cast("int"))


def calendar_period(ts_ns: Column, cycle_day: Column | int = 1) -> Column:
    """Months since January 2000 of the billing month, which starts on the cycle day (0 counts as 1)."""
    day = F.lit(cycle_day) if isinstance(cycle_day, int) else cycle_day
    day = F.when(day == 0, 1).otherwise(day)
    date = civil_date(ts_ns)
    months = (F.year(date) - 2000) * 12 + F.month(date) - 1 - F.when(F.dayofmonth(date) < day, 1).otherwise(0)
    return F.when(ts_ns <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0), months).cast("long"))


def resolve_period(ts_ns: Column, period_type: Column, cycle_day: Column, period_ns: Column) -> Column:
    """The period of a metric's own kind; an unknown kind is fixed, a length of 0 is 30 days."""
    length = F.when(F.coalesce(period_ns, F.lit(0)) == 0, F.lit(DEFAULT_PERIOD_NS)).otherwise(period_ns)
    kinds = F.when(period_type == "calendar", calendar_period(ts_ns, F.coalesce(cycle_day, F.lit(0))))
    return kinds.when(period_type == "day", day_period(ts_ns)).when(period_type == "week", week_period(ts_ns)).otherwise(fixed_period(ts_ns, length))


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp without zone, or of one in a UTC session."""
    micros = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
    return (micros + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")) * 1000


def scaled(value: Column) -> Column:
    """A decimal quantity in millionths."""
    return F.round(value * SCALE).cast("long")


def descaled(value: Column) -> Column:
    return value / F.lit(SCALE)


def saturated(total: Column) -> Column:
    """A wide sum as an unsigned 64-bit one that stops at its largest value."""
    return F.least(total.cast("decimal(38,0)"), F.lit(MAX_U64).cast("decimal(38,0)")).cast("decimal(20,0)")


def uuid7_ms(uuid_hex: Column) -> Column:
    """Milliseconds since the epoch in the top 48 bits of a UUIDv7 in hex, with or without dashes."""
    return F.conv(F.substring(F.replace(uuid_hex, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid7(ms: Column, *parts: Column) -> Column:
    """A UUIDv7 in hex with dashes: 48 bits of milliseconds, version 7, and bits that hashes of the parts stand in for, so that the
    same event gets the same one."""
    low, high = F.xxhash64(*parts, F.lit("a")), F.xxhash64(*parts, F.lit("b"))
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    time = digits(ms.bitwiseAND(F.lit((1 << 48) - 1)), 12)
    rest = digits(high.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(-(1 << 63))), 16)
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), digits(low.bitwiseAND(F.lit(0xFFF)), 3)), F.substring(rest, 1, 4), F.substring(rest, 5, 12))


def partition_of(account_id: Column, partitions: int = PARTITIONS) -> Column:
    return F.pmod(account_id, F.lit(partitions)).cast("int")


def event_checksum(offset: Column, ts_ns: Column, account_id: Column, metric_code: Column, value: Column, operation_type: Column) -> Column:
    """CRC-32 of an event's fields, joined by NUL bytes."""
    return F.crc32(F.encode(F.concat_ws("\0", *(c.cast("string") for c in (offset, ts_ns, account_id, metric_code, value, operation_type))), "utf-8"))


def bit_set(flags: Column, bit: int) -> Column:
    return flags.bitwiseOR(F.lit(1 << bit).cast("long"))


def bit_test(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit).cast("long")) != 0
