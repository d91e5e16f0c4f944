"""Time arithmetic on naive timestamps (the session time zone is pinned to UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    """Whole epoch seconds, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_seconds(sec: Column) -> Column:
    return F.timestamp_seconds(sec).cast("timestamp_ntz")


def floor_slot(ts: Column, step: int | Column) -> Column:
    """Start of the slot a stamp lies in, as epoch seconds."""
    width = F.lit(step) if isinstance(step, int) else step
    return (seconds(ts) - F.pmod(seconds(ts), width)).cast("long")


def round_slot(ts: Column, step: int | Column) -> Column:
    """Nearest slot as epoch seconds; a stamp half-way goes to the even slot."""
    width = (F.lit(step) if isinstance(step, int) else step).cast("long") * F.lit(MICROS)
    us = micros(ts)
    rest = F.pmod(us, width)
    index = ((us - rest) / width).cast("long")
    up = (rest * 2 > width) | ((rest * 2 == width) & (F.pmod(index, F.lit(2)) == 1))
    return ((index + up.cast("long")) * (width / F.lit(MICROS)).cast("long")).cast("long")


def second_of_day(text: Column) -> Column:
    """Seconds since midnight of an ``HH:MM:SS`` string; NULL when it does not parse."""
    part = lambda n: F.try_element_at(F.split(F.trim(text), ":"), F.lit(n)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0))


def parse_flexible(text: Column) -> Column:
    """ISO-8601 first, then ``ddMONyy:HH:MM:SS``, else NULL."""
    iso = text.try_cast("timestamp_ntz")
    sas = F.try_to_timestamp(F.initcap(F.lower(text)), F.lit("ddMMMyy:HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(iso, sas)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def cyclic(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day on a 1440-minute circle."""
    angle = F.lit(2.0) * F.pi() * minute_of_day(ts) / F.lit(1440)
    return F.sin(angle), F.cos(angle)


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)
