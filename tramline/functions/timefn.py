"""Calendar, slot and service-day expressions. All work on Columns and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def dow_type(date: Column, holiday: Column | None = None) -> Column:
    """0 weekday, 1 Saturday (also a holiday one), 2 Sunday or holiday. A null holiday flag counts as no holiday."""
    off = F.coalesce(holiday, F.lit(False)) if holiday is not None else F.lit(False)
    return F.when(F.dayofweek(date) == 7, 1).when((F.dayofweek(date) == 1) | off, 2).otherwise(0)


def day_type(date: Column, holiday: Column | None = None) -> Column:
    """weekday, saturday, sunday or holiday; only a weekday can be a holiday."""
    off = F.coalesce(holiday, F.lit(False)) if holiday is not None else F.lit(False)
    return F.when(F.dayofweek(date) == 7, "saturday").when(F.dayofweek(date) == 1, "sunday").when(off, "holiday").otherwise("weekday")


def folded_day_type(kind: Column) -> Column:
    """The three-way type of timetables and calibrations: a holiday runs as a Sunday."""
    return F.when(kind == "holiday", "sunday").otherwise(kind)


def mon0_dow(date: Column) -> Column:
    """0 Monday .. 6 Sunday."""
    return (F.dayofweek(date) + 5) % 7


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def slot_5m(ts: Column) -> Column:
    return F.floor(minute_of_day(ts) / 5).cast("int")


def slot_30m(ts: Column) -> Column:
    return F.floor(minute_of_day(ts) / 30).cast("int")


def slot_5m_to_30m(slot: Column) -> Column:
    return F.floor(slot / 6).cast("int")


def hhmm_to_slot_5m(hhmm: Column) -> Column:
    """A number such as 935 (9:35) as a 5-minute slot."""
    return (F.floor(hhmm / 100) * 12 + F.floor(hhmm % 100 / 5)).cast("int")


def floor_5min(ts: Column) -> Column:
    """The start of the 5-minute slot, as the type of a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / 300) * 300)


def service_slot(hour: Column, late_until: int = 3) -> Column:
    """Hour labels of a service day: up to ``late_until`` it is "24~", to 5 "~06", else "HH-HH"."""
    h = hour.cast("int")
    return F.when(h <= late_until, "24~").when(h <= 5, "~06").otherwise(F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("-"), F.lpad((h + 1).cast("string"), 2, "0")))


def service_minutes(minutes: Column, first_hour: int = 4) -> Column:
    """Minutes of the service day: before ``first_hour`` the day before goes on."""
    return F.when(minutes >= first_hour * 60, minutes).otherwise(minutes + 1440)


def parse_minutes(clock: Column) -> Column:
    """Minutes of "HH:MM" or "HH:MM:SS"; null for anything else."""
    part = lambda i: F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int")
    return part(1) * 60 + part(2)


def minutes_to_slot30(minutes: Column) -> Column:
    """The label "HH:MM" of the half hour."""
    return label_of(F.floor(minutes / 30) * 30)


def minutes_to_bin5(minutes: Column) -> Column:
    return label_of(F.floor(minutes / 5) * 5)


def label_of(minutes: Column) -> Column:
    m = F.pmod(minutes.cast("int"), F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def half_hours(hour: Column) -> Column:
    """The two half-hour labels of an hour."""
    return F.array(label_of(hour * 60), label_of(hour * 60 + 30))


def hour_bucket(slot30: Column) -> Column:
    """The service hour label of a half-hour label."""
    return service_slot(F.substring(slot30, 1, 2).cast("int"))


def weather_time(date: Column, hhmm: Column) -> Column:
    """yyyyMMdd and a possibly unpadded hhmm as a timestamp; null if they are none."""
    return F.try_to_timestamp(F.concat(date, F.lpad(hhmm, 4, "0")), F.lit("yyyyMMddHHmm"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a period."""
    angle = value * (2 * PI / period)
    return F.sin(angle), F.cos(angle)


def target_time(ts: Column, minutes: int = 30) -> Column:
    return ts + F.expr(f"INTERVAL {minutes} MINUTES")


def in_operating_window(minutes: Column, begin: int, end: int) -> Column:
    """Whether a minute of day is in [begin, end); a window whose end is not after its begin passes midnight."""
    return (minutes >= begin) & (minutes < end) if begin < end else (minutes >= begin) | (minutes < end)


def last_open(ts: Column, begin: int, end: int) -> Column:
    """The last time at or before ``ts`` at which the window was open: ``ts`` itself, or the window's last end."""
    day = F.date_trunc("day", ts)
    after = minute_of_day(ts) >= end
    ended = F.when(after, day).otherwise(day - F.expr("INTERVAL 1 DAY")) + F.expr(f"INTERVAL {end} MINUTES")
    return F.when(in_operating_window(minute_of_day(ts), begin, end), ts).otherwise(ended)
