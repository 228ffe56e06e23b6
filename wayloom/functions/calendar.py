"""Day types and minutes, by integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

# Holidays as month * 100 + day.
HOLIDAYS = (101, 411, 501, 725, 802, 815, 831, 915, 1201, 1225)


def local(ts, zone: str = "America/Costa_Rica") -> Column:
    return F.from_utc_timestamp(c(ts), zone)


def easter(year) -> Column:
    """Easter Sunday of the year (anonymous Gregorian computus)."""
    y = c(year).cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, cc = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(cc, 4) - h - cc % 4) % 7
    m = div(a + 11 * h + 22 * w, 451)
    n = h + w - 7 * m + 114
    return F.make_date(y, div(n, 31), n % 31 + 1)


def is_holiday(day) -> Column:
    """A fixed holiday, or Thursday or Friday before Easter."""
    d = c(day)
    before = F.datediff(easter(F.year(d)), d)
    return (F.month(d) * 100 + F.day(d)).isin(*HOLIDAYS) | before.isin(2, 3)


def day_type(day, holiday=None) -> Column:
    """feriado, domingo, sabado or habil; ``holiday``: a flag of the caller's in place of the calendar."""
    h = is_holiday(day) if holiday is None else c(holiday)
    dow = F.dayofweek(c(day))
    return F.when(h, "feriado").when(dow == 1, "domingo").when(dow == 7, "sabado").otherwise("habil")


def minute_of_day(ts) -> Column:
    return F.hour(c(ts)) * 60 + F.minute(c(ts))


def clock_minutes(text) -> Column:
    """Minutes of ``hh:mm[:ss]``; hours may pass 24, whole minutes of seconds count, seconds that aren't a number don't. Null without a number of hours and minutes."""
    number = lambda i: F.get(F.split(c(text), ":"), F.lit(i)).try_cast("int")
    return number(0) * 60 + number(1) + F.coalesce(F.floor(number(2) / 60), F.lit(0)).cast("int")
