"""Timestamp expressions. All times are without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval


def compose_timestamp(day: Column, time: Column, default_time: str) -> Column:
    """Date plus 'HH:mm:ss' text; a missing time takes the default, a missing date gives NULL."""
    text = F.concat(day.cast("date").cast("string"), F.lit(" "), F.coalesce(time, F.lit(default_time)))
    return text.try_cast("timestamp_ntz")


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from `start` to `end` as BIGINT, the same in every session time zone."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    days = F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    return days * 86400 + (_second_of_day(end) - _second_of_day(start))


def lasts_longer(start: Column, end: Column, minimum: Interval | str) -> Column:
    """True when the stay outlasts `minimum`; an open end counts as far in the future."""
    span = Interval.of(minimum)
    if span.unbounded:
        raise ValueError("a stay cannot outlast an unbounded interval")
    far = F.coalesce(end.cast("timestamp_ntz"), F.lit("2099-01-01").cast("timestamp_ntz"))
    least = F.make_dt_interval(F.lit(span.days))
    if span.months:
        least = F.make_ym_interval(F.lit(0), F.lit(span.months))
    return far > start.cast("timestamp_ntz") + least
