"""Interval texts such as '5yr', '6 months' or 'all', and calendar shifts by them."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"yr": (12, 0), "year": (12, 0), "month": (1, 0), "week": (0, 7), "day": (0, 1)}


@dataclass(frozen=True)
class Interval:
    """A calendar span of whole months or whole days; `unbounded` stands for the text 'all'."""

    months: int = 0
    days: int = 0
    label: str = ""
    unbounded: bool = False

    @classmethod
    def of(cls, value: Interval | str) -> Interval:
        if isinstance(value, Interval):
            return value
        text = value.strip().lower()
        if text == "all":
            return cls(label="all", unbounded=True)
        match = re.fullmatch(r"(\d+)\s*([a-z]+?)s?", text)
        if not match or match[2] not in _UNITS:
            raise ValueError(f"not an interval: {value!r}")
        count, unit = int(match[1]), match[2]
        months, days = _UNITS[unit]
        return cls(count * months, count * days, f"{count}{unit[0]}")

    def after(self, day: Column, times: Column | int = 1) -> Column:
        """`day` moved forward; month ends clamp the way SQL interval arithmetic clamps them."""
        return self._moved(day, times, 1)

    def before(self, day: Column, times: Column | int = 1) -> Column:
        return self._moved(day, times, -1)

    def _moved(self, day: Column, times: Column | int, sign: int) -> Column:
        if self.unbounded:
            raise ValueError("an unbounded interval has no end")
        if self.months:
            day = F.add_months(day, F.lit(sign * self.months) * times)
        if self.days:
            day = F.date_add(day, F.lit(sign * self.days) * times)
        return day

    def day_before(self, day: date) -> date:
        """`before` for a date of the driver's."""
        if self.unbounded:
            raise ValueError("an unbounded interval has no end")
        month = day.year * 12 + day.month - 1 - self.months
        last = monthrange(month // 12, month % 12 + 1)[1]
        return date(month // 12, month % 12 + 1, min(day.day, last)) - timedelta(self.days)

    def steps_between(self, low: Column, high: Column) -> Column:
        """At least as many whole steps as fit from `low` to `high`, never negative."""
        if self.months:
            steps = F.months_between(high, low) / self.months
        else:
            steps = F.datediff(high, low) / self.days
        return F.greatest(F.lit(0), F.ceil(steps).cast("int"))
