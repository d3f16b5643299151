"""A registered query: the Spark side, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fixtures.adapters import Tables, with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    views: tuple[str, ...] = ()

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(list(self.views), self.sql)


DATES = ["1999-01-01", "2000-07-01", "2001-01-01"]
LOOKBACK = "2 years"
HORIZON = "6 months"
TIMESPANS = ["6 months", "1yr"]

# The as-of dates with their window ends, for the SQL side.
SPINE = """
    spine as (
      select d as as_of_date, d - interval '2' year as lo, d + interval '6' month as hi, d + interval '1' year as hi_year
      from (values (date '1999-01-01'), (date '2000-07-01'), (date '2001-01-01')) v(d))"""
