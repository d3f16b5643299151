"""Need signals.

Every source yields rows of one log, `(entity_id, event_ts, signal, sign, undated)`. Windows, wide forms,
periods and recency are then single aggregations over the log instead of one join per source. `undated`
rows count at every date.

Logs of stored events keep their date and month, so bounds on a log reach the folders of every source in it. Rows
that count at every date are a log of their own, so the dated ones beside them are still bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.tristate import any_answer, matches_without, strongest, yes_no
from hindcast.operators.asof import (
    EVENT_DATE,
    EVENT_MONTH,
    KEYS,
    Dates,
    expand,
    first_date,
    in_period,
    last_date,
    stored_columns,
    within,
)
from hindcast.operators.cohorts import day


def _log(events: DataFrame, name: str, ts: str, sign: Column, undated: bool = False) -> DataFrame:
    return events.filter("entity_id is not null").select(
        F.expr("cast(entity_id as bigint) as entity_id"),
        F.expr(f"cast({ts} as timestamp_ntz) as event_ts"),
        F.expr(f"'{name}' as signal"),
        sign.cast("int").alias("sign"),
        F.expr("true" if undated else "false").alias("undated"),
        *stored_columns(events),
    )


def flag_log(events: DataFrame, name: str, ts: str, flag: str) -> DataFrame:
    """A 0/1/NULL column as it is."""
    return _log(events, name, ts, F.col(flag))


def answers_log(events: DataFrame, name: str, ts: str, answers: Sequence[str], reversed_answers: Sequence[str]) -> DataFrame:
    return _log(events, name, ts, any_answer(answers, reversed_answers))


def yes_no_log(events: DataFrame, name: str, ts: str, flag: str) -> DataFrame:
    return _log(events, name, ts, yes_no(F.col(flag)))


def regex_log(events: DataFrame, name: str, ts: str, text: str, pattern: str) -> DataFrame:
    return _log(events.filter(F.col(text).rlike(pattern)), name, ts, F.lit(1))


def regex_exclude_log(
    events: DataFrame, name: str, ts: str, texts: Sequence[str], pattern: str, exclusion: str
) -> DataFrame:
    return _log(events.filter(matches_without(texts, pattern, exclusion)), name, ts, F.lit(1))


def in_list_log(events: DataFrame, name: str, ts: str, category: str, wanted: Sequence[str]) -> DataFrame:
    return _log(events.filter(F.col(category).isin(*wanted)), name, ts, F.lit(1))


def ilike_log(
    events: DataFrame, name: str, ts: str, text: str, patterns: Sequence[str], as_written: bool = False
) -> DataFrame:
    """Text like any pattern. `as_written`: only the last pattern is tied to the date window."""
    hits = [F.col(text).ilike(p) for p in patterns]
    if not as_written or len(hits) == 1:
        return _log(events.filter(reduce(Column.__or__, hits)), name, ts, F.lit(1))
    always = reduce(Column.__or__, hits[:-1])
    dated = _log(events.filter(hits[-1] & ~always), name, ts, F.lit(1))
    return signal_log(dated, _log(events.filter(always), name, ts, F.lit(1), undated=True))


def presence_log(events: DataFrame, name: str, ts: str) -> DataFrame:
    """Any record at all."""
    return _log(events, name, ts, F.lit(1))


def signal_log(*logs: DataFrame) -> DataFrame:
    """One log of all; if some are of stored events, the others get date and month from their timestamp."""
    day = F.col("event_ts").cast("date")
    derived = {EVENT_DATE: day, EVENT_MONTH: F.trunc(day, "month")}
    wanted = {c for log in logs for c in stored_columns(log)}
    whole = [log.withColumns({c: derived[c] for c in derived if c in wanted and c not in log.columns}) for log in logs]
    return reduce(DataFrame.unionByName, whole)


def _placed(log: DataFrame, dates: Dates, lookback: str) -> DataFrame:
    """Log rows on the dates whose `[t - lookback, t]` holds them."""
    span, at, undated = Interval.of(lookback), F.col("event_ts"), F.col("undated")
    low, high = span.before(first_date(dates)), last_date(dates)
    bounded = log.filter(undated | (within(log, low, high) & (at >= low) & (at <= high)))
    bounds = {"first": span.before, "last": lambda t: t}
    return expand(bounded, dates, bounds, lambda w: undated | ((at >= w["first"]) & (at <= w["last"])))


def signs_at(log: DataFrame, dates: Dates, lookback: str) -> DataFrame:
    """`(entity_id, as_of_date, sign)`: the strongest sign of the log's rows in the window."""
    return _placed(log, dates, lookback).groupBy(*KEYS).agg(F.max("sign").alias("sign"))


def signals_wide(log: DataFrame, names: Sequence[str], dates: Dates, lookback: str, cohort: DataFrame) -> DataFrame:
    """One row per cohort `(entity_id, as_of_date)`, one column per signal."""
    wide = _placed(log, dates, lookback).groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("signal") == name, F.col("sign"))).alias(name) for name in names]
    )
    return cohort.select(*KEYS).join(wide, KEYS, "left")


def signal_combine_greatest(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.select(*KEYS, strongest(*[F.col(n) for n in names]).alias("sign"))


def signs_by_period(log: DataFrame, periods: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per entity one sign per period `[from, to]`, NULL where unknown, for entities with a record in some period.

    One pass for all periods; records outside all of them are left out by date before anything is linked or grouped.
    """
    inside = _inside(periods)
    return (
        log.filter(_any_period(log, periods))
        .groupBy("entity_id")
        .agg(*[F.max(F.when(rule, F.col("sign"))).alias(name) for name, rule in inside.items()])
    )


def _inside(periods: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col("event_ts").between(day(a), day(b)) for name, (a, b) in periods.items()}


def _any_period(log: DataFrame, periods: Mapping[str, tuple[str, str]]) -> Column:
    """Rows of some period; the dates of stored events are bounded by the earliest and the latest day."""
    ends = [end for period in periods.values() for end in period]
    return in_period(log, min(ends, key=str), max(ends, key=str)) & reduce(Column.__or__, _inside(periods).values())


def signal_combine_zero_filled(log: DataFrame, periods: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Signs by period with unknown counted as 0, for entities with a record in some period."""
    return signs_by_period(log, periods).fillna(0, list(periods))


def signal_two_periods(log: DataFrame, periods: Mapping[str, tuple[str, str]], cohort: DataFrame) -> DataFrame:
    """Signs of cohort entities in a history and an outcome period, side by side; NULL where unknown.

    The cohort joins the log as marked rows, so one aggregation finds members and signs.
    """
    inside = _inside(periods)
    signs = log.filter(_any_period(log, periods)).select("entity_id", "event_ts", "sign")
    rows = signs.unionByName(cohort.select("entity_id", F.lit(True).alias("listed")), allowMissingColumns=True)
    found = rows.groupBy("entity_id").agg(
        F.max("listed").alias("listed"), *[F.max(F.when(rule, F.col("sign"))).alias(n) for n, rule in inside.items()]
    )
    return found.filter("listed").drop("listed")


def signal_presence(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """`(source_id, signal, sign)`: 1 for each id with any record, per named `(frame, id column)`."""
    rows = [
        df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("source_id"), F.lit(name).alias("signal"))
        for name, (df, key) in sources.items()
    ]
    return reduce(DataFrame.unionByName, rows).distinct().withColumn("sign", F.lit(1))


def signal_issue_calls(calls: DataFrame, key: str, issue: str, wanted: Sequence[str]) -> DataFrame:
    """Per source id: number of calls on a listed issue, and the flag that there is one."""
    return (
        calls.filter(F.col(issue).isin(*wanted))
        .groupBy(key)
        .agg(F.count(issue).alias("n_calls"))
        .withColumn("has_call", F.lit(1))
    )
