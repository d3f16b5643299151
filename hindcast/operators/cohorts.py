"""Cohorts and stay status. Stays have `entity_id, stay_id, start_ts, end_ts`; a NULL end is still open."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.timestamps import lasts_longer, seconds_between
from hindcast.operators.asof import EVENT_END, KEYS, Dates, first_date, in_period, known_within, last_date, within
from hindcast.presets import LONG_STAY


def day(value: str | date) -> Column:
    return F.lit(date.fromisoformat(value) if isinstance(value, str) else value)


def _linked(stays: DataFrame) -> DataFrame:
    return stays.filter(F.col("entity_id").isNotNull())


def cohort_table(stays: DataFrame, dates: Dates, lookback: str) -> DataFrame:
    """Entities with a stay starting in `[t - lookback, t]`; active if the latest one ended before `t`.

    Two maxima decide it: the latest start, and the latest start among stays already closed. They are equal
    exactly when some stay at the latest start is closed, so there is no sort and no self-join.
    """
    start = F.col("start_ts")
    seen = known_within(_linked(stays), "start_ts", dates, lookback)
    latest = seen.groupBy(*KEYS).agg(
        F.max(start).alias("latest"),
        F.max(F.when(F.col("end_ts") < F.col("as_of_date"), start)).alias("latest_closed"),
    )
    return latest.select(*KEYS, F.coalesce(F.col("latest") == F.col("latest_closed"), F.lit(False)).alias("active"))


def cohort_last_stay_closed(stays: DataFrame, dates: Dates, lookback: str) -> DataFrame:
    """Entities free at `t` whose latest stay of the lookback has ended."""
    return cohort_table(stays, dates, lookback).filter("active").select(*KEYS)


def cohort_last_long_stay_closed(
    stays: DataFrame, dates: Dates, lookback: str, minimum: str = LONG_STAY
) -> DataFrame:
    """Same, but only stays longer than `minimum` (or open) compete for the latest start.

    Any stay at that start may be the closed one, so stays are first reduced per start. Stays that start outside all
    lookbacks are left out before that.
    """
    start = F.col("start_ts")
    low, high = Interval.of(lookback).before(first_date(dates)), last_date(dates)
    per_start = (
        _linked(stays)
        .filter(within(stays, low, high))
        .filter((start >= low) & (start <= high))
        .groupBy("entity_id", "start_ts")
        .agg(F.max(lasts_longer(start, F.col("end_ts"), minimum)).alias("is_long"), F.min("end_ts").alias("first_end"))
        .filter("is_long")
    )
    seen = known_within(per_start, "start_ts", dates, lookback)
    return (
        seen.groupBy(*KEYS)
        .agg(
            F.max(start).alias("latest"),
            F.max(F.when(F.col("first_end") < F.col("as_of_date"), start)).alias("latest_closed"),
        )
        .filter("latest = latest_closed")
        .select(*KEYS)
    )


def cohort_any_closed_stay(stays: DataFrame, t0: str, t1: str) -> DataFrame:
    """Entities with a stay that started after `t0` and ended before `t1`.

    Stored stays are bounded by `t0` only: a stay may carry an end before its start, and still counts.
    """
    closed = (F.col("start_ts") > day(t0)) & (F.col("end_ts") < day(t1))
    return _linked(stays).filter(in_period(stays, t0, None)).filter(closed).select("entity_id").distinct()


def cohort_with_signal(cohort: DataFrame, signs: DataFrame) -> DataFrame:
    """Cohort rows whose entity has a sign of 1 at the same date in any source."""
    return cohort.join(signs.filter("sign = 1").select(*KEYS), KEYS, "left_semi")


def long_stay_in(t0: str | date | None, t1: str | date, minimum: str = LONG_STAY) -> Column:
    """A stay starting strictly between `t0` and `t1` that lasts longer than `minimum` or is open."""
    start = F.col("start_ts")
    inside = start < day(t1)
    if t0 is not None:
        inside = inside & (start > day(t0))
    return inside & lasts_longer(start, F.col("end_ts"), minimum)


def stay_count_window(stays: DataFrame, windows: Mapping[str, tuple[str, str]], minimum: str = LONG_STAY) -> DataFrame:
    """Long stays per entity in each named window, in one pass; entities with none are left out."""
    rules = {name: long_stay_in(t0, t1, minimum) for name, (t0, t1) in windows.items()}
    some = F.lit(False)
    for rule in rules.values():
        some = some | rule
    starts, ends = zip(*windows.values(), strict=True)
    return (
        _linked(stays)
        .filter(in_period(stays, min(starts, key=str), max(ends, key=str)))
        .filter(some)
        .groupBy("entity_id")
        .agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])
    )


def stay_count_before(stays: DataFrame, t: str, minimum: str = LONG_STAY) -> DataFrame:
    """Long stays begun before `t` for every stay holder, zero included."""
    return (
        _linked(stays).groupBy("entity_id").agg(F.count(F.when(long_stay_in(None, t, minimum), 1)).alias("n_stays"))
    )


def ends_from(stays: DataFrame, t: str | date) -> Column:
    """A bound on the stored day of the end: open, or ended on the day `t` or later; always true for other stays."""
    if EVENT_END not in stays.columns:
        return F.lit(True)
    return F.col(EVENT_END).isNull() | (F.col(EVENT_END) >= day(t))


def open_stays(stays: DataFrame, t: str) -> DataFrame:
    """Linked stays open at `t`; stored ones are bounded by the days of start and end."""
    return _linked(stays).filter(in_period(stays, None, t)).filter(ends_from(stays, t)).filter(open_at(t))


def open_at(t: str) -> Column:
    return (F.col("start_ts") < day(t)) & (F.col("end_ts").isNull() | (F.col("end_ts") > day(t)))


def status_as_of(stays: DataFrame, t: str) -> DataFrame:
    """Entities with a stay open at `t`."""
    return open_stays(stays, t).select("entity_id").distinct().withColumn("in_stay", F.lit(1))


def status_report(stays: DataFrame, t: str, now: str) -> DataFrame:
    """Every stay record beside its holder's first stay open at `t`; open stays last until `now`."""
    start, end = F.col("current_start"), F.col("current_end")
    current = (
        open_stays(stays, t)
        .groupBy("entity_id")
        .agg(F.min(F.struct("start_ts", "stay_id", "end_ts")).alias("first"))
        .select(
            "entity_id",
            F.lit(1).alias("in_stay"),
            F.col("first.start_ts").alias("current_start"),
            F.col("first.end_ts").alias("current_end"),
        )
        .withColumn("duration_s", seconds_between(start, F.coalesce(end, day(now).cast("timestamp_ntz"))))
    )
    return (
        stays.select("entity_id", "stay_id")
        .join(current, "entity_id", "left")
        .withColumn("in_stay", F.coalesce("in_stay", F.lit(0)))
        .orderBy(F.desc("in_stay"), F.desc_nulls_first("duration_s"))
    )


def status_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("in_stay").agg(F.count("entity_id").alias("n_rows"))


def base_rate_flags(
    universe: DataFrame, stays: DataFrame, log: DataFrame, t0: str, t1: str, t2: str, minimum: str = LONG_STAY
) -> DataFrame:
    """Per entity of the universe: stay counts before and after `t1`, status at `t1`, signs, cohort, outcome.

    Universe, stays and signs travel as rows of one log, so a single aggregation by entity does it all. Stays and
    signs outside the periods are left out by date first; a stay of any age may be open at `t1`, so stored stays have
    no lower bound but their end, if it is stored as a date (see `sinks.store_events`).
    """
    sign_in = {
        "sign_history": F.col("event_ts").between(day(t0), day(t1)),
        "sign_outcome": F.col("event_ts").between(day(t1), day(t2)),
    }
    rows = (
        universe.select("entity_id", F.lit(True).alias("listed"))
        .unionByName(
            _linked(stays)
            .filter(in_period(stays, None, F.greatest(day(t1), day(t2))))
            .filter(in_period(stays, t0, None) | ends_from(stays, t1))
            .filter((F.col("start_ts") < F.greatest(day(t1), day(t2))) & ((F.col("start_ts") > day(t0)) | open_at(t1)))
            .select(
                "entity_id",
                F.when(long_stay_in(t0, t1, minimum), 1).alias("before"),
                F.when(long_stay_in(t1, t2, minimum), 1).alias("after"),
                F.when(open_at(t1), 1).alias("open"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            log.filter(in_period(log, F.least(day(t0), day(t1)), F.greatest(day(t1), day(t2))))
            .filter(F.col("event_ts").between(F.least(day(t0), day(t1)), F.greatest(day(t1), day(t2))))
            .select("entity_id", *[F.when(rule, F.col("sign")).alias(name) for name, rule in sign_in.items()]),
            allowMissingColumns=True,
        )
    )
    per_entity = (
        rows.groupBy("entity_id")
        .agg(
            F.max("listed").alias("listed"),
            F.count("before").alias("stays_before"),
            F.count("after").alias("stays_after"),
            F.coalesce(F.max("open"), F.lit(0)).alias("in_stay"),
            *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in sign_in],
        )
        .filter("listed")
        .drop("listed")
    )
    in_cohort = (F.col("stays_before") > 0) & (F.col("in_stay") == 0)
    shown = (F.col("sign_history") == 1) | (F.col("sign_outcome") == 1)
    return (
        per_entity.withColumn("cohort", in_cohort.cast("int"))
        .withColumn("outcome", (in_cohort & (F.col("stays_after") > 0) & shown).cast("int"))
        .withColumn("stayed_before", (F.col("stays_before") > 0).cast("int"))
        .withColumn("stayed_after", (F.col("stays_after") > 0).cast("int"))
    )


def base_rate_summary(flags: DataFrame) -> DataFrame:
    totals = ["cohort", "outcome", "sign_history", "sign_outcome", "stayed_before", "stayed_after"]
    return flags.agg(F.count("entity_id").alias("n_entities"), *[F.sum(c).alias(f"n_{c}") for c in totals])


def repeat_event_flag(stays: DataFrame) -> DataFrame:
    """Entities with more than one dated stay."""
    return (
        _linked(stays)
        .groupBy("entity_id")
        .agg(F.count("start_ts").alias("n_stays"))
        .filter("n_stays > 1")
        .select("entity_id", F.lit(1).alias("repeated"))
    )
