"""Forward-looking labels over `[t, t + horizon]`, both ends included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.timestamps import lasts_longer
from hindcast.operators.asof import KEYS, Dates, upcoming
from hindcast.presets import LONG_STAY


def _long_starts(stays: DataFrame, minimum: str) -> DataFrame:
    rows = stays.filter(F.col("entity_id").isNotNull())
    return rows.filter(lasts_longer(F.col("start_ts"), F.col("end_ts"), minimum)).select("entity_id", "start_ts")


def label_reevent_long(
    stays: DataFrame, cohort: DataFrame, dates: Dates, horizon: str, minimum: str = LONG_STAY
) -> DataFrame:
    """1 if a stay longer than `minimum` starts in the horizon, else 0, for each cohort row."""
    events = upcoming(_long_starts(stays, minimum), "start_ts", dates, horizon)
    positive = events.groupBy(*KEYS).agg(F.lit(1).alias("label"))
    return cohort.select(*KEYS).join(positive, KEYS, "left").fillna(0, ["label"])


def label_reevent_any(stays: DataFrame, cohort: DataFrame, dates: Dates, horizon: str) -> DataFrame:
    """1 if any stay starts in the horizon, 0 if the entity has stays otherwise, NULL if it has none."""
    dated = stays.filter(F.col("entity_id").isNotNull() & F.col("start_ts").isNotNull())
    holders = dated.groupBy("entity_id").agg(F.lit(0).alias("known"))
    positive = upcoming(dated.select("entity_id", "start_ts"), "start_ts", dates, horizon)
    positive = positive.groupBy(*KEYS).agg(F.lit(1).alias("again"))
    return (
        cohort.select(*KEYS)
        .join(positive, KEYS, "left")
        .join(holders, "entity_id", "left")
        .select(*KEYS, F.coalesce("again", "known").alias("label"))
    )


def label_positive_only(stays: DataFrame, dates: Dates, horizon: str, minimum: str = LONG_STAY) -> DataFrame:
    """Only entities with a long stay in the horizon, all labelled 1."""
    events = upcoming(_long_starts(stays, minimum), "start_ts", dates, horizon)
    return events.select(*KEYS).distinct().withColumn("label", F.lit(1))


def label_simplified(
    stays: DataFrame, signs: DataFrame, seen: DataFrame, dates: Dates, horizon: str, minimum: str = LONG_STAY
) -> DataFrame:
    """Long re-event label for entities `seen` in the lookback with a sign of 1, free at `t` or not."""
    members = seen.select(*KEYS).join(signs.filter("sign = 1"), KEYS, "left_semi")
    return label_reevent_long(stays, members, dates, horizon, minimum)


def label_grid(
    stays: DataFrame, cohort: DataFrame, dates: Dates, timespans: Sequence[str], minimum: str = LONG_STAY
) -> DataFrame:
    """`(entity_id, as_of_date, label_timespan, label)` for every date and timespan in one job.

    Horizons share their start, so the first long stay from `t` on decides them all.
    """
    first = (
        upcoming(_long_starts(stays, minimum), "start_ts", dates, *timespans)
        .groupBy(*KEYS)
        .agg(F.min("start_ts").alias("first_start"))
    )
    return label_timespans(cohort.select(*KEYS).join(first, KEYS, "left"), timespans)


def label_timespans(rows: DataFrame, timespans: Sequence[str]) -> DataFrame:
    """One labelled row per timespan from rows with `first_start`, the next long stay's start if any."""
    answers = [
        F.struct(
            F.lit(text).alias("label_timespan"),
            F.coalesce(
                (F.col("first_start") <= Interval.of(text).after(F.col("as_of_date"))).cast("int"), F.lit(0)
            ).alias("label"),
        )
        for text in timespans
    ]
    placed = rows.withColumn("answer", F.explode(F.array(*answers)))
    return placed.select(*KEYS, "answer.label_timespan", "answer.label")


def label_positive_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count(F.when(F.col("label") == 1, 1)).alias("n_positive"))
