"""The grid of train and test as-of dates, generated by Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.functions.intervals import Interval


Setting = str | Sequence[str]


@dataclass(frozen=True)
class TemporalConfig:
    """How splits are laid out; the label bounds come from the data (or from literals) as a frame.

    Every setting may list several values (see `settings`). `label_timespans` stands for both label timespans.
    `feature_start` and `feature_end` bound the events that features may use, dates as text.
    """

    model_update_frequency: Setting
    training_label_timespan: Setting = ()
    test_label_timespan: Setting = ()
    training_frequency: Setting = "1day"
    test_frequency: Setting = "1day"
    max_training_history: Setting = "0day"
    test_duration: Setting = "0day"
    label_timespans: Setting = ()
    feature_start: str | None = None
    feature_end: str | None = None

    def settings(self) -> list[TemporalConfig]:
        """One configuration of single values for each combination, the last setting changing fastest."""
        listed = {f: (v,) if isinstance(v, str) else tuple(v) for f in LISTED for v in [getattr(self, f)]}
        both = (self.label_timespans,) if isinstance(self.label_timespans, str) else tuple(self.label_timespans)
        for name in ("training_label_timespan", "test_label_timespan"):
            listed[name] = listed[name] or both
        bounds = {"feature_start": self.feature_start, "feature_end": self.feature_end}
        return [TemporalConfig(**dict(zip(listed, values)), **bounds) for values in product(*listed.values())]


LISTED = [f.name for f in fields(TemporalConfig)][:7]


def _back(anchor: Column, limit: Column, step: Interval) -> Column:
    """`anchor`, `anchor - step`, ... while `>= limit`; always counted from the anchor."""
    steps = F.sequence(F.lit(0), step.steps_between(limit, anchor))
    return F.filter(F.transform(steps, lambda k: step.before(anchor, k)), lambda d: d >= limit)


def _onward(anchor: Column, limit: Column, step: Interval) -> Column:
    steps = F.sequence(F.lit(0), step.steps_between(anchor, limit))
    return F.filter(F.transform(steps, lambda k: step.after(anchor, k)), lambda d: d <= limit)


def label_bounds(events: DataFrame, ts: str) -> DataFrame:
    """First label date and the day after the last one, read off the data."""
    return events.agg(
        F.min(ts).cast("date").alias("label_start"), F.date_add(F.max(ts).cast("date"), 1).alias("label_end")
    )


def asof_spine(bounds: DataFrame, config: TemporalConfig) -> DataFrame:
    """`(split_id, role, as_of_date, label_timespan)` from `(label_start, label_end)`; newest split is 1.

    The newest split leaves room for the test labels; older ones follow every update frequency while a full
    training label window still fits. No training label window passes its split.
    """
    train_span = Interval.of(config.training_label_timespan)
    test_span = Interval.of(config.test_label_timespan)
    duration = Interval.of(config.test_duration)
    start, split = F.col("label_start"), F.col("split_date")

    newest = duration.before(test_span.before(F.col("label_end")))
    splits = bounds.select(
        "label_start",
        F.posexplode(_back(newest, train_span.after(start), Interval.of(config.model_update_frequency))).alias(
            "position", "split_date"
        ),
    )
    last_train = train_span.before(split)
    first_train = F.greatest(Interval.of(config.max_training_history).before(last_train), start)
    train = _back(last_train, first_train, Interval.of(config.training_frequency))
    test = _onward(split, duration.after(split), Interval.of(config.test_frequency))

    def part(role: str, days: Column, timespan: str) -> Column:
        return F.struct(F.lit(role).alias("role"), days.alias("days"), F.lit(timespan).alias("label_timespan"))

    roles = F.array(
        part("train", train, config.training_label_timespan), part("test", test, config.test_label_timespan)
    )
    return (
        splits.select((F.col("position") + 1).alias("split_id"), F.explode(roles).alias("part"))
        .select("split_id", "part.role", F.explode("part.days").alias("as_of_date"), "part.label_timespan")
    )


def known_from(events: DataFrame, config: TemporalConfig) -> DataFrame:
    """Events `(..., knowledge_date)` between the configured feature start and end."""
    for end, rule in ((config.feature_start, ">="), (config.feature_end, "<")):
        events = events.filter(f"knowledge_date {rule} date '{end}'") if end else events
    return events


def asof_spines(bounds: DataFrame, config: TemporalConfig) -> DataFrame:
    """The spines of all combinations of listed settings, numbered from 1 by `setting_id`."""
    parts = [asof_spine(bounds, s).withColumn("setting_id", F.lit(i)) for i, s in enumerate(config.settings(), 1)]
    return reduce(DataFrame.unionByName, parts)


def split_spans(spine: DataFrame, config: TemporalConfig) -> DataFrame:
    """Each date's label window and the box its split and role cover, newest split first."""
    train_span = Interval.of(config.training_label_timespan)
    test_span = Interval.of(config.test_label_timespan)
    day = F.col("as_of_date")
    label_end = F.when(F.col("role") == "train", train_span.after(day)).otherwise(test_span.after(day))
    box = Window.partitionBy("split_id", "role")
    return (
        spine.withColumn("label_end", label_end)
        .withColumn("box_start", F.min("as_of_date").over(box))
        .withColumn("box_end", F.max("label_end").over(box))
        .orderBy("split_id", "role", "as_of_date")
    )
