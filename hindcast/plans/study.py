"""The study end to end: cohort, need, labels, features, matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.timestamps import lasts_longer
from hindcast.operators.asof import KEYS, Dates, expand, farthest, first_date, last_date, within
from hindcast.operators.evaluation import Cuts, evaluate, top_k_vs_random
from hindcast.operators.features import FeatureGroup, feature_intervals, fill_missing, time_since_known
from hindcast.operators.labels import label_timespans
from hindcast.operators.matrix import matrix_build
from hindcast.operators.models import ModelSpec, model_grid
from hindcast.operators.spine import TemporalConfig, asof_spine, asof_spines, known_from
from hindcast.presets import LONG_STAY
from hindcast.sources.sinks import through_storage


def cohort_facts(
    stays: DataFrame, log: DataFrame, dates: Dates, lookback: str, horizons: Sequence[str], minimum: str = LONG_STAY
) -> DataFrame:
    """The cohort in need with the start of each member's next long stay, `first_start`.

    Members are free at `t` after their latest stay and show a need in the lookback. Stays and signs travel as
    rows of one log, each placed on the dates it matters to; a single aggregation by entity and date then
    settles cohort, need and label, where joining the three would aggregate and shuffle each by itself.
    """
    span, end = Interval.of(lookback), farthest(horizons)
    at, t, undated = F.col("event_ts"), F.col("as_of_date"), F.col("undated")
    earliest, latest = span.before(first_date(dates)), last_date(dates)
    start = F.col("start_ts")
    rows = (
        stays.filter("entity_id is not null")
        .filter(within(stays, earliest, end(latest)))
        .filter((start >= earliest) & (start <= end(latest)))
        .select(
            "entity_id",
            start.alias("event_ts"),
            "end_ts",
            lasts_longer(start, F.col("end_ts"), minimum).alias("is_long"),
            F.lit(True).alias("is_stay"),
            F.lit(None).cast("int").alias("sign"),
            F.lit(False).alias("undated"),
        )
        .unionByName(
            # only a sign of 1 can make a member; other rows need not be shuffled
            log.filter("sign = 1")
            .filter(undated | (within(log, earliest, latest) & (at >= earliest) & (at <= latest)))
            .selectExpr(
                "entity_id", "event_ts", "cast(null as timestamp_ntz) as end_ts", "false as is_long",
                "false as is_stay", "sign", "undated",
            )
        )
    )
    bounds = {"first": span.before, "now": lambda d: d, "last": end}
    placed = expand(
        rows,
        dates,
        bounds,
        lambda w: undated
        | ((at >= w["first"]) & (at <= w["now"]))
        | (F.col("is_long") & (at >= w["now"]) & (at <= w["last"])),
    )
    seen, ahead = F.col("is_stay") & (at <= t), F.col("is_long") & (at >= t)
    return (
        placed.groupBy(*KEYS)
        .agg(
            F.max(F.when(seen, at)).alias("latest"),
            F.max(F.when(seen & (F.col("end_ts") < t), at)).alias("latest_closed"),
            F.max("sign").alias("sign"),
            F.min(F.when(ahead, at)).alias("first_start"),
        )
        .filter("latest = latest_closed and sign = 1")
        .select(*KEYS, "first_start")
    )


def labelled_cohort(
    stays: DataFrame, log: DataFrame, dates: Dates, lookback: str, horizon: str, minimum: str = LONG_STAY
) -> DataFrame:
    """The label query: long re-event within the horizon for the cohort in need."""
    facts = cohort_facts(stays, log, dates, lookback, [horizon], minimum)
    return facts.select(*KEYS, F.col("first_start").isNotNull().cast("int").alias("label"))


def labelled_grid(
    stays: DataFrame, log: DataFrame, dates: Dates, lookback: str, timespans: Sequence[str], minimum: str = LONG_STAY
) -> DataFrame:
    """The label query for every date and timespan in one job."""
    return label_timespans(cohort_facts(stays, log, dates, lookback, timespans, minimum), timespans)


@dataclass(frozen=True)
class EventFeatures:
    """Features over one source of events `(entity_id, knowledge_date, ...)`: groups, and time since the last one."""

    groups: Sequence[FeatureGroup] = ()
    recency: str | None = None
    tiebreak: Sequence[str] = ()

    def names(self) -> list[str]:
        return [n for g in self.groups for n in g.names()] + ([self.recency] if self.recency else [])

    def build(self, events: DataFrame, dates: Dates) -> list[DataFrame]:
        parts = [feature_intervals(events, dates, *self.groups, tiebreak=self.tiebreak)] if self.groups else []
        return parts + ([time_since_known(events, "knowledge_date", self.recency, dates)] if self.recency else [])


@dataclass(frozen=True)
class Study:
    """`groups` are features over the stays, `sources` those over other events by the name of the source.

    Settings of `temporal` that list several values give a spine and matrices for each combination, told by `setting_id`.
    """

    temporal: TemporalConfig
    lookback: str
    groups: Sequence[FeatureGroup]
    recency: str = "since_last_stay"
    sources: Mapping[str, EventFeatures] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        own = [n for g in self.groups for n in g.names()] + [self.recency]
        return own + [n for source in self.sources.values() for n in source.names()]

    def spine(self, bounds: DataFrame) -> DataFrame:
        settings = self.temporal.settings()
        return asof_spines(bounds, self.temporal) if len(settings) > 1 else asof_spine(bounds, settings[0])

    def matrices(
        self, stays: DataFrame, log: DataFrame, bounds: DataFrame, events: Mapping[str, DataFrame] | None = None
    ) -> DataFrame:
        """All train and test matrices of the grid as one frame; `events` has a frame for each of `sources`.

        Only events of entities in the labelled cohort are aggregated. The labels are stored first, since every
        group of features is narrowed by them. Labels and features of a date are computed once for all settings.
        """
        spine = self.spine(bounds)
        # The dates are a short list; as constants they prune stored events and stay inside generated code.
        days = [r["as_of_date"] for r in spine.select("as_of_date").distinct().collect()] or spine
        settings = self.temporal.settings()
        timespans = sorted({t for s in settings for t in (s.training_label_timespan, s.test_label_timespan)})
        labels = through_storage(labelled_grid(stays, log, days, self.lookback, timespans), "labels")
        members = labels.select("entity_id").distinct()
        own = EventFeatures(self.groups, self.recency, ["stay_id"])
        known = {"": stays.withColumnRenamed("start_ts", "knowledge_date"), **(events or {})}
        features = []
        for name, source in {"": own, **self.sources}.items():
            features += source.build(known_from(known[name], self.temporal).join(members, "entity_id", "left_semi"), days)
        return fill_missing(matrix_build(labels, features, spine), self.feature_names())

    def predictions(self, matrices: DataFrame, specs: Sequence[ModelSpec], splits: Sequence[int]) -> DataFrame:
        """Scores of every spec on every split; pass stored matrices."""
        return model_grid(matrices, self.feature_names(), specs, splits)


def held_out_precision(predictions: DataFrame, k: int = 100) -> DataFrame:
    """Precision in the top k of each model, split and test date beside the base rate."""
    return top_k_vs_random(predictions.filter("role = 'test'"), ["model_id", "split_id", "as_of_date"], k)


def evaluation_table(predictions: DataFrame, cuts: Cuts = Cuts((100,), ())) -> DataFrame:
    """`evaluations` as a run leaves them behind: metrics of each model, split and test date."""
    rows = predictions.filter("role = 'test'").withColumnRenamed("as_of_date", "evaluation_end_time")
    return evaluate(rows, ["model_id", "split_id", "evaluation_end_time"], cuts)
