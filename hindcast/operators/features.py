"""Features over trailing intervals `[t - i, t)`, and time since the last event.

Events have `entity_id, knowledge_date` and attributes. All intervals and metrics of a group come out of one
scan and one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.timestamps import seconds_between
from hindcast.operators.asof import KEYS, Dates, Edges, first_date, known_before, last_date, slotted, within


@dataclass(frozen=True)
class Aggregate:
    """`column` None counts rows ('*'); `metrics` from count, sum, min, max, avg, last."""

    quantity: str
    metrics: tuple[str, ...]
    column: str | None = None


@dataclass(frozen=True)
class FeatureGroup:
    prefix: str
    aggregates: tuple[Aggregate, ...]
    intervals: tuple[str, ...]
    closed: str = "left"

    def names(self) -> list[str]:
        return [
            self.name(Interval.of(i), a, m) for i in self.intervals for a in self.aggregates for m in a.metrics
        ]

    def name(self, interval: Interval, aggregate: Aggregate, metric: str) -> str:
        return f"{self.prefix}_{interval.label}_{aggregate.quantity}_{metric}"


def feature_intervals(
    events: DataFrame, dates: Dates, *groups: FeatureGroup, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Every aggregate of the groups over every interval, per `(entity_id, as_of_date)` with an event in some interval.

    Groups over the same events share one scan; they must agree on `closed`. Events are aggregated per entity and slot
    first, so later rows do not grow with events. With listed dates the slots are then folded (`Edges.accumulated`):
    counts and exact sums of an interval are differences of running totals, and only extremes and inexact sums of
    limited intervals look at single slots again. 'last' takes the latest event, then the greatest `tiebreak`;
    intervals end together, so one latest event serves all.
    """
    if len({g.closed for g in groups}) != 1:
        raise ValueError("groups in one call must close their intervals on the same side")
    closed = groups[0].closed
    spans = {Interval.of(i) for g in groups for i in g.intervals}
    limited = sorted((s for s in spans if not s.unbounded), key=lambda s: s.label)
    longest = [] if any(s.unbounded for s in spans) else limited

    # Events become one row per entity and slot first; what each metric needs can be merged later.
    wanted = {(a.column, m) for g in groups for a in g.aggregates for m in a.metrics}
    merged = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    states = {}
    for column, metric in sorted(wanted, key=str):
        value = F.lit(1) if column is None else F.col(column)
        if metric == "last":
            states[f"_last_{column}"] = F.max(F.struct("knowledge_date", *tiebreak, F.col(column).alias("_value")))
            continue
        for part in ("sum", "count") if metric in ("avg", "sum") else (metric,):
            states[f"_{part}_{column}"] = merged[part](value)
    linked = events.filter(F.col("entity_id").isNotNull())
    bounded = slotted(_known(linked, dates, closed, longest), "knowledge_date", dates, closed, limited)
    slots = bounded.groupBy("entity_id", "_slot")
    if isinstance(dates, DataFrame):
        # Any time in a slot stands for all of it.
        found = slots.agg(F.max("knowledge_date").alias("knowledge_date"), *[s.alias(n) for n, s in states.items()])
        return _placed_intervals(known_before(found, "knowledge_date", dates, closed, longest), groups, states)
    found = slots.agg(F.count(F.lit(1)).alias("_rows"), *[s.alias(n) for n, s in states.items()])
    exact = {c for c, kind in events.dtypes if kind in INTEGRAL or kind.startswith("decimal")} | {None}
    return _folded_intervals(found, Edges(dates, closed, limited), limited, groups, states, exact)


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _metric(metric: str, column: str | None, part) -> Column:
    """A metric from the merged parts of its column."""
    if metric == "avg":
        return part("sum", column) / F.nullif(part("count", column), F.lit(0))
    if metric == "count":
        return F.coalesce(part("count", column), F.lit(0))
    return F.when(part("count", column) > 0, part("sum", column)) if metric == "sum" else part(metric, column)


def _folded_intervals(
    slots: DataFrame, edges: Edges, limited: Sequence[Interval], groups: Sequence[FeatureGroup], states: Mapping[str, Column],
    exact: set[str | None],
) -> DataFrame:
    running = {"_rows": "sum"} | {n: "max" if n.startswith("_last_") else n.split("_")[1].replace("count", "sum") for n in states}
    whole = [(Interval.of(i), g, a, m) for g in groups for i in g.intervals for a in g.aggregates for m in a.metrics]

    def by_slot(metric: str, column: str | None) -> bool:
        return metric in ("min", "max") or metric in ("sum", "avg") and column not in exact

    inner = sorted({limited.index(s) for s, _, a, m in whole if not s.unbounded and by_slot(m, a.column)})
    rows = edges.accumulated(slots, running, inner)
    kind, aggs = F.col("_kind"), {}

    def total(name: str, at: int) -> Column:
        aggs[f"{name}@{at}"] = F.max(F.when(kind == at, F.col(f"_run{name}")))
        return F.col(f"`{name}@{at}`")

    def within_window(name: str, span: Interval) -> Column:
        """A sum over the window, by difference."""
        if span.unbounded:
            return total(name, 0)
        return total(name, 0) - F.coalesce(total(name, limited.index(span) + 1), F.lit(0))

    outputs = []
    for span, group, a, metric in whole:

        def part(name: str, column: str | None, span=span) -> Column:
            state = f"_{name}_{column}"
            if not span.unbounded and name != "count" and by_slot(name, column):
                i = limited.index(span)
                inside = (kind == -1) & (F.col("_slot") >= edges.starting_slot(i))
                aggs[f"{state}@in{i}"] = {"sum": F.sum, "min": F.min, "max": F.max}[name](F.when(inside, F.col(state)))
                return F.col(f"`{state}@in{i}`")
            return within_window(state, span) if name in ("sum", "count") else total(state, 0)

        name = group.name(span, a, metric)
        if metric == "last":
            last = total(f"_last_{a.column}", 0)
            recent = F.lit(True) if span.unbounded else last["knowledge_date"] >= span.before(F.col("as_of_date"))
            outputs.append(F.when(recent, last["_value"]).alias(name))
        else:
            outputs.append(_metric(metric, a.column, part).alias(name))
    spans = {s for s, *_ in whole}
    some = reduce(Column.__or__, [within_window("_rows", s) > 0 for s in spans])
    return rows.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggs.items()]).filter(some).select(*KEYS, *outputs)


def _placed_intervals(placed: DataFrame, groups: Sequence[FeatureGroup], states: Mapping[str, Column]) -> DataFrame:
    """The same from slots placed on every date that knows them, for dates that come as a frame."""
    at, t = F.col("knowledge_date"), F.col("as_of_date")
    final = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    aggs, outputs = [F.max(n).alias(n) for n in states if n.startswith("_last_")], []
    for group in groups:
        for span in map(Interval.of, group.intervals):
            inside = F.lit(True) if span.unbounded else at >= span.before(t)
            for a in group.aggregates:
                for metric in a.metrics:
                    name = group.name(span, a, metric)
                    if metric == "last":
                        recent = F.lit(True) if span.unbounded else F.col(f"_last_{a.column}.knowledge_date") >= span.before(t)
                        outputs.append(F.when(recent, F.col(f"_last_{a.column}._value")).alias(name))
                        continue
                    part = lambda p, column, inside=inside: final[p](F.when(inside, F.col(f"_{p}_{column}")))
                    aggs.append(_metric(metric, a.column, part).alias(name))
                    outputs.append(F.col(name))
    return placed.groupBy(*KEYS).agg(*aggs).select(*KEYS, *outputs)


def _known(events: DataFrame, dates: Dates, closed: str, longest: Sequence[Interval] = (), ts: str = "knowledge_date") -> DataFrame:
    """Events that some date can know: the others need not be aggregated."""
    at, end = F.col(ts), last_date(dates)
    starts = [span.before(first_date(dates)) for span in longest]
    start = (F.least(*starts) if len(starts) > 1 else starts[0]) if starts else None
    known = events.filter(within(events, start, end)).filter(at <= end if closed == "right" else at < end)
    return known if start is None else known.filter(at >= start)


def impute_constant(cohort: DataFrame, features: DataFrame, names: Sequence[str], value: float = 0) -> DataFrame:
    """Features for every cohort row; missing ones get `value` and a 1 in `<name>_imp`."""
    return fill_missing(cohort.select(*KEYS).join(features, KEYS, "left"), names, value)


def fill_missing(rows: DataFrame, names: Sequence[str], value: float = 0) -> DataFrame:
    flags = {f"{n}_imp": F.col(n).isNull().cast("int") for n in names}
    return rows.withColumns(flags).fillna(value, list(names))


def time_since_known(events: DataFrame, ts: str, name: str, dates: Dates) -> DataFrame:
    """Seconds from the last event known at `t` to `t`, for every entity with one."""
    rows = _known(events.filter(F.col("entity_id").isNotNull()), dates, "right", ts=ts).select("entity_id", ts)
    last = _latest_known(rows, ts, dates, {"_latest": F.max(ts)})
    return last.select(*KEYS, seconds_between(F.col("_latest"), F.col("as_of_date")).alias(name))


def _latest_known(rows: DataFrame, ts: str, dates: Dates, greatest: Mapping[str, Column]) -> DataFrame:
    """Per entity and date the `greatest` (maxima) over all rows up to `t`."""
    slots = slotted(rows, ts, dates, "right").groupBy("entity_id", "_slot")
    if isinstance(dates, DataFrame):
        found = slots.agg(F.max(ts).alias(ts), *[c.alias(n) for n, c in greatest.items()])
        return known_before(found, ts, dates, "right").groupBy(*KEYS).agg(*[F.max(n).alias(n) for n in greatest])
    found = slots.agg(*[c.alias(n) for n, c in greatest.items()])
    folded = Edges(dates, "right").accumulated(found, {n: "max" for n in greatest})
    return folded.select(*KEYS, *[F.col(f"_run{n}").alias(n) for n in greatest])


def feature_time_since_last(
    events: DataFrame, cohort: DataFrame, ts: str, name: str, dates: Dates | None = None
) -> DataFrame:
    """Seconds from the last event to `t` for cohort rows.

    With `dates` the last event known at `t` counts. Without, the last event of all time decides and the row
    is dropped when that lies after `t`, so later knowledge shows: only for comparing with old results.
    """
    rows = events.filter(F.col("entity_id").isNotNull())
    members = cohort.select(*KEYS)
    if dates is not None:
        return members.join(time_since_known(events, ts, name, dates), KEYS)
    last = rows.groupBy("entity_id").agg(F.max(ts).alias("_last"))
    joined = members.join(last, "entity_id").filter(F.col("_last") <= F.col("as_of_date"))
    return joined.select(*KEYS, seconds_between(F.col("_last"), F.col("as_of_date")).alias(name))


def feature_time_since_any(
    log: DataFrame, cohort: DataFrame, base: str, name: str, dates: Dates | None = None, positive_only: bool = False
) -> DataFrame:
    """Seconds since the latest record of any signal source, for entities with a sign of 1 somewhere.

    Entities need a row of the `base` signal. Dates of all records count; `positive_only` keeps those of
    positive ones. `dates` works as in `feature_time_since_last`.
    """
    rows = log.filter("sign = 1 or signal = '%s'" % base) if positive_only else log
    dated = F.when(F.col("sign") == 1, F.col("event_ts")) if positive_only else F.col("event_ts")
    aggs = {"_last": F.max(dated), "_sign": F.max("sign"), "_based": F.max(F.col("signal") == base)}
    members = cohort.select(*KEYS)
    if dates is not None:
        joined = members.join(_latest_known(_known(rows, dates, "right", ts="event_ts"), "event_ts", dates, aggs), KEYS)
    else:
        joined = members.join(rows.groupBy("entity_id").agg(*[c.alias(n) for n, c in aggs.items()]), "entity_id")
        joined = joined.filter(F.col("_last") <= F.col("as_of_date"))
    seconds = seconds_between(F.col("_last"), F.col("as_of_date")).alias(name)
    return joined.filter("_based and _sign = 1").select(*KEYS, seconds)


def feature_demographics(people: DataFrame, key: str, number: str, categories: Sequence[str]) -> DataFrame:
    """Per source id: mean of a number and the greatest value of each category."""
    return people.groupBy(key).agg(F.avg(number).alias(f"avg_{number}"), *[F.max(c).alias(c) for c in categories])


def feature_score_extrema(outcomes: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    return outcomes.groupBy(key).agg(
        *[f(s).alias(f"{n}_{s}") for s in scores for n, f in (("max", F.max), ("min", F.min))]
    )


def feature_distinct_dates(events: DataFrame, key: str, ts: str) -> DataFrame:
    return events.groupBy(key).agg(F.countDistinct(ts).alias("n_dates"))


def feature_most_common(df: DataFrame, key: str, category: str) -> DataFrame:
    """Most frequent category per key; ties go to the smallest name."""
    counted = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(F.min_by(category, F.struct(-F.col("_n"), category)).alias(category))


def feature_source_frequency(crosswalk: DataFrame, source: str) -> DataFrame:
    """Hashed records per entity for one crosswalk tag."""
    return (
        crosswalk.filter(F.col("source") == source).groupBy("entity_id").agg(F.count("hash_key").alias("source_freq"))
    )
