"""Placing events on as-of dates.

The as-of dates are a short list, so each event row is expanded in place to the dates whose window holds
it: there is no join with the dates and no shuffle before the first partial aggregation.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval

Dates = Sequence[str | date] | DataFrame
Shift = Callable[[Column], Column]

KEYS = ["entity_id", "as_of_date"]

# Columns of stored events (see `sources.sinks.store_events`).
EVENT_DATE, EVENT_MONTH, EVENT_END = "event_date", "event_month", "event_end"


def stored_columns(events: DataFrame) -> list[str]:
    return [c for c in (EVENT_DATE, EVENT_MONTH) if c in events.columns]


def _literals(dates: Dates) -> list[Column]:
    days = [date.fromisoformat(d) if isinstance(d, str) else d for d in dates]
    return [F.lit(d) for d in sorted(set(days))]


def first_date(dates: Dates) -> Column:
    """The earliest date: a literal, or a scalar subquery over a frame with `as_of_date`."""
    return dates.agg(F.min("as_of_date")).scalar() if isinstance(dates, DataFrame) else _literals(dates)[0]


def last_date(dates: Dates) -> Column:
    return dates.agg(F.max("as_of_date")).scalar() if isinstance(dates, DataFrame) else _literals(dates)[-1]


def within(events: DataFrame, low: Column | None, high: Column | None) -> Column:
    """Bounds on the date and month that stored events carry; always true for other events.

    Parquet row groups are not skipped by bounds on a timestamp without zone. Bounds on a DATE skip them, and
    bounds on the month skip whole folders.
    """
    rule = F.lit(True)
    for name, cut in ((EVENT_DATE, lambda d: d), (EVENT_MONTH, lambda d: F.trunc(d, "month"))):
        if name in events.columns:
            rule = rule if high is None else rule & (F.col(name) <= cut(high.cast("date")))
            rule = rule if low is None else rule & (F.col(name) >= cut(low.cast("date")))
    return rule


def in_period(events: DataFrame, low: str | date | Column | None, high: str | date | Column | None) -> Column:
    """`within` for a fixed period between two days."""

    def day(value: str | date | Column) -> Column:
        return value if isinstance(value, Column) else F.lit(date.fromisoformat(value) if isinstance(value, str) else value)

    return within(events, *(None if end is None else day(end) for end in (low, high)))


def expand(events: DataFrame, dates: Dates, bounds: Mapping[str, Shift], holds: Shift) -> DataFrame:
    """One row per event and as-of date for which `holds(window)` is true.

    A window is a struct of the date `t` and the named `bounds` of it. All of it is computed once per date,
    not per event, and reaches the events as a constant array.
    """

    def window(t: Column) -> Column:
        ends = [bound(t).cast("timestamp_ntz").alias(name) for name, bound in bounds.items()]
        return F.struct(t.alias("t"), *ends)

    if isinstance(dates, DataFrame):
        # a subquery may not stand inside a lambda function, so its value becomes a column first
        windows = dates.agg(F.collect_set(window(F.col("as_of_date")))).scalar()
        events, windows = events.withColumn("_windows", windows), F.col("_windows")
    else:
        windows = F.array(*[window(t) for t in _literals(dates)])
    placed = events.withColumn("_window", F.explode(F.filter(windows, holds)))
    return placed.withColumn("as_of_date", F.col("_window.t")).drop("_window", "_windows")


def known_within(events: DataFrame, ts: str, dates: Dates, lookback: Interval | str) -> DataFrame:
    """Events in `[t - lookback, t]`, both ends included."""
    span, at = Interval.of(lookback), F.col(ts)
    low, high = span.before(first_date(dates)), last_date(dates)
    bounded = events.filter(within(events, low, high)).filter((at >= low) & (at <= high))
    bounds = {"first": span.before, "last": lambda t: t}
    return expand(bounded, dates, bounds, lambda w: (at >= w["first"]) & (at <= w["last"]))


def _constant(values: Sequence, kind: str) -> Column:
    """A literal array, folded from one text, so that the plan does not grow with it."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


class Edges:
    """The ends `t` and `t - lookback` of all windows of listed dates, in order, and the slots between them.

    Slot k holds the events with k edges at or before them. Every window is a range of slots, so events of one slot
    can be aggregated before any date is met. With `closed='right'` the end of a window lies just after `t`.
    """

    def __init__(self, dates: Sequence[str | date], closed: str = "left", lookbacks: Sequence[Interval] = ()):
        self.days = sorted({date.fromisoformat(d) if isinstance(d, str) else d for d in dates})
        self.late = int(closed == "right")
        lows = [[span.day_before(d) for span in lookbacks] for d in self.days]
        self.edges = sorted({(d, self.late) for d in self.days} | {(low, 0) for row in lows for low in row})
        #: Per date its windows' end and beginnings, as the first slot that lies beyond them.
        self.ends = [self._rank(d, self.late) for d in self.days]
        self.starts = [[self._rank(low, 0) for low in row] for row in lows]

    def _rank(self, day: date, late: int) -> int:
        return bisect_right(self.edges, (day, late))

    def slot(self, at: Column) -> Column:
        """Looked up by day; edges at midnight and just after it need one table each."""
        at = at.cast("timestamp_ntz")
        parts = []
        for late in sorted({late for _, late in self.edges}):
            days = [d for d, own in self.edges if own == late]
            span = (days[-1] - days[0]).days + 1
            table = [bisect_right(days, days[0] + timedelta(k - 1)) for k in range(span + 1)]
            day = (at - F.expr("interval '0.000001' second") if late else at).cast("date")
            place = F.greatest(F.lit(0), F.least(F.lit(span), F.datediff(day, F.lit(days[0])) + 1))
            parts.append(F.get(_constant(table, "int"), F.when(at.isNotNull(), place)))
        return reduce(Column.__add__, parts)

    def _up_to(self, ranks: Sequence[int]) -> Column:
        """How many of the ascending `ranks` are at most k, by k."""
        return _constant([bisect_right(ranks, k) for k in range(len(self.edges) + 1)], "int")

    def accumulated(self, slots: DataFrame, running: Mapping[str, str], inner: Sequence[int] = ()) -> DataFrame:
        """Slots of entities, folded: per entity, date and `_kind` one row of `running` totals (sum, min or max).

        Kind 0 totals all slots before the window's end, kind i + 1 those before its beginning by lookback i; a window's
        sum is their difference. Each slot's totals go to just the edges that follow it before the entity's next slot,
        so there are as many rows as edges, however many slots. What cannot be differenced needs the slots themselves:
        kind -1 has those inside the windows of the lookbacks `inner`.
        """
        kinds = len(self.starts[0]) + 2
        by_slot = Window.partitionBy("entity_id").orderBy("_slot")
        so_far = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        marks = sorted(
            [(end, d * kinds) for d, end in enumerate(self.ends)]
            + [(start, d * kinds + i + 1) for d, row in enumerate(self.starts) for i, start in enumerate(row)]
        )
        passed = self._up_to([rank for rank, _ in marks])
        first = F.get(passed, F.col("_slot"))
        last = F.get(passed, F.coalesce(F.lead("_slot").over(by_slot), F.lit(len(self.edges))))
        rows = slots.select("*", first.alias("_first"), last.alias("_last_mark"), *[how[f](n).over(so_far).alias(f"_run{n}") for n, f in running.items()])
        codes = F.slice(_constant([code for _, code in marks], "int"), F.col("_first") + 1, F.col("_last_mark") - F.col("_first"))
        if inner:
            lows = sorted(min(row[i] for i in inner) for row in self.starts)
            ended, begun = F.get(self._up_to(self.ends), F.col("_slot")), F.get(self._up_to(lows), F.col("_slot"))
            inside = F.transform(F.sequence(ended, begun - 1), lambda d: d * kinds + (kinds - 1))
            codes = F.concat(codes, F.when(begun > ended, inside).otherwise(F.expr("array()").cast("array<int>")))
        rows = rows.withColumn("_code", F.explode(codes))
        number = F.floor(F.col("_code") / kinds).cast("int")
        kind = F.col("_code") % kinds
        return rows.select(
            "entity_id", F.get(_constant(self.days, "date"), number).alias("as_of_date"), "_slot", number.alias("_date"),
            F.when(kind == kinds - 1, -1).otherwise(kind).alias("_kind"), *[c for c in slots.columns if c not in ("entity_id", "_slot")],
            *[f"_run{n}" for n in running],
        )

    def starting_slot(self, lookback: int) -> Column:
        """The first slot inside the window of a row's date (`_date`) by this lookback."""
        return F.get(_constant([row[lookback] for row in self.starts], "int"), F.col("_date"))


def slotted(
    events: DataFrame, ts: str, dates: Dates, closed: str = "left", lookbacks: Sequence[Interval] = ()
) -> DataFrame:
    """Events with `_slot`, the number of the span between neighbouring window ends that holds them (see `Edges`)."""
    at = F.col(ts)
    if not isinstance(dates, DataFrame):
        return events.withColumn("_slot", Edges(dates, closed, lookbacks).slot(at))

    def ends(t: Column) -> list[Column]:
        own = t.cast("timestamp_ntz")
        own = own + F.expr("interval '0.000001' second") if closed == "right" else own
        return [own, *[span.before(t).cast("timestamp_ntz") for span in lookbacks]]

    edges = dates.agg(F.flatten(F.collect_set(F.array(*ends(F.col("as_of_date")))))).scalar()
    placed = events.withColumn("_edges", F.array_distinct(edges))
    return placed.withColumn("_slot", F.size(F.filter("_edges", lambda e: at >= e))).drop("_edges")


def known_before(
    events: DataFrame, ts: str, dates: Dates, closed: str = "left", lookbacks: Sequence[Interval] = ()
) -> DataFrame:
    """Events before `t`, not older than the longest of `lookbacks` if given; `closed='right'` includes `t`."""
    at = F.col(ts)

    def start(t: Column) -> Column:
        starts = [span.before(t) for span in lookbacks]
        return F.least(*starts) if len(starts) > 1 else starts[0]

    def known(end: Column) -> Column:
        return at <= end if closed == "right" else at < end

    bounded = events.filter(within(events, None, last_date(dates))).filter(known(last_date(dates)))
    if not lookbacks:
        return expand(bounded, dates, {"last": lambda t: t}, lambda w: known(w["last"]))
    bounded = bounded.filter(at >= start(first_date(dates)))
    bounds = {"first": start, "last": lambda t: t}
    return expand(bounded, dates, bounds, lambda w: (at >= w["first"]) & known(w["last"]))


def farthest(horizons: Sequence[Interval | str]) -> Shift:
    """The end of the farthest of several horizons that begin together."""
    spans = [Interval.of(h) for h in horizons]

    def end(t: Column) -> Column:
        ends = [span.after(t) for span in spans]
        return F.greatest(*ends) if len(ends) > 1 else ends[0]

    return end


def upcoming(events: DataFrame, ts: str, dates: Dates, *horizons: Interval | str) -> DataFrame:
    """Events in `[t, t + horizon]`, both ends included; with several horizons the farthest end counts."""
    at, end = F.col(ts), farthest(horizons)
    low, high = first_date(dates), end(last_date(dates))
    bounded = events.filter(within(events, low, high)).filter((at >= low) & (at <= high))
    bounds = {"first": lambda t: t, "last": end}
    return expand(bounded, dates, bounds, lambda w: (at >= w["first"]) & (at <= w["last"]))
