import random
from datetime import date, datetime, timedelta

import pytest

from hindcast.functions.intervals import Interval
from hindcast.operators import features as X
from hindcast.operators.asof import slotted
from tests.conftest import tuples

EVENTS = "entity_id bigint, knowledge_date timestamp_ntz, id bigint, v int"
T = ["2000-01-01", "2001-01-01"]
GROUP = X.FeatureGroup("f", (X.Aggregate("n", ("count",)), X.Aggregate("v", ("min", "max", "avg", "last"), "v")), ("1 year", "all"))


def events(frame, *extra):
    return frame(
        EVENTS,
        (1, "1999-01-01 00:00:00", 1, 5), (1, "1998-12-31 23:59:59", 2, 9), (1, "2000-01-01 00:00:00", 3, 7),
        (2, "1990-01-01 00:00:00", 4, None), (None, "1999-01-01 00:00:00", 5, 1), *extra,
    )


def test_windows_are_half_open(frame):
    got = X.feature_intervals(events(frame), T, GROUP, tiebreak=["id"])
    assert tuples(got) == [
        (1, "2000-01-01", 1, 5, 5, 5.0, 5, 2, 5, 9, 7.0, 5),
        (1, "2001-01-01", 1, 7, 7, 7.0, 7, 3, 5, 9, 7.0, 7),
        (2, "2000-01-01", 0, None, None, None, None, 1, None, None, None, None),
        (2, "2001-01-01", 0, None, None, None, None, 1, None, None, None, None),
    ]
    assert got.columns[2:] == GROUP.names()


def test_closed_right_and_ties_for_last(frame):
    group = X.FeatureGroup("f", (X.Aggregate("v", ("last",), "v"),), ("1 year",), closed="right")
    more = events(frame, (1, "2000-01-01 00:00:00", 4, 8))
    assert tuples(X.feature_intervals(more, ["2000-01-01"], group, tiebreak=["id"])) == [(1, "2000-01-01", 8)]
    with pytest.raises(ValueError):
        X.feature_intervals(more, T, group, GROUP)


def test_bounded_intervals_leave_out_old_events(frame):
    group = X.FeatureGroup("f", (X.Aggregate("n", ("count",)),), ("1 year", "2 weeks"))
    assert tuples(X.feature_intervals(events(frame), ["2000-01-01"], group)) == [(1, "2000-01-01", 1, 0)]


def test_future_events_change_nothing(frame):
    later = [(1, "2000-01-01 00:00:00", 8, 99), (2, "2000-06-01 00:00:00", 9, 99), (3, "2000-01-01 00:00:00", 10, 99)]
    dates = ["2000-01-01"]
    before = tuples(X.feature_intervals(events(frame), dates, GROUP, tiebreak=["id"]))
    assert tuples(X.feature_intervals(events(frame, *later), dates, GROUP, tiebreak=["id"])) == before


def test_listed_dates_and_a_frame_of_dates_agree(frame):
    """Slots come from constants in one case, from a subquery in the other."""
    more = [(e, f"{y}-{m:02}-01 0{e}:00:00", 10 * y + m, y + m) for e in (1, 2, 3) for y in (1998, 1999, 2000) for m in (1, 6, 12)]
    days = ["1999-06-01", "2000-01-01", "2000-06-01", "2001-01-01"]
    spine = frame("as_of_date date", *[(d,) for d in days], (days[0],))
    for closed in ("left", "right"):
        group = X.FeatureGroup("f", GROUP.aggregates, ("2 weeks", "6 months", "all"), closed)
        listed = tuples(X.feature_intervals(events(frame, *more), days, group, tiebreak=["id"]))
        assert tuples(X.feature_intervals(events(frame, *more), spine, group, tiebreak=["id"])) == listed != []
    since = tuples(X.time_since_known(events(frame, *more), "knowledge_date", "s", days))
    assert tuples(X.time_since_known(events(frame, *more), "knowledge_date", "s", spine)) == since != []


def test_impute(frame):
    cohort = frame("entity_id bigint, as_of_date date", (1, "2000-01-01"), (5, "2000-01-01"))
    group = X.FeatureGroup("f", (X.Aggregate("n", ("count",)),), ("1 year",))
    got = X.impute_constant(cohort, X.feature_intervals(events(frame), T, group), group.names())
    assert tuples(got, "entity_id", "f_1y_n_count", "f_1y_n_count_imp") == [(1, 1, 0), (5, 0, 1)]


def test_time_since_last(frame):
    df = frame(
        "entity_id bigint, ts timestamp_ntz",
        (1, "2000-06-01 00:00:00"), (2, "1999-12-31 00:00:00"), (2, "2000-06-01 00:00:00"),
        (3, "1999-12-31 23:59:59"), (4, "2000-01-01 00:00:00"),
    )
    cohort = frame("entity_id bigint, as_of_date date", *[(e, "2000-01-01") for e in (1, 2, 3, 4, 5)])
    known = X.feature_time_since_last(df, cohort, "ts", "s", ["2000-01-01"])
    assert tuples(known, "entity_id", "s") == [(2, 86400), (3, 1), (4, 0)]
    as_written = X.feature_time_since_last(df, cohort, "ts", "s")
    assert tuples(as_written, "entity_id", "s") == [(3, 1), (4, 0)]


def test_time_since_any(frame):
    log = frame(
        "entity_id bigint, event_ts timestamp_ntz, signal string, sign int, undated boolean",
        (1, "1999-12-30 00:00:00", "screen", None, False), (1, "1999-12-31 00:00:00", "q", 0, False),
        (1, "1999-01-01 00:00:00", "q", 1, False),
        (2, "1999-12-31 00:00:00", "q", 1, False),  # never screened
        (3, "1999-12-31 00:00:00", "screen", 0, False),  # no need shown
        (4, "1999-12-31 00:00:00", "screen", 1, False), (4, "2000-02-01 00:00:00", "q", 0, False),
    )
    cohort = frame("entity_id bigint, as_of_date date", *[(e, "2000-01-01") for e in (1, 2, 3, 4)])
    dates = ["2000-01-01"]
    assert tuples(X.feature_time_since_any(log, cohort, "screen", "s", dates), "entity_id", "s") == [(1, 86400), (4, 86400)]
    assert tuples(X.feature_time_since_any(log, cohort, "screen", "s"), "entity_id", "s") == [(1, 86400)]
    positive = X.feature_time_since_any(log, cohort, "screen", "s", dates, positive_only=True)
    assert tuples(positive, "entity_id", "s") == [(1, 365 * 86400), (4, 86400)]


def test_per_person_features(frame):
    df = frame("patid bigint, payor string, a int, ts timestamp_ntz",
               (1, "b", 1, "2000-01-01 00:00:00"), (1, "a", 5, "2000-01-01 00:00:00"), (2, "b", None, None),
               (2, "b", 3, "2000-01-02 00:00:00"), (2, "a", 2, "2000-01-03 00:00:00"))
    assert tuples(X.feature_most_common(df, "patid", "payor")) == [(1, "a"), (2, "b")]
    assert tuples(X.feature_score_extrema(df, "patid", ["a"])) == [(1, 5, 1), (2, 3, 2)]
    assert tuples(X.feature_distinct_dates(df, "patid", "ts")) == [(1, 1), (2, 2)]
    assert tuples(X.feature_demographics(df, "patid", "a", ["payor"])) == [(1, 3.0, "b"), (2, 2.5, "b")]


def _seen(df):
    """Rows by key; sums of doubles are added in another order."""
    rows = df.collect()
    return {(r.entity_id, r.as_of_date): tuple(round(v, 6) if isinstance(v, float) else v for v in r[2:]) for r in rows}


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("intervals", [("1 year", "6 months", "all"), ("1 month", "5 weeks")])
def test_folded_slots_equal_events_placed_on_every_date(spark, closed, intervals):
    """Listed dates fold slots, a frame of dates places them; both must equal aggregating the events themselves."""
    rng = random.Random(f"{closed}{intervals}")
    days = [date(2000, 1, 31) + timedelta(rng.randrange(0, 900)) for _ in range(14)] + [date(2000, 2, 29), date(2001, 3, 31)]
    rows = []
    for i in range(600):
        at = datetime(1999, 6, 1) + timedelta(rng.randrange(0, 1300)) if i % 3 else datetime.combine(rng.choice(days), datetime.min.time())
        rows.append((rng.randrange(0, 12) if i % 50 else None, at + timedelta(0, 0, rng.choice([0, 0, 1])), i, rng.choice([None, 1, 2, 7]), rng.random()))
    events = spark.createDataFrame(rows, "entity_id bigint, knowledge_date timestamp_ntz, i int, n int, x double")
    metrics = ("count", "sum", "min", "max", "avg", "last")
    group = X.FeatureGroup("f", (X.Aggregate("a", ("count",)), X.Aggregate("n", metrics, "n"), X.Aggregate("x", metrics, "x")), intervals, closed)
    got = _seen(X.feature_intervals(events, days, group, tiebreak=["i"]))
    frame = spark.createDataFrame([(d,) for d in days], "as_of_date date")
    assert got == _seen(X.feature_intervals(events, frame, group, tiebreak=["i"]))
    want = {}
    for entity in range(12):
        for day in set(days):
            t = datetime.combine(day, datetime.min.time())
            values, some = [], False
            known = sorted((r for r in rows if r[0] == entity and (r[1] < t or closed == "right" and r[1] == t)), key=lambda r: (r[1], r[2]))
            for span in map(Interval.of, intervals):
                low = datetime.min if span.unbounded else datetime.combine(span.day_before(day), datetime.min.time())
                inside = [r for r in known if r[1] >= low]
                some = some or bool(inside)
                values.append(len(inside))
                for k in (3, 4):
                    full = [r[k] for r in inside if r[k] is not None]
                    stats = (sum(full), min(full), max(full), sum(full) / len(full)) if full else (None,) * 4
                    values += [len(full), *stats, inside[-1][k] if inside else None]
            if some:
                want[entity, day] = tuple(round(v, 6) if isinstance(v, float) else v for v in values)
    assert got == want


def test_slots_by_search_equal_counted_edges(spark):
    rng = random.Random(5)
    days = [date(2001, 1, 31) + timedelta(rng.randrange(0, 400)) for _ in range(9)]
    spans = [Interval.of(x) for x in ("1 month", "3 weeks")]
    rows = [(datetime(2000, 11, 1) + timedelta(rng.randrange(0, 600), 0, rng.choice([0, 1, 999])),) for _ in range(400)] + [(None,)]
    events = spark.createDataFrame(rows, "at timestamp_ntz")
    frame = spark.createDataFrame([(d,) for d in days], "as_of_date date")
    for closed in ("left", "right"):
        found = [tuples(slotted(events.filter("at is not null"), "at", d, closed, spans), "at", "_slot") for d in (days, frame)]
        assert found[0] == found[1]
    assert slotted(events.filter("at is null"), "at", days).first()._slot is None


def test_the_plan_does_not_grow_with_the_dates(spark):
    events = spark.createDataFrame([], "entity_id bigint, knowledge_date timestamp_ntz")
    group = X.FeatureGroup("f", (X.Aggregate("a", ("count",)),), ("1 year", "all"))
    sizes = []
    for n in (3, 200):
        found = X.feature_intervals(events, [date(2000, 1, 1) + timedelta(30 * k) for k in range(n)], group)
        sizes.append(found._jdf.queryExecution().analyzed().toString().count("="))
    assert sizes[0] == sizes[1]
