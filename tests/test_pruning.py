"""Which rows of stored events the operators read."""

import pytest
from pyspark.sql import functions as F

from hindcast.operators import cohorts as C
from hindcast.operators import features as X
from hindcast.operators import signals as S
from hindcast.sources import sinks
from tests.conftest import tuples
from tests.test_plans import rows_read

DATES, LOOKBACK = ["1995-01-01"], "1 year"
ROWS = 24_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Ten years of stays, a third of them open for good in the last two years, stored by month; and the same not stored."""
    day = F.col("id") % 3650
    start = F.lit("1990-01-01").cast("timestamp_ntz") + F.make_dt_interval(day)
    events = spark.range(ROWS).select(
        (F.col("id") % 700).alias("entity_id"), F.col("id").alias("stay_id"), start.alias("start_ts"),
        F.when((day < 2900) | (F.col("id") % 3 != 0), start + F.make_dt_interval(F.col("id") % 40 - 2)).alias("end_ts"),
        (F.col("id") % 3 - 1).cast("int").alias("flag"), F.when(F.col("id") % 2 == 0, "Y").otherwise("N").alias("yes"),
        F.concat(F.lit("Mental "), (F.col("id") % 5).cast("string")).alias("text"),
    )
    path = str(tmp_path_factory.mktemp("store") / "events")
    sinks.store_events(events, path, "start_ts", slices=2, end="end_ts")
    return sinks.read_events(spark, path, events, ended=True), events


def logs(events):
    return {
        "flag": S.flag_log(events, "s", "start_ts", "flag"),
        "answers": S.answers_log(events, "s", "start_ts", ["flag"], ["flag"]),
        "yes_no": S.yes_no_log(events, "s", "start_ts", "yes"),
        "regex": S.regex_log(events, "s", "start_ts", "text", "tal [12]"),
        "exclude": S.regex_exclude_log(events, "s", "start_ts", ["text", "yes"], "tal", "tal 3"),
        "listed": S.in_list_log(events, "s", "start_ts", "yes", ["Y"]),
        "like": S.ilike_log(events, "s", "start_ts", "text", ["%MENTAL 1%", "%mental 2%"]),
        "presence": S.presence_log(events, "s", "start_ts"),
    }


def days_between(events, low, high):
    return events.filter(F.col("start_ts").between(F.to_date(F.lit(low)), F.to_date(F.lit(high)))).count()


@pytest.mark.parametrize("kind", ["flag", "answers", "yes_no", "regex", "exclude", "listed", "like", "presence"])
def test_signals_read_their_lookback_only(stored, kind):
    kept, plain = (logs(events)[kind] for events in stored)
    found = S.signs_at(kept, DATES, LOOKBACK)
    assert rows_read(found) <= 1.1 * days_between(stored[1], "1994-01-01", "1995-01-01")
    assert tuples(found) == tuples(S.signs_at(plain, DATES, LOOKBACK)) != []


def test_a_log_of_several_sources_is_bounded_in_each(stored):
    """One of them is not stored: its dates come from its timestamps."""
    kept, plain = stored
    both = [S.signal_log(S.flag_log(a, "a", "start_ts", "flag"), S.yes_no_log(b, "b", "start_ts", "yes"), S.presence_log(plain, "c", "start_ts"))
            for a, b in ((kept, kept), (plain, plain))]
    cohort = C.cohort_last_stay_closed(plain, DATES, LOOKBACK)
    wide = [S.signals_wide(log, ["a", "b", "c"], DATES, LOOKBACK, cohort) for log in both]
    assert rows_read(wide[0]) <= 2.2 * days_between(plain, "1994-01-01", "1995-01-01")
    assert tuples(wide[0]) == tuples(wide[1]) != []


def test_rows_of_any_date_leave_the_dated_ones_bounded(stored):
    as_written = [S.ilike_log(events, "s", "start_ts", "text", ["%MENTAL 1%", "%mental 2%"], as_written=True) for events in stored]
    found = S.signs_at(as_written[0], DATES, LOOKBACK)
    assert rows_read(found) <= ROWS + 1.1 * days_between(stored[1], "1994-01-01", "1995-01-01")
    assert tuples(found) == tuples(S.signs_at(as_written[1], DATES, LOOKBACK))


PERIODS = {"before": ("1994-01-01", "1995-01-01"), "after": ("1995-01-01", "1995-07-01")}
FIXED = {
    "zero_filled": lambda e: S.signal_combine_zero_filled(S.flag_log(e, "s", "start_ts", "flag"), PERIODS),
    "stay_count": lambda e: C.stay_count_window(e, PERIODS),
    "long_closed": lambda e: C.cohort_last_long_stay_closed(e, DATES, "1 year"),
    "bounded_feature": lambda e: X.feature_intervals(
        e.withColumnRenamed("start_ts", "knowledge_date"), DATES, X.FeatureGroup("f", (X.Aggregate("n", ("count", "max"), "flag"),), ("1 year",))
    ),
}


@pytest.mark.parametrize("name", sorted(FIXED))
def test_periods_bound_what_is_read(stored, name):
    kept, plain = (FIXED[name](events) for events in stored)
    assert rows_read(kept) <= 1.1 * days_between(stored[1], "1994-01-01", "1995-07-01")
    assert tuples(kept) == tuples(plain) != []


def everyone(events):
    rows = events.sparkSession.range(700)
    return rows.select(F.col("id").alias("entity_id"), F.to_date(F.lit(DATES[0])).alias("as_of_date"))


ONE_SIDED = {
    "any_closed": (lambda e: C.cohort_any_closed_stay(e, "1997-01-01", "1998-01-01"), "1997-01-01", "2000-01-01"),
    "since_last": (lambda e: X.time_since_known(e, "start_ts", "s", DATES), "1990-01-01", "1995-01-01"),
    "since_any": (
        lambda e: X.feature_time_since_any(S.flag_log(e, "s", "start_ts", "flag"), everyone(e), "s", "x", DATES),
        "1990-01-01", "1995-01-01",
    ),
    "status": (lambda e: C.status_as_of(e, "1994-01-01"), "1990-01-01", "1994-01-01"),
}


@pytest.mark.parametrize("name", sorted(ONE_SIDED))
def test_one_sided_periods_bound_what_is_read(stored, name):
    build, low, high = ONE_SIDED[name]
    kept, plain = (build(events) for events in stored)
    assert rows_read(kept) <= 1.1 * days_between(stored[1], low, high) + 100
    assert tuples(kept) == tuples(plain) != []


def test_two_periods_and_base_rates(stored):
    def flags(events):
        universe = stored[1].select("entity_id").distinct()
        return C.base_rate_flags(universe, events, S.flag_log(events, "s", "start_ts", "flag"), "1996-01-01", "1997-01-01", "1997-07-01")

    kept, plain = (flags(events) for events in stored)
    # Old stays are read up to t2 at most; signs from t0 on.
    assert rows_read(kept) <= 1.1 * (days_between(stored[1], "1990-01-01", "1997-07-01") + days_between(stored[1], "1996-01-01", "1997-07-01"))
    assert tuples(kept) == tuples(plain) != []
    kept, plain = (
        S.signal_two_periods(S.flag_log(e, "s", "start_ts", "flag"), PERIODS, C.cohort_any_closed_stay(stored[1], "1994-01-01", "1995-01-01"))
        for e in stored
    )
    assert rows_read(kept) <= 1.1 * days_between(stored[1], "1994-01-01", "1995-07-01")
    assert tuples(kept) == tuples(plain) != []
