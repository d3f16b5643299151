from hindcast.operators import cohorts as C
from tests.conftest import tuples

STAYS = "entity_id bigint, stay_id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz"
T = ["2000-01-01"]


def stays(frame, *rows):
    return frame(STAYS, *[(e, i, s, x) for i, (e, s, x) in enumerate(rows)])


def test_window_and_end_edges(frame):
    df = stays(
        frame,
        (1, "2000-01-01 00:00:00", "2000-01-05 00:00:00"),  # starts at t, still running
        (2, "1995-01-01 00:00:00", "1995-02-01 00:00:00"),  # starts exactly at t - lookback
        (3, "1994-12-31 23:59:59", "1995-02-01 00:00:00"),  # one second too early
        (4, "2000-01-01 00:00:01", "2000-02-01 00:00:00"),  # one second too late
        (5, "1999-01-01 00:00:00", "2000-01-01 00:00:00"),  # ends exactly at t
        (6, "1999-01-01 00:00:00", "1999-12-31 23:59:59"),
    )
    assert tuples(C.cohort_last_stay_closed(df, T, "5yr"), "entity_id") == [(2,), (6,)]
    assert tuples(C.cohort_table(df, T, "5yr"), "entity_id", "active") == [
        (1, False), (2, True), (5, False), (6, True)
    ]


def test_ties_and_older_closed(frame):
    df = stays(
        frame,
        (1, "1999-05-01 00:00:00", None), (1, "1999-05-01 00:00:00", "1999-06-01 00:00:00"),  # tie, one closed
        (2, "1999-05-01 00:00:00", None), (2, "1998-05-01 00:00:00", "1998-06-01 00:00:00"),  # latest open
        (3, "1999-05-01 00:00:00", None), (3, "1999-05-01 00:00:00", None),
        (None, "1999-05-01 00:00:00", "1999-06-01 00:00:00"),
    )
    assert tuples(C.cohort_last_stay_closed(df, T, "5yr")) == [(1, "2000-01-01")]


def test_only_long_stays_compete(frame):
    df = stays(
        frame,
        (1, "1999-01-01 00:00:00", "1999-03-01 00:00:00"), (1, "1999-12-30 00:00:00", None),
        (2, "1999-01-01 00:00:00", "1999-03-01 00:00:00"), (2, "1999-12-30 00:00:00", "2000-01-02 00:00:00"),
        (3, "1999-01-01 00:00:00", "1999-01-15 00:00:00"),  # exactly two weeks
        (4, "1999-01-01 00:00:00", None), (4, "1999-01-01 00:00:00", "1999-01-02 00:00:00"),  # short closed tie
    )
    assert tuples(C.cohort_last_long_stay_closed(df, T, "5yr"), "entity_id") == [(2,), (4,)]


def test_counts_status_and_repeat(frame):
    df = stays(
        frame,
        (1, "1999-01-01 00:00:00", "1999-03-01 00:00:00"), (1, "1999-12-01 00:00:00", None),
        (2, "1999-06-01 00:00:00", "1999-06-02 00:00:00"),
        (3, "2000-02-01 00:00:00", "2000-04-01 00:00:00"), (3, "2000-01-01 00:00:00", None),
    )
    windows = {"n_before": ("1999-01-01", "2000-01-01"), "n_after": ("2000-01-01", "2001-01-01")}
    assert tuples(C.stay_count_window(df, windows), "entity_id", "n_before", "n_after") == [(1, 1, 0), (3, 0, 1)]
    assert tuples(C.stay_count_before(df, "2000-01-01")) == [(1, 2), (2, 0), (3, 0)]
    assert tuples(C.status_as_of(df, "2000-01-01")) == [(1, 1)]
    assert tuples(C.repeat_event_flag(df)) == [(1, 1), (3, 1)]
    assert tuples(C.cohort_any_closed_stay(df, "1998-01-01", "2000-01-01")) == [(1,), (2,)]


def test_status_report_takes_the_first_open_stay(frame):
    df = stays(
        frame,
        (1, "1999-12-31 00:00:00", None), (1, "1999-12-01 00:00:00", "2000-01-11 00:00:00"),
        (2, "1999-12-30 00:00:00", None), (3, "1998-01-01 00:00:00", "1998-01-02 00:00:00"),
    )
    report = C.status_report(df, "2000-01-01", "2000-01-02")
    assert [r.entity_id for r in report.collect()] == [1, 1, 2, 3]
    assert tuples(report, "stay_id", "in_stay", "current_start", "duration_s") == [
        (0, 1, "1999-12-01 00:00:00", 41 * 86400), (1, 1, "1999-12-01 00:00:00", 41 * 86400),
        (2, 1, "1999-12-30 00:00:00", 3 * 86400), (3, 0, None, None),
    ]
    assert tuples(C.status_summary(report)) == [(0, 1), (1, 3)]


def test_base_rates(frame):
    df = stays(
        frame,
        (1, "1999-01-02 00:00:00", "1999-03-01 00:00:00"), (1, "2000-02-01 00:00:00", None),
        (2, "1999-01-02 00:00:00", None),
        (9, "1999-01-02 00:00:00", "1999-03-01 00:00:00"),  # not in the universe
    )
    log = frame(
        "entity_id bigint, event_ts timestamp_ntz, signal string, sign int, undated boolean",
        (1, "1999-06-01 00:00:00", "s", 1, False), (2, "2000-01-01 00:00:00", "s", 0, False),
        (3, "2000-03-01 00:00:00", "s", 1, False),
    )
    universe = frame("entity_id bigint", (1,), (2,), (3,))
    flags = C.base_rate_flags(universe, df, log, "1999-01-01", "2000-01-01", "2000-07-01")
    names = ["entity_id", "stays_before", "stays_after", "in_stay", "sign_history", "sign_outcome", "cohort", "outcome"]
    assert tuples(flags, *names) == [(1, 1, 1, 0, 1, 0, 1, 1), (2, 1, 0, 1, 0, 0, 0, 0), (3, 0, 0, 0, 0, 1, 0, 0)]
    assert C.base_rate_summary(flags).first().asDict() == {
        "n_entities": 3, "n_cohort": 1, "n_outcome": 1, "n_sign_history": 1, "n_sign_outcome": 1,
        "n_stayed_before": 2, "n_stayed_after": 1,
    }
