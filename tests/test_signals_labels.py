from hindcast.operators import cohorts as C
from hindcast.operators import labels as L
from hindcast.operators import signals as S
from hindcast.plans.study import cohort_facts, labelled_cohort, labelled_grid
from tests.conftest import tuples
from tests.test_cohorts import stays

T = ["2000-01-01"]
LOG = "entity_id bigint, event_ts timestamp_ntz, signal string, sign int, undated boolean"


def test_flags_combine_over_an_entity(frame):
    df = frame(
        "entity_id bigint, ts timestamp_ntz, f string",
        (1, "1999-01-01 00:00:00", "N"), (1, "1999-02-01 00:00:00", "Y"), (1, "1999-03-01 00:00:00", "?"),
        (1, "1999-03-02 00:00:00", None), (2, "1999-01-01 00:00:00", "N"), (3, "1999-01-01 00:00:00", None),
        (4, "1994-12-31 23:59:59", "Y"), (5, "2000-01-01 00:00:00", "Y"), (6, "2000-01-01 00:00:01", "Y"),
        (None, "1999-01-01 00:00:00", "Y"),
    )
    signs = S.signs_at(S.yes_no_log(df, "q", "ts", "f"), T, "5yr")
    assert tuples(signs, "entity_id", "sign") == [(1, 1), (2, 0), (3, None), (5, 1)]


def test_ilike_precedence(frame):
    df = frame(
        "entity_id bigint, ts timestamp_ntz, x string",
        (1, "1980-01-01 00:00:00", "Violence"), (2, "1980-01-01 00:00:00", "HOMICIDAL"),
        (3, "1999-01-01 00:00:00", "homicide"), (4, "1999-01-01 00:00:00", None),
    )
    patterns = ["%violence%", "%homicid%"]
    tied = S.signs_at(S.ilike_log(df, "c", "ts", "x", patterns), T, "5yr")
    assert tuples(tied, "entity_id") == [(3,)]
    loose = S.signs_at(S.ilike_log(df, "c", "ts", "x", patterns, as_written=True), T, "5yr")
    assert tuples(loose, "entity_id") == [(1,), (3,)]


def test_wide_and_combined(frame):
    log = frame(
        LOG, (1, "1999-01-01 00:00:00", "a", 0, False), (1, "1999-01-01 00:00:00", "b", 1, False),
        (2, "1999-01-01 00:00:00", "a", 0, False), (9, "1999-01-01 00:00:00", "a", 1, False),
    )
    cohort = frame("entity_id bigint, as_of_date date", *[(e, "2000-01-01") for e in (1, 2, 3)])
    wide = S.signals_wide(log, ["a", "b"], T, "5yr", cohort)
    assert tuples(wide, "entity_id", "a", "b") == [(1, 0, 1), (2, 0, None), (3, None, None)]
    assert tuples(S.signal_combine_greatest(wide, ["a", "b"]), "entity_id", "sign") == [(1, 1), (2, 0), (3, None)]


def test_periods(frame):
    log = frame(
        LOG, (1, "1999-01-01 00:00:00", "a", 0, False), (1, "2000-01-01 00:00:00", "a", 1, False),
        (4, "2000-02-01 00:00:00", "b", 1, False), (5, "1990-01-01 00:00:00", "b", 1, False), (2, "2001-01-01 00:00:00", "b", 1, False),
    )
    universe = frame("entity_id bigint", (1,), (2,))
    periods = {"past": ("1995-01-01", "2000-01-01"), "next": ("2000-01-01", "2000-07-01")}
    assert tuples(S.signs_by_period(log, periods)) == [(1, 1, 1), (4, None, 1)]
    assert tuples(S.signal_combine_zero_filled(log, periods)) == [(1, 1, 1), (4, 0, 1)]
    assert tuples(S.signal_two_periods(log, periods, universe)) == [(1, 1, 1), (2, None, None)]


def test_presence_and_issue_calls(frame):
    calls = frame("patid bigint, issue string", (1, "ANXIETY"), (1, "DEPRESSION"), (2, "HOUSING"), (3, None))
    assert tuples(S.signal_issue_calls(calls, "patid", "issue", ["ANXIETY", "DEPRESSION"])) == [(1, 2, 1)]
    assert tuples(S.signal_presence({"caller": (calls, "patid")})) == [(1, "caller", 1), (2, "caller", 1), (3, "caller", 1)]


def label_stays(frame):
    return stays(
        frame,
        (1, "1999-01-01 00:00:00", "1999-02-01 00:00:00"), (1, "2000-01-01 00:00:00", "2000-02-01 00:00:00"),
        (2, "1999-01-01 00:00:00", "1999-02-01 00:00:00"), (2, "2000-07-01 00:00:00", None),
        (3, "1999-01-01 00:00:00", "1999-02-01 00:00:00"), (3, "2000-07-01 00:00:01", None),
        (4, "1999-01-01 00:00:00", "1999-02-01 00:00:00"), (4, "2000-03-01 00:00:00", "2000-03-15 00:00:00"),
    )


def members(frame, *entities):
    return frame("entity_id bigint, as_of_date date", *[(e, "2000-01-01") for e in entities])


def test_long_label_edges(frame):
    got = L.label_reevent_long(label_stays(frame), members(frame, 1, 2, 3, 4), T, "6 months")
    assert tuples(got, "entity_id", "label") == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert tuples(L.label_positive_only(label_stays(frame), T, "6 months"), "entity_id") == [(1,), (2,)]


def test_any_label_is_null_without_stays(frame):
    got = L.label_reevent_any(label_stays(frame), members(frame, 1, 3, 4, 5), T, "6 months")
    assert tuples(got, "entity_id", "label") == [(1, 1), (3, 0), (4, 1), (5, None)]


def test_grid_agrees_with_single_labels(frame):
    cohort = members(frame, 1, 2, 3, 4)
    grid = L.label_grid(label_stays(frame), cohort, T, ["6 months", "1yr"])
    for span in ("6 months", "1yr"):
        single = L.label_reevent_long(label_stays(frame), cohort, T, span)
        assert tuples(grid.filter(grid.label_timespan == span), "entity_id", "label") == tuples(single, "entity_id", "label")
    assert L.label_positive_count(grid).first()[0] == 5


def test_fused_and_composed_label_queries_agree(frame):
    df, dates = label_stays(frame), ["1999-06-01", "2000-01-01", "2000-12-01"]
    log = frame(
        LOG, (1, "1999-01-01 00:00:00", "a", 1, False), (2, "1999-12-31 00:00:00", "a", 1, False),
        (2, "1970-01-01 00:00:00", "a", 1, True), (3, "1999-01-01 00:00:00", "a", 0, False),
        (4, "2000-06-01 00:00:00", "b", 1, False), (5, "1999-01-01 00:00:00", "a", 1, False),
    )
    cohort = C.cohort_with_signal(C.cohort_last_stay_closed(df, dates, "2 years"), S.signs_at(log, dates, "2 years"))
    composed = L.label_reevent_long(df, cohort, dates, "6 months")
    fused = labelled_cohort(df, log, dates, "2 years", "6 months")
    assert tuples(fused, "entity_id", "as_of_date", "label") == tuples(composed, "entity_id", "as_of_date", "label")
    assert tuples(fused)
    grid = labelled_grid(df, log, dates, "2 years", ["6 months", "1yr"])
    assert tuples(grid) == tuples(L.label_grid(df, cohort, dates, ["6 months", "1yr"]))


def test_dates_may_come_from_a_frame(frame):
    df = label_stays(frame)
    log = frame(LOG, (1, "1999-01-01 00:00:00", "a", 1, False))
    spine = frame("as_of_date date", ("2000-01-01",), ("1999-06-01",), ("2000-01-01",))
    listed = ["1999-06-01", "2000-01-01"]
    assert tuples(cohort_facts(df, log, spine, "2 years", ["6 months"])) == tuples(
        cohort_facts(df, log, listed, "2 years", ["6 months"])
    )


def test_simplified_label(frame):
    signs = frame("entity_id bigint, as_of_date date, sign int", (1, "2000-01-01", 1), (2, "2000-01-01", 0))
    seen = C.cohort_table(label_stays(frame), T, "5yr")
    assert tuples(L.label_simplified(label_stays(frame), signs, seen, T, "6 months"), "entity_id", "label") == [(1, 1)]
