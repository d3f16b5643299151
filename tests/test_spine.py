from dataclasses import replace

import pytest

from hindcast.operators.spine import TemporalConfig, asof_spine, asof_spines, known_from, label_bounds, split_spans
from tests.conftest import tuples


def config(update, train="6month", test="6month", train_every="6month", test_every="1month", history="0day", duration="0day"):
    return TemporalConfig(update, train, test, train_every, test_every, history, duration)


def days(spine, split, role):
    return [d for (d,) in tuples(spine.filter(f"split_id = {split} and role = '{role}'"), "as_of_date")]


@pytest.mark.parametrize(
    "start, end, settings, tests, newest_train",
    [
        ("2010-01-01", "2019-01-01", config("2year", history="5year"),
         ["2018-07-01", "2016-07-01", "2014-07-01", "2012-07-01", "2010-07-01"], 11),
        ("2014-01-01", "2019-01-01", config("18month", train_every="18month", test_every="18month", history="5year"),
         ["2018-07-01", "2017-01-01", "2015-07-01"], 3),
        ("2017-01-01", "2019-05-01", config("100year", train_every="1day", test_every="1day"), ["2018-11-01"], 1),
    ],
)
def test_known_configurations(frame, start, end, settings, tests, newest_train):
    spine = asof_spine(frame("label_start date, label_end date", (start, end)), settings)
    splits = sorted({r.split_id for r in spine.collect()})
    assert [days(spine, s, "test") for s in splits] == [[d] for d in tests]
    assert len(days(spine, 1, "train")) == newest_train
    assert max(days(spine, 1, "train")) <= tests[0]


def test_single_split_configuration(frame):
    settings = config("1month", "1year", "1year", "3month", "3month")
    spine = asof_spine(frame("label_start date, label_end date", ("2017-01-01", "2019-01-01")), settings)
    assert tuples(spine, "split_id", "role", "as_of_date") == [(1, "test", "2018-01-01"), (1, "train", "2017-01-01")]


def test_month_ends_step_from_the_anchor(frame):
    settings = config("100year", "1month", "1month", "1month", "1month", "4month", "2month")
    spine = asof_spine(frame("label_start date, label_end date", ("2000-01-01", "2001-11-30")), settings)
    assert days(spine, 1, "test") == ["2001-08-30", "2001-09-30", "2001-10-30"]
    assert days(spine, 1, "train") == ["2001-03-30", "2001-04-30", "2001-05-30", "2001-06-30", "2001-07-30"]


def test_no_training_label_passes_its_split(frame):
    settings = config("3month", history="2year", train_every="1month")
    spine = asof_spine(frame("label_start date, label_end date", ("2015-03-31", "2019-08-31")), settings)
    spans = split_spans(spine, settings)
    rows = spans.collect()
    split_day = {r.split_id: r.as_of_date for r in rows if r.role == "test"}
    assert len(split_day) > 5
    assert all(r.label_end <= split_day[r.split_id] for r in rows if r.role == "train")
    assert [r.split_id for r in rows] == sorted(r.split_id for r in rows)
    box = [r for r in rows if r.split_id == 1 and r.role == "train"]
    assert {r.box_start for r in box} == {min(r.as_of_date for r in box)}
    assert {r.box_end for r in box} == {max(r.label_end for r in box)}


def test_bounds_from_data(frame):
    df = frame("ts timestamp_ntz", ("2000-05-06 07:00:00",), ("2001-02-03 23:00:00",))
    assert tuples(label_bounds(df, "ts")) == [("2000-05-06", "2001-02-04")]


def test_listed_settings(frame):
    bounds = frame("label_start date, label_end date", ("2010-01-01", "2019-01-01"))
    listed = TemporalConfig(
        "2year", label_timespans=("6month", "1year"), training_frequency="6month", test_frequency="1month",
        max_training_history=("1year", "5year"),
    )
    settings = listed.settings()
    assert [(s.training_label_timespan, s.test_label_timespan, s.max_training_history) for s in settings] == [
        (a, b, h) for a in ("6month", "1year") for b in ("6month", "1year") for h in ("1year", "5year")
    ]
    spines = asof_spines(bounds, listed)
    for i, one in enumerate(settings, 1):
        part = spines.filter(f"setting_id = {i}").drop("setting_id")
        assert tuples(part) == tuples(asof_spine(bounds, one)) != []


def test_feature_bounds(frame):
    events = frame("k int, knowledge_date timestamp_ntz", *[(y, f"{y}-01-01 00:00:00") for y in range(1995, 2000)])
    bounded = config("2year")
    assert tuples(known_from(events, bounded), "k") == [(y,) for y in range(1995, 2000)]
    bounded = replace(bounded, feature_start="1996-01-01", feature_end="1998-01-01")
    assert tuples(known_from(events, bounded), "k") == [(1996,), (1997,)]
