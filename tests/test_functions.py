from datetime import date

import pytest
from pyspark.sql import functions as F

from hindcast.functions.intervals import Interval
from hindcast.functions.timestamps import lasts_longer, seconds_between
from hindcast.functions.tristate import any_answer, matches_without, strongest, yes_no
from hindcast.operators.linkage import compose_timestamp
from hindcast.presets import INVENTORY_ANSWERS, INVENTORY_REVERSED, NEED_EXCLUSION, NEED_PATTERN
from tests.conftest import tuples


@pytest.mark.parametrize(
    "text, months, days, label",
    [
        ("5yr", 60, 0, "5y"), ("1yr", 12, 0, "1y"), ("6 months", 6, 0, "6m"), ("2 weeks", 0, 14, "2w"),
        ("1 year", 12, 0, "1y"), ("5 years", 60, 0, "5y"), ("6month", 6, 0, "6m"), ("18month", 18, 0, "18m"),
        ("2year", 24, 0, "2y"), ("100year", 1200, 0, "100y"), ("0day", 0, 0, "0d"), ("1day", 0, 1, "1d"),
        ("3month", 3, 0, "3m"),
    ],
)
def test_interval_texts(text, months, days, label):
    assert Interval.of(text) == Interval(months, days, label)


def test_interval_all_and_nonsense():
    assert Interval.of("all").unbounded
    with pytest.raises(ValueError):
        Interval.of("soon")
    with pytest.raises(ValueError):
        Interval.of("all").after(None)


def test_month_ends_clamp(spark):
    day = F.lit(date(2000, 8, 31))
    row = spark.range(1).select(
        Interval.of("6 months").before(day).alias("a"), Interval.of("6month").after(day).alias("b"),
        Interval.of("2 weeks").after(day).alias("c"),
    ).first()
    assert row == (date(2000, 2, 29), date(2001, 2, 28), date(2000, 9, 14))


def test_compose_timestamp(frame):
    df = frame(
        "k int, d date, t string",
        (1, "2001-02-03", None), (2, "2001-02-03", "04:05:06"), (3, None, "04:05:06"), (4, None, None),
    )
    starts = compose_timestamp(df, "d", "t", "00:00:01", "ts")
    assert tuples(starts, "k", "ts") == [
        (1, "2001-02-03 00:00:01"), (2, "2001-02-03 04:05:06"), (3, None), (4, None)
    ]
    ends = compose_timestamp(df, "d", "t", "23:59:59", "ts")
    assert tuples(ends, "k", "ts")[0] == (1, "2001-02-03 23:59:59")


def test_seconds_between_ignores_the_session_zone(spark, frame):
    df = frame("a timestamp_ntz, b timestamp_ntz", ("2021-03-27 12:00:00", "2021-03-28 12:00:01"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(seconds_between(F.col("a"), F.col("b"))).first()[0] == 86401
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_long_stay_edges(frame):
    df = frame(
        "k int, a timestamp_ntz, b timestamp_ntz",
        (1, "2000-01-01 00:00:00", "2000-01-15 00:00:00"), (2, "2000-01-01 00:00:00", "2000-01-15 00:00:01"),
        (3, "2000-01-01 00:00:00", None),
    )
    assert tuples(df.select("k", lasts_longer(F.col("a"), F.col("b"), "2 weeks"))) == [(1, False), (2, True), (3, True)]


def test_any_answer_edges(frame):
    df = frame(
        "k int, x int, y int, r int",
        (1, None, None, None), (2, None, 0, None), (3, 2, 2, 0), (4, 2, 2, 1), (5, 2, 2, 2), (6, None, 1, None),
        (7, 0, 0, None),
    )
    sign = any_answer(["x", "y", "r"], ["r"])
    assert tuples(df.select("k", sign)) == [(1, None), (2, 0), (3, 1), (4, 1), (5, 0), (6, 1), (7, 0)]


def test_preset_inventory(frame):
    schema = "k int, " + ", ".join(f"{a} int" for a in INVENTORY_ANSWERS)
    blank = [None] * len(INVENTORY_ANSWERS)
    reversed_zero, plain_zero, one = list(blank), list(blank), list(blank)
    reversed_zero[INVENTORY_ANSWERS.index("ans_40")] = 0
    plain_zero[INVENTORY_ANSWERS.index("ans_41")] = 0
    one[INVENTORY_ANSWERS.index("ans_50")] = 1
    df = frame(schema, (1, *blank), (2, *reversed_zero), (3, *plain_zero), (4, *one))
    assert tuples(df.select("k", any_answer(INVENTORY_ANSWERS, INVENTORY_REVERSED))) == [(1, None), (2, 1), (3, 0), (4, 1)]


def test_yes_no(frame):
    df = frame("k int, f string", (1, "Y"), (2, "N"), (3, "?"), (4, None))
    assert tuples(df.select("k", yes_no(F.col("f")))) == [(1, 1), (2, 0), (3, None), (4, None)]


def test_matches_without(frame):
    df = frame(
        "k int, a string, b string",
        (1, "ANXIETY", "x"), (2, "x", "MENTAL"), (3, "ANXIETY", "CONCUSSION"), (4, "ANXIETY", None), (5, "x", "y"),
        (6, "CONCUSSION", "MENTAL"),
    )
    hits = df.filter(matches_without(["a", "b"], NEED_PATTERN, NEED_EXCLUSION))
    assert tuples(hits, "k") == [(1,), (2,)]


def test_strongest(frame):
    df = frame("k int, a int, b int", (1, None, None), (2, None, 0), (3, 0, 1))
    assert tuples(df.select("k", strongest(F.col("a"), F.col("b")))) == [(1, None), (2, 0), (3, 1)]


def test_minimum_stays_in_months(frame):
    stays = frame(
        "k int, a timestamp_ntz, b timestamp_ntz", (1, "2000-01-31 00:00:00", "2000-02-01 00:00:00"),
        (2, "2000-01-31 00:00:00", "2000-02-29 00:00:01"), (3, "2000-01-01 00:00:00", "2000-02-01 00:00:00"), (4, "2000-01-01 00:00:00", None),
    )
    longer = lambda text: tuples(stays.filter(lasts_longer(F.col("a"), F.col("b"), text)), "k")
    assert longer("1 month") == [(2,), (4,)]
    assert longer("1yr") == [(4,)]
    assert longer("0day") == [(1,), (2,), (3,), (4,)]
    with pytest.raises(ValueError):
        longer("all")
