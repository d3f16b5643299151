from itertools import permutations
from statistics import mean, pstdev

import pytest

from hindcast.operators import evaluation as E
from hindcast.operators.joins import running_totals
from hindcast.operators.ranking import RankRule, rank_multi_feature
from tests.conftest import tuples

PRED = "m int, entity_id bigint, score double, label int"


def enumerated(rows, k):
    """Precision and recall over every order of the ties."""
    rows = [(s, y) for s, y in rows if y is not None]
    k, positives = min(k, len(rows)), sum(y for _, y in rows)
    hits = [
        sum(y for _, y in sorted((rows[i] for i in order), key=lambda r: -r[0])[:k])
        for order in permutations(range(len(rows)))
    ]
    spread = (max(hits), min(hits), mean(hits), pstdev(hits))
    return [h / k for h in spread], [h / positives if positives else None for h in spread]


@pytest.mark.parametrize(
    "rows",
    [
        [(1.0, 1), (1.0, 0), (1.0, 0), (1.0, 1)],  # all tied
        [(3.0, 1), (2.0, 1), (2.0, 0), (2.0, 0), (1.0, 1)],  # cuts divide a tie
        [(3.0, 0), (2.0, 0), (1.0, 0)],  # no positives
        [(3.0, None), (2.0, 1), (2.0, 0), (1.0, None), (0.5, 1)],  # unknown labels
        [(-1.0, 1), (0.0, 0), (1e9, 1), (1e-9, 0), (2e-9, 1), (1e-9, 1)],  # crowded values beside an outlier
    ],
)
def test_against_enumeration(frame, rows):
    df = frame(PRED, *[(1, i, s, y) for i, (s, y) in enumerate(rows)])
    found = E.evaluate(df, ["m"], E.Cuts((1, 2, 3, 4, 50), ())).collect()
    for k in (1, 2, 3, 4, 50):
        precision, recall = enumerated(rows, k)
        for metric, want in (("precision@", precision), ("recall@", recall)):
            (row,) = [r for r in found if r.metric == metric and r.parameter == f"{k}_abs"]
            got = [row.best_value, row.worst_value, row.stochastic_value, row.standard_deviation]
            assert got == pytest.approx(want) if want[0] is not None else got == [None] * 4


def test_percent_cuts(frame):
    df = frame(PRED, *[(1, i, float(-i), int(i < 3)) for i in range(10)])
    found = {(r.metric, r.parameter): r for r in E.evaluate(df, ["m"], E.Cuts((), (5, 10, 55, 100))).collect()}
    assert found["precision@", "5_pct"].k == 0 and found["precision@", "5_pct"].best_value is None
    assert found["precision@", "10_pct"].best_value == 1.0
    assert found["recall@", "55_pct"].k == 5 and found["recall@", "55_pct"].worst_value == 1.0
    assert found["recall@", "100_pct"].stochastic_value == 1.0


def test_best_mean_worst_are_ordered(frame):
    df = frame(PRED, *[(i % 2, i, float(i * 7 % 5), i * 13 % 3 == 0 and 1 or 0) for i in range(60)])
    for r in E.evaluate(df, ["m"], E.Cuts((1, 7, 20), (10, 33, 100))).collect():
        assert r.best_value >= r.stochastic_value - 1e-12 >= r.worst_value - 2e-12


@pytest.mark.parametrize("buckets", [1, 3, 1024])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_a_plain_sum(frame, buckets, descending):
    rows = [(g, float(x), y, x * x + y) for g in (1, 2) for x in (-3, 0, 1, 2, 1000) for y in (0, 1)]
    df = frame("g int, x double, y int, v bigint", *[(g, x, y, int(v)) for g, x, y, v in rows])
    order = [("x", descending), ("y", False)]
    for r in running_totals(df, ["g"], order, ["v"], buckets).collect():
        sign = -1 if descending else 1
        ahead = [int(v) for g, x, y, v in rows if g == r.g and (sign * x, y) < (sign * r.x, r.y)]
        assert r.before_v == sum(ahead)
        assert r.total_v == sum(int(v) for g, _, _, v in rows if g == r.g)


def test_rank_rules(frame):
    df = frame(
        "as_of_date int, entity_id int, a int, b int",
        (1, 1, 5, 1), (1, 2, 5, 2), (1, 3, 7, 9), (1, 4, 5, 1), (2, 5, 0, 0),
    )
    rules = [RankRule("a"), RankRule("b", low_value_high_score=True)]
    got = rank_multi_feature(df, rules)
    assert tuples(got, "entity_id", "rank") == [(1, 2), (2, 3), (3, 1), (4, 2), (5, 1)]
    scores = {r.entity_id: r.score for r in got.collect()}
    assert scores == pytest.approx({1: 2 / 3, 2: 1 / 3, 3: 1.0, 4: 2 / 3, 5: 1.0})


def test_equity_and_random_pick(frame):
    df = frame(PRED, *[(1, i, float(i // 4), int(i >= 6)) for i in range(8)])
    groups = frame("entity_id bigint, sex string", *[(i, "f" if i % 2 else "m") for i in range(7)])
    got = {r.sex: r for r in E.top_k_equity(df, groups, "sex", ["m"], 2).collect()}
    assert {k: r.n_cohort for k, r in got.items()} == {"f": 3, "m": 4, None: 1}
    assert {k: r.n_top for k, r in got.items()} == pytest.approx({"f": 0.5, "m": 1.0, None: 0.5})
    row = E.top_k_vs_random(df, ["m"], 2).first()
    assert (row.top_k, row.base_rate, row.gain) == (0.5, 0.25, 0.25)


def test_rank_keeps_rows_with_null_features(frame):
    df = frame(
        "as_of_date int, entity_id int, a int, b int", (1, 1, 5, None), (1, 2, None, 2), (1, 3, None, None), (1, 4, 5, 1), (1, 5, None, None)
    )
    got = rank_multi_feature(df, [RankRule("a"), RankRule("b", low_value_high_score=True)])
    assert tuples(got, "entity_id", "rank") == [(1, 1), (2, 4), (3, 3), (4, 2), (5, 3)]


@pytest.mark.parametrize("buckets", [1, 4])
def test_running_totals_over_odd_values(frame, buckets):
    """NULL, NaN and infinite values, and a first column of few values."""
    odd = [None, float("-inf"), -2.0, 0.0, 3.0, float("inf"), float("nan")]
    rows = [(1, x, y, 1) for x in odd for y in (None, 1, 2, 50)]
    df = frame("g int, x double, y int, v bigint", *rows)
    got = running_totals(df, ["g"], [("x", False), ("y", True)], ["v"], buckets).orderBy("before_v").collect()
    assert [r.before_v for r in got] == list(range(len(rows)))
    assert [(repr(r.x), r.y) for r in got] == [(repr(x), y) for x in odd for y in (50, 2, 1, None)]
