"""Runs of a study and their tables, over a few made stays."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hindcast.operators import features as X
from hindcast.operators import signals as S
from hindcast.operators.models import ModelSpec
from hindcast.operators.spine import TemporalConfig, label_bounds
from hindcast.plans import runs as R
from hindcast.plans.study import Study
from tests.conftest import tuples

ONE = TemporalConfig("1year", "6month", "6month", "6month", "6month", "1year")
STUDY = Study(ONE, "2 years", [X.FeatureGroup("stays", (X.Aggregate("prior", ("count",)),), ("1 year", "all"))])
RANKER = ModelSpec(7, "rank_multi_feature", {"rules": [{"feature": "stays_all_prior_count"}]})
OTHER = ModelSpec(8, "rank_multi_feature", {"rules": [{"feature": "stays_1y_prior_count"}]})


@pytest.fixture(scope="module")
def tables(spark):
    stays = spark.range(120, numPartitions=1).select(
        (F.col("id") % 20).alias("entity_id"), F.col("id").alias("stay_id"), (F.col("id") % 3 == 0).cast("int").alias("screen_flag"),
        F.expr("timestamp_ntz '2010-01-01 00:00:00' + make_interval(0, 0, 0, cast(id * 7919 % 1000 as int))").alias("start_ts"),
    )
    stays = stays.withColumn("end_ts", F.expr("start_ts + make_interval(0, 0, 0, cast(stay_id % 30 as int))"))
    return stays, S.flag_log(stays, "screen", "start_ts", "screen_flag"), label_bounds(stays, "start_ts")


def test_the_newest_run_is_reported_and_a_repeated_run_replaces_itself(spark, tables, tmp_path):
    path = str(tmp_path)
    first = R.run_study(path, STUDY, [RANKER], *tables, started=datetime(2024, 1, 1), user="u")
    two = replace(STUDY, temporal=replace(ONE, training_label_timespan=("6month", "1year")))
    second = R.run_study(path, two, [RANKER, OTHER], *tables, started=datetime(2024, 2, 1), user="u")
    assert first != second
    report = R.latest_evaluations(spark, path)
    got = tuples(report, "setting_id", "split_id", "spec_id", "evaluation_end_time", "stochastic_value")
    assert {r[0] for r in got} == {1, 2} and {r[2] for r in got} == {7, 8}
    assert report.first().models_needed == len({r[:3] for r in got})
    again = R.run_study(path, two, [RANKER, OTHER], *tables, started=datetime(2024, 2, 1), user="u")
    assert again == second
    assert tuples(R.latest_evaluations(spark, path), "setting_id", "split_id", "spec_id", "evaluation_end_time", "stochastic_value") == got
    stored = R.read_run_tables(spark, path)
    assert tuples(stored["runs"], "run_hash", "current_status") == sorted([(first, "completed"), (second, "completed")])
    # The one setting of the first run is the first of the second one: its model is the same and is kept once.
    links = stored["experiment_models"]
    shared = links.filter(f"experiment_hash = '{first}'").join(links.filter(f"experiment_hash = '{second}'"), "model_hash", "left_semi")
    assert shared.count() == links.filter(f"experiment_hash = '{first}'").count() > 0
    assert stored["models"].count() == links.select("model_hash").distinct().count()
    rows = stored["predictions"].groupBy("model_id", "role", "as_of_date", "entity_id").count()
    assert rows.filter("count > 1").count() == 0 and rows.count() > 0


def test_a_failed_run_is_told_and_not_reported(spark, tables, tmp_path):
    path = str(tmp_path)
    assert R.read_run_tables(spark, path)["evaluations"].count() == 0
    with pytest.raises(ValueError, match="twice"):
        R.run_study(path, STUDY, [RANKER, replace(RANKER, model_id=9)], *tables, started=datetime(2024, 1, 1))
    assert tuples(R.read_run_tables(spark, path)["runs"], "current_status") == [("failed",)]
    assert R.latest_evaluations(spark, path).count() == 0


def test_splits_of_all_settings_are_numbered_apart(frame):
    spine = frame(
        "split_id int, role string, as_of_date date, label_timespan string, setting_id int",
        (1, "test", "2011-01-01", "6month", 1), (1, "test", "2011-02-01", "6month", 1), (2, "test", "2010-01-01", "6month", 1),
        (1, "train", "2010-01-01", "6month", 2), (1, "test", "2012-01-01", "6month", 2),
    )
    splits = R.splits_of(spine)
    assert [(s.number, s.setting_id, s.split_id, s.day) for s in splits] == [(1, 1, 1, "2011-01-01"), (2, 1, 2, "2010-01-01"), (3, 2, 1, "2012-01-01")]
    matrices = frame("setting_id int, split_id int", (1, 2), (2, 1), (1, 1), (2, 5), (None, 1))
    assert tuples(R.numbered(matrices, splits)) == sorted([(2,), (3,), (1,), (None,), (None,)], key=lambda r: tuple(map(repr, r)))
    assert tuples(R.numbered(matrices.drop("setting_id"), splits[:2])) == sorted([(2,), (1,), (1,), (1,), (None,)], key=lambda r: tuple(map(repr, r)))
