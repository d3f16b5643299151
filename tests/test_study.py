import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from hindcast.operators import matrix as M
from hindcast.operators import models as Z
from hindcast.operators import profiles as P
from hindcast.operators import ranking as K
from hindcast.operators import reports as R
from hindcast.sources import sinks
from hindcast.sources.tables import JdbcRange, JdbcSource, load_source
from tests.conftest import tuples

XWALK = "entity_id bigint, source string, source_key string, hash_key string"


def test_matrix_places_rows_by_date_and_timespan(frame):
    labels = frame(
        "entity_id bigint, as_of_date date, label_timespan string, label int",
        (1, "2000-01-01", "6month", 1), (1, "2000-01-01", "1year", 1), (1, "1999-01-01", "6month", 0), (2, "1990-01-01", "6month", 0),
    )
    features = frame("entity_id bigint, as_of_date date, f int", (1, "2000-01-01", 5))
    spine = frame(
        "split_id int, role string, as_of_date date, label_timespan string",
        (1, "test", "2000-01-01", "6month"), (1, "train", "1999-01-01", "6month"), (2, "test", "1999-01-01", "6month"),
    )
    got = M.matrix_build(labels, [features], spine)
    assert tuples(got, "split_id", "role", "entity_id", "label", "f") == [
        (1, "test", 1, 1, 5), (1, "train", 1, 0, None), (2, "test", 1, 0, None)
    ]
    assert tuples(M.training_rows(got), "split_id") == [(1,)]


def test_resampling_is_stable_and_balances(spark):
    rows = spark.range(4000).select(F.col("id").alias("entity_id"), (F.col("id") < 500).cast("int").alias("label"))
    kept = M.resample_groups(rows, "label", "entity_id", 7)
    sizes = dict(tuples(kept.groupBy("label").count()))
    assert sizes[1] == 500 and 400 < sizes[0] < 600
    again = M.resample_groups(rows.repartition(7), "label", "entity_id", 7)
    assert tuples(kept, "entity_id") == tuples(again, "entity_id")


def test_resampling_keeps_rows_without_group(frame):
    rows = frame("entity_id bigint, label int", (1, 0), (2, 1), (3, None))
    assert tuples(M.resample_groups(rows, "label", "entity_id", 7), "entity_id") == [(1,), (2,), (3,)]


@pytest.fixture(scope="module")
def matrix(spark):
    """Label follows feature a; b is noise."""
    rows = spark.range(600).select(
        F.lit(1).alias("split_id"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("role"),
        F.col("id").alias("entity_id"),
        F.to_date(F.lit("2000-01-01")).alias("as_of_date"),
        (F.col("id") % 10 >= 7).cast("int").alias("label"),
        (F.col("id") % 10).cast("int").alias("a"),
        (F.col("id") * 7919 % 101).cast("int").alias("b"),
    )
    return rows.cache()


def test_grid_expansion():
    specs = Z.expand_grid(Z.GRID)
    assert [s.kind for s in specs] == ["random_forest"] + ["decision_tree"] * 5 + ["scaled_logistic"]
    assert [s.params.get("max_features") for s in specs[1:6]] == [1, 2, 3, 4, 5]


def test_effective_parameters_are_recorded(spark):
    forest = Z.expand_grid(Z.GRID)[0]
    assert forest.params["max_depth"] == 50 and forest.effective()["max_depth"] == 30
    rows = Z.model_table([forest, Z.ModelSpec(9, "rank_multi_feature", {})], [1, 2], "run").collect()
    assert len({r.model_hash for r in rows}) == 4
    assert '"max_depth": 50' in rows[0].hyperparameters and '"effective": {"max_depth": 30' in rows[0].hyperparameters


def test_models_separate_and_cover_every_row(matrix):
    specs = [
        Z.ModelSpec(1, "random_forest", {"n_estimators": 10, "max_depth": 50, "min_samples_split": 25}),
        Z.ModelSpec(2, "decision_tree", {"max_depth": 3, "max_features": 2, "min_samples_split": 25}),
        Z.ModelSpec(3, "scaled_logistic", {"C": 0.1, "penalty": "l1"}),
        Z.ModelSpec(4, "rank_multi_feature", {"rules": [{"feature": "a"}]}),
    ]
    found = Z.model_grid(matrix, ["a", "b"], specs, [1])
    assert tuples(found.groupBy("model_id").count()) == [(i, 600) for i in (1, 2, 3, 4)]
    means = found.groupBy("model_id").agg(
        F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("p"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("n"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    )
    assert all(r.p > r.n and 0 <= r.low <= r.high <= 1 for r in means.collect())


def test_importance_and_seed(matrix):
    train = M.training_rows(matrix)
    spec = Z.ModelSpec(1, "random_forest", {"n_estimators": 10, "max_depth": 5, "min_samples_split": 4})
    first, second = (Z.feature_importance(Z.fit(train, ["a", "b"], spec), ["a", "b"]) for _ in range(2))
    weights = dict(tuples(first))
    assert weights["a"] > weights["b"] and sum(weights.values()) == pytest.approx(1)
    assert tuples(first) == tuples(second)
    with pytest.raises(ValueError):
        Z.fit(train, ["a"], Z.ModelSpec(1, "oracle"))


def test_told_trees_say_what_the_forest_scores(spark, matrix):
    train = M.training_rows(matrix)
    for spec in (
        Z.ModelSpec(1, "random_forest", {"n_estimators": 7, "max_depth": 6, "min_samples_split": 10}),
        Z.ModelSpec(2, "decision_tree", {"max_depth": 3, "max_features": 1, "min_samples_split": 25}),
    ):
        model = Z.fit(train, ["a", "b"], spec)
        nodes = Z.tree_nodes(model)
        depth = max(t.depth for t in model.stages[-1].trees)
        walked = Z.told_score(matrix, nodes, ["a", "b"], depth).select("entity_id", "told")
        trees = Z.told_trees(nodes, ["a", "b"])
        by_text = matrix.select("entity_id", F.expr(f"({' + '.join(trees)}) / {len(trees)}").alias("by_text"))
        rows = Z.score(model, matrix, ["a", "b"]).join(walked, "entity_id").join(by_text, "entity_id").collect()
        assert len(rows) == 600 and len({r.score for r in rows}) > 1
        assert all(abs(r.score - r.told) < 1e-12 and abs(r.told - r.by_text) < 1e-12 for r in rows)
        # A constant score, as of a model that was not fitted, is told from the trees.
        assert any(abs(0.5 - r.told) > 1e-3 for r in rows)
        weights = dict(tuples(Z.feature_importance(model, ["a", "b"])))
        assert dict(tuples(Z.gain_importance(nodes, ["a", "b"]))) == pytest.approx(weights)


def test_optimality_holds_for_fits_only(matrix):
    train = M.training_rows(matrix)
    spec = Z.ModelSpec(3, "scaled_logistic", {"C": 1.0, "penalty": "l1"})
    model = Z.fit(train, ["a", "b"], spec)
    rows = {r.feature: r for r in Z.optimality(model, train, ["a", "b"], spec).collect()}
    assert set(rows) == {"(intercept)", "a", "b"} and all(r.holds for r in rows.values())
    assert rows["a"].coefficient > 0
    # Judged by a tenth of the penalty, or on other rows, the same coefficients are no optimum.
    other = Z.ModelSpec(3, "scaled_logistic", {"C": 10.0, "penalty": "l1"})
    assert not all(r.holds for r in Z.optimality(model, train, ["a", "b"], other).collect())
    turned = train.withColumn("label", 1 - F.col("label"))
    assert not any(r.holds for r in Z.optimality(model, turned, ["a", "b"], spec).collect() if r.feature != "b")


def test_fits_side_by_side_are_the_fits_one_by_one(matrix):
    specs = [Z.ModelSpec(i, "decision_tree", {"max_depth": 3, "max_features": 1 + i % 2, "min_samples_split": 25}) for i in range(4)]
    found = Z.fit_grid(matrix, ["a", "b"], specs, [1], at_once=4)
    assert list(found) == [(i, 1) for i in range(4)]
    for i, spec in enumerate(specs):
        alone = Z.fit(M.training_rows(matrix), ["a", "b"], spec)
        assert alone.stages[-1].toDebugString.split("\n")[1:] == found[i, 1].stages[-1].toDebugString.split("\n")[1:]


def test_rule_sets_in_one_pass_equal_each_alone(spark):
    rng = random.Random(1)
    values = [None, float("nan"), float("inf"), float("-inf"), -1.0, -0.0, 0.0, 2.0, 2.5]
    rows = [(i, i % 2, i % 3, rng.choice(values), rng.choice(values), rng.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, split_id int, day int, a double, b double, c int").repartition(5)
    sets = {
        7: [K.RankRule("a"), K.RankRule("b", low_value_high_score=True)], 8: [K.RankRule("c", low_value_high_score=True)],
        9: [K.RankRule("b", low_value_high_score=True), K.RankRule("a"), K.RankRule("c")], 10: [K.RankRule("b")],
    }
    found = K.rank_rule_sets(df, sets, ["split_id", "day"], "rules")
    for key, rules in sets.items():
        alone = K.rank_multi_feature(df.withColumn("g", F.struct("split_id", "day")), rules, "g")
        assert tuples(found.filter(F.col("rules") == key), "id", "rank", "score") == tuples(alone, "id", "rank", "score")


def test_profile_by_source(frame):
    crosswalk = frame(XWALK, (1, "A", "1", None), (1, "H", None, "h"), (2, "A", "2", None), (2, "B", "1", None), (2, "A", "2", None))
    twice = frame("k bigint, p int", (1, 0), (1, 1))
    hashed = frame("h string, m int", ("h", 1))
    got = P.profile_by_source(crosswalk, [P.Attachment("A", twice, "k"), P.Attachment("H", hashed, "h", "hash_key")])
    assert tuples(got, "entity_id", "source", "p", "m") == [
        (1, "A", 0, None), (1, "A", 1, None), (1, "H", None, 1), (2, "A", None, None), (2, "B", None, None)
    ]


def test_composite_target(frame):
    df = frame("k int, r int, a int, b int", (1, 1, 1, None), (2, 1, 0, None), (3, None, 1, 1), (4, 1, None, None), (5, 1, 0, 1))
    assert tuples(P.label_composite_target(df, "r", ["a", "b"]), "k", "target") == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]


def test_flagged_by_person_duplicates_unless_deduped(frame):
    index = frame("urno bigint, n string", (1, "5"), (2, "5"))
    records = frame("urno bigint, f string", (1, "Y"), (2, "N"), (2, "?"))
    assert tuples(P.flagged_by_person(index, records, "urno", "n", "f", "s")) == [(5, 0), (5, 1)]
    assert tuples(P.flagged_by_person(index, records, "urno", "n", "f", "s", dedupe=True)) == [(5, 1)]


def test_profile_patient_keys(frame):
    calls = frame("patid bigint, n int", (1, 4), (2, 5))
    admissions = frame("patid bigint, d int", (1, 1),)
    payors = frame("patid bigint, payor string", (1, "x"), (2, "y"))
    scores = frame("patid bigint, hi int", (3, 9))
    ids = frame("entity_id bigint, source_key bigint", (10, 1), (20, 2))
    universe = frame("entity_id bigint", (10,), (20,), (30,))
    args = (calls, admissions, payors, scores, ids, universe, "patid")
    assert tuples(P.profile_patient(*args), "patid", "n", "d", "payor", "hi", "entity_id") == sorted(
        [(1, 4, 1, "x", None, 10), (None, 5, None, None, None, None), (None, None, None, "y", None, None),
         (None, None, None, None, 9, None), (None, None, None, None, None, 20), (None, None, None, None, None, 30)],
        key=lambda r: tuple(map(repr, r)),
    )
    assert tuples(P.profile_patient(*args, coalesce_key=True), "patid", "n", "payor", "hi", "entity_id") == sorted(
        [(1, 4, "x", None, 10), (2, 5, "y", None, 20), (3, None, None, 9, None), (None, None, None, None, 30)],
        key=lambda r: tuple(map(repr, r)),
    )


def test_label_summaries_with_unknown_labels(frame):
    labels = frame(
        "entity_id bigint, as_of_date date, label_timespan string, label int",
        (1, "2000-01-01", "6m", 1), (2, "2000-01-01", "6m", None), (3, "2000-01-01", "6m", 0), (3, "2000-01-01", "6m", 0),
    )
    assert R.label_summary(labels).first()[2:] == (1, 3, 1, 3, 25, 75)
    assert R.label_summary_basic(labels).first()[2:] == (4, 3, 1, 25)
    assert R.label_pull_comparison(labels).first()[2:] == (4, 3, 1, 2, 1)


def test_cohort_summary(frame):
    cohort = frame("entity_id bigint, as_of_date date, active boolean", (1, "2000-01-01", True), (1, "2000-01-01", None), (2, "2000-01-01", False))
    assert R.cohort_summary(cohort).first()[1:] == (3, 2, 1, 2)


def test_run_reports(frame):
    runs = frame(
        "run_hash string, current_status string, start_time timestamp_ntz, os_user string",
        ("h1", "completed", "2023-11-03 16:29:00", "u1"), ("h2", "completed", "2023-11-04 23:23:00", "u2"),
        ("h3", "failed", "2023-11-05 00:16:00", "u2"),
    )
    assert R.latest_run(runs).first().run_hash == "h2"
    assert R.latest_run(runs, only_completed=False).first().run_hash == "h3"
    config = '{"temporal_config": {"b": "2", "a": ["0day"]}, "other": 1}'
    experiments = frame("experiment_hash string, config string", ("h2", config), ("h1", "{}"))
    got = R.run_config_lookup(experiments, R.latest_run(runs)).collect()
    assert [(r.key, r.value) for r in got] == [("a", '["0day"]'), ("b", "2")]
    models = frame("t string", ("pkg.tree.RandomForest",), ("m",))
    assert tuples(models.select(R.model_short_name("t"))) == [("RandomForest",), ("m",)]


def test_sinks_round_trip(spark, frame, tmp_path):
    feature = frame("entity_id bigint, as_of_date date, s bigint", (1, "2000-01-01", 5), (2, "2001-01-01", 6))
    path = str(tmp_path / "feature")
    sinks.materialize_feature(feature, path, "s")
    sinks.materialize_feature(feature.filter("entity_id = 2"), path, "s")
    assert tuples(spark.read.parquet(path), "entity_id", "s", "knowledge_date") == [(2, 6, "2001-01-01")]

    path = str(tmp_path / "predictions")
    rows = frame("model_id int, as_of_date date, entity_id bigint, score double", (1, "2000-01-01", 1, 0.5), (2, "2000-01-01", 1, 0.7))
    sinks.save_predictions(rows, path)
    sinks.save_predictions(rows.filter("model_id = 2").withColumn("score", F.lit(0.9)), path)
    assert tuples(spark.read.parquet(path), "model_id", "score") == [(1, 0.5), (2, 0.9)]
    stored = sinks.through_storage(rows, "t", ("model_id",))
    assert stored.schema == rows.schema and tuples(stored) == tuples(rows)
    assert sorted(os.listdir(path))[-1] == "model_id=2"


class _Session:
    """As much of a session as `shared_folder` looks at."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default


def test_the_cluster_names_the_shared_folder():
    assert sinks.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        sinks.shared_folder(_Session("yarn"))
    assert os.path.isdir(sinks.shared_folder(_Session("local[4]")))


def test_sources(spark, frame, tmp_path):
    df = frame("a bigint, b string", (1, "x"))
    for fmt in ("parquet", "orc", "json"):
        df.write.format(fmt).save(str(tmp_path / f"t.{fmt}"))
        assert tuples(load_source(spark, "t", str(tmp_path), fmt, "a bigint, b string")) == [(1, "x")]
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert tuples(load_source(spark, "t", str(tmp_path), "csv", "a bigint, b string")) == [(1, "x")]
    with pytest.raises(ValueError):
        load_source(spark, "t", str(tmp_path), "xls")


def test_jdbc_reads_are_cut(spark):
    source = JdbcSource("jdbc:x", "d.Driver", {"user": "u"})
    options = source.options("cleaned.stays", JdbcRange("id", "0", "100", 8))
    assert options == {
        "url": "jdbc:x", "dbtable": "cleaned.stays", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100",
        "numPartitions": "8", "fetchsize": "10000", "driver": "d.Driver", "user": "u",
    }
    with pytest.raises(ValueError):
        load_source(spark, "cleaned.stays", source)


def test_fits_of_all_splits_run_side_by_side(matrix, monkeypatch):
    """One spec and two splits: each fit waits for the other to begin."""
    both = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(Z, "fit", lambda rows, features, spec, seed: (both.wait(), spec.model_id)[1])
    spec = Z.ModelSpec(1, "decision_tree", {"max_depth": 3, "max_features": 1, "min_samples_split": 2})
    assert Z.fit_grid(matrix, ["a", "b"], [spec], [1, 2]) == {(1, 1): 1, (1, 2): 1}


def test_forest_tasks_are_not_sent_the_trees(matrix):
    """Rows keep the node they have reached; the trees are the same as without that."""
    rows = Z.with_vector(M.training_rows(matrix), ["a", "b"])
    forest = Z._forest({"max_depth": 6, "min_samples_split": 2}, 4, "sqrt", True, 7)
    assert forest.getCacheNodeIds()
    assert forest.fit(rows).toDebugString.split("\n")[1:] == forest.copy().setCacheNodeIds(False).fit(rows).toDebugString.split("\n")[1:]
