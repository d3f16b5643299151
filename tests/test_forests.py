import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from hindcast.operators import forests as B
from hindcast.operators import models as Z

FOREST = Z.ModelSpec(1, "random_forest", {"n_estimators": 8, "max_depth": 50, "min_samples_split": 6})
TREE = Z.ModelSpec(2, "decision_tree", {"max_depth": 4, "max_features": 2, "min_samples_split": 20})


@pytest.fixture(scope="module")
def matrix(spark):
    """2000 rows with 40 values of `a` times 5 of `b`; the label follows both, not always."""
    return spark.range(2000).select(
        F.lit(1).alias("split_id"), F.lit("train").alias("role"), F.col("id").alias("entity_id"),
        F.to_date(F.lit("2000-01-01")).alias("as_of_date"),
        ((F.col("id") * 7 % 40 + F.col("id") % 5 * 6 + F.col("id") * 31 % 11) > 34).cast("int").alias("label"),
        (F.col("id") * 7 % 40).cast("int").alias("a"), (F.col("id") % 5).cast("bigint").alias("b"),
    )


def test_forests_are_grown_without_a_pass_over_the_rows_per_level(matrix, monkeypatch):
    def per_level(self, rows):
        raise AssertionError("Spark ML reads all rows for every level")

    monkeypatch.setattr(RandomForestClassifier, "fit", per_level)
    fitted = Z.fit_grid(matrix, ["a", "b"], [FOREST, TREE], [1])
    assert fitted[1, 1].stages[-1].getNumTrees == 8 and fitted[2, 1].stages[-1].getNumTrees == 1
    stats = Z.tree_nodes(fitted[1, 1]).where("node = 0").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert 1700 < stats[0] < stats[1] < 2300 and stats[2] > 4  # each tree has a bootstrap of all rows
    least = Z.tree_nodes(fitted[1, 1]).agg(F.min("n")).scalar()
    assert matrix.select(least).first()[0] >= 3


def test_a_tree_is_the_one_that_spark_grows_from_the_rows(spark, matrix):
    """Below 33 values both lay the same thresholds; without a bootstrap and with all features the tree is one."""
    rows = Z.with_vector(matrix.withColumn("a", F.col("a") % 30), ["a", "b"])
    forest = Z._forest({"max_depth": 6, "min_samples_split": 20}, 1, "2", False, 7)
    mine = B.fit_forest(spark, B.groups_of(rows, 2), forest).toDebugString.split("\n")[1:]
    assert mine == forest.fit(rows).toDebugString.split("\n")[1:] and len(mine) > 8


def test_too_many_groups_and_unknown_labels_are_left_to_spark(matrix):
    rows = Z.with_vector(matrix, ["a", "b"])
    assert B.groups_of(rows, 2, most=10) is None
    assert B.groups_of(rows.filter("false"), 2) is None
    assert B.groups_of(rows.withColumn("label", F.lit(2)), 2) is None
    bins, counts, cuts = B.groups_of(rows, 2)
    assert counts.sum() == 2000 and len(cuts[0]) == 31 and len(cuts[1]) == 4 and len(bins) <= 32 * 5


def test_digests_keep_all_rows():
    values, counts = B.digest(np.arange(1000.0), np.ones(1000, int), 10)
    assert counts.sum() == 1000 and values.tolist() == [100.0 * i - 1 for i in range(1, 11)]
    assert B.thresholds_of(np.array([1.0, 2.0, 5.0]), np.array([1, 1, 1])).tolist() == [1.5, 3.5]
    assert len(B.thresholds_of(np.arange(1000.0), np.ones(1000, int))) == 31


def test_scores_by_bins_are_the_scores_of_the_rows(matrix):
    """Rows of all values, also between and beyond the thresholds."""
    names = ["a", "b"]
    rows = matrix.withColumn("a", F.col("a") * 1.37 - 3)
    for spec in (FOREST, TREE):
        model = Z.fit(matrix, names, spec)
        apart = {r["entity_id"]: r["score"] for r in Z.score(model, Z.with_vector(rows, names).drop(*names), names).collect()}
        binned = {r["entity_id"]: r["score"] for r in Z.score(model, rows, names).collect()}
        assert binned == apart and len(set(apart.values())) > 2
        told = Z.told_score(rows, Z.tree_nodes(model), names, Z.MAX_DEPTH).collect()
        assert all(abs(r["told"] - apart[r["entity_id"]]) < 1e-9 for r in told) and len(told) == 2000
