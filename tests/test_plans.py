"""What the physical plans must and must not contain."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fixtures.registry import QUERIES
from hindcast.operators.asof import known_within
from hindcast.operators.cohorts import cohort_table
from hindcast.operators.joins import running_totals
from hindcast.sources import sinks

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

LAZY = sorted(
    n for n in QUERIES
    if not n.startswith(("model_", "study_")) and not n.endswith("_stored")
    and n not in ("feature_importance", "materialize_feature", "predictions_save", "matrix_build_sources")
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_no_python(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "Scan ExistingRDD"):
        assert word not in text


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


def rows_read(df):
    """Rows that the file scans of an executed frame gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        inner = leaf.plan().collectLeaves() if "QueryStage" in leaf.nodeName() else None
        for scan in [inner.apply(k) for k in range(inner.size())] if inner else [leaf]:
            if "Scan parquet" in scan.nodeName():
                total += scan.metrics().apply("numOutputRows").value()
    return total


def test_stored_events_are_read_by_date(spark, tmp_path):
    """Not the explain text: the rows that come out of the scan."""
    days = spark.range(40_000).select(
        (F.col("id") % 500).alias("entity_id"),
        (F.lit("1990-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 4000)).alias("start_ts"),
    )
    days = days.withColumn("end_ts", F.col("start_ts") + F.expr("interval '1' day"))
    path = str(tmp_path / "events")
    sinks.store_events(days, path, "start_ts", slices=2)
    stored = sinks.read_events(spark, path, days)
    wanted = days.filter("start_ts >= date '1995-01-01' and start_ts <= date '1996-01-01'").count()
    found = known_within(stored, "start_ts", ["1996-01-01"], "1yr").select("entity_id", "as_of_date")
    assert wanted <= rows_read(found) <= 1.2 * wanted
    facts = cohort_table(stored, ["1996-01-01"], "1yr")
    assert rows_read(facts) <= 1.2 * wanted


def test_ranges_spread_a_two_valued_first_column(spark):
    rows = spark.range(200_000).select(
        F.lit(1).alias("g"), (F.col("id") % 2).alias("a"), F.xxhash64("id").alias("b"), F.lit(1).alias("one")
    )
    found = running_totals(rows, ["g"], [("a", True), ("b", False)], ["one"])
    best = found.select((F.col("before_one") + 1).alias("r"), "a", "b", "total_one")
    check = best.agg(F.min("r"), F.max("r"), F.countDistinct("r"), F.min("total_one")).first()
    assert tuple(check) == (1, 200_000, 200_000, 200_000)
    first = best.orderBy("r").limit(3).collect()
    want = rows.orderBy(F.desc("a"), "b").limit(3).collect()
    assert [(r.a, r.b) for r in first] == [(r.a, r.b) for r in want]


def test_label_query_aggregates_once_by_entity_and_date(spark):
    text = plan(entry.queries()["label_reevent_long"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning(entity_id") == 1
    assert "as_of_date" in text.split("Exchange hashpartitioning(entity_id")[1][:60]


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["cohort_any_closed_stay"](spark, FOLDER))
    assert "o_orderkey" not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_id", "as_of_date", "label"] and df.count() > 0
