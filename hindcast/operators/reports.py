"""Reports on runs, cohorts, labels and evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_run(runs: DataFrame, only_completed: bool = True) -> DataFrame:
    """The newest run; a tie on start time goes to the greatest hash."""
    rows = runs.filter("current_status = 'completed'") if only_completed else runs
    return rows.orderBy(F.desc("start_time"), F.desc("run_hash")).limit(1)


def run_config_lookup(experiments: DataFrame, run: DataFrame, section: str = "temporal_config") -> DataFrame:
    """One section of a run's JSON config as sorted key and value rows."""
    hashes = run.select(F.col("run_hash").alias("experiment_hash"))
    found = experiments.join(hashes, "experiment_hash", "left_semi")
    entries = F.from_json(F.get_json_object("config", f"$.{section}"), "map<string,string>")
    return found.select("experiment_hash", F.explode(entries).alias("key", "value")).orderBy("experiment_hash", "key")


def model_short_name(model_type: Column | str) -> Column:
    return F.substring_index(model_type, ".", -1)


def evaluations_of_latest_run(
    runs: DataFrame,
    experiments: DataFrame,
    experiment_models: DataFrame,
    models: DataFrame,
    evaluations: DataFrame,
    metric: str = "precision@",
    parameter: str = "100_abs",
) -> DataFrame:
    """Evaluations of the models of the newest completed run, by model type and date.

    The single newest run comes first, so each later join starts from the few rows it selects.
    """
    run = latest_run(runs).withColumnRenamed("run_hash", "experiment_hash")
    return (
        run.join(experiments, "experiment_hash")
        .join(experiment_models, "experiment_hash")
        .join(models, "model_hash")
        .join(evaluations.filter((F.col("metric") == metric) & (F.col("parameter") == parameter)), "model_id")
        .select(
            "metric",
            "parameter",
            "evaluation_end_time",
            "model_id",
            "model_type",
            model_short_name("model_type").alias("model_type_short"),
            "hyperparameters",
            "best_value",
            "worst_value",
            "stochastic_value",
            "standard_deviation",
            "time_splits",
            "as_of_times",
            "total_features",
            "models_needed",
            "os_user",
            "batch_run_time",
        )
        .orderBy("model_type", "evaluation_end_time")
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """Rows, distinct entities, active and inactive rows per date.

    Rows are reduced per entity first, so the distinct count needs no second pass over them.
    """
    per_entity = cohort.groupBy("as_of_date", "entity_id").agg(
        F.count("entity_id").alias("n"), F.count(F.when(F.col("active"), 1)).alias("a"), F.count(F.lit(1)).alias("r")
    )
    return per_entity.groupBy("as_of_date").agg(
        F.sum("n").alias("total_rows"),
        F.count("entity_id").alias("n_entities"),
        F.sum("a").alias("active_rows"),
        F.sum(F.col("r") - F.col("a")).alias("inactive_rows"),
    )


def label_summary(labels: DataFrame, keys: Sequence[str] = ("as_of_date", "label_timespan")) -> DataFrame:
    """Positives, the rest, unknowns, labelled rows and integer percents."""
    rows, positive = F.col("n_rows"), F.col("n_positive")
    return (
        labels.groupBy(*keys)
        .agg(
            F.sum("label").alias("n_positive"),
            F.count("entity_id").alias("n_rows"),
            F.count(F.when(F.col("label").isNull(), 1)).alias("n_null"),
            F.count("label").alias("n_labelled"),
        )
        .select(
            *keys,
            "n_positive",
            (rows - positive).alias("n_negative"),
            "n_null",
            "n_labelled",
            F.expr("100 * n_positive div n_rows").alias("pct_positive"),
            F.expr("100 * (n_rows - n_positive) div n_rows").alias("pct_negative"),
        )
        .orderBy(*keys)
    )


def label_summary_basic(labels: DataFrame, keys: Sequence[str] = ("as_of_date", "label_timespan")) -> DataFrame:
    per_entity = labels.groupBy(*keys, "entity_id").agg(F.count("entity_id").alias("n"), F.sum("label").alias("p"))
    return (
        per_entity.groupBy(*keys)
        .agg(F.sum("n").alias("n_rows"), F.count("entity_id").alias("n_entities"), F.sum("p").alias("n_positive"))
        .withColumn("pct_positive", F.expr("100 * n_positive div n_rows"))
    )


def label_pull_comparison(labels: DataFrame, keys: Sequence[str] = ("as_of_date", "label_timespan")) -> DataFrame:
    """Rows, distinct ids, ones, zeros and unknowns of each pull."""
    per_entity = labels.groupBy(*keys, "entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("label") == 1, 1)).alias("p"),
        F.count(F.when(F.col("label") == 0, 1)).alias("z"),
    )
    return per_entity.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("p").alias("n_ones"),
        F.sum("z").alias("n_zeros"),
        F.sum(F.col("n") - F.col("p") - F.col("z")).alias("n_null"),
    )
