"""Runs of a study, and the tables they leave behind: runs, experiments, their models, evaluations and predictions.

An experiment is a study with its grid of models; its hash is that of its settings. A model's hash is that of all that
its fit depends on but the data: settings, features, parameters, seed and the day of its split. Hashes are the same on
every run, so a run that is repeated replaces its rows and those of its models, and a lost run can simply be run again.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hindcast.operators.evaluation import Cuts, evaluate
from hindcast.operators.models import ModelSpec, model_grid
from hindcast.operators.reports import evaluations_of_latest_run, latest_run
from hindcast.plans.study import Study
from hindcast.presets import RANDOM_SEED
from hindcast.sources.sinks import save_predictions, through_storage

RUN = "run_hash string, start_time timestamp_ntz, os_user string, current_status string, batch_run_time double"
EXPERIMENT = "experiment_hash string, config string, time_splits int, as_of_times int, total_features int, models_needed int"
LINK = "experiment_hash string, model_hash string, spec_id int, setting_id int, split_id int"
FITTED = "number int, spec_id int, setting_id int, split_id int, model_hash string, model_id bigint, model_type string, hyperparameters string, split_date date"
MODEL = "experiment_hash string, model_hash string, model_id bigint, model_type string, hyperparameters string, split_date date"
VALUES = "k bigint, best_value double, worst_value double, stochastic_value double, standard_deviation double"
EVALUATION = f"evaluation_end_time date, metric string, parameter string, {VALUES}, model_id bigint"
PREDICTION = "role string, entity_id bigint, score double, label int, model_id bigint, as_of_date date"


@dataclass(frozen=True)
class Split:
    """One split of one setting; `number` is unique over all settings."""

    number: int
    setting_id: int
    split_id: int
    day: str


def _digest(*parts: object) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def splits_of(spine: DataFrame) -> list[Split]:
    """The splits of a spine, one short row each; their day is the first test date."""
    keys = [c for c in ("setting_id", "split_id") if c in spine.columns]
    days = spine.filter("role = 'test'").groupBy(*keys).agg(F.min("as_of_date").alias("day")).orderBy(*keys)
    rows = [r.asDict() for r in days.collect()]
    return [Split(i, r.get("setting_id", 1), r["split_id"], r["day"].isoformat()) for i, r in enumerate(rows, 1)]


def numbered(matrices: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Matrices with the number of each split in the place of setting and split."""
    setting = F.col("setting_id") if "setting_id" in matrices.columns else F.lit(1)
    places = {}
    for s in splits:
        places.setdefault(s.setting_id, {})[s.split_id] = s.number
    number = F.lit(None).cast("int")
    for setting_id, found in places.items():
        lookup = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
        number = F.when(setting == setting_id, F.try_element_at(lookup, F.col("split_id"))).otherwise(number)
    return matrices.withColumn("split_id", number).drop("setting_id")


def experiment_config(study: Study, specs: Sequence[ModelSpec], seed: int = RANDOM_SEED) -> str:
    """All settings of an experiment as JSON; the section `temporal_config` is flat."""
    temporal = {k: v if isinstance(v, str) else json.dumps(v) for k, v in asdict(study.temporal).items()}
    sections = {
        "temporal_config": temporal,
        "lookback": study.lookback,
        "features": {
            "stays": [asdict(g) for g in study.groups],
            "recency": study.recency,
            "sources": {name: asdict(source) for name, source in study.sources.items()},
        },
        "grid": [{"kind": s.kind, **s.params} for s in specs],
        "random_seed": seed,
    }
    return json.dumps(sections, sort_keys=True, default=str)


def experiment_models(study: Study, specs: Sequence[ModelSpec], splits: Sequence[Split], seed: int = RANDOM_SEED) -> list[tuple]:
    """`(number, spec_id, setting_id, split_id, model_hash, model_id, model_type, hyperparameters, split_date)` of every fit."""
    config = json.loads(experiment_config(study, specs, seed))
    settings = study.temporal.settings()
    rows = []
    for split in splits:
        for spec in specs:
            asked = json.dumps({**spec.params, "effective": spec.effective()}, sort_keys=True)
            setting = asdict(settings[split.setting_id - 1])
            digest = _digest(spec.kind, asked, seed, setting, config["lookback"], config["features"], split.day)
            day = datetime.fromisoformat(split.day).date()
            kind = f"hindcast.{spec.kind}"
            rows.append((split.number, spec.model_id, split.setting_id, split.split_id, digest, int(digest[:15], 16), kind, asked, day))
    return rows


def _save(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the rows that share `keys` with those of `df`; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _save_status(spark: SparkSession, path: str, run: tuple) -> None:
    rows = spark.createDataFrame([run], RUN).withColumn("started", F.date_format("start_time", "yyyyMMddHHmmssSSSSSS"))
    _save(rows.coalesce(1), f"{path}/runs", "run_hash", "started")


def run_study(
    path: str,
    study: Study,
    specs: Sequence[ModelSpec],
    stays: DataFrame,
    log: DataFrame,
    bounds: DataFrame,
    events: Mapping[str, DataFrame] | None = None,
    cuts: Cuts = Cuts((100,), ()),
    seed: int = RANDOM_SEED,
    started: datetime | None = None,
    user: str | None = None,
) -> str:
    """Build matrices, fit and score the grid on every split of every setting, evaluate; the experiment's hash.

    The run is `started` until all its tables are written, then `completed`; an error leaves it `failed`.
    """
    spark, began = stays.sparkSession, time.monotonic()
    config = experiment_config(study, specs, seed)
    run, start, user = _digest(config), started or datetime.now(), user or getpass.getuser()
    status = lambda text: _save_status(spark, path, (run, start, user, text, time.monotonic() - began))
    status("started")
    try:
        spine = study.spine(bounds)
        splits = splits_of(spine)
        models = experiment_models(study, specs, splits, seed)
        days = spine.select("as_of_date").distinct().count()
        ids = [m[5] for m in models]
        if len(set(ids)) < len(ids):
            raise ValueError("the grid lists a model twice")
        table = spark.createDataFrame(models, FITTED).withColumn("experiment_hash", F.lit(run))
        # One folder per split, so that a fit opens that of its split only.
        matrices = through_storage(numbered(study.matrices(stays, log, bounds, events), splits), "matrices", ("split_id", "role"))
        found = model_grid(matrices, study.feature_names(), specs, [s.number for s in splits], seed)
        found = found.withColumnsRenamed({"model_id": "spec_id", "split_id": "number"})
        found = found.join(table.select("spec_id", "number", "model_id"), ["spec_id", "number"])
        save_predictions(found.select("role", "entity_id", "score", "label", "model_id", "as_of_date"), f"{path}/predictions")
        # This run's predictions only: folders of other models are not opened.
        scored = _read(spark, path, "predictions").filter(F.col("model_id").isin(ids)).filter("role = 'test'")
        metrics = evaluate(scored.withColumnRenamed("as_of_date", "evaluation_end_time"), ["model_id", "evaluation_end_time"], cuts)
        _save(metrics.repartition("model_id"), f"{path}/evaluations", "model_id")
        one = table.coalesce(1)
        _save(one.select("model_hash", "spec_id", "setting_id", "split_id", "experiment_hash"), f"{path}/experiment_models", "experiment_hash")
        kept = ["model_hash", "model_id", "model_type", "hyperparameters", "split_date", "experiment_hash"]
        _save(one.select(*kept), f"{path}/models", "experiment_hash")
        facts = (run, config, len(splits), days, len(study.feature_names()), len(models))
        _save(spark.createDataFrame([facts], EXPERIMENT).coalesce(1), f"{path}/experiments", "experiment_hash")
    except Exception:
        status("failed")
        raise
    status("completed")
    return run


SCHEMAS = {
    "runs": RUN,
    "experiments": EXPERIMENT,
    "experiment_models": LINK,
    "models": MODEL,
    "evaluations": EVALUATION,
    "predictions": PREDICTION,
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table; empty before a run has written any of it."""
    columns = StructType.fromDDL(SCHEMAS[name])
    try:
        return spark.read.schema(columns).parquet(f"{path}/{name}").select(*columns.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_run_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored tables by name. A model that several experiments share is one row of `models`."""
    tables = {name: _read(spark, path, name) for name in SCHEMAS}
    tables["models"] = tables["models"].drop("experiment_hash").dropDuplicates(["model_hash"])
    return tables


def latest_evaluations(spark: SparkSession, path: str, **which: str) -> DataFrame:
    """Evaluations of the newest completed run; `spec_id, setting_id, split_id` tell the fit each belongs to."""
    t = read_run_tables(spark, path)
    report = evaluations_of_latest_run(t["runs"], t["experiments"], t["experiment_models"], t["models"], t["evaluations"], **which)
    run = latest_run(t["runs"]).select(F.col("run_hash").alias("experiment_hash"))
    fits = t["experiment_models"].join(run, "experiment_hash", "left_semi").join(t["models"].select("model_hash", "model_id"), "model_hash")
    return report.join(fits.select("model_id", "spec_id", "setting_id", "split_id"), "model_id")
