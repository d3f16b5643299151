"""Writing results, and cutting lineage through storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.asof import EVENT_DATE, EVENT_END, EVENT_MONTH


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a scratch folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="hindcast-")


def through_storage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each write are removed as soon as it is done, not when the driver next collects garbage.

    For stores made one after another, whose shuffles would otherwise lie on disk together.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_feature(feature: DataFrame, path: str, value: str, slices: int = 64) -> None:
    """Replace the stored feature `(entity_id, knowledge_date, value)`, one folder per knowledge date.

    Rows are spread by date and one of `slices` of the entities, so one crowded date does not end in one task.
    """
    spread = F.pmod(F.xxhash64("entity_id"), F.lit(slices))
    (
        feature.select("entity_id", F.col("as_of_date").alias("knowledge_date"), value)
        .repartition("knowledge_date", spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("knowledge_date")
        .parquet(path)
    )


def store_events(events: DataFrame, path: str, ts: str, slices: int = 64, end: str | None = None) -> None:
    """Keep linked events once: a DATE beside the timestamp, one folder per month, entities together within a file.

    Readers that bound the date (see `operators.asof.within`) then open only the months they need. Of events that last,
    `end` names the end's timestamp: its day is kept too, in the order of the rows of a date, so that readers of what is
    still open (see `operators.cohorts.ends_from`) skip what has ended.
    """
    dated = events.withColumn(EVENT_DATE, F.col(ts).cast("date"))
    dated = dated.withColumn(EVENT_MONTH, F.trunc(EVENT_DATE, "month"))
    order = [EVENT_MONTH, EVENT_DATE, "entity_id"]
    if end:
        dated = dated.withColumn(EVENT_END, F.col(end).cast("date"))
        order = [EVENT_MONTH, F.col(EVENT_END).isNull(), EVENT_DATE, "entity_id"]
    spread = F.pmod(F.xxhash64("entity_id"), F.lit(slices))
    (
        dated.repartition(EVENT_MONTH, spread)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(EVENT_MONTH)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str, like: DataFrame, ended: bool = False) -> DataFrame:
    """Stored events with the columns of `like`, the date and the month, and the day of the end if it was stored."""
    names = [EVENT_DATE, *([EVENT_END] if ended else []), EVENT_MONTH]
    schema = T.StructType([*like.schema.fields, *[T.StructField(n, T.DateType()) for n in names]])
    return spark.read.schema(schema).parquet(path)


def save_predictions(predictions: DataFrame, path: str, slices: int = 64) -> None:
    """Keep scores and labels, one folder per model and as-of date; other models' folders stay."""
    spread = F.pmod(F.xxhash64("entity_id"), F.lit(slices))
    (
        predictions.repartition("model_id", "as_of_date", spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_id", "as_of_date")
        .parquet(path)
    )


def sorted_report(df: DataFrame, *order) -> DataFrame:
    """The report in its printed order (a range-partitioned sort)."""
    return df.orderBy(*order)
