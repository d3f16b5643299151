"""Train and test matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.asof import KEYS
from hindcast.operators.joins import null_safe_join


def matrix_build(labels: DataFrame, features: Sequence[DataFrame], spine: DataFrame) -> DataFrame:
    """Labelled cohort x feature groups, one row per `(split_id, role, entity_id, as_of_date)`.

    A spine of several settings puts `setting_id` in front; what the settings share is built once. All inputs are keyed by `(entity_id, as_of_date)`, as their aggregations left them, so the joins need no
    further shuffle. Split and role are looked up in the short spine without a join; a row goes where the
    spine asks for its date and `label_timespan`.
    """
    rows = labels
    for group in features:
        rows = rows.join(group, KEYS, "left")
    matrix = [c for c in ("setting_id", "split_id", "role") if c in spine.columns]
    places = spine.agg(F.collect_set(F.struct(*matrix, "as_of_date", "label_timespan"))).scalar()
    wanted = F.filter(
        "_places",
        lambda s: (s["as_of_date"] == F.col("as_of_date")) & (s["label_timespan"] == F.col("label_timespan")),
    )
    placed = rows.withColumn("_places", places).withColumn("_place", F.explode(wanted))
    kept = [c for c in rows.columns if c != "label_timespan"]
    return placed.select(*[f"_place.{c}" for c in matrix], *kept)


def training_rows(matrix: DataFrame) -> DataFrame:
    return matrix.filter("role = 'train' and label is not null")


def resample_groups(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Thin the larger groups so that all are expected to reach the size of the smallest.

    A row stays when a hash of its key falls under its group's share: the choice depends on the row alone,
    so it is the same on every run and after any lost executor. Rows without a group are a group like the others.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    smallest = sizes.agg(F.min("_size")).scalar()
    shares = sizes.select(group, (smallest / F.col("_size")).alias("_share"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return null_safe_join(rows, shares, [group]).filter(point < F.col("_share")).select(*rows.columns)
