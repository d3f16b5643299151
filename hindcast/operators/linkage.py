"""Cleaning timestamps and linking source records to one entity id through the crosswalk.

Crosswalk columns: `entity_id, source, source_key, hash_key`; one of the two keys is filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.timestamps import compose_timestamp as compose
from hindcast.operators.joins import frequency, full_outer, rows_per_key


def compose_timestamp(df: DataFrame, day: str, time: str, default_time: str, out: str) -> DataFrame:
    return df.withColumn(out, compose(F.col(day), F.col(time), default_time))


def _link_key(name: str, kind: str) -> Column:
    """`kind` is 'number' (text that must parse as a whole number), 'text' or 'hash'."""
    return F.col(name).try_cast("bigint") if kind == "number" else F.col(name)


def crosswalk_keys(crosswalk: DataFrame, source: str | None, kind: str = "number") -> DataFrame:
    """Distinct `(link_key, entity_id)` of one source, or of all sources when `source` is None."""
    rows = crosswalk if source is None else crosswalk.filter(F.col("source") == source)
    key = _link_key("hash_key" if kind == "hash" else "source_key", kind)
    return (
        rows.select(key.alias("link_key"), F.col("entity_id").cast("bigint").alias("entity_id"))
        .filter(F.col("link_key").isNotNull())
        .distinct()
    )


def link_entity(
    df: DataFrame, crosswalk: DataFrame, source: str, key: str, kind: str = "number", many: bool = False
) -> DataFrame:
    """Attach `entity_id`; unmatched rows keep NULL.

    A key shared by several entities goes to the smallest id, so that rows are never multiplied; `many=True`
    keeps every match. The crosswalk side is unique per key, so a crowded key only weighs on the left side,
    which adaptive execution splits.
    """
    keys = crosswalk_keys(crosswalk, source, kind)
    if not many:
        keys = keys.groupBy("link_key").agg(F.min("entity_id").alias("entity_id"))
    rows = df.withColumn("link_key", _link_key(key, kind))
    return rows.join(keys, "link_key", "left").drop("link_key")


def link_via(df: DataFrame, middle: DataFrame, on: str, entity: str = "entity_id") -> DataFrame:
    """Attach the entity of an intermediate record (assessment -> case -> entity)."""
    owner = (
        middle.filter(F.col(on).isNotNull())
        .groupBy(on)
        .agg(F.min(F.col(entity).cast("bigint")).alias("entity_id"))
    )
    return df.join(owner, on, "left")


def link_two_hop(
    df: DataFrame, index: DataFrame, on: str, index_key: str, crosswalk: DataFrame, source: str | None
) -> DataFrame:
    """Record -> name index by `on` -> crosswalk by text key (and tag, unless `source` is None)."""
    names = index.filter(F.col(on).isNotNull()).select(on, F.col(index_key).alias("link_key"))
    keys = crosswalk_keys(crosswalk, source, "text")
    owners = names.join(keys, "link_key").select(on, "entity_id").distinct()
    return df.join(owners, on, "left")


def link_hashed(
    raw: DataFrame, cleaned: DataFrame, on: str, hash_col: str, crosswalk: DataFrame, source: str
) -> DataFrame:
    """Raw record -> cleaned record by `on`, and raw record -> crosswalk by hashed key."""
    owners = link_entity(raw.select(on, hash_col), crosswalk, source, hash_col, "hash", many=True)
    return owners.join(cleaned, on, "left")


def linked_events(
    df: DataFrame, crosswalk: DataFrame, source: str, key: str, knowledge_date: str, attrs: Sequence[str] = ()
) -> DataFrame:
    """Inner form used as a feature source: `(entity_id, knowledge_date, attrs...)`, every match kept."""
    keys = crosswalk_keys(crosswalk, source)
    rows = df.select(
        F.col(key).try_cast("bigint").alias("link_key"), F.col(knowledge_date).alias("knowledge_date"), *attrs
    )
    return rows.join(keys, "link_key").select("entity_id", "knowledge_date", *attrs)


def typed_crosswalk(crosswalk: DataFrame) -> DataFrame:
    number = F.col("source_key").try_cast("bigint").alias("source_key")
    return crosswalk.select("entity_id", "source", number, "hash_key").distinct()


def distinct_entities(crosswalk: DataFrame, source: str | None = None) -> DataFrame:
    """Every entity, or the `(entity_id, source_key)` list of one source."""
    if source is None:
        return crosswalk.select("entity_id").distinct()
    number = F.col("source_key").try_cast("bigint").alias("source_key")
    return crosswalk.filter(F.col("source") == source).select("entity_id", number).distinct()


def link_coverage(linked: DataFrame) -> DataFrame:
    return linked.agg(
        F.count(F.when(F.col("entity_id").isNull(), 1)).alias("n_unlinked"), F.count(F.lit(1)).alias("n_rows")
    )


def multiplicity_histogram(crosswalk: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows per entity, then how many entities have that many."""
    return frequency(crosswalk.groupBy(key).agg(F.count(key).alias("id_count")), "id_count")


def join_fanout_histogram(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows per key of `left LEFT JOIN right`, then their frequency, without building the join.

    Both sides are counted per key first; the joined size of a key is the product of its counts.
    """
    n_left = left.groupBy(on).agg(F.count(on).alias("_left"))
    n_right = rows_per_key(right.filter(F.col(on).isNotNull()), on, "_right")
    joined = n_left.join(n_right, on, "left")
    size = (F.col("_left") * F.coalesce(F.col("_right"), F.lit(1))).alias("rows_per_key")
    return frequency(joined.select(size), "rows_per_key")


def facts_per_entity_histogram(facts: DataFrame, stays: DataFrame, on: str, entity: str) -> DataFrame:
    """Facts per person over `facts JOIN stays`, then their frequency; facts are counted per key first."""
    n_facts = rows_per_key(facts.filter(F.col(on).isNotNull()), on, "_facts")
    per_entity = (
        stays.select(on, entity)
        .join(n_facts, on)
        .groupBy(entity)
        .agg(F.sum(F.when(F.col(entity).isNotNull(), F.col("_facts")).otherwise(0)).alias("fact_count"))
    )
    return frequency(per_entity, "fact_count")


def linked_extract(
    df: DataFrame, crosswalk: DataFrame, source: str, key: str, columns: Sequence[str], kind: str = "number"
) -> DataFrame:
    """A source table beside its crosswalk slice: unlinked records and ids without records both show.

    Full-outer: `key` stays NULL on ids without records, and every entity sharing a key is listed.
    """
    slice_key = _link_key("hash_key" if kind == "hash" else "source_key", kind)
    ids = crosswalk.filter(F.col("source") == source).select(slice_key.alias("link_key"), "entity_id")
    rows = df.select(_link_key(key, kind).alias("link_key"), key, *[c for c in columns if c != key])
    return full_outer(rows, ids, "link_key").drop("link_key")


def fact_dimension_extract(
    facts: DataFrame, stays: DataFrame, on: str, fact_columns: Sequence[str], stay_columns: Sequence[str]
) -> DataFrame:
    """Fact rows with their stay (inner)."""
    return facts.select(on, *fact_columns).join(stays.select(on, *stay_columns), on)


def assessment_case_extract(
    assessments: DataFrame, cases: DataFrame, on: str, columns: Sequence[str], case_columns: Sequence[str]
) -> DataFrame:
    """Assessments beside cases, full-outer; `on` is the assessment's own key (NULL on bare cases)."""
    left = assessments.select(F.col(on).alias("link_key"), on, *columns)
    right = cases.select(F.col(on).alias("link_key"), *case_columns)
    return full_outer(left, right, "link_key").drop("link_key")
