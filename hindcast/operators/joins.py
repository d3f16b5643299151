"""Joins and running totals that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def full_outer(left: DataFrame, right: DataFrame, on: str, keys: DataFrame | None = None) -> DataFrame:
    """Full outer join on one shared column; the result keeps a single, merged key.

    Adaptive execution can split a crowded key of a left outer join but not of a full outer one, and NULL
    keys would all meet in one task. So: left outer join, plus the right rows whose key the left never has
    (its keys reduced map-side first). `keys` may give the left's keys from where they come from, so that the
    left is not computed twice.
    """
    keys = (left if keys is None else keys).select(on).filter(F.col(on).isNotNull()).distinct()
    matched = left.join(right.filter(F.col(on).isNotNull()), on, "left")
    alone = right.join(keys, on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def rows_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def frequency(df: DataFrame, count_col: str, out: str = "freq") -> DataFrame:
    """Frequency of frequencies: how many rows of `df` have each count."""
    return df.groupBy(count_col).agg(F.count(F.lit(1)).alias(out))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    values: Sequence[str],
    buckets: int = 1024,
    levels: int = 2,
) -> DataFrame:
    """Add `before_<v>` (sum over the rows ranked ahead) and `total_<v>` per group, exactly.

    `order` lists (column, descending) of numeric columns; together they are unique in a group. A plain window
    would sort a whole group in one task. Here a group is cut into ranges of the first column, and each range again
    into ranges of its own extent, so that values crowded beside an outlier still spread; a range that holds a
    single value of the first column is cut on the next one. More `levels` spread rows that share one value of a
    column with many close values. Ranges are totalled, the short lists of totals are accumulated level by level,
    and only the rows of one innermost range are sorted together. A row's range depends on values alone, so
    retries agree.
    """
    path, ranged = list(keys), df

    def sum_ahead(v: str) -> Column:
        ahead = Window.partitionBy(*path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(v).over(ahead), F.lit(0))

    def totals(level: int) -> DataFrame:
        """Sums per range, what is ahead of it, and the extents that the next level cuts."""
        aggs = [F.sum(v).alias(f"_sum_{v}") for v in values]
        if level:
            aggs += [F.max(f"_ahead_{v}").alias(f"_parent_{v}") for v in values]
        if level < levels:
            for i, (column, _) in enumerate(order):
                value = F.col(column).cast("double")
                finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
                aggs += [F.min(finite).alias(f"_low{i}"), F.max(finite).alias(f"_high{i}")]
                known = F.count(column)
                alone = F.min(column).eqNullSafe(F.max(column)) & ((known == 0) | (known == F.count(F.lit(1))))
                aggs.append(alone.alias(f"_fixed{i}"))
        found = ranged.groupBy(*path).agg(*aggs)
        if not level:
            return found.withColumns({f"_ahead_{v}": F.lit(0) for v in values}).withColumnsRenamed({f"_sum_{v}": f"total_{v}" for v in values})
        offsets = {f"_ahead_{v}": F.col(f"_parent_{v}") + sum_ahead(f"_sum_{v}") for v in values}
        return found.withColumns(offsets).drop(*[f"_sum_{v}" for v in values], *[f"_parent_{v}" for v in values])

    # Every branch over `df` uses its keys, order columns and values, so Spark computes their exchange once.
    for level in range(levels):
        ranged = ranged.drop(*[f"_ahead_{v}" for v in values]).join(totals(level), path)
        number = F.lit(0)
        for i, (column, descending) in reversed(list(enumerate(order))):
            place = _range_number(column, i, buckets)
            number = F.when(~F.col(f"_fixed{i}"), -place if descending else place).otherwise(number)
        ranged = ranged.withColumn(f"_range{level}", number)
        ranged = ranged.drop(*[f"{name}{i}" for i in range(len(order)) for name in ("_low", "_high", "_fixed")])
        path = [*path, f"_range{level}"]
    offsets = totals(levels)
    ranged = ranged.drop(*[f"_ahead_{v}" for v in values]).join(offsets, path)
    ahead = Window.partitionBy(*path).orderBy(*[_ordered(c, desc) for c, desc in order])
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select(
        *df.columns,
        *[f"total_{v}" for v in values],
        *[(F.col(f"_ahead_{v}") + F.coalesce(F.sum(v).over(ahead), F.lit(0))).alias(f"before_{v}") for v in values],
    )


def _range_number(column: str, i: int, buckets: int) -> Column:
    """Where `column` falls in its extent, the i-th; NULL, infinite and NaN values get ranges of their own."""
    value, low, width = F.col(column).cast("double"), F.col(f"_low{i}"), F.col(f"_high{i}") - F.col(f"_low{i}")
    place = F.when(width > 0, F.least(F.floor((value - low) / width * buckets), F.lit(buckets - 1))).otherwise(0)
    return (
        F.when(value.isNull(), -2)
        .when(F.isnan(value), buckets + 1)
        .when(value == float("inf"), buckets)
        .when(value == float("-inf"), -1)
        .otherwise(place)
        .cast("int")
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which NULL equals NULL; the columns of `on` are kept once."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    rule = reduce(Column.__and__, [left[c].eqNullSafe(other[f"_right_{c}"]) for c in on])
    return left.join(other, rule, how).drop(*[f"_right_{c}" for c in on])


def _ordered(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()
