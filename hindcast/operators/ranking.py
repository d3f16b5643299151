"""Rule baseline: rank entities by features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.joins import null_safe_join, running_totals


@dataclass(frozen=True)
class RankRule:
    feature: str
    low_value_high_score: bool = False


def rank_multi_feature(rows: DataFrame, rules: Sequence[RankRule], group: str = "as_of_date") -> DataFrame:
    """Add `rank` (dense, 1 = highest score) and `score = 1 - (rank - 1) / max rank` per group.

    Rows are reduced to distinct feature tuples before anything is ordered. A NULL feature is the lowest value.
    """
    names = [r.feature for r in rules]
    tuples = rows.select(group, *names).distinct().withColumn("one", F.lit(1))
    order = [(r.feature, not r.low_value_high_score) for r in rules]
    ranked = running_totals(tuples, [group], order, ["one"]).select(
        group, *names, (F.col("before_one") + 1).alias("rank"), "total_one"
    )
    score = (F.lit(1.0) - (F.col("rank") - 1) / F.col("total_one")).alias("score")
    return null_safe_join(rows, ranked, [group, *names]).select(*rows.columns, "rank", score)


def rank_rule_sets(
    rows: DataFrame, rule_sets: Mapping[int, Sequence[RankRule]], groups: Sequence[str], name: str = "rule_set"
) -> DataFrame:
    """`rank_multi_feature` by every rule set in one pass: each row once per set, with its key in the column `name`.

    Groups are those columns together. All sets share one layout of ranges: a rule becomes a column in which the higher
    value ranks first, with a second one for what a turned value cannot tell (NULL is lowest, NaN highest). Features are
    compared as doubles.
    """
    most = max(map(len, rule_sets.values()))
    turned = [any(len(rules) > k and rules[k].low_value_high_score for rules in rule_sets.values()) for k in range(most)]

    def places(rules: Sequence[RankRule]) -> list[Column]:
        found = []
        for k in range(most):
            rule = rules[k] if k < len(rules) else None
            value = F.col(rule.feature).cast("double") if rule else F.lit(None).cast("double")
            low = rule is not None and rule.low_value_high_score
            if turned[k]:
                odd = F.when(value.isNull(), 1).when(F.isnan(value), -1).otherwise(0) if low else F.lit(0)
                found.append(odd.alias(f"_odd{k}"))
            if low:
                value = F.when(value.isNull() | F.isnan(value), 0.0).otherwise(-value)
            found.append(value.alias(f"_place{k}"))
        return found

    sets = [F.struct(F.lit(key).alias(name), *places(rules)) for key, rules in rule_sets.items()]
    placed = rows.withColumn("_set", F.explode(F.array(*sets))).select(*rows.columns, "_set.*")
    names = [n for k in range(most) for n in ([f"_odd{k}"] if turned[k] else []) + [f"_place{k}"]]
    keys = [name, *groups]
    tuples = placed.select(*keys, *names).distinct().withColumn("one", F.lit(1))
    ranked = running_totals(tuples, keys, [(n, True) for n in names], ["one"])
    ranked = ranked.select(*keys, *names, (F.col("before_one") + 1).alias("rank"), "total_one")
    score = (F.lit(1.0) - (F.col("rank") - 1) / F.col("total_one")).alias("score")
    return null_safe_join(placed, ranked, [*keys, *names]).select(name, *rows.columns, "rank", score)
