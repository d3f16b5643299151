"""Precision and recall in the top k, exact under score ties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.joins import running_totals
from hindcast.presets import TOP_N, TOP_PERCENT

METRICS = ("precision@", "recall@")


@dataclass(frozen=True)
class Cuts:
    """Top-n and top-percent thresholds; parameters read '100_abs' and '5_pct'."""

    top_n: tuple[int, ...] = tuple(TOP_N)
    percents: tuple[int, ...] = tuple(TOP_PERCENT)

    def column(self) -> Column:
        """The cuts as one literal array; SQL text, since building hundreds of columns one by one is slow."""
        rows = [(f"{n}_abs", n, "null") for n in self.top_n] + [(f"{p}_pct", "null", p) for p in self.percents]
        cuts = [f"named_struct('parameter', '{name}', 'top', int({n}), 'pct', int({p}))" for name, n, p in rows]
        return F.expr(f"array({', '.join(cuts)})")


def _size(cut: Column, rows: Column) -> Column:
    """Rows the cut takes of a group of `rows`."""
    by_percent = F.floor(rows * cut["pct"] / F.lit(100))
    return F.when(cut["top"].isNotNull(), F.least(cut["top"].cast("bigint"), rows)).otherwise(by_percent)


def evaluate(
    predictions: DataFrame, keys: Sequence[str], cuts: Cuts = Cuts(), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """`(keys, metric, parameter, k, best_value, worst_value, stochastic_value, standard_deviation)`.

    Rows without label are left out. Predictions are reduced to distinct scores; each cut is then settled on
    the one score it falls on. Where it divides a tie, best and worst take the tie in the most and least
    favourable order, the stochastic value is the mean over all orders and the deviation is theirs.
    """
    keys = list(keys)
    per_score = (
        predictions.filter(F.col("label").isNotNull() & F.col("score").isNotNull())
        .groupBy(*keys, "score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    )
    ranked = running_totals(per_score, keys, [("score", True)], ["n", "p"])
    before, after, rows = F.col("before_n"), F.col("before_n") + F.col("n"), F.col("total_n")
    # A percent p cuts here when before < floor(rows * p / 100) <= after; solved for p once per score.
    ranked = ranked.select(
        "*",
        after.alias("after_n"),
        F.ceil((before + 1) * 100 / rows).alias("first_pct"),
        F.ceil((after + 1) * 100 / rows).alias("next_pct"),
    )
    straddling = F.filter(
        cuts.column(),
        lambda c: ((c["top"] > before) & ((c["top"] <= F.col("after_n")) | (F.col("after_n") == rows)))
        | ((c["pct"] >= F.col("first_pct")) & (c["pct"] < F.col("next_pct"))),
    )
    hits = ranked.withColumn("cut", F.explode(straddling)).select(
        *keys, "n", "p", "before_n", "before_p", "cut.parameter"
    )
    groups = per_score.groupBy(*keys).agg(F.sum("n").alias("total_n"), F.sum("p").alias("total_p"))
    listed = groups.withColumn("cut", F.explode(cuts.column())).select(
        *keys, "cut.parameter", _size(F.col("cut"), F.col("total_n")).alias("k"), "total_p"
    )
    taken = F.col("k") - F.col("before_n")
    share = F.col("p") / F.col("n")
    spread = taken * share * (1 - share) * (F.col("n") - taken) / F.greatest(F.col("n") - 1, F.lit(1))
    counted = listed.join(hits, [*keys, "parameter"], "left").select(
        *keys,
        "parameter",
        "k",
        "total_p",
        (F.col("before_p") + F.least(F.col("p"), taken)).alias("best"),
        (F.col("before_p") + F.greatest(F.lit(0), taken - (F.col("n") - F.col("p")))).alias("worst"),
        (F.col("before_p") + taken * share).alias("stochastic"),
        F.sqrt(spread).alias("deviation"),
    )
    forms = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), (F.col("k") if m == "precision@" else F.col("total_p")).alias("base")
            )
            for m in metrics
        ]
    )
    rows = counted.withColumn("form", F.explode(forms))
    base = F.nullif(F.col("form.base"), F.lit(0))
    return rows.select(
        *keys,
        "form.metric",
        "parameter",
        "k",
        (F.col("best") / base).alias("best_value"),
        (F.col("worst") / base).alias("worst_value"),
        (F.col("stochastic") / base).alias("stochastic_value"),
        (F.col("deviation") / base).alias("standard_deviation"),
    )


def top_k_equity(predictions: DataFrame, groups: DataFrame, group: str, keys: Sequence[str], k: int = 100) -> DataFrame:
    """Make-up of the top k beside that of the whole cohort."""
    keys = list(keys)
    per_score = (
        predictions.join(groups, "entity_id", "left")
        .groupBy(*keys, group, "score")
        .agg(F.count(F.lit(1)).alias("n_group"))
    )
    shares = in_top_scores(predictions, keys, k)
    per_group = (
        per_score.join(shares, [*keys, "score"])
        .groupBy(*keys, group)
        .agg(F.sum("n_group").alias("n_cohort"), F.sum(F.col("n_group") * F.col("share_in_top")).alias("n_top"))
    )
    totals = per_group.groupBy(*keys).agg(F.sum("n_cohort").alias("_cohort"), F.sum("n_top").alias("_top"))
    return per_group.join(totals, keys).select(
        *keys,
        group,
        "n_cohort",
        "n_top",
        (F.col("n_cohort") / F.col("_cohort")).alias("share_of_cohort"),
        (F.col("n_top") / F.col("_top")).alias("share_of_top"),
    )


def in_top_scores(predictions: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Distinct scores with the share of their rows inside the top k."""
    per_score = predictions.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(per_score, keys, [("score", True)], ["n"])
    left = F.least(F.lit(k), F.col("total_n")) - F.col("before_n")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("n")))
    return ranked.select(*keys, "score", share.alias("share_in_top"))


def top_k_vs_random(predictions: DataFrame, keys: Sequence[str], k: int = 100) -> DataFrame:
    """Precision in the top k beside that of a random pick, the base rate."""
    keys = list(keys)
    top = evaluate(predictions, keys, Cuts((k,), ()), ["precision@"])
    base = predictions.groupBy(*keys).agg(F.avg("label").alias("base_rate"))
    return top.join(base, keys).select(
        *keys,
        F.col("stochastic_value").alias("top_k"),
        "base_rate",
        (F.col("stochastic_value") - F.col("base_rate")).alias("gain"),
    )
