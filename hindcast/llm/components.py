"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import through_storage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node it is linked to, for every node of `edges` (u, v); a root has a row too.

    Alternates large-star and small-star steps: every node hands its larger (then its smaller) neighbours to the
    smallest node it knows. Only minima per node are gathered, so a node with very many neighbours is no large group.
    Each round is written to shared storage; a lost executor repeats no earlier round.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = through_storage(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = through_storage(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = through_storage(large, "large-star")
        least = through_storage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
        edges = through_storage(small.distinct(), "small-star")
        after = _state(edges)
        if after == state:
            break
        state = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
