"""Forests grown from counts of binned rows: the trees of Spark ML's forest without a pass over the rows per level.

A tree compares a feature with at most `MOST_BINS - 1` thresholds, so rows that lie in the same bins take the same way
through every tree. All training rows are read twice: for the thresholds, and to count the labels of each combination of
bins. A tree is then grown from these groups by one task. The bootstrap draws each of a group's `n` rows by Poisson(1),
which sums to Poisson(n); thresholds, gains, stops and the merging of equal leaves are Spark ML's, except that thresholds
are laid by all rows and not by a sample of them. The number of groups is bounded by the bins, not by the rows; fits with
more than `MOST_GROUPS` are left to Spark ML.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.sources.sinks import shared_folder

MOST_BINS = 32  # Spark ML's default
MOST_GROUPS = 1 << 18  # some 10 MB for a task of Python
DIGEST = 4096  # values of a feature that a task tells the driver
TASKS = 32  # tasks that grow the trees of a forest

# Executors get the functions of this module with the task and need not have this package.
register_pickle_by_value(sys.modules[__name__])

Groups = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def digest(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; beyond `most`, the greatest value of each of `most` equal shares."""
    found, at = np.unique(values, return_inverse=True)
    total = np.bincount(at, counts, len(found)).astype(np.int64)
    if len(found) <= most:
        return found, total
    ends = np.cumsum(total)
    share = (ends - 1) * most // ends[-1]
    last = np.append(share[1:] != share[:-1], True)
    return found[last], np.diff(ends[last], prepend=0)


def alike(bins: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first of the rows that have equal bins, and for each row which of these firsts it equals."""
    if np.prod([float(size) for size in sizes]) < 1 << 62:  # one number for all bins of a row
        bins = np.ravel_multi_index(tuple(bins.T), sizes) if bins.shape[1] else np.zeros(len(bins), int)
    _, first, at = np.unique(bins, axis=0, return_index=True, return_inverse=True)
    return first, at.ravel()


def thresholds_of(values: np.ndarray, counts: np.ndarray, most: int = MOST_BINS - 1) -> np.ndarray:
    """Spark ML's rule: between all neighbouring values, or where the rows are cut into `most` + 1 nearly equal parts."""
    if len(values) <= most + 1:
        return (values[1:] + values[:-1]) / 2
    stride = counts.sum() / (most + 1)
    found, target, ends = [], stride, np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            found.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.unique(found)


def thresholds(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The thresholds of each feature of `rows` with `x`, laid by all rows."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [(np.empty(0), np.empty(0, np.int64))] * width
        held: list[list[np.ndarray]] = [[] for _ in range(width)]

        def folded(j: int, most: int) -> None:
            values = np.concatenate([kept[j][0], *held[j]])
            counts = np.append(kept[j][1], np.ones(len(values) - len(kept[j][0]), np.int64))
            kept[j], held[j] = digest(values, counts, most), []

        rows_held = 0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            rows_held += len(x)
            for j in range(width):
                held[j].append(x[:, j])
                if rows_held > 1 << 18:
                    folded(j, 4 * DIGEST)
            rows_held = 0 if rows_held > 1 << 18 else rows_held
        for j in range(width):
            folded(j, DIGEST)
        part = [TaskContext.get().partitionId()] * width
        lists = [pa.array([k[i] for k in kept], pa.list_(kind)) for i, kind in enumerate((pa.float64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(range(width), pa.int32()), *lists], ["part", "feature", "v", "n"])

    schema = "part int, feature int, v array<double>, n array<bigint>"
    parts = rows.select("x").mapInArrow(told, schema).toArrow().sort_by([("feature", "ascending"), ("part", "ascending")])
    found = []
    for j in range(width):
        own = parts.filter(pc.equal(parts["feature"], j))
        whole = [np.concatenate([np.empty(0), *(np.asarray(v.values) for v in own[c])]) for c in ("v", "n")]
        found.append(thresholds_of(*digest(whole[0], whole[1].astype(np.int64), len(whole[0]) + 1)))
    return found


def groups_of(rows: DataFrame, width: int, most: int = MOST_GROUPS) -> Groups | None:
    """`(bins, counts, thresholds)`: the bins of every group of `rows` with the vector `assembled`, and its rows by label.

    None if there are more than `most` groups, no rows, or labels besides 0 and 1.
    """
    rows = rows.select(F.col("label").cast("double").alias("label"), vector_to_array("assembled").alias("x"))
    cuts = thresholds(rows, width)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            label = np.asarray(batch.column(0))
            bins = np.column_stack([np.searchsorted(cuts[j], x[:, j]) for j in range(width)]).astype(np.uint8)
            first, at = alike(bins, [len(cut) + 1 for cut in cuts])
            found = bins[first]
            tallies = [np.bincount(at, weights, len(found)).astype(np.int64) for weights in (label == 0, label == 1, (label != 0) & (label != 1))]
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(found), [None, pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), *map(pa.array, tallies)], ["bins", "n0", "n1", "other"])

    tallied = rows.mapInArrow(counted, "bins binary, n0 bigint, n1 bigint, other bigint")
    found = tallied.groupBy("bins").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "other")]).limit(most + 1).toArrow()
    if not 0 < len(found) <= most or np.asarray(found["other"]).any():
        return None
    found = found.sort_by("bins")
    bins = np.frombuffer(b"".join(found["bins"].to_pylist()), np.uint8).reshape(-1, width)
    return bins, np.column_stack([np.asarray(found["n0"]), np.asarray(found["n1"])]), cuts


def grown(groups: Groups, depth: int, least: int, tried: int, bootstrap: bool, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays by node, children behind their parents; `rng` draws the rows, and the `tried` features of a node."""
    bins, counts, cuts = groups
    draws = rng.poisson(counts) if bootstrap else counts
    weight, bins = draws[draws.sum(1) > 0].astype(float), bins[draws.sum(1) > 0]
    levels, first, at = [], 0, np.zeros(len(weight), np.int64)
    stats = weight.sum(0, keepdims=True)
    for level in range(depth + 1):
        m, n = len(stats), stats.sum(1)
        gain, feature, cut = np.zeros(m), np.full(m, -1), np.zeros(m, np.int64)
        chosen = rng.random((m, len(cuts))).argsort(1).argsort(1) < tried
        for j in range(len(cuts)) if level < depth else ():
            size = len(cuts[j]) + 1
            if size == 1:
                continue
            a, b = (np.bincount(at * size + bins[:, j], weight[:, c], m * size).reshape(m, size).cumsum(1)[:, :-1] for c in (0, 1))
            c, d = stats[:, :1] - a, stats[:, 1:] - b
            with np.errstate(all="ignore"):
                own = (2 * stats[:, 0] * stats[:, 1] / n)[:, None]
                gains = (own - 2 * a * b / (a + b) - 2 * c * d / (c + d)) / n[:, None]
            gains[~((a + b >= least) & (c + d >= least) & chosen[:, j, None])] = 0
            k = gains.argmax(1)
            best = gains[np.arange(m), k]
            better = best > gain
            gain[better], feature[better], cut[better] = best[better], j, k[better]
        splits = feature >= 0
        place = np.cumsum(splits) - 1
        left = np.where(splits, first + m + 2 * place, -1)
        levels.append((left, feature, cut, gain, stats))
        if not splits.any():
            break
        inside = splits[at]
        at, bins, weight = at[inside], bins[inside], weight[inside]
        right = bins[np.arange(len(at)), feature[at]] > cut[at]
        at = 2 * place[at] + right
        first += m
        stats = np.column_stack([np.bincount(at, weight[:, c], 2 * int(splits.sum())) for c in (0, 1)])
    left, feature, cut, gain, stats = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    return merged(left, feature, cut, gain, stats, cuts)


def merged(left, feature, cut, gain, stats, cuts) -> dict[str, np.ndarray]:
    """The tree without splits whose two leaves predict the same label, as Spark ML leaves them out."""
    says = stats[:, 1] > stats[:, 0]
    for i in range(len(left) - 1, -1, -1):
        at = left[i]
        if at >= 0 and left[at] < 0 and left[at + 1] < 0 and says[at] == says[at + 1]:
            left[i] = -1
    reached = np.zeros(len(left), bool)
    reached[0] = True
    for i in range(len(left)):
        if reached[i] and left[i] >= 0:
            reached[left[i]] = reached[left[i] + 1] = True
    number = np.cumsum(reached) - 1
    inner = left[reached] >= 0
    below = np.where(inner, number[left[reached]], -1)
    values = [float(cuts[j][k]) if own else np.nan for j, k, own in zip(feature[reached], cut[reached], inner, strict=True)]
    return {
        "left": below, "right": np.where(inner, below + 1, -1), "feature": np.where(inner, feature[reached], -1),
        "threshold": np.array(values), "gain": np.where(inner, gain[reached], -1.0), "stats": stats[reached], "says": says[reached],
    }


NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,
gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def as_saved(number: int, tree: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A tree in the columns of `NODES`, in which Spark ML saves and loads it."""
    stats, size = tree["stats"], len(tree["left"])
    whole = stats.sum(1)
    impurity = np.where(whole > 0, 1 - (stats**2).sum(1) / np.maximum(whole, 1) ** 2, 0.0)
    inner, none = tree["left"] >= 0, np.full(size, -1, np.int32)
    lists = [[t] if own else [] for t, own in zip(tree["threshold"], inner, strict=True)]
    split = {
        "featureIndex": pa.array(tree["feature"], pa.int32()),
        "leftCategoriesOrThreshold": pa.array(lists, pa.list_(pa.float64())),
        "numCategories": pa.array(none),
    }
    node = {
        "id": pa.array(np.arange(size), pa.int32()),
        "prediction": pa.array(tree["says"].astype(float)),
        "impurity": pa.array(impurity),
        "impurityStats": pa.array(stats.tolist(), pa.list_(pa.float64())),
        "rawCount": pa.array(whole.astype(np.int64)),
        "gain": pa.array(tree["gain"]),
        "leftChild": pa.array(tree["left"], pa.int32()),
        "rightChild": pa.array(tree["right"], pa.int32()),
        "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    data = pa.StructArray.from_arrays(list(node.values()), list(node))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number), pa.int32()), data], ["treeID", "nodeData"])


def _described(kind: str, forest: RandomForestClassifier, left_out: Sequence[str] = (), **more: Any) -> str:
    own, default = (
        {p.name: v for p, v in params.items() if p.name not in left_out} for params in (forest._paramMap, forest._defaultParamMap)
    )
    told = {
        "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__,
        "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": own, "defaultParamMap": default,
    }
    return json.dumps(told | more)


def fit_forest(spark: SparkSession, groups: Groups, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """What `forest` fits to the rows of `groups`: its trees are grown side by side, saved as Spark ML saves them, and loaded."""
    width, trees = groups[0].shape[1], forest.getNumTrees()
    subset = forest.getFeatureSubsetStrategy()
    tried = int(np.ceil(np.sqrt(width))) if subset == "sqrt" else int(subset)
    depth, least, seed = forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getSeed()
    bootstrap = forest.getBootstrap() and trees > 1

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield as_saved(number, grown(groups, depth, least, tried, bootstrap, np.random.default_rng([seed, number])))

    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    numbers = spark.range(0, trees, 1, min(trees, TASKS))
    numbers.mapInArrow(grow, NODES).write.parquet(f"{path}/data")
    told = _described("RandomForestClassificationModel", forest, numFeatures=width, numClasses=2, numTrees=trees)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = _described("DecisionTreeClassificationModel", forest, ("numTrees", "featureSubsetStrategy", "bootstrap", "subsamplingRate"))
    spark.range(0, trees, 1, 1).select(F.col("id").cast("int").alias("_1"), F.lit(each).alias("_2"), F.lit(1.0).alias("_3")).write.parquet(f"{path}/treesMetadata")
    return RandomForestClassificationModel.load(path)
