"""Model grid over Spark ML and the rule baseline."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from threading import Lock
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.asof import KEYS
from hindcast.operators.forests import NODES, Groups, alike, fit_forest, groups_of
from hindcast.operators.matrix import training_rows
from hindcast.operators.ranking import RankRule, rank_rule_sets
from hindcast.presets import RANDOM_SEED
from hindcast.sources.sinks import shared_folder, through_storage

MAX_DEPTH = 30  # the deepest tree Spark ML grows


@dataclass(frozen=True)
class ModelSpec:
    """`kind`: random_forest, decision_tree, scaled_logistic or rank_multi_feature."""

    model_id: int
    kind: str
    params: Mapping[str, Any] = field(default_factory=dict)

    def effective(self) -> dict[str, Any]:
        """The parameters the fit really uses: Spark ML grows no tree deeper than MAX_DEPTH."""
        params = dict(self.params)
        if "max_depth" in params:
            params["max_depth"] = min(params["max_depth"], MAX_DEPTH)
        return params


# The study's grid.
GRID = {
    "random_forest": {"n_estimators": [150], "max_depth": [50], "min_samples_split": [25]},
    "decision_tree": {"max_depth": [3], "max_features": [1, 2, 3, 4, 5], "min_samples_split": [25]},
    "scaled_logistic": {"C": [0.1], "penalty": ["l1"]},
}


def expand_grid(grid: Mapping[str, Mapping[str, Sequence[Any]]]) -> list[ModelSpec]:
    """One spec per parameter combination, numbered from 1."""
    found = [
        (kind, dict(zip(options, values))) for kind, options in grid.items() for values in product(*options.values())
    ]
    return [ModelSpec(i, kind, params) for i, (kind, params) in enumerate(found, 1)]


def _forest(params: Mapping[str, Any], trees: int, subset: str, bootstrap: bool, seed: int) -> RandomForestClassifier:
    """A node is split from `min_samples_split` rows on; the nearest Spark rule is half of that per child.

    Tasks keep the node each row has reached; otherwise every task of every level would be sent the trees grown so far.
    """
    return RandomForestClassifier(
        featuresCol="assembled",
        labelCol="label",
        numTrees=trees,
        maxDepth=params["max_depth"],
        minInstancesPerNode=max(1, params["min_samples_split"] // 2),
        featureSubsetStrategy=subset,
        bootstrap=bootstrap,
        maxMemoryInMB=512,
        cacheNodeIds=True,
        seed=seed,
    )


def with_vector(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """`rows` with the features as one vector, `assembled`, unless they have it."""
    return rows if "assembled" in rows.columns else VectorAssembler(inputCols=list(features), outputCol="assembled").transform(rows)


class Training:
    """Training rows with their vector; the groups that trees are grown from are counted once, when first asked for."""

    def __init__(self, rows: DataFrame, features: Sequence[str]):
        self.rows, self._width, self._lock, self._found = rows, len(features), Lock(), None

    def groups(self) -> Groups | None:
        with self._lock:
            self._found = self._found or (groups_of(self.rows, self._width),)
        return self._found[0]

    def fit_forest(self, forest: RandomForestClassifier) -> RandomForestClassificationModel:
        groups = self.groups()
        return forest.fit(self.rows) if groups is None else fit_forest(self.rows.sparkSession, groups, forest)


def _penalty(spec: ModelSpec, n_rows: int) -> float:
    return 1.0 / (spec.params["C"] * max(n_rows, 1))


def fit(train: DataFrame | Training, features: Sequence[str], spec: ModelSpec, seed: int = RANDOM_SEED) -> PipelineModel:
    """The model of `spec`. Several specs share the vectors and the groups of one `Training`."""
    training = train if isinstance(train, Training) else Training(with_vector(train, features), features)
    train, params = training.rows, spec.effective()
    if spec.kind == "random_forest":
        return PipelineModel([training.fit_forest(_forest(params, params["n_estimators"], "sqrt", True, seed))])
    elif spec.kind == "decision_tree":
        return PipelineModel([training.fit_forest(_forest(params, 1, str(params["max_features"]), False, seed))])
    elif spec.kind == "scaled_logistic":
        stages = [
            MinMaxScaler(inputCol="assembled", outputCol="features"),
            LogisticRegression(
                featuresCol="features",
                labelCol="label",
                regParam=_penalty(spec, train.count()),
                elasticNetParam=1.0 if params["penalty"] == "l1" else 0.0,
                standardization=False,
                maxIter=500,
                tol=1e-10,
            ),
        ]
    else:
        raise ValueError(f"unknown model kind {spec.kind!r}")
    return Pipeline(stages=stages).fit(train)


def _bin(name: str, cuts: Sequence[float], first: int = 0) -> str:
    """SQL of the number of the bin that the sorted `cuts` put a feature in."""
    if not cuts:
        return str(first)
    mid = len(cuts) // 2
    return f"IF(`{name}` <= {cuts[mid]!r}D, {_bin(name, cuts[:mid], first)}, {_bin(name, cuts[mid + 1 :], first + mid + 1)})"


def _scored_by_bins(model: PipelineModel, rows: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """`rows` with the forest's `score`, which is asked once for all rows that no threshold of its trees tells apart.

    Features without a value have a bin of their own, so that the vector of their rows is refused as without bins.
    """
    cuts: dict[str, list[float]] = {}
    for row in tree_nodes(model).where("left >= 0").select("feature", "threshold").distinct().collect():
        cuts.setdefault(features[row["feature"]], []).append(row["threshold"])
    bins = {f"_bin{j}": f"IF(`{f}` IS NULL OR isnan(`{f}`), -1, {_bin(f, sorted(cuts.get(f, [])))})" for j, f in enumerate(features)}
    binned = rows.withColumns({b: F.expr(text) for b, text in bins.items()})
    unlike = with_vector(binned.groupBy(*bins).agg(*[F.min(f).alias(f) for f in features]), features)
    # Stored, its size is known before the rows are dealt out to meet it.
    scores = through_storage(model.transform(unlike).select(*bins, positive), "scores")
    return binned.join(scores, list(bins)).drop(*bins)


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Rows with `score`, the probability of label 1, and the columns `kept`."""
    positive = vector_to_array(F.col("probability"))[1].alias("score")
    names = ["split_id", "role", *KEYS, "label", *kept]
    if hasattr(model.stages[-1], "trees") and set(features) <= set(rows.columns):
        return _scored_by_bins(model, rows.select(*dict.fromkeys([*names, *features])), features, positive).select(*names, "score")
    return model.transform(with_vector(rows, features)).select(*names, positive)


Fitted = dict[tuple[int, int], PipelineModel]


def fit_grid(
    matrix: DataFrame, features: Sequence[str], specs: Sequence[ModelSpec], splits: Sequence[int], seed: int = RANDOM_SEED,
    at_once: int = 4,
) -> Fitted:
    """Fitted models by (model_id, split_id); rankers need no fit.

    Each split's training rows are assembled once and kept while the specs are fitted, `at_once` fits side by side over
    all splits: a fit is a row of small jobs that leave most of a cluster idle. Forests take longest and begin first.
    A fit depends on its rows and its seed alone.
    """
    fitted = sorted((s for s in specs if s.kind != "rank_multi_feature"), key=lambda s: s.kind != "random_forest")
    if not fitted:
        return {}
    rows = {}
    for split in splits:
        train = training_rows(matrix.filter(F.col("split_id") == split))
        rows[split] = Training(with_vector(train, features).select("label", "assembled").persist(), features)
    try:
        with ThreadPoolExecutor(at_once) as pool:
            jobs = {(spec.model_id, split): pool.submit(fit, rows[split], features, spec, seed) for spec in fitted for split in splits}
            done = {key: job.result() for key, job in jobs.items()}
    finally:
        for training in rows.values():
            training.rows.unpersist()
    order = [s.model_id for s in specs]
    found = {key: done[key] for key in sorted(done, key=lambda key: (splits.index(key[1]), order.index(key[0])))}
    return found


def model_grid(
    matrix: DataFrame, features: Sequence[str], specs: Sequence[ModelSpec], splits: Sequence[int], seed: int = RANDOM_SEED,
    fitted: Fitted | None = None, told: Mapping[tuple[int, int], DataFrame] | None = None, at_once: int = 4,
) -> DataFrame:
    """Predictions `(model_id, split_id, role, entity_id, as_of_date, label, score)` of every spec and split.

    Pass a stored matrix, since every split reads it again. All rankers score all splits in one pass. With `told`, the
    nodes of `nodes_of`, the predictions also have `told`, the score by `told_score` (NULL for models without trees).
    """
    fitted = fit_grid(matrix, features, specs, splits, seed) if fitted is None else fitted
    nodes_of(fitted, at_once)

    def scored(key: tuple[int, int]) -> DataFrame:
        (model_id, split), model = key, fitted[key]
        rows = matrix.filter(F.col("split_id") == split)
        names = [F.lit(model_id).alias("model_id"), "split_id", "role", *KEYS, "label", "score"]
        if told is None:
            return score(model, rows, features).select(*names)
        if key not in told:
            return score(model, rows, features).select(*names, F.lit(None).cast("double").alias("told"))
        return told_score(score(model, rows, features, features), told[key], features, MAX_DEPTH).select(*names, "told")

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(scored, fitted))
    rules = {s.model_id: [RankRule(**r) for r in s.params["rules"]] for s in specs if s.kind == "rank_multi_feature"}
    if rules:
        rows = matrix.filter(F.col("split_id").isin(list(splits)))
        ranked = rank_rule_sets(rows, rules, ["split_id", "as_of_date"], "model_id")
        ranked = ranked.select("model_id", "split_id", "role", *KEYS, "label", "score")
        parts.append(ranked if told is None else ranked.withColumn("told", F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, parts)


def tree_nodes(model: PipelineModel, spark: SparkSession | None = None) -> DataFrame:
    """The nodes of a fitted forest, as it is saved: children and condition, gain, weight `n`, share of label 1.

    Leaves have no children (-1). A row goes left if its feature is at most the threshold.
    """
    if hasattr(model, "_saved_nodes"):
        return model._saved_nodes
    spark = spark or SparkSession.active()
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    stats = F.col("nodeData.impurityStats")
    # Saved once, however often the nodes are asked for.
    model._saved_nodes = spark.read.schema(NODES).parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("nodeData.gain").alias("gain"),
        (stats[0] + stats[1]).alias("n"), (stats[1] / (stats[0] + stats[1])).alias("share"),
    )
    return model._saved_nodes


def nodes_of(fitted: Fitted, at_once: int = 4) -> dict[tuple[int, int], DataFrame]:
    """`tree_nodes` of every fitted forest and tree; `at_once` models are saved side by side."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(at_once) as pool:
        forests = {key: model for key, model in fitted.items() if hasattr(model.stages[-1], "trees")}
        return dict(zip(forests, pool.map(lambda model: tree_nodes(model, spark), forests.values()), strict=True))


def told_trees(nodes: DataFrame, features: Sequence[str]) -> list[str]:
    """Every tree as a nested SQL condition over the features that ends in the leaf's share of label 1.

    The nodes of a model come to the driver, as the model itself is there; their number is bounded by depth and trees.
    """
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row

    def told(tree: dict[int, Row], node: int) -> str:
        row = tree[node]
        if row["left"] < 0:
            return f"{row['share']!r}D"
        name = f"`{features[row['feature']]}`"
        return f"IF({name} <= {row['threshold']!r}D, {told(tree, row['left'])}, {told(tree, row['right'])})"

    return [told(trees[t], 0) for t in sorted(trees)]


def told_score(rows: DataFrame, nodes: DataFrame, features: Sequence[str], depth: int) -> DataFrame:
    """`rows` with `told`: every told tree is walked down from its root, and the shares of the leaves are averaged.

    The rows of a batch take each step of a tree together, so no row meets a tree by a join, and rows that no threshold
    tells apart take it once; like the model itself the trees come to the driver, bounded by depth and trees.
    """
    kinds = {"left": "i8", "right": "i8", "feature": "i8", "threshold": "f8", "share": "f8"}
    found = nodes.select("tree", "node", *kinds).fillna(-1.0, ["threshold"]).toArrow()  # a leaf has no threshold
    found = found.sort_by([("tree", "ascending"), ("node", "ascending")])
    columns = {c: np.asarray(found[c]).astype(kind) for c, kind in kinds.items()}
    starts = np.flatnonzero(np.diff(np.asarray(found["tree"]), prepend=-1))
    trees = [dict(zip(kinds, parts, strict=True)) for parts in zip(*(np.split(c, starts[1:]) for c in columns.values()), strict=True)]
    inner = [(tree["feature"][tree["left"] >= 0], tree["threshold"][tree["left"] >= 0]) for tree in trees]
    cuts = [np.unique(np.concatenate([np.empty(0), *(t[f == j] for f, t in inner)])) for j in range(len(features))]

    # Defined here, so that executors get it with the task and need not have this package.
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1)
            bins = np.column_stack([np.searchsorted(cut, x[:, j]) for j, cut in enumerate(cuts)])
            first, at_first = alike(bins, [len(cut) + 1 for cut in cuts])
            x, total = x[first], np.zeros(len(first))
            for tree in trees:
                node, inside = np.zeros(len(x), np.int64), np.arange(len(x))
                for _ in range(depth + 1):
                    inside = inside[tree["left"][node[inside]] >= 0]
                    if not len(inside):
                        break
                    at = node[inside]
                    goes_left = x[inside, tree["feature"][at]] <= tree["threshold"][at]
                    node[inside] = np.where(goes_left, tree["left"][at], tree["right"][at])
                total += tree["share"][node]
            told = pa.array((total / len(trees))[at_first])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], told], [*batch.schema.names[:-1], "told"])

    vector = vector_to_array("assembled").alias("_x")
    schema = T.StructType([*rows.schema.fields, T.StructField("told", T.DoubleType())])
    return with_vector(rows, features).select(*rows.columns, vector).mapInArrow(walk, schema)


def gain_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(feature, importance)` from the gains of the told trees: weighted by rows, shares per tree, then overall."""
    gains = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    named = SparkSession.active().createDataFrame(list(enumerate(features)), "number int, feature string")
    found = shares.select(F.col("feature").alias("number"), (F.col("share") / total).alias("importance"))
    return named.join(found, "number", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def optimality(model: PipelineModel, train: DataFrame, features: Sequence[str], spec: ModelSpec, slack: float = 0.02) -> DataFrame:
    """`(feature, coefficient, gradient, bound, holds)` of a penalised logistic fit, and a row for the intercept.

    At the optimum of mean log loss plus bound * sum |coefficient| the loss has gradient -bound * sign where a coefficient
    is not zero, within the bound where it is, and none along the intercept. One aggregation over the training rows;
    `slack` is the part of the bound by which a numeric fit may miss it.
    """
    train = with_vector(train, features)
    scaled = vector_to_array(F.col("features"))
    fitted = model.stages[-1]
    weights = [float(w) for w in fitted.coefficients]
    line = reduce(Column.__add__, [F.lit(w) * scaled[j] for j, w in enumerate(weights)], F.lit(float(fitted.intercept)))
    miss = F.lit(1.0) / (1 + F.exp(-line)) - F.col("label")
    rows = model.stages[0].transform(train)
    sums = rows.agg(F.avg(miss).alias("intercept"), *[F.avg(miss * scaled[j]).alias(f"g{j}") for j in range(len(weights))])
    bound = _penalty(spec, train.count())
    terms = [("(intercept)", float(fitted.intercept), "intercept", 0.0)]
    terms += [(name, weights[j], f"g{j}", bound) for j, name in enumerate(features)]
    listed = [
        F.struct(F.lit(name).alias("feature"), F.lit(w).alias("coefficient"), F.col(g).alias("gradient"), F.lit(b).alias("bound"))
        for name, w, g, b in terms
    ]
    told = sums.select(F.explode(F.array(*listed)).alias("term")).select("term.*")
    target = F.when(F.col("coefficient") != 0, F.col("bound") * F.signum("coefficient")).otherwise(0.0)
    reach = F.when(F.col("coefficient") != 0, 0.0).otherwise(F.col("bound")) + slack * bound
    reach = F.when(F.col("feature") == "(intercept)", F.lit(slack * bound)).otherwise(reach)
    target = F.when(F.col("feature") == "(intercept)", 0.0).otherwise(target)
    return told.withColumn("holds", F.abs(F.col("gradient") + target) <= reach)


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """`(feature, importance)`: tree importances, or coefficients of a linear model."""
    last = model.stages[-1]
    weights = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(name, float(weights[i])) for i, name in enumerate(features)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def split_ids(spine: DataFrame) -> list[int]:
    """The splits of a spine, newest first: one short row each."""
    return [r["split_id"] for r in spine.select("split_id").distinct().orderBy("split_id").collect()]


def model_table(specs: Sequence[ModelSpec], splits: Sequence[int], run_hash: str) -> DataFrame:
    """`(experiment_hash, model_hash, model_id, split_id, model_type, hyperparameters)`, one row per fitted model.

    `hyperparameters` holds what was asked for and, under `effective`, what the fit used.
    """
    rows = []
    for split in splits:
        for spec in specs:
            text = json.dumps({**spec.params, "effective": spec.effective()}, sort_keys=True)
            digest = hashlib.md5(f"{spec.kind}:{split}:{text}".encode()).hexdigest()
            rows.append((run_hash, digest, spec.model_id, split, f"hindcast.{spec.kind}", text))
    schema = "experiment_hash string, model_hash string, model_id int, split_id int, model_type string, hyperparameters string"
    return SparkSession.active().createDataFrame(rows, schema)
