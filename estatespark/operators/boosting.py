"""Boosted trees grown one by one on residuals, with leaf values of their own, in blocks that can be stopped and taken up again.

The first tree fits the label, each further one the sign of what the trees before leave over. A leaf then gets the mean of what its
tree was fitted on, or the median of the residuals that lie in it, which is the best constant for absolute errors. With
weights of one over the label that is the best constant for percentage errors.

A block is a number of trees. Inside a block the residuals are expressions over the block's trees; at its end they are written, with
the rows, to a table that the next block reads. Where leaves hold medians, which read the rows several times, the rows are written for
each tree, with the leaf that each falls into, and no tree is walked again. Fitting ends with the block in which patience ran out. A block's rows and trees are its state: a fit that is given
a folder goes on behind the last whole block it finds there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.functions.quantiles import medians_by_group
from estatespark.session import fresh_path, remove_path

LABEL = "label"
FEATURES = "features"
LOG_PREDICTION = "log_prediction"
HELD, WEIGHT, RESIDUAL, LEAF = "held", "fit_weight", "residual", "leaf"
# Trees between two written states.
BLOCK_TREES = 10

SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
OTHERWISE = re.compile(r"Else \(feature \d+ > \S+\)")
LEAF_VALUE = re.compile(r"Predict: (\S+)")


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of a walk that goes left first. A leaf has feature -1."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    @property
    def leaves(self) -> list[int]:
        """Nodes of the leaves, in the learner's order of leaves."""
        return [i for i, feature in enumerate(self.feature) if feature < 0]

    def with_leaf_values(self, values: Sequence[float]) -> Tree:
        placed = list(self.value)
        for node, value in zip(self.leaves, values, strict=True):
            placed[node] = value
        return replace(self, value=tuple(placed))


def read_tree(model: DecisionTreeRegressionModel) -> Tree:
    """The nodes of a fitted tree, from its description."""
    lines = iter([line.strip() for line in model.toDebugString.splitlines()[1:] if line.strip()])
    nodes: list[list] = []

    def walk() -> int:
        line, node = next(lines), len(nodes)
        nodes.append([-1, 0.0, -1, -1, 0.0])
        if leaf := LEAF_VALUE.fullmatch(line):
            nodes[node][4] = float(leaf[1])
            return node
        split = SPLIT.fullmatch(line)
        if split is None:
            raise ValueError(f"not a split of a number: {line}")
        nodes[node][:2] = int(split[1]), float(split[2])
        nodes[node][2] = walk()
        if not OTHERWISE.fullmatch(next(lines)):
            raise ValueError("a split needs two sides")
        nodes[node][3] = walk()
        return node

    walk()
    return Tree(*map(tuple, zip(*nodes)))


def _rows_of(features: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)


def _leaf_values(tree: Sequence[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row falls into."""
    feature, threshold, left, right, value = tree
    at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while True:
        wanted = feature[at]
        inner = wanted >= 0
        if not inner.any():
            return value[at]
        down = np.where(rows[every, np.maximum(wanted, 0)] <= threshold[at], left[at], right[at])
        at = np.where(inner, down, at)


@dataclass(frozen=True)
class BoostedTrees:
    """The sum of the trees' leaf values, each tree times its scale. `importance` has a share per tree and feature."""

    trees: tuple[Tree, ...]
    scales: tuple[float, ...]
    importance: tuple[tuple[float, ...], ...]

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as the library's own ensembles call it
        return len(self.trees)

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return len(self.importance[0]) if self.importance else 0

    def first(self, count: int) -> BoostedTrees:
        return BoostedTrees(self.trees[:count], self.scales[:count], self.importance[:count])

    def importances(self) -> list[float]:
        """Mean share of each feature in the gains of the trees that split at all."""
        total = np.sum([np.zeros(self.numFeatures), *[np.array(shares) for shares in self.importance]], axis=0)
        return (total / total.sum() if total.sum() else total).tolist()

    def arrays(self) -> list[tuple[tuple[np.ndarray, ...], float]]:
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        columns = [(t.feature, t.threshold, t.left, t.right, t.value) for t in self.trees]
        return [(tuple(np.array(c, k) for c, k in zip(tree, kinds)), scale) for tree, scale in zip(columns, self.scales)]

    def predicted(self, spark: SparkSession, *features: Column) -> Column:
        """The prediction for arrays of features, side by side; batches of rows go through the trees level by level."""
        shared = spark.sparkContext.broadcast(self.arrays())

        def predict(*features: pa.Array) -> pa.Array:
            total = np.zeros(len(features[0]))
            if len(total):
                rows = np.hstack([_rows_of(f) for f in features])
                for tree, scale in shared.value:
                    total += scale * _leaf_values(tree, rows)
            return pa.array(total)

        return F.arrow_udf(predict, "double")(*features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction to rows with a vector of features."""
        return df.withColumn(LOG_PREDICTION, self.predicted(df.sparkSession, vector_to_array(FEATURES)))

    def evaluate_each(self, df: DataFrame) -> list[float]:
        """Mean absolute error of the label after each tree. Tasks send a sum per tree."""
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, np.zeros(len(shared.value))
            for batch in batches:
                if not batch.num_rows:
                    continue
                left, rows = batch.column(1).to_numpy(zero_copy_only=False).copy(), _rows_of(batch.column(0))
                n += len(rows)
                for i, (tree, scale) in enumerate(shared.value):
                    left -= scale * _leaf_values(tree, rows)
                    sums[i] += np.abs(left).sum()
            yield pa.RecordBatch.from_pydict({"tree": list(range(len(sums))), "n": [n] * len(sums), "error": sums.tolist()})

        rows = df.select(vector_to_array(FEATURES).alias(FEATURES), F.col(LABEL).cast("double"))
        found = rows.mapInArrow(errors, "tree bigint, n bigint, error double").groupBy("tree")
        return [r["error"] for r in found.agg((F.sum("error") / F.sum("n")).alias("error")).orderBy("tree").collect()]


def predicted_each(spark: SparkSession, ensembles: Sequence[BoostedTrees], shared: Column, own: Sequence[Column] = ()) -> Column:
    """An array of the ensembles' predictions. Each sees the `shared` features and, behind them, its entry of `own`, if there are any."""
    ensembles_sent = spark.sparkContext.broadcast([e.arrays() for e in ensembles])

    def predict(shared: pa.Array, *own: pa.Array) -> pa.Array:
        totals = np.zeros((len(shared), len(ensembles_sent.value)))
        if len(shared):
            rows = _rows_of(shared)
            for i, trees in enumerate(ensembles_sent.value):
                seen = np.hstack([rows, _rows_of(own[i])]) if own else rows
                for tree, scale in trees:
                    totals[:, i] += scale * _leaf_values(tree, seen)
        ends = np.arange(len(shared) + 1, dtype=np.int32) * totals.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(totals.ravel()))

    # Marked so that a filter on a prediction, as for missing ones, does not have Spark predict every row twice.
    return F.arrow_udf(predict, "array<double>").asNondeterministic()(shared, *own)


def best_prefix(errors: Sequence[float], patience: int | None = None) -> int:
    """How many iterations to keep: up to the lowest error, the first of equal ones.

    With `patience` the search ends after that many iterations in a row without a new lowest error.
    """
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        if patience is not None and i - best >= patience:
            break
    return best + 1


def _weight(config: RunConfig) -> Column:
    """What an error of a row counts: one, or one over the fitted value for percentage errors."""
    return F.lit(1.0) if config.loss == "absolute" else 1.0 / F.greatest(F.abs(F.col(LABEL)), F.lit(1.0))


def _learner(config: RunConfig, number: int) -> RandomForestRegressor:
    """One tree on all features; a forest of one is the learner that takes a share of the rows."""
    return RandomForestRegressor(
        featuresCol=FEATURES, labelCol="gradient", weightCol=WEIGHT, numTrees=1, bootstrap=False, featureSubsetStrategy="all",
        maxDepth=config.max_depth, maxBins=config.border_count, subsamplingRate=config.subsample, seed=config.random_seed + number,
    )


def leaf_medians(rows: DataFrame, n_rows: int, weighted: bool) -> dict[int, float]:
    """Median of the residuals of each leaf, of rows with LEAF, RESIDUAL and WEIGHT. Some thousand leaves at most."""
    found = medians_by_group(rows, LEAF, RESIDUAL, WEIGHT if weighted else None, n_rows)
    return {int(r[LEAF]): r["median"] for r in found.collect()}


def grow(
    current: DataFrame, number: int, n_rows: int, config: RunConfig, path: str | None = None
) -> tuple[Tree, float, tuple[float, ...], DataFrame]:
    """(tree, its scale, its importances, `current` with the residuals it leaves over) of the next tree.

    With a `path` the rows are written there, beside the leaf that each falls into. What follows reads that table and looks leaf values
    up, so that no tree is walked twice for a row.
    """
    # The first tree stands for the start, so it counts whole.
    scale = config.learning_rate if number else 1.0
    sign = F.when(F.col(RESIDUAL) < 0, -1.0).otherwise(1.0)
    target = current.where(~F.col(HELD)).select(FEATURES, WEIGHT, (sign if number else F.col(RESIDUAL)).alias("gradient"))
    model = _learner(config, number).fit(target).trees[0].setLeafCol(LEAF).setPredictionCol("")
    tree = read_tree(model)
    fallen = model.transform(current).withColumn(LEAF, F.col(LEAF).cast("int"))
    if path:
        fallen.write.parquet(path)
        fallen = current.sparkSession.read.schema(fallen.schema).parquet(path)
    if config.leaf_values == "median":
        medians = leaf_medians(fallen.where(~F.col(HELD)).select(LEAF, RESIDUAL, WEIGHT), n_rows, config.loss != "absolute")
        tree = tree.with_leaf_values([medians.get(i, tree.value[node]) for i, node in enumerate(tree.leaves)])
    # An array is one literal, where a list would be one per leaf.
    values = F.lit(np.array([tree.value[node] for node in tree.leaves]))
    left = fallen.withColumn(RESIDUAL, F.col(RESIDUAL) - F.lit(scale) * F.get(values, F.col(LEAF))).drop(LEAF)
    return tree, scale, tuple(model.featureImportances.toArray().tolist()), left


class _States:
    """Written blocks of one fit, below a folder. A block counts once its description is there, which comes last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def last(self) -> tuple[int, BoostedTrees, list[float], DataFrame] | None:
        """(next block, trees, errors, rows) behind the last whole block."""
        found, block = None, 0
        while self._exists(f"{self.folder}/block-{block}/trees/_SUCCESS"):
            found, block = block, block + 1
        if found is None:
            return None
        text = self.spark.read.text(f"{self.folder}/block-{found}/trees", wholetext=True).first()[0]
        described = json.loads(text)
        trees = tuple(Tree(*map(tuple, t)) for t in described["trees"])
        ensemble = BoostedTrees(trees, tuple(described["scales"]), tuple(map(tuple, described["importance"])))
        return block, ensemble, described["errors"], self.spark.read.parquet(f"{self.folder}/block-{found}/rows")

    def write(self, block: int, ensemble: BoostedTrees, errors: list[float], rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/block-{block}"
        # What a broken attempt has left is no state.
        remove_path(self.spark, path)
        rows.write.parquet(f"{path}/rows")
        trees = [(t.feature, t.threshold, t.left, t.right, t.value) for t in ensemble.trees]
        text = json.dumps({"trees": trees, "scales": ensemble.scales, "importance": ensemble.importance, "errors": errors})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/trees")
        if block:
            remove_path(self.spark, f"{self.folder}/block-{block - 1}/rows")
        return self.spark.read.schema(rows.schema).parquet(f"{path}/rows")


def fit_boosted(
    rows: DataFrame, validation: DataFrame | None, config: RunConfig, folder: str | None = None, block_trees: int = BLOCK_TREES
) -> tuple[BoostedTrees, list[float]]:
    """(the trees kept, validation error after each tree that was fitted) on `rows` (FEATURES, LABEL).

    With validation rows and early stopping the prefix of lowest error is kept, and fitting ends after the block in which
    `early_stopping_rounds` trees in a row brought no new lowest error. With a `folder` the blocks are kept there, and a second call
    with the same rows and settings goes on behind the last one.
    """
    spark = rows.sparkSession
    stops = config.early_stopping and validation is not None and not validation.isEmpty()
    data = rows.select(FEATURES, LABEL, F.lit(False).alias(HELD))
    if stops:
        data = data.unionByName(validation.select(FEATURES, LABEL, F.lit(True).alias(HELD)))
    current = data.select(FEATURES, LABEL, HELD, _weight(config).alias(WEIGHT), F.col(LABEL).alias(RESIDUAL))
    states = _States(spark, folder) if folder else None
    ensemble, errors, block = BoostedTrees((), (), ()), [], 0
    if states and (found := states.last()):
        block, ensemble, errors, current = found
    # Medians read the rows several times, so those are written for each tree; else a block's residuals are one expression.
    by_tree, path, state = config.leaf_values == "median", None, None
    n_rows = rows.count() if by_tree else 0
    while ensemble.getNumTrees < config.iterations and not _spent(errors, config):
        stages = []
        for number in range(ensemble.getNumTrees, min(config.iterations, ensemble.getNumTrees + block_trees)):
            before, path = path, fresh_path(spark, "leaves") if by_tree else None
            tree, scale, shares, current = grow(current, number, n_rows, config, path)
            if before:
                remove_path(spark, before)
            ensemble = BoostedTrees((*ensemble.trees, tree), (*ensemble.scales, scale), (*ensemble.importance, shares))
            if stops and by_tree:
                errors = [*errors, *current.where(HELD).agg(_error(RESIDUAL)).first()]
            elif stops:
                stages.append(f"left_{number}")
                current = current.withColumn(stages[-1], F.col(RESIDUAL))
        if stages:
            errors = [*errors, *current.where(HELD).agg(*[_error(s).alias(s) for s in stages]).first()]
        current = current.drop(*stages)
        if states:
            current = states.write(block, ensemble, errors, current)
        elif not by_tree and ensemble.getNumTrees < config.iterations and not _spent(errors, config):
            # One block's rows lie on disk beside the next one's, however many blocks there are.
            before, state = state, fresh_path(spark, "residuals")
            current.write.parquet(state)
            current = spark.read.schema(current.schema).parquet(state)
            if before:
                remove_path(spark, before)
        block += 1
    return (ensemble.first(best_prefix(errors, config.early_stopping_rounds)) if stops else ensemble), errors


def _error(residual: str) -> Column:
    return F.sum(F.abs(F.col(residual)) * F.col(WEIGHT)) / F.sum(WEIGHT)


def _spent(errors: Sequence[float], config: RunConfig) -> bool:
    """Whether patience has run out."""
    best = 0
    for i, error in enumerate(errors):
        best = i if error < errors[best] else best
        if config.early_stopping_rounds is not None and i - best >= config.early_stopping_rounds:
            return True
    return False
