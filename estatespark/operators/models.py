"""Boosted trees on log prices: preparation, fit, fold ensemble, importances and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import splits
from estatespark.operators.boosting import FEATURES, LABEL, LOG_PREDICTION, BoostedTrees, best_prefix, fit_boosted, predicted_each
from estatespark.operators.projections import exp_prediction, log_target
from estatespark.operators.target_statistics import TargetStatistics, count_categories, count_rows, fit_target_statistics
from estatespark.schema import CATEGORICAL, IS_TEST, KEY, TARGET
from estatespark.session import as_table, in_this_run

__all__ = ["FEATURES", "LABEL", "best_prefix"]

# Predictions of fit rows by the member that did not see them.
LEFT_OUT = "left_out_prediction"
VALIDATION = "is_validation"
FOLD = "fold"
OWN_PART = "own_part"
SHARED_SLOTS = "shared_slots"
# Parts of each fold for target statistics, dealt by a hash of its own.
FOLD_PARTS = 4
PART_SEED_SHIFT = 3


@dataclass(frozen=True)
class Encoder:
    """Category and number columns as one vector per ensemble member, fitted on the fit rows.

    A category of a column with up to `one_hot_max_size` of them is a slot of its own, beside one slot for any other
    value. The categories of larger columns are target statistics, which differ by member as each leaves its fold out.
    """

    one_hot: tuple[tuple[str, tuple[str, ...]], ...]
    statistics: TargetStatistics
    continuous: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        """The source column of every slot."""
        slots = [column for column, labels in self.one_hot for _ in range(len(labels) + 1)]
        return (*slots, *self.continuous, *self.statistics.tables)

    @property
    def vectors(self) -> int:
        """Different vectors of a row: one per member, or one for all where there are no target statistics."""
        return len(self.statistics.members) if self.statistics.tables else 1

    def attach(self, df: DataFrame) -> DataFrame:
        """`df` with what `features` needs; the dictionaries are joined here, once for all members."""
        slots = []
        for column, labels in self.one_hot:
            value = F.col(column).cast("string")
            slots += [F.coalesce((value == label).cast("double"), F.lit(0.0)) for label in labels]
            slots.append(F.coalesce((~value.isin(*labels)).cast("double"), F.lit(1.0)))
        slots += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.continuous]
        # The slots that all members share are a column of their own, so that they are computed once.
        return self.statistics.attach(df).withColumn(SHARED_SLOTS, F.array(*slots).cast("array<double>"))

    def means(self, member: int, own: Column | None = None) -> Column:
        """What a member's features have behind the shared slots, on rows that `attach` has prepared. Fit rows have `own`, their part
        of the statistics."""
        return F.array(*[self.statistics.mean(c, member, own) for c in self.statistics.tables]).cast("array<double>")

    def features(self, member: int, own: Column | None = None) -> Column:
        """The features of a member as a vector."""
        return array_to_vector(F.concat(F.col(SHARED_SLOTS), self.means(member, own)))


def part_of(n_folds: int, seed: int, rows: DataFrame | None = None) -> Column:
    """Part of a fit row: its fold, and a finer hash inside it. Drawn hashes of `rows` are used."""
    return splits.fold(n_folds, seed, rows=rows) * FOLD_PARTS + splits.hashed(seed + PART_SEED_SHIFT, FOLD_PARTS, rows=rows)


def hash_seeds(seed: int) -> tuple[int, ...]:
    """Seeds of all hashes that a run draws of its keys: holdout, folds, parts."""
    return seed, seed + splits.FOLD_SEED_SHIFT, seed + PART_SEED_SHIFT


def fit_encoder(
    fit_rows: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str] = CATEGORICAL,
    one_hot_max_size: int = 8,
    n_folds: int = 2,
    seed: int = 0,
    by_fold: bool = False,
) -> Encoder:
    """`fit_rows` carry LABEL. With `by_fold` there is a member per fold, else one member that leaves nothing out.

    The categories are counted in one scan; at most `one_hot_max_size` labels per column come to the driver.
    """
    part, parts = part_of(n_folds, seed, fit_rows), n_folds * FOLD_PARTS
    counts = as_table(count_categories(fit_rows, categorical, LABEL, part), "category-counts")
    values = counts.groupBy("column", "value").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    # The limit is pushed below the shuffle: a column brings no more than one label too many.
    head = values.withColumn("place", place).where(F.col("place") <= one_hot_max_size + 1).collect()
    labels: dict[str, list[str]] = {c: [] for c in categorical}
    for row in sorted(head, key=lambda r: (r["column"], r["value"])):
        labels[row["column"]].append(row["value"])
    small = [c for c in categorical if len(labels[c]) <= one_hot_max_size]
    large = [c for c in categorical if c not in small]
    left_out = [tuple(range(i * FOLD_PARTS, (i + 1) * FOLD_PARTS)) for i in range(n_folds)] if by_fold else [()]
    statistics = fit_target_statistics(counts, large, *count_rows(fit_rows, LABEL, part, parts), left_out)
    return Encoder(tuple((c, tuple(labels[c])) for c in small), statistics, tuple(continuous))


@dataclass(frozen=True)
class PriceModel:
    encoder: Encoder
    trees: BoostedTrees
    member: int = 0

    def score(self, attached: DataFrame, output: str) -> DataFrame:
        """Adds the predicted price to rows that the encoder has attached its counts to."""
        predicted = self.trees.predicted(attached.sparkSession, F.col(SHARED_SLOTS), self.encoder.means(self.member))
        return exp_prediction(attached.withColumn(LOG_PREDICTION, predicted), LOG_PREDICTION, output).drop(LOG_PREDICTION)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the predicted price."""
        return self.score(self.encoder.attach(df), output).select(*[c for c in df.columns if c != output], output)

    def importances(self, spark) -> DataFrame:
        """(feature, importance), slots of one source column added up."""
        total: dict[str, float] = {}
        for name, value in zip(self.encoder.names, self.trees.importances(), strict=True):
            total[name] = total.get(name, 0.0) + float(value)
        return spark.createDataFrame(list(total.items()), "feature string, importance double")


def fit_trees(rows: DataFrame, validation: DataFrame | None, config: RunConfig, folder: str | None = None) -> BoostedTrees:
    """Trees on `rows` (FEATURES, LABEL); with validation rows, the prefix of lowest error there."""
    return fit_boosted(rows, validation, config, folder)[0]


def _labelled(df: DataFrame, is_validation: Column | None, config: RunConfig) -> DataFrame:
    known = log_target(df, TARGET, LABEL).where(F.col(LABEL).isNotNull())
    flag = F.lit(False) if is_validation is None else is_validation
    return known.withColumns({VALIDATION: F.coalesce(flag, F.lit(False)), FOLD: splits.fold(config.n_folds, config.seed, rows=df)})


def _encoded(
    df: DataFrame, continuous: Sequence[str], config: RunConfig, is_validation: Column | None, categorical: Sequence[str], by_fold: bool
) -> tuple[Encoder, DataFrame]:
    """The encoder, and the labelled rows encoded once for all members and written once, by fold."""
    known = _labelled(df, is_validation, config)
    fit_rows = known.where(~F.col(VALIDATION))
    encoder = fit_encoder(fit_rows, continuous, categorical, config.one_hot_max_size, config.n_folds, config.seed, by_fold)
    # The part is a column below the joins: as an expression its hashes would be drawn again wherever a mean asks for it.
    own = F.when(~F.col(VALIDATION), part_of(config.n_folds, config.seed, known)).otherwise(-1)
    known = known.withColumn(OWN_PART, own)
    vectors = [encoder.features(i, F.col(OWN_PART)).alias(f"{FEATURES}_{i}") for i in range(encoder.vectors)]
    encoded = encoder.attach(known).select(LABEL, VALIDATION, FOLD, *vectors)
    return encoder, as_table(encoded, "model-input", partition_by=FOLD)


def _members(
    df: DataFrame, continuous: Sequence[str], config: RunConfig, is_validation: Column | None, categorical: Sequence[str],
    by_fold: bool, parallelism: int,
) -> tuple[PriceModel, ...]:
    """Fits each member on its partitions of the encoded rows."""
    encoder, encoded = _encoded(df, continuous, config, is_validation, categorical, by_fold)
    count = len(encoder.statistics.members)

    def fit(i: int) -> PriceModel:
        rows = encoded.select(F.col(f"{FEATURES}_{min(i, encoder.vectors - 1)}").alias(FEATURES), LABEL, VALIDATION, FOLD)
        used = rows.where(~F.col(VALIDATION) & ((F.col(FOLD) != i) if by_fold else F.lit(True)))
        held = rows.where(F.col(VALIDATION)) if is_validation is not None else None
        return PriceModel(encoder, fit_trees(used, held, config), i)

    if count == 1:
        return (fit(0),)
    # The members' jobs run side by side, as tree fits leave many executors idle between their short stages.
    with ThreadPool(min(parallelism, count)) as pool:
        return tuple(pool.map(inheritable_thread_target(df.sparkSession)(in_this_run(fit)), range(count)))


def fit_price_model(
    df: DataFrame,
    continuous: Sequence[str],
    config: RunConfig = RunConfig(),
    is_validation: Column | None = None,
    categorical: Sequence[str] = CATEGORICAL,
) -> PriceModel:
    """Rows with a price: fit rows and, where `is_validation` says so, rows that only decide when to stop."""
    return _members(df, continuous, config, is_validation, categorical, by_fold=False, parallelism=1)[0]


def fit_curve(
    df: DataFrame, continuous: Sequence[str], config: RunConfig, is_validation: Column, categorical: Sequence[str] = CATEGORICAL, folder: str | None = None
) -> tuple[PriceModel, list[float]]:
    """`fit_price_model`, and the validation error after each tree that was fitted. With a `folder` a broken fit goes on there."""
    encoder, encoded = _encoded(df, continuous, config, is_validation, categorical, by_fold=False)
    rows = encoded.select(F.col(f"{FEATURES}_0").alias(FEATURES), LABEL, VALIDATION)
    trees, errors = fit_boosted(rows.where(~F.col(VALIDATION)), rows.where(F.col(VALIDATION)), config, folder)
    return PriceModel(encoder, trees), errors


def validation_curve(model: PriceModel, df: DataFrame) -> list[float]:
    """Mean absolute error of the log price after each tree."""
    known = model.encoder.attach(log_target(df, TARGET, LABEL).where(F.col(LABEL).isNotNull()))
    rows = known.select(model.encoder.features(model.member).alias(FEATURES), LABEL)
    return model.trees.evaluate_each(rows)


@dataclass(frozen=True)
class FoldEnsemble:
    """One encoder for all folds and a model per fold; the prediction is the mean price over the folds."""

    members: tuple[PriceModel, ...]

    def transform(self, df: DataFrame, output: str = "prediction", own_fold: Column | None = None) -> DataFrame:
        """Adds the predicted price.

        With `own_fold`, the fold of fit rows and missing for others, LEFT_OUT is added too: the price by the member that left the row
        out, and for rows that all members left out the mean.
        """
        names = [f"fold_{i}" for i in range(len(self.members))]
        encoder = self.members[0].encoder
        # One call for all members, so that a row goes to Python once.
        means = [encoder.means(m.member) for m in self.members] if encoder.statistics.tables else []
        logs = predicted_each(df.sparkSession, [m.trees for m in self.members], F.col(SHARED_SLOTS), means)
        rows = encoder.attach(df).withColumn(LOG_PREDICTION, logs)
        rows = rows.withColumns({name: F.exp(F.get(F.col(LOG_PREDICTION), F.lit(i))) for i, name in enumerate(names)})
        scored, added = average_predictions(rows, names, output), [output]
        if own_fold is not None:
            outside = F.coalesce(F.get(F.array(*names), own_fold.cast("int")), F.col(output))
            scored, added = scored.withColumn(LEFT_OUT, outside), [output, LEFT_OUT]
        return scored.select(*[c for c in df.columns if c not in added], *added)

    def importances(self, spark) -> DataFrame:
        """Mean importance over the folds, highest first."""
        tables = [m.importances(spark) for m in self.members]
        stacked = tables[0]
        for t in tables[1:]:
            stacked = stacked.unionByName(t)
        mean = stacked.groupBy("feature").agg((F.sum("importance") / len(tables)).alias("importance"))
        return mean.orderBy(F.desc("importance"), "feature")


def average_predictions(df: DataFrame, predictions: Sequence[str], output: str = "prediction") -> DataFrame:
    """Mean of the predicted prices (not of their logarithms)."""
    total = F.col(predictions[0])
    for name in predictions[1:]:
        total = total + F.col(name)
    return df.withColumn(output, total / F.lit(float(len(predictions))))


def fit_fold_ensemble(
    df: DataFrame,
    continuous: Sequence[str],
    config: RunConfig = RunConfig(),
    is_validation: Column | None = None,
    categorical: Sequence[str] = CATEGORICAL,
    parallelism: int = 3,
) -> FoldEnsemble:
    """Each member is fitted on the rows outside one fold; validation rows decide when to stop."""
    return FoldEnsemble(_members(df, continuous, config, is_validation, categorical, by_fold=True, parallelism=parallelism))


def score_splits(
    model, df: DataFrame, config: RunConfig = RunConfig(), output: str = "prediction", left_out: bool = False
) -> DataFrame:
    """All rows with split name and predicted price; with `left_out`, of an ensemble, also LEFT_OUT."""
    split = splits.split_name(config.valid_size, config.seed, KEY, IS_TEST, df)
    if left_out:
        scored = model.transform(df, output, F.when(split == "train", splits.fold(config.n_folds, config.seed, rows=df)))
    else:
        scored = model.transform(df, output)
    return scored.withColumn("split", split)
