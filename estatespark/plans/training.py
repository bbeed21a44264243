"""The tree run: enrich, clean, add photo features, append pseudo labels, fit folds, score and evaluate."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import metrics, models, projections, pseudo_labels, quantile_map, splits, vectors
from estatespark.operators.area_stats import AreaStatistics
from estatespark.plans import enrichment
from estatespark.schema import IS_TEST, KEY, LISTING, QUANTILE_COLUMNS, TARGET
from estatespark.session import as_table


@dataclass(frozen=True)
class Preparation:
    """Everything fitted that turns listings into rows for the model."""

    config: RunConfig
    statistics: AreaStatistics
    quantile_map: quantile_map.QuantileMap | None
    n_images: int
    components: vectors.Components | None
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]

    def transform(
        self, listings: DataFrame, image_features: DataFrame | None = None, vector: str = "vector", keep: tuple[str, ...] = ()
    ) -> DataFrame:
        """Key, split flag, price, area, the columns to `keep` and the model's. `image_features` is (key, array `vector`)."""
        config = self.config
        enriched = enrichment.apply_enrichment(
            listings, self.statistics, config.size_cutoff, config.valid_size, config.seed, config.size_backfill
        )
        table = projections.prepare(enriched, self.quantile_map, config.clip_rooms)
        if self.n_images or self.components is not None:
            if image_features is None:
                raise ValueError("the model was fitted with photo features")
            joined = vectors.join_image_features(table, image_features)
            if self.components is not None:
                projected = self.components.transform(joined, vector)
                table = vectors.widen(projected, "pca", config.n_pca_features, "pca_feature_").drop(vector)
            else:
                table = vectors.widen(joined, vector, self.n_images)
        # The area of the pseudo labels is kept, whether it is a feature or not.
        area = [] if "postal_code" in self.categorical else ["postal_code"]
        kept = [KEY, IS_TEST, TARGET, *area, *keep, *splits.drawn_hashes(listings)]
        return projections.select_features(table, kept, self.continuous, self.categorical)


def fit_preparation(
    listings: DataFrame,
    config: RunConfig = RunConfig(),
    image_features: DataFrame | None = None,
    vector: str = "vector",
    written: bool = False,
) -> Preparation:
    statistics = enrichment.fit_enrichment(listings, config.size_cutoff, config.valid_size, config.seed, written=written)
    fitted = None
    if config.quantile_transform is not None:
        # Enrichment leaves these columns as they are, so the map needs none of its joins.
        known = listings.where(~F.col(IS_TEST))
        fitted = quantile_map.fit_quantile_map(known, n_quantiles=config.n_quantiles, output=config.quantile_transform)
    n_images, components = 0, None
    if config.use_image_features and image_features is not None:
        # Listings without photos have no vector, and so may the first row.
        n_images = image_features.agg(F.max(F.size(vector))).first()[0] or 0
        if config.n_pca_features:
            owned = as_table(listings.select(KEY).join(image_features, KEY).select(vector), "photo-vectors")
            components = vectors.fit_components(owned, vector, config.n_pca_features)
    continuous, categorical = projections.model_columns(
        config.columns_to_add, config.dont_use_size, n_images, config.n_pca_features if n_images else None, only=config.features
    )
    return Preparation(config, statistics, fitted, n_images, components, tuple(continuous), tuple(categorical))


# What the enrichment and the pseudo labels read, and what further columns are made of.
_ENRICHED = ("postal_code", "city", "property_type", "size")
_MADE_OF = {"nb_rooms": ("nb_bedrooms",), "size_ratio": ("land_size",), "size_ratio_clean": ("land_size",), "nb_photos_clean": ("nb_photos",)}


def written_listings(listings: DataFrame, config: RunConfig) -> DataFrame:
    """The listings written once, with the hashes of their keys: a run's statistics and its rows read them, and whatever joins lie
    below `listings` run once. Columns that the model can't see are missing values of their type."""
    raw = [c for c in listings.columns if c in LISTING.names]
    needed = {KEY, IS_TEST, TARGET, *_ENRICHED, *raw}
    if config.features is not None:
        wanted = {*config.features, *(QUANTILE_COLUMNS if config.quantile_transform else ())}
        needed = {KEY, IS_TEST, TARGET, *_ENRICHED, *wanted, *[c for w in wanted for c in _MADE_OF.get(w, ())]}
    kept = [c for c in raw if c in needed]
    written = as_table(splits.draw_hashes(listings.select(*kept), models.hash_seeds(config.seed)), "listings")
    types = listings.schema
    columns = [F.col(c) if c in needed else F.lit(None).cast(types[c].dataType).alias(c) for c in raw]
    return written.select(*columns, *splits.drawn_hashes(written))


def model_table(
    listings: DataFrame, config: RunConfig = RunConfig(), image_features: DataFrame | None = None, vector: str = "vector"
) -> tuple[DataFrame, list[str], list[str]]:
    """(rows ready for the model, continuous columns, categorical ones). `image_features` is (key, array `vector`)."""
    listings = written_listings(listings, config)
    fitted = fit_preparation(listings, config, image_features, vector, written=True)
    return fitted.transform(listings, image_features, vector), list(fitted.continuous), list(fitted.categorical)


@dataclass(frozen=True)
class TreeRun:
    model: models.FoldEnsemble | None
    scored: DataFrame
    metrics: DataFrame
    importances: DataFrame
    preparation: Preparation | None = None


def run_trees(
    listings: DataFrame,
    config: RunConfig = RunConfig(),
    image_features: DataFrame | None = None,
    labels: DataFrame | None = None,
    run: str = "run",
) -> TreeRun:
    """`labels` are pseudo labels (key, price, uncertainty) of test rows."""
    listings = written_listings(listings, config)
    prepared = fit_preparation(listings, config, image_features, written=True)
    # Every fold fit and the scoring read the prepared rows.
    table = as_table(prepared.transform(listings, image_features), "prepared")
    return replace(fit_and_score(table, list(prepared.continuous), list(prepared.categorical), config, labels, run), preparation=prepared)


def fit_and_score(
    table: DataFrame, continuous: list[str], categorical: list[str], config: RunConfig, labels: DataFrame | None = None, run: str = "run"
) -> TreeRun:
    known = table.where(~F.col(IS_TEST))
    validation = splits.is_holdout(config.valid_size, config.seed, rows=table) & ~F.col(IS_TEST)
    if labels is not None:
        known = pseudo_labels.append_pseudo_labels(known, table.where(F.col(IS_TEST)), labels, config.uncertainty_level)
    model = models.fit_fold_ensemble(known, continuous, config, validation, categorical)
    scored = models.score_splits(model, table, config, left_out=True).drop(*splits.drawn_hashes(table))
    errors = metrics.metrics_by_split(scored.where(~F.col(IS_TEST)), "split", TARGET, "prediction")
    return TreeRun(model, scored, metrics.metric_rows(errors, run), model.importances(table.sparkSession))


def pseudo_label_rounds(
    listings: DataFrame, config: RunConfig = RunConfig(), rounds: int = 1, image_features: DataFrame | None = None, out_of_fold: bool = False
) -> TreeRun:
    """A run without pseudo labels, then runs on the labels of the run before. The rows are prepared once.

    An area's uncertainty is the error of the prediction there; `out_of_fold`, of the prediction by members that did not see the row,
    so that areas whose prices the trees have learnt by heart do not look certain.
    """
    table, continuous, categorical = model_table(listings, config, image_features)
    table = as_table(table, "prepared")
    result = fit_and_score(table, continuous, categorical, config, run="round_0")
    for i in range(rounds):
        scored = as_table(result.scored.select(KEY, "postal_code", TARGET, "prediction", models.LEFT_OUT, IS_TEST), "scored")
        judged = models.LEFT_OUT if out_of_fold else "prediction"
        labels = as_table(pseudo_labels.pseudo_labels(scored, judged=judged), "pseudo-labels")
        result = fit_and_score(table, continuous, categorical, config, labels, f"round_{i + 1}")
    return result
