"""Enrichment of listings with area densities and price statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from estatespark.functions import quantiles
from estatespark.operators import area_stats, projections, splits


def base_features(df: DataFrame, size_cutoff: float = 1000.0) -> DataFrame:
    """The single-row features that the area statistics start from."""
    df = projections.add_department(df)
    df = projections.add_size_clean(df, size_cutoff)
    return projections.add_price_m2(projections.add_size_ratio(df))


def fit_enrichment(
    listings: DataFrame,
    size_cutoff: float = 1000.0,
    valid_size: float = 0.2,
    seed: int = 0,
    direct_rows: int = quantiles.DIRECT_ROWS,
    written: bool = False,
) -> area_stats.AreaStatistics:
    """Area densities of all listings and price statistics of the fit rows, from narrow scans of `listings`, a `written` table or not."""
    return area_stats.fit_area_statistics(base_features(listings, size_cutoff), splits.is_fit(valid_size, seed, rows=listings), direct_rows, written)


def apply_enrichment(
    listings: DataFrame,
    statistics: area_stats.AreaStatistics,
    size_cutoff: float = 1000.0,
    valid_size: float = 0.2,
    seed: int = 0,
    size_backfill: bool = True,
) -> DataFrame:
    """Listings of any split with the enrichment columns of fitted statistics."""
    enriched = statistics.transform(base_features(listings, size_cutoff))
    if size_backfill:
        enriched = projections.backfill_size(enriched, splits.is_fit(valid_size, seed, rows=listings))
    return projections.add_nb_photos_clean(projections.add_size_ratio_clean(enriched))


def enrich(
    listings: DataFrame,
    size_cutoff: float = 1000.0,
    valid_size: float = 0.2,
    seed: int = 0,
    size_backfill: bool = True,
    direct_rows: int = quantiles.DIRECT_ROWS,
) -> DataFrame:
    """Listings of all splits, with prices where known, plus the enrichment columns and `price_m2`.

    Fits on narrow scans of `listings` and returns a lazy projection with joins to the fitted tables, so the wide rows are
    read once and, while the statistics stay below the broadcast limit, never shuffled.
    """
    statistics = fit_enrichment(listings, size_cutoff, valid_size, seed, direct_rows)
    return apply_enrichment(listings, statistics, size_cutoff, valid_size, seed, size_backfill)
