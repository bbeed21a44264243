"""Declared columns of the listing tables, so that no file's types depend on inference."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "listing_id"
TARGET = "price"
IS_TEST = "is_test"

# Categorical and continuous model columns, in model order.
CATEGORICAL = (
    "property_type",
    "city",
    "postal_code",
    "energy_performance_category",
    "ghg_category",
    "exposition",
    "has_a_balcony",
    "has_a_cellar",
    "has_a_garage",
    "has_air_conditioning",
    "last_floor",
    "upper_floors",
    "department",
)
CONTINUOUS = (
    "approximate_latitude",
    "approximate_longitude",
    "size",
    "floor",
    "land_size",
    "energy_performance_value",
    "ghg_value",
    "nb_rooms",
    "nb_bedrooms",
    "nb_bathrooms",
    "nb_parking_places",
    "nb_boxes",
    "nb_photos",
    "nb_terraces",
)
# Columns that go through the quantile map.
QUANTILE_COLUMNS = ("size", "land_size", "energy_performance_value", "ghg_value")
# Suffix of the price statistics of an area level, and the area column behind it.
AREA_LEVELS = {"zipcode": "postal_code", "deptcode": "department", "city": "city"}
# Names of the price-per-square-metre statistics; {} stands for the level.
PRICE_STATISTICS = {
    "mean": "price_m2_type_{}",
    "p25": "price_m2_type_{}25",
    "p50": "price_m2_type_{}50",
    "p75": "price_m2_type_{}75",
    "std": "price_m2_type_{}_std",
}

TEXT_CATEGORIES = ("property_type", "city", "energy_performance_category", "ghg_category", "exposition")
FLAG_CATEGORIES = tuple(c for c in CATEGORICAL if c.startswith("has_")) + ("last_floor", "upper_floors")


def _feature_type(column: str) -> T.DataType:
    if column in TEXT_CATEGORIES:
        return T.StringType()
    if column == "postal_code":
        return T.LongType()
    return T.DoubleType()


RAW_FEATURES = tuple(c for c in CATEGORICAL if c != "department") + CONTINUOUS

FEATURES = T.StructType(
    [T.StructField(KEY, T.LongType(), False)] + [T.StructField(c, _feature_type(c)) for c in RAW_FEATURES]
)
LABELS = T.StructType([T.StructField(KEY, T.LongType(), False), T.StructField(TARGET, T.DoubleType())])
SUBMISSION = LABELS
PSEUDO_LABELS = T.StructType(LABELS.fields + [T.StructField("uncertainty", T.DoubleType())])
LISTING = T.StructType(
    FEATURES.fields + [T.StructField(TARGET, T.DoubleType()), T.StructField(IS_TEST, T.BooleanType(), False)]
)
METRICS = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())]
)


def image_feature_columns(count: int) -> list[str]:
    return [f"image_feature_{i}" for i in range(count)]


def image_features_schema(count: int) -> T.StructType:
    return T.StructType(
        [T.StructField(KEY, T.LongType(), False)]
        + [T.StructField(c, T.FloatType()) for c in image_feature_columns(count)]
    )


def enrichment_columns() -> list[str]:
    """Selectable columns that the enrichment adds."""
    base = ["density", "density_department", "density_ratio", "size_ratio", "size_clean", "size_ratio_clean"]
    statistics = [name.format(level) for level in AREA_LEVELS for name in PRICE_STATISTICS.values()]
    return base + statistics + ["nb_photos_clean"]
