"""Cleaning and feature expressions on single rows. No operator here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.functions import numeric
from estatespark.schema import CATEGORICAL, CONTINUOUS, QUANTILE_COLUMNS, TARGET, image_feature_columns

# Types whose implausible sizes are removed, most photos counted, fill values of the cleaning.
SIZED_TYPES = ("appartement", "maison")
MAX_PHOTOS = 6
ENERGY_FILL = {"energy_performance_value": -1.0, "ghg_value": -1.0}
CONTINUOUS_FILL = 0.0
CATEGORY_FILL = "-1"


def add_department(df: DataFrame) -> DataFrame:
    return df.withColumn("department", numeric.department(F.col("postal_code")))


def add_size_clean(df: DataFrame, cutoff: float = 1000.0) -> DataFrame:
    """`size`, missing for apartments and houses above the cutoff."""
    implausible = F.col("property_type").isin(*SIZED_TYPES) & (F.col("size") > cutoff)
    return df.withColumn("size_clean", F.when(implausible, None).otherwise(F.col("size")))


def add_size_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("size_ratio", numeric.safe_ratio(F.col("size"), F.col("land_size")))


def add_price_m2(df: DataFrame) -> DataFrame:
    return df.withColumn("price_m2", numeric.safe_ratio(F.col(TARGET), F.col("size_clean")))


def add_size_ratio_clean(df: DataFrame) -> DataFrame:
    return df.withColumn("size_ratio_clean", numeric.safe_ratio(F.col("size_clean"), F.col("land_size")))


def add_nb_photos_clean(df: DataFrame) -> DataFrame:
    return df.withColumn("nb_photos_clean", numeric.bounded(F.col("nb_photos"), upper=MAX_PHOTOS))


def backfill_size(df: DataFrame, fit_rows: Column, area_price: str = "price_m2_type_zipcode") -> DataFrame:
    """Missing clean sizes of fit rows, from the price and the area's mean price per square metre."""
    estimate = numeric.safe_ratio(F.col(TARGET), F.col(area_price))
    return df.withColumn(
        "size_clean", F.when(fit_rows & F.col("size_clean").isNull(), estimate).otherwise(F.col("size_clean"))
    )


def clip_columns(
    df: DataFrame,
    columns: Sequence[str] = ("nb_rooms", "nb_bedrooms"),
    lower: float | None = None,
    upper: float | None = None,
) -> DataFrame:
    return df.withColumns({c: numeric.bounded(F.col(c), lower, upper) for c in columns})


def fill_rooms(df: DataFrame) -> DataFrame:
    """Missing room counts become bedrooms plus one."""
    return df.withColumn("nb_rooms", F.coalesce(F.col("nb_rooms"), F.col("nb_bedrooms") + 1))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for missing values; every continuous column becomes double, every categorical one text."""
    fills = {c: F.lit(ENERGY_FILL.get(c, CONTINUOUS_FILL)) for c in CONTINUOUS}
    columns = {c: F.coalesce(F.col(c).cast("double"), fill) for c, fill in fills.items()}
    columns.update({c: F.coalesce(F.col(c).cast("string"), F.lit(CATEGORY_FILL)) for c in CATEGORICAL})
    return df.withColumns(columns)


def log_target(df: DataFrame, target: str = TARGET, output: str = "label") -> DataFrame:
    """Natural logarithm of the price; NULL for prices that are not positive."""
    return df.withColumn(output, F.when(F.col(target) > 0, F.log(target)))


def exp_prediction(df: DataFrame, prediction: str = "prediction", output: str = TARGET) -> DataFrame:
    return df.withColumn(output, F.exp(prediction))


def model_columns(
    columns_to_add: Sequence[str] = (),
    dont_use_size: bool = False,
    n_image_features: int = 0,
    n_pca_features: int | None = None,
    network: bool = False,
    only: Sequence[str] | None = None,
) -> tuple[list[str], list[str]]:
    """(continuous, categorical) columns of a model. Principal components replace the raw image columns.

    With `only` the model has those columns; each must be one that it could have.
    """
    continuous = list(CONTINUOUS)
    if n_pca_features:
        continuous += [f"pca_feature_{i}" for i in range(n_pca_features)]
    elif n_image_features:
        continuous += image_feature_columns(n_image_features)
    if network:
        return continuous, list(CATEGORICAL)
    continuous += list(columns_to_add)
    if dont_use_size:
        continuous.remove("size")
    if only is not None:
        unknown = sorted(set(only) - {*continuous, *CATEGORICAL})
        if unknown:
            raise ValueError(f"columns that the model can't have: {unknown}")
        return [c for c in continuous if c in only], [c for c in CATEGORICAL if c in only]
    return continuous, list(CATEGORICAL)


def select_features(df: DataFrame, keep: Sequence[str], continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Categorical columns first, then continuous ones."""
    return df.select(*keep, *categorical, *continuous)


def uncertainty_filter(df: DataFrame, level: float = 0.5) -> DataFrame:
    return df.where(F.col("uncertainty") < level)


def width_filter(df: DataFrame, width: int = 743) -> DataFrame:
    return df.where(F.col("width") == width)


def add_aspect_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("aspect_ratio", numeric.safe_ratio(F.col("width"), F.col("height")))


def prepare(df: DataFrame, quantile_map=None, clip_rooms: tuple[float | None, float | None] | None = None) -> DataFrame:
    """The cleaning sequence: quantile map, room bounds, department, rooms, defaults."""
    if quantile_map is not None:
        df = quantile_map.transform(df, QUANTILE_COLUMNS)
    if clip_rooms is not None:
        df = clip_columns(df, lower=clip_rooms[0], upper=clip_rooms[1])
    return fill_defaults(fill_rooms(add_department(df)))
