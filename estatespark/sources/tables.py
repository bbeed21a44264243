"""Table readers. Schemas are declared, so a file cannot change a column's type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatespark.schema import KEY, image_features_schema


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV (with header) or parquet table. CSV needs a schema; for parquet it prunes to the declared columns."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a declared schema")
        # Malformed numbers raise rather than turn into missing values; a written NaN is a missing value.
        return without_nan(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path))
    stored = without_nan(spark.read.parquet(path))
    if schema is None:
        return stored
    missing = [f.name for f in schema.fields if f.name not in stored.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN counts as missing in every numeric column, whatever file it comes from."""
    decimals = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in decimals}) if decimals else df


def read_image_features(spark: SparkSession, path: str, key: str = KEY) -> DataFrame:
    """A wide table of photo features, parquet or CSV. The header says how many features there are, the schema their types."""
    if not path.rstrip("/").endswith(".csv"):
        return read_keyed(spark, path, None, key)
    names = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f for f in image_features_schema(len(names) - 1).fields}
    if set(names) != set(declared):
        raise ValueError(f"{path} is no table of {key} and image_feature_0 to image_feature_{len(names) - 2}")
    return read_keyed(spark, path, T.StructType([declared[n] for n in names]), key)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType | None, key: str) -> DataFrame:
    """A table of precomputed values per listing: image features, predictions, pseudo labels."""
    table = read_table(spark, path, schema)
    if key not in table.columns:
        raise ValueError(f"{path} has no key column {key}")
    return table.where(F.col(key).isNotNull())
