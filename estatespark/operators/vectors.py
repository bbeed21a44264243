"""Feature vectors per listing: averages, joins, principal components, wide and packed forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import (
    PCA,
    ElementwiseProduct,
    PCAModel,
    StandardScaler,
    StandardScalerModel,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatespark.schema import KEY

# The covariance matrix of this width takes 128 MB.
MAX_WIDTH = 4096


def vector_mean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per key. Sums of fixed width combine before the shuffle, so a key may hold any share of rows."""
    packed = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector)).alias("v"))
    return packed.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias(vector))


def widen(df: DataFrame, vector: str, size: int, prefix: str = "image_feature_") -> DataFrame:
    columns = [F.get(F.col(vector), F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]
    return df.select(*[c for c in df.columns if c != vector], *columns)


def pack(df: DataFrame, columns: Sequence[str], vector: str) -> DataFrame:
    """The named columns as one array; NULL where all of them are missing."""
    some = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    return df.withColumn(vector, F.when(some, F.array(*columns))).drop(*columns)


def join_image_features(df: DataFrame, features: DataFrame, key: str = KEY) -> DataFrame:
    """Left join; listings without photos keep a NULL vector."""
    return df.join(features, key, "left")


def union_vectors(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


@dataclass(frozen=True)
class Components:
    """Fitted centre and principal components; the largest loading of each component is positive."""

    centre: StandardScalerModel
    model: PCAModel
    signs: Sequence[float]

    @property
    def size(self) -> int:
        return self.model.pc.numRows

    def loadings(self) -> np.ndarray:
        return self.model.pc.toArray() * np.asarray(self.signs)

    def transform(self, df: DataFrame, vector: str, output: str = "pca") -> DataFrame:
        """Adds the projection as an array; NULL in, NULL out."""
        zero = F.array_repeat(F.lit(0.0), self.size)
        held = df.withColumn("pca_in", array_to_vector(F.coalesce(F.col(vector).cast("array<double>"), zero)))
        flip = ElementwiseProduct(scalingVec=Vectors.dense(self.signs), inputCol="pca_raw", outputCol="pca_signed")
        projected = flip.transform(self.model.transform(self.centre.transform(held)))
        result = F.when(F.col(vector).isNotNull(), vector_to_array("pca_signed"))
        return projected.withColumn(output, result).drop("pca_in", "pca_centred", "pca_raw", "pca_signed")


def fit_components(df: DataFrame, vector: str, n_components: int) -> Components:
    """Sums of products are aggregated on the executors; the driver sees one square matrix of the vector's width, which is why
    widths above MAX_WIDTH are refused.
    """
    present = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("pca_in"))
    width = present.select(F.size(vector_to_array("pca_in")).alias("width")).agg(F.max("width")).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"components of vectors wider than {MAX_WIDTH} are not fitted: {width}")
    centre = StandardScaler(withMean=True, withStd=False, inputCol="pca_in", outputCol="pca_centred").fit(present)
    model = PCA(k=n_components, inputCol="pca_centred", outputCol="pca_raw").fit(centre.transform(present))
    loadings = model.pc.toArray()
    strongest = loadings[np.abs(loadings).argmax(axis=0), range(n_components)]
    return Components(centre, model, [1.0 if s >= 0 else -1.0 for s in strongest])


def assemble(
    df: DataFrame, columns: Sequence[str], vector_sizes: Mapping[str, int] | None = None, output: str = "features"
) -> DataFrame:
    """Blocks of columns, numbers or vectors, as one vector; missing numbers become 0.

    The widths of vector columns are given, so that no row has to be read to plan.
    """
    types = dict(df.dtypes)
    filled = df.fillna(0.0, [c for c in columns if types[c] in ("double", "float")])
    for column, size in (vector_sizes or {}).items():
        filled = VectorSizeHint(inputCol=column, size=size, handleInvalid="error").transform(filled)
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(filled)
