"""Expressions shared by the operators. All but functions of batches stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The largest absolute value of the normal quantile output, the normal quantile of 1 - (1e-7 - 2**-52).
NORMAL_BOUND = 5.1993375821928165
# Rational approximations of Wichura (1988), algorithm AS 241, highest power last.
AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_NEAR_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero or either side is missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def bounded(value: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """`value` held within the bounds; a missing value stays missing."""
    result = value
    if lower is not None:
        result = F.greatest(result, F.lit(float(lower)))
    if upper is not None:
        result = F.least(result, F.lit(float(upper)))
    return F.when(value.isNotNull(), result)


def department(postal_code: Column) -> Column:
    """First two digits of the five-digit postal code."""
    return F.substring(F.lpad(postal_code.cast("string"), 5, "0"), 1, 2)


def hash_bits(key: Column, seed: int) -> Column:
    """Reproducible hash of a key: the first 32 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _polynomial(coefficients: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    result = np.full(len(x), coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = result * x + c
    return result


def with_normal_quantile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Probabilities become standard normal quantiles, held within +-NORMAL_BOUND at and near 0 and 1."""
    return df.withColumns({c: in_batches(_normal_quantile)(F.col(c)) for c in columns})


def in_batches(function: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of doubles as a function of a column; missing values stay missing.

    Long formulas over several columns go through Arrow batches: as column code they end in one generated method that the JVM
    does not compile, and run many times slower.
    """

    def run(x: pa.Array) -> pa.Array:
        missing = x.is_null().to_numpy(zero_copy_only=False)
        return pa.array(function(x.fill_null(0.0).to_numpy(zero_copy_only=False)), mask=missing)

    return F.arrow_udf(run, "double")


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    # The floor keeps the logarithm's argument positive; values this far out are bounded anyway.
    r = np.sqrt(-np.log(np.maximum(np.where(p < 0.5, p, 1.0 - p), 1e-300)))
    centre, near = np.abs(q) <= 0.425, r <= 5.0
    x = np.where(centre, 0.180625 - q * q, r - np.where(near, 1.6, 5.0))

    def ratio(pair) -> np.ndarray:
        return _polynomial(pair[0], x) / _polynomial(pair[1], x)

    tail = np.sign(q) * np.where(near, ratio(AS241_NEAR_TAIL), ratio(AS241_FAR_TAIL))
    return np.clip(np.where(centre, q * ratio(AS241_CENTRE), tail), -NORMAL_BOUND, NORMAL_BOUND)
