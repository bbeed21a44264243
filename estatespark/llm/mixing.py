"""Mixing sources to target weights by iterative proportional fitting, and sampling by the calibrated probabilities.

Documents are counted in cells, one for each combination of categories that occurs. Raking scales the cells' token weights to one
marginal after the other until all fit. A document's probability is proportional to weight / tokens of its cell, scaled so that the
expected number of tokens is the budget; probabilities that would pass one stay at one and the others take over their share.
A document is drawn when the hash of its id falls below its probability, so the sample is the same on every run.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch
from estatespark.session import BroadcastBudget, joinable, value_bytes

TOLERANCE = 1e-9
#: Raking ends without a fit when the gap has stayed within this share of itself for so many sweeps: nothing meets the targets.
STALLED_SWEEPS, LEAST_MOVE = 10, 1e-4
#: It ends as well when the share that FALL_SWEEPS sweeps take off the gap falls by SLOWING or more whenever the sweeps double, twice in
#: a row: the targets push a cell to zero, and the gap goes with one over the sweeps. A slow fit keeps its share.
FALL_SWEEPS, SLOWING, SLOW_FROM = 8, 0.7, 96
HEX_DIGITS = 13
Target = Mapping[str, float] | float


def _key(column: Column) -> Column:
    """A category as text; a missing one is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _goals(cells: DataFrame, key: str, target: Target) -> DataFrame:
    """(key, goal): tokens that each category should have. They add up to all tokens.

    A number is an exponent: shares go with the observed tokens to that power. Named shares are scaled to what the
    categories without a name leave over; these keep the share they have.
    """
    observed = cells.groupBy(key).agg(F.sum("tokens").alias("seen"))
    spark = cells.sparkSession
    if not isinstance(target, Mapping):
        powered = observed.withColumn("wish", F.pow("seen", F.lit(float(target))))
        named, left = powered, F.lit(0.0)
    else:
        if any(share <= 0 for share in target.values()):
            raise ValueError("shares are positive")
        shares = spark.createDataFrame([("=" + str(c), float(s)) for c, s in target.items()], f"{key} string, wish double")
        named = observed.join(F.broadcast(shares), key, "left")
        left = F.coalesce(F.sum(F.when(F.col("wish").isNull(), F.col("seen"))), F.lit(0.0))
    total = named.agg(F.sum("seen").alias("seen"), F.sum("wish").alias("wish"), left.cast("double").alias("unnamed")).first()
    seen, wish, unnamed = total["seen"] or 0.0, total["wish"] or 1.0, total["unnamed"] or 0.0
    goal = F.coalesce(F.col("wish") / F.lit(wish) * F.lit(seen - unnamed), F.col("seen").cast("double"))
    return named.select(key, goal.alias(f"{key}_goal"))


def _ends(gaps: list[float]) -> bool:
    """Whether further sweeps are in vain, given the gap after each one."""
    last = gaps[-STALLED_SWEEPS:]
    if len(last) == STALLED_SWEEPS and max(last) - min(last) <= LEAST_MOVE * max(last):
        return True
    if len(gaps) < SLOW_FROM:
        return False

    def fall(sweeps: int) -> float:
        return 1.0 - gaps[sweeps - 1] / gaps[sweeps - 1 - FALL_SWEEPS]

    return all(fall(len(gaps) >> k) < SLOWING * fall(len(gaps) >> (k + 1)) for k in (0, 1))


def rake(cells: DataFrame, targets: Mapping[str, Target], scratch: Scratch) -> DataFrame:
    """`cells` (keys, tokens) with `weight`: tokens raked to the targets of each key. Cells without tokens have weight 0.

    Sweeps go on until the largest relative gap is below TOLERANCE. Targets that these cells meet only with weights of zero, or not at
    all, leave a gap that hardly falls any more; then raking ends and a warning tells the gap reached.
    """
    weighed, sizes = cells.withColumn("weight", F.col("tokens").cast("double")), {}
    for key, target in targets.items():
        goals = scratch.write(_goals(cells, key, target), "goals")
        # A sweep's sums have the same keys and one number each.
        sizes[key] = goals.agg(F.sum(value_bytes(goals))).first()[0] or 0
        weighed = weighed.join(joinable(goals, sizes[key]), key)
    weighed = scratch.write(weighed, "raked")
    gaps: list[float] = []
    while True:
        swept, gap, sums, budget = weighed.drop("gap"), F.lit(0.0), [], BroadcastBudget()
        for key in targets:
            # Partial sums meet, so a key may have any share of the cells.
            sums.append(scratch.write(swept.groupBy(key).agg(F.sum("weight").alias(f"{key}_sum")), "sums"))
            swept = swept.join(joinable(sums[-1], sizes[key], budget), key)
            scale = F.when(F.col(f"{key}_sum") > 0, F.col(f"{key}_goal") / F.col(f"{key}_sum")).otherwise(1.0)
            swept = swept.withColumn(f"{key}_scale", scale).withColumn("weight", F.col("weight") * F.col(f"{key}_scale"))
            gap = F.greatest(gap, F.abs(F.col(f"{key}_scale") - 1.0))
        helpers = [f"{key}_{part}" for key in targets for part in ("sum", "scale")]
        following = scratch.write(swept.withColumn("gap", gap).drop(*helpers), "raked")
        scratch.drop(weighed, *sums)
        weighed = following
        gaps.append(weighed.agg(F.max("gap")).first()[0] or 0.0)
        if gaps[-1] < TOLERANCE:
            break
        if _ends(gaps):
            warnings.warn(f"weights miss the targets by up to {gaps[-1]:.3g} of a goal after {len(gaps)} sweeps", stacklevel=2)
            break
    return weighed.drop("gap", *[f"{key}_goal" for key in targets])


def _scaled(raked: DataFrame, budget: float) -> float:
    """The factor at which the expected tokens reach the budget, with no probability above one."""
    everything = raked.agg(F.sum("tokens")).first()[0] or 0
    wanted, factor = budget * everything, 0.0
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    while True:
        full = ratio * F.lit(factor) >= 1.0
        row = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        # Each turn fills at least one cell more, or ends.
        following = (wanted - float(row["full"] or 0)) / row["open"] if row["open"] else factor
        if following <= factor * (1 + 1e-12):
            return factor
        factor = following


def unit_hash(identifier: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), identifier.cast("string"))), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def sampling_probabilities(
    docs: DataFrame, keys: Mapping[str, Column], tokens: Column, targets: Mapping[str, Target], budget: float
) -> tuple[DataFrame, Scratch]:
    """(cells with their keys as text, tokens, weight, probability), and the run's tables."""
    if not 0 < budget <= 1 or set(keys) != set(targets):
        raise ValueError("budget is a share of the tokens, and every key needs a target")
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = docs.select(*[_key(c).alias(k) for k, c in keys.items()], F.greatest(tokens, F.lit(0)).cast("bigint").alias("tokens"))
    cells = scratch.write(counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, scratch)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    chance = F.least(F.lit(1.0), ratio * F.lit(_scaled(raked, budget)))
    # Cells without tokens cost nothing and stay.
    chance = F.when(F.col("tokens") > 0, chance).otherwise(1.0)
    return scratch.write(raked.withColumn("probability", chance), "probabilities"), scratch


def sample_documents(
    docs: DataFrame,
    keys: Mapping[str, Column],
    tokens: Column,
    targets: Mapping[str, Target],
    budget: float,
    id_column: str = "doc_id",
    seed: int = 0,
    names: tuple[str, str] = ("probability", "sampled"),
) -> DataFrame:
    """`docs` with the probability of each row and whether it is drawn.

    A row's missing category is a category. Rows of the same id are drawn together or not at all; rows without an id share one
    draw. Rows whose cell has no tokens are kept. Columns of `docs` with the output's names are replaced.
    """
    cells, scratch = sampling_probabilities(docs, keys, tokens, targets, budget)
    kept = [c for c in docs.columns if c not in names]
    own = [_key(c).alias(f"key_{i}") for i, c in enumerate(keys.values())]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *own, unit_hash(F.col(f"`{id_column}`"), seed).alias("draw"))
    chances = cells.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], "probability")
    scratch.keep_only(cells)
    # Wide rows stay where they are while the cells are few; beyond the checked size both sides are shuffled.
    joined = packed.join(joinable(chances), [f"key_{i}" for i in range(len(keys))], "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("probability").alias(names[0]),
        (F.col("draw") < F.col("probability")).alias(names[1]),
    )
