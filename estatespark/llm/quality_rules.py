"""Quality rules with risk-controlled thresholds, in Column expressions only.

A rule rejects texts whose statistic reaches a cutoff. Cutoffs are chosen per stratum on a labelled holdout: for each rule the
candidates are tested from the mildest on, and a candidate passes when the exact binomial tail P(Bin(n, a) <= k) is small, n being
the stratum's good texts and k those it would reject. The strictest candidate before the first failure is taken. Testing in a fixed
order needs no correction along the candidates; over strata and rules the error is divided by their number (Bonferroni). The share a
is the limit divided by the number of rules, so with the given confidence no stratum loses more than the limit of its good texts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatespark.llm.common import SPACE, WORD, Scratch
from estatespark.session import joinable

WINDOW = 5
LEAST_WORDS = 10
SYMBOLS = "[#*$%&|<>]"
#: Candidate cutoffs of each statistic, mildest first. They are set beforehand, not by the data.
CANDIDATES = {
    "symbol_share": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_share": (0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}
RISK, ERROR = 0.02, 0.05
# Steps of the continued fraction: so many, and so many times the square root of the number of rows.
LEAST_STEPS, STEPS_OF_ROOT, TINY = 40, 2, 1e-300
LEAST_CHANCE = 1e-300


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with the base measures and the statistics of the rules, over whole texts. No shuffle.

    Missing texts have no words. A window of five words that occurs twice or more in a text counts all its words, each
    word once.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    step = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)))
    count = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    windows = F.arrays_zip(*[F.slice("_words", i + 1, count) for i in range(WINDOW)])
    step = step.withColumn("_windows", F.transform(windows, lambda w: F.xxhash64(w)))
    kept = [c for c in docs.columns if c != text_column]
    step = step.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Few texts repeat a window; only theirs are sorted.
        F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.col("_windows")).alias("_windows"),
    )
    step = step.withColumn("_sorted", F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    around = F.arrays_zip(
        F.col("_sorted").alias("own"),
        F.concat(F.slice("_sorted", 1, 1), F.col("_sorted")).alias("before"),
        F.concat(F.slice("_sorted", 2, F.size("_sorted")), F.slice("_sorted", -1, 1)).alias("after"),
    )
    step = step.withColumn("_around", F.when(F.col("_windows").isNotNull(), around))

    def repeated(x: Column) -> Column:
        def same(other: str) -> Column:
            return (x["own"]["w"] == x[other]["w"]) & (x["own"]["i"] != x[other]["i"])

        return x["own"].isNotNull() & (same("before") | same("after"))

    places = F.array_sort(F.transform(F.filter("_around", repeated), lambda x: x["own"]["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda s, i: F.struct(i.alias("last"), (s["words"] + F.least(F.lit(WINDOW), i - s["last"])).alias("words")),
        lambda s: s["words"],
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_around")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return step.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
            "symbol_share": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
        }
    )


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: Stirling's series sixteen steps up, and the steps back."""
    z = n.cast("double") + 1.0
    up, product = z + 16.0, z
    for i in range(1, 16):
        product = product * (z + float(i))
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * up)
    series = series - 1.0 / (360.0 * F.pow(up, 3)) + 1.0 / (1260.0 * F.pow(up, 5))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, chance: float) -> Column:
    """P(Bin(n, chance) <= k); 1 where k is at or above the mean, as no such k can pass a test.

    The tail is the incomplete beta function at 1 - chance with n - k and k + 1, by its continued fraction, evaluated by steps
    forward. Below the mean the fraction converges within about the square root of the larger number of steps.
    """
    a, b, x = (n - k).cast("double"), (k + 1).cast("double"), 1.0 - chance
    log_front = _log_factorial(n) - _log_factorial(n - k - 1) - _log_factorial(k) + a * math.log(x) + b * math.log(chance)

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < TINY, F.lit(TINY)).otherwise(value)

    # The fraction's value and its two running quotients.
    first = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    state = F.struct(first.alias("value"), F.lit(1.0).alias("c"), first.alias("d"))

    def stepped(s: Column, factor: Column) -> Column:
        c, d = safe(1.0 + factor / s["c"]), 1.0 / safe(1.0 + factor * s["d"])
        return F.struct((s["value"] * c * d).alias("value"), c.alias("c"), d.alias("d"))

    def even(s: Column, m: Column) -> Column:
        return stepped(s, m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)))

    def odd(s: Column, m: Column) -> Column:
        return stepped(s, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0)))

    # The terms are taken in order: 2 m for the m-th even one, 2 m + 1 for the odd one behind it.
    steps = F.sequence(F.lit(2), (2 * (LEAST_STEPS + STEPS_OF_ROOT * F.ceil(F.sqrt(a + b)))).cast("int") + 1)
    folded = F.aggregate(steps, state, lambda s, i: F.when(i % 2 == 0, even(s, F.floor(i / 2).cast("double"))).otherwise(odd(s, F.floor(i / 2).cast("double"))))
    value = F.greatest(F.exp(log_front) * folded["value"] / a, F.lit(LEAST_CHANCE))
    return F.when(k.cast("double") >= n * chance, F.lit(1.0)).otherwise(F.least(value, F.lit(1.0)))


def choose_cutoffs(
    good: DataFrame, strata: DataFrame, candidates: Mapping[str, Sequence[float]] = CANDIDATES, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """(stratum, one column per statistic): the cutoffs, missing where no candidate passes and the rule must not reject.

    `good` holds the statistics and `stratum` of the holdout's good texts; `strata` all strata there are. The counts combine before the
    shuffle; what is tested is a row per stratum, rule and candidate.
    """
    rules = list(candidates)
    tested = [(r, i, c) for r in rules for i, c in enumerate(candidates[r])]
    sums = [F.sum((F.col(r) >= c).cast("long")).alias(f"k_{r}_{i}") for r, i, c in tested]
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *sums)

    def row(r: str, i: int, c: float) -> Column:
        return F.struct(F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{i}").alias("k"))

    table = counts.select("stratum", "n", F.inline(F.array(*[row(*t) for t in tested])))
    table = table.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk / len(rules)))
    passed = F.col("tail") <= error / max(1, strata.count() * len(rules))
    order = Window.partitionBy("stratum", "rule").orderBy("place")
    table = table.withColumn("open", F.min(passed.cast("int")).over(order))
    chosen = [F.min(F.when((F.col("open") == 1) & (F.col("rule") == r), F.col("cutoff"))).alias(f"cut_{r}") for r in rules]
    return table.groupBy("stratum").agg(*chosen)


def apply_rules(
    docs: DataFrame, labels: DataFrame, good: Column, stratum: Column, id_column: str = "doc_id", text_column: str = "text",
    risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """One row per document: id, the base measures, base_failed, kept.

    `good` says of a row of `labels` whether the text is good; `stratum` is a column of `docs`, and texts without one are a stratum of
    their own. Strata without enough good texts reject nothing but what fails the base rules. Labels of unknown documents and
    repeated labels count as often as they match.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    named = F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("-"))
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), named.alias("stratum"), F.col(f"`{text_column}`").alias("text"))
    measured = scratch.write(measures(narrow), "measures")
    holdout = labels.where(good).select(F.col(f"`{id_column}`").alias("id")).join(measured, "id").where(~F.col("base_failed"))
    cutoffs = scratch.write(choose_cutoffs(holdout, measured.select("stratum").distinct(), CANDIDATES, risk, error), "cutoffs")
    joined = measured.join(joinable(cutoffs), "stratum", "left")
    rejected = F.lit(False)
    for rule in CANDIDATES:
        rejected = rejected | F.coalesce(F.col(rule) >= F.col(f"cut_{rule}"), F.lit(False))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(F.col("id").alias(id_column), *base, (~F.col("base_failed") & ~rejected).alias("kept"))
