import collections
import inspect
import math
import random
import re
import warnings

import pytest
from fixtures import LONG, clashing, no_docs, odd_docs
from pyspark.sql import functions as F

from estatespark.llm import mixing
from estatespark.llm.common import Scratch
from estatespark.llm.mixing import rake, sample_documents, unit_hash
from estatespark.llm.quality_rules import apply_rules, binomial_tail, choose_cutoffs, measures

LABELS = "doc_id long, quality int, toxic int"


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_measures_as_plain_python(spark):
    draw = random.Random(0)
    texts = ["".join(draw.choice(["a ", "b ", "c\n", "# ", "\n", "\t", "d|e ", "é ", "😀 "]) for _ in range(draw.randint(0, 120))) for _ in range(60)]
    texts += ["x y z u v " * 3, "x y z u v", "a a a a a a a", "a a a a a", "", None, LONG, "l\nl\n l\n\n\n"]
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "extra")
    rows = {r.doc_id: r for r in measures(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(text), repr(text)[:80]


def test_exact_binomial_tail(spark):
    cases = [(0, 1, 0.1), (0, 500, 0.01), (3, 1000, 0.01), (9, 1000, 0.01), (40, 5000, 0.01), (10, 1000, 0.01), (0, 0, 0.5), (200, 30_000, 0.01), (1999, 250_000, 0.01), (2001, 250_000, 0.01),
             (2400, 250_000, 0.01), (24_500, 2_500_000, 0.01)]
    for k, n, chance in cases:
        found = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), chance).alias("t")).first().t
        if k >= n * chance:
            assert found == 1.0
        else:
            exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(chance) + (n - i) * math.log1p(-chance)) for i in range(k + 1))
            assert abs(found - exact) < 1e-7 * exact + 1e-290


def test_cutoffs_stop_at_the_first_failure(spark):
    candidates = {"s": (0.9, 0.5, 0.1)}
    rows = [("a", 0.05)] * 4000 + [("a", 0.2)] * 400 + [("b", 0.0)] * 20
    good = spark.createDataFrame(rows, "stratum string, s double")
    strata = spark.createDataFrame([("a",), ("b",), ("c",)], "stratum string")
    found = {r.stratum: r.cut_s for r in choose_cutoffs(good, strata, candidates, risk=0.02, error=0.05).collect()}
    assert found == {"a": 0.5, "b": None}


def test_rules_of_odd_rows(spark):
    docs = clashing(odd_docs(spark), "kept", "stratum", "n_words")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 1, 0)], LABELS)
    rows = apply_rules(docs, labels, F.col("quality") == 1, F.col("lang")).collect()
    assert len(rows) == 10 and sum(r.kept for r in rows) == 4 and all(not r.kept for r in rows if r.base_failed)
    assert apply_rules(no_docs(spark), labels, F.col("quality") == 1, F.col("lang")).count() == 0
    assert apply_rules(docs, labels.limit(0), F.col("quality") == 1, F.col("lang")).where("kept").count() == 4


def test_rules_reject_marked_texts(spark):
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(words[i % 20 : i % 20 + 20]) + (" ### ### ### ### ###" * 3 if i >= 3000 else ""), "en") for i in range(3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = apply_rules(docs, labels, F.col("quality") == 1, F.col("lang")).groupBy((F.col("doc_id") < 3000).alias("good"), "kept").count().collect()
    assert {(r.good, r.kept, r["count"]) for r in kept} == {(True, True, 3000), (False, False, 300)}


def test_raking_goes_on_until_it_fits_or_tells(spark):
    schema = "a string, b string, tokens long"
    dependent = spark.createDataFrame([("=x", "=p", 1000), ("=x", "=q", 1), ("=y", "=p", 1), ("=y", "=q", 1000)], schema)
    raked = rake(dependent, {"a": {"x": 0.5, "y": 0.5}, "b": {"p": 0.62, "q": 0.38}}, Scratch(spark, "test")).collect()
    shares = {"=x": 0.5, "=y": 0.5, "=p": 0.62, "=q": 0.38}
    assert all(abs(sum(r.weight for r in raked if k in (r.a, r.b)) / (2002 * share) - 1) < 3e-9 for k, share in shares.items())
    assert not any("Window" in line for line in inspect.getsource(mixing).splitlines())
    one_sided = spark.createDataFrame([("=x", "=p", 1000), ("=y", "=p", 500), ("=y", "=q", 500)], schema)
    with pytest.warns(UserWarning, match="miss the targets by up to 4 of a goal"):
        rake(one_sided, {"a": {"x": 0.9, "y": 0.1}, "b": {"p": 0.5, "q": 0.5}}, Scratch(spark, "test"))


class Sweeps(Scratch):
    """Counts the sweeps by the tables they write."""

    def __init__(self, spark):
        super().__init__(spark, "test")
        self.raked = 0

    def write(self, df, name, codec="snappy"):
        self.raked += name == "raked"
        return super().write(df, name, codec)


def test_raking_ends_where_a_cell_is_pushed_to_zero(spark):
    scratch = Sweeps(spark)
    cells = spark.createDataFrame([("=x", "=p", 100), ("=x", "=q", 100), ("=y", "=p", 100)], "a string, b string, tokens long")
    with pytest.warns(UserWarning, match="miss the targets by up to 0.005"):
        raked = rake(cells, {"a": {"x": 0.5, "y": 0.5}, "b": {"p": 0.5, "q": 0.5}}, scratch).collect()
    assert scratch.raked < 100
    weights = {(r.a, r.b): r.weight for r in raked}
    assert weights["=x", "=p"] < 2 and abs(weights["=y", "=p"] - 150) < 2 and abs(weights["=x", "=q"] - 150) < 2


def test_raking_with_empty_cells(spark):
    draw = random.Random(5)
    cells = [(f"={a}", f"={b}", draw.randint(1, 500)) for a in range(9) for b in range(6) if draw.random() > 0.3]
    scratch = Sweeps(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        raked = rake(spark.createDataFrame(cells, "a string, b string, tokens long"), {"a": 0.5, "b": 0.5}, scratch).collect()
    assert scratch.raked < 100
    for place, key in ((0, "a"), (1, "b")):
        seen, got = collections.Counter(), collections.Counter()
        for cell in cells:
            seen[cell[place]] += cell[2]
        for r in raked:
            got[r[key]] += r.weight
        scale = sum(seen.values()) / sum(v**0.5 for v in seen.values())
        assert all(abs(got[k] / (v**0.5 * scale) - 1) < 1e-8 for k, v in seen.items())


def test_raking_meets_the_margins(spark):
    draw = random.Random(1)
    cells = [(f"={a}", f"={b}", draw.randint(1, 1000)) for a in "xyz" for b in "pq"]
    table = spark.createDataFrame(cells, "a string, b string, tokens long")
    total = sum(c[2] for c in cells)
    raked = rake(table, {"a": {"x": 0.5, "y": 0.3, "z": 0.2}, "b": 1.0}, Scratch(spark, "test")).collect()
    assert abs(sum(r.weight for r in raked if r.a == "=x") - 0.5 * total) < 1e-4
    assert abs(sum(r.weight for r in raked if r.b == "=p") - sum(c[2] for c in cells if c[1] == "=p")) < 1e-4
    # Raking keeps the odds ratios of the cells.
    odds = lambda v: v["=x", "=p"] * v["=y", "=q"] / v["=x", "=q"] / v["=y", "=p"]
    assert abs(odds({(r.a, r.b): r.weight for r in raked}) / odds({(a, b): t for a, b, t in cells}) - 1) < 1e-6


def test_categories_without_a_target_keep_their_share(spark):
    table = spark.createDataFrame([("=x", 300), ("=y", 100), ("-", 100)], "a string, tokens long")
    raked = {r.a: r.weight for r in rake(table, {"a": {"x": 1.0, "y": 1.0, "none": 5.0}}, Scratch(spark, "test")).collect()}
    assert raked == pytest.approx({"=x": 200.0, "=y": 200.0, "-": 100.0})


def test_sample_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("t").alias("text")
    )
    drawn = sample_documents(clashing(docs, "sampled", "row"), {"s": F.col("source")}, F.lit(10), {"s": 0.0}, 0.4)
    rows = drawn.groupBy("source").agg(F.sum(F.col("sampled").cast("int")).alias("n"), F.avg("probability").alias("p"), F.count("*").alias("all")).collect()
    assert abs(sum(r.p * r["all"] for r in rows) - 8000) < 1e-3
    assert all(abs(r.n - r.p * r["all"]) < 5 * math.sqrt(r["all"] * r.p * (1 - r.p) + 1) for r in rows) and all(abs(r.p * r["all"] - 1000) < 1 for r in rows)
    assert drawn.columns == ["doc_id", "source", "text", "row", "probability", "sampled"]


def test_probabilities_stay_below_one(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 5 else "common") for i in range(1000)], "doc_id long, source string")
    rows = sample_documents(docs, {"s": F.col("source")}, F.lit(1), {"s": 0.0}, 0.5).groupBy("source").agg(F.max("probability").alias("p")).collect()
    assert {r.source: round(r.p, 6) for r in rows} == {"rare": 1.0, "common": round(495 / 995, 6)}


def test_mixing_of_odd_rows(spark):
    keys = {"s": F.col("source"), "l": F.col("lang")}
    tokens = F.coalesce(F.length("text"), F.lit(0))
    drawn = sample_documents(odd_docs(spark), keys, tokens, {"s": 1.0, "l": {"en": 1.0}}, 1.0)
    assert drawn.count() == 10 and drawn.where("probability is null or sampled is null").count() == 0
    assert sample_documents(no_docs(spark), keys, tokens, {"s": 1.0, "l": 1.0}, 0.5).count() == 0
    assert spark.range(1000).select(unit_hash(F.col("id"), 3).alias("u")).where("u < 0 or u >= 1").count() == 0
