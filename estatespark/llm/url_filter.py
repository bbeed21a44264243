"""URL filter: listed rules first, then naive Bayes over the words of the host and the tokens of the path.

Host names are runs of letters that often hold several words. A unigram model of word counts splits each distinct name by Viterbi's
algorithm into its most probable words; a run that is no known word costs more the longer it is. The counts come from page
texts, where words stand apart, and from the hyphenated parts of hosts and paths. Substrings of the distinct names are joined with
the counts, so the dictionary is never broadcast and may grow with the corpus; long words are met by their first letters.

Multinomial naive Bayes then adds up one weight per token. Tokens are hashed to 2**BITS weights, which bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch, lower_ascii

BITS = 18
# Words of up to so many letters are looked up whole, longer ones by this many and then compared.
SPAN = 20
PARTS = r"://([^/?#]*)([^?#]*)"
#: Words that mark a page for the weak labels that the classifier is fitted on.
BLOCKED_WORDS = ("adult", "bets", "betting", "casino", "cheap", "gambling", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a missing url or one without '://'."""
    return (
        lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))),
        F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")),
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z]+"), lambda w: F.length(w) > 0)


def _path_tokens(path: Column) -> Column:
    """Runs of letters and digits; a number stands for all numbers."""
    parts = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: F.length(t) > 0)
    return F.transform(parts, lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(t))


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) of the words a-z of the texts, markup left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "<[^>]*>", " "))
    return texts.select(F.explode(_words(plain)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def best_split(size: int, known: dict[tuple[int, int], float], total: float) -> list[tuple[int, int]]:
    """(start, length) of the words of a name of `size` letters; `known` has the counts of its substrings that are words."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, length), n in sorted(known.items()):
        ending.setdefault(start + length, []).append((start, n))
    score, back = [0.0] * (size + 1), [0] * (size + 1)
    # An unknown run counts as a tenth of a word for each letter, so where the best one begins does not depend on its end.
    run_start, run_score, unknown = 0, 0.0, 1.0 - math.log10(total)
    for end in range(1, size + 1):
        if score[end - 1] + end - 1 > run_score:
            run_start, run_score = end - 1, score[end - 1] + end - 1
        score[end], back[end] = run_score + unknown - end, run_start
        for start, n in ending.get(end, ()):
            chance = math.log10(n / total)
            if score[start] + chance > score[end]:
                score[end], back[end] = score[start] + chance, start
    pieces, end = [], size
    while end:
        pieces.append((back[end], end - back[end]))
        end = back[end]
    return pieces[::-1]


def segment_names(names: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, words) of distinct names. `counts` is (word, n)."""
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 10.0
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    longest = F.least(F.lit(SPAN), F.length("name") - F.col("start") + 1)
    spans = starts.select("name", "start", F.explode(F.sequence(F.lit(1), longest)).alias("length"))
    spans = spans.withColumn("head", F.expr("substring(name, start, length)"))
    # SPAN spans per letter at most; a long word is met by the span of its first letters.
    met = spans.join(counts.select("word", "n", F.left("word", F.lit(SPAN)).alias("head")), "head")
    met = met.where(F.expr("substring(name, start, length(word)) = word")).withColumn("length", F.length("word"))
    found = met.groupBy("name").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            given, split = batch.column(0).to_pylist(), []
            for name, spans in zip(given, batch.column(1).to_pylist()):
                known = {(s["start"], s["length"]): s["n"] for s in spans or ()}
                split.append([name[start : start + length] for start, length in best_split(len(name), known, total)])
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.string()), pa.array(split, pa.list_(pa.string()))], names=["name", "words"])

    return scratch.write(names.join(found, "name", "left").mapInArrow(run, "name string, words array<string>"), "segments")


def host_words(hosts: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, words) of distinct hosts: their letter runs, each split into words."""
    parts = hosts.select("host", F.posexplode(F.filter(F.split("host", "[^a-z]+"), lambda p: F.length(p) > 0)).alias("place", "name"))
    parts = scratch.write(parts, "names")
    segments = segment_names(parts.select("name").distinct(), counts, scratch)
    placed = parts.join(segments, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("placed"))
    return scratch.write(placed.select("host", F.flatten(F.transform("placed", lambda p: p["words"])).alias("words")), "host-words")


def _slots(words: Column, path: Column) -> Column:
    tokens = F.concat(
        F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(_path_tokens(path), lambda t: F.concat(F.lit("p:"), t)),
    )
    return F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND((1 << BITS) - 1).cast("int"))


def fit_weights(urls: DataFrame, label: Column) -> tuple[np.ndarray, float]:
    """Weight of each slot and the prior, from `slots` of all rows; `label` is true for pages to block.

    A class without a token is taken to have it as often as all pages do, with a weight of one page per known slot.
    """
    rows = urls.select("slots", label.cast("long").alias("label"))
    blocked, allowed = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    # Counts combine before the shuffle; 2**BITS rows at most come to the driver.
    counts = rows.select(F.explode("slots").alias("slot"), "label").groupBy("slot")
    counts = counts.agg(F.sum("label").alias("block"), F.sum(1 - F.col("label")).alias("allow")).toArrow()
    weights = np.zeros(1 << BITS)
    if counts.num_rows:
        slot = counts.column("slot").to_numpy()
        block, allow = (counts.column(c).to_numpy().astype(np.float64) for c in ("block", "allow"))
        mass = float(len(slot))
        share = (block + allow) / (block + allow).sum()
        weights[slot] = np.log((block + mass * share) / (block.sum() + mass)) - np.log((allow + mass * share) / (allow.sum() + mass))
    return weights, math.log((blocked + 1.0) / (allowed + 1.0))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else missing. A rule fits its host and all hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    blocked_words: Sequence[str] = BLOCKED_WORDS,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score (log odds; above 0 is block where no rule fits).

    Pages of blocked words are the weak labels. A url without host and path tokens, missing ones too, has the score of the prior.
    Repeated rows come out as often as they come in. `rules` are (text, verdict) pairs such as ("net/es/", "block").
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col(f"`{url_column}`"))
    located = scratch.write(pages.select(F.col(f"`{id_column}`").alias("id"), host.alias("host"), path.alias("path")), "located")
    hosts = located.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    hosts = scratch.write(hosts, "hosts")
    spoken = word_counts(pages, html_column)
    # Parts that hyphens set apart are words by their author's hand, as are path words.
    hyphened = hosts.select(F.explode(F.filter(F.split("host", "[.]"), lambda p: p.contains("-"))).alias("part"), "n")
    hyphened = hyphened.select(F.explode(_words(F.col("part"))).alias("word"), "n")
    written = located.select(F.explode(_words(F.lower("path"))).alias("word"), F.lit(1).cast("bigint").alias("n"))
    seeds = spark.createDataFrame([(w, 1) for w in blocked_words], "word string, n bigint")
    counts = spoken.union(hyphened).union(written).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "words")
    words = host_words(hosts.select("host"), counts, scratch)
    # One row per host on one side: a hot host's pages are split over tasks at run time.
    joined = located.join(words, "host", "left")
    listed = F.array(*[F.lit(w) for w in blocked_words])
    marked = F.arrays_overlap(F.concat(F.coalesce("words", F.array().cast("array<string>")), _path_tokens(F.col("path"))), listed)
    slots = _slots(F.col("words"), F.col("path"))
    featured = scratch.write(joined.select("id", "host", "path", slots.alias("slots"), marked.alias("marked")), "featured")
    weights, prior = fit_weights(featured, F.col("marked"))
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            totals = [prior + float(shared.value[slots].sum()) for slots in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(totals, pa.float64())], names=["id", "host", "path", "score"])

    kind = featured.schema["id"].dataType.simpleString()
    scored = featured.select("id", "host", "path", "slots").mapInArrow(score, f"id {kind}, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scratch.keep_only(featured)
    return scored.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("score").alias("block_score"),
    )
