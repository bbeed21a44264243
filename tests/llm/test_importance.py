import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from fixtures import clashing, no_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from estatespark.llm.importance import Shifts, WordGrams, bucket_gains, resample

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, sizes):
    words = WORDS.findall((text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2), (4, 6)])
def test_crc_of_every_gram_from_two_prefixes(sizes):
    texts = [text for _, text, *_ in odd_rows()] + [" ".join(prose(i, i)) for i in range(30)] + ["a" * 70_000 + "!b", "É,Ü--x9", "  a"]
    grams = WordGrams(*sizes)
    for text in texts:
        words, codes = grams((text or "").encode())
        assert (words, codes.tolist()) == plain_features(text, sizes)


def test_shift_appends_zero_bytes():
    lengths = np.array([0, 1, 2, 3, 255, 256, 1000, 65_537])
    crcs = np.arange(1, 9, dtype=np.uint32) * np.uint32(0x1234567)
    for crc, length, shifted in zip(crcs.tolist(), lengths.tolist(), Shifts()(crcs, lengths).tolist()):
        # zlib's CRC of zero bytes alone cancels the conditioning.
        assert shifted == zlib.crc32(b"\0" * length, crc) ^ zlib.crc32(b"\0" * length)


def test_gains_go_down():
    assert bucket_gains(np.array([0, 9]), np.array([3, 0])).tolist() == [
        math.floor(1000 * math.log(4 * 11 / (1 * 5))), math.floor(1000 * math.log(1 * 11 / (10 * 5)))]


def plain_resample(rows, target, percent, sizes, buckets, least, seed):
    source, wanted = collections.Counter(), collections.Counter()
    for _, text in rows:
        source.update(c % buckets for c in plain_features(text, sizes)[1])
    for text in target:
        wanted.update(c % buckets for c in plain_features(text, sizes)[1])
    all_s, all_t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (all_s + buckets) / ((source[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for identifier, text in rows:
        words, features = plain_features(text, sizes)
        weight = sum(gain[c % buckets] for c in features)
        name = "" if identifier is None else str(identifier)
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        out.append([identifier, words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2)])
def test_same_as_plain(spark, sizes):
    rows = [(i, " ".join(prose(i, 5 + i % 60))) for i in range(300)] + [(r[0], r[1]) for r in odd_rows()]
    rows += [(7000, rows[50][1])] * 5
    target = [" ".join(prose(i, 40, 60)) for i in range(20)] + [None, ""]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "id", "rank", "score", "part", "place", "row", "n").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample(docs, goal, 20, sizes, 97, 15, seed=3).collect()
    assert collections.Counter(map(tuple, found)) == plain_resample(rows, target, 20, sizes, 97, 15, 3)


def test_draws_what_is_like_the_target(spark):
    rows = [(i, " ".join(prose(i, 60, 60) if i % 4 == 0 else [f"z{w}" for w in prose(i, 60, 60)])) for i in range(400)]
    goal = spark.createDataFrame([(" ".join(prose(9000 + i, 60, 60)),) for i in range(50)], "text string")
    drawn = resample(spark.createDataFrame(rows, "doc_id long, text string"), goal, 25).where("rank is not null")
    assert drawn.count() == 100 and drawn.where("doc_id % 4 = 0").count() > 90


def test_empty_tables(spark):
    assert resample(no_docs(spark), no_docs(spark)).count() == 0
    assert resample(odd_docs(spark), no_docs(spark), 50, least_words=10).where("rank is not null").count() == 2
    alike = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("one two three").alias("text"))
    ranks = resample(alike, alike, 100, least_words=1).select("rank").collect()
    assert sorted(r.rank for r in ranks) == list(range(1, 501))
