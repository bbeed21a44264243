"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of a few consecutive words, each hashed to a bucket by the CRC-32 of its bytes. A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus; a document's weight adds up the gains of its features. With
keyed Gumbel noise on top, the highest scores are a draw without replacement in proportion to the weights.

A text is scanned once: its words, joined by one space, go through a running CRC that is stored at both ends of each word. The CRC of
any n-gram follows from two of these prefixes: CRC is linear over GF(2), so the part before the n-gram, shifted over the n-gram's
bytes, cancels out of the CRC up to its end. Longer n-grams cost no further scan.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch, as_bytes, small_batches

# Runs of anything but ASCII letters, digits and bytes above ASCII separate words.
FEATURE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
# Rows of a partition are numbered below this by monotonically_increasing_id.
PARTITION_BITS = 33


def _zero_byte() -> np.ndarray:
    """(4, 256): what a zero byte makes of a register with one byte set; a register is the XOR of its bytes' entries."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(POLYNOMIAL), register >> 1)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([register, *[values << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])


def _applied(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    parts = [table[k][(register >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


class Shifts:
    """Multiplication by x**(8 * length) in GF(2), from tables for lengths that are powers of two."""

    def __init__(self):
        self.tables = [_zero_byte()]

    def __call__(self, registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        shifted = registers.copy()
        for power in range(int(lengths.max(initial=0)).bit_length()):
            if power == len(self.tables):
                self.tables.append(_applied(self.tables[-1], self.tables[-1]))
            chosen = np.flatnonzero((lengths >> power) & 1)
            shifted[chosen] = _applied(self.tables[power], shifted[chosen])
        return shifted


class WordGrams:
    """CRCs of all word n-grams of a text, repeats included, by increasing n."""

    def __init__(self, least: int, most: int):
        if not 1 <= least <= most:
            raise ValueError("n-grams have one word at least")
        self.sizes, self.shifts = range(least, most + 1), Shifts()

    def __call__(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """(number of words, CRCs)."""
        words = FEATURE_WORD.findall((text or b"").lower())
        if not words:
            return 0, np.empty(0, np.uint32)
        crc, run, before, behind = zlib.crc32, 0, [], []
        for word in words:
            before.append(run)
            run = crc(word, run)
            behind.append(run)
            run = crc(b" ", run)
        starts, ends = np.array(before, np.uint32), np.array(behind, np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths + 1)
        first = last - lengths
        found = []
        for size in self.sizes:
            n = len(words) - size + 1
            if n > 0:
                found.append(ends[size - 1 :] ^ self.shifts(starts[:n], last[size - 1 :] - first[:n]))
        return len(words), np.concatenate(found) if found else np.empty(0, np.uint32)


def _bucket_sums(least: int, most: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        grams, total = WordGrams(least, most), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                _, codes = grams(text)
                total += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_column: str, sizes: tuple[int, int], buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. Tasks send sums, so `buckets` numbers come to the driver for any corpus."""
    sums = docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(_bucket_sums(*sizes, buckets), "bucket bigint, n bigint")
    found = sums.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    size, whole, wanted = len(source), int(source.sum()), int(target.sum())
    ratios = ((t + 1) * (whole + size) / ((s + 1) * (wanted + size)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weights(least: int, most: int, gains) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        grams, gain = WordGrams(least, most), gains.value
        for batch in batches:
            words, features, weights = [], [], []
            for text in as_bytes(batch.column(1)):
                n, codes = grams(text)
                words.append(n)
                features.append(len(codes))
                weights.append(int(gain[codes % np.uint32(len(gain))].sum()))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in (words, features, weights)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    return run


def gumbel_noise(identifier: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel number, rounded down, that depends on the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("bigint")


def _ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` with their rank by score, highest first, then by id.

    Rows are dealt to ranges and numbered inside them; a range's first rank follows from the sizes of the ranges before. The
    row's own number, last in the order, spreads rows that are alike in everything else.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    dealt = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    part = F.shiftright("place", PARTITION_BITS)
    placed = scratch.write(dealt.drop("row").withColumn("place", place).withColumn("part", part), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    firsts, total = [], 0
    for row in sizes:
        firsts.append((row["part"], total))
        total += row["n"]
    # One row a partition.
    before = F.broadcast(spark.createDataFrame(firsts, "part bigint, before bigint"))
    inside = F.col("place").bitwiseAND((1 << PARTITION_BITS) - 1)
    return placed.join(before, "part").withColumn("rank", F.col("before") + inside + 1).drop("part", "before", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    sizes: tuple[int, int] = (1, 2),
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of `docs`; the drawn ones have a rank.

    Of the rows with `least_words` words, `percent` per cent are drawn (rounded down), the highest scores first, equal ones by id. Missing
    and empty texts have no features and weight 0. Rows without an id share one noise and come first among equal scores.
    Repeated rows count, and are drawn, as often as they come. Without target texts all gains follow the corpus alone.
    Further columns of both tables are left out, whatever their names.
    """
    small_batches(docs.sparkSession)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    source = bucket_counts(docs, text_column, sizes, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(source, bucket_counts(target, target_text, sizes, buckets)))
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    weighed = narrow.mapInArrow(_weights(*sizes, gains), f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed)), "scored")
    gains.destroy()
    able = F.col("n_words") >= least_words
    ranked = _ranked(scored.where(able), scratch)
    drawn = scored.where(able).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_column)
