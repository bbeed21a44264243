"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half the hashes of its word shingles have it set. Equal fingerprints are one entry. Two
fingerprints that differ in few bits differ in still fewer inside one of two halves (pigeonhole): with distance d the upper half
differs in d/2 bits at most or the lower one in fewer than the rest. So entries are stored by each half, every fingerprint looks up
the small Hamming ball around its own halves, and what it meets is verified on all 64 bits.

A half that many fingerprints share, as in a large group of near copies, would make pairs with the square of their number. Such
a bucket is not paired: its entries and the lookups that reach it go on to the same step inside the bits that are still free, half
as wide, with the distance that is left. Once the free bits are used up a bucket holds one fingerprint, so a lookup never
meets more than BUCKET entries and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch, as_bytes, small_batches
from estatespark.llm.components import components
from estatespark.session import joinable

WIDTH = 64
# A bucket with more entries is looked up again by finer keys.
BUCKET = 32
# Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int, seed: int) -> int:
    """64 bits of a whole text, A-Z lower-cased. Fewer words than `width` are one shingle; no words give zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    span = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - span + 1]
    pieces = map(plain.__getitem__, map(slice, starts.tolist(), ends[span - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(starts))
    counts = np.zeros(WIDTH, np.int64)
    for first in range(0, len(hashes), BLOCK):
        octets = hashes[first : first + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.array([fingerprint(text, width, seed) for text in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "print"])

    return run


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to `radius` of `width` bits."""
    return [sum(1 << bit for bit in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def half_radii(distance: int) -> tuple[int, int]:
    """How far two halves are searched: strings within `distance` are that near in the upper half or in the lower one."""
    return (distance // 2, distance // 2 - 1) if distance % 2 == 0 else (distance // 2, distance // 2)


def _keyed(df: DataFrame, bits: str, half: int) -> DataFrame:
    """`key`: the bits outside the free ones, which are `half` bits from `low` on."""
    return df.withColumn("key", F.expr(f"{bits} & ~shiftleft({(1 << half) - 1}L, low)"))


def _finer_entries(entries: DataFrame, half: int) -> DataFrame:
    """Each entry twice: with its upper half fixed and the lower one free, and the other way round."""
    lows = F.explode(F.array(F.col("low"), F.col("low") + half))
    return _keyed(entries.select("print", lows.alias("low")), "print", half)


def _finer_lookups(lookups: DataFrame, half: int, distance: int) -> DataFrame:
    """The balls around both halves of the free bits, with the distance left for the other half.

    A pair is looked up from one side: from where the half is smaller, once a ball's bits are flipped (`turned`).
    """

    def side(upper: bool, radius: int, left: int) -> Column:
        # The fixed half begins at `at`; the free half is the other one.
        at, low = ("low + " + str(half), "low") if upper else ("low", "low + " + str(half))
        masks = ", ".join(f"named_struct('mask', {m}L, 'n', {m.bit_count()})" for m in ball(half, radius))
        moved = f"virtual ^ shiftleft(b.mask, {at})"
        ones = (1 << half) - 1
        rises = f"(shiftrightunsigned(virtual, {at}) & {ones}L) < (shiftrightunsigned({moved}, {at}) & {ones}L)"
        chosen = f"filter(array({masks}), b -> b.n = 0 or turned or {rises})"
        child = f"named_struct('low', {low}, 'radius', {left} - b.n, 'virtual', {moved}, 'turned', turned or b.n > 0)"
        return F.expr(f"transform({chosen}, b -> {child})")

    found = None
    for left in range(distance, -1, -1):
        sides = [side(upper, radius, left) for upper, radius in zip((True, False), half_radii(left)) if radius >= 0]
        balls = F.concat(*sides)
        found = F.when(F.col("radius") == left, balls) if found is None else found.when(F.col("radius") == left, balls)
    return _keyed(lookups.select("print", F.inline(found)), "virtual", half)


def _met(lookups: DataFrame, entries: DataFrame, distance: int) -> DataFrame:
    """(u, v) of fingerprints that meet and lie within the distance on all bits."""
    other = entries.select("low", "key", F.col("print").alias("v"))
    met = lookups.select("low", "key", "turned", F.col("print").alias("u")).join(other, ["low", "key"])
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).between(1, distance)
    return met.where(near & (F.col("turned") | (F.col("u") < F.col("v")))).select("u", "v")


def linked_prints(prints: DataFrame, distance: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(u, v) of all pairs of distinct fingerprints (`print`) that differ in 1 to `distance` bits, each pair once or twice."""
    entries = prints.select("print", F.lit(0).alias("low"))
    start = [F.lit(0).alias("low"), F.lit(distance).alias("radius"), F.col("print").alias("virtual"), F.lit(False).alias("turned")]
    lookups, half, parts = prints.select("print", *start), WIDTH, []
    while True:
        half //= 2
        entries, lookups = _finer_entries(entries, half), _finer_lookups(lookups, half, distance)
        sizes = entries.groupBy("low", "key").agg(F.count("*").alias("n"))
        crowded = scratch.write(sizes.where(F.col("n") > bucket).select("low", "key"), "crowded")
        if crowded.isEmpty():
            parts.append(scratch.write(_met(lookups, entries, distance), "links"))
            break
        named = joinable(crowded)
        plain = [df.join(named, ["low", "key"], "left_anti") for df in (lookups, entries)]
        parts.append(scratch.write(_met(*plain, distance), "links"))
        # Only what lies in a crowded bucket goes on.
        entries = scratch.write(entries.join(named, ["low", "key"], "left_semi").select("print", "low"), "entries")
        lookups = lookups.join(named, ["low", "key"], "left_semi").select("print", "low", "radius", "virtual", "turned")
        lookups = scratch.write(lookups, "lookups")
    links = parts[0]
    for part in parts[1:]:
        links = links.union(part)
    return links


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, distance: int = 3, seed: int = 42,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link when they differ in `distance` bits or fewer. Missing, empty and white-space texts have the fingerprint zero
    and link like any other. component_id is the smallest id that links reach, its own included; rows without an id take part and
    get the smallest id they reach, missing if there is none. Repeated rows come out as often as they come in, further
    columns are left out, an empty table gives an empty one.
    """
    if not 0 <= distance < WIDTH or bucket < 2:
        raise ValueError("a distance below 64 and buckets of two at least are needed")
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    members = scratch.write(narrow.mapInArrow(_fingerprints(width, seed), f"id {kind}, print bigint"), "members")
    prints = scratch.write(members.groupBy("print").agg(F.min("id").alias("id")), "prints")
    links = linked_prints(prints.select("print"), distance, scratch, bucket)
    if links.isEmpty():
        groups = prints.select("print", F.col("id").alias("component_id"))
    else:
        stars = components(links, scratch).select(F.col("u").alias("print"), F.col("v").alias("root"))
        rooted = scratch.write(prints.join(stars, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        groups = rooted.join(least, "root").select("print", "component_id")
    groups = scratch.write(groups, "groups")
    scratch.keep_only(members, groups)
    found = members.join(groups, "print")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")
