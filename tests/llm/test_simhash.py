import collections
import random

import pytest
import xxhash
from fixtures import clashing, near_copies, no_docs, odd_rows
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch
from estatespark.llm.simhash_join import ball, fingerprint, half_radii, linked_prints, simhash_components


MASK = (1 << 64) - 1


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows, width, distance):
    """(id, fingerprint, smallest id of the component) of each row."""
    prints = [plain_fingerprint(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (identifier, _) in enumerate(rows):
        if identifier is not None:
            ids[root(i)].append(identifier)
    return collections.Counter((identifier, f"{prints[i]:016x}", min(ids[root(i)], default=None)) for i, (identifier, _) in enumerate(rows))


@pytest.mark.parametrize("width", [1, 3, 5])
def test_fingerprints(width):
    texts = [text for _, text, *_ in odd_rows()] + [text for _, text in near_copies(3)] + ["a", "a B", "a b a", "x " * 70_000]
    for text in texts:
        assert fingerprint((text or "").encode(), width, 42) == plain_fingerprint(text, width)


def test_halves_find_everything_near():
    for distance in range(6):
        upper, lower = half_radii(distance)
        for flipped in range(distance + 1):
            # However the flipped bits fall on the halves, one of the balls holds its half.
            assert all(up <= upper or flipped - up <= lower for up in range(flipped + 1))
    assert len(ball(32, 1)) == 33 and len(set(ball(8, 2))) == 37


def crowd(seed, centres, around, flips):
    draw = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(around):
            out.add(centre ^ sum(1 << bit for bit in draw.sample(range(64), draw.randint(0, flips))))
    return sorted(out)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("bucket", [2, 1000])
def test_every_near_pair_is_linked(spark, distance, bucket):
    prints = crowd(distance, 4, 25, 2)
    # A dense corner: all of these agree on the upper half.
    prints = sorted({*prints, *range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {frozenset((r.u, r.v)) for r in linked_prints(frame, distance, Scratch(spark, "test"), bucket).collect()}
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & MASK).bit_count() <= distance}


@pytest.mark.parametrize("distance,bucket", [(2, 32), (2, 2), (6, 8)])
def test_same_as_plain(spark, distance, bucket):
    rows = near_copies(4) + [(9000 + i, r[1]) for i, r in enumerate(odd_rows())] + [(None, "a lonely text"), (None, near_copies(4)[0][1])]
    rows += [rows[0], rows[0]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "id", "print", "key", "low", "component_id").repartition(4)
    found = simhash_components(docs, width=3, distance=distance, bucket=bucket).collect()
    assert collections.Counter(map(tuple, found)) == plain_components(rows, 3, distance)


def test_hot_texts_and_no_documents(spark):
    assert simhash_components(no_docs(spark)).count() == 0
    text = F.when(F.col("id") % 3 == 0, F.lit("the same words again and again")).otherwise(F.concat(F.lit("number "), F.col("id"), F.lit(" of many texts")))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = simhash_components(docs, distance=1).groupBy("component_id").count().orderBy(F.desc("count")).collect()
    assert rows[0].component_id == 0 and rows[0]["count"] >= 667
