import collections
import hashlib
import random

import pytest
from fixtures import DOCS, LONG, clashing, near_copies, no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from estatespark.llm import jaccard_join
from estatespark.llm.common import Scratch
from estatespark.llm.components import components
from estatespark.llm.exact_dedup import PatriciaTrie, common_length, drop_copies, mark_copies
from estatespark.llm.jaccard_join import jaccard_components


def test_trie_keeps_strings_apart():
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcabc", b"\x00", b"ab" * 5000, b"ab" * 5000 + b"x"]
    trie = PatriciaTrie()
    for turn in range(2):
        for i, key in enumerate(keys):
            node = trie.terminal(key)
            assert (node.owner is None) == (turn == 0)
            node.owner = i
    assert sorted(trie.drain()) == sorted((k, i) for i, k in enumerate(keys))
    assert list(trie.drain()) == [] and trie.bytes == 0


def test_common_length():
    for a, b, n in ((b"", b"x", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"x" * 999 + b"y", b"x" * 1000, 999), (b"ba", b"aa", 0)):
        assert common_length(a, b) == n == common_length(b, a)


def expected_marks(rows, largest):
    groups = collections.defaultdict(list)
    for identifier, text, *_ in rows:
        groups[(text or "").encode().lower()].append(identifier)
    out = collections.Counter()
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        for i in ids:
            out[(i, keep, len(ids), hashlib.sha256(key).hexdigest())] += 1
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("trie_bytes", [1, 48 << 20])
def test_marks_of_odd_rows(spark, keep, trie_bytes):
    docs = clashing(odd_docs(spark), "keep_id", "kept", "row", "owner_row").repartition(3)
    rows = mark_copies(docs, keep=keep, trie_bytes=trie_bytes).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == expected_marks(odd_rows(), keep == "largest")
    # One row of each group stays, also of repeated rows.
    assert collections.Counter(r.text_sha256 for r in rows if r.kept) == collections.Counter({r.text_sha256: 1 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_rows_that_stay_are_whole(spark):
    docs = clashing(odd_docs(spark), "row", "id", "rest").repartition(4)
    kept = drop_copies(docs)
    assert kept.dtypes == docs.dtypes
    found = {r.doc_id: r for r in kept.collect()}
    assert set(found) == {1, 3, 6, 7, 5} and found[1].text.startswith("The quick") and found[6].text == LONG and found[1].lang == "en"


def test_no_documents(spark):
    assert mark_copies(no_docs(spark)).count() == 0 and drop_copies(no_docs(spark)).count() == 0
    assert jaccard_components(no_docs(spark)).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    rows = mark_copies(docs.repartition(7), keep="largest").groupBy("group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r.group_size, r.n, r.kept) for r in rows} == {(1000, 1000, 1), (1, 2000, 2000)}


def brute_components(rows, width, percent):
    def shingle_set(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        span = min(width, len(words))
        return frozenset(tuple(words[i : i + span]) for i in range(len(words) - span + 1))

    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (identifier, *_) in enumerate(rows):
        least[find(i)].append(identifier)
    out = collections.Counter()
    for i, (identifier, *_) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        out[(identifier, len(sets[i]), min(known) if known else None)] += 1
    return out


@pytest.mark.parametrize("width, percent, seed", [(5, 80, 0), (4, 85, 1), (1, 50, 2), (2, 100, 3)])
def test_components_as_brute_force(spark, width, percent, seed):
    rows = near_copies(seed) + odd_rows()
    rows = [(r[0], r[1]) for r in rows]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "class", "n", "prefix", "component_id").repartition(3)
    found = jaccard_components(docs, width=width, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, width, percent)


def test_large_group_of_near_copies(spark):
    base = [f"base{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        words[i % 60] = f"own{i}"
        rows.append((i, " ".join(words)))
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=90).collect()
    assert {r.component_id for r in found} == {0}


@pytest.mark.parametrize("percent, seed", [(70, 0), (80, 1), (100, 2)])
def test_far_pairs_of_blocks_as_brute_force(spark, monkeypatch, percent, seed):
    """Few words in many texts: each is in the prefixes of texts that mostly do not link, so every window is looked at."""
    monkeypatch.setattr(jaccard_join, "LEAST_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "FIRST_WINDOW", 1)
    monkeypatch.setattr(jaccard_join, "WINDOW_GROWTH", 3)
    blocks, far = [], jaccard_join._far_blocks

    def watched(active, low, high):
        dealt = far(active, low, high)
        blocks.extend(r["count"] for r in dealt.groupBy("token", "block").count().collect())
        return dealt

    monkeypatch.setattr(jaccard_join, "_far_blocks", watched)
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.sample([f"w{j}" for j in range(22)], 8))) for i in range(220)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 1, percent)
    assert blocks and max(blocks) <= 2 * 16


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (200, 100)] + [(300, x) for x in range(301, 340)]
    links = spark.createDataFrame(edges, "u long, v long")
    found = {r.u: r.v for r in components(links, Scratch(spark, "test")).collect()}
    assert all(found[i] == 0 for i in range(1, 51)) and {found[x] for x in (101, 102, 200)} == {100} and found[339] == 300


def test_counts_of_very_common_shingles_are_whole():
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["one two three four"] * 70_000})
    (counted,) = jaccard_join._counts(4)(iter([batch]))
    largest = max(np.frombuffer(c, np.int64).max() for c in counted.column(1).to_pylist())
    (levels,) = jaccard_join._levels(iter([counted]))
    assert largest == 70_000 and max(max(b) for b in levels.column(1).to_pylist()) == round(6 * np.log2(70_001))
