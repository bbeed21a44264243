import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from fixtures import clashing, no_docs, odd_docs, odd_rows, prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from estatespark.llm.bpe import byte_symbols
from estatespark.llm.token_alignment import align_texts, alignment_digests, common_ends, link_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "▁▁a", " ", "  ", "   x", "\t", "\r\n", "é", "é", "中文", "😀", "\x00", "a  b",
       "it's", "don'T", "word", " ", "　", "​", "12345", "a" * 300, " " * 40, "x \n y", "ﬁ", "Ａ"]


def plain(text, byte_level, pieces):
    """Groups by intersecting sets of ends: ([ids of A], [ids of B]) each."""
    if not text:
        return []
    a, b = byte_level.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    symbols = byte_symbols()
    spelled_a = [bytes(symbols[c] for c in byte_level.id_to_token(i)) for i in a]
    spelled_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
    if b"".join(spelled_a) != b"".join(spelled_b) or b"".join(spelled_a) != b" " + text.encode():
        return []
    ends_a, ends_b = np.cumsum(list(map(len, spelled_a))), np.cumsum(list(map(len, spelled_b)))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        p, q = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


@pytest.fixture(scope="module")
def tokenizers():
    byte_level = Tokenizer.from_file(A)
    byte_level.encode_special_tokens = True
    return byte_level, SentencePieceProcessor(model_file=B)


def test_common_ends_of_any_two_cuts():
    draw = random.Random(1)
    for _ in range(2000):
        size = draw.randint(1, 200)
        share = draw.choice([0.02, 0.5, 0.95, 1.0])
        both = [i for i in range(1, size) if draw.random() < share]
        ends = [np.array(sorted({size, *(i for i in both if draw.random() < 0.9), *(i for i in range(1, size) if draw.random() < 0.05)}), np.int32) for _ in "ab"]
        cuts = common_ends(*ends)
        expected = np.intersect1d(*ends)
        assert all((e[c - 1] == expected).all() and len(c) == len(expected) for e, c in zip(ends, cuts))


@pytest.mark.parametrize("size", [1, 3, 4, 5, 12, 13, 1000, 4097])
def test_long_diagonals(size):
    ends = np.arange(1, size + 1, dtype=np.int32)
    assert all((cuts == ends).all() for cuts in common_ends(ends, ends))
    shifted = np.r_[np.int32(1), ends + 1].astype(np.int32), (ends + 1).astype(np.int32)
    assert [c.tolist() for c in common_ends(*shifted)] == [list(range(2, size + 2)), list(range(1, size + 1))]


def test_same_as_plain(spark, tokenizers):
    draw = random.Random(2)
    texts = [text for _, text, *_ in odd_rows()] + [" ".join(prose(i, 30)) for i in range(20)]
    texts += ["".join(draw.choice(ODD) for _ in range(draw.randint(1, 9))) for _ in range(400)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rows = list(enumerate(texts))
    expected = {i: plain(text, *tokenizers) for i, text in rows}
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "id", "n", "a_ids", "pair").repartition(4)
    aligned = align_texts(docs, A, B).cache()
    for r in aligned.collect():
        a, b = np.cumsum([0, *r.a_sizes]), np.cumsum([0, *r.b_sizes])
        assert [(r.a_ids[p:q], r.b_ids[s:t]) for p, q, s, t in zip(a, a[1:], b, b[1:])] == expected[r.doc_id]
    aligned = align_texts(docs, A, B, packed=True).cache()
    counts = collections.Counter((g[0][-1], g[1][-1]) for groups in expected.values() for g in groups)
    assert {(r.a, r.b): r.n for r in link_counts(aligned).collect()} == counts
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for r in alignment_digests(aligned).collect():
        groups = expected[r.doc_id]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        assert (r.n_a, r.n_b) == (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups))
        assert r.n_groups == r.n_links == len(groups)
        assert r.n_best == sum(counts[link] == best[link[1]] for link in links) and r.count_sum == sum(counts[link] for link in links)
        assert r.groups_sha256 == (hashlib.sha256(spelled.encode()).hexdigest() if groups else "")


def test_texts_spelled_otherwise_have_no_tokens(tokenizers):
    assert plain("a ▁ b", *tokenizers) == [] and plain("a b", *tokenizers)


def test_odd_rows_and_empty_tables(spark):
    rows = alignment_digests(align_texts(clashing(odd_docs(spark), "n_a"), A, B, packed=True)).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id for r in rows if r.n_groups == 0 and r.groups_sha256 == ""} == {3, 4, None}
    assert alignment_digests(align_texts(no_docs(spark), A, B, packed=True)).count() == 0
