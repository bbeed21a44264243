import hashlib
import random
import time

import public_tokenizers
import pytest
from fixtures import clashing, no_docs, odd_docs
from tokenizers import Tokenizer

from estatespark.llm import bpe
from estatespark.llm.bpe import Encoder, decode_ids, encode_texts, token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "th", "the", " ", "  ", "\n", "\t", "é", "中", "😀", "'s", "'ll", "12", "²", "Ⅷ", "ª", " ", " ", "\x1c", "\x85", "_", "-", "!!",
         "<|endoftext|>", "<|end", "́", "​", "aaaa", "==", "'", "\x00", "ǅ", " x", "\r\n"]


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return Encoder(file.read())


def test_same_ids_as_the_public_tokenizer(encoder, public):
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))
        ids = public.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert encoder.decode(ids) == public.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 40_000, "-" * 40_000, " " * 20_000 + "x", "中" * 10_000, "ab" * 20_000])
def test_long_pieces(encoder, public, text):
    assert encoder.encode(text).tolist() == public.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(encoder, public):
    draw = random.Random(4)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 20))]
        assert encoder.decode(ids) == public.decode(ids, skip_special_tokens=False)


def test_caches_are_shared_and_end(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.3)
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    with bpe.encoder_for(content) as first:
        ids = first.encode("hello there zebra crossing").tolist()
    held = len(first.spaced)
    with bpe.encoder_for(content) as second:
        assert second is first and len(first.spaced) == held > 0
    time.sleep(1.0)
    assert not first.spaced and not first.pieces and not first.vocabulary._pairs
    assert first.encode("hello there zebra crossing").tolist() == ids


def test_caches_are_bounded_in_bytes():
    made = bpe.Bounded(lambda key: key.encode() * 4, 20_000)
    for i in range(5000):
        assert made[f"key {i}"] == f"key {i}".encode() * 4
        assert made.held <= 20_000 + 300 and len(made.older) <= 20_000 // bpe.ENTRY + 2
    assert made["x" * 100] and "x" * 100 not in made


def test_round_trip_and_odd_rows(spark):
    docs = clashing(odd_docs(spark), "ids", "value", "row")
    encoded = encode_texts(docs, PATH)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    rows = decode_ids(encoded, PATH).collect()
    assert len(rows) == 10 and all(r.decoded == (r.text or "") for r in rows)
    assert encode_texts(no_docs(spark), PATH).count() == 0


def test_digests(spark, public):
    rows = {r.doc_id: r for r in token_digests(odd_docs(spark).where("doc_id > 2"), PATH).collect()}
    for r in odd_docs(spark).where("doc_id > 2").collect():
        ids = public.encode(r.text or "", add_special_tokens=False).ids
        decoded = public.decode(ids, skip_special_tokens=False)
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
