"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text the last token of its encoding is unique. A token that ends there is that last token exactly when
the encoding of what comes before ends in a token that is compatible with it: merging the bytes of the two tokens gives the
two tokens back. An automaton over the vocabulary lists the tokens that are suffixes of each prefix; one pass stores the last token
of every prefix, and following the back-pointers from the end gives the ids. The time is linear in the length of a piece.

Pieces are what the tokenizer's pattern cuts. They never reach over a space that is followed by other text, so a text is
cut at such spaces first and each chunk is encoded once per worker while it stays in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import sys
import threading
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatespark.llm.common import small_batches

# Fixed values of byte-level tokenizers: the pattern that cuts texts, Unicode's white space, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Bytes that a worker's caches may take, the entries in use; as much again for those of the time before.
CHUNK_CACHE, PIECE_CACHE = 40 << 20, 12 << 20
# What an entry takes besides its key's and value's own bytes, and what a pair of tokens takes.
ENTRY, PAIR_ENTRY = 190, 220
PAIR_CACHE = 48 << 20
# Seconds after a task in which the next one of its stage takes over the caches; then they are emptied.
IDLE_SECONDS = 5.0


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bounded(dict):
    """A dictionary of bytes that fills itself by `make`; entries in use take up to `limit` bytes, those of the time before as many."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older, self.held = make, limit, longest, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if self.held > self.limit:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += ENTRY + len(key) + len(value)
        return value

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0


class Vocabulary:
    """A byte-level vocabulary with its merges, from the content of a tokenizer file."""

    def __init__(self, content: str):
        import ahocorasick

        described = json.loads(content)
        model = described["model"]
        if model["type"] != "BPE" or described["normalizer"] or described["pre_tokenizer"] != BYTE_LEVEL:
            raise ValueError("a byte-level BPE file without normalizer is needed")
        symbols = byte_symbols()
        spelled = {token: bytes(symbols[c] for c in token) for token in model["vocab"]}
        self.ids = {spelled[token]: i for token, i in model["vocab"].items()}
        self.added = {}
        for token in described["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("only plain added tokens are known")
            self.added[token["content"]] = token["id"]
        by_id = {i: b for b, i in self.ids.items()} | {i: content.encode() for content, i in self.added.items()}
        #: Bytes of each id.
        self.spelling = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        #: For each pair that merges: its rank. For each token made by a merge: that rank and its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (self.ids[spelled[left]], self.ids[spelled[right]])
            self.rank[pair] = rank
            self.made.setdefault(self.ids[spelled[left] + spelled[right]], (rank, *pair))
        # The automaton works on characters; one character stands for one byte.
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, side by side, encode to the two tokens.

        Merges are undone, the last one first, on whichever side it happened. They come back if at some moment
        the two tokens at the seam merge before the merge that was undone last.
        """
        known = self._test(left, right)
        if len(self._pairs) >= PAIR_CACHE // PAIR_ENTRY:
            self._pairs.clear()
        self._pairs[(left, right)] = known
        return known

    def forget(self) -> None:
        self._pairs.clear()

    def _test(self, left: int, right: int) -> bool:
        made, rank = self.made, self.rank
        # Rank of the merge undone last, and whether it was on the left: on equal ranks the left one comes first.
        undone, undone_left = len(rank), False
        while True:
            seam = rank.get((left, right))
            if seam is not None and (seam < undone or (seam == undone and not undone_left)):
                return False
            from_left, from_right = made.get(left), made.get(right)
            if from_left is None and from_right is None:
                return True
            if from_right is None or (from_left is not None and from_left[0] > from_right[0]):
                undone, undone_left, left = from_left[0], True, from_left[2]
            else:
                undone, undone_left, right = from_right[0], False, from_right[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.ids.get(piece)
        if whole is not None and (whole in self.made or len(piece) == 1):
            return [whole]
        size = len(piece)
        last, start = [-1] * size, [0] * size
        known, compatible, done = self._pairs, self.compatible, -1
        # For each end the longest token comes first; ends are counted from 0.
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            at = end - length
            if at >= 0:
                # Every byte is a token, so each shorter prefix has its last token by now.
                before = last[at]
                fits = known.get((before, token))
                if fits is None:
                    fits = compatible(before, token)
            else:
                fits = length == 1 or token in self.made
            if fits:
                last[end], start[end], done = token, at, end
        ids, end = [], size - 1
        while end >= 0:
            ids.append(last[end])
            end = start[end]
        return ids[::-1]


# Fixed value: how a byte-level file describes the cutting of texts.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Encoder:
    """Texts to ids and back."""

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.pattern = regex.compile(PATTERN)
        self.decimals = [str(i) for i in range(len(self.vocabulary.spelling))]
        marks = sorted(self.vocabulary.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.spaced_white = regex.compile(f" (?:[{WHITE_SPACE}]|$)")
        self.pieces = Bounded(self._piece, PIECE_CACHE)
        #: Chunks by what follows their leading space.
        self.spaced = Bounded(self._spaced, CHUNK_CACHE)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def _spaced(self, part: str) -> bytes:
        # Letters behind a space are one piece of the pattern.
        return self._piece(" " + part) if part.isalpha() else self._chunk(" " + part)

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pattern.findall(chunk):
            word = piece[1:]
            out.append(self.spaced[word] if piece[0] == " " and word.isalpha() else self.pieces[piece])
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        # A space starts a new chunk when other text follows it, else it stays with the white space around it.
        if self.spaced_white.search(text):
            out, chunk = [], ""
            for i, part in enumerate(text.split(" ")):
                if not i:
                    chunk = part
                elif part and part[0] not in WHITE_SPACE:
                    out.append(self._chunk(chunk))
                    chunk = " " + part
                else:
                    chunk += " " + part
            out.append(self._chunk(chunk))
            return b"".join(out)
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of added tokens become those tokens."""
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        added = self.vocabulary.added
        parts = self.marks.split(text)
        out = [np.int32(added[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts) if p]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.spelling.__getitem__, ids)).decode("utf-8", "replace")

    def forget(self) -> None:
        """Empties the caches; what stays has the vocabulary's size."""
        self.vocabulary.forget()
        self.pieces.forget()
        self.spaced.forget()

    def digits(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))


@contextmanager
def encoder_for(content: str) -> Iterator[Encoder]:
    """The worker's encoder for a file's content. The tasks of a stage share its caches, which end soon after the last one."""
    # Tasks get this module by value, so what outlives a task is held by a module of the worker's own.
    held = sys.modules.setdefault("estatespark_worker", ModuleType("estatespark_worker")).__dict__
    if "emptying" in held:
        held["emptying"].cancel()
    key = hashlib.sha256(content.encode()).hexdigest()
    if held.get("encoder_key") != key:
        held["encoder"], held["encoder_key"] = Encoder(content), key
    try:
        yield held["encoder"]
    finally:
        held["emptying"] = threading.Timer(IDLE_SECONDS, held["encoder"].forget)
        held["emptying"].daemon = True
        held["emptying"].start()


def _vocabulary_file(spark, path: str):
    """The file's content, read by the driver: a vocabulary has the same size for any corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, path: str, text_column: str = "text", output: str = "ids") -> DataFrame:
    """Adds the ids of every whole text as array<int>; only the texts go to Python, and only ids come back.

    A missing text has no ids, as an empty one. Rows come out as often as they come in; a further column named like the output
    is replaced, an empty table stays one.
    """
    small_batches(docs.sparkSession)
    return _added(docs, text_column, output, "array<int>", _encoding(_vocabulary_file(docs.sparkSession, path)))


def decode_ids(docs: DataFrame, path: str, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids. A missing array gives an empty text; otherwise as `encode_texts`."""
    small_batches(docs.sparkSession)
    return _added(docs, ids_column, output, "string", _decoding(_vocabulary_file(docs.sparkSession, path)))


def _added(docs: DataFrame, column: str, output: str, kind: str, run: Callable) -> DataFrame:
    """`docs` with a column more, which `run` makes of one column, batch by batch."""
    made = F.arrow_udf(run, kind)(F.col(f"`{column}`"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != output], made.alias(output))


def _encoding(content) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder_for(content.value) as encoder:
            for texts in batches:
                found = [encoder.encode(text or "") for text in texts.to_pylist()]
                offsets = np.r_[0, np.cumsum([len(ids) for ids in found])].astype(np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return run


def _decoding(content) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with encoder_for(content.value) as encoder:
            for arrays in batches:
                yield pa.array([encoder.decode(ids or []) for ids in arrays.to_pylist()], pa.string())

    return run


def token_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (of the decoded text).

    A missing text counts as an empty one; rows without an id and repeated rows come out as they come in. Further columns are left out,
    an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("value"))
    content = _vocabulary_file(docs.sparkSession, path)
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]):
        with encoder_for(content.value) as encoder:
            for batch in batches:
                sizes, spelled, decoded = [], [], []
                for text in batch.column(1).to_pylist():
                    ids = encoder.encode(text or "").tolist()
                    sizes.append(len(ids))
                    spelled.append(hashlib.sha256(encoder.digits(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow.mapInArrow(run, schema)
