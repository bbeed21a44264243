"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes. Byte offsets where tokens of both end cut the tokens into groups: the smallest runs of tokens of
either side that spell the same bytes. Each side's ends are an increasing array. While the tokens agree one to one, both
arrays are equal at a fixed shift of their indexes, a diagonal. Exponential probing compares ever longer slices along it and halves
back to the last equal entry, so a stretch of n agreeing tokens takes about log n comparisons. Where it breaks, the two
arrays are advanced past each other until they meet again; that is an irregular group, and the shift goes on from there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.llm.bpe import BYTE_LEVEL, PATTERN, byte_symbols
from estatespark.llm.common import small_batches

# Characters of text that a batch of the output holds, one text at least.
SLICE = 1 << 20
# Entries that the first probe along a diagonal compares.
FIRST_PROBE = 4
NO_GROUPS = [np.empty(0, np.int32)] * 4
PARTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
# Fixed values of piece vocabularies: the mark for a space.
SPACE_MARK = "▁"


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side lie before every common end; `a` and `b` are int32 ends that increase to the same last one."""
    raw_a, raw_b, ends_a, ends_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    i, j, n = 0, 0, len(ends_a)
    # For each stretch: where both sides stand behind it, and its number of groups.
    behind_a: list[int] = []
    behind_b: list[int] = []
    groups: list[int] = []
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:
            # Along the diagonal: probes grow while they match, then halve down to the first difference.
            first, shift, probe = i, j - i, FIRST_PROBE
            i += 1
            while i < n and raw_a[4 * i : 4 * (i + probe)] == raw_b[4 * (i + shift) : 4 * (i + shift + probe)]:
                i = min(n, i + probe)
                probe *= 2
            while probe > FIRST_PROBE:
                probe //= 2
                if raw_a[4 * i : 4 * (i + probe)] == raw_b[4 * (i + shift) : 4 * (i + shift + probe)]:
                    i = min(n, i + probe)
            while i < n and ends_a[i] == ends_b[i + shift]:
                i += 1
            j = i + shift
            groups.append(i - first)
        else:
            # An irregular group: whichever side lies behind goes on until both end together; the shift goes with it.
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            i += 1
            j += 1
            groups.append(1)
        behind_a.append(i)
        behind_b.append(j)
    sizes = np.array(groups, np.int64)
    place, total = np.arange(1, sizes.sum() + 1), np.cumsum(sizes)
    return tuple(place + np.repeat(np.array(behind, np.int64) - total, sizes) for behind in (behind_a, behind_b))


class BytePairs:
    """Side A: the byte-level vocabulary of a tokenizer file; texts begin with a space."""

    #: Tokens of bytes that are merged and never changed spell the text.
    exact = True

    def __init__(self, content: str):
        import tiktoken

        self.spelling, merged = byte_spellings(content)
        # Ranks stand for the merges if these make their tokens in the order of the ids.
        if merged != sorted(merged):
            raise ValueError("the ids of merged tokens must go with the order of the merges")
        ranks = {spelled: i for i, spelled in enumerate(self.spelling) if spelled}
        # Without special tokens their strings are plain text.
        self.encoding = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)


class Pieces:
    """Side B: a piece vocabulary with byte fallback, which puts the space before a text itself."""

    exact = False

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=content)
        self.spelling = piece_spellings(self.processor)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text), np.int32)


def byte_spellings(content: str) -> tuple[list[bytes], list[int]]:
    """(bytes of each id of a byte-level vocabulary file, none for added tokens; ids that the merges make, in their order)."""
    described, symbols = json.loads(content), byte_symbols()
    if described["model"]["type"] != "BPE" or described["normalizer"] or described["pre_tokenizer"] != BYTE_LEVEL:
        raise ValueError("a byte-level BPE file without normalizer is needed")
    vocabulary, added = described["model"]["vocab"], {token["id"] for token in described["added_tokens"]}
    spelling = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if i not in added:
            spelling[i] = bytes(symbols[c] for c in token)
    merges = (merge.split(" ") if isinstance(merge, str) else merge for merge in described["model"]["merges"])
    return spelling, [vocabulary[left + right] for left, right in merges]


def piece_spellings(processor) -> list[bytes]:
    """Bytes of each id of a piece vocabulary; <0xHH> is the byte HH."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]


class Alignment:
    """Groups of the tokens of both sides of a text."""

    def __init__(self, contents: tuple[str, bytes]):
        self.sides = BytePairs(contents[0]), Pieces(contents[1])
        self.lengths = [np.array(list(map(len, side.spelling)), np.int32) for side in self.sides]

    def __call__(self, text: str | None) -> list[np.ndarray]:
        """(ids of A, ids of B, A's tokens in each group, B's); nothing for texts that are missing, empty or spelled otherwise."""
        if not text:
            return NO_GROUPS
        ids, wanted = [side(text) for side in self.sides], b" " + text.encode()
        ends = [np.cumsum(length[own], dtype=np.int32) for length, own in zip(self.lengths, ids)]
        # Most texts that a side spells otherwise differ in length already.
        if any(not len(e) or e[-1] != len(wanted) for e in ends):
            return NO_GROUPS
        if any(b"".join(map(side.spelling.__getitem__, own.tolist())) != wanted for side, own in zip(self.sides, ids) if not side.exact):
            return NO_GROUPS
        return ids + [np.diff(cuts, prepend=0).astype(np.int32) for cuts in common_ends(*ends)]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _packed(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _aligned(contents, column: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        align = None
        for batch in batches:
            start = 0
            for texts in _slices(batch.column(1).to_pylist()):
                align = align or Alignment(contents.value)
                columns = [column(arrays) for arrays in zip(*map(align, texts))]
                rows = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows, *columns], names=["id", *PARTS])
                start += len(texts)

    return run


def _contents(spark: SparkSession, a_path: str, b_path: str):
    """Both vocabulary files, read by the driver: they have the same size for any corpus."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align_texts(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", packed: bool = False
) -> DataFrame:
    """(id, a_ids, b_ids, a_sizes, b_sizes): the ids of every whole text, after a space, and the numbers of tokens in its groups.

    They are arrays of int, or `packed`, which takes less to write and read back: 32-bit numbers in binary. `a_path` is a byte-level
    tokenizer file, `b_path` a piece model. Missing and empty texts, and texts that a side does not spell byte for byte, have no
    tokens. Rows keep their number; rows without an id have none. Further columns are left out.
    """
    small_batches(docs.sparkSession)
    contents = _contents(docs.sparkSession, a_path, b_path)
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind, part = narrow.schema["id"].dataType.simpleString(), "binary" if packed else "array<int>"
    schema = ", ".join([f"id {kind}", *[f"{name} {part}" for name in PARTS]])
    return narrow.mapInArrow(_aligned(contents, _packed if packed else _lists), schema).withColumnRenamed("id", id_column)


def _rows(batch: pa.RecordBatch, first: int) -> Iterator[list[np.ndarray]]:
    """The four packed parts of each row, from column `first` on."""
    for row in zip(*(batch.column(first + i).to_pylist() for i in range(len(PARTS)))):
        yield [np.frombuffer(part, np.int32) for part in row]


def _links(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Codes of a row's links: of each group the two tokens that end it, as A << 32 | B."""
    return a[np.cumsum(a_sizes) - 1].astype(np.int64) << 32 | b[np.cumsum(b_sizes) - 1]


def _pair_sums(batches: Iterator[pa.RecordBatch]):
    codes, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        found, n = np.unique(np.concatenate([np.empty(0, np.int64), *[_links(*row) for row in _rows(batch, 0)]]), return_counts=True)
        codes, place = np.unique(np.r_[codes, found], return_inverse=True)
        sums = np.bincount(place, weights=np.r_[sums, n], minlength=len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["pair", "n"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how many links of packed groups hold the two ids linked.

    Of two tokens that end together one is a suffix of the other, so there are at most as many pairs as the tokens of both
    vocabularies have bytes, for any corpus. Tasks send sums over pairs.
    """
    sums = aligned.select(*PARTS).mapInArrow(_pair_sums, "pair bigint, n bigint")
    summed = sums.groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n")


def _spelled_groups(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, digits: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: decimal ids, group by group."""
    groups = np.arange(len(a_sizes))
    a_group, b_group = np.repeat(groups, a_sizes), np.repeat(groups, b_sizes)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    spelled = np.zeros((len(a) + len(b), digits.shape[1] + 1), np.uint8)
    # A token of A stands behind the tokens of B of the groups before, a token of B behind all tokens of A up to its group.
    a_place, b_place = np.arange(len(a)) + (b_ends - b_sizes)[a_group], np.arange(len(b)) + a_ends[b_group]
    spelled[a_place, :-1], spelled[b_place, :-1] = digits[a], digits[b]
    spelled[:, -1] = ord(",")
    spelled[a_place[a_ends - 1], -1], spelled[b_place[b_ends - 1], -1] = ord("|"), ord(";")
    spelled = spelled.ravel()
    return spelled[spelled != 0][:-1].tobytes()


def _digits(most: int) -> np.ndarray:
    """A row of digits for every number up to `most`, zeros in front as empty bytes."""
    width = len(str(most))
    return np.array([str(i).rjust(width, "\0") for i in range(most + 1)], f"S{width}").view(np.uint8).reshape(-1, width)


def _digested(counts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        pairs, n, best = counts.value
        digits = _digits(1)
        for batch in batches:
            numbers, spelled = [], []
            for row in _rows(batch, 1):
                a, b, a_sizes, b_sizes = row
                place = np.searchsorted(pairs, _links(*row))
                numbers.append((len(a), len(b), len(place), len(place), int(best[place].sum()), int(n[place].sum())))
                most = int(max(a.max(initial=1), b.max(initial=1)))
                if most >= len(digits):
                    digits = _digits(most)
                spelled.append(hashlib.sha256(_spelled_groups(*row, digits)).hexdigest() if len(place) else "")
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * 6
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(spelled, pa.string())], names=names)

    return run


def alignment_digests(aligned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of packed `align_texts`, written once: numbers of tokens, groups and links, links whose pair is the most frequent one of its B
    id in all rows (ties included), the sum of the links' counts, and a digest of the groups.
    """
    spark = aligned.sparkSession
    # Bounded by the vocabularies, see link_counts; some hundred thousand pairs for two of fifty thousand tokens.
    found = link_counts(aligned).toArrow()
    a, b, n = (found.column(name).to_numpy() for name in ("a", "b", "n"))
    codes = a.astype(np.int64) << 32 | b
    order = np.argsort(codes)
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    counts = spark.sparkContext.broadcast((codes[order], n[order], (n == highest[b])[order].astype(np.int64)))
    kind = aligned.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return aligned.select(id_column, *PARTS).mapInArrow(_digested(counts), schema)
