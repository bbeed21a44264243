"""Exact deduplication: compressed radix tries whose terminal nodes hold the owner of a text.

Two rounds of tries. Each input partition inserts its texts into a trie, so that copies meet their partition's first row before
anything is shuffled; one row per distinct text and partition then goes to the partition of its length and content hash,
where a second trie over the full bytes decides. Equality is decided by the tries' bytes, never by a hash.

Tries stay below a byte budget. In the first round a full trie is emptied into the output, which only means that a text may have two
owners there. In the second round rows come sorted by length and hash, which lead every key, so a subtree is finished when the next
header arrives; finished subtrees leave the trie for Spark's output, and Spark's sort does the spilling.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatespark.llm.common import Scratch, as_bytes, row_numbers, small_batches

TRIE_BYTES = 48 * 1024 * 1024
OUTPUT_BYTES = 16 * 1024 * 1024
NODE_BYTES = 300
# Length and content hash lead every key of the second round.
HEADER = ">Qq"


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner = edge, {}, None


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class PatriciaTrie:
    """Byte strings with shared beginnings stored once; `bytes` estimates the memory held."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def terminal(self, key: bytes) -> Node:
        """The node at which `key` ends, made if need be."""
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = Node(rest)
                self.bytes += NODE_BYTES + len(rest)
                return child
            shared = common_length(child.edge, rest)
            if shared < len(child.edge):
                upper = Node(child.edge[:shared])
                child.edge = child.edge[shared:]
                upper.children[child.edge[0]] = child
                node.children[rest[0]] = upper
                self.bytes += NODE_BYTES
                child = upper
            node, rest = child, rest[shared:]
        return node

    def drain(self) -> Iterator[tuple[bytes, object]]:
        """All (key, owner), leaving an empty trie."""
        stack = [(b"", self.root)]
        self.root, self.bytes = Node(b""), 0
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.edge
            if node.owner is not None:
                yield key, node.owner
            stack.extend((key, child) for child in node.children.values())


def better(new: int | None, old: int | None, largest: bool) -> bool:
    """Whether `new` takes the place of `old`; a missing identifier never does."""
    if new is None or old is None:
        return old is None and new is not None
    return new > old if largest else new < old


def normalised(text: bytes | None) -> bytes:
    """A-Z lower-cased; a missing text counts as empty. bytes.lower() touches ASCII only."""
    return b"" if text is None else text.lower()


class _Rows:
    """Collects rows and gives record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        self.rows.append(row)
        self.size += size
        return self.size >= OUTPUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        arrays = [pa.array(c, field.type) for c, field in zip(columns, self.schema)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


class _Owner:
    """What a terminal of the first round knows of a text: its first row here, its best row, how many there are."""

    __slots__ = ("owner_row", "row", "id", "n", "text", "rest")

    def __init__(self, row, identifier, text, rest):
        self.owner_row, self.row, self.id, self.n, self.text, self.rest = row, row, identifier, 1, text, rest


def _own(largest: bool, schema: pa.Schema, trie_bytes: int) -> Callable:
    """First round: a row for each input row (row, id, owner_row), and a summary for each distinct text."""

    def summaries(trie: PatriciaTrie) -> Iterator[tuple[tuple, int]]:
        for key, owner in trie.drain():
            hashed = xxhash.xxh3_64_intdigest(key) - (1 << 63)
            row = (owner.row, owner.id, owner.owner_row, owner.n, len(key), hashed, owner.text, owner.rest)
            yield row, len(owner.text or b"") + 200

    def run(batches):
        trie, numbers, out = PatriciaTrie(), row_numbers(), _Rows(schema)
        for batch in batches:
            ids, texts, rests = batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()
            for identifier, text, rest in zip(ids, texts, rests):
                row, node = next(numbers), trie.terminal(normalised(text))
                owner = node.owner
                if owner is None:
                    owner = node.owner = _Owner(row, identifier, text, rest)
                    trie.bytes += len(text or b"")
                else:
                    owner.n += 1
                    if better(identifier, owner.id, largest):
                        owner.row, owner.id, owner.text, owner.rest = row, identifier, text, rest
                if out.add((row, identifier, owner.owner_row) + (None,) * 5):
                    yield out.batch()
                if trie.bytes > trie_bytes:
                    for summary, size in summaries(trie):
                        if out.add(summary, size):
                            yield out.batch()
        for summary, size in summaries(trie):
            if out.add(summary, size):
                yield out.batch()
        yield out.batch()

    return run


class _Group:
    __slots__ = ("owners", "row", "id", "n", "text", "rest")

    def __init__(self):
        self.owners, self.row, self.id, self.n, self.text, self.rest = [], None, None, 0, None, None


def _merge(largest: bool, schema: pa.Schema, trie_bytes: int, whole_rows: bool) -> Callable:
    """Second round over summaries sorted by length and hash."""

    def finished(trie: PatriciaTrie) -> Iterator[tuple[tuple, int]]:
        for key, group in trie.drain():
            if whole_rows:
                yield (group.id, group.text, group.rest), len(group.text or b"") + 200
                continue
            digest = hashlib.sha256(key[struct.calcsize(HEADER) :]).hexdigest()
            for owner_row in group.owners:
                yield (owner_row, group.id, group.row, group.n, digest), 150

    def run(batches):
        trie, out, last = PatriciaTrie(), _Rows(schema), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            texts, rests = as_bytes(batch.column(6)), batch.column(7).to_pylist()
            for row, identifier, owner_row, n, length, hashed, text, rest in zip(*columns, texts, rests):
                header = struct.pack(HEADER, length, hashed)
                if header != last and trie.bytes > trie_bytes:
                    for result, size in finished(trie):
                        if out.add(result, size):
                            yield out.batch()
                last = header
                node = trie.terminal(header + normalised(text))
                group = node.owner
                if group is None:
                    group = node.owner = _Group()
                    trie.bytes += len(text or b"") * whole_rows
                group.n += n
                if not whole_rows:
                    group.owners.append(owner_row)
                if group.row is None or better(identifier, group.id, largest):
                    group.row, group.id = row, identifier
                    if whole_rows:
                        group.text, group.rest = text, rest
        for result, size in finished(trie):
            if out.add(result, size):
                yield out.batch()
        yield out.batch()

    return run


def _schemas(id_type: T.DataType, rest: T.StructType) -> tuple[T.StructType, T.StructType, T.StructType]:
    long = T.LongType()
    owned = T.StructType(
        [T.StructField("row", long), T.StructField("id", id_type), T.StructField("owner_row", long), T.StructField("n", long),
         T.StructField("length", long), T.StructField("hash", long), T.StructField("text", T.StringType()), T.StructField("rest", rest)]
    )
    marks = T.StructType(
        [T.StructField("owner_row", long), T.StructField("keep_id", id_type), T.StructField("keep_row", long),
         T.StructField("group_size", long), T.StructField("text_sha256", T.StringType())]
    )
    rows = T.StructType([T.StructField("id", id_type), T.StructField("text", T.StringType()), T.StructField("rest", rest)])
    return owned, marks, rows


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _round_one(docs: DataFrame, id_column: str, text_column: str, rest: list[str], largest: bool, trie_bytes: int):
    small_batches(docs.sparkSession)
    payload = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), payload.alias("rest"))
    schemas = _schemas(narrow.schema["id"].dataType, narrow.schema["rest"].dataType)
    owned = narrow.mapInArrow(_own(largest, _arrow(schemas[0]), trie_bytes), schemas[0])
    return owned, schemas


def _round_two(summaries: DataFrame, schema: T.StructType, largest: bool, trie_bytes: int, whole_rows: bool) -> DataFrame:
    # Equal texts share length and hash, so they meet; by then there is one of them per input partition.
    dealt = summaries.repartition("length", "hash").sortWithinPartitions("length", "hash", "row")
    return dealt.mapInArrow(_merge(largest, _arrow(schema), trie_bytes, whole_rows), schema)


def mark_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the smallest (or `keep="largest"`) id stays; a missing id stays only if all ids of the group are
    missing. Of rows with the same text and id the first read stays. Missing texts equal empty ones. Other columns are ignored.
    """
    largest = _largest(keep)
    scratch = Scratch(docs.sparkSession, "copies")
    owned, schemas = _round_one(docs, id_column, text_column, [], largest, trie_bytes)
    owned = scratch.write(owned, "owned")
    marks = _round_two(owned.where("n is not null"), schemas[1], largest, trie_bytes, whole_rows=False)
    rows = owned.where("n is null").select("row", "id", "owner_row")
    # An owner has the copies of one input partition at most, so this join has no hot key beyond that.
    joined = rows.join(marks, "owner_row")
    return joined.select(
        F.col("id").alias(id_column), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """The rows that stay, whole and with their own text; rules as in `mark_copies`. Nothing is joined back."""
    largest = _largest(keep)
    rest = [c for c in docs.columns if c not in (id_column, text_column)]
    owned, schemas = _round_one(docs, id_column, text_column, rest, largest, trie_bytes)
    rows = _round_two(owned.where("n is not null"), schemas[2], largest, trie_bytes, whole_rows=True)
    source = {id_column: F.col("id"), text_column: F.col("text")}
    source |= {c: F.col("rest").getField(c) for c in rest}
    return rows.select(*[source[c].alias(c) for c in docs.columns])


def _largest(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return keep == "largest"
