"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets are put in one global order, rare shingles first. Two sets that reach the
similarity share at least `l` shingles of their prefixes, when a prefix holds n - ceil(t n) + l of n shingles. Every document
chooses its own `l`: a longer prefix costs more to read but asks for more shared shingles before a pair is verified, and
a pair must share the smaller of its two numbers. The order only affects cost, so it comes from a sketch of fixed size.

Equal sets are one class. Links between classes are verified on whole sets. Candidates come from the prefixes for l = 1: a linked pair's
first common shingle lies there on both sides, at places that leave enough shingles behind. Postings of a shingle are ranked, and a
posting is paired with those at growing distances in rank, but only while the two lie in different components: a group of near
copies is tied together by its close ranks, and pairs inside its component are never made. Each pair of ranks is visited
or known to be connected, so components are exact. No pair is dropped for any group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatespark.llm.common import Scratch, as_bytes, small_batches
from estatespark.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH_BITS = 21
BLOCK = 1 << 16
BITMAP_BITS = 26
# Words whose codes a task keeps, about 9 MB.
WORD_CACHE = 1 << 16
MOST_MATCHES = 12
# What verifying one candidate costs, counted in postings read.
VERIFY_COST = 32.0
# Ranks that are paired in the first round, and how much farther each round looks.
FIRST_WINDOW, WINDOW_GROWTH = 4, 16
LEAST_BLOCK = 4096
PAIR_CHUNK = 200_000


class WordCodes(dict):
    """64-bit codes of words; holds a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = code
        return code


def shingles(text: bytes | None, width: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles of a whole text, A-Z lower-cased.

    Fewer words than `width` are one shingle; no words, none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    coded = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    last = len(words) - span + 1
    mixed = coded[:last] + np.uint64(span)
    for i in range(1, span):
        mixed = ((mixed ^ (mixed >> np.uint64(29))) * MIX) + coded[i : last + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a partner must share at least: ceil(percent / 100 * size)."""
    return -(-percent * size // 100)


def choose_matches(frequency: np.ndarray, percent: int) -> int:
    """The number of matches with the least estimated cost, given the frequencies of the ordered shingles.

    With l matches the prefix's postings are read, and each candidate takes up l of them at least.
    """
    size = len(frequency)
    overlap = least_overlap(size, percent)
    most = min(MOST_MATCHES, overlap)
    read = np.cumsum(frequency[: size - overlap + most])[size - overlap :]
    cost = read * (1.0 + VERIFY_COST / np.arange(1, most + 1))
    return int(np.argmin(cost)) + 1


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counts(width: int) -> Callable:
    """(block, counters): in how many documents of the task a slot's shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]):
        codes, total = WordCodes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [shingles(text, width, codes) for text in as_bytes(batch.column(0))]
            if found:
                total += np.bincount(_slots(np.concatenate(found)), minlength=1 << SKETCH_BITS)
        blocks = total.reshape(-1, BLOCK)
        yield pa.RecordBatch.from_pydict({"block": list(range(len(blocks))), "counters": [b.tobytes() for b in blocks]})

    return run


def _levels(batches: Iterator[pa.RecordBatch]):
    """Sums of a block's counters, as logarithms in a byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(counters, np.int64)
    level = [np.minimum(255, np.round(6 * np.log2(1.0 + s))).astype(np.uint8).tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int64()), "levels": pa.array(level, pa.binary())})


def frequency_levels(docs: DataFrame, text_column: str, width: int) -> np.ndarray:
    """Rounded logarithm of the document frequency of each slot, over all documents: 2**SKETCH_BITS bytes for any input."""
    counts = docs.select(F.col(text_column).alias("text")).mapInArrow(_counts(width), "block bigint, counters binary")
    summed = counts.repartition((1 << SKETCH_BITS) // BLOCK, "block").mapInArrow(_levels, "block bigint, levels binary")
    levels = np.zeros((1 << SKETCH_BITS) // BLOCK * BLOCK, np.uint8)
    for row in summed.collect():
        levels[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def class_code(codes: np.ndarray) -> int:
    """64 bits that stand for a set; sets with the same bits count as equal, which shingle codes already do."""
    return xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63)


def _prefixes(width: int, percent: int, levels) -> Callable:
    """(id, n_shingles, class, matches, prefix) of each document; matches and prefix for a class's first row in a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        codes, seen, level = WordCodes(), set(), levels.value
        for batch in batches:
            sizes, classes, matches, prefixes = [], [], [], []
            for text in as_bytes(batch.column(1)):
                found = shingles(text, width, codes)
                size = len(found)
                sizes.append(size)
                key = class_code(found) if size else None
                classes.append(key)
                if not size or key in seen:
                    matches.append(None)
                    prefixes.append(None)
                    continue
                seen.add(key)
                rank = level[_slots(found)].astype(np.uint64)
                order = np.argsort((rank << np.uint64(56)) | ((found * MIX) >> np.uint64(8)), kind="stable")
                wanted = choose_matches(np.exp2(rank[order] / 6.0), percent)
                matches.append(wanted)
                prefixes.append(_signed(found[order[: size - least_overlap(size, percent) + wanted]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.array(matches, pa.int32()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["id", "n", "class", "matches", "prefix"],
            )

    return run


def _ranked(batches: Iterator[pa.RecordBatch]):
    """Rank of each posting among those of its shingle; rows come sorted by shingle. Shingles of one class only fall away."""
    held: list[int] | None = None
    last, rank = None, 0
    names = ["token", "class", "n", "place", "rank"]

    def give(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        token = columns[0]
        if not len(token):
            continue
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        lengths = np.diff(np.r_[starts, len(token)])
        order = np.arange(len(token)) - np.repeat(starts, lengths)
        shared = np.repeat(lengths > 1, lengths)
        if token[0] == last:
            order[: lengths[0]] += rank
            shared[: lengths[0]] = True
            # The row that ended the batch before was not alone.
            if held:
                yield give([[h] for h in held])
        tail = len(token) - 1
        held = None if shared[tail] else [int(c[tail]) for c in (*columns, order)]
        last, rank = token[tail], int(order[tail]) + 1
        yield give([c[shared] for c in (*columns, order)])


def _sets(width: int, wanted) -> Callable:
    """(class, codes) of documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]):
        codes, seen, bitmap = WordCodes(), set(), wanted.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            may = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            chosen = np.flatnonzero(may)
            keys, sets = [], []
            for text in as_bytes(batch.column(1).take(pa.array(chosen))):
                found = shingles(text, width, codes)
                key = class_code(found) if len(found) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(_signed(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "codes"])

    return run


def _slot(identifier: Column) -> Column:
    """A slot of the bitmap; rows without an id all share one."""
    return F.xxhash64(identifier).bitwiseAND((1 << BITMAP_BITS) - 1)


def _whole_sets(docs: DataFrame, id_column: str, text_column: str, width: int, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, codes) of the given classes (class, id), from one more scan of the texts.

    A bitmap of fixed size over the classes' ids spares other rows the shingling; the join decides.
    """
    spark = docs.sparkSession
    slot = _slot(F.col("id"))
    words = classes.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")).alias("bits")
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    packed = words.toArrow()
    bitmap[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(bitmap)
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("slot", slot)
    found = narrow.mapInArrow(_sets(width, wanted), "class bigint, codes array<bigint>")
    sets = scratch.write(found.join(classes.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    wanted.destroy()
    return sets


def _needed(u_size: Column, v_size: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes must share to link."""
    total = (u_size + v_size) * percent
    return F.floor((total + (99 + percent)) / (100 + percent)).cast("int")


def _linked(pairs: DataFrame, classes: DataFrame, sets: Callable, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v) of the pairs that share enough of their prefixes and then of their whole sets.

    The joins are by sort: arrays are larger in memory than files let one expect.
    """

    def side(df: DataFrame, name: str, *values: str) -> DataFrame:
        return df.select(F.col("class").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in values])

    def both(pairs: DataFrame, df: DataFrame, *values: str) -> DataFrame:
        return pairs.join(side(df, "u", *values).hint("merge"), "u").join(side(df, "v", *values).hint("merge"), "v")

    close = both(pairs, classes, "prefix", "matches", "n")
    matches, needed = F.least("u_matches", "v_matches"), _needed(F.col("u_n"), F.col("v_n"), percent)
    ends = [F.slice(f"{side}_prefix", 1, (F.col(f"{side}_n") - needed + matches).cast("int")) for side in "uv"]
    close = scratch.write(close.where(F.size(F.array_intersect(*ends)) >= matches).select("u", "v"), "close")
    if close.isEmpty():
        return close
    whole = sets(close.select(F.col("u").alias("class")).union(close.select(F.col("v").alias("class"))).distinct())
    verified = both(close, whole, "codes")
    shared = F.size(F.array_intersect("u_codes", "v_codes"))
    union = F.size("u_codes") + F.size("v_codes") - shared
    links = scratch.write(verified.where(shared * 100 >= union * percent).select("u", "v"), "links")
    scratch.drop(close)
    return links


def _needed_shared(total: np.ndarray, percent: int) -> np.ndarray:
    return (total * percent + (99 + percent)) // (100 + percent)


def _good(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of rows (class, size, place, before, root) of one shingle may link and meet here first."""
    (_, size_a, place_a, before_a, root_a), (_, size_b, place_b, before_b, root_b) = a, b
    needed = _needed_shared(size_a + size_b, percent)
    # Where both have the same shingle before this one, the pair has met there.
    good = (root_a != root_b) & ((before_a != before_b) | (before_a == 0))
    return good & (size_a - place_a >= needed) & (size_b - place_b >= needed)


def _given(held: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.concatenate(held, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])


def _collected(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) in batches, the smaller class first."""
    held, count = [], 0
    for found in pairs:
        held.append(np.sort(found, axis=0))
        count += found.shape[1]
        if count > PAIR_CHUNK:
            yield _given(held)
            held, count = [], 0
    if count:
        yield _given(held)


def _near_pairs(low: int, high: int, percent: int) -> Callable:
    """Pairs of rows of one (token, block) whose ranks are `low` to `high` apart, all blocks at once.

    A block holds all ranks from its first to its last row, so distance in rank is distance in place.
    """

    def pairs(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
        token, block, *values, own = columns
        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
        lengths = np.diff(np.r_[starts, len(token)])
        behind = np.repeat(starts + lengths, lengths) - np.arange(len(token)) - 1
        for step in range(low, min(high, int(lengths.max()) - 1) + 1):
            a = np.flatnonzero(behind >= step)
            b = a + step
            good = own[b] & _good([v[a] for v in values], [v[b] for v in values], percent)
            yield np.stack([values[0][a[good]], values[0][b[good]]])

    return pairs


def _far_pairs(low: int, high: int, percent: int) -> Callable:
    """Pairs of rows of two blocks of one token whose ranks are `low` to `high` apart.

    `block` names both, the left one in the upper half; `own` tells the left one's rows. Both hold LEAST_BLOCK ranks at most, without
    gaps, so what a pair of blocks takes is bounded for any window.
    """

    def pairs(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
        token, block, *values, own = columns
        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
        for start, end in zip(starts, np.r_[starts[1:], len(token)]):
            between = (int(block[start] & 0xFFFFFFFF) - int(block[start] >> 32)) * LEAST_BLOCK
            left = [v[start:end][own[start:end]] for v in values]
            right = [v[start:end][~own[start:end]] for v in values] if between else left
            n, m = len(left[0]), len(right[0])
            for distance in range(max(low, between - n + 1), min(high, between + m - 1) + 1):
                first, last = max(0, between - distance), min(n, between + m - distance)
                a = [v[first:last] for v in left]
                b = [v[first + distance - between : last + distance - between] for v in right]
                good = _good(a, b, percent)
                yield np.stack([a[0][good], b[0][good]])

    return pairs


def _by_block(pairs: Callable) -> Callable:
    """Applies `pairs` to whole blocks of rows, which come sorted by token, block and rank. What is held is one block."""

    def run(batches: Iterator[pa.RecordBatch]):
        open_block: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            # The last block may go on in the next batch.
            token, block = columns[0], columns[1]
            ended = np.flatnonzero((token != token[-1]) | (block != block[-1]))
            cut = int(ended[-1]) + 1 if len(ended) else 0
            same = bool(open_block) and open_block[0][0][0] == token[0] and open_block[0][1][0] == block[0]
            if open_block and (cut or not same):
                whole = [np.concatenate(c) for c in zip(*open_block)]
                open_block = []
                columns = [np.concatenate([o, c]) for o, c in zip(whole, columns)]
                cut += len(whole[0])
            if cut:
                yield from _collected(pairs([c[:cut] for c in columns]))
            open_block.append([c[cut:] for c in columns])
        if open_block:
            yield from _collected(pairs([np.concatenate(c) for c in zip(*open_block)]))

    return run


def _near_blocks(active: DataFrame, high: int) -> DataFrame:
    """Postings in blocks of LEAST_BLOCK ranks, each with as many ranks of the block before as the window reaches back."""
    block = F.floor(F.col("rank") / LEAST_BLOCK)
    reaches = (F.col("rank") % LEAST_BLOCK >= LEAST_BLOCK - high) & ((block + 1) * LEAST_BLOCK <= F.col("last"))
    dealt = active.withColumn("own", F.explode(F.when(reaches, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    return dealt.withColumn("block", F.when(F.col("own"), block).otherwise(block + 1))


def _far_blocks(active: DataFrame, low: int, high: int) -> DataFrame:
    """Postings in every pair of blocks of LEAST_BLOCK ranks that the window joins."""
    nearest, farthest = max(0, -(-(low + 1) // LEAST_BLOCK) - 1), (high - 1) // LEAST_BLOCK + 1
    own, last = F.floor(F.col("rank") / LEAST_BLOCK), F.floor(F.col("last") / LEAST_BLOCK)
    left = F.transform(
        F.filter(F.sequence(F.lit(nearest), F.lit(farthest)), lambda k: own + k <= last),
        lambda k: F.struct((F.shiftleft(own, 32) + own + k).alias("block"), F.lit(True).alias("own")),
    )
    right = F.transform(
        F.filter(F.sequence(F.lit(max(1, nearest)), F.lit(max(1, farthest))), lambda k: own - k >= 0),
        lambda k: F.struct((F.shiftleft(own - k, 32) + own).alias("block"), F.lit(False).alias("own")),
    )
    return active.select("*", F.inline(F.concat(left, right)))


def _candidates(postings: DataFrame, stars: DataFrame | None, low: int, high: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(u, v) of classes in different components whose postings of some shingle lie `low` to `high` ranks apart; None when no
    shingle reaches as far with postings of different components.
    """
    active = postings.withColumn("root", F.col("class"))
    if stars is not None:
        roots = stars.select(F.col("u").alias("class"), F.col("v").alias("reached"))
        active = postings.join(roots.hint("merge"), "class", "left").withColumn("root", F.coalesce("reached", "class")).drop("reached")
    tokens = active.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("rank").alias("last"))
    tokens = tokens.where((F.col("least") != F.col("most")) & (F.col("last") >= low)).select("token", "last")
    active = scratch.write(active.join(tokens.hint("merge"), "token"), "active")
    if active.isEmpty():
        return None
    # A shingle's postings are dealt to blocks of ranks, and beyond a quarter of a block to pairs of blocks. Both are bounded for any
    # window, so no shingle is hot.
    near = 4 * high <= LEAST_BLOCK
    dealt = _near_blocks(active, high) if near else _far_blocks(active, low, high)
    dealt = dealt.repartition("token", "block").sortWithinPartitions("token", "block", "rank")
    met = dealt.select("token", "block", "class", "n", "place", "before", "root", "own")
    paired = _by_block((_near_pairs if near else _far_pairs)(low, high, percent))
    pairs = scratch.write(met.mapInArrow(paired, "u bigint, v bigint").distinct(), "pairs")
    scratch.drop(active)
    return pairs


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, set_class (the same for equal sets), component_id.

    Documents link when 100 * shared >= percent * union of their shingles. component_id is the smallest id that links reach. Missing,
    empty and white-space texts have no shingles, link with nothing and are their own component. Rows without an id take part
    and get the smallest id they reach, missing if there is none. Repeated rows come out as often as they come in.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    levels = spark.sparkContext.broadcast(frequency_levels(docs, text_column, width))
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, class bigint, matches int, prefix array<bigint>"
    members = scratch.write(narrow.mapInArrow(_prefixes(width, percent, levels), schema), "members")
    levels.destroy()
    named = members.where("class is not null").groupBy("class").agg(F.min("id").alias("id"))
    once = members.where("prefix is not null").select("class", "n", "matches", "prefix").dropDuplicates(["class"])
    classes = scratch.write(once.join(named, "class"), "classes")
    # From here on the rows need no prefixes.
    wide, members = members, scratch.write(members.select("id", "n", "class"), "members")
    scratch.drop(wide)
    named = classes.select("class", "id")
    first = (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("int")
    postings = classes.select(F.posexplode(F.slice("prefix", 1, first)).alias("place", "token"), "class", "n")
    postings = postings.select("token", "class", "n", F.col("place").cast("bigint").alias("place"))
    postings = postings.repartition("token").sortWithinPartitions("token", "n", "class")
    schema = "token bigint, class bigint, n bigint, place bigint, rank bigint"
    postings = postings.mapInArrow(_ranked, schema)
    # The shared shingle that comes before in the class's own order.
    own_order = Window.partitionBy("class").orderBy("place")
    postings = scratch.write(postings.withColumn("before", F.coalesce(F.lag("token").over(own_order), F.lit(0))), "postings")
    fetched: list[DataFrame] = []

    def sets(ends: DataFrame) -> DataFrame:
        missing = ends
        for part in fetched:
            missing = missing.join(part.select("class"), "class", "left_anti")
        wanted = scratch.write(missing.join(classes.select("class", "id"), "class"), "wanted")
        if not wanted.isEmpty():
            fetched.append(_whole_sets(docs, id_column, text_column, width, wanted, scratch))
        scratch.drop(wanted)
        whole = fetched[0]
        for part in fetched[1:]:
            whole = whole.union(part)
        return whole

    stars = None
    low, high = 1, FIRST_WINDOW
    while (pairs := _candidates(postings, stars, low, high, percent, scratch)) is not None:
        fresh = _linked(pairs, classes, sets, percent, scratch)
        if not fresh.isEmpty():
            stars = components(fresh if stars is None else stars.union(fresh), scratch)
        scratch.drop(pairs)
        low, high = high + 1, high * WINDOW_GROWTH

    result = members.select("id", "n", "class")
    if stars is None:
        groups = named.select("class", F.col("id").alias("component_id"))
    else:
        rooted = named.join(stars.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left")
        rooted = rooted.select("class", "id", F.coalesce("root", "class").alias("root"))
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        groups = rooted.join(least, "root").select("class", "component_id")
    groups = scratch.write(groups, "groups")
    scratch.keep_only(members, groups)
    found = result.join(groups, "class", "left")
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.col("class").alias("set_class"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
