"""N-gram Jaccard join: MinHash LSH forest with exact verification.

A text's set is the hashes of its runs of five words (a shorter text is one run). Texts with equal sets are one node.
Each of ``TREES`` trees orders the nodes by a signature of ``FULL_DEPTH`` MinHash values: sorted signatures are a prefix
trie, whose nodes are runs of rows with an equal prefix. Two nodes of similarity s share a prefix of length d in a tree
with probability s^d, so a node whose prefixes have lengths d_t over the trees misses a similar one with probability
prod(1 - 0.8^d_t) at most.

The length is settled by node and tree, from the data. The floor is the longest length at which all trees together reach
the target recall. A run of at most ``DENSE`` rows is searched at the floor. In a denser run the prefixes stay longer,
until the run is at most ``DENSE`` rows; then the chance of a miss is added up for each node over its trees, and where
it is above what the target leaves, the node's prefixes are shortened to the floor again, the longest first, until the
target is reached: there the node is compared with the whole dense run, in pairs of blocks.

Nodes of a run are compared by one-bit sketches of their MinHash values and by size; what cannot be similar by size, or
is unlikely to be by sketch, is left out (a chance of 0.8e-5 at the threshold, within the target). What remains makes
stars: every node of a connected part of a run is tied to the least one. Every similar pair lies in some star, and stars
whose centres are tied are verified together, so a unit spans two steps from its centre however long a chain of near
copies is. The sets of a unit are compared, all pairs, in numpy; a pair that several units hold counts in the least one.
Only the number of links of each node and a spanning forest of the links come out. Units too large for one task are
split into blocks, and every pair of blocks is a group of its own: nothing is capped and no group is unbounded.

Defined results: null and empty texts, and others without words, are linked to nothing; rows with equal sets are copies
(not links) and share a class; repeated rows and repeated or null ids are rows of their own; an empty table gives no
rows; ids are integers (a text that is no number raises); columns other than id and text are only carried by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.common import bit_filter, bound_batches, discard, in_slices, materialized, may_hold, quoted, released, salted_join, strings
from veilspark.llm.components import components

SHINGLE = 5
#: Similarity 4/5 as a fraction: links have 5 * common >= 4 * union.
NUMERATOR, DENOMINATOR = 4, 5
TREES, FULL_DEPTH, HEAD, RECALL = 26, 8, 4, 0.9999
SKETCH = 128
#: Sketch bits that two nodes of similarity 0.8 share, less 4.7 standard deviations: fewer have a chance of 7.7e-6.
MIN_EQUAL_BITS = 99
#: The chance of a miss that the target leaves to the prefixes, beside the sketch.
MISS = 1 - RECALL - 1e-5
#: Rows of a run searched at the floor, and of a block of a run; nodes and shingles of a block of a unit.
DENSE, UNIT_NODES, UNIT_SHINGLES = 2048, 1024, 1 << 20
#: Runs of a shingle longer than this are counted by matrix products.
LONG_RUN = 24
SEED = 20
BLANKS = " \t\n\x0b\x0c\r"


def prefix_depth(trees: int = TREES, full: int = FULL_DEPTH, miss: float = MISS, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """The floor: the longest prefix on which similar nodes meet in at least one tree but for the given chance."""
    depth = full
    while depth > HEAD + 1 and (1 - similarity**depth) ** trees > miss:
        depth -= 1
    return depth


def miss_of(depth: int | None, similarity: float = NUMERATOR / DENOMINATOR) -> float:
    """Logarithm of the chance that similar nodes do not share a prefix of a length in one tree; None: not searched there."""
    return 0.0 if depth is None else math.log1p(-(similarity**depth))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, joined, and the number of each. Texts have no nulls."""
    trimmed = pc.utf8_trim(texts, BLANKS)
    lists = pc.split_pattern_regex(trimmed, "[\\x20\\x09-\\x0D]+")
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in strings(coded.dictionary, " ")), np.uint64, len(coded.dictionary))
    words = known[coded.indices.to_numpy(zero_copy_only=False)]
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    # The hash of the run that starts at each word; runs that leave their text are not used.
    n, factor = len(words), np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs = runs * factor + words[k : k + len(runs)]
    runs = _mix(runs)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if blank[i]:
            continue
        if b - a < SHINGLE:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * factor + w
            own = _mix(h + np.uint64(b - a))
        else:
            own = np.sort(runs[a : b - SHINGLE + 1])
            own = own[np.r_[True, own[1:] != own[:-1]]]
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), sizes


_random = np.random.default_rng(SEED)
VALUES = TREES * FULL_DEPTH
FACTORS = _random.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LABELS = _random.integers(0, 2**63, FULL_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each set that is not empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), VALUES), np.uint64)
    step = 1 << 16
    if not len(starts):
        return out
    # In pieces that stay in the processor's cache; a set that is cut is put together by minima.
    pieces = np.unique(np.r_[starts, np.arange(0, len(joined), step)])
    owner = np.searchsorted(starts, pieces, side="right") - 1
    whole = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for k in range(VALUES):
        low = np.minimum.reduceat(joined * FACTORS[k], pieces)
        out[:, k] = np.minimum.reduceat(low, whole)
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: row, doc_id, text_hash, size and digest of its set, its signature in every tree, its sketch.

    ``heads`` are hashes of a tree and the first ``HEAD`` values in it, ``tails`` the later values, 16 bits of each.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined, sizes = shingle_sets(b.column(3))
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            digest = np.zeros((2, b.num_rows), np.int64)
            heads, tails = (np.zeros((b.num_rows, TREES), np.int64) for _ in range(2))
            sketch = np.zeros((b.num_rows, 2), np.int64)
            if len(full):
                for k in range(2):
                    digest[k, full] = np.add.reduceat(_mix(joined + np.uint64(k)), starts).view(np.int64)
                values = _mix(signatures(joined, sizes)).reshape(len(full), TREES, FULL_DEPTH)
                h = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(full), TREES))
                for d in range(HEAD):
                    h = _mix(h * LABELS[d] + values[:, :, d])
                heads[full] = h.view(np.int64)
                t = np.zeros((len(full), TREES), np.uint64)
                for d in range(HEAD, FULL_DEPTH):
                    t = (t << np.uint64(16)) | (values[:, :, d] >> np.uint64(48))
                tails[full] = t.view(np.int64)
                bits = np.packbits((values.reshape(len(full), -1)[:, :SKETCH] & np.uint64(1)).astype(np.uint8), axis=1)
                sketch[full] = np.ascontiguousarray(bits).view(np.int64)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TREES)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), *lists, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())],
                ["row", "doc_id", "text_hash", "size", "d0", "d1", "heads", "tails", "s0", "s1"],
            )

    return src.mapInArrow(in_slices(run, 3), "row long, doc_id long, text_hash long, size long, d0 long, d1 long, heads array<long>, tails array<long>, s0 long, s1 long")


def blocked(rows: DataFrame, keys: list[str], blocks: DataFrame, node: str = "node") -> DataFrame:
    """``rows`` dealt into groups ``(keys, low, high)`` with their own ``block``, so that any two rows of a key meet in one group.

    ``blocks`` has ``(keys, n_blocks)`` of the keys that have more than one.
    """
    n = F.coalesce("n_blocks", F.lit(1))
    own = F.when(n > 1, F.pmod(F.xxhash64(node), n)).otherwise(0).cast("int")
    met = salted_join(rows, blocks, keys, node, "left")
    marked = met.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return marked.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("n_blocks", "other")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of every member's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups, with True: rows equal in the first ``keys`` columns are consecutive and never cut.

    With a ``limit``, a group of more rows is not held: it is given in pieces as it comes, with False.
    """
    held, passing = None, None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if passing is not None:
            own = pc.equal(table[0], passing[0])
            for k in range(1, keys):
                own = pc.and_(own, pc.equal(table[k], passing[k]))
            cut = table.num_rows if pc.all(own).as_py() else pc.index(own, False).as_py()
            if cut:
                yield table.slice(0, cut), False
            table = table.slice(cut)
            if not table.num_rows:
                continue
            passing = None
        if held is not None:
            table = pa.concat_tables([held, table])
        last = pc.equal(table[0], table[0][-1])
        for k in range(1, keys):
            last = pc.and_(last, pc.equal(table[k], table[k][-1]))
        cut = pc.index(last, True).as_py()
        whole, held = table.slice(0, cut), table.slice(cut).combine_chunks()
        if limit is not None and whole.num_rows:
            starts = _starts(whole, keys)
            sizes = np.diff(np.r_[starts, whole.num_rows])
            for g in np.flatnonzero(sizes > limit):
                yield whole.slice(int(starts[g]), int(sizes[g])), False
            if (sizes > limit).any():
                whole = whole.filter(pa.array(np.repeat(sizes <= limit, sizes)))
        if whole.num_rows:
            yield whole, True
        if limit is not None and held.num_rows > limit:
            yield held, False
            held, passing = None, [held[k][0] for k in range(keys)]
    if held is not None:
        yield held, True


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stars(starts: np.ndarray, node: np.ndarray, size: np.ndarray, s: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes ``a`` and the least node ``b`` of the connected part of their group that they are alike with, ``b < a``."""
    n = len(node)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    order = np.lexsort((node, group))
    node, size, s = node[order], size[order], s[order]
    sizes = np.diff(np.r_[starts, n])
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = SKETCH - np.bitwise_count(s[i] ^ s[j]).sum(axis=1) >= MIN_EQUAL_BITS
        near &= DENOMINATOR * np.minimum(size[i], size[j]) >= NUMERATOR * np.maximum(size[i], size[j])
        return near if may is None else near & may(order[i], order[j])

    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 8), sizes))
    for o in range(1, 8):
        i = at[at + o < n]
        i = i[group[i] == group[i + o]]
        if not len(i):
            break
        i = i[alike(i, i + o)]
        a.append(node[i + o])
        b.append(node[i])
    for g in np.flatnonzero(sizes > 8):
        m, first = int(sizes[g]), int(starts[g])
        root = np.arange(m)
        for k in range(0, m, 64):  # pairs of 64 members with all later ones, turned into trees at once
            i, j = np.triu_indices(min(64, m - k), 1, m - k)
            i, j = i + k, j + k
            apart = root[i] != root[j]  # only parts that are not tied yet
            i, j = i[apart], j[apart]
            near = alike(first + i, first + j)
            root = _roots(m, np.r_[np.arange(m), i[near]], np.r_[root, j[near]])
            if not root.any():
                break
        odd = np.flatnonzero(root != np.arange(m))
        a.append(node[first + odd])
        b.append(node[first + root[odd]])
    return np.concatenate(a), np.concatenate(b)


LEVEL = ["kind", "bucket", "tail", "a", "b", "s0", "s1"]
STAR, REST, SEARCHED = 0, 1, 2


def _level(rows: DataFrame, depth: int, floor: int, scratch: list[str]) -> DataFrame:
    """Search the runs of an equal prefix of length ``depth`` in rows ``(bucket, tail, node, size, s0, s1)``.

    Gives stars ``(a, b)``, the rows of runs that are too dense, and beyond the floor the rows that were searched.
    A dense run streams by and is never held.
    """
    prefix = F.shiftrightunsigned("tail", 16 * (FULL_DEPTH - depth))
    dealt = rows.repartition("bucket") if depth == floor else rows.repartition("bucket", prefix)
    dealt = dealt.sortWithinPartitions("bucket", "tail", "node").select("bucket", prefix.alias("prefix"), "tail", "node", "size", "s0", "s1")
    limit = DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _groups(batches, 2, limit):
            bucket, _, tail, node, size, s0, s1 = (t.column(k).combine_chunks() for k in range(7))
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), REST, np.int8)), bucket, tail, node, size, s0, s1], LEVEL)
                continue
            s = np.stack([s0.to_numpy(), s1.to_numpy()], axis=1).view(np.uint64)
            a, b = _stars(_starts(t, 2), node.to_numpy(), size.to_numpy(), s)
            blank = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), STAR, np.int8)), blank, blank, pa.array(a), pa.array(b), blank, blank], LEVEL)
            if depth > floor:
                blank = pa.nulls(len(node), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), SEARCHED, np.int8)), bucket, tail, node, blank, blank, blank], LEVEL)

    return materialized(dealt.mapInArrow(released(run), "kind byte, bucket long, tail long, a long, b long, s0 long, s1 long"), "forest", scratch)


def candidate_stars(nodes: DataFrame, scratch: list[str]) -> DataFrame:
    """Stars ``(a, b)`` of the forest, ``b`` the centre: with the target recall every similar pair lies in one."""
    floor = prefix_depth()
    rows = nodes.select(F.inline(F.arrays_zip("heads", "tails")).alias("bucket", "tail"), "node", "size", "s0", "s1")
    found = _level(rows, floor, floor, scratch)
    stars = found.where(F.col("kind") == STAR).select("a", "b")
    left = dense = found.where(F.col("kind") == REST).select("bucket", "tail", F.col("a").alias("node"), F.col("b").alias("size"), "s0", "s1")
    if dense.isEmpty():
        return stars.distinct()
    extra = None  # what a longer prefix adds to a node's logarithm of a miss
    for depth in range(floor + 1, FULL_DEPTH + 1):
        found = _level(left, depth, floor, scratch)
        stars = stars.union(found.where(F.col("kind") == STAR).select("a", "b"))
        left = found.where(F.col("kind") == REST).select("bucket", "tail", F.col("a").alias("node"), F.col("b").alias("size"), "s0", "s1")
        searched = found.where(F.col("kind") == SEARCHED).select("bucket", F.col("a").alias("node"), F.lit(miss_of(depth) - miss_of(floor)).alias("miss"))
        extra = searched if extra is None else extra.union(searched)
    extra = extra.union(left.select("bucket", "node", F.lit(miss_of(None) - miss_of(floor)).alias("miss")))
    # At most TREES rows a node: the largest are taken back to the floor until the rest is within what the target leaves.
    room = math.log(MISS) - TREES * miss_of(floor)
    rest = F.sum("miss").over(W.partitionBy("node").orderBy("miss", "bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    short = materialized(extra.withColumn("rest", rest).where(F.col("rest") > room).select("bucket", "node"), "shortened", scratch)
    if short.isEmpty():
        return stars.distinct()
    fifth = F.shiftrightunsigned("tail", 16 * (FULL_DEPTH - floor))
    marked = dense.withColumn("prefix", fifth).join(short.withColumn("asks", F.lit(True)), ["bucket", "node"], "left")
    marked = materialized(marked.withColumn("asks", F.coalesce("asks", F.lit(False))), "dense", scratch)
    runs = marked.groupBy("bucket", "prefix").agg(F.ceil(F.count(F.lit(1)) / DENSE).alias("n_blocks"), F.max("asks").alias("asked")).where("asked").drop("asked")
    names = ["bucket", "prefix", "low", "high", "block", "node", "size", "s0", "s1", "asks"]
    keys = names[:4]
    pairs = blocked(marked, ["bucket", "prefix"], runs).select(*names).repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _groups(batches, 4):
            low, high, block, node, size, s0, s1 = (t.column(k).to_numpy() for k in range(2, 9))
            asks = t.column(9).to_numpy(zero_copy_only=False)

            def may(i: np.ndarray, j: np.ndarray, one: np.ndarray = low == high, block: np.ndarray = block, asks: np.ndarray = asks) -> np.ndarray:
                return (one[i] | (block[i] != block[j])) & (asks[i] | asks[j])

            a, b = _stars(_starts(t, 4), node, size, np.stack([s0, s1], axis=1).view(np.uint64), may)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return stars.union(pairs.mapInArrow(released(run), "a long, b long")).distinct()


def verification_groups(stars: DataFrame, nodes: DataFrame, scratch: list[str]) -> DataFrame:
    """Per node of a star: node, doc_id, text_hash and ``groups``, its places ``(unit, low, high, block)`` in verification.

    Stars whose centres are tied share a unit; a unit of more than a block is dealt into pairs of blocks.
    """
    least = stars.groupBy("a").agg(F.min("b").alias("unit")).withColumnRenamed("a", "b")
    tied = salted_join(stars, least, ["b"], "a", "left").select("a", "b", F.coalesce("unit", "b").alias("unit"))
    members = tied.select(F.col("a").alias("node"), "unit").union(tied.select(F.col("b").alias("node"), "unit")).distinct()
    members = materialized(members.join(nodes.select("node", "doc_id", "text_hash", "size"), "node"), "members", scratch)
    totals = members.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / UNIT_NODES), F.ceil(F.col("total") / UNIT_SHINGLES))
    dealt = blocked(members, ["unit"], totals.select("unit", blocks.alias("n_blocks")).where("n_blocks > 1"))
    # One row a node: a few units for each tree and block it stands in, and the blocks of these.
    return dealt.groupBy("node", "doc_id", "text_hash").agg(F.collect_list(F.struct("unit", "low", "high", "block")).alias("groups"))


def common_counts(joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many members every two of the sets have in common: short runs of a member pair by pair, long ones by products."""
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(joined, kind="stable")
    values, owner = joined[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    runs = np.diff(np.r_[starts, len(values)])
    counts = np.zeros(m * m, np.int32)
    length = np.repeat(runs, runs)
    run = np.repeat(np.arange(len(runs)), runs)
    at = np.flatnonzero((length > 1) & (length <= LONG_RUN))
    for o in range(1, LONG_RUN):
        i = at[at + o < len(values)]
        i = i[run[i] == run[i + o]]
        if not len(i):
            break
        np.add(counts, np.bincount(owner[i] * m + owner[i + o], minlength=m * m), out=counts, casting="unsafe")
    counts = counts.reshape(m, m)
    long = np.flatnonzero(runs > LONG_RUN)
    for k in range(0, len(long), 4096):
        own = long[k : k + 4096]
        table = np.zeros((m, len(own)), np.float32)
        for c, g in enumerate(own):
            table[owner[starts[g] : starts[g] + runs[g]], c] = 1
        counts += np.triu(table @ table.T, 1).astype(np.int32)
    return counts


def verified_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exact links inside the units: rows ``(node, root, links)``, to be summed and linked over a node's groups.

    ``members`` has ``(node, doc_id, text_hash, groups)``, one row per node.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("text"))
    # A filter of bounded size keeps most other texts out of the join's shuffle.
    n = members.count()
    maybe = may_hold(texts, "__hash", bit_filter(members, "text_hash", n), n).where("__maybe")
    found = maybe.join(members, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash"))).select("node", "groups", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined, sizes = shingle_sets(b.column(2))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(joined.view(np.int64)))], ["node", "groups", "shingles"])

    known = found.mapInArrow(in_slices(sets, 2), "node long, groups array<struct<unit:long,low:int,high:int,block:int>>, shingles array<long>")
    # The units before the own one tell in which of several common units a pair counts.
    earlier = F.array_distinct(F.transform(F.filter("groups", lambda g: g["unit"] < F.col("g.unit")), lambda g: g["unit"]))
    dealt = known.select("node", F.explode("groups").alias("g"), "groups", "shingles").select("g.*", "node", earlier.alias("before"), "shingles")
    keys = ["unit", "low", "high"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _groups(batches, 3):
            starts = _starts(t, 3)
            low, high, block, node = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
            before, lists = t.column(5).combine_chunks(), t.column(6).combine_chunks()
            earlier, from_ = before.values.to_numpy(), before.offsets.to_numpy()
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, np.r_[starts[1:], t.num_rows], strict=True):
                # A repeated row (equal id and text) stands for its node once.
                own = np.arange(a, b)[np.r_[True, node[a + 1 : b] != node[a : b - 1]]]
                if len(own) < 2:
                    continue
                sizes = (offsets[own + 1] - offsets[own]).astype(np.int32)
                joined = np.concatenate([values[offsets[k] : offsets[k + 1]] for k in own])
                common = common_counts(joined, sizes)
                total = sizes[:, None] + sizes[None, :]
                linked = np.triu(DENOMINATOR * common >= NUMERATOR * (total - common), 1) & (common > 0)
                if low[a] != high[a]:
                    linked &= block[own][:, None] != block[own][None, :]
                seen = from_[own + 1] - from_[own]
                if (seen > 0).sum() > 1:
                    linked &= ~_share(np.concatenate([earlier[from_[k] : from_[k + 1]] for k in own]), seen)
                i, j = np.nonzero(linked)
                root = _roots(len(own), i, j)
                degree = np.bincount(i, minlength=len(own)) + np.bincount(j, minlength=len(own))
                some = np.flatnonzero(degree)
                out.append((node[own[some]], node[own[root[some]]], degree[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "root", "links"])

    return dealt.mapInArrow(released(run), "node long, root long, links long")


def _share(joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the lists, given joined, have a value in common, as a square."""
    out = np.zeros((len(sizes), len(sizes)), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values, place = np.unique(joined, return_inverse=True)
    for k in range(0, len(values), 4096):
        part = (place >= k) & (place < k + 4096)
        table = np.zeros((len(sizes), min(4096, len(values) - k)), np.float32)
        table[owner[part], place[part] - k] = 1
        out |= table @ table.T > 0
    return out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join: row, doc_id, text_hash, class_key, class_id, n_links, n_copies of every document.

    ``class_key`` tells classes apart, ``class_id`` is the least id of a class.
    """
    described = materialized(describe(docs, id_col, text_col), "sets")
    first = F.min(F.struct("row", "doc_id", "text_hash", "size", "heads", "tails", "s0", "s1"))
    nodes = described.where("size > 0").groupBy("d0", "d1").agg(first.alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialized(nodes.select("d0", "d1", "least", "copies", F.col("n.row").alias("node"), "n.doc_id", "n.text_hash", "n.size", "n.heads", "n.tails", "n.s0", "n.s1"), "nodes")
    scratch: list[str] = []
    members = materialized(verification_groups(candidate_stars(nodes, scratch), nodes, scratch), "units", scratch)
    links = materialized(verified_links(docs, members, id_col, text_col), "links")
    discard(docs.sparkSession, scratch)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Everything but the documents themselves is a row for each node with a link or a copy.
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = roots.join(degrees, "node").join(nodes.select("node", "least"), "node")
    class_ids = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = salted_join(linked, class_ids, ["root"], "node").select("node", "root", "links", "class_id")
    copied = nodes.where("copies > 1").select("d0", "d1", F.col("node").alias("first"), "least", "copies")
    slim = described.select("row", "doc_id", "text_hash", "size", "d0", "d1")
    met = salted_join(slim, copied, ["d0", "d1"], "row", "left")
    met = met.select("row", "doc_id", "text_hash", F.coalesce("first", "row").alias("node"), F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"), F.coalesce("copies", F.lit(1)).alias("copies"))
    known = salted_join(met, linked, ["node"], "row", "left")
    return known.select(
        "row", "doc_id", "text_hash", F.coalesce("root", "node").alias("class_key"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"),
    )


def class_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (the least id of its class), n_links to other texts, n_copies with an equal set."""
    return classify(docs, id_col, text_col).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: the one of the least id (then text hash); every column of ``docs`` is returned.

    Documents that are alone in their class are not shuffled but for those that a filter of bounded size takes for others.
    """
    rows = materialized(classify(docs, id_col, text_col).select("doc_id", "text_hash", "class_key"), "classes")
    best = rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("b"), F.count(F.lit(1)).alias("n"))
    # At most one row per id and text: different texts of one class never both come first, equal ones share a class.
    # Keys without nulls let the join and the numbering of repeated rows share one shuffle.
    keys = ["__keep_id", "__keep_null", "__keep_hash"]
    best = best.select("class_key", "n", F.coalesce("b.doc_id", F.lit(0)).alias(keys[0]), F.col("b.doc_id").isNull().alias(keys[1]), F.col("b.text_hash").alias(keys[2]))
    several = materialized(best.where("n > 1"), "several")
    crowd = materialized(salted_join(rows, several.select("class_key"), ["class_key"], "text_hash").select("text_hash").distinct(), "crowd")
    n = crowd.count()
    own = F.col(id_col).cast("long")
    marked = docs.withColumns({keys[0]: F.coalesce(own, F.lit(0)), keys[1]: own.isNull(), keys[2]: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    marked = may_hold(marked, keys[2], bit_filter(crowd, "text_hash", n), n)
    alone = marked.where(~F.col("__maybe")).select(*quoted(docs.columns))
    kept = marked.where("__maybe").join(best.select(*keys), keys, "left_semi")
    kept = kept.withColumn("__keep_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))).where("__keep_nth = 1")
    return alone.union(kept.select(*quoted(docs.columns)))
