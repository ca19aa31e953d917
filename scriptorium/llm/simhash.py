"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit for each of 64 positions: 1 if more than half of the text's shingles have it set in their
64-bit hash. Equal fingerprints are merged first. The others meet in shards: the 64 bits are cut into six blocks, and
fingerprints that differ in at most four bits agree on at least two of the blocks, so for each of the fifteen pairs of
blocks a fingerprint goes to the shard of its bits there; no link is lost.

In a shard the fingerprints are sorted by Gray rank, so that neighbours share bits. A node of the index is a run of
them with the bits on which all agree (mask and pattern) factored out. Two nodes are compared by the bits that both
have fixed: differences accumulate from the nodes' patterns, and a pair of nodes that already differs in more than four
is pruned with all below. So is a pair whose members all are connected already: neighbours in Gray order are linked
first, and in a family of near copies these few links leave little to compare. What is left at the lowest nodes is
compared as it is. A shard passes on a spanning forest of its links, and of that the links of which it is the first
shard that both ends share; so what it makes grows with its fingerprints, not with their pairs.

Links make components by alternating large-star and small-star steps over tables in the shared folder, so that an
executor's loss costs one step. A component is named after its smallest doc_id.

A null or empty text has fingerprint zero, which links like any other. Fewer than `shingle` words make one shingle of
all. Rows without doc_id get a fingerprint and a component but never name one (null if all its rows lack an id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, small_batches, whole_text, written

SHINGLE, DISTANCE = 4, 4
SEED = 42
#: (shift, width) of the six blocks of a fingerprint.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints of a lowest node, and pairs of nodes that are compared at a time.
LEAF, PAIRS = 8, 8192


def shingle_bits(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    array = np.array(hashes, ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(array), 65_536):  # a very long text, part by part
        counts += np.unpackbits(array[at : at + 65_536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long, bit for bit."""

    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_bits(t.encode().translate(ASCII_LOWER).split(), shingle) for t in batch], dtype="int64")

    return bits(text)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


class Forest:
    """Union-find over positions, many links at a time."""

    def __init__(self, n: int):
        self.above = np.arange(n)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        top = self.above[x]
        while True:
            higher = self.above[top]
            if (higher == top).all():
                return top
            top = higher

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the trees of x and y; of the links, keeps those that joined two."""
        while len(x):
            self.above = self.roots(self.above)
            a, b = self.above[x], self.above[y]
            open_ = a != b
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            if not len(x):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            # Each root goes below one smaller root, by the first link that asks for it; the others try again.
            _, first = np.unique(high, return_index=True)
            self.above[high[first]] = low[first]
            self.left.append(x[first])
            self.right.append(y[first])
            rest = np.ones(len(x), bool)
            rest[first] = False
            x, y = x[rest], y[rest]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Fewer links than positions, with the same closure as all that were made."""
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *self.left]), np.concatenate([empty, *self.right])


def index_levels(sorted_values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(fixed, pattern) of the nodes of each level, from the leaves up, nodes of a level joined two by two.

    fixed: the bits on which all values of a node agree, pattern: their values there.
    """
    edges = np.arange(0, len(sorted_values), LEAF)
    low = np.bitwise_and.reduceat(sorted_values, edges)
    high = np.bitwise_or.reduceat(sorted_values, edges)
    levels = [(~(low ^ high), low)]
    while len(levels[-1][0]) > 1:
        fixed, pattern = levels[-1]
        if len(fixed) % 2:
            fixed, pattern = np.append(fixed, fixed[-1]), np.append(pattern, pattern[-1])
        both = fixed[::2] & fixed[1::2] & ~(pattern[::2] ^ pattern[1::2])
        levels.append((both, pattern[::2] & both))
    return levels


def node_pairs(levels: list[tuple[np.ndarray, np.ndarray]], distance: int, trees: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lowest nodes that may hold links, from the root down; a node with itself too.

    Differences accumulate from the patterns of two nodes: a pair that already differs in more than `distance` is pruned
    with all below, and so is one whose members all are in one tree. trees: by level the tree that holds all of a node, or -1.
    """
    a = b = np.zeros(1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        fixed, pattern = levels[level]
        keep = _ones((pattern[a] ^ pattern[b]) & fixed[a] & fixed[b]) <= distance
        keep &= (trees[level][a] < 0) | (trees[level][a] != trees[level][b])
        a, b = a[keep], b[keep]
        if level:
            size = len(levels[level - 1][0])
            same = a == b
            left = np.concatenate([2 * a, 2 * a[~same] + 1, 2 * a, 2 * a + 1])
            right = np.concatenate([2 * b, 2 * b[~same], 2 * b + 1, 2 * b + 1])
            inside = (left < size) & (right < size)
            a, b = left[inside], right[inside]
    for at in range(0, len(a), PAIRS):
        yield a[at : at + PAIRS], b[at : at + PAIRS]


def near_pairs(sorted_values: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all values of these pairs of lowest nodes that are within `distance` of each other."""
    n = len(sorted_values)
    left = (a[:, None] * LEAF + np.arange(LEAF)).repeat(LEAF, axis=1).ravel()
    right = np.tile(b[:, None] * LEAF + np.arange(LEAF), (1, LEAF)).ravel()
    keep = (right < n) & (left < right)
    left, right = left[keep], right[keep]
    keep = _ones(sorted_values[left] ^ sorted_values[right]) <= distance
    return left[keep], right[keep]


def spanning_links(sorted_values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links, fewer than values, whose closure connects all within `distance`; distinct values in Gray order.

    Neighbours in Gray order are linked first; in a family of near copies they make few trees, so that the index prunes
    most pairs of its nodes and a family costs little more than its size.
    """
    n = len(sorted_values)
    forest = Forest(n)
    for step in range(1, LEAF):
        i = np.arange(max(0, n - step))
        i = i[_ones(sorted_values[i] ^ sorted_values[i + step]) <= distance]
        forest.link(i, i + step)
    if n <= LEAF:
        return forest.links()
    levels = index_levels(sorted_values)
    roots = forest.roots(np.arange(n))
    edges = np.arange(0, n, LEAF)
    low, high = np.minimum.reduceat(roots, edges), np.maximum.reduceat(roots, edges)
    trees = [np.where(low == high, low, -1)]
    for fixed, _ in levels[1:]:
        below = trees[-1]
        if len(below) % 2:
            below = np.append(below, below[-1])
        trees.append(np.where(below[::2] == below[1::2], below[::2], -1)[: len(fixed)])
    for a, b in node_pairs(levels, distance, trees):
        if len(a):
            forest.link(*near_pairs(sorted_values, a, b, distance))
    return forest.links()


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """left, right: pairs of the distinct fingerprints in `bits` whose closure connects all that differ in `distance` bits or fewer (4 at most)."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("six blocks, two of them equal, find up to four differing bits")
    pairs = list(combinations(range(len(BLOCKS)), 2))

    def part(block: int) -> Column:
        shift, width = BLOCKS[block]
        return F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*(F.lit(i << 40) + F.shiftleft(part(x), 11) + part(y) for i, (x, y) in enumerate(pairs)))
    rank = F.col("bits")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # Signed order of ranks is Gray order but for its halves, which swap places.
    dealt = fingerprints.select("bits", rank.alias("rank"), F.explode(keys).alias("shard"))
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "rank").select("shard", "bits")

    masks = np.array([((1 << width) - 1) << shift for shift, width in BLOCKS], np.uint64)

    def first_shard(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The first pair of blocks on which both agree; a link is passed on from there alone, as its ends are connected there."""
        differ = left ^ right
        out = np.full(len(left), len(pairs))
        for i in range(len(pairs) - 1, -1, -1):
            out[(differ & (masks[pairs[i][0]] | masks[pairs[i][1]])) == 0] = i
        return out

    def search(shards: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        """Links of whole shards, side by side in sorted order."""
        found = []
        cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
        sizes = np.diff(np.append(cuts, len(shards)))
        # Small shards all at once: each value with the next ones of its shard.
        small = np.repeat(sizes <= LEAF, sizes)
        forest = Forest(len(values))
        for step in range(1, LEAF):
            i = np.flatnonzero(small[:-step] & (shards[:-step] == shards[step:])) if len(shards) > step else np.empty(0, np.int64)
            i = i[_ones(values[i] ^ values[i + step]) <= distance]
            forest.link(i, i + step)
        found.append(forest.links())
        for at, size in zip(cuts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
            x, y = spanning_links(values[at : at + size], distance)
            found.append((x + at, y + at))
        x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        own = first_shard(values[x], values[y]) == shards[x] >> 40
        return pd.DataFrame({"left": values[x[own]].astype(np.int64), "right": values[y[own]].astype(np.int64)})

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Holds back the last shard of a batch, as the next batch may go on with it."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, values = batch["shard"].to_numpy(), batch["bits"].to_numpy().astype(np.uint64)
            if not len(keys):
                continue
            goes_on = bool(held) and keys[-1] == held[0][0][0]
            done = 0 if goes_on else int(np.searchsorted(keys, keys[-1]))
            if done or (held and not goes_on):
                before = [*held, (keys[:done], values[:done])]
                yield search(*(np.concatenate([b[i] for b in before]) for i in (0, 1)))
                held = []
            held.append((keys[done:], values[done:]))
        if held:
            yield search(*(np.concatenate([b[i] for b in held]) for i in (0, 1)))

    return dealt.mapInPandas(shards, "left long, right long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; nodes of no edge are left out.

    Large-star links each node's larger neighbours to the smallest node around, small-star the smaller ones, until
    nothing changes. A step reads and writes tables; the driver sees one number a step.
    """
    falling = edges.select(F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v"))
    current, before = written(falling.where("u > v").distinct(), "links"), None
    while True:
        around = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v > m").select("v", "m")).distinct()
        old, current = current, written(small, "links")
        discard(old)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, bits, component_id and copies (rows of the same fingerprint), a row for each row of documents."""
    small_batches(documents.sparkSession)
    signed = written(documents.select(F.col(doc_id).alias("doc_id"), fingerprint(whole_text(text), shingle).alias("bits")), "simhash")
    return grouped(signed, distance)


def grouped(signed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """near_duplicates() of rows whose fingerprints are known: doc_id and bits."""
    classes = signed.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    found = links(classes.select("bits"), distance)
    member = components(classes.select("bits"), found)
    named = classes.join(member, classes["bits"] == member["node"], "left").select("bits", "least", "copies", F.coalesce("component", "bits").alias("component"))
    named = written(named, "classes")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = named.join(names, "component").select("bits", "component_id", "copies")
    return signed.join(labelled, "bits").select("doc_id", "bits", "component_id", "copies")
