"""Near copies by exact Jaccard similarity of five-word shingles, for the pipeline's near-dedup stage.

Candidates come from two sides. SimHash components (`simhash.grouped`, four bits) give each member with the smallest of
its component. At similarity 0.8 fingerprints differ in some ten of 64 bits, and no cut of 64 bits into blocks that finds
such a distance is selective; so MinHash gives the rest: BANDS keys of ROWS least shingle hashes, which find a pair at
similarity s with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8.

Every candidate is verified on its set of shingles before it becomes a link. Texts of a band first meet only one of
them, that which stands beside most texts in all its bands: of a group of copies the one in its middle. So a large group
costs as many comparisons as it has members. What this leaves in several components is compared band by band inside a
task: the band's sets are an inverted index, each text outside the band's largest component counts what it has in common
with all others, and the task passes on links that join components, fewer than it has texts. The texts of the largest
component and the rest are dealt into blocks of BLOCK; those of the largest component stand in one task for each block
of the rest, as a rule one. No link is lost, and no pairs are made into rows.

An empty table has no rows to return; rows that repeat (one id, one text) are one row. Texts of equal words are one node. A text of fewer than SHINGLE words is one shingle, an empty one has none and is like
no other. Rows without doc_id take no part. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, discard, gram_hashes, mix, small_batches, whole_text, written
from .simhash import Forest, components, grouped, shingle_bits

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Shingles that are hashed at a time, and texts of a band that one task compares.
PART, BLOCK = 2048, 2000
_DRAW = np.random.default_rng(7)
_TIMES, _PLUS = (_DRAW.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def _words(text: str) -> list[bytes]:
    return text.encode().translate(ASCII_LOWER).split()


def shingles(text: str) -> set[tuple[bytes, ...]]:
    words = _words(text)
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a text by its shingles' hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), PART):
        np.minimum(least, (hashes[at : at + PART, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ row)
    return keys.view(np.int64).tolist()


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            words = _words(text)
            hashes = known.of(words)
            grams = gram_hashes(hashes, min(SHINGLE, len(words))) if words else hashes
            rows.append((xxhash.xxh128_hexdigest(b" ".join(words)), len(np.unique(grams)), shingle_bits(words, SHINGLE), bands(grams)))
        out = pd.DataFrame(rows, columns=["node", "size", "bits", "bands"])
        yield out.assign(doc_id=batch["doc_id"].to_numpy(), text_key=batch["text_key"].to_numpy())


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        found = []
        for text in batch["text"]:
            words = _words(text)
            found.append(np.unique(gram_hashes(known.of(words), min(SHINGLE, len(words)))).view(np.int64) if words else np.empty(0, np.int64))
        yield pd.DataFrame({"node": batch["node"], "shingles": found})


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether sets of these sizes with so much in common are similar enough."""
    return (common > 0) & (common >= least * (a + b - common) - 1e-9)


def joining_links(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links between texts of different components that are similar, fewer than texts, so that all such links
    lie within the closure of these and the components. side: with two sides, texts of one only meet those of the other."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders, first = owner[order], np.append(0, np.cumsum(np.bincount(term)))
    _, group = np.unique(component, return_inverse=True)
    forest = Forest(len(sets))
    by_group = np.argsort(group, kind="stable")
    same = group[by_group][1:] == group[by_group][:-1]
    forest.link(by_group[:-1][same], by_group[1:][same])  # what is in one component already
    forest.left, forest.right = [], []
    largest = np.bincount(group).argmax()
    starts = np.append(0, np.cumsum(size))
    for x in np.flatnonzero(group != largest).tolist():
        own = term[starts[x] : starts[x + 1]]
        lo, count = first[own], first[own + 1] - first[own]
        at = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        met = np.flatnonzero(similar(common, size, size[x]) & (group != group[x]))
        if side.any():
            met = met[side[met] != side[x]]
        if len(met):
            forest.link(np.full(len(met), x), met)
    return forest.links()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (left, right) whose sets are similar enough; sets: node, size, shingles."""
    sizes = sets.select("node", "size")
    fit = pairs.join(sizes.toDF("left", "m"), "left").join(sizes.toDF("right", "n"), "right")
    fit = fit.where(F.least("m", "n") >= F.lit(SIMILARITY) * F.greatest("m", "n") - 1e-9).select("left", "right")
    body = sets.select("node", "shingles")
    both = fit.join(body.toDF("left", "a"), "left").join(body.toDF("right", "b"), "right")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(batch["a"], batch["b"], strict=True)])
            keep = similar(common, batch["a"].str.len().to_numpy(), batch["b"].str.len().to_numpy())
            yield batch.loc[keep, ["left", "right"]]

    return both.mapInPandas(compare, "left string, right string")


def _across(shared: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (left, right) between texts that share a band and stand in different components; shared: key and node."""
    own = shared.select("key", "node").join(member.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = own.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("most")).where("all > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("most.c").alias("largest"), blocks(F.col("all") - F.col("most.n")).alias("odd_blocks"), blocks(F.col("most.n")).alias("blocks"))
    rows = own.join(mixed, "key").withColumn("odd", F.col("c") != F.col("largest"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("odd_blocks")).otherwise(F.col("blocks"))).cast("int")
    rows = rows.withColumn("block", block)
    # Texts of the largest component meet only the others: each stands in one task for each block of those, of which there
    # is one as a rule. The others meet the largest component's blocks and each other.
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    odd = F.concat(upto("blocks", lambda j: place(0, F.col("block"), j)), upto("odd_blocks", lambda o: place(1, F.least("block", o), F.greatest("block", o))))
    places = F.when(F.col("odd"), odd).otherwise(upto("odd_blocks", lambda o: place(0, o, F.col("block"))))
    rows = rows.select("key", "node", "c", "block", "odd", F.explode(places).alias("at")).select("key", "node", "c", "block", "odd", "at.*")
    rows = rows.join(sets.select("node", "shingles"), "node")

    def link(key: tuple, group: pa.Table) -> pa.Table:
        nodes = group["node"].to_pylist()
        _, component = np.unique(np.array(group["c"].to_pylist()), return_inverse=True)
        _, kind, i, j = (k.as_py() for k in key)
        side = group["odd"].to_numpy(zero_copy_only=False).astype(int) if kind == 0 else (group["block"].to_numpy() == j).astype(int) * (i != j)
        left, right = joining_links([s.values.to_numpy() for s in group["shingles"]], component, side)
        return pa.table({"left": pa.array([nodes[i] for i in left], pa.string()), "right": pa.array([nodes[i] for i in right], pa.string())})

    return rows.groupBy("key", "kind", "i", "j").applyInArrow(link, "left string, right string").distinct()


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text): one row of each group of near copies, that with the smallest doc_id."""
    small_batches(documents.sparkSession)
    keyed = documents.where("doc_id is not null").select(F.col("doc_id"), whole_text().alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = written(keyed.mapInPandas(_signed, "node string, size long, bits long, bands array<long>, doc_id long, text_key long"), "near-signed")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "size", "bits", "bands")).alias("of")).select("node", "of.*")
    nodes = written(nodes, "near-nodes")
    discard(signed)

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    shared = written(buckets.join(several, "key"), "near-bands")
    beside = shared.groupBy("node").agg(F.sum("texts").alias("beside"))
    middle = shared.join(beside, "node").groupBy("key").agg(F.max(F.struct("beside", "node"))["node"].alias("middle"))
    by_bits = grouped(nodes.select(F.col("node").alias("doc_id"), "bits"))
    pairs = shared.join(middle, "key").select(F.greatest("node", "middle").alias("left"), F.least("node", "middle").alias("right"))
    pairs = pairs.union(by_bits.select("doc_id", "component_id")).where("left != right").distinct()
    pairs = written(pairs, "near-pairs")

    # The sets of candidates only; a text_key beside the id, as ids may repeat.
    asked = pairs.select("left").union(pairs.select("right")).union(shared.select("node")).distinct().toDF("node")
    asked = nodes.join(asked, "node", "left_semi").select("node", "size", "doc_id", "text_key")
    texts = keyed.join(asked, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")
    sets = written(texts.mapInPandas(_sets, "node string, shingles array<long>").withColumn("size", F.size("shingles")), "near-sets")

    linked = written(_verified(pairs, sets), "near-links")
    discard(pairs)
    member = written(components(nodes.select("node"), linked), "near-members")
    more = written(_across(shared, member, sets), "near-more")
    discard(shared, sets)
    member = components(nodes.select("node"), linked.union(more))

    named = nodes.join(member, "node", "left").select(F.coalesce("component", "node").alias("component"), "doc_id", "text_key")
    return named.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("of")).select("of.*")
