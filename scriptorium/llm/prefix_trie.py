"""Conversation prefix trie: how much of their conversations' beginnings a corpus shares.

The turns of a conversation, in order, are a path from the root; conversations that begin alike share nodes. A node is
known by its depth and by two 64-bit sums (exclusive or) of hashes of (place, role, text), which a prefix sum gives for
every turn at once, whatever a conversation's length. (Two different beginnings meet with chance 2^-128.)

Preorder intervals: nodes are ranked by a key in which every subtree is one interval. The child with the most members
(ties: the largest hash) is the heavy child of its node and comes first; a node's key is the list of the light steps on its way,
(last place first, hash), then its own depth. A light step leaves at most half of the members, so a key has at most
log2(conversations) steps however deep the trie is, and keys compare as text. A node's subtree ends at the last position
at which one of its members ends. Leaves and savings of a subtree are differences of prefix sums at its two ends.

Every step is a join or a sum of rows of a few numbers; texts leave the first scan only as hashes and lengths. A hot
conversation, a first turn that a third of all share, or a node that a third of them end at: running sums go by ranges,
maxima and counts are summed per task first, and joins are left to adaptive skew splitting. The hash over a node's ends
needs them in order; ids are joined to chunks by ranges, and one task a node passes its chunks, not ids, through SHA-256
as a stream.

Defined results: turns go by turn, null first, then by the hashes of role and text where turns tie (equal rows stay as
many turns). A null role or text is empty. Rows without conv_id belong to no conversation and are left out. An empty
table gives no nodes, not even a root. Columns of other names are not read; those of the result are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .running import SUM, XOR, running

#: Conversations whose beginnings are taken from the one that opens their family.
FAMILY, INHERITED = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), t1, t2 (hashes of role and text) and chars of every turn, as it stands."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(text, role, F.lit(1)).alias("t2"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    return running(rows, order, ["conv_id"], {"i": ("one", SUM)}, ["conv_id", "t1", "t2", "chars"], "turns")


def rebuilt(turns: DataFrame, family: int = FAMILY, inherited: int = INHERITED) -> DataFrame:
    """c, d (from 1), t1, t2, chars and ends (c's last turn): conversation c as the first h turns of conversation
    c - c % family (the remainder has c's sign), then its own after its first h; h is crc32(c) % inherited. And of each c a row with d = 0."""
    own = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    c = F.col("conv_id")
    convs = own.select(c.alias("c"), "n", (F.crc32(c.cast("string").cast("binary")) % inherited).alias("h"), (c - c % family).alias("base"))
    bases = own.where(c % family == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("c", "n", "h", "base", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    convs = written(convs, "convs")
    columns = ["t1", "t2", "chars", (F.col("d") == F.col("size")).alias("ends")]
    first = turns.where((c % family == 0) & (F.col("i") < inherited)).withColumnRenamed("conv_id", "base")
    taken = convs.where("lent > 0").join(first, "base").where("i <= lent").withColumn("d", F.col("i")).select("c", "d", *columns)
    kept = turns.withColumnRenamed("conv_id", "c").join(convs, "c").where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("lent")).select("c", "d", *columns)
    zero = F.lit(0).cast("long")
    roots = convs.withColumn("d", zero).select("c", "d", zero.alias("t1"), zero.alias("t2"), zero.alias("chars"), columns[-1])
    return taken.unionByName(kept).unionByName(roots)


def _placed(first: str, second: str, salt: int) -> Column:
    """A hash of a turn at its place; none of the root."""
    return F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("d", first, second, F.lit(salt)))


def members_of(paths: DataFrame) -> DataFrame:
    """Of each (c, d): p1, p2, the node; q1, q2, its parent (of the root: null); chars of its last turn; ends."""
    hashed = paths.select("c", "d", "chars", "ends", _placed("t1", "t2", 1).alias("h1"), _placed("t2", "t1", 2).alias("h2"))
    summed = running(hashed, [F.col("c"), F.col("d")], ["c"], {"p1": ("h1", XOR), "p2": ("h2", XOR)}, ["c", "d", "chars", "ends", "h1", "h2"], "paths")
    parent = [F.when(F.col("d") > 0, F.col(p).bitwiseXOR(F.col(h))).alias(q) for p, h, q in (("p1", "h1", "q1"), ("p2", "h2", "q2"))]
    return written(summed.select("c", "d", "chars", "ends", "p1", "p2", *parent), "members")


def _fixed(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def keyed(nodes: DataFrame, kids: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes with `key`, by which they stand in preorder: '1', place, hash of each light step; then '0' and the depth."""
    heavy = kids.select("q1", "q2", F.col("heavy.p1").alias("h1"), F.col("heavy.p2").alias("h2"))
    light = nodes.where("d > 0").join(heavy, ["q1", "q2"]).where("p1 != h1 or p2 != h2").select("d", "p1", "p2")
    # At most log2(conversations) light steps a conversation.
    steps = members.where("d > 0").select("c", "d", "p1", "p2").join(light, ["d", "p1", "p2"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "p1", "p2"))).alias("steps"))
    met = nodes.join(steps.withColumnRenamed("c", "conv_id"), "conv_id", "left")
    way = F.filter(F.coalesce("steps", F.array().cast("array<struct<d:bigint,p1:bigint,p2:bigint>>")), lambda s: s["d"] <= F.col("d"))
    text = F.transform(way, lambda s: F.concat(F.lit("1"), _fixed(F.lit((1 << 48) - 1) - s["d"], 12), _fixed(s["p1"], 16), _fixed(s["p2"], 16)))
    return met.withColumn("key", F.concat(F.array_join(text, ""), F.lit("0"), _fixed(F.col("d"), 12))).drop("steps")


def ends_hashes(members: DataFrame) -> DataFrame:
    """p1, p2 and the SHA-256 over the ids of the conversations that end there, ascending and joined by commas."""
    small_batches(members.sparkSession)
    order = ["d", "p1", "p2", "c"]
    ends = members.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for d, p1, p2, c in zip(*(batch.column(n).to_pylist() for n in order), strict=True):
                rows.setdefault((d, p1, p2), []).append(c)
            out = [(*node, own[0], ",".join(map(str, own))) for node, own in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], [*order, "ids"]) if out else pa.RecordBatch.from_pylist([], pa.schema([*((n, pa.int64()) for n in order), ("ids", pa.string())]))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.int64()) for n in order[:3]), ("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            out = []
            for d, p1, p2, ids in zip(*(batch.column(n).to_pylist() for n in [*order[:3], "ids"]), strict=True):
                if node == (d, p1, p2):
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (d, p1, p2), hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, digest.hexdigest()), strict=True))], schema)

    chunks = ends.mapInArrow(joined, "d long, p1 long, p2 long, c long, ids string").repartition("d", "p1", "p2").sortWithinPartitions(*order)
    return chunks.mapInArrow(digested, "d long, p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, inherited: int = INHERITED) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and its interval of preorder positions, first and last."""
    node = ["d", "p1", "p2"]
    members = members_of(rebuilt(turns_of(conversations), family, inherited))
    nodes = written(members.groupBy(*node).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("chars").alias("chars")), "nodes")
    kids = written(nodes.where("d > 0").groupBy("q1", "q2", (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "p1", "p2")).alias("heavy")), "kids")
    children = kids.select("d", F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    placed = keyed(nodes, kids, members).join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    placed = placed.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"), F.lit(1).cast("long").alias("one"))
    names = [*node, "q1", "q2", "conv_id", "n_convs", "n_children", "leaf", "saving"]
    ordered = running(placed, [F.col("key")], [], {"first": ("one", SUM), "leaves": ("leaf", SUM), "savings": ("saving", SUM)}, names, "preorder")
    # The sums rise with the position, so at the last end of a node's members all three are largest.
    at_end = members.where("ends").select("c", *node).join(ordered.select(*node, "first", "leaves", "savings"), node).select("c", "first", "leaves", "savings")
    last = members.select("c", *node).join(at_end, "c").groupBy(*node).agg(F.max("first").alias("last"), F.max("leaves").alias("leaves_by"), F.max("savings").alias("savings_by"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    found = ordered.join(last, node).join(ends_hashes(members), node, "left").join(parents, ["d", "q1", "q2"], "left")
    return found.select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_by") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("savings_by") - F.col("savings") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        "first",
        "last",
    )
