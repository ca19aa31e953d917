"""The prefix trie against brute force: odd rows, deep and hot conversations, many ranges."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from scriptorium.llm import prefix_trie
from scriptorium.llm.queries import ORACLE_SQL, QUERIES
from scriptorium.llm.running import SUM, XOR, running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_by_brute_force(rows, family=100, inherited=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % inherited
        paths[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, own in members.items():
        saving = (len(own) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += saving
            leaves[node[:d]] += node not in kids
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, convs=300, longest=9, words=4):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "bot"]), "x" * draw.randrange(words) + draw.choice("ačž")) for c in draw.sample([c for c in range(3 * convs) if c not in (7, 8, 100)], convs) for t in range(draw.randrange(1, longest))]
    # No conversation has two rows of one turn here: ties go by hashes.
    rows += [(7, None, None, "first"), (8, 0, "user", None), (None, 0, "user", "of none"), (100, None, "", ""), (-30, 0, "user", "below zero")]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(120) for t in range(4)]  # copies
    rows += [(c, t, "user", f"deep {t}") for c in (2000, 2001, 2050) for t in range(60 + c % 7)]  # deep ones
    draw.shuffle(rows)
    return rows


def found(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    return sorted(map(tuple, prefix_trie.trie(frame).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 9])
def test_trie_equals_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = some_rows(partitions)
        assert found(spark, rows) == nodes_by_brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_intervals_hold_exactly_the_subtree(spark):
    """A node's descendants are the nodes of its interval: those whose interval lies within, and as many as its width."""
    rows = some_rows(5, convs=60)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    nodes = sorted(prefix_trie.trie(frame).select("first", "last", "depth", "n_children").collect())
    assert [n["first"] for n in nodes] == list(range(1, len(nodes) + 1))
    open_ = []
    for n in nodes:
        while open_ and open_[-1]["last"] < n["first"]:
            open_.pop()
        assert len(open_) == n["depth"] and all(o["last"] >= n["last"] for o in open_)
        open_.append(n)
    assert max(n["depth"] for n in nodes) > 50


def test_repeated_and_tied_turns_are_turns_each(spark):
    rows = [(200, 1, "user", "again"), (200, 1, "user", "again"), (200, 1, "user", "again")]
    assert found(spark, rows) == nodes_by_brute_force(rows)
    assert max(r[1] for r in found(spark, rows)) == 3


def test_empty_tables_and_turnless_conversations(spark):
    assert found(spark, []) == []
    h = next(c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, [(h, 0, "user", "cut away")]) == [(h, 0, None, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())]


def test_clashing_columns_are_not_read(spark):
    rows = [(5, 0, "user", "text")]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    odd = plain.selectExpr("*", "'x' as c", "'y' as d", "'z' as p1", "1 as depth", "2 as key")
    assert prefix_trie.trie(odd).collect() == prefix_trie.trie(plain).collect()


def test_light_steps_stay_few(spark):
    """A caterpillar: every conversation leaves the same spine one turn later; keys stay short for all that."""
    n = 40
    rows = [(1000 * c + c, t, "user", f"spine {t}" if t < c else f"own {c}") for c in range(1, n) for t in range(c + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    members = prefix_trie.members_of(prefix_trie.rebuilt(prefix_trie.turns_of(frame)))
    assert found(spark, rows) == nodes_by_brute_force(rows)
    nodes = members.groupBy("d", "p1", "p2").agg({"c": "min"}).count()
    assert nodes > n


def test_running_sums_over_any_ranges(spark):
    draw = random.Random(2)
    rows = [(g, i, draw.randrange(-5, 9)) for i, g in enumerate(sorted([0] * 700 + [draw.randrange(1, 9) for _ in range(300)] + list(range(20, 60))))]
    frame = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        out = sorted(map(tuple, running(frame, [frame.g, frame.i], ["g"], {"s": ("v", SUM), "x": ("v", XOR)}, ["g", "i"]).collect()))
        whole = sorted(map(tuple, running(frame, [frame.i], [], {"s": ("v", SUM)}, ["i"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums, xors, total = defaultdict(int), defaultdict(int), 0
    for (g, i, v), got, all_ in zip(rows, out, whole, strict=True):
        sums[g], xors[g], total = sums[g] + v, xors[g] ^ v, total + v
        assert got == (g, i, sums[g], xors[g]) and all_ == (i, total)


def test_query_equals_sql(spark):
    data = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    theirs = con.sql(ORACLE_SQL["op12_prefix_trie"])
    ours = QUERIES["op12_prefix_trie"](spark, str(data))
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(map(tuple, ours.select(*COLUMNS).collect()), key=str) == sorted((tuple(r[theirs.columns.index(c)] for c in COLUMNS) for r in theirs.fetchall()), key=str)
