"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from scriptorium.llm import importance
from scriptorium.llm.queries import QUERIES

WORDS = ["ana", "Ben", "čar", "D0b", "ena", "fin", "gol", "hit", "iva", "jug", "ŠUM"]


def runs_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_brute_force(docs, items):
    s, t = Counter(), Counter()
    for counts, rows in ((s, docs), (t, items)):
        for _, text in rows:
            counts.update(runs_of(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, found = runs_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-r[4], -1 if r[0] is None else r[0]) for r in rows if r[1] >= 20)
    ranks = {}
    for i, key in enumerate(fit[: 5 * len(fit) // 100], 1):
        ranks.setdefault(key, []).append(i)
    out = []
    for r in rows:
        own = ranks.get((-r[4], -1 if r[0] is None else r[0]), []) if r[1] >= 20 else []
        out.append((r[0], *r[2:], own.pop(0) if own else None))
    return sorted(out, key=str)


def some_rows(seed, n=400):
    draw = random.Random(seed)
    prose = lambda k: draw.choice([" ", "\n", "-", " \x1c"]).join(draw.choice(WORDS) + str(draw.randrange(9)) for _ in range(k))
    docs = [(i * 7, prose(draw.randrange(60))) for i in range(n)]
    docs += [(1, None), (2, ""), (3, " .;\t"), (4, "one"), (5, "one two"), (6, prose(9000)), (None, prose(30)), (None, prose(30))]
    docs += [(50_001, docs[40][1])] * 60  # one id, one score, many rows
    return docs, [(i, prose(25)) for i in range(12)] + [(99, None)]


def found(spark, docs, items, schema="doc_id long, text string", rows=None):
    left, right = spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    drawn = importance.resample(left, right).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, drawn.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling_equals_brute_force(spark, seed):
    docs, items = some_rows(seed)
    assert found(spark, docs, items) == by_brute_force(docs, items)


def test_many_rows_of_one_score_are_ranked_each(spark):
    text = " ".join(WORDS * 3)
    docs = [(1, text)] * 300 + [(2, text + " x")] * 100
    got = found(spark, docs, [(1, text)])
    assert got == by_brute_force(docs, [(1, text)])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))


def test_odd_tables(spark):
    docs, items = some_rows(3, 60)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == by_brute_force(docs, [])
    few = [(i, "short text") for i in range(50)]
    assert found(spark, few, items) == by_brute_force(few, items)
    assert all(r[4] is None for r in found(spark, few, items))


def test_clashing_columns_are_not_read(spark):
    docs, items = some_rows(4, 50)
    plain, target = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    odd = plain.selectExpr("*", "'x' as score", "'y' as rank", "1 as n", "2 as one", "3 as weight", "4 as upto")
    rows = [sorted(map(tuple, importance.resample(d, target).collect()), key=str) for d in (plain, odd)]
    assert rows[0] == rows[1]


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    read = lambda name, *cs: [tuple(r) for r in spark.read.parquet(f"{data}/{name}.parquet").select(*cs).collect()]
    expected = by_brute_force(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    ours = QUERIES["op13_importance"](spark, data).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, ours.collect()), key=str) == expected


def test_target_like_documents_are_drawn(spark):
    """Texts in the target's words are drawn far more often than their share."""
    draw = random.Random(9)
    like = [" ".join(draw.choice(WORDS[:4]) for _ in range(40)) for _ in range(40)]
    other = [" ".join(draw.choice(WORDS[4:]) for _ in range(40)) for _ in range(760)]
    docs = list(enumerate(like + other))
    got = found(spark, docs, [(0, " ".join(draw.choice(WORDS[:4]) for _ in range(500)))])
    assert sum(r[4] is not None for r in got) == 40 and sum(r[0] < 40 for r in got if r[4]) >= 38
