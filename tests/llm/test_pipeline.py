"""The queries over the small tables, and the pipeline stage by stage against what each must keep."""

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import toxicity
from scriptorium.llm.common import remainder, written
from scriptorium.llm.decontaminate import sequence
from scriptorium.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, name):
    rows = QUERIES[name](spark, DATA)
    source, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    if name.startswith("op5"):
        assert {"doc_id", "item_id"} <= set(rows.columns)
        return
    if name.startswith("op12"):  # a row for each node; conversations end at one node each
        convs = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id")
        assert rows.join(convs, "conv_id", "left_anti").count() == 0
        assert rows.where("depth = 0").first()["n_convs"] == convs.distinct().count()
        return
    there = spark.read.parquet(f"{DATA}/{source}.parquet").select(key)
    assert rows.select(key).exceptAll(there).count() == 0 and rows.count() == there.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = QUERIES[name](spark, DATA)
    theirs = con.sql(ORACLE_SQL[name])
    order = [theirs.columns.index(c) for c in rows.columns]
    assert sorted(map(repr, (tuple(r) for r in rows.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in theirs.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [b" ".join(sequence(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, DATA), name)
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        if name != "byte_bpe":
            assert kept.columns == columns
        if name == "simhash_near_dedup":
            assert kept.select("text").distinct().count() == kept.count()
        if name == "decontamination":
            leaks = {r["doc_id"] for r in docs.collect() if any(b" " + i + b" " in b" " + b" ".join(sequence(r["text"])) + b" " for i in items)}
            assert leaks and not leaks & {r["doc_id"] for r in kept.collect()}
            assert kept.count() == docs.count() - len(leaks)
        docs = kept
    assert docs.where("not round_trip").count() == 0
    assert 0.6 * spark.read.parquet(f"{DATA}/documents.parquet").count() < docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(draw, n):
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA).withColumn("kept", F.lit("old"))


def test_toxicity_stage_equals_brute_force(spark, tmp_path):
    """Documents that go are those whose score, by the cosine to every example, is 0.7 or more."""
    draw = random.Random(3)
    bad = ["scum", "moron", "idiot"]
    rows = [(i, words_of(draw, 30) + (f" {draw.choice(bad)} {words_of(draw, 5)} {draw.choice(bad)}" if i % 4 == 0 else "")) for i in range(240)]
    rows += [(1000, None), (1001, ""), (None, "moron moron"), (7, words_of(draw, 9)), (1002, "x" * 30_000)]
    docs = documents(spark, rows)
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    index = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), remainder("doc_id", 3) != 1)

    def score(text):
        ids, weights = index.vector(toxicity.terms_of(text or ""))
        term = np.repeat(np.repeat(np.arange(len(index.terms)), np.diff(index.first)), index.end - index.start)
        matrix = np.zeros((len(index.terms), index.size))
        matrix[term, index.entry] = index.value
        matrix[index.row[:-1] >= 0] = index.common
        cosines = np.round(weights @ matrix[ids], 12)
        best = np.lexsort((np.arange(index.size), -cosines))[: index.k]
        best = best[cosines[best] > 0]
        return index.probability(best, cosines[best])

    want = [(i, t) for i, t in rows if score(t) < 0.7]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, want))
    assert all(i % 4 for i, _ in want if i is not None and i < 240) and sum(i is not None and i < 240 for i, _ in want) == 181


def test_substring_stage_equals_brute_force(spark):
    draw = random.Random(5)
    passages = [words_of(draw, 60) for _ in range(4)]
    rows = [(i, f"{words_of(draw, 20)} {draw.choice(passages)} {words_of(draw, 20)}") for i in range(30)] + [(40, passages[0]), (41, None), (42, ""), (None, passages[1]), (5, "one two")]
    kept = {(r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, documents(spark, rows), "").collect()}
    first, want = {}, set()
    for i, text in sorted((i, t) for i, t in rows if i is not None and t):
        own = text.split()
        for s in range(len(own) - 19):
            first.setdefault(tuple(own[s : s + 20]), i)
    for i, text in rows:
        own, gone = (text or "").split(), set()
        for s in range(len(own) - 19 if i is not None else 0):
            if first[tuple(own[s : s + 20])] < i:
                gone.update(range(s, s + 20))
        left = " ".join(w for k, w in enumerate(own) if k not in gone) if gone else text
        if not gone or left:
            want.add((i, left, None if left is None else len(left)))
    assert kept == want and len(want) == len(rows) - 1


def edits(item, text):
    """The smallest edit distance of the item to any passage of the text, by words."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (w != x)))
    return min(row)


@pytest.mark.parametrize("share, least", [(0.1, 0.99), (0.15, 0.97), (0.2, 0.94)])
def test_decontamination_stage_equals_brute_force(spark, tmp_path, share, least):
    """Every document that goes holds an item within a fifth of its words; nearly all that hold one go."""
    draw = random.Random(share)
    items = [(i, words_of(draw, draw.randint(6, 40))) for i in range(60)]
    rows = []
    for i, text in items * 4:
        own = text.split()
        for _ in range(int(share * len(own) + 1e-9)):
            at = draw.randrange(len(own))
            own[at : at + 1] = draw.choice([["zz"], [], [own[at], "zz"]])
        rows.append((len(rows), f"{words_of(draw, 30)} {' '.join(own)} {words_of(draw, 30)}"))
    rows += [(len(rows) + k, words_of(draw, 90)) for k in range(60)] + [(2000, None), (None, items[0][1]), (2001, "")]
    spark.createDataFrame([*items, (98, None), (99, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, documents(spark, rows), str(tmp_path)).collect()}
    held = {(i, t) for i, t in rows if t and any(edits(x.split(), t.split()) <= int(0.2 * len(x.split()) + 1e-9) for _, x in [*items, (99, "w1 w2")])}
    gone = set(rows) - kept
    assert gone <= held and len(gone) >= least * len(held) and len(held) > 200


def test_pipeline_of_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
