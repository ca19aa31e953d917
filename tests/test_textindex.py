"""The stored positional index against brute force, over additions, changes and removals."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import token_list
from scriptorium.operators import retrieval, textindex
from scriptorium.operators.textindex import ACCENTED, PLAIN, TextIndex

WORDS = ["sud", "šud", "žalba", "zalba", "odluka", "pravo", "člán", "i", "na", "rok"]
FOLD = str.maketrans(ACCENTED, PLAIN)


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def tokens_by_spark(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    return {r["id"]: r["t"] for r in frame.select("id", token_list(F.coalesce("text", F.lit(""))).alias("t")).collect()}


def check(spark, index, texts, *, fully=False):
    tokens = tokens_by_spark(spark, texts)
    assert {r["id"]: r["dl"] for r in index.lengths().collect()} == {i: len(t) for i, t in tokens.items()}
    for query in ("Žalba sud", "clan pravo rok", "nema toga", "i na")[: 4 if fully else 1]:
        wanted = {t.translate(FOLD) for t in textindex.tokens_of(query, spark)}
        expected = {}
        for i, own in tokens.items():
            plain = [t.translate(FOLD) for t in own]
            if wanted and wanted <= set(plain):
                expected[i] = round(sum(t in wanted for t in plain) / len(plain), 6)
        assert {r["id"]: r["rank"] for r in index.search(query).collect()} == pytest.approx(expected), query
    for query in ("pravo rok pravo", "odluka i na šud", "žalba", "sud sud", "i")[: 5 if fully else 1]:
        wanted = [t.translate(FOLD) for t in textindex.tokens_of(query, spark)]
        expected = {}
        for i, own in tokens.items():
            plain = [t.translate(FOLD) for t in own]
            places = [k for k in range(len(plain) - len(wanted) + 1) if plain[k : k + len(wanted)] == wanted] if wanted else []
            if places:
                expected[i] = places
        assert {r["id"]: r["places"] for r in index.phrase(query).collect()} == expected, query
    asked = spark.createDataFrame([(0, "šud pravo pravo"), (1, "zalba"), (2, "nema")], "query_id long, query string")
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    ours, built = (sorted(map(tuple, retrieval.top_bm25(i, asked, 5).collect())) for i in (index.lexical(), retrieval.build_lexical(frame)))
    assert [r[:2] for r in ours] == [r[:2] for r in built] and [r[2] for r in ours] == pytest.approx([r[2] for r in built])


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_index_over_changes_equals_brute_force(spark, tmp_path):
    draw = random.Random(1)
    texts = {i: prose(draw, draw.randrange(1, 30)) for i in range(120)} | {500: None, 501: "", 502: "sud " * 400}
    index = TextIndex(spark, str(tmp_path / "one"), buckets=8)
    add = lambda rows: index.add(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(2))
    assert add(texts) == 0
    check(spark, index, texts, fully=True)
    before = files(tmp_path / "one")
    changed = {3: "žalba sud", 500: "sud sud", 900: "clan i pravo"}
    assert add(changed) == 1
    texts |= changed
    assert files(tmp_path / "one").items() >= before.items()  # no other segment is touched
    assert add({3: "odluka odluka"}) == 2
    texts[3] = "odluka odluka"
    index.remove(spark.createDataFrame([(7,), (900,), (12345,)], "id long"))
    texts.pop(7), texts.pop(900)
    check(spark, index, texts)
    assert add({900: "sud rok"}) == 4  # one that was removed comes back
    texts[900] = "sud rok"
    compact = index.compact(str(tmp_path / "two"))
    assert len(compact.totals()) == 1
    check(spark, index, texts)
    check(spark, compact, texts)
    assert compact._table("terms").where("df <= 0").count() == 0


def test_a_failed_batch_is_repeated(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    first, second = (spark.createDataFrame([(i, t)], "doc_id long, text string") for i, t in ((1, "sud"), (2, "rok")))
    index.add(first)
    # Postings and lengths of a batch that got no further.
    TextIndex._finish, finish = (lambda self, segment: None), TextIndex._finish
    try:
        index.add(second)
    finally:
        TextIndex._finish = finish
    assert [r["id"] for r in index.lengths().collect()] == [1] and index.search("rok").count() == 0
    assert index.add(second) == 1
    check(spark, index, {1: "sud", 2: "rok"})


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, term string, at string"
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(spark.createDataFrame([], schema))
    assert index.lengths().count() == 0 and index.search("sud").count() == 0 and index.phrase("sud").count() == 0
    index.add(spark.createDataFrame([(1, "sud", "x", "y"), (1, "rok", "x", "y"), (None, "sud", "x", "y")], schema))
    assert index.lengths().count() == 1 and index.search("sud").count() + index.search("rok").count() == 1


def test_a_search_reads_only_its_terms_folders(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=64)
    index.add(spark.range(300).selectExpr("id as doc_id", "concat('sud riječ', id) as text"))
    hits = index.postings(["sud"])
    assert len({Path(f).parent for f in hits.inputFiles()}) <= 64
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "bucket" in scan.partition("PartitionFilters")[2] and "plain" in scan.partition("PushedFilters")[2]
    read = {r["bucket"] for r in hits.select("bucket").distinct().collect()}
    assert len(read) == 1 and hits.count() == 300


def test_kept_indexes_follow_their_files(spark, tmp_path):
    read = lambda: spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text", "_metadata")
    spark.createDataFrame([(1, "sud")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    one, again = (textindex.kept(read(), str(tmp_path)) for _ in range(2))
    assert one is again and one.search("sud").count() == 1
    spark.createDataFrame([(2, "sud")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "docs"))
    assert textindex.kept(read(), str(tmp_path)).search("sud").count() == 2
