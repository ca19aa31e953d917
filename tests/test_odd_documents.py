"""Queries of documents against their SQL on odd texts: none, blank, white space of any script, blank lines, abbreviations."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.plans.catalogue import ORACLE_SQL, QUERIES

SPACES = [" ", "\n", "\t", "\r", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff"]
PIECES = [
    *SPACES, "čl. ", "st. ", "st.\n", "br.  ", "best. ", "x_st. ", "²st. ", "e\u0301st. ", "\u203fst. ", "Riječ ", "A", "5", "[1]", ". ", "! ", ".\u2003", ".\x1e", ".\v", "\x01", "\x02",
    "nisam s\u0131guran ", "PREPORUČUJEM ", "That, ", "t.hat ", "\x03", "duga rečenica bez kraja ",
]


def texts() -> list[str | None]:
    draw = random.Random(4)
    odd = [None, "", *SPACES, *(s + "tekst" + s for s in SPACES), *(s * 2300 for s in SPACES[:3]), *("x" * n for n in (2000, 2001, 2199, 2200, 2201, 3801))]
    odd += ["a" * n + gap + "b" * 5000 for n in (1000, 1001, 1998, 1999) for gap in ("\n\n", "\n\n\n", "\r\n\n", "\n \n")]
    odd += [s + "riječ " * 500 + s for s in SPACES]
    odd += ["\n\n".join("r" * draw.choice([1, 190, 600, 1001, 2500]) for _ in range(12)) for _ in range(10)]
    odd += ["".join(draw.choices(PIECES, k=draw.choice([5, 40, 300]))) for _ in range(200)]
    odd += ["Aaaa aaaa aaaa aaaa st. st. st. Bbbb bbbb bbbb. Cccc cccc cccc cccc"]
    return odd + [None] * 2


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The folder, and DuckDB on it. Two rows share an id."""
    path = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[max(i, 1), t] for i, t in enumerate(texts())])
    con.sql(f"copy documents to '{path}/documents.parquet' (format parquet)")
    return path, con


@pytest.mark.parametrize("name", ["chunk_fixed", "chunk_stats", "claim_sentences", "rich_text", "search_headline"])
def test_same_rows_of_odd_texts(spark, odd, name):
    path, con = odd
    ours, theirs = QUERIES[name](spark, path), con.sql(ORACLE_SQL[name])
    at = [theirs.columns.index(c) for c in ours.columns]
    assert sorted(repr(tuple(r)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_sentences_strip_and_keep_abbreviations_in_a_row(spark, odd):
    rows = QUERIES["claim_sentences"](spark, odd[0]).where(f"doc_id = {len(texts()) - 3}").orderBy("pos").collect()
    assert [r["sentence"] for r in rows] == ["Aaaa aaaa aaaa aaaa st. st. st. Bbbb bbbb bbbb.", "Cccc cccc cccc cccc"]
    frame = spark.createDataFrame([("\u00a0Prva.\x01 Druga.\v Treća čl.\nČetvrta\u2003",)], "t string")
    assert frame.select(X.sentences(F.col("t"))).first()[0] == ["Prva.\x01 Druga.", "Treća čl.", "Četvrta"]


def test_fixed_chunks_end_at_blank_lines(spark, odd):
    rows = QUERIES["chunk_fixed"](spark, odd[0]).where(f"doc_id = {texts().index('a' * 1001 + chr(10) * 2 + 'b' * 5000)}").collect()
    cut = ["a" * 1001, "a" * 200 + "\n\n" + "b" * 1798, "b" * 2000, "b" * 1602]
    assert [r["digest"] for r in sorted(rows, key=lambda r: r["chunk_index"])] == [hashlib.md5(c.encode()).hexdigest() for c in cut]
