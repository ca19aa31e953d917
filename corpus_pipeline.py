"""A corpus pipeline of five stages: toxicity, near-dedup, substring dedup, decontamination, byte-level BPE.

Each stage takes what its predecessor kept, as a written table, and its decisions take effect: rejected documents go,
copies go, repeated passages are cut. All but the last return the columns of documents. Rows without doc_id can't be
told apart: near-dedup and substring dedup leave them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, decontaminate, near_copies, substring_dedup, toxicity
from scriptorium.llm.common import remainder, whole_text, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by examples from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    return toxicity.score(docs.select(*COLUMNS), index).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word Jaccard similarity 0.8 or more), once."""
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(whole_text()))
    kept = keyed.join(near_copies.near_copies(docs), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing is left go."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or kept != ''")
    changed = F.col("n_removed") > 0
    texts = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return cut.withColumns(texts).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each document, and whether decoding the ids gives its text back."""
    coded = byte_bpe.round_trip(docs.select(*COLUMNS))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL can't state these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
