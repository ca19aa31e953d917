"""Hybrid retrieval: BM25 and dense candidates, rank fusion, exact identifiers, the confidence gate.

The lexical index is three tables: postings (term, id, tf, dl), lengths (id, dl) and terms (term, df, idf). Queries are a
table of their own, so any number of them runs as one job. Ties break by id, descending for BM25, ascending elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LOOKUP_CASE_NUMBER, collapsed, token_list
from ..sources.scratch import written

# Fixed values of the scorer and the gate.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DENSE_LEAST, BM25_LEAST = 0.55, 5.0
#: Vectors of queries that stand beside a chunk of vectors as one row, the vectors of a chunk, and the blocks that are
#: sent to every task; more of them meet the chunks by a shuffle.
QUERY_BLOCK, CHUNK, SENT_BLOCKS = 1_024, 2_048, 32
#: Terms of queries that are sent to every task; more are joined by a shuffle.
MANY_TERMS = 100_000


def ranked(rows: DataFrame, order: Window, k: int, name: str) -> DataFrame:
    """The first k rows of each window partition and their rank from 0. The bound is on the row number itself, so that
    each task keeps k rows of a partition before the shuffle."""
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return first.withColumn(name, (F.col("_n") - 1).cast("int")).drop("_n")


@dataclass
class LexicalIndex:
    """terms and lengths, and either saved postings or the documents' tokens, from which postings of given terms are made."""

    lengths: DataFrame
    terms: DataFrame
    postings: DataFrame | None = None
    tokens: DataFrame | None = None
    #: Of postings in folders: a term's folder, which the postings have as the column `bucket`.
    bucket: Callable[[Column], Column] | None = None

    def of_terms(self, wanted: DataFrame) -> DataFrame:
        """term, id, tf, dl of the wanted terms; of tokens, others go before anything is shuffled."""
        if self.bucket is not None:
            folders = [r["b"] for r in wanted.select(self.bucket(F.col("term")).alias("b")).distinct().collect()]  # as many as there are folders
            return self.postings.where(F.col("bucket").isin(folders)).join(wanted, "term", "left_semi").drop("bucket")
        if self.postings is not None:
            return self.postings.join(wanted, "term", "left_semi")
        each = self.tokens.select("id", "dl", F.explode("tokens").alias("term"))
        return each.join(wanted, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))

    def save(self, path: str) -> None:
        """One table each, replacing what is there: the lexical index is always built anew. Postings are sorted by term for pruning."""
        postings = self.postings
        if postings is None:
            postings = self.tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return LexicalIndex(read("lengths"), read("terms"), postings=read("postings"))


def build_lexical(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Texts are cut into tokens once, into a table; terms are counted per task before the shuffle. idf is
    ln(N - df + .5) - ln(df + .5); where that is negative, a quarter of the mean over all terms."""
    cut = documents.select(F.col(doc_id).alias("id"), token_list(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    tokens = written(cut.select("id", F.size("tokens").cast("long").alias("dl"), "tokens"), "tokens")
    lengths = tokens.select("id", "dl")
    n = lengths.count()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = written(df.withColumn("raw", F.round(F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5), 12)), "terms")
    mean = raw.agg(F.avg("raw").alias("mean"))  # one number
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(lengths, terms, tokens=tokens)


def bounded(frame: DataFrame, most: int) -> DataFrame:
    """The frame, to be sent to every task if it has `most` rows at most."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def bm25(index: LexicalIndex, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, score of the documents that share a term; a term that a query repeats counts as often."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(token_list(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked, "asked")
    names = bounded(asked.select("term").distinct(), MANY_TERMS)
    wanted = asked.join(index.terms.join(names, "term", "left_semi").select("term", "idf"), "term")
    average = index.lengths.agg(F.avg("dl").alias("avgdl"))  # one number
    hits = index.of_terms(names).join(bounded(wanted, MANY_TERMS), "term").join(F.broadcast(average))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_bm25(index: LexicalIndex, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, bm25_score (6 digits) and bm25_rank from 0, of the k best of all documents.

    Documents without a shared term score 0 and only fill up short lists: of them the k largest ids are enough.
    """
    scored = bm25(index, queries, query_id, query).select("query_id", "id", F.round("score", 6).alias("bm25_score"))
    rest = index.lengths.select("id").orderBy(F.desc("id")).limit(k)
    # At most k rows for each query.
    filler = queries.select(F.col(query_id).alias("query_id")).join(F.broadcast(rest)).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
    # A document that scores below zero ranks under the fillers, of which there may be more than k were all kept.
    everything = scored.unionByName(filler.withColumn("bm25_score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), F.desc("id"))
    return ranked(everything, order, k, "bm25_rank")


def top_dense(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, id, dense_score (6 digits) and dense_rank from 0, of the k largest inner products, exactly.

    A stated set of queries meets all vectors: queries are packed into blocks of about QUERY_BLOCK, each a row that stands
    beside the vectors, of which a task takes a batch at a time and multiplies two matrices. The vectors are scanned once
    and not shuffled where the blocks are few enough to be sent to every task; the best k of a query and batch are all that
    is shuffled. Null vectors match nothing. No vectors, or no queries, give no rows.
    """
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast("array<double>").alias("_q"))
    blocks = -(-asked.count() // QUERY_BLOCK)
    packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).alias("_block")).agg(F.collect_list(F.struct("query_id", "_q")).alias("_asked"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_v"))
    # Vectors in chunks of neighbouring rows, so that a block is beside few rows: a row of numbers for some thousand vectors.
    chunks = rows.mapInArrow(_chunked, "ids array<long>, numbers array<double>")
    beside = chunks.crossJoin(F.broadcast(packed) if blocks <= SENT_BLOCKS else packed)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("dense_score", pa.float64())])
        for batch in batches:
            for at in range(batch.num_rows):
                ids = np.asarray(batch.column(0)[at].values)
                own = batch.column(2)[at].values
                names = np.asarray(own.field(0))
                asked, known = (np.asarray(x).reshape(n, -1) for x, n in ((own.field(1).flatten(), len(names)), (batch.column(1)[at].values, len(ids))))
                scores = np.round(asked @ known.T, 6)
                found = [_first(ids, row, k) for row in scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(f) for f in found])), pa.array(ids[np.concatenate(found)]), pa.array(np.concatenate([row[f] for row, f in zip(scores, found, strict=True)]))], schema=schema)

    part = beside.select("ids", "numbers", "_asked").mapInArrow(best, "query_id long, id long, dense_score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "id")
    return ranked(part, order, k, "dense_rank")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            own = batch.slice(at, CHUNK)
            ids, numbers = np.asarray(own.column(0)), np.asarray(own.column(1).flatten())
            yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([numbers])], ["ids", "numbers"])


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], name: str = "embedding", batch: int = 64) -> DataFrame:
    """The rows with the unit vector of their text by an injected model: `embed` takes some texts and gives a row of numbers
    for each. It is called inside tasks, some texts at a time; a null text counts as empty, a zero vector stays zero."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for at in range(0, len(texts), batch):
                own = np.asarray(embed(texts.iloc[at : at + batch].tolist()), np.float64)
                size = np.linalg.norm(own, axis=1, keepdims=True)
                found += list(own / np.where(size > 0, size, 1.0))
            yield pd.Series(found, dtype=object)

    return rows.withColumn(name, vectors(F.coalesce(F.col(text), F.lit(""))))


def save_dense(rows: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], doc_id: str = "id", text: str = "text", *, force: bool = False) -> bool:
    """Writes the dense index (id, embedding) unless it is there; force replaces it. Whether it was written."""
    spark = rows.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dense/_SUCCESS")
    if not force and file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return False
    embedded(rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", embed).select("id", "embedding").write.mode("overwrite").parquet(f"{path}/dense")
    return True


def fused(lexical: DataFrame, dense: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two candidate lists, 6 digits; scores that a side lacks count as 0 to the gate."""
    part = lambda rank: F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))
    return lexical.join(dense, ["query_id", "id"], "full").withColumn("fused_score", F.round(part("bm25_rank") + part("dense_rank"), 6))


def exact_hits(documents: DataFrame, queries: DataFrame, most: int = 3, pattern: str = LOOKUP_CASE_NUMBER, number: str = "case_number", doc_id: str = "id", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, exact_pos: documents whose identifier a query names, first document of each, in the query's order."""
    named = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.regexp_extract_all(query, F.lit(pattern), F.lit(0))).alias("pos", "name"))
    named = named.withColumn("name", collapsed(F.col("name"))).groupBy("query_id", "name").agg(F.min("pos").alias("pos"))
    known = documents.where(F.col(number) != "").groupBy(collapsed(F.col(number)).alias("name")).agg(F.min(doc_id).alias("id"))
    found = named.join(known, "name").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy("pos", "id")
    return ranked(found, order, most, "exact_pos").select("query_id", "id", "exact_pos")


def promoted(hybrid: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Exact hits first, with 10 more than their own score (or 1), then the rest by fused score, cut to k; pos from 0."""
    joined = hybrid.join(exact, ["query_id", "id"], "full")
    hit = F.col("exact_pos").isNotNull()
    joined = joined.withColumn("fused_score", F.when(hit, F.coalesce("fused_score", F.lit(1.0)) + 10.0).otherwise(F.col("fused_score")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("exact_pos"), F.desc("fused_score"), "id")
    return ranked(joined, order, k, "pos")


def gate(queries: DataFrame, hits: DataFrame, dense_least: float = DENSE_LEAST, bm25_least: float = BM25_LEAST) -> DataFrame:
    """query_id, max_dense, max_bm25, exact_match, confident and reason for every query, those without hits too."""
    best = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce("dense_score", F.lit(0.0))).alias("max_dense"),
        F.max(F.coalesce("bm25_score", F.lit(0.0))).alias("max_bm25"),
        F.bool_or(F.col("fused_score") >= 1.0).alias("exact_match"),
    )
    out = queries.select("query_id").join(best, "query_id", "left")
    low = (F.col("max_dense") < dense_least) & (F.col("max_bm25") < bm25_least)
    state: Column = F.when(F.col("n").isNull(), "no hits").when(F.col("exact_match"), "exact case-id match").when(low, "low confidence").otherwise("ok")
    return out.select(
        "query_id",
        F.coalesce("max_dense", F.lit(0.0)).alias("max_dense"),
        F.coalesce("max_bm25", F.lit(0.0)).alias("max_bm25"),
        F.coalesce("exact_match", F.lit(False)).alias("exact_match"),
        state.isin("ok", "exact case-id match").alias("confident"),
        state.alias("reason"),
    )
