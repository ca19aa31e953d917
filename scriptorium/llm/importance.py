"""Target-distribution importance resampling: a share of the documents, drawn with chances by how much they look like a target.

Features are runs of one to three consecutive words of the lower-cased (A-Z) text, in hashed buckets. A bucket's gain is
the log ratio of its share in the target to its share in the documents, in thousandths and rounded down; a document's
weight is the sum of the gains of its features. Adding seeded Gumbel noise by doc_id and taking the highest scores draws
without replacement, with chances in proportion to exp(weight / 1000).

One pass counts buckets (a task sends one row a bucket), one scores all documents from an array of gains, a fixed number
of them. Scores are integers, so an exact histogram of them stands for the documents: a row for each score, added up
from the highest on in ranges, gives how many documents stand before it. What survives are the scores that begin within
the draw; the last of them is the cutoff. Within each surviving score documents are numbered by doc_id. Nothing is sorted
but the histogram and the documents that survive, and both go by ranges, so that a score that many documents share (rows
that repeat an id) is no task of its own.

A null text counts as empty: no features, weight 0, not drawn. Documents with fewer than `least_words` words get a score
but no rank. A null doc_id draws its noise as an empty one, and stands first within its score. Rows that repeat an id are
scored and ranked each; among those of one id and score, which is first is open. An empty target has no counts, so rarer
features gain. An empty table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_batches, whole_text, written
from .running import SUM, running

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42

#: Lower-cases A-Z; any other ASCII byte that is neither a letter nor a digit parts words.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in LOWER + "0123456789" else ord(chr(b).lower()) if chr(b) in UPPER else 0x20 for b in range(256))


def features(text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of up to `longest` words: its bytes' crc32, modulo. A run's crc32
    goes on from that of the run without its last word."""
    words = text.encode().translate(_WORD_BYTES).split()
    n = len(words)
    sums = np.fromiter(map(crc32, words), np.uint32, n)
    found, after = [sums], [b" " + w for w in words]
    for length in range(2, min(longest, n) + 1):
        sums = np.fromiter(map(crc32, islice(after, length - 1, None), sums.tolist()), np.uint32, n - length + 1)
        found.append(sums)
    return n, np.concatenate(found) % np.uint32(buckets)


def bucket_counts(frame: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task counts its own texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(features(t.as_py(), buckets, longest)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    small_batches(frame.sparkSession)
    counted = frame.select(whole_text(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():  # one row a bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from the counts of both sides."""
    up = (target + 1.0) * (source.sum() + len(source))
    down = (source + 1.0) * (target.sum() + len(target))
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def scored(documents: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words, found = features(t.as_py(), len(gain), longest)
                rows.append((words, len(found), int(gain[found].sum())))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(chance)))
    return weighed.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of scored() with rank: 1 for the highest score, for the share that is drawn; else null."""
    rows = written(rows, "scored")
    fit = F.col("n_words") >= least_words
    # A row for each score that occurs, and the number of documents up to it, from the highest score on.
    histogram = rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    summed = written(running(histogram, [F.col("score").desc()], [], {"upto": ("n", SUM)}, ["score", "n"], "histogram"), "suffix_sums")
    room = (summed.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n")).first()["n"] * percent) // 100
    surviving = summed.where(F.col("upto") - F.col("n") < room)
    cutoff = surviving.agg(F.min("score").alias("score")).first()["score"]
    empty = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return rows.select("*", empty)
    best = rows.where(fit & (F.col("score") >= cutoff)).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("score"), F.col("doc_id").asc_nulls_first()]
    numbered = running(best, order, ["score"], {"place": ("one", SUM)}, rows.columns, "best")
    rank = F.col("before") + F.col("place")
    met = numbered.join(surviving.select("score", (F.col("upto") - F.col("n")).alias("before")), "score")
    return met.select(*rows.columns, F.when(rank <= room, rank).alias("rank")).unionByName(rows.where(~fit | (F.col("score") < cutoff)).select("*", empty))


def resample(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn towards the target's texts."""
    gain = gains(bucket_counts(documents, text, buckets), bucket_counts(target, target_text, buckets))
    return drawn(scored(documents, gain, doc_id, text, seed=seed), percent, least_words)
