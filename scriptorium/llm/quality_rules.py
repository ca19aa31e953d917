"""Quality rules: fixed rules on counts, then a calibrated logistic regression on hashed words and characters.

A text fails the rules if it has fewer than `least_words` words, or if more than `most_repeated` per cent of its words
stand in windows of eight words that the text holds twice or more. What passes is judged by a logistic regression, which
is fitted to labelled rows: hashed words and pairs of words, and hashed runs of three characters, each with 1 + ln(count)
and either kind scaled to length one. A fifth of the labelled rows is kept out of the fit; on it a logistic curve of the
margin is fitted, so that `quality` is a probability in the shares that labels have. Rows are kept from a fixed threshold
on.

Features are made in Arrow batches, and so are scores; the weights, a fixed number, are all that is sent to the tasks.
Both fits are Spark's, by sums over its partitions. They learn from a bounded sample, EXAMPLES labelled rows at most (the
smallest hashes of their ids); their features are a written table of vectors, which the fits read without Python, in
PARTS parts at most: each part holds and sends a sum as long as the weights at every step. A row's features take some ten
times its text, so they are handed over, written and read ROWS rows at a time.

A null or empty text has no words, counts of zero, and fails the rules. Labels that disagree on a doc_id count as the
lower; null labels and labels without a document count as none, and of rows that share a labelled id the smallest text is learned.
With labels of one kind only, quality is that label; with none, it is 1 and the rules alone decide. Repeated rows are
judged each. An empty table gives an empty one. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, WordHashes, gram_hashes, mix, others, small_batches, whole_text, written

#: Labelled rows to learn from at most.
EXAMPLES = 16_384
#: Parts of these rows in the fits at most; rows of features that are handed over and stand in a file at a time; MB of a fit's blocks.
PARTS, ROWS, BLOCK_MB = 12, 128, 0.25
#: Bits of the number of a word feature and of a character feature.
BITS = 15
WINDOW, LEAST_WORDS, MOST_REPEATED, KEEP = 8, 20, 30, 0.5
SYMBOLS = "#*$%&|<>"
STEPS, RIDGE = 60, 1e-4
#: Characters of a text whose runs are counted at a time.
BLOCK = 1 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACES = SPACE_CHARS.encode()


def counts_of(text: str, words: list[bytes], hashes: np.ndarray, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """COUNTS of a text, whose words and their hashes are given."""
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    lines, repeated = set(), 0
    for line in text.encode().split(b"\n"):
        if line.strip(_SPACES):
            repeated += line in lines
            lines.add(line)
    covered = 0
    if len(words) > window:
        _, which, times = np.unique(gram_hashes(hashes, window), return_inverse=True, return_counts=True)
        twice = times[which] > 1
        edges = np.zeros(len(words) + 1, np.int64)
        edges[: len(twice)] += twice
        edges[window : window + len(twice)] -= twice
        covered = int((np.cumsum(edges[:-1]) > 0).sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, covered


def _scaled(places: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(1 << bits, np.int64)
    for some in places:
        counts += np.bincount((some >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    values = 1.0 + np.log(counts[at])
    return at, values / (np.sqrt((values**2).sum()) or 1.0)


def features(text: str, hashes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: first of words and pairs of words, then of runs of three characters."""
    base, spread = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    runs = []
    for at in range(0, max(0, len(text) - 2), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        runs.append(((codes[:-2] * base + codes[1:-1]) * base + codes[2:]) * spread)
    word_at, word_values = _scaled([mix(hashes), gram_hashes(hashes, 2)], bits)
    char_at, char_values = _scaled(runs, bits)
    return np.concatenate([word_at, char_at + (1 << bits)]), np.concatenate([word_values, char_values])


def _hashed(text: str, known: WordHashes) -> tuple[list[bytes], np.ndarray]:
    words = text.encode().split()
    return words, known.of(words)


class Model:
    """Weights by place, and the margin's curve: quality is logistic(slope * margin + shift)."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float, bits: int):
        self.weights, self.slope, self.shift, self.bits = weights, slope, shift, bits

    def arrays(self) -> tuple:
        return self.weights, self.slope, self.shift, self.bits


def _regression(rows: DataFrame, features: str, ridge: float) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", maxIter=STEPS, regParam=ridge, standardization=False, maxBlockSizeInMB=BLOCK_MB).fit(rows)


def fit(documents: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", examples: int = EXAMPLES, bits: int = BITS) -> Model:
    """Learns from the labelled rows for which `learn`, an expression over doc_id, holds."""
    small_batches(documents.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(learn).groupBy("doc_id").agg(F.min((F.col(label) > 0).cast("int")).alias("label"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = documents.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).join(F.broadcast(some), "doc_id")  # at most `examples` rows of two numbers
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    size = 2 << bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            found = [features(t, _hashed(t, known)[1], bits) for t in batch.column(2).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float64()))]
            # The fields of a sparse vector as Spark stores it.
            kind = [pa.array([0] * len(found), pa.int8()), pa.array([size] * len(found), pa.int32())]
            vectors = pa.StructArray.from_arrays([*kind, *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["doc_id", "label", "features"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())])
    learned = written(rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(hashed, schema), "quality_rows", maxRecordsPerFile=ROWS).coalesce(PARTS)
    sizes = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        only = 1.0 if sizes.get(1) or not sizes else 0.0
        return Model(np.zeros(size), 0.0, np.inf if only else -np.inf, bits)
    # Both labels weigh the same in the fit; the curve then sees them as they are.
    balance = F.when(F.col("label") == 1, F.lit(0.5 * sum(sizes.values()) / sizes[1])).otherwise(F.lit(0.5 * sum(sizes.values()) / sizes[0]))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    rows = learned.select(F.col("label").cast("double").alias("label"), "features", balance.alias("weight"), held.alias("held"))
    there = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    fitted = _regression(rows if (False, 0.0) not in there or (False, 1.0) not in there else rows.where("not held"), "features", RIDGE)
    weights, shift = fitted.coefficients.toArray(), float(fitted.intercept)
    if (True, 0.0) not in there or (True, 1.0) not in there:
        return Model(weights, 1.0, shift, bits)
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    margins = fitted.transform(rows.where("held")).select("label", array_to_vector(F.array(margin)).alias("margin"), F.lit(1.0).alias("weight"))
    curve = _regression(margins, "margin", 1e-3)
    slope, level = float(curve.coefficients[0]), float(curve.intercept)
    # A curve that falls would turn the fit around; where so few held rows give one, the fit stands as it is.
    return Model(weights, slope, slope * shift + level, bits) if slope > 0 else Model(weights, 1.0, shift, bits)


def judge(documents: DataFrame, model: Model, text: str = "text", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, keep: float = KEEP) -> DataFrame:
    """The rows with COUNTS, base_failed, quality and kept. One pass, without a shuffle."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model.arrays())
    names = [*COUNTS, "base_failed", "quality", "kept"]
    rest = [c for c in documents.columns if c.lower() not in names]
    rows = documents.select(*others(documents, *names), whole_text(text).alias("_judged"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, shift, bits = sent.value
        known = WordHashes()
        for batch in batches:
            found = []
            for t in batch.column(len(rest)):
                t = t.as_py()
                words, hashes = _hashed(t, known)
                at, values = features(t, hashes, bits)
                with np.errstate(over="ignore"):
                    found.append((*counts_of(t, words, hashes), float(1.0 / (1.0 + np.exp(-(slope * (weights[at] @ values) + shift))))))
            columns = list(zip(*found, strict=True)) or [()] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *arrays], [*batch.schema.names[: len(rest)], *COUNTS, "quality"])

    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("quality", T.DoubleType())])
    judged = rows.mapInArrow(score, schema)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return judged.select(*[f"`{c}`" for c in rest], *COUNTS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= keep)).alias("kept"))
