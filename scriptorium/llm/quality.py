"""Quality classifier: ordinal regression with a cumulative link on graded ratings.

Grades 0..K share one weight vector over hashed text features; ordered thresholds separate them: the probability of a
grade above g is logistic(weights . features - threshold_g). Features are hashed words (lower case), each with
1 + ln(count), together of length one, and a few of the text's shape: its length, the shares of repeated words and
lines, of letters and of punctuation, and how long its words are. Rows get the expected grade and the probability of a
grade in the tail that is selected.

It is fitted to a bounded sample, EXAMPLES rated rows at most (the smallest hashes of their ids), by full-batch gradient
steps with momentum; what leaves a task is a row's hashed features, DIMENSIONS numbers at most. Scoring is one pass
without a shuffle.

A null text counts as empty: its features are those of its shape. Ratings that disagree on a doc_id count as the
lower; null ratings, and ratings without a document, count as none. With no ratings, or all of one grade, every row
gets that grade (0 with none). Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, small_batches, whole_text

EXAMPLES, DIMENSIONS = 6_000, 4_096
SHAPES = 9
STEPS, RATE, RIDGE = 300, 2.0, 2e-4
KEEP = 0.5


def features(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values; the last SHAPES positions are the text's shape."""
    words = re.findall(r"\w+", text.lower())
    counts = Counter(words)
    sums: dict[int, float] = {}
    for word, n in counts.items():
        h = xxhash.xxh64_intdigest(word)
        sums[h % dimensions] = sums.get(h % dimensions, 0.0) + (1.0 + np.log(n)) * (1 if h >> 63 else -1)
    size = np.sqrt(sum(v * v for v in sums.values())) or 1.0
    lines = [line for line in text.split("\n") if line.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    shape = [
        1.0,
        np.log1p(len(words)) / 8.0,
        1.0 - len(counts) / n,
        max(counts.values(), default=0) / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isalpha, text)) / chars,
        sum(map(str.isdigit, text)) / chars,
        sum(not (c.isalnum() or c.isspace()) for c in text) / chars,
        min(20.0, chars / n) / 20.0,
    ]
    at = np.array([*sums, *range(dimensions, dimensions + SHAPES)], np.int32)
    return at, np.array([*(v / size for v in sums.values()), *shape], np.float32)


class Ordinal:
    """Weights and rising thresholds."""

    def __init__(self, grades: int, dimensions: int = DIMENSIONS):
        self.weights, self.cuts = np.zeros(dimensions + SHAPES), np.zeros(max(0, grades - 1))
        self.grades = grades

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS) -> Ordinal:
        if self.grades < 2 or not rows:
            return self
        row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
        over = grades[:, None] > np.arange(self.grades - 1)  # a rating above each threshold
        share = np.clip(over.mean(axis=0), 1e-3, 1 - 1e-3)
        first, gaps = -np.log(share / (1 - share))[0], np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2)
        theta = np.concatenate([self.weights, [first], np.log(gaps)])
        m, n = len(self.weights), len(rows)
        # Grades weigh the same on the whole, however many rows have them.
        weight = (1.0 / np.maximum(np.bincount(grades, minlength=self.grades), 1))[grades]
        weight /= weight.mean()
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            w, first, gaps = theta[:m], theta[m], np.exp(theta[m + 1 :])
            cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(row, value * w[at], n)
            p = 1.0 / (1.0 + np.exp(-(score[:, None] - cuts)))  # chance of a grade above each threshold
            # Chance of the own grade is the difference of two neighbours; its gradient by score and thresholds.
            full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
            slope = full * (1 - full)
            own = np.arange(n)
            chance = np.maximum(full[own, grades] - full[own, grades + 1], 1e-9)
            by_score = -(slope[own, grades] - slope[own, grades + 1]) / chance * weight
            by_cut = np.zeros((n, self.grades + 1))
            by_cut[own, grades] += slope[own, grades] / chance * weight
            by_cut[own, grades + 1] -= slope[own, grades + 1] / chance * weight
            cut = by_cut[:, 1:-1].sum(axis=0) / n
            gradient = np.concatenate([np.bincount(at, value * by_score[row], m) / n + RIDGE * w, [cut.sum()], cut[::-1].cumsum()[::-1][1:] * gaps])
            m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
            theta = theta - 0.05 * RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        self.weights = theta[:m]
        self.cuts = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
        return self

    def above(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The chance of a grade above each threshold."""
        return 1.0 / (1.0 + np.exp(-((value * self.weights[at]).sum() - self.cuts)))


def fit(documents: DataFrame, ratings: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", rating: str = "quality", examples: int = EXAMPLES) -> tuple[Ordinal, list[int]]:
    """The model and the grades in order. learn: an expression over doc_id that picks the rated rows to learn from."""
    small_batches(documents.sparkSession)
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col(rating).isNotNull()).where(learn).groupBy("doc_id").agg(F.min(rating).cast("int").alias("grade"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = documents.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # of rows that share an id, one

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "at": [a for a, _ in found], "value": [v for _, v in found]})

    held = sorted(rows.mapInPandas(hashed, "doc_id long, grade int, at array<int>, value array<float>").collect(), key=lambda r: r["doc_id"])
    grades = sorted({r["grade"] for r in held})
    model = Ordinal(len(grades))
    model.fit([(np.array(r["at"]), np.array(r["value"])) for r in held], np.array([grades.index(r["grade"]) for r in held], np.int64))
    return model, grades or [0]


def score(documents: DataFrame, model: Ordinal, grades: list[int], text: str = "text", keep: float = KEEP, tail: int | None = None) -> DataFrame:
    """The rows with expected_grade, tail_prob (of a grade of at least `tail`, the top one by default) and keep (tail_prob
    is at least `keep`)."""
    tail = grades[-1] if tail is None else tail
    # The threshold below the lowest grade of the tail; none if all grades or no grade belong to it.
    cut = sum(g < tail for g in grades) - 1
    certain = 1.0 if cut < 0 else 0.0
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((model, grades))

    @F.pandas_udf("expected_grade double, tail_prob double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, grades = sent.value
        steps = np.diff(grades)
        for batch in batches:
            out = []
            for t in batch:
                above = model.above(*features(t)) if len(grades) > 1 else np.ones(0)
                out.append((grades[0] + float((above * steps).sum()), float(above[cut]) if 0 <= cut < len(above) else certain))
            yield pd.DataFrame(out, columns=["expected_grade", "tail_prob"])

    columns = others(documents, "expected_grade", "tail_prob", "keep")
    judged = documents.select(*columns, judge(whole_text(text)).alias("_judged"))
    return judged.select(*columns, "_judged.expected_grade", "_judged.tail_prob", (F.col("_judged.tail_prob") >= keep).alias("keep"))
