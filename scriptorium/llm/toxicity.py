"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words (lower case), all of them. A term's weight in a text is
(1 + ln(count)) * ln(1 + examples / examples with the term) * strength, and vectors have length one; terms that no
example has count in a text's length too. Strength is a factor between FLOOR and FLOOR + 1 that says how unevenly the
labels of the examples share the term: FLOOR + min(|z| / STRONG, 1) ** 2, z being the two shares' difference in standard
deviations. (With no such factor the few words that make a text toxic are outweighed by the rest.) Of the learned rows
a bounded sample, EXAMPLES of each label at most and the smallest hashes of their ids, gives the examples. Examples with
the same terms are one entry with the mean of their labels.

The index has the entries in blocks; for each term and block it keeps the postings and their largest weight. A query's
bound for a block is the sum of its weights times those; blocks are taken by falling bound, in groups, until no block left
can reach the k-th best cosine found so far. The nearest entries vote with the inverse square of their distance. Votes
become a probability by a logistic curve, fitted to the votes that the examples themselves get with their own row left
out, and weighted back to the labels' true shares.

What is learned is bounded by EXAMPLES, so it is sent to every task; scoring is one pass without a shuffle.

A null or empty text, or one without a term of any example, has no neighbours: its score is the learned share of label 1.
Labels that disagree on a doc_id count as the larger, and of examples that share a doc_id the smallest text is learned;
null labels and labels without a document count as none. With no examples of both labels every score is the share of
label 1 (0 with no labels at all). Repeated rows are scored each. An empty table gives an empty one. Output columns
replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, small_batches, whole_text

EXAMPLES = 1_024
NEAREST, BLOCK = 15, 64
#: Texts that meet the common terms' matrix at a time.
GROUP = 32
#: Blocks that are searched first.
FIRST = 4
FLOOR, STRONG = 0.05, 8.0
THRESHOLD = 0.7


def terms_of(text: str) -> Counter[str]:
    """How often each term occurs."""
    return Counter(re.findall(r"\w+", text.lower()))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its end, one range after the other, and the ranges' lengths."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes), sizes


class Index:
    """The examples' entries, their blocks and the logistic curve; small, and sent to the tasks as it is."""

    def __init__(self, rows: list[tuple[int, dict[str, int], int]], shares: dict[int, float], k: int = NEAREST):
        """rows: (doc_id, counts of terms, label); shares: what each row of a label stands for."""
        self.k = k
        self.terms: dict[str, int] = {}
        for _, counts, _ in rows:
            for t in counts:
                self.terms.setdefault(t, len(self.terms))
        n, size = max(1, len(rows)), len(self.terms)
        df = np.zeros((2, size + 1))  # the last: a term that no example has
        for _, counts, label in rows:
            df[label, [self.terms[t] for t in counts]] += 1
        of = [max(1, sum(label == y for *_, label in rows)) for y in (0, 1)]
        both = (df.sum(axis=0) + 1.0) / (n + 2.0)
        z = (df[1] / of[1] - df[0] / of[0]) / np.sqrt(both * (1 - both) * (1.0 / of[0] + 1.0 / of[1]))
        z[-1] = 0.0
        self.weights = np.log1p(n / np.maximum(df.sum(axis=0), 1.0)) * (FLOOR + np.minimum(np.abs(z) / STRONG, 1.0) ** 2)
        entries: dict[frozenset, list] = {}
        for doc_id, counts, label in rows:
            entries.setdefault(frozenset(counts.items()), [counts, []])[1].append((doc_id, label))
        # Entries with the same strongest term stand together, so that blocks differ in what they bound.
        vectors = [(*self.vector(counts), own) for counts, own in entries.values()]
        vectors.sort(key=lambda v: (int(v[0][np.argmax(v[1])]) if len(v[0]) else -1, min(v[2])))
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        self.rows = np.array([len(own) for _, _, own in vectors], float)
        self.toxic = np.array([sum(y for _, y in own) for _, _, own in vectors], float)
        self.example = np.array([min(d for d, _ in own) for _, _, own in vectors], np.int64)
        self._index(np.concatenate([v[0] for v in vectors] or [np.empty(0, np.int64)]), np.repeat(np.arange(self.size), [len(v[0]) for v in vectors]), np.concatenate([v[1] for v in vectors] or [np.empty(0)]))
        stands = {y: sum(label == y for *_, label in rows) * shares[y] for y in (0, 1)}
        self.prior = stands[1] / (stands[0] + stands[1]) if rows else 0.0
        self.curve = (1.0, 0.0)
        self.learned = len({label for *_, label in rows}) == 2
        if self.learned:
            self._calibrate(vectors, shares)

    def _index(self, term: np.ndarray, entry: np.ndarray, value: np.ndarray) -> None:
        size = len(self.terms)
        #: Terms that more than a quarter of the entries have are rows of a matrix; `row` says which, from 0, else -1.
        common = np.flatnonzero(np.bincount(term, minlength=size) > self.size / 4)
        self.row = np.full(size + 1, -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.size))
        often = self.row[term] >= 0
        self.common[self.row[term[often]], entry[often]] = value[often]
        # Postings of the others by term and entry; their blocks, each with its largest weight; where a term's blocks begin.
        term, entry, value = term[~often], entry[~often], value[~often]
        order = np.lexsort((entry, term))
        self.entry, self.value, term = entry[order], value[order], term[order]
        key = term * max(1, self.blocks) + self.entry // BLOCK
        self.start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.end = np.append(self.start[1:], len(key)) if len(key) else self.start
        self.block = self.entry[self.start] // BLOCK
        self.most = np.maximum.reduceat(self.value, self.start) if len(key) else np.empty(0)
        self.first = np.searchsorted(term[self.start], np.arange(size + 1))

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text that examples have, and their weights; the rest only shortens them."""
        none = len(self.terms)
        ids = np.array(list(map(self.terms.get, counts, repeat(none))), np.int64)
        weights = (1.0 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.weights[ids]
        weights /= np.sqrt((weights**2).sum()) or 1.0
        order = np.argsort(ids, kind="stable")[: np.count_nonzero(ids < none)]
        return ids[order], weights[order]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the positions and cosines of the k nearest entries that share a term, exactly; ties by position."""
        if not self.size:
            return [(np.empty(0, np.int64), np.empty(0))] * len(vectors)
        weights = np.zeros((len(vectors), len(self.common)))
        for own, (ids, values) in zip(weights, vectors, strict=True):
            row = self.row[ids]
            own[row[row >= 0]] = values[row >= 0]
        return [self._nearest(ids, values, sums) for (ids, values), sums in zip(vectors, weights @ self.common, strict=True)]

    def _nearest(self, ids: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sums: what the common terms add to each entry's cosine. Only blocks are searched for the rest that may hold one of the k best."""
        own, sizes = _ranges(self.first[ids], self.first[np.minimum(ids + 1, len(self.first) - 1)])
        block, by = self.block[own], np.repeat(weights, sizes)
        bounds = np.maximum.reduceat(sums, np.arange(0, self.size, BLOCK)) + np.bincount(block, by * self.most[own], self.blocks) + 1e-9
        order = np.argsort(-bounds, kind="stable")
        at, cosines = np.empty(0, np.int64), np.empty(0)
        # First the blocks with the largest bounds; then all that may still hold a better entry than the k-th.
        for blocks in (order[:FIRST], order[FIRST:]):
            if len(cosines) >= self.k:
                blocks = blocks[bounds[blocks] >= cosines[-1]]
            if not len(blocks):
                continue
            taken = np.zeros(self.blocks, bool)
            taken[blocks] = True
            some = np.flatnonzero(taken[block])
            postings, sizes = _ranges(self.start[own[some]], self.end[own[some]])
            found = sums + np.bincount(self.entry[postings], np.repeat(by[some], sizes) * self.value[postings], self.size)
            found = np.where(np.repeat(taken, BLOCK)[: self.size], np.round(found, 12), 0.0)
            least = np.partition(found, -self.k)[-self.k] if self.size > self.k else 0.0
            hit = np.flatnonzero((found > 0) & (found >= least))
            at, cosines = np.concatenate([at, hit]), np.concatenate([cosines, found[hit]])
            best = np.lexsort((at, -cosines))[: self.k]
            at, cosines = at[best], cosines[best]
        return at, cosines

    def vote(self, at: np.ndarray, cosines: np.ndarray, without: tuple[int, int] | None = None) -> float:
        """The share of label 1, as the nearest entries see it, drawn a little to the overall share. without: an entry and
        the label of a row that is left out of it."""
        rows, toxic = self.rows[at].copy(), self.toxic[at].copy()
        if without is not None:
            own = at == without[0]
            rows[own] -= 1
            toxic[own] -= without[1]
        real = rows > 0
        # An entry of many rows counts more, but not in proportion.
        near = np.log2(1.0 + rows[real]) / (np.clip(1.0 - cosines[real], 0.0, 1.0) + 0.05) ** 2
        return float(((near * toxic[real] / rows[real]).sum() + 0.5 * self.prior) / (near.sum() + 0.5))

    def _calibrate(self, vectors: list[tuple], shares: dict[int, float]) -> None:
        votes, labels, weights = [], [], []
        found = chain.from_iterable(self.nearest([v[:2] for v in vectors[at : at + GROUP]]) for at in range(0, len(vectors), GROUP))
        for i, ((_, _, own), (at, cosines)) in enumerate(zip(vectors, found, strict=True)):
            for label in (0, 1):
                n = sum(y == label for _, y in own)
                if n and len(at):
                    votes.append(self.vote(at, cosines, (i, label)))
                    labels.append(label)
                    weights.append(n * shares[label])
        x, y, w = logit(np.array(votes)), np.array(labels, float), np.array(weights)
        ones, zeros = max(1.0, sum(y)), max(1.0, sum(1 - y))
        y = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method, held back by a weak prior on the curve
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(w * (p - y) * x).sum() + (a - 1.0), (w * (p - y)).sum() + 0.1 * b])
            r = w * p * (1 - p)
            h = np.array([[(r * x * x).sum() + 1.0, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
            move = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = a - move[0], b - move[1]
        self.curve = (max(a, 0.05), b)

    def probability(self, at: np.ndarray, cosines: np.ndarray) -> float:
        if not len(at) or not self.learned:
            return self.prior
        return float(1 / (1 + np.exp(-(self.curve[0] * logit(self.vote(at, cosines)) + self.curve[1]))))

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[int, float, float]]]]:
        """Of each text the probability of label 1, and the nearest entries as (doc_id of an example, cosine, share of label 1)."""
        for first in range(0, len(texts), GROUP):
            for at, cosines in self.nearest([self.vector(terms_of(t)) for t in texts[first : first + GROUP]]):
                yield self.probability(at, cosines), [(int(self.example[i]), float(c), float(self.toxic[i] / self.rows[i])) for i, c in zip(at[:3].tolist(), cosines[:3].tolist(), strict=True)]


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, k: int = NEAREST) -> Index:
    """Learns from the labelled rows for which `learn`, an expression over doc_id, holds."""
    small_batches(documents.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(learn).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    some = some[0].union(some[1])  # at most 2 * examples rows of two numbers
    rows = documents.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of rows that share an id, one

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms_of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [" ".join(c) for c in found], "counts": [list(c.values()) for c in found]})

    held = rows.mapInPandas(counts, "doc_id long, label int, terms string, counts array<int>").collect()
    got = Counter(r["label"] for r in held)
    shares = {y: sizes.get(y, 0) / max(1, got[y]) for y in (0, 1)}
    # A sample of each label stands for all of its rows; on average a row stands for one.
    mean = sum(shares[r["label"]] for r in held) / max(1, len(held))
    shares = {y: s / mean if mean else 1.0 for y, s in shares.items()}
    return Index(sorted(((r["doc_id"], dict(zip(r["terms"].split(), r["counts"], strict=True)), r["label"]) for r in held), key=lambda r: r[0]), shares, k)


def score(documents: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score, predicted (1 from the threshold on) and evidence, the nearest examples; they replace columns of these names."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<struct<doc_id:long,cosine:double,toxic:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            yield pd.DataFrame(own.scores(batch.tolist()), columns=["score", "evidence"])

    columns = others(documents, "score", "predicted", "evidence")
    judged = documents.select(*columns, judge(whole_text(text)).alias("_judged"))
    columns = others(judged, "_judged")
    return judged.select(*columns, "_judged.score", (F.col("_judged.score") >= threshold).cast("int").alias("predicted"), "_judged.evidence")
