"""LM scoring: the likelihood of a subword lattice, marginal over all segmentations.

Tokens are the words of the lower-cased (A-Z) text, then one end. The vocabulary of a public subword tokenizer gives the
pieces; as it states ranks, not probabilities, a piece's weight is 1 / (rank + 20), to sum one. The probability of a
word's spelling is the sum over all ways to cut it into pieces, by a forward recursion in log space. Each word starts
with a piece that carries the word mark and no other piece does, so spellings sum to one, and the product over a text's
tokens is its marginal probability over all segmentations: lattice_score, by the vocabulary's weights as they are.

These weights know nothing of the corpus, so `score` puts what was counted in it on top of lattices: piece weights fitted
to the corpus by expectation-maximisation over its distinct words, and counts of whole words. Documents fall into a few
classes by how often each byte occurs (mostly languages); counts and weights are kept by class. In a class with N tokens
and V distinct words, a word's probability is (c - D) / N plus the discounts' share D * V / N of a mixture of its
spelling and its frequency in all classes. D comes from the numbers of words seen once and twice, the mixture from how
many words that a class saw once no class saw else. The probability of a document is the sum over classes of the class's
share times the product over its tokens: its marginal over classes and segmentations. Both scores are log10.

Classes start from a bounded sample of rows without labels and are then fitted to all learned rows: what a task makes
of it are classes * 257 sums. Words are counted per task before they are shuffled. The HEAD most frequent short words, a
bounded table, are sent to every task; only other words are shuffled to meet their counts, so no frequent word makes a
large group. Words of more than LONG characters pass the recursion one by one, BLOCK characters at a time and for all
sets of weights at once, so a text that is one word of any length needs little memory.

A null text counts as empty: its only token is the end. With nothing to learn from, every word is scored by its
spelling alone. Rows that repeat an id are scored each; a row without doc_id is scored as any other. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, mix, small_batches, whole_text, written

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: Words sent to every task, and the bytes of the longest such word: 65,536 words of 32 bytes at most.
HEAD, HEAD_BYTES = 65_536, 32
#: Distinct words that a counting task gathers before it passes them on.
GATHER = 150_000
ROUNDS = 3
#: Classes of documents, the rows that they start from (a bounded sample, the smallest hashes of the ids), and how often
#: they are then fitted to all rows.
CLASSES, SAMPLE, FITS = 5, 4_096, 1
#: Characters of a word that passes the recursion alone, and of its parts.
LONG, BLOCK = 64, 1_024
#: Sizes of the tables that find pieces, and the base of the hash of their characters.
TABLE_BITS, BASE = 20, 0x9E3779B97F4A7C15
LN10 = float(np.log(10.0))


class Lattice:
    """Pieces, one or several sets of log weights for them, and the recursions over words of equal length at once, for all
    sets side by side."""

    def __init__(self, pieces: dict[str, int], weights: np.ndarray):
        self.pieces = pieces
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        self.none = self.size + 4
        self._weigh(weights)
        self._place(list(pieces))
        self.shapes: dict[int, tuple[np.ndarray, np.ndarray, list[slice]]] = {}

    def _weigh(self, weights: np.ndarray) -> None:
        """Behind the pieces: characters without one, by their UTF-8 length, each of whose bytes is as likely; last, no edge."""
        self.alone = weights.ndim == 1
        rows = np.atleast_2d(weights)
        self.weights = np.hstack([rows, np.full((len(rows), 1), -np.inf)])
        self.chances = np.exp(self.weights)

    def weighed(self, weights: np.ndarray) -> Lattice:
        """The same pieces with other weights."""
        other = copy(self)
        other._weigh(weights)
        return other

    @staticmethod
    def first(pieces: dict[str, int]) -> np.ndarray:
        """Log weights by rank, the order in which the vocabulary's scores put the pieces."""
        weights = np.append(1.0 / (np.arange(len(pieces)) + 20.0), [1e-4] * 4)
        return np.log(weights / weights.sum()) - np.append(np.zeros(len(pieces)), np.log(256.0) * np.arange(1, 5))

    def shape(self, n: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
        """Start and end of every edge of a word of n characters, ordered by end and start; where each end's edges are."""
        if n not in self.shapes:
            pairs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
            ends = np.array([j for _, j in pairs])
            bounds = np.searchsorted(ends, np.arange(1, n + 2))
            self.shapes[n] = (np.array([i for i, _ in pairs]), ends, [slice(bounds[j], bounds[j + 1]) for j in range(n)])
        return self.shapes[n]

    def _place(self, pieces: list[str]) -> None:
        """Two tables from bits of a piece's hash to its number; a piece whose place in the first is taken goes to the second."""
        none = self.none
        self.hashes = np.zeros(none + 1, np.uint64)
        for n in {len(p) for p in pieces}:
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            self.hashes[own] = self._hashed(self._codes([pieces[i] for i in own], n), np.array([0]), np.array([n]))[:, 0]
        self.tables = [np.full(1 << TABLE_BITS, none, np.int32) for _ in range(2)]
        at = self._slots(self.hashes)
        for i in range(len(pieces)):
            for table, slots in zip(self.tables, at, strict=True):
                if table[slots[i]] == none:
                    table[slots[i]] = i
                    break
            else:
                raise ValueError("the vocabulary is too large for its tables")

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)

    @staticmethod
    def _hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the parts from starts to ends of each word."""
        n = codes.shape[1]
        sums = np.zeros((len(codes), n + 1), np.uint64)
        for j in range(n):
            sums[:, j + 1] = sums[:, j] * np.uint64(BASE) + codes[:, j] + np.uint64(1)
        powers = np.array([pow(BASE, k, 1 << 64) for k in range(int((ends - starts).max()) + 1)], np.uint64)
        return mix(sums[:, ends] - sums[:, starts] * powers[ends - starts])

    @staticmethod
    def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> np.uint64(64 - TABLE_BITS), hashes & np.uint64((1 << TABLE_BITS) - 1)

    def edges(self, words: list[str], n: int) -> np.ndarray:
        """The number of the piece at each edge of each word; where none is, that of no edge or of a lone character."""
        starts, ends, _ = self.shape(n)
        none = self.none
        codes = self._codes(words, n)
        hashes = self._hashed(codes, starts, ends)
        first, second = self._slots(hashes)
        out = self.tables[0][first]
        out = np.where(self.hashes[out] == hashes, out, self.tables[1][second])
        out = np.where(self.hashes[out] == hashes, out, none)
        single = np.flatnonzero(ends - starts == 1)
        sizes = (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        out[:, single] = np.where(out[:, single] == none, self.size + sizes[:, starts[single]], out[:, single])
        return out

    def forward(self, edges: np.ndarray, n: int) -> np.ndarray:
        """The log of the sum over ways to each place, for each set of weights and word, in log space."""
        weights = self.weights[:, edges]
        alpha = np.full((*weights.shape[:2], n + 1), -np.inf)
        alpha[..., 0] = 0.0
        for j, s in enumerate(self.shape(n)[2], 1):
            alpha[..., j] = _log_sum(alpha[..., max(0, j - self.longest) : j] + weights[..., s])
        return alpha

    def shares(self, edges: np.ndarray, n: int, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row (a word's edges and a set of weights) how often each edge is used, expected over all ways; and the
        word's chance. Words are short, so that chances themselves are summed; where one is too small for that it is 0, and
        so are its shares."""
        starts, ends, slices = self.shape(n)
        chances = self.chances[sets[:, None], edges]
        alpha, beta = np.zeros((len(edges), n + 1)), np.zeros((len(edges), n + 1))
        alpha[:, 0] = beta[:, n] = 1.0
        lows = [max(0, j - self.longest) for j in range(1, n + 1)]
        for j, (s, low) in enumerate(zip(slices, lows, strict=True), 1):
            alpha[:, j] = np.einsum("we,we->w", alpha[:, low:j], chances[:, s])
        for j, s, low in zip(range(n, 0, -1), slices[::-1], lows[::-1], strict=True):
            beta[:, low:j] += chances[:, s] * beta[:, j, None]
        whole = np.where(alpha[:, n] > 1e-250, alpha[:, n], 0.0)
        chances *= alpha[:, starts]
        chances *= beta[:, ends]
        chances *= np.divide(1.0, whole, out=np.zeros_like(whole), where=whole > 0)[:, None]
        return chances, whole

    def part(self, word: str, first: int) -> np.ndarray:
        """Of a long word, for each of BLOCK ends from `first` on the numbers of the edges that start `longest` to one
        characters before it; where the word has not begun there is no edge."""
        none, width = self.none, self.longest
        last = min(len(word), first + BLOCK - 1)
        lead = max(0, first - width)
        codes = self._codes([word[lead:last]], last - lead)
        ends = np.arange(first - lead, last - lead + 1)
        starts = ends[:, None] - np.arange(width, 0, -1)
        flat_ends, flat_starts = np.repeat(ends, width), np.maximum(starts, 0).ravel()
        hashes = self._hashed(codes, flat_starts, flat_ends)[0]
        first_slot, second_slot = self._slots(hashes)
        out = self.tables[0][first_slot]
        out = np.where(self.hashes[out] == hashes, out, self.tables[1][second_slot])
        out = np.where(self.hashes[out] == hashes, out, none).reshape(len(ends), width)
        own = codes[0, ends - 1]
        sizes = (own >= 0x80).astype(np.int32) + (own >= 0x800) + (own >= 0x10000)
        out[:, -1] = np.where(out[:, -1] == none, self.size + sizes, out[:, -1])
        out[starts < 0] = none
        return out

    def _on(self, before: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The recursion of a part, for all sets of weights at once: the logs of the `longest` places before it, then its own."""
        width, n = self.longest, weights.shape[1]
        alpha = np.hstack([before, np.empty((len(before), n))])
        for k in range(n):
            alpha[:, width + k] = np.logaddexp.reduce(alpha[:, k : k + width] + weights[:, k], axis=1)
        return alpha

    def _begin(self) -> np.ndarray:
        """The places before a word: nothing reaches them, but the last, where it starts."""
        before = np.full((len(self.weights), self.longest), -np.inf)
        before[:, -1] = 0.0
        return before

    def long_log(self, word: str) -> np.ndarray:
        before = self._begin()
        for first in range(1, len(word) + 1, BLOCK):
            before = self._on(before, self.weights[:, self.part(word, first)])[:, -self.longest :]
        return before[:, -1]

    def long_expected(self, word: str) -> np.ndarray:
        """expected() of one long word: from its end on, the chance of each place to be passed, part by part. Of the way
        there only each part's beginning is kept, and the part walked again."""
        width, begun = self.longest, [self._begin()]
        firsts = list(range(1, len(word) + 1, BLOCK))
        for first in firsts[:-1]:
            begun.append(self._on(begun[-1], self.weights[:, self.part(word, first)])[:, -width:])
        total = np.zeros(self.weights.shape)
        after = np.zeros((len(total), width))
        after[:, -1] = 1.0
        for first, before in zip(firsts[::-1], begun[::-1], strict=True):
            edges = self.part(word, first)
            weights, n = self.weights[:, edges], len(edges)
            alpha = self._on(before, weights)
            reached = np.lib.stride_tricks.sliding_window_view(alpha, width, axis=1)[:, :n]
            shares = np.exp(reached + weights - alpha[:, width:, None])
            passed = np.zeros((len(total), width + n))
            passed[:, n:] = after
            for k in range(n - 1, -1, -1):
                shares[:, k] *= passed[:, width + k, None]
                passed[:, k : k + width] += shares[:, k]
            for i, own in enumerate(shares):
                total[i] += np.bincount(edges.ravel(), own.ravel(), total.shape[1])
            after = passed[:, :width]
        return total

    def grouped(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Positions, length and edges of words of equal length, some at a time; long words are left out."""
        spelt = [MARK + w.decode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        for n in np.unique(lengths[lengths <= LONG]).tolist():
            own = np.flatnonzero(lengths == n)
            step = max(1, 400_000 // (n * min(n, self.longest) * len(self.weights)))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                yield some, n, self.edges([spelt[i] for i in some.tolist()], n)

    def log_spelling(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word over all ways to cut it; a row for each set of weights."""
        out = np.empty((len(self.weights), len(words)))
        for own, size, edges in self.grouped(words):
            out[:, own] = self.forward(edges, size)[..., size]
        for i, word in long_words(words):
            out[:, i] = self.long_log(word)
        return out[0] if self.alone else out

    def expected(self, words: list[bytes], there: np.ndarray | None = None) -> np.ndarray:
        """How often each piece is used, expected over all segmentations of the words; a row for each set of weights, of
        the words that are `there` (a row for each set) in it."""
        total = np.zeros(self.weights.shape)
        there = np.ones((len(total), len(words)), bool) if there is None else there
        for own, n, edges in self.grouped(words):
            sets, at = np.nonzero(there[:, own])  # by set; most words are in one set only
            if not len(sets):
                continue
            edges = edges[at]
            shares, whole = self.shares(edges, n, sets)
            bounds = np.searchsorted(sets, np.arange(len(total) + 1))
            for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                total[i] += np.bincount(edges[low:high].ravel(), shares[low:high].ravel(), total.shape[1])
            for row in np.flatnonzero(whole == 0).tolist():
                # Rare: a word whose chance is too small for plain numbers.
                total[sets[row]] += self.long_expected(MARK + words[own[at[row]]].decode("utf-8", "replace"))[sets[row]]
        for i, word in long_words(words):
            total += self.long_expected(word) * there[:, i, None]
        return total[0, :-1] if self.alone else total[:, :-1]


def long_words(words: list[bytes]) -> Iterator[tuple[int, str]]:
    """Positions and spellings of the words of more than LONG characters."""
    for i, w in enumerate(words):
        if len(w) >= LONG and len(spelt := MARK + w.decode("utf-8", "replace")) > LONG:
            yield i, spelt


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Over the last axis; x is used up."""
    top = x.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    x -= safe[..., None]
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x, out=x).sum(axis=-1)) + safe


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The pieces of a sentencepiece model that spell words, numbered by their scores."""
    from sentencepiece import SentencePieceProcessor

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids = [i for i in ids if MARK not in model.id_to_piece(i)[1:]]
    ids.sort(key=lambda i: -model.get_score(i))
    # Words are lower-cased, so pieces with A-Z spell none.
    pieces = [p for p in map(model.id_to_piece, ids) if not any("A" <= c <= "Z" for c in p)]
    return {p: n for n, p in enumerate(dict.fromkeys([*pieces, MARK]))}


def tokens(text: str) -> list[bytes]:
    """Words in bytes, then the end, which is the empty word."""
    return [*text.encode().translate(ASCII_LOWER).split(), b""]


def byte_counts(text: str) -> np.ndarray:
    return bytes_of(text.encode().translate(ASCII_LOWER))


def bytes_of(low: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(low, np.uint8), minlength=256)


def byte_classes(rows: np.ndarray, classes: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Log shares and log byte probabilities of a mixture, by expectation-maximisation from rows far from each other."""
    rows = rows[rows.sum(axis=1) > 0].astype(np.float64)
    if not len(rows):
        return np.array([0.0]), np.full((1, 256), -np.log(256.0))
    parts = np.sqrt(rows / rows.sum(axis=1, keepdims=True))
    picked = [int(np.argmax(parts @ parts.mean(axis=0)))]
    nearest = parts @ parts[picked[0]]
    for _ in range(min(classes, len(rows)) - 1):
        # The row that a tenth of all are farther away than: not a lone odd one.
        picked.append(int(np.argsort(nearest, kind="stable")[len(rows) // 10]))
        nearest = np.maximum(nearest, parts @ parts[picked[-1]])
    # Long texts count as if they had 1000 bytes, so that none is certain from the start.
    weights = rows * np.minimum(1.0, 1000.0 / rows.sum(axis=1, keepdims=True))
    shares, bytes_ = np.full(len(picked), 1.0 / len(picked)), weights[picked] + 0.5
    for _ in range(rounds):
        logs = np.log(bytes_ / bytes_.sum(axis=1, keepdims=True))
        belief = weights @ logs.T + np.log(shares)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
        shares = (belief.sum(axis=0) + 1.0) / (len(rows) + len(picked))
        bytes_ = belief.T @ weights + 0.5
    return np.log(shares), np.log(bytes_ / bytes_.sum(axis=1, keepdims=True))


class Model:
    """counts: a table (word, c, c0, c1, ...) of every word of the corpus, counted in the learned rows, in all and by class."""

    def __init__(self, documents: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, path: str | None = None):
        spark = documents.sparkSession
        small_batches(spark)
        rows = documents.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))

        @F.pandas_udf("array<int>")
        def histogram(texts: pd.Series) -> pd.Series:
            return pd.Series([byte_counts(t).astype(np.int32) for t in texts])

        some = rows.where("learned").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE)
        some = rows.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi").where("learned")
        seen = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(histogram("text").alias("bytes")).collect()
        self.shares, self.bytes = shares, byte_logs = byte_classes(np.array([r["bytes"] for r in seen]).reshape(-1, 256), classes)
        self.classes = k = len(shares)
        for _ in range(FITS if len(seen) else 0):
            self.shares, self.bytes = shares, byte_logs = self._over_all(rows, shares, byte_logs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[Counter[bytes]] = [Counter() for _ in range(k)]
            rest: set[bytes] = set()

            def out() -> Iterator[pa.RecordBatch]:
                for i, own in enumerate([*seen, dict.fromkeys(rest, 0)]):
                    columns = [pa.array(own.keys(), pa.binary()), pa.array(np.full(len(own), i % k, np.int32)), pa.array(np.fromiter(own.values(), np.int64, len(own)))]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "k", "c"])
                rest.clear()
                for own in seen:
                    own.clear()

            for batch in batches:
                for row, learned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    low = row.encode().translate(ASCII_LOWER)
                    own = [*low.split(), b""]
                    if learned:
                        seen[int(np.argmax(byte_logs @ bytes_of(low) + shares))].update(own)
                    else:
                        rest.update(own)
                    if sum(map(len, seen)) + len(rest) > GATHER:
                        yield from out()
            yield from out()

        counted = rows.select("text", "learned").mapInArrow(count, "word binary, k int, c long")
        by_class = [F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(k)]
        self.counts = written(counted.groupBy("word").agg(F.sum("c").alias("c"), *by_class), "counts")
        hit = lambda condition: F.count(F.when(condition, 1))
        names = [f"c{i}" for i in range(k)]
        facts = self.counts.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n"), hit(F.col("c") > 0).alias("v"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in names), *(hit(F.col(c) > 0).alias(f"v_{c}") for c in names),
            *(hit(F.col(c) == 1).alias(f"ones_{c}") for c in names), *(hit(F.col(c) == 2).alias(f"twos_{c}") for c in names), *(hit((F.col(c) == 1) & (F.col("c") == 1)).alias(f"only_{c}") for c in names),
        ).first()
        self.n, self.v = int(facts["n"]), int(facts["v"])
        of = lambda name: np.array([facts[f"{name}_{c}"] for c in names], np.float64)
        self.class_n = of("n")
        self.discount = np.clip((of("ones") + 0.5) / (of("ones") + 2 * of("twos") + 1.0), 0.1, 0.9)
        self.fresh = np.where(self.class_n > 0, self.discount * of("v") / np.maximum(self.class_n, 1), 1.0)
        self.spelt = (of("only") + 1.0) / (of("ones") + 2.0)
        self.pieces = vocabulary(path)
        self.lattice = Lattice(self.pieces, Lattice.first(self.pieces))
        self.weights = self._fitted(spark, rounds)
        self.lexicon = written(self._scored(spark), "lexicon")

    @staticmethod
    def _over_all(rows: DataFrame, shares: np.ndarray, byte_logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and byte probabilities of the classes from all learned rows, by what each row is believed to be now.
        A task sums its rows; sums are summed by Spark, and classes * 257 numbers come back."""
        k = len(shares)

        def believe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((k, 257))
            for batch in batches:
                for text in batch["text"]:
                    own = byte_counts(text).astype(np.float64)
                    logs = byte_logs @ own * min(1.0, 1000.0 / max(own.sum(), 1.0)) + shares
                    belief = np.exp(logs - logs.max())
                    belief /= belief.sum()
                    sums[:, :256] += belief[:, None] * own * min(1.0, 1000.0 / max(own.sum(), 1.0))
                    sums[:, 256] += belief
            yield pd.DataFrame({"k": range(k), "n": list(sums)})

        each = rows.where("learned").select("text").mapInPandas(believe, "k int, n array<double>").select("k", F.posexplode("n").alias("b", "n"))
        sums = np.zeros((k, 257))
        for r in each.groupBy("k", "b").agg(F.sum("n").alias("n")).collect():
            sums[r["k"], r["b"]] = r["n"]
        bytes_ = sums[:, :256] + 0.5
        return np.log((sums[:, 256] + 1.0) / (sums[:, 256].sum() + k)), np.log(bytes_ / bytes_.sum(axis=1, keepdims=True))

    def _fitted(self, spark: SparkSession, rounds: int) -> np.ndarray:
        """Log weights by class. Each round sends them (some 30,000 numbers a class, whatever the input) out and expected counts back."""
        k, size = self.classes, len(self.pieces)
        weights = np.tile(Lattice.first(self.pieces), (k, 1))
        learned = self.counts.where("c > 0").select("word", sum(F.when(F.col(f"c{i}") > 0, 1 << i).otherwise(0) for i in range(k)).alias("there"))
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(self.lattice.weighed(weights))

            def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                total = 0.0
                for batch in batches:
                    if len(batch):
                        there = batch["there"].to_numpy() >> np.arange(k)[:, None] & 1
                        total = total + sent.value.expected(batch["word"].tolist(), there.astype(bool))
                for i, own in enumerate(total if np.ndim(total) else []):
                    used = np.flatnonzero(own > 0)
                    yield pd.DataFrame({"k": i, "piece": used, "n": own[used]})

            sums = learned.mapInPandas(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
            total = np.full(weights.shape, 1e-3)
            total[sums["k"].to_numpy(), sums["piece"].to_numpy()] += sums["n"].to_numpy()
            weights = np.log(total / total.sum(axis=1, keepdims=True)) - np.append(np.zeros(size), np.log(256.0) * np.arange(1, 5))
            sent.unpersist()
        return weights

    def _scored(self, spark: SparkSession) -> DataFrame:
        """word, c and p0, p1, ..., its log10 probability in each class and last by the lattice of the vocabulary's weights alone."""
        sent = spark.sparkContext.broadcast(self.lattice.weighed(np.vstack([self.weights, Lattice.first(self.pieces)])))
        k, n, class_n, discount, fresh, spelt = self.classes, self.n, self.class_n, self.discount, self.fresh, self.spelt

        names = [f"p{i}" for i in range(k + 1)]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
                spelling = sent.value.log_spelling(column("word").to_pylist())
                overall = column("c").to_numpy().astype(np.float64) / max(n, 1)
                logs = []
                for i in range(k):
                    share = spelt[i] if n else 1.0
                    seen = np.maximum(column(f"c{i}").to_numpy().astype(np.float64) - discount[i], 0.0) / max(class_n[i], 1.0) + fresh[i] * (1 - share) * overall
                    with np.errstate(divide="ignore"):
                        logs.append(np.logaddexp(np.log(seen), np.log(fresh[i] * share) + spelling[i]) / LN10)
                logs.append(spelling[k] / LN10)
                yield pa.RecordBatch.from_arrays([column("word"), column("c"), *map(pa.array, logs)], ["word", "c", *names])

        return self.counts.mapInArrow(score, "word binary, c long, " + ", ".join(f"{name} double" for name in names))

    def _head(self) -> DataFrame:
        """The end and the most frequent short words, HEAD at most: those above the least frequency, of a few hundred on a
        logarithmic scale, that so few words reach. Only the counts at each step of the scale leave the tasks to find it."""
        step = F.floor(F.log2(F.col("c").cast("double")) * 16)
        short = self.lexicon.where((F.octet_length("word") <= HEAD_BYTES) & (F.octet_length("word") > 0) & (F.col("c") > 0)).withColumn("step", step)
        least, room = None, HEAD - 1
        for row in sorted(short.groupBy("step").count().collect(), reverse=True):
            room -= row["count"]
            if room < 0:
                break
            least = row["step"]
        end = self.lexicon.where(F.octet_length("word") == 0)
        return end if least is None else end.unionByName(short.where(F.col("step") >= least).drop("step"))

    def score(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score, score and lattice_score of each row; the rows must be those that were counted."""
        spark = documents.sparkSession
        top = self._head().collect()
        n, v, k = self.n, self.v, self.classes
        total = n + 0.5 * (v + 1)
        head = {bytes(r["word"]): i for i, r in enumerate(top)}
        facts = np.array([[r["c"] > 0, np.log10((r["c"] + 0.5) / total), *(r[f"p{i}"] for i in range(k + 1))] for r in top]).reshape(len(top), k + 3)
        sent = spark.sparkContext.broadcast((head, np.vstack([facts, np.zeros(k + 3)])))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, facts = sent.value
            none = len(facts) - 1
            for batch in batches:
                sums, tokens_, ends, rest = [], [], [0], []
                for row in batch.column(1).to_pylist():
                    found = tokens(row)
                    met = np.fromiter(map(head.get, found, repeat(none)), np.int64, len(found))
                    sums.append(facts[met].sum(axis=0))
                    tokens_.append(len(found))
                    rest += [found[i] for i in np.flatnonzero(met == none).tolist()]
                    ends.append(len(rest))
                sums = np.array(sums).reshape(-1, facts.shape[1])
                each = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * (k + 1))
                own = pa.ListArray.from_arrays(each, pa.array(sums[:, 2:].ravel()))
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest, pa.binary()))
                columns = [batch.column(0), pa.array(tokens_, pa.int64()), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), own, words]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "known", "low", "own", "rest"])

        rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
        looked = rows.mapInArrow(look_up, "doc_id long, n_tokens long, known long, low double, own array<double>, rest array<binary>")
        looked = written(looked.withColumn("row", F.monotonically_increasing_id()), "looked")
        met = looked.select("row", F.explode("rest").alias("word")).join(self.lexicon, "word")
        rest = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("known2"), F.sum(F.log10((F.col("c") + 0.5) / total)).alias("low2"), *(F.sum(f"p{i}").alias(f"own{i}") for i in range(k + 1)))
        both = looked.drop("rest").join(rest, "row", "left")
        logs = F.array(*(F.lit(float(self.shares[i] / LN10)) + F.col("own")[i] + F.coalesce(f"own{i}", F.lit(0.0)) for i in range(k)))
        top_log = F.array_max("logs")
        return both.withColumn("logs", logs).select(
            "doc_id",
            "n_tokens",
            (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("low") + F.coalesce("low2", F.lit(0.0))).alias("base_score"),
            (top_log + F.log10(F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top_log)))).alias("score"),
            (F.col("own")[k] + F.coalesce(f"own{k}", F.lit(0.0))).alias("lattice_score"),
        )
