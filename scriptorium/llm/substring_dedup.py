"""Substring dedup: repeated-phrase automata.

A window is `window` consecutive words of one document. Each word is removed that a window covers whose words also
start earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input.

1. Survey: each document gives its seeds, of the phrases of six words of each window the one with the smallest hash. Two
   equal windows have the same seed, and about one phrase in eight is a seed. No places are kept.
2. Documents whose words all equal those of an earlier one lose everything; they take no part in what follows.
3. Confirmation: sums before the shuffle tell which phrases recur across documents. Documents are dealt at random over
   shards of about SHARD_WORDS words, and each shard is sent the numbers of the confirmed phrases of its documents. The
   shard adds the phrases that recur within it, reads each one's text off one document that has it, and compiles these
   texts into Aho-Corasick automata of AUTOMATON phrases at most.
4. All documents of the shard are streamed through its automata, which alone say where phrases occur: every occurrence,
   by text, also those that are no seed of their window.
5. The windows around occurrences are the candidates. Those that repeat within the shard are settled there. The first of
   each in the shard, if it holds a phrase that recurs across documents, meets those of other shards: the smallest
   doc_id of a window, again summed before the shuffle, keeps it.
6. Texts are read once more to cut what is to go.

Windows of different shards are equal if two independent 64-bit hashes of them are: 128 bits, so that of 10^13 windows no
two different ones are expected to meet (chance 10^-13). What leaves a task for each document is its seeds or windows.

A null text has no words. Texts shorter than a window keep all. Rows that share a doc_id don't count as earlier than
each other; rows that share doc_id and text are one document, returned as often as it comes. Rows without doc_id keep
everything and are nobody's earlier occurrence. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WordHashes, discard, gram_hashes, mix, others, small_batches, whole_text, written

WINDOW, PHRASE = 20, 6
#: Words of a shard's documents together, and phrases of one automaton (some 1 KB each).
SHARD_WORDS, AUTOMATON = 200_000, 50_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Hashes of words that a worker meets in shard after shard.
_KNOWN = WordHashes(limit=100_000)


def _sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """The least or greatest of each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def seeds(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the phrases that are the smallest of some window."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = gram_hashes(hashes, phrase)
    n = window - phrase + 1
    least = _sliding(grams, n, np.minimum)
    pad = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), n, np.maximum) == grams)
    return grams[at], at


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def occurrences(phrases: list[tuple[bytes, bool]], documents: list[list[bytes]], most: int = AUTOMATON) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the first words of every occurrence of a phrase, in no order, and the phrases' marks.

    Phrases are words joined by one space. They are compiled into automata of `most` phrases at most, and each document
    is streamed through each of these.
    """
    import ahocorasick

    found: list[tuple[list[int], list[bool]]] = [([], []) for _ in documents]
    texts = [f" {b' '.join(words).decode('latin-1')} " for words in documents]  # a character for each byte
    for first in range(0, len(phrases), most):
        automaton = ahocorasick.Automaton()
        for text, mark in phrases[first : first + most]:
            automaton.add_word(f" {text.decode('latin-1')} ", (len(text) + 1, mark))
        automaton.make_automaton()
        for text, (places, marks) in zip(texts, found, strict=True):
            for end, (size, mark) in automaton.iter(text):
                places.append(end - size)
                marks.append(mark)
    out = []
    for words, (places, marks) in zip(documents, found, strict=True):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes
        out.append((np.searchsorted(starts, np.array(places, np.int64) + 1), np.array(marks, bool)))
    return out


def _around(places: np.ndarray, n_windows: int, window: int, phrase: int) -> np.ndarray:
    """Whether each window holds a phrase at one of these places."""
    opened = np.bincount(np.clip(places - (window - phrase), 0, n_windows), minlength=n_windows + 1)
    closed = np.bincount(np.clip(places + 1, 0, n_windows), minlength=n_windows + 1)
    return np.cumsum(opened - closed)[:-1] > 0


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the columns, and for each place of it whether the first two columns differ from the place before."""
    order = np.lexsort(columns[::-1])
    a, b = columns[0][order], columns[1][order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]


def settle(documents: list[tuple[int, int, list[bytes]]], confirmed: set[int], known: WordHashes, window: int = WINDOW, phrase: int = PHRASE):
    """A shard's documents (doc_id, key of the text, words): for each the windows that go for certain, and the windows
    that other shards must be asked about, as first words and two hashes."""
    hashes = [known.of(words) for _, _, words in documents]
    own = [seeds(h, window, phrase) for h in hashes]
    every, first, times = np.unique(np.concatenate([h for h, _ in own]), return_index=True, return_counts=True)
    across = np.isin(every, np.fromiter(confirmed, np.uint64, len(confirmed)))
    document = np.repeat(np.arange(len(own)), [len(h) for h, _ in own])
    place = np.concatenate([p for _, p in own])
    phrases = []
    for i in np.flatnonzero(across | (times > 1)).tolist():
        at = int(place[first[i]])
        phrases.append((b" ".join(documents[document[first[i]]][2][at : at + phrase]), bool(across[i])))
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for i, (places, marks) in enumerate(occurrences(phrases, [words for _, _, words in documents])):
        if not len(places):
            continue
        n = len(hashes[i]) - window + 1
        near = np.flatnonzero(_around(places, n, window, phrase))
        a = gram_hashes(hashes[i], window)[near]
        b = gram_hashes(mix(hashes[i] ^ _SECOND), window)[near]
        for column, values in zip(columns, (a, b, np.full(len(near), i), near, _around(places[marks], n, window, phrase)[near]), strict=True):
            column.append(values)
    nothing = np.empty(0, np.int64)
    if not columns[0]:
        return [(nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64)) for _ in documents]
    a, b, index, at, asked = (np.concatenate(c) for c in columns)
    ids, keys = (np.array([d[k] for d in documents], np.int64)[index] for k in (0, 1))
    order, starts = _groups(a, b, ids, keys, at)
    group = np.cumsum(starts) - 1
    again = np.append(False, (group[1:] == group[:-1]) & (index[order][1:] == index[order][:-1]))
    gone = np.empty(len(order), bool)
    gone[order] = again | (ids[order] > ids[order][starts][group])
    ask = ~gone & asked
    bounds = np.searchsorted(index, np.arange(len(documents) + 1)).tolist()
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mine, theirs = gone[lo:hi], ask[lo:hi]
        out.append((at[lo:hi][mine], at[lo:hi][theirs], a[lo:hi][theirs], b[lo:hi][theirs]))
    return out


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole_text(text)).alias("text_key"), whole_text(text).alias("text"))


def lost_windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), whole and starts: the documents that lose words, all of them or those of
    the windows that start at these words (in no order, some repeatedly)."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = _keyed(documents, doc_id, text)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for value in batch.column("text"):
                words = value.as_py().encode().split()
                h = np.unique(seeds(_KNOWN.of(words), window, phrase)[0]) if len(words) >= window else np.empty(0, np.uint64)
                sizes.append(len(words))
                digests.append(sha256(words))
                found.append(h.view(np.int64))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "sha", "h"])

    surveyed = written(rows.mapInArrow(survey, "doc_id long, text_key long, n_words long, sha string, h array<long>"), "survey")
    n_words = surveyed.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-n_words // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).alias("shard")

    first = surveyed.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = surveyed.select("doc_id", "text_key", "n_words", "sha").join(first, "sha").where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window))
    copies = written(copies.select("doc_id", "text_key").distinct(), "copies")

    # Whole copies have one content, so they alone make no phrase recur.
    content = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("content")
    across = surveyed.select(content, F.explode("h").alias("h")).groupBy("h").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a < b").select("h")
    # A table of its own, so that the join below has two plain sides and a phrase of very many documents can be split.
    across = written(across, "across")
    confirmed = surveyed.select(shard, F.explode("h").alias("h")).join(across, "h").select("shard", "h").distinct()
    none = F.lit(None).cast("long")
    notes = confirmed.select("shard", "h", none.alias("doc_id"), none.alias("text_key")).unionByName(copies.select(shard, none.alias("h"), "doc_id", "text_key"))

    fields = [pa.field("doc_id", pa.int64()), pa.field("text_key", pa.int64()), pa.field("gone", pa.list_(pa.int32())), pa.field("at", pa.list_(pa.int32())), pa.field("a", pa.list_(pa.int64())), pa.field("b", pa.list_(pa.int64()))]

    def locate(texts: pa.Table, notes: pa.Table) -> pa.Table:
        skip = {(i, k) for i, k in zip(notes["doc_id"].to_pylist(), notes["text_key"].to_pylist(), strict=True) if i is not None}
        phrases = notes["h"].drop_null().to_numpy().astype(np.int64).view(np.uint64)
        held = {}
        for i, k, value in zip(texts["doc_id"].to_pylist(), texts["text_key"].to_pylist(), texts["text"], strict=True):
            if (i, k) not in skip and (i, k) not in held:
                words = value.as_py().encode().split()
                if len(words) >= window:
                    held[i, k] = words
        shard = [(i, k, held[i, k]) for i, k in sorted(held)]
        found = settle(shard, set(phrases.tolist()), _KNOWN, window, phrase) if shard else []
        rows = [(d[0], d[1], g.astype(np.int32), at.astype(np.int32), a.view(np.int64), b.view(np.int64)) for d, (g, at, a, b) in zip(shard, found, strict=True) if len(g) or len(at)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))

    schema = "doc_id long, text_key long, gone array<int>, at array<int>, a array<long>, b array<long>"
    dealt = rows.withColumn("shard", shard).groupBy("shard").cogroup(notes.groupBy("shard"))
    located = written(dealt.applyInArrow(locate, schema), "located")
    discard(surveyed, across)

    windows = located.select("doc_id", "text_key", F.explode(F.arrays_zip("at", "a", "b")).alias("w")).select("doc_id", "text_key", "w.*")
    earliest = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first")
    earliest = written(earliest, "earliest")
    later = windows.join(earliest, ["a", "b"]).where("doc_id > first").groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("later"))
    whole = copies.select("doc_id", "text_key", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))
    parts = located.where("size(gone) > 0").select("doc_id", "text_key", "gone").join(later, ["doc_id", "text_key"], "full")
    none = F.array().cast("array<int>")
    parts = parts.select("doc_id", "text_key", F.lit(False).alias("whole"), F.concat(F.coalesce("gone", none), F.coalesce("later", none)).alias("starts"))
    lost = written(parts.unionByName(whole), "lost")
    discard(located, earliest, copies)
    return lost


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The rows with n_words, n_removed, kept_sha256 (of the kept words, joined by a space) and kept, these words; kept is
    null where n_removed is 0. The four replace columns of these names."""
    small_batches(documents.sparkSession)
    lost = lost_windows(documents, doc_id, text, window, phrase).toDF("_lost_id", "_lost_key", "_whole", "_starts")
    rows = documents.select(*others(documents, "n_words", "n_removed", "kept_sha256", "kept"), whole_text(text).alias("_text"))
    columns = rows.columns[:-1]
    joined = rows.join(lost, (F.col(f"`{doc_id}`").cast("long") == F.col("_lost_id")) & (F.xxhash64("_text") == F.col("_lost_key")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in columns), "_text", "_whole", "_starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, texts = [], [], [], []
            for value, whole, starts in zip(batch.column("_text"), batch.column("_whole").to_pylist(), batch.column("_starts"), strict=True):
                words = value.as_py().encode().split()
                kept = [] if whole else words
                if starts.is_valid and not whole:
                    change = np.zeros(len(words) + 1, np.int64)
                    gone = np.unique(starts.values.to_numpy())
                    change[gone] += 1
                    change[gone + window] -= 1
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(sha256(kept))
                texts.append(b" ".join(kept).decode() if removed[-1] else None)
            out = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out], [*columns, "n_words", "n_removed", "kept_sha256", "kept"])

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept", StringType())]
    return joined.mapInArrow(cut, StructType([*joined.select(*(F.col(f"`{c}`") for c in columns)).schema.fields, *added]))
