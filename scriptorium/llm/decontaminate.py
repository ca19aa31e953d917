"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are sequences of words (lower case A-Z, letters and digits only). The CGK embedding walks
through a sequence: at each step it emits the current word and, as a random bit of word and step says, stays or moves on.
Sequences at a small edit distance get embeddings at a small Hamming distance, as their walks fall into step again after
an edit. Bit-sampling LSH draws `SAMPLED` steps for each of `REPEATS` walks; an item's key is what its walk emits there.
Items are grouped by length (the longest of a group has at most GROUP times the words of the shortest), and each group
draws its steps over the whole walk of its shortest item, so a key samples all of an item and short items change nothing
for long ones. An item that a walk has left before its last sampled step has no key there; each group's first walk stays
inside all of its items, so equal passages always collide.

Every word of a document starts a window. What a walk emits from a sampled step on depends only on the word where it
stands then, so a walk is taken up at its first sampled step, at every word that begins an item's key, and leaves as soon
as it begins none. Places are left out from the first where no run of words is made of enough words of the group's items
to hold one of them, which loses nothing. The few walks that reach an item's whole key are followed back to the windows they come from. These are
candidates and are verified: the smallest word-level edit distance of the item to a window that starts at most as many
words off as edits are allowed, by bit parallel dynamic programming, must be at most `1 - similarity` of its words.

Recall: for an item that differs in a share e of its embedding, one walk finds it with probability (1 - e) ** SAMPLED.

The benchmark is sent to the tasks in shards of SHARD items and ITEM_WORDS words at most, so a shard's size is bounded
whatever the benchmark's; each shard is one more pass over the documents. Nothing is shuffled.

Null or empty texts and items match nothing. Items so short that `1 - similarity` of their words is less than one word
are matched by equality of all words.
Repeated items are reported each; repeated rows too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, small_batches, whole_text

SIMILARITY = 0.8
REPEATS, SAMPLED = 32, 3
#: Greatest ratio of the lengths in a group of items.
GROUP = 1.3
#: Bits of a word's number in a key; a shard has fewer words than that.
BITS = 21
#: Words that walk together in a task.
BLOCK = 400_000
SHARD, ITEM_WORDS = 20_000, 2_000_000
#: Bytes other than letters and digits become spaces.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in ASCII_LOWER)


def sequence(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def edit_within(item: dict[bytes, int], length: int, words: list[bytes], most: int, anywhere: bool = False) -> tuple[int, int]:
    """(distance, words used): the smallest edit distance of the item to a prefix of `words`, the longest such prefix.

    item: for each of its words the bit mask of its places. Python's integers hold the vertical differences of a column,
    so an item of any length is one step per word. anywhere: the distance to a passage that starts at any of `words`.
    """
    full, last = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, used = length, 0
    for at, word in enumerate(words if anywhere else words[: length + most], 1):
        equal = item.get(word, 0)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        # Where the text must begin here, the top row rises with each word.
        up, down = ((up << 1) | (not anywhere)) & full, (down << 1) & full
        plus, minus = down | ~(zero | up) & full, up & zero
        if score <= best:
            best, used = score, at
    return best, used


class Walks:
    """The items of a shard by their keys in each walk; built inside a task.

    Words are numbered by the items' vocabulary; all other words are one symbol, 0, which no item has.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 1):
        self.items = [(i, sequence(text)) for i, text in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.similarity = similarity
        self.masks: list[dict[bytes, int]] = []
        self.ids: dict[bytes, int] = {}
        for _, words in self.items:
            mask: dict[bytes, int] = {}
            for at, word in enumerate(words):
                mask[word] = mask.get(word, 0) | 1 << at
                self.ids.setdefault(word, len(self.ids) + 1)
            self.masks.append(mask)
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.slack = ((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        draw = np.random.default_rng(seed)
        groups: dict[int, list[int]] = {}
        least = group = 0
        for length in sorted({len(w) for _, w in self.items}):
            if length > least * GROUP:
                least, group = length, length
            groups.setdefault(group, []).extend(i for i, (_, w) in enumerate(self.items) if len(w) == length)
        #: By group: its words, the least length of a passage, the most words of it that are not the group's, the words around, the walks.
        self.groups = []
        for shortest, own in groups.items():
            walks = []
            there = np.zeros(len(self.ids) + 1, bool)
            there[[self.ids[w] for i in own for w in self.items[i][1]]] = True
            most, reach = int(self.slack[own].max()), int((self.lengths[own] + self.slack[own]).max())
            self.groups.append((there, int((self.lengths[own] - self.slack[own]).min()), most, reach, walks))
            for r in range(repeats if most else 1):  # where no edit is allowed, the first walk finds all
                # A walk advances by half a word a step on average, and never by more than one.
                steps = shortest if r == 0 else max(shortest, int(2 * shortest - (2 * shortest) ** 0.5))
                walk = self._walk(draw, own, steps, sampled)
                if walk:
                    walks.append(walk)
        #: The words of each item, as sorted pairs of item and word.
        self.pairs = np.unique(np.array([i << BITS | self.ids[w] for i, (_, words) in enumerate(self.items) for w in words], np.int64))

    def _walk(self, draw: np.random.Generator, own: list[int], steps: int, sampled: int):
        """The sampled steps, a bit for each word and step, and the group's items by the words that they emit there."""
        at = np.sort(draw.choice(steps, min(sampled, steps), replace=False)).tolist()
        bits = draw.integers(0, 1 << 62, len(self.ids) + 1, dtype=np.int64)
        keys: list[list[int]] = []
        members = []
        for item in own:
            words = self.items[item][1]
            cursor, emitted = 0, []
            for step in range(at[-1] + 1):
                if cursor >= len(words):
                    break
                word = self.ids[words[cursor]]
                if step in at:
                    emitted.append(word)
                cursor += int(bits[word]) >> step % 62 & 1
            if len(emitted) == len(at):
                keys.append(emitted)
                members.append(item)
        if not keys:
            return None
        opening = np.zeros(len(self.ids) + 1, bool)
        opening[[k[0] for k in keys]] = True
        # A key's number is its place among the keys of its length; with the next word it makes the next level's key.
        number = np.array([k[0] for k in keys], np.int64)
        levels = []
        for depth in range(1, len(at)):
            longer = number << BITS | np.array([k[depth] for k in keys], np.int64)
            levels.append(np.unique(longer))
            number = np.searchsorted(levels[-1], longer)
        by_key: dict[int, list[int]] = {}
        for item, k in zip(members, number.tolist(), strict=True):
            by_key.setdefault(k, []).append(item)
        return at, bits, opening, levels, by_key

    def candidates(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and items of the windows that share a key with an item.

        text: numbers of words, 0 after each document; begins: where documents begin.
        """
        starts, items = [], []
        # Walks that leave the last document stay among words that no item has.
        ahead = np.concatenate([text, np.zeros(max([0, *(walk[0][-1] for group in self.groups for walk in group[4])]) + 2, np.int64)])
        for live, first, (at, bits, opening, levels, by_key) in ((live, text[live], walk) for group in self.groups for live in [self._live(text, *group[:4])] for walk in group[4]):
            begun = opening[first]
            start, key = live[begun], first[begun]
            cursor, level = start.copy(), 0
            for step in range(at[0], at[-1] + 1):
                word = ahead[cursor]
                if level < len(levels) and step == at[level + 1]:
                    key = key << BITS | word
                    place = np.minimum(np.searchsorted(levels[level], key), len(levels[level]) - 1)
                    keep = levels[level][place] == key
                    start, cursor, key, word = start[keep], cursor[keep], place[keep], word[keep]
                    level += 1
                if not len(start):
                    break
                # The bit is taken of the words or of the places, whichever are fewer.
                cursor += (bits >> step % 62 & 1)[word] if len(bits) < len(word) else bits[word] >> step % 62 & 1
            if not len(start):
                continue
            # Back from the first sampled step to the windows; one that would start in the document before starts here.
            floor = begins[np.searchsorted(begins, start, "right") - 1]
            for step in range(at[0] - 1, -1, -1):
                stays = bits[text[start]] >> step % 62 & 1 == 0
                prior = np.maximum(start - 1, 0)
                moves = (start > floor) & (bits[text[prior]] >> step % 62 & 1 == 1)
                edge = (start == floor) & ~stays
                stays |= edge
                start, key, floor = (np.concatenate([x, y]) for x, y in ((start[stays], prior[moves]), (key[stays], key[moves]), (floor[stays], floor[moves])))
            for s, k in zip(start.tolist(), key.tolist(), strict=True):
                for item in by_key[k]:
                    starts.append(s)
                    items.append(item)
        pairs = np.unique(np.array(starts, np.int64) << BITS | np.array(items, np.int64))
        return self._possible(text, pairs >> BITS, pairs & ((1 << BITS) - 1))

    @staticmethod
    def _live(text: np.ndarray, there: np.ndarray, length: int, most: int, reach: int) -> np.ndarray:
        """The places around runs of `length` words of which all but `most` are the group's: each edit brings in one other word at most."""
        n = len(text)
        others = np.zeros(n + length + 1, np.int32)
        np.cumsum(~there[text], out=others[1 : n + 1])
        others[n + 1 :] = others[n] + np.arange(1, length + 1)
        dense = np.zeros(n + 2 * reach + 2, np.int32)
        np.cumsum(others[length : length + n] - others[:n] <= most, out=dense[reach + 1 : reach + n + 1])
        dense[reach + n + 1 :] = dense[reach + n]
        return np.flatnonzero(dense[2 * reach + 1 : 2 * reach + 1 + n] > dense[:n])

    def _possible(self, text: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose windows, wider at both ends by the words that they may be off, have enough of the item's words.

        An edit distance is at least the number of the item's words that the window can't match. Word by word, windows
        go as soon as what is left of them can't make up for what they lack.
        """
        length, slack = self.lengths[items], self.slack[items]
        missed, at = np.zeros(len(starts), np.int64), 0
        live = np.arange(len(starts))
        done = [np.empty(0, np.int64)]
        while len(live):
            # Of length + 3 * slack + 2 words, length - slack must be the item's.
            wide = length[live] + 3 * slack[live] + 2
            ended = wide <= at
            done.append(live[ended])
            live = live[~ended]
            place = starts[live] + at - slack[live] - 1
            word = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], 0)
            key = items[live] << BITS | word
            known = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            missed[live] += ~known
            live = live[missed[live] <= 4 * slack[live] + 2]
            at += 1
        kept = np.sort(np.concatenate(done))
        return starts[kept], items[kept]

    def all_matches(self, texts: Iterable[str]) -> Iterator[list[tuple[int, int, int, int, float]]]:
        """matches() of each text; texts walk together, some hundred thousand words at a time."""
        get, block, size = self.ids.get, [], 0
        for text in texts:
            words = sequence(text) if self.items else []
            block.append(words)
            size += len(words) + 1
            if size >= BLOCK:
                yield from self._matches(block, get)
                block, size = [], 0
        yield from self._matches(block, get)

    def _matches(self, block: list[list[bytes]], get) -> Iterator[list[tuple[int, int, int, int, float]]]:
        if not self.items:
            yield from ([] for _ in block)
            return
        ends = np.cumsum([len(words) + 1 for words in block]).tolist()
        numbers = np.zeros(ends[-1] if ends else 0, np.int64)
        for words, end in zip(block, ends, strict=True):
            numbers[end - 1 - len(words) : end - 1] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        starts, items = self.candidates(numbers, np.array([0, *ends[:-1]])) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))
        bounds = np.searchsorted(starts, [0, *ends]).tolist()
        for d, words in enumerate(block):
            own = slice(bounds[d], bounds[d + 1])
            yield self._verified(words, (starts[own] - (ends[d - 1] if d else 0)).tolist(), items[own].tolist())

    def matches(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, last word + 1, edit distance, similarity) of every item that the text holds, the best place of each."""
        return next(self.all_matches([text]))

    def _verified(self, words: list[bytes], starts: list[int], items: list[int]) -> list[tuple[int, int, int, int, float]]:
        best: dict[int, tuple[int, int, int]] = {}
        met: set[tuple[int, int]] = set()
        tried: set[tuple[int, int]] = set()
        for s, k in zip(starts, items, strict=True):
            length = len(self.items[k][1])
            most = int(self.slack[k])
            # Places are tried in rising order, so after an equal passage none is better.
            if k in best and not best[k][0]:
                continue
            around = words[max(s - most - 1, 0) : s + length + 2 * most + 1]
            if (s, k) in met or edit_within(self.masks[k], length, around, most, anywhere=True)[0] > most:
                continue
            met.add((s, k))
            for first in range(s - most - 1, s + most + 2):
                if first < 0 or first >= len(words) or (first, k) in tried:
                    continue
                tried.add((first, k))
                distance, used = edit_within(self.masks[k], length, words[first : first + length + most], most)
                if distance <= most and (k not in best or (distance, first) < best[k][:2]):
                    best[k] = (distance, first, first + used)
                if not distance:
                    break
        return [(self.items[k][0], a, b, d, 1 - d / len(self.items[k][1])) for k, (d, a, b) in sorted(best.items())]


def _shards(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, one after the other."""
    shard, words = [], 0
    for row in benchmark.select(F.col(item_id).alias("id"), whole_text(text).alias("text")).toLocalIterator():
        size = len(row["text"].split())
        if shard and (len(shard) >= SHARD or words + size > ITEM_WORDS):
            yield shard
            shard, words = [], 0
        shard.append((row["id"], row["text"]))
        words += size
    yield shard


def find(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance and similarity: a row for each item that a document holds."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    out = None
    for shard in _shards(benchmark, item_id, item_text):
        sent = documents.sparkSession.sparkContext.broadcast(shard)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            walks = Walks(sent.value, similarity)
            for batch in batches:
                found = [(i, *m) for i, own in zip(batch["doc_id"].astype("Int64").array, walks.all_matches(batch["text"]), strict=True) for m in own]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(search, "doc_id long, item_id long, first_word long, end_word long, distance long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(sent, similarity: float) -> Callable:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walks = Walks(sent.value, similarity)
        for batch in batches:
            yield pd.Series([not own for own in walks.all_matches(batch)], dtype="bool")

    return clean


def without_items(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that hold no item, unchanged; each row is judged where it is read, so nothing is shuffled."""
    small_batches(documents.sparkSession)
    for shard in _shards(benchmark, item_id, item_text):
        documents = documents.where(_clean(documents.sparkSession.sparkContext.broadcast(shard), similarity)(whole_text(text)))
    return documents
