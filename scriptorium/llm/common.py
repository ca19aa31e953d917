"""What the operators of this subpackage share: text rules, held-out rows, written tables, hashed words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, written  # noqa: F401  for the operators

#: A word is a run of anything but the six ASCII white-space characters.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that lower-case A-Z and leave every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def whole_text(name: str = "text") -> Column:
    """The column, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; a text without any gives one empty string."""
    return F.split(F.btrim(text, F.lit(SPACE_CHARS)), SPACES)


def others(frame: DataFrame, *names: str) -> list[Column]:
    """The frame's columns but those of these names: an operator's output replaces input columns of the same name."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken]


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; what splits rows into learned and held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % modulus


#: Bytes of texts that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to BATCH_BYTES, as texts may be long: what a worker holds at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


class WordHashes(dict):
    """Bytes of a word to its 64-bit hash. Long words are not kept, and it is emptied when it has grown to `limit` words,
    so its memory is bounded (some 45 MB)."""

    def __init__(self, seed: int = 0, limit: int = 250_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that their low and high bits can be used alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive words, by a polynomial over the ring of 64-bit integers."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_ODD, len(hashes)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _powers(_INVERSE, count))
