"""Byte-level BPE by a sentencepiece model that is written from a rank file.

Each byte of the vocabulary's byte strings is mapped to one printable character, each string becomes a piece whose
score is its negative rank, and normalisation is the identity. Sentencepiece then merges the pair of the best score
first, leftmost on ties: the pair of the lowest rank, which is what a rank-based byte-level BPE does. The text is cut
by the pre-token pattern; each pre-token is encoded separately, a pre-token that is itself in the vocabulary becomes
its id at once. Decoding maps ids to pieces, pieces to bytes.

A null text counts as empty; an empty text has no ids. One row in gives one row out, whatever its id, in place: no
shuffle, and memory is bounded by one batch of rows and the cache of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, small_batches, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a task remembers before it starts anew, and the longest that it remembers.
CACHED, LONGEST = 60_000, 32


def rank_file(spark: SparkSession, path: str | None = None) -> bytes:
    """The vocabulary's rank file: a path that the driver can open, by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return file.read()


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def ranked(data: bytes) -> list[bytes]:
    """The vocabulary's byte strings in order of rank."""
    pairs = (line.split() for line in data.splitlines() if line)
    ranks = {int(rank): base64.b64decode(text) for text, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def model_of(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model with these pieces, the id of each its place in the list."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    characters = byte_characters()
    model = pb.ModelProto()
    for rank, piece in enumerate(pieces):
        model.pieces.add(piece="".join(characters[b] for b in piece), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(pieces)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes inside a task; built there from the rank file's bytes."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = ranked(data)
        self.ids = {piece: i for i, piece in enumerate(self.pieces)}
        self.characters = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_of(self.pieces))
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def token_ids(self, pre_token: str) -> list[int]:
        found = self.known.get(pre_token)
        if found is None:
            raw = pre_token.encode()
            whole = self.ids.get(raw)
            found = [whole] if whole is not None else self.processor.encode(raw.decode("latin-1").translate(self.characters))
            if len(pre_token) <= LONGEST:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[pre_token] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for pre_token in self.cut(text):
            ids += self.token_ids(pre_token)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


def _tables(spark: SparkSession, path: str | None, pattern: str | None):
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    small_batches(spark)
    # The vocabulary: under 1 MB, whatever the input.
    return spark.sparkContext.broadcast((rank_file(spark, path), pattern))


def encode(documents: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with `ids`, an array of int."""
    tables = _tables(documents.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*tables.value)
        for batch in batches:
            yield pd.Series([np.array(codec.encode(t), np.int32) for t in batch], dtype=object)

    return documents.withColumn("ids", ids(whole_text(text)))


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with `decoded`, the bytes of the ids."""
    tables = _tables(encoded.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = ranked(tables.value[0])
        for batch in batches:
            yield pd.Series([b"".join([pieces[i] for i in row.tolist()]) for row in batch], dtype=object)

    return encoded.withColumn("decoded", back(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(documents: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with `ids` and round_trip: whether decoding them gives the text's bytes. Both ways run in one pass, so a
    task needs one Python worker."""
    tables = _tables(documents.sparkSession, path, pattern)

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(*tables.value)
        for batch in batches:
            ids, same = [], []
            for t in batch:
                own = codec.encode(t)
                ids.append(np.array(own, np.int32))
                same.append(codec.decode(own) == t.encode())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": same})

    coded = documents.select(*others(documents, "ids", "round_trip"), both(whole_text(text)).alias("_both"))
    return coded.select(*others(coded, "_both"), "_both.*")


def digests(documents: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with n_tokens, ids_sha256 (of the decimal ids, joined by a space) and decoded_sha256 of a round trip.

    Both ways run in the task that reads the row, so the ids themselves are never sent anywhere.
    """
    tables = _tables(documents.sparkSession, path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(*tables.value)
        decimal = [str(i) for i in range(len(codec.pieces))]
        for batch in batches:
            rows = []
            for t in batch:
                ids = codec.encode(t)
                shown = " ".join([decimal[i] for i in ids]).encode()
                rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = documents.select(*others(documents, "n_tokens", "ids_sha256", "decoded_sha256"), both(whole_text(text)).alias("_both"))
    return coded.select(*others(coded, "_both"), "_both.*")
