"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary.

Method: a segment tree over the byte positions of a piece holds the leftmost minimum pair rank; each merge takes the root and
makes logarithmic point updates on the live neighbours. Long words therefore cost n log n. The corpus repeats its words, so a
bounded cache keeps the ids of words, as bytes, and a text is encoded by joining them.

Defined results: null and empty text give an empty list; blank text is encoded like any other; repeated rows come out as
often as they stand in the table; surrogates that cannot be encoded are replaced; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pattern that cuts a text into words before the merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_NONE = 1 << 62
_CACHE_MOST = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of least rank is merged."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # leaf i: rank << 32 | i of the pair that starts at i, so that a minimum is the leftmost of least rank
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # end of the live token that starts here
    start = list(range(-1, n))  # start of the live token before this position
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for at in range(size - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def update(i: int, value: int) -> None:
        at = size + i
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        right = end[i]
        after = end[right]
        end[i] = after
        if after < n:
            start[after] = i
            rank = ranks.get(piece[i : end[after]])
            update(i, _NONE if rank is None else rank << 32 | i)
        else:
            update(i, _NONE)
        update(right, _NONE)
        if (before := start[i]) >= 0:
            rank = ranks.get(piece[before:after])
            update(before, _NONE if rank is None else rank << 32 | before)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _BesideBlank(Exception):
    """A blank next to other white space: the text can't be cut there."""


class _Words(dict):
    """Word to ids, as bytes; a word not yet known is encoded with `before` in front of it."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        if self.before and (not word or word[0].isspace() or word[-1].isspace()):
            raise _BesideBlank
        ids = self.encoder.stretch(self.before + word)
        if len(word) <= 64:
            if len(self) >= _CACHE_MOST:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Text to ids, as little-endian int32 bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall
        self.after_blank, self.pieces = _Words(self, " "), {}

    def stretch(self, text: str) -> bytes:
        """The ids of a text cut into pieces by the pattern."""
        known, out = self.pieces, []
        for piece in self.find(text):
            if (ids := known.get(piece)) is None:
                ids = np.array(merge_piece(piece.encode("utf-8", "replace"), self.ranks), "<i4").tobytes()
                if len(piece) <= 64:
                    if len(known) >= _CACHE_MOST:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """A single blank between two other characters always begins a new piece, so the words between may be cached."""
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace() or (rest and not first):
                raise _BesideBlank
            return self.stretch(first) + b"".join(map(self.after_blank.__getitem__, rest))
        except _BesideBlank:
            return self.stretch(text)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared: Broadcast) -> Encoder:
    """One encoder of a vocabulary file, with its cache, for each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def token_ids(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS):
    """A column function from text to array<int>. The vocabulary, about 1 MB whatever the corpus, is broadcast."""
    ranks = spark.sparkContext.broadcast(read_ranks(f"{folder}/{vocabulary}"))

    @arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        encoder = _encoder(f"{folder}/{vocabulary}", ranks)
        parts = [encoder.encode(t) if t else b"" for t in text.to_pylist()]
        offsets = np.cumsum([0, *(len(p) >> 2 for p in parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return encode


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids for every row of df, in one pass without a shuffle."""
    return df.select(F.col(key).alias("doc_id"), token_ids(df.sparkSession, vocabulary, folder)(F.col(text)).alias("ids"))


def encode_all(texts: Iterable[str | None], ranks: dict[bytes, int]) -> list[list[int]]:
    """The same on plain values, for tests."""
    encoder = Encoder(ranks)
    return [np.frombuffer(encoder.encode(t), "<i4").tolist() if t else [] for t in texts]
