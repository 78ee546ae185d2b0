"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their boundary.

Encodings of two neighbours are joined by encoding a window across the boundary anew. The window grows until both
tokens at its edges are compatible with their outer neighbours. Two neighbouring tokens are compatible if the text
of the two encodes to just these two; when all neighbours in a sequence are compatible, no merge can cross any
token's edge, so the sequence is the encoding of its text. Tokens outside the window are therefore final.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices

LEAF_BYTES = 2
KEPT_BYTES = 8
CACHED_PIECES = 250_000
SLICE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeEncoder:
    """Encodes one piece of text, as bytes, by reduction over a tree of halves."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """By the definition: the pair of lowest rank is merged, leftmost first, until no pair has a rank."""
        rank_of, none = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.compatible_pairs.get((left, right))
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.compatible_pairs) > CACHED_PIECES:
                self.compatible_pairs.clear()
            self.compatible_pairs[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        reach = 1
        while True:
            i, k = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(self.text([*left[i:], *right[:k]]))
            before = i == 0 or self.compatible(left[i - 1], window[0])
            after = k == len(right) or self.compatible(window[-1], right[k])
            if before and after:
                return [*left[:i], *window, *right[k:]]
            reach *= 2

    def encode(self, data: bytes) -> list[int]:
        """The tree's reduction; short halves, which many pieces share, are kept."""
        if len(data) <= self.leaf:
            return self.merged(data)
        known = self.halves.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.encode(data[:half]), self.encode(data[half:]))
            if len(data) <= KEPT_BYTES:
                if len(self.halves) > CACHED_PIECES:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """A whole piece that is itself a token stays whole."""
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.encode(data)

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Ids of a piece, as bytes of 32-bit numbers. Broadcast empty, it fills on each worker and serves all its tasks."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoder = TreeEncoder(ranks)

    def __reduce__(self):
        return _Pieces, (self.encoder.ranks,)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        found = self[piece] = array("i", self.encoder.piece(piece.encode())).tobytes()
        return found


def _encoded(batches: Iterator[pa.RecordBatch], ids_of: Callable[[str], bytes], pattern: str, keep: tuple[str, ...], into: str) -> Iterator[pa.RecordBatch]:
    """The columns keep, and into: the ids of each __text."""
    import regex

    split = regex.compile(pattern).findall
    for batch in slices(batches, "__text", SLICE_BYTES):
        ids = [b"".join(map(ids_of, split(x))) if x else b"" for x in batch.column("__text").to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, into])


def _decoded(batches: Iterator[pa.RecordBatch], tokens: dict[int, bytes], ids: str, keep: tuple[str, ...], into: str) -> Iterator[pa.RecordBatch]:
    """The columns keep, and into: the bytes of each list of ids."""
    texts = np.empty(max(tokens, default=-1) + 1, object)
    for rank, text in tokens.items():
        texts[rank] = text

    def up(parts: list[bytes]) -> bytes:
        while len(parts) > 1:
            parts = list(map(add, parts[::2], [*parts[1::2], b""] if len(parts) % 2 else parts[1::2]))
        return parts[0] if parts else b""

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            lists = pc.fill_null(part.column(ids), [])
            all_, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(lists).to_numpy())
            found = pa.array([up(texts[x].tolist()) for x in np.split(all_, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found], names=[*keep, into])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "ids", keep: tuple[str, ...] = ("doc_id",), decoded: str = "") -> DataFrame:
    """The columns keep, and into: the token ids of the whole text as array<int>.

    Each match of pattern is encoded separately. Null and empty texts give an empty array. Rows are independent:
    repeated rows, null ids and any further columns need no care; a column named as into is replaced. ranks is
    broadcast; its size is that of the vocabulary. An empty table gives an empty one. decoded, if given, names a further
    column of what the ids decode to, made by the same worker, so that a second one need not hold the vocabulary.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_Pieces(ranks))
    keep = tuple(c for c in keep if c not in (into, decoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        ids = _encoded(batches, pieces.__getitem__, pattern, keep, into)
        return _decoded(ids, pieces.encoder.tokens, into, (*keep, into), decoded) if decoded else ids

    made = [T.StructField(into, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *made]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and into: the bytes of the ids, concatenated up a tree, neighbours in pairs. Null ids: no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, {rank: text for text, rank in sent.value.items()}, "__ids", keep, into)

    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(into, T.BinaryType())])
    return encoded.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for each document."""
    x = encode(docs, ranks, pattern, decoded="decoded")
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
