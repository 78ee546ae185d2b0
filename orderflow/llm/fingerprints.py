"""Fingerprints of documents: digests of the quartiles of byte triplet counts, compared by a bounded difference.

The triplets of a text are every first byte with two of the four that follow it, in six shapes. Each is hashed to a
bucket. A bucket's code is the quartile its count falls in, 0 to 3. A fingerprint is, in lowercase hex: a check byte of the
text, its length on a scale of tenths, first and second quartile in fifteenths of the third, then the codes, four a
byte. Counts are sums, so a long text is counted in windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shuffle_partitions
from .text import raw, slices

BUCKETS = 256
SHAPES = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
#: Odd multipliers, one a shape; the top bits of a product are the bucket.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
#: Texts as long as the i-th of these have at least i + 1 as their length: powers of 1.1, rounded up.
LENGTHS = np.unique(np.ceil(1.1 ** np.arange(255)).astype(np.int64))
#: A step of a code, a length or a quartile ratio counts one; of lengths at most so many. Differences from BOUND on are all alike.
MOST_STEPS = 16
BOUND = 3 * BUCKETS // 2
WINDOW = 1 << 20
SLICE_BYTES, SLICE_ROWS = 2 << 20, 2048


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many triplets of each row of bytes fall in each bucket. Rows of under three bytes have none."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, np.int64)
    reach = max(k for _, k in SHAPES)
    for begin in range(0, len(data), WINDOW):
        wide = data[begin : begin + WINDOW + reach].astype(np.uint32)
        row = np.repeat(np.arange(rows), np.diff(np.clip(offsets, begin, begin + len(wide))))
        for multiplier, (j, k) in zip(MULTIPLIERS, SHAPES):
            n = min(WINDOW, len(wide) - k)
            if n > 0:
                bucket = ((wide[:n] | wide[j : j + n] << np.uint32(8) | wide[k : k + n] << np.uint32(16)) * multiplier) >> SHIFT
                inside = row[:n] == row[k : k + n]
                counts += np.bincount((row[:n] * BUCKETS + bucket)[inside], minlength=len(counts))
    return counts.reshape(rows, BUCKETS)


def digests(texts: pa.Array) -> list[str]:
    """The fingerprint of each text; null is empty. That of a text without triplets has its check byte and length only."""
    data, offsets = raw(texts)
    counts = bucket_counts(data, offsets)
    quarter = np.sort(counts, axis=1)[:, BUCKETS // 4 - 1 :: BUCKETS // 4][:, :3]
    codes = (counts[:, :, None] > quarter[:, None, :]).sum(2).astype(np.uint8).reshape(len(counts), -1, 4)
    out = np.zeros((len(counts), 3 + BUCKETS // 4), np.uint8)
    out[:, 0] = [zlib.crc32(data[a:b]) & 255 for a, b in zip(offsets, offsets[1:])]
    out[:, 1] = np.searchsorted(LENGTHS, np.diff(offsets), side="right")
    ratios = 15 * quarter[:, :2] // np.maximum(quarter[:, 2:], 1)
    out[:, 2] = ratios[:, 0] << 4 | ratios[:, 1]
    out[:, 3:] = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return [row.tobytes().hex() for row in out]


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """1 less the difference of each two fingerprints, as a share of BOUND."""
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), 3 + BUCKETS // 4).astype(np.int64) for s in (a, b))
    difference = (x[:, 0] != y[:, 0]) + np.minimum(np.abs(x[:, 1] - y[:, 1]), MOST_STEPS)
    for shift in (0, 4):
        difference = difference + np.abs((x[:, 2] >> shift & 15) - (y[:, 2] >> shift & 15))
    for shift in (0, 2, 4, 6):
        difference = difference + np.abs((x[:, 3:] >> shift & 3) - (y[:, 3:] >> shift & 3)).sum(1)
    return 1.0 - np.minimum(difference, BOUND) / BOUND


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint of a text column; equal texts have equal ones, null that of the empty text."""
    table = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = (p for s in slices(iter([table]), "text", SLICE_BYTES) for p in _few(s))
    return pa.array([d for p in parts for d in digests(p.column("text"))], pa.string())


@F.arrow_udf(T.DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """How alike two fingerprints are, from 0 to 1, which equal ones are; null where one is null."""
    out = np.full(len(a), np.nan)
    both = pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False)
    if both.any():
        out[both] = likenesses(a.filter(pa.array(both)).to_pylist(), b.filter(pa.array(both)).to_pylist())
    return pa.array(out, pa.float64(), mask=~both)


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE_ROWS) for i in range(0, batch.num_rows, SLICE_ROWS))


def _place(bounds: list[int], key: Column) -> Column:
    """How many bounds, which ascend, are at most key; null keys come before all. A binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.lit(bounds)
    onward = lambda at, step: (at + step <= len(bounds)) & (F.get(known, at + step - 1) <= key)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(onward(at, step), at + step).otherwise(at))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, __part, __last: docs in key ranges, each range ending with the row that follows it.

    Ranges are cut at keys that occur, taken from one aggregation of the keys (a bounded sketch), so each row of
    a bound is also sent to the range before, and those of the least key to the last range, marked __last. Rows of a null key
    come first; rows that share a key are ordered by text. Within a partition rows are in order, marked ones at its end.
    """
    parts = shuffle_partitions(docs.sparkSession)
    x = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))
    found = x.agg(cuts.alias("cuts"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted(set(found["cuts"] or []) - {found["least"]})
    part = _place(bounds, F.col("doc_id"))
    first = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["least"])
    at_bound = F.coalesce((F.col("__part") > 0) & (F.col("doc_id") == F.get(F.lit(bounds or [0]), F.col("__part") - 1)), F.lit(False))
    places = F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("last")), F.when(first, F.struct(F.lit(len(bounds)).alias("part"), F.lit(True).alias("last"))), F.when(at_bound, F.struct((F.col("__part") - 1).alias("part"), F.lit(True).alias("last"))))
    x = x.withColumn("__part", part).withColumn("__place", F.explode(F.array_compact(places)))
    x = x.select("doc_id", "text", F.col("__place.part").alias("__part"), F.col("__place.last").alias("__last"))
    return x.repartitionById(len(bounds) + 1, "__part").sortWithinPartitions("__last", F.col("doc_id").asc_nulls_first(), "text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint for each row of docs.

    edited: the text with its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by ascending id, after the last by those of the first; a document alone follows itself. Null texts are
    empty; null ids come first; rows that share an id follow each other by text. An empty table gives no rows. Each text
    moves once, and a task holds one slice of texts (or one longer text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, ended = None, False  # waiting: the last row, until what follows it is known
        for whole in slices(batches, "text", SLICE_BYTES):
            for batch in _few(whole):
                if ended:  # only rows after the first marked one are left
                    continue
                own = batch.num_rows - pc.sum(batch.column("__last").cast(pa.int64())).as_py()
                batch = batch.slice(0, own + 1)  # of the marked rows the first
                rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), digests(batch.column("text"))))
                if waiting:
                    rows.insert(0, waiting)
                    own += 1
                waiting = rows[-1] if own == len(rows) else None
                if pairs := list(zip(rows[:own], rows[1:])):
                    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t, _), (_, n, _) in pairs]
                    column = pa.array(edited, pa.string())
                    found = [[d for d, _, _ in rows[: len(pairs)]], [len(t) for _, t, _ in rows[: len(pairs)]], column, [p for _, _, p in rows[: len(pairs)]], digests(column), [n for _, (_, _, n) in pairs]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(found, kinds)], names=names)
                ended = own < len(rows)

    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    schema = T.StructType([T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, kinds)])
    return followed(docs, key, text).mapInArrow(run, schema)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """edited_fingerprints with the edited text as a digest, and the likeness of each fingerprint to that of the edited text and of the next document."""
    near = {"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint")}
    x = edited_fingerprints(docs).withColumn("edited_sha256", F.sha2("edited", 256)).withColumns(near)
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
