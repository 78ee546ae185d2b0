"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier for each bit tells from byte n-grams whether the bit is set. The
classifiers are log-odds of n-gram frequencies, learned from counts that Spark sums over all labelled documents. A
text's bit scores are decoded to the codeword of least loss, weighed by how well each bit tells its two sides apart
in the learned frequencies; a small margin to the second codeword flags the text as ambiguous. The decoder rejects a
text that is ambiguous, that is far even from its nearest codeword, or that noise explains better than its language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .text import lower, raw, slices

BUCKETS = 1 << 15
GRAMS = (2, 3)
SLICE_BYTES = 1 << 19
EVIDENCE = 200.0
MARGIN = 0.1
#: So many languages are learned at most.
LANGUAGES = 256
NONE = "und"
#: A text whose loss to the nearest codeword is above this is rejected. Bits without any evidence lose log 2 = 0.69.
LOSS = 0.5
#: So is a text whose n-grams have, on average, a lower log-odds of its language against evenly drawn n-grams.
FIT = 0.5


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of each n-gram, and the row it is of, some of them at a time whatever the length of a text.

    Bytes that are ASCII but no letter count as one blank kind.
    """
    data, offsets = raw(column)
    data = lower(data)
    data[(data < 128) & ((data < 97) | (data > 122))] = 32
    for begin in range(0, len(data), SLICE_BYTES):
        piece = data[begin : begin + SLICE_BYTES + max(GRAMS) - 1].astype(np.uint32)
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.clip(offsets - begin, 0, len(piece))))
        for n in GRAMS:
            size = min(SLICE_BYTES, len(piece) - n + 1)
            if size < 1:
                continue
            code = np.zeros(size, np.uint32)
            for i in range(n):
                code = code * np.uint32(0x01000193) ^ piece[i : size + i]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
            inside = row[:size] == row[n - 1 : n - 1 + size]
            yield code[inside].astype(np.int32), row[:size][inside]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all docs (text, lang). Each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE_BYTES):
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), str), return_inverse=True)
            for buckets, rows in _grams(batch.column("text")):
                of = which[rows]
                for i in np.unique(of):
                    sums[langs[i]] = sums.get(langs[i], 0) + np.bincount(buckets[of == i], minlength=BUCKETS)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])

    counted = docs.select(F.col("text"), F.col("lang")).mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """One row of bits for each of n classes, far apart: all splits of up to 5 classes, else the best of drawn codes."""
    if n <= 5:
        columns = [c for c in product((0, 1), repeat=n) if c[0] == 1 and 0 in c]
        return np.array(columns, np.int8).T if columns else np.ones((n, 1), np.int8)
    bits, draw = 2 * math.ceil(5 * math.log2(n)), np.random.default_rng(n)
    apart = lambda c: min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
    return max((draw.integers(0, 2, (n, bits), dtype=np.int8) for _ in range(20)), key=apart)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # of each bit
    fits: np.ndarray  # language x bucket: log-odds of the language against evenly drawn n-grams


def fit(docs: DataFrame, most: int = LANGUAGES) -> Model:
    """From every row of docs whose text and lang are not null, for the most frequent languages.

    A label beyond the most languages of the greatest counts is not learned: what comes to the driver is one count for each learned
    language and n-gram bucket, at most most * BUCKETS. Labels of equal counts are taken in their order.
    """
    counted = cut(gram_counts(docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())))
    common = counted.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(most)
    found = counted.join(F.broadcast(common), "lang").select("lang", "bucket", "n").toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    codes = codewords(len(langs)) if langs else np.zeros((0, 1), np.int8)
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    weights, trust = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1])
    for b in range(codes.shape[1]):
        one, zero = share[codes[:, b] == 1], share[codes[:, b] == 0]
        if len(one) and len(zero):
            odds = np.log(one.mean(0)) - np.log(zero.mean(0))
            weights[:, b] = odds
            trust[b] = min((one @ odds).min(), -(zero @ odds).max())
    trust = np.maximum(trust, 1e-3)
    return Model(langs, codes, weights, trust / trust.sum() if len(trust) else trust, np.log(share * BUCKETS).astype(np.float32))


def _told(column: pa.Array, m: Model, margin: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: language, sureness, whether it is ambiguous, its least loss, and its nearest codeword."""
    n, bits = len(column), m.weights.shape[1]
    signs = m.codes.astype(np.float64) * 2 - 1
    score, number = np.zeros((n, bits)), np.zeros(n, np.int64)
    for buckets, rows in _grams(column):
        number += np.bincount(rows, minlength=n)
        for b in range(bits):
            score[:, b] += np.bincount(rows, m.weights[buckets, b], minlength=n)
    score /= np.maximum(number, 1)[:, None]
    letters = [bool(m.langs and text and any(map(str.isalpha, text))) for text in column.to_pylist()]
    if not m.langs:
        return [NONE] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64)
    loss = np.logaddexp(0, -6.0 * score[:, None, :] * signs[None]) @ m.trust
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * np.minimum(number, EVIDENCE)[:, None] / 4)
    odds /= odds.sum(1, keepdims=True)
    best, each = loss.argmin(1), np.arange(n)
    sure = odds[each, best]
    second = np.partition(odds, -2, axis=1)[:, -2] if len(m.langs) > 1 else np.zeros(n)
    pred = [m.langs[i] if ok else NONE for i, ok in zip(best, letters)]
    ok = np.array(letters, bool)
    return pred, np.where(ok, sure, 0.0), ok & (sure - second < margin), loss.min(1), best


def identify(docs: DataFrame, model: Model, margin: float = MARGIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score (0 to 1), ambiguous; from the text alone.

    Null texts and texts without a letter are "und", with score 0, as is all when nothing was learned. Repeated rows
    and null ids are rows like others; further columns are left out unless named in keep.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            pred, sure, doubt, _, _ = _told(batch.column("__text"), sent.value, margin)
            told = [pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(doubt, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *told], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, as they are, that the decoder does not reject.

    Rejected are null texts and texts without a letter, ambiguous texts, and those beyond LOSS or FIT; a single
    language has no bits to lose, so there FIT alone tells. Where nothing was learned all is rejected.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            m, column = sent.value, batch.column("text")
            pred, _, doubt, least, best = _told(column, m, margin)
            ok = np.array([x != NONE for x in pred], bool) & ~doubt
            if m.langs:
                fits, number = np.zeros(len(column)), np.zeros(len(column))
                for buckets, rows in _grams(column):
                    fits += np.bincount(rows, m.fits[best[rows], buckets], minlength=len(column))
                    number += np.bincount(rows, minlength=len(column))
                ok &= (fits >= FIT * np.maximum(number, 1)) & ((least <= LOSS) | (len(m.langs) == 1))
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def held_out_column() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the documents that are not held out."""
    model = fit(docs.filter(~held_out_column()))
    marked = docs.select("doc_id", "text", held_out_column().alias("held_out"))
    return identify(marked, model, keep=("doc_id", "held_out"))
