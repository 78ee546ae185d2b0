"""Periodic runs of words, by a dictionary of basic factors.

At level k every position is named after the 2^k words that begin there, names made of pairs of names of level k - 1. A
factor's successor is its next occurrence. In a run of period q the factor of the first power of two from q on recurs
exactly q later, at every position whose factor and its successor lie inside (a nearer one would give the run a shorter
period), so at that level, where successors within the factor's length lie, occurrences form progressions q apart, and positions
next to each other propose the same period. A stretch of such positions can't grow without its end words differing from those q
away; so stretches are runs, each found at one level. Positions whose factor doesn't recur in the document have no name
from there on, as no longer factor there recurs either; few are left after some levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_PERIODS = 6, 4
SLICE_BYTES = 1 << 20


def recurring(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positions at (ascending) with their keys, those whose key recurs: positions, names of keys, and the next position of the key (-1: none)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    after, before = np.append(same, False), np.append(False, same)
    names, following = np.empty(len(keys), np.int64), np.full(len(keys), -1, np.int64)
    names[order] = np.cumsum(~before) - 1
    following[order[:-1][same]] = at[order[1:][same]]
    kept = np.empty(len(keys), bool)
    kept[order] = after | before
    return at[kept], names[kept], following[kept]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Runs of words (numbers, equal for equal words) of documents that begin at bounds: first position, length and period, ordered so.

    A run has its smallest period and at least max(least, periods * period) words; periods is 4 at least.
    """
    ends = np.repeat(bounds[1:], np.diff(bounds))
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, size = [], 1
    keys = document * (words.max(initial=0) + 1) + words
    at, names, following = recurring(keys, np.arange(len(words)))
    while len(at):
        period = np.where(following < 0, 0, following - at)
        proposed = np.flatnonzero((2 * period > size) & (period <= size))
        if len(proposed):
            i, q = at[proposed], period[proposed]
            begins = np.append(True, (np.diff(i) != 1) | (np.diff(q) != 0) | (document[i[1:]] != document[i[:-1]]))
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(i)) - 1
            length = i[last] - i[first] + size + q[first]
            long = length >= np.maximum(least, periods * q[first])
            found.append(np.stack([i[first], length, q[first]], 1)[long])
        full = np.full(len(words), -1, np.int64)
        full[at] = names
        at, left = at[at + 2 * size <= ends[at]], names[at + 2 * size <= ends[at]]
        right = full[at + size]
        at, left, right = at[right >= 0], left[right >= 0], right[right >= 0]
        at, names, following = recurring(left * (names.max(initial=0) + 1) + right, at)
        size *= 2
    runs = np.concatenate([np.empty((0, 3), np.int64), *found])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_words, runs (array of start, length, period, by start then period) and collapsed, for each row of docs.

    start is a word number from 0. collapsed is the words that no run contains after its first period, joined by a space. Rows
    are independent: repeated rows, null ids and further columns need no care. Null and blank texts have no runs and an empty
    collapsed text. A task holds one slice of texts, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            lists = [x.split() if x else [] for x in batch.column("__text").to_pylist()]
            bounds = np.cumsum([0, *map(len, lists)])
            flat = [w for x in lists for w in x]
            words = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = find_runs(words, bounds)
            of = np.searchsorted(bounds, runs[:, 0], side="right") - 1
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            joined = []
            for i, x in enumerate(lists):
                own = kept[bounds[i] : bounds[i + 1]]
                joined.append(b" ".join(x if own.all() else [w for w, k in zip(x, own.tolist()) if k]))
            parts = [pa.array(c, pa.int64()) for c in (runs[:, 0] - bounds[of], runs[:, 1], runs[:, 2])]
            rows = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lists) + 1)), pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(bounds), pa.int64()), rows, pa.array(joined, pa.binary()).cast(pa.string())], names=[*keep, "n_words", "runs", "collapsed"])

    one = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(one)), T.StructField("collapsed", T.StringType())])
    return docs.select(*keep, F.col(text).cast("binary").alias("__text")).mapInArrow(run, schema)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a repetition to the end in the text of every tenth row by a hash of its key; rows of a null key or without words stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    x = docs.withColumns({"__h": h, "__words": F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))})
    g, n = F.floor(F.col("__h") / 10), F.size("__words")
    x = x.withColumn("__from", F.when(n > 0, (g % n).cast("int")))
    x = x.withColumn("__period", (1 + F.floor((n - F.col("__from")) / (3 + g % 8))).cast("int"))
    turns = F.ceil((n - F.col("__from")) / F.col("__period")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("__words", F.col("__from") + 1, F.col("__period")), turns))
    repeated = F.array_join(F.slice(F.concat(F.slice("__words", F.lit(1), F.col("__from")), again), F.lit(1), n), " ")
    return x.withColumn(text, F.when(F.col("__from").isNotNull(), repeated).otherwise(F.col(text))).drop("__h", "__words", "__from", "__period")


def run_table(docs: DataFrame) -> DataFrame:
    """The longest run of each document with planted repetitions, and digests of all runs and of the words kept."""
    x = periodic_runs(planted(docs.select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    x = x.withColumns({"longest": longest, "n_runs": F.size("runs").cast("long")})
    milli = F.floor(1000 * F.col("longest.length") / F.col("longest.period"))
    return x.select("doc_id", "n_runs", "longest.start", "longest.length", "longest.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
