"""Substring deduplication over prefix-partitioned suffix trees.

A suffix is a document's words from some word on, down to the depth at which a repeat counts. Suffixes are dealt to
groups by a prefix of variable length: one word where few suffixes begin so, more words below common prefixes, until the
entries of a group fit the memory that a task may take; exact counts over all suffixes decide. A group's subtree is built from its
suffixes in order: the depth that neighbours share makes the internal nodes, whose edges are named by fingerprints of
their words. Every node at full depth is a repeat and knows the smallest document below it; its neighbours to the left and right
in a text are nodes too where the repeat is longer, so that runs of them are the maximal repeats, and their words go.

Before that, anchors leave out suffixes that cannot repeat. Of the shorter runs of words within a window the one of
least fingerprint is its anchor; equal windows have equal anchors, so a window whose anchor is in one document only
is in one document only. Texts travel packed in batches, and within a batch an anchor or suffix is sent once. So what
a batch sends of a repeat is one entry, however often the repeat occurs in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shuffle_partitions
from .text import raw, slices, window_prints, within, word_prints, word_spans

BATCH_BYTES = 2 << 20
GROUP_BYTES = 32 << 20
ENTRY_BYTES = 24  # of a suffix in a group: the two edges below the root, and the least document
#: Words of a prefix, until a group is small enough; a whole suffix is the last one.
DEPTHS = (1, 2, 3, 4, 6, 9)
COUNTED = 1024  # groups whose counts travel as one row
NO_ID = np.iinfo(np.int64).max


def pack(docs: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """batch, n_words, ids, offsets, data: the documents in batches of about limit bytes, compressed; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=3).compress
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "__text", limit):
            data, offsets = raw(batch.column("__text"))
            words = len(word_spans(data, offsets)[0])
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([words]), *(pa.array([pressed(x.tobytes())], pa.binary()) for x in (ids.astype(np.int64), offsets, data))],
                names=["batch", "n_words", "ids", "offsets", "data"],
            )
            number += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return cut(texts.mapInArrow(run, "batch long, n_words long, ids binary, offsets binary, data binary"))


class Batch:
    """A batch's documents, words and windows."""

    def __init__(self, row: dict, least: int):
        import zstandard

        read = zstandard.ZstdDecompressor().decompress
        self.ids = np.frombuffer(read(row["ids"]), np.int64)
        self.offsets = np.frombuffer(read(row["offsets"]), np.int64)
        self.data = np.frombuffer(read(row["data"]), np.uint8)
        starts, ends, self.bounds = word_spans(self.data, self.offsets)
        self.words = word_prints(self.data, starts, ends)
        self.least = least
        self.windows = within(self.bounds, least)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.bounds, at, side="right") - 1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, which of them each window has, and whether this batch has it in two documents."""
        length = (self.least + 1) // 2
        prints = window_prints(self.words, length)
        if not len(self.windows):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        reach = self.least - length + 1
        view = np.lib.stride_tricks.sliding_window_view(prints, reach)[self.windows]
        found, which = np.unique(view.min(1), return_inverse=True)
        low, high = least_and_most(self.owners(self.windows), which, len(found))
        return found, which, low != high

    def prefixes(self, depth: int, at: np.ndarray, groups: int) -> np.ndarray:
        """The group that the first words of each suffix would give."""
        prints = window_prints(self.words, min(depth, self.least))
        return (prints[at] % np.uint64(groups)).astype(np.int64) if len(at) else np.zeros(0, np.int64)

    def suffixes(self, repeated: np.ndarray, which: np.ndarray, heavy: list[np.ndarray], groups: int):
        """Of windows with a repeated anchor: where they begin, and of the distinct ones (by group): group, head, tail, least id."""
        at = self.windows[repeated[which]] if len(which) else self.windows
        half = self.least // 2
        head = window_prints(self.words, half)[at] if len(at) else np.zeros(0, np.uint64)
        tail = window_prints(self.words, self.least - half)[at + half] if len(at) else np.zeros(0, np.uint64)
        group = np.zeros(len(at), np.int64)
        open_ = np.ones(len(at), bool)
        for depth, full in zip((*DEPTHS, self.least), (*heavy, np.zeros(0, np.int64))):
            if open_.any():
                group[open_] = self.prefixes(depth, at[open_], groups)
                open_ &= np.isin(group, full)
        order = np.lexsort((tail, head, group))
        g, h, t = group[order], head[order], tail[order]
        new = np.ones(len(at), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        low, _ = least_and_most(self.owners(at), which, int(new.sum()))
        return at, which, g[new], h[new], t[new], low


def least_and_most(values: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, which, values)
    np.maximum.at(high, which, values)
    return low, high


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def from_planes(data: bytes, n: int, kind: type) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).view(kind).ravel()


def _answers(parts: list[dict] | None, n: int) -> np.ndarray:
    """The bits of all parts in order of part."""
    found = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(parts or [], key=lambda x: x["part"])]
    bits = np.concatenate(found).astype(bool) if found else np.zeros(0, bool)
    assert len(bits) == n, "an answer is missing"
    return bits


_BITS = "array<struct<part:int,n:int,bits:binary>>"


def _by_batch(answers: DataFrame) -> DataFrame:
    return answers.groupBy("batch").agg(F.collect_list(F.struct("part", "n", "bits")).alias("parts"))


def repeated_anchors(packed: DataFrame, least: int, parts: int) -> DataFrame:
    """batch, parts: for each batch's anchors in order, whether another document has it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, _, many = Batch(row, least).anchors()
                ends = np.searchsorted(found, np.array([(p << 64) // parts for p in range(1, parts)] or [0], np.uint64)) if parts > 1 else np.zeros(0, int)
                edges = np.concatenate([[0], ends, [len(found)]])
                some = np.flatnonzero(np.diff(edges))
                cells = [(found[edges[p] : edges[p + 1]].tobytes(), np.packbits(many[edges[p] : edges[p + 1]]).tobytes()) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["part", "batch", "prints", "many"])

    def meet(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()]
        sizes = np.array([len(x) for x in prints])
        all_, many = np.concatenate(prints), np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("many").to_pylist(), sizes)])
        order = np.argsort(all_, kind="stable")
        new = np.concatenate([[True], all_[order][1:] != all_[order][:-1]])
        node = np.cumsum(new) - 1
        often = (np.bincount(node) > 1) | (np.bincount(node, many[order]) > 0)
        bits = np.empty(len(all_), np.uint8)
        bits[order] = often[node]
        cuts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "n": pa.array(sizes, pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in cuts], pa.binary())})

    sent = packed.select("batch", "ids", "offsets", "data").mapInArrow(send, "part int, batch long, prints binary, many binary")
    return _by_batch(sent.groupBy("part").applyInArrow(meet, "batch long, part int, n int, bits binary"))


def group_counts(packed: DataFrame, anchors: DataFrame, least: int, groups: int) -> DataFrame:
    """depth, block, sums: what each task will send, by prefix length, for COUNTED groups at a time: rows are not one for each group and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(DEPTHS), groups), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row, least)
                found, which, _ = b.anchors()
                answers = _answers(row["parts"], len(found))
                at = b.windows[answers[which]] if len(which) else b.windows
                whole = window_prints(b.words, least)
                at = at[np.unique(whole[at], return_index=True)[1]] if len(at) else at
                for i, depth in enumerate(DEPTHS):
                    sums[i] += np.bincount(b.prefixes(depth, at, groups), minlength=groups)
        some = [(d, k, sums[d, k * COUNTED : (k + 1) * COUNTED]) for d in range(len(DEPTHS)) for k in range(-(-groups // COUNTED))]
        some = [(d, k, x.tobytes()) for d, k, x in some if x.any()]
        yield pa.RecordBatch.from_pylist([{"depth": d, "block": k, "sums": x} for d, k, x in some], pa.schema([("depth", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())]))

    joined = packed.join(anchors, "batch", "left").select("ids", "offsets", "data", F.col("parts").cast(_BITS).alias("parts"))
    return joined.mapInArrow(count, "depth int, block int, sums binary")


def heavy_prefixes(packed: DataFrame, anchors: DataFrame, least: int, limit: int, groups: int) -> list[np.ndarray]:
    """For each prefix length, the groups that would hold over limit entries by it, in order.

    Counts are of what batches will send, over all of them. All counts of a length add up to the entries, so no more than
    entries / limit groups of it come to the driver.
    """

    def heavy(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, block = (k.as_py() for k in key)
        total = np.int64(0)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total = total + np.frombuffer(x, np.int64)
        part = np.flatnonzero(total > limit) + block * COUNTED
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), depth), pa.int32()), pa.array(part, pa.int64())], names=["depth", "part"])

    found = group_counts(packed, anchors, least, groups).groupBy("depth", "block").applyInArrow(heavy, "depth int, part long").collect()
    return [np.sort(np.array([r["part"] for r in found if r["depth"] == d], np.int64)) for d in range(len(DEPTHS))]


def subtree(head: np.ndarray, tail: np.ndarray, low: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order of the suffixes, and of each internal node of their tree: depth, first leaf in that order, least document below.

    head and tail name the edges of the first least // 2 words and of the rest. Of suffixes in order, neighbours share
    all words, the first edge's, or fewer; a node is a run of leaves that share its depth.
    """
    order = np.lexsort((tail, head))
    h, t = head[order], tail[order]
    shared = np.zeros(len(order) + 1, np.int64)
    shared[1:-1] = np.where(h[1:] != h[:-1], 0, np.where(t[1:] != t[:-1], least // 2, least))
    nodes = []
    for depth in (least // 2, least):
        first = np.flatnonzero(shared[:-1] < depth)
        nodes.append((np.full(len(first), depth), first, np.minimum.reduceat(low[order], first) if len(first) else first))
    return order, *(np.concatenate(x) for x in zip(*nodes))


def repeated_suffixes(packed: DataFrame, anchors: DataFrame, least: int, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """batch, parts: for each batch's distinct suffixes in order, whether a smaller document of another batch has it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row, least)
                found, which, _ = b.anchors()
                _, _, group, head, tail, low = b.suffixes(_answers(row["parts"], len(found)), which, heavy, groups)
                edges = np.searchsorted(group, np.arange(groups + 1))
                some = np.flatnonzero(np.diff(edges))
                cells = [[x[edges[g] : edges[g + 1]] for x in (head, tail, low)] for g in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([len(c[0]) for c in cells], pa.int32()), pa.array([c[0].tobytes() for c in cells], pa.binary()), pa.array([c[1].tobytes() for c in cells], pa.binary()), pa.array([planes(c[2]) for c in cells], pa.binary())],
                    names=["part", "batch", "n", "head", "tail", "low"],
                )

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        head = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("head").to_pylist()])
        tail = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tail").to_pylist()])
        low = np.concatenate([from_planes(x, n, np.int64) for x, n in zip(table.column("low").to_pylist(), sizes)])
        order, depth, first, least_below = subtree(head, tail, low, least)
        deep = depth == least
        leaves = np.diff(np.append(first[deep], len(order)))
        bits = np.empty(len(head), np.uint8)
        bits[order] = np.repeat(least_below[deep], leaves) < low[order]
        cuts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "n": table.column("n"), "bits": pa.array([np.packbits(x).tobytes() for x in cuts], pa.binary())})

    joined = packed.join(anchors, "batch", "left").select("batch", "ids", "offsets", "data", F.col("parts").cast(_BITS).alias("parts"))
    sent = joined.mapInArrow(send, "part int, batch long, n int, head binary, tail binary, low binary")
    return _by_batch(sent.groupBy("part").applyInArrow(answer, "batch long, part int, n int, bits binary"))


def remove_repeats(docs: DataFrame, least: int = 13, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of start, end in words), kept (binary: kept words, one space between).

    A word goes if some window of least words that covers it also begins in a document of smaller doc_id. Null and
    empty texts have no words. Rows that share an id are one document and don't remove from each other; a null id
    counts as larger than all. An empty table gives no rows; further columns are left out. A group of suffixes holds
    about group_bytes; only one suffix that very many batches have can take more, at one entry a batch.
    """
    spark = docs.sparkSession
    packed = pack(docs)
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    limit = max(1, group_bytes // ENTRY_BYTES)
    groups = max(4 * shuffle_partitions(spark), -(-4 * total // limit))
    anchors = cut(repeated_anchors(packed, least, groups))
    heavy = heavy_prefixes(packed, anchors, least, min(limit, max(1, total // groups)), groups)
    nodes = repeated_suffixes(packed, anchors, least, heavy, groups).withColumnRenamed("parts", "nodes")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row, least)
                found, which, _ = b.anchors()
                at, which, _, head, _, low = b.suffixes(_answers(row["parts"], len(found)), which, heavy, groups)
                gone = _answers(row["nodes"], len(head))[which] | (b.owners(at) > low[which])
                edge = np.zeros(len(b.words) + 1, np.int64)
                np.add.at(edge, at[gone], 1)
                np.add.at(edge, at[gone] + least, -1)
                covered = np.cumsum(edge)[:-1] > 0
                text = b.data.tobytes()
                spans, kept = [], []
                for i in range(len(b.ids)):
                    mine = covered[b.bounds[i] : b.bounds[i + 1]]
                    words = text[b.offsets[i] : b.offsets[i + 1]].split()
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])])
                    kept.append(b" ".join(compress(words, ~mine) if len(turns) else words))
                sizes = np.diff(b.bounds)
                removed = np.concatenate([[0], np.cumsum(covered)])
                ids = pa.array(b.ids, mask=b.ids == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes), pa.array(removed[b.bounds[1:]] - removed[b.bounds[:-1]]), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "removed", "kept"],
                )

    x = packed.join(anchors, "batch", "left").join(nodes, "batch", "left")
    x = x.select("ids", "offsets", "data", F.col("parts").cast(_BITS).alias("parts"), F.col("nodes").cast(_BITS).alias("nodes"))
    return x.mapInArrow(keep, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept binary")


def substring_table(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
k AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS low FROM k GROUP BY t),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN m USING (t) WHERE low < doc_id),
a AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)"""
