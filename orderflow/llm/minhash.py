"""Near-duplicates by fast similarity sketching, banding and exact verification.

Fast similarity sketching fills t coordinates in rounds: in the first t rounds each element falls into one hashed bin a
round, in the next t rounds every element goes to the round's own bin, so that all coordinates are filled at the end
for certain; a coordinate keeps its least value, and earlier rounds win. Coordinates of two sets agree with a
probability equal to their Jaccard similarity, more closely concentrated than independent minima. Bands of coordinates
make buckets; documents of a bucket are compared on their full sets.

Within a bucket not all pairs are compared. Documents of equal sets are one from the start. In turns, the least
document of a bucket is compared with all others that are not in its component yet, then leaves the bucket. Only
buckets that still hold several components go on, so a bucket of like documents is done after one turn. What is left
then are mostly documents that share a passage but not most of their text, of which further turns would settle few. They
are paired by their rarest shingles instead: with shingles in one order, rare ones first, two sets at the wanted similarity must meet
within their first few, and far enough from their ends. This filter is exact, so no link between different components
is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .text import lower, mix, pair, raw, slices, window_prints, word_prints, word_spans

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 64, 6  # a pair at 0.75 shares no band with probability (1 - 0.75 ** 6) ** 64 = 4e-6, one at 0.2 shares one with 0.4 %
SLICE_BYTES = 2 << 20
TURNS = 1  # results are the same for any number


def shingle_sets(column: pa.Array, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of every row, one after another, and where each row's begin.

    A-Z are lower-cased. A row of fewer words than length has its whole sequence as one; without words none.
    """
    data, offsets = raw(column)
    data = lower(data)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_prints(data, starts, ends)
    sizes = np.diff(bounds)
    n = np.where(sizes >= length, sizes - length + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), n)
    at = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    prints = window_prints(np.concatenate([words, np.zeros(length, np.uint64)]), length)[at]
    for few in range(1, length):
        some = np.flatnonzero(sizes[row] == few)
        if len(some):
            prints[some] = window_prints(words, few)[at[some]]
    order = np.lexsort((prints, row))
    row, prints = row[order], prints[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
    return prints[new], np.searchsorted(row[new], np.arange(len(sizes) + 1))


def sketches(prints: np.ndarray, bounds: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """One row of t coordinates for each set; rows of empty sets mean nothing."""
    n = len(bounds) - 1
    sketch = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(n * t, bool)
    row = np.repeat(np.arange(n), np.diff(bounds))
    for turn in range(2 * t):
        if not len(row):
            break
        hashed = mix(prints ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (np.uint64(turn) << np.uint64(54)) | (hashed >> np.uint64(10))
        place = row * t + ((mix(hashed) % np.uint64(t)).astype(np.int64) if turn < t else turn - t)
        open_ = ~filled[place]
        np.minimum.at(sketch, place[open_], value[open_])
        filled[place[open_]] = True
        left = ~filled.reshape(n, t).all(1)
        keep = left[row]
        row, prints = row[keep], prints[keep]
    return sketch.reshape(n, t)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (16 bytes, equal for equal sets; null for empty ones), keys (a bucket for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            prints, bounds = shingle_sets(batch.column("__text"))
            sizes = np.diff(bounds)
            keys = sketches(prints, bounds).reshape(-1, ROWS)
            band = np.tile(np.arange(BANDS, dtype=np.uint64), len(sizes))
            found = mix((band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            for coordinate in keys.T:
                found = pair(found, coordinate)
            keys = found.view(np.int64)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(prints ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            same = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([s.tobytes() if n else None for s, n in zip(same, sizes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys)),
                ],
                names=["doc_id", "n_shingles", "same", "keys"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return texts.mapInArrow(run, "doc_id long, n_shingles long, same binary, keys array<long>")


def pressed(docs: DataFrame) -> DataFrame:
    """node, packed: each document's id and its text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "__text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([press(x or b"") for x in batch.column("__text").to_pylist()], pa.binary())], names=["node", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("__text")).filter("node IS NOT NULL").mapInArrow(run, "node long, packed binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs whose sets have an intersection of percent of their union or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in slices(batches, "right", SLICE_BYTES // 4):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            prints, bounds = shingle_sets(pa.array([unpress(x) for x in batch.column("right").to_pylist()], pa.large_binary()))
            yes = np.zeros(len(a), bool)
            for i, of in enumerate(batch.column("mark").to_pylist()):
                if held[0] != of:
                    held = (of, shingle_sets(pa.array([unpress(batch.column("left")[i].as_py())], pa.large_binary()))[0])
                left, right = held[1], prints[bounds[i] : bounds[i + 1]]
                both = len(left) + len(right)
                at = np.searchsorted(left, right)
                common = int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0
                yes[i] = 100 * common >= percent * (both - common) and common > 0
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, yes) if y], pa.int64()), pa.array([x for x, y in zip(b, yes) if y], pa.int64())], names=["a", "b"])

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("right")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("left")), "a")
    return both.select("a", "b", F.xxhash64("left").alias("mark"), "left", "right").mapInArrow(run, "a long, b long")


def rare_pairs(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of members (node, component) in different components, all those of that similarity among them.

    A set of n shingles shares at least percent of them with any like set, so that the two meet in the first
    n - ceil(n * percent / 100) + 1, and the smaller one in still fewer. From where they first meet, what follows in the
    shorter remainder must suffice for the intersection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed", SLICE_BYTES // 4):
            nodes, components_, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "mark"))
            prints, bounds = shingle_sets(pa.array([unpress(x) for x in batch.column("packed").to_pylist()], pa.large_binary()))
            n = np.diff(bounds)
            for begin in range(0, len(prints), 1 << 17):
                row = np.searchsorted(bounds, np.arange(begin, min(begin + (1 << 17), len(prints))), "right") - 1
                columns = [nodes[row], components_[row], marks[row], n[row], prints[begin : begin + len(row)].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["node", "component", "mark", "n", "print"])

    distinct = members.select("node", "component").distinct()
    sets = cut(distinct.join(texts, "node").select("node", "component", F.xxhash64("packed").alias("mark"), "packed").dropDuplicates(["node", "mark"]).mapInArrow(run, "node long, component long, mark long, n long, print long"))
    often = sets.groupBy("print").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node", "mark").orderBy("often", "print"))
    placed = sets.join(often, "print").withColumn("place", place)
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = cut(placed.filter((F.col("often") > 1) & (F.col("place") <= probe)))
    kept = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    small = first.filter(F.col("place") <= kept).select("print", F.col("node").alias("x"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("place").alias("i"))
    follow = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("place")) + 1
    meet = (
        (F.struct("m", "x") < F.struct("n", "node"))
        & (F.col("c") != F.col("component"))
        & (100 * F.col("m") >= percent * F.col("n"))
        & ((100 + percent) * follow >= percent * (F.col("m") + F.col("n")))
    )
    pairs = first.join(small, (small["print"] == first["print"]) & meet)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) with the components that links (a, b) join made one; only links between components are followed."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    x = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    step = cut(components(x.filter("a <> b").distinct()))
    moved = found.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return cut(moved.unionByName(step.join(found.select("node"), "node", "left_anti")))


def bucket_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, component for the linked nodes of members (key long, node long), by turns as told above."""
    found = cut(members.sparkSession.createDataFrame([], "node long, component long"))
    members = members.withColumn("component", F.col("node"))
    for turn in range(TURNS + 1):
        if turn < TURNS:
            first = members.groupBy("key").agg(F.min(F.struct("node", "component")).alias("first"))
            first = cut(first.select("key", F.col("first.node").alias("a"), F.col("first.component").alias("c")))
            pairs = members.join(first, "key").filter("component <> c").select("a", F.col("node").alias("b"))
        else:  # those that share a bucket with documents that they aren't like
            pairs = rare_pairs(members, texts)
        new = cut(verified(pairs.distinct(), texts))
        if new.limit(1).count():
            found = joined(found, new)
        if turn < TURNS:
            rest = members.join(first, "key").filter("node <> a").select("key", "node")
            rest = rest.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
            several = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
            members = cut(rest.join(cut(several), "key"))
            if not members.limit(1).count():
                break
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Rows of null or wordless text have an empty set and are linked with nothing; neither are rows without an id, whose
    component_id is null and which are kept. Rows that share an id are one document, linked by what any of its texts is like.
    An empty table gives no rows; further columns are left out.
    """
    base = cut(signatures(docs))
    some = base.filter("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    spread = classes.select("node", F.explode("keys").alias("key"))
    full = cut(spread.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("key"))
    members = cut(spread.join(full, "key").select("key", "node"))
    texts = cut(pressed(docs).join(members.select("node").distinct(), "node"))
    found = bucket_links(members, texts)
    several = some.groupBy("doc_id").agg(F.min("same").alias("s"), F.max("same").alias("t")).filter("s < t").select("doc_id")
    shared = cut(some.join(several, "doc_id").select("doc_id", "same").distinct().join(classes.select("same", "node"), "same").select("doc_id", "node"))
    if shared.limit(1).count():  # ids with different texts make one of their classes
        least = shared.groupBy("doc_id").agg(F.min("node").alias("a"))
        found = joined(found, shared.join(least, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    of = classes.select("same", "node").join(found, "node", "left").select(F.col("same").alias("of"), F.coalesce("component", "node").alias("c"))
    x = base.join(cut(of), F.col("same") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return x.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
