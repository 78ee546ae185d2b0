"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt out to blocks, and each block's vectors are sorted by every dimension, once, into lists that are
written. A query walks a block's lists from the end that its sign favours, some entries of each list at a time, scores the
vectors that it has not seen yet, and stops when the sum over the lists of what the next entry could still add is below
its kth score (on an equal bound it goes on, as ids break ties). First each query meets one block; the kth score it has
there goes with it to all others, which it leaves at once if their highest and lowest components can't beat that. The k
best of each block are then ranked together; what a block leaves out has k better ones.

The bound stops early where few dimensions decide, or blocks differ. For unit vectors in 64 even directions it can't: at
51,282 of them lists are walked to 29 % of their length, and in 64 lists that meets every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import dimensions, packed, rows, unpack, usable

ROWS = 4096
QUERIES = 512
STEP = 64
NONE = -(1 << 62)


def falling(data: np.ndarray) -> np.ndarray:
    """One list a dimension: positions by falling component, as uint32."""
    return np.ascontiguousarray(np.argsort(-data, axis=0, kind="stable").T.astype(np.uint32))


class SortedLists:
    """A block's vectors, and their lists."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, order: np.ndarray | None = None):
        """data: whole numbers, as float64 whose products and sums here are exact below 2 ** 53, or as int64."""
        self.ids, self.data = ids, data
        order = falling(data) if order is None else order
        self.order = np.stack([order[:, ::-1], order]).astype(np.int64)  # by the sign of a query's component: from the least, from the highest
        self.values = np.take_along_axis(np.broadcast_to(data.T, self.order.shape), self.order, 2)
        self.scored = 0

    def top(self, query: np.ndarray, k: int, leave_out: int, floor: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (fewer if there are fewer), without the id leave_out; those below floor may be missing."""
        n, used = len(self.ids), np.flatnonzero(query)
        side, weight = (query[used] > 0).astype(np.int64), query[used]
        seen = self.ids == leave_out
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.data.dtype)
        depth, step = 0, STEP
        while True:
            if len(used) and weight @ self.values[side, used, depth] < max(floor, best[-1] if len(best) == k else NONE):
                break
            end = min(n, depth + step) if len(used) else n
            near = np.zeros(n, bool)
            near[self.order[side, used, depth:end].ravel() if len(used) else slice(None)] = True
            new = np.flatnonzero(near & ~seen)
            seen[new] = True
            self.scored += len(new)
            score = self.data[new] @ query
            if len(new) > k:
                high = score >= np.partition(score, -k)[-k]
                new, score = new[high], score[high]
            best_ids, best = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, score])
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
            if end == n:
                break
            depth, step = end, step * 2
        return best_ids, best.astype(np.int64)


def with_lists(blocks: DataFrame, d: int, kind: type) -> DataFrame:
    """blocks (block, ids, data) with order: their lists, made once and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in rows(batches):
            _, data = unpack(x["ids"], x["data"], d, kind)
            yield pa.RecordBatch.from_arrays([pa.array([x["block"]], pa.int64()), *(pa.array([v], pa.binary()) for v in (x["ids"], x["data"], falling(data).tobytes()))], names=["block", "ids", "data", "order"])

    return cut(blocks.select("block", "ids", "data").mapInArrow(run, "block long, ids binary, data binary, order binary"))


def exact_kind(vectors: DataFrame, queries: DataFrame, d: int) -> type:
    """What scores are exact in: float64 below 2 ** 53, else int64; ArithmeticError where they may not fit a long."""
    most = [x.agg(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))))).first()[0] or 0.0 for x in (vectors, queries)]
    bound = d * most[0] * most[1]
    if bound >= 2.0**62:
        raise ArithmeticError(f"scores up to {bound:.3g} don't fit a long")
    return np.float64 if bound < 2.0**52 else np.int64


def nearest_by_product(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    vectors, queries: vec_id long, embedding array<long> of the same length. Rows that share the query's id are its own
    and never its results; other rows that repeat an id are rows like others. Where either is empty, so is the result.
    """
    spark = vectors.sparkSession
    d = dimensions(vectors)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors, queries = vectors.filter(F.size("embedding") == d), queries.filter(F.size("embedding") == d)
    n, asked = vectors.count(), queries.count()
    kind = exact_kind(vectors, queries, d)
    column = "array<double>" if kind is np.float64 else "array<bigint>"
    blocks, groups = max(1, math.ceil(n / ROWS)), max(1, math.ceil(asked / QUERIES))
    whole = lambda x, parts: packed(x.withColumn("embedding", F.col("embedding").cast(column)), F.pmod(F.xxhash64("vec_id"), F.lit(parts)), d, kind)
    lists = with_lists(whole(vectors, blocks), d, kind)
    asking = cut(whole(queries, groups).select(F.col("block").alias("group"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in rows(batches):
            ids, data = unpack(x["ids"], x["data"], d, kind)
            q_ids, q_data = unpack(x["q_ids"], x["q_data"], d, kind)
            floors = dict(zip(x["f_ids"] or [], x["floors"] or []))
            block = SortedLists(ids, data, np.frombuffer(x["order"], np.uint32).reshape(d, -1))
            found = [block.top(q, k, i, floors.get(i, NONE)) for i, q in zip(q_ids.tolist(), q_data)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(a) for a, _ in found])), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.select("ids", "data", "order", "q_ids", "q_data", "f_ids", "floors").mapInArrow(run, "query_id long, vec_id long, score long")

    own = F.pmod(F.col("group"), F.lit(blocks))
    unknown = [F.lit(None).cast("array<bigint>").alias(c) for c in ("f_ids", "floors")]
    # Blocks and queries meet by merging: a plan sees the size of asking's files, not that they are repeated for each block, and would send all pairs through the driver.
    first = cut(met(asking.withColumn("block", own).select("*", *unknown).join(lists.hint("merge"), "block")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("place", place).filter(F.col("place") == k).select("query_id", "score")
    of = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    floors = kth.groupBy(of.alias("group")).agg(F.collect_list(F.struct("query_id", "score")).alias("f")).select("group", F.col("f.query_id").alias("f_ids"), F.col("f.score").alias("floors"))
    # Queries, the smaller side, go to every block but the one they have met; a group's floors are as many as its queries.
    others = asking.join(floors, "group", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).filter(F.col("block") != own)
    best = first.unionByName(met(others.join(lists.hint("merge"), "block")))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def product_table(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """Top k of each vector whose id is divisible by every, over components floor(scale * x).

    Vectors that are null or hold null or non-finite components take no part, nor those of another length than the commonest, with which no
    product is defined; zero vectors do. An empty table gives no rows; further columns are left out.
    """
    x = cut(usable(embeddings, zero_too=True).withColumn("embedding", F.transform("embedding", lambda v: F.floor(v * F.lit(scale)))))
    return nearest_by_product(x, x.filter(F.col("vec_id") % every == 0), k)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
