"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

The graph starts from exact neighbours within cells of random hyperplanes, and within cells drawn by id, which leave no
point alone. Each round joins every point's neighbours
(forward and reverse) with each other, as a neighbour of a neighbour is likely to be one: the vectors of a point's
neighbourhood meet in one group, and pairs of which one end is new there and that are closer than what either end has
are kept. A search holds a pool of the
nearest points found for each query and expands the pool's points along the graph, one Spark join a hop, until every
point of the pool is expanded. Equal vectors are one point, so that no common vector makes a large neighbourhood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import dimensions, matrix, usable

DEGREE = 16
CELL = 256
TREES = 3
ROUNDS = 8
#: So many nodes of each query are expanded: in even directions a graph of this degree holds a quarter of the true neighbours, and the rest are met on the way.
POOL = 512
DRAWN = 8


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches again, cut only between keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            if last:
                yield table.slice(0, last)
            held, n = table.slice(last).to_batches(), table.num_rows - last
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _distances(a: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)
    d = square[:, None] + square[None] - 2 * (a @ a.T)
    return np.maximum(d, 0)


def top(edges: DataFrame, by: str = "node", k: int = DEGREE) -> DataFrame:
    """node, other, near, fresh: the k nearest others of each node, ties to the smaller node; fresh unless some of an edge's rows isn't."""
    once = edges.groupBy("node", "other").agg(F.min("near").alias("near"), F.min("fresh").alias("fresh"))
    other = "other" if by == "node" else "node"
    place = F.row_number().over(Window.partitionBy(by).orderBy("near", other))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def first_edges(points: DataFrame, n: int, d: int, degree: int) -> DataFrame:
    """Exact nearest others within cells: the signs against random planes, cells of many points being parted by id.

    Further cells are drawn by id: a point whose direction is its own, alone in its cell of every tree, has links by them.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / CELL))))
    planes = np.random.default_rng(7).standard_normal((TREES, bits, d)).astype(np.float32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, d)
            for t in range(TREES):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))) * TREES + t
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), batch.column("node"), batch.column("vec")], names=["cell", "node", "vec"])

    dealt = points.select("node", "vec").mapInArrow(cells, "cell long, node long, vec binary")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parted = dealt.join(sizes, "cell").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (4 * CELL)))))
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, n // CELL)))
    parted = parted.select("cell", "node", "vec").unionByName(points.select(F.xxhash64(F.lit("drawn"), drawn).alias("cell"), "node", "vec"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 4 * CELL):
            bounds = _bounds(table.column("cell").to_numpy())
            nodes = table.column("node").to_numpy()
            x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, d)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                near = _distances(x[a:b].astype(np.float64))
                np.fill_diagonal(near, np.inf)
                k = min(degree, b - a - 1)
                best = np.argpartition(near, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[a:b], k)), pa.array(nodes[a:b][best.ravel()]), pa.array(np.take_along_axis(near, best, 1).ravel())], names=["node", "other", "near"])

    return parted.select("cell", "node", "vec").repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "node long, other long, near double")


def descend(graph: DataFrame, points: DataFrame, d: int, degree: int) -> DataFrame:
    """Pairs that one round of joining neighbours of neighbours finds: node, other, near. A task keeps the best degree of a node."""
    both = graph.select("node", "other", "fresh").unionByName(top(graph, "other", degree).select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh"))
    members = both.groupBy("node", F.col("other").alias("member")).agg(F.max("fresh").alias("fresh"))
    members = members.unionByName(points.select("node", F.col("node").alias("member"), F.lit(False).alias("fresh")))
    reach = graph.groupBy("node").agg(F.max("near").alias("reach"), F.count(F.lit(1)).alias("n"))
    reach = points.join(reach, "node", "left").select(F.col("node").alias("member"), "vec", F.when(F.col("n") >= degree, F.col("reach")).otherwise(F.lit(float("inf"))).alias("reach"))
    met = members.join(reach, "member").repartition("node").sortWithinPartitions("node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            bounds = _bounds(table.column("node").to_numpy())
            ids, reach_of = table.column("member").to_numpy(), table.column("reach").to_numpy()
            fresh = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
            x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, d).astype(np.float64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                new = fresh[a:b]
                if not new.any():
                    continue
                near = _distances(x[a:b])
                np.fill_diagonal(near, np.inf)
                i, j = np.nonzero((near < reach_of[a:b, None]) & (new[:, None] | new[None]))
                out.append((ids[a:b][i], ids[a:b][j], near[i, j]))
            if not out:
                continue
            node, other, near = (np.concatenate(v) for v in zip(*out))
            order = np.lexsort((other, near, node))
            node, other, near = node[order], other[order], near[order]
            once = np.ones(len(node), bool)
            once[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])  # equal pairs lie at one distance
            node, other, near = node[once], other[once], near[once]
            first = np.searchsorted(node, node)
            best = np.arange(len(node)) - first < degree
            yield pa.RecordBatch.from_arrays([pa.array(v[best]) for v in (node, other, near)], names=["node", "other", "near"])

    return met.select("node", "member", "vec", "reach", "fresh").mapInArrow(join, "node long, other long, near double")


def build_graph(points: DataFrame, d: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """node, other, near for points (node long, vec: float32 bytes); rounds, of which rounds are the most, end once few edges change."""
    n = points.count()
    graph = cut(top(first_edges(points, n, d, degree).withColumn("fresh", F.lit(True)), k=degree))
    for _ in range(rounds):
        known = graph.select("node", "other", "near", F.lit(False).alias("fresh"))
        graph = cut(top(known.unionByName(descend(graph, points, d, degree).withColumn("fresh", F.lit(True))), k=degree))
        if graph.filter("fresh").count() <= 0.005 * n * degree:
            break
    return graph.drop("fresh")


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, entries: DataFrame, d: int, pool: int = POOL) -> DataFrame:
    """query_id, node, near: up to pool nodes found nearest each query. Greedy: only what is in the pool is expanded, all of it.

    points: node, vec; queries: query_id, vec; entries: query_id, node, where the search starts. near: squared distance of the float32 vectors.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, d).astype(np.float64) for c in ("vec", "of"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(((a - b) ** 2).sum(1))], names=["query_id", "node", "near"])

    asked = queries.select("query_id", F.col("vec").alias("of"))

    def measured(pairs: DataFrame) -> DataFrame:
        x = pairs.join(points.select("node", "vec"), "node").join(asked, "query_id")
        return x.select("query_id", "node", "vec", "of").mapInArrow(measure, "query_id long, node long, near double")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "node"))
    best = lambda x: x.withColumn("place", place).filter(F.col("place") <= pool).drop("place")
    found = cut(best(measured(entries.select("query_id", "node").distinct())).withColumn("done", F.lit(False)))
    links = graph.select(F.col("node").alias("at"), F.col("other").alias("node"))
    links = cut(links.unionByName(links.select(F.col("node").alias("at"), F.col("at").alias("node"))).distinct())
    while True:
        ahead = found.filter(~F.col("done")).select("query_id", F.col("node").alias("at")).join(links, "at").select("query_id", "node").distinct()
        new = measured(ahead.join(found, ["query_id", "node"], "left_anti")).withColumn("done", F.lit(False))
        found = cut(best(found.withColumn("done", F.lit(True)).unionByName(new)))
        if not found.filter(~F.col("done")).limit(1).count():
            break
    return found.select("query_id", "node", "near")


def exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """query_id, node, near for pairs of them: the distance of the original vectors, in double precision."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column("embedding"), d), matrix(batch.column("of"), d)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], names=["query_id", "node", "near"])

    x = pairs.join(vectors.select("node", "embedding"), "node").join(queries.select("query_id", F.col("embedding").alias("of")), "query_id")
    return x.select("query_id", "node", "embedding", "of").mapInArrow(measure, "query_id long, node long, near double")


def drawn_entries(points: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query_id, node: some DRAWN nodes for each query, other ones for each: two of the groups that a hash of the ids makes."""
    groups = F.lit(max(1, n // (DRAWN // 2)))
    dealt = points.select("node", F.pmod(F.xxhash64("node", F.lit(11)), groups).alias("drawn"))
    asked = queries.select("query_id", F.explode(F.array(*(F.pmod(F.xxhash64("query_id", F.lit(i)), groups) for i in (12, 13)))).alias("drawn"))
    return asked.join(dealt, "drawn").select("query_id", "node")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by every.

    Euclidean distance in double precision, ties to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor those of an unusual length, to which no distance is defined. A query enters
    the graph at its own point, so that equal vectors and near ones are found at once, and at points drawn by id. Points
    are known by a hash of their vectors, so ids may repeat: each row is then a query or a candidate of its own, rows that agree in
    id and vector are one, and rows that have the query's id are never its results. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    x = usable(embeddings, zero_too=False)
    d = dimensions(x)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = cut(x.filter(F.size("embedding") == d).withColumn("node", F.xxhash64("embedding")).dropDuplicates(["vec_id", "node"]))
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    members = cut(x.withColumn("place", place).filter(F.col("place") <= k + 1))  # no more of a point's ids can be among k results
    vectors = members.filter(F.col("place") == 1).select("node", "embedding")

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = matrix(batch.column("embedding"), d).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in data], pa.binary())], names=["node", "vec"])

    points = cut(vectors.mapInArrow(to_bytes, "node long, vec binary"))
    graph = build_graph(points, d)
    asked = cut(x.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("asker"), F.xxhash64("vec_id", "node").alias("query_id"), "node", "embedding"))
    queries = asked.select("query_id", "node").join(points, "node").select("query_id", "vec")
    entries = asked.select("query_id", "node").unionByName(drawn_entries(points, queries, points.count()))
    found = search(graph, points, queries, entries, d)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "node"))
    some = found.withColumn("place", place).filter(F.col("place") <= max(64, 4 * k))  # float32 doesn't misplace a result so far
    found = exact(some.select("query_id", "node"), vectors, asked, d)
    near = found.join(members.select("node", "vec_id"), "node").join(asked.select("query_id", "asker"), "query_id").filter(F.col("vec_id") != F.col("asker"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("asker").alias("query_id"), "rank", "vec_id", F.col("near").alias("score"))
