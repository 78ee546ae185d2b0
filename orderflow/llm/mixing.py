"""Mixing sources to target weights by entropy balancing.

Among all document rates whose words add up to each source's target, none above a limit, those closest to 1 in relative
entropy are exponentials exp(l_s * size), one dual variable for each source. The dual is convex; Newton steps on it
take their gradient and curvature from one aggregation over all documents each. Rates are rounded to whole copies
systematically: along each source, in order of size, copies follow the running sum of the rates, so that the words
taken stay within half the longest document of the target; a few single copies then close most of that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
STEPS = 60
TURNS = 6


def targets(sources: DataFrame, weights: tuple[float, ...], budget: float = 1.0, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with target: budget times all words, shared by weight, none above most times its size.

    Sources take the weights in turn in code point order, null last. What exceeds a cap is shared anew among the
    others by weight until none exceeds; in order of size for its weight, the capped sources come first, so running
    sums find them at once. One row a source goes through one task.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_turn = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", by_turn.cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    row = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later, everything = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.lit(budget) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    x = x.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first_free = F.max(F.when(F.col("free"), F.col("level"))).over(everything)  # after the first free source the level falls
    return x.withColumn("level", first_free).select("source", "source_size", F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def balanced(sizes: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """source, size, rate, before (documents of the source of smaller size), sum_before (of their rates).

    Minimises the relative entropy of document rates to 1, none above most, under each source's target of words: the
    solution is exp(l * size) of one dual variable a source, cut at most. Each step of Newton's method on the dual is one
    aggregation over all documents, which are first counted by source and size, for equal sizes have equal rates. A step
    that leaves what is known of the solution's place is replaced by halving it. Sums are of decimals, so that reruns agree.
    """
    counted = cut(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    scale = F.col("source_size") / F.col("documents")
    x = sources.join(counted.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("documents")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    x = x.withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    full = F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")
    x = cut(x.withColumns({"full": full, "dual": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "gap": F.lit(None).cast("double")}))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,9)")).cast("double"), F.lit(0.0))
    for _ in range(STEPS):
        known = x.filter("NOT full").select(F.col("source").alias("s"), "scale", "dual")
        y = counted.join(known, F.col("source").eqNullSafe(F.col("s")))
        tilt = F.col("dual") * F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * F.least(F.exp(F.least(tilt, F.lit(math.log(most)))), F.lit(most))
        slope = F.when(tilt < math.log(most), words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = y.groupBy("s").agg(exact(words).alias("words"), exact(slope).alias("slope"))
        z = x.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.coalesce(F.col("words"), F.col("target")) - F.col("target")
        low, high = F.when(gap <= 0, F.col("dual")).otherwise(F.col("low")), F.when(gap >= 0, F.col("dual")).otherwise(F.col("high"))
        z = z.withColumns({"gap": gap, "low": low, "high": high})
        newton = F.when(F.col("slope") > 0, F.col("dual") - F.col("gap") / F.col("slope"))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        half = F.when(F.col("low").isNull(), F.least(2 * F.col("high"), F.col("high") - 1)).when(F.col("high").isNull(), F.greatest(2 * F.col("low"), F.col("low") + 1)).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.abs("gap") <= 1e-9 * F.col("target") + 1e-6
        following = F.when(done | F.col("full"), F.col("dual")).otherwise(F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(half))
        x = cut(z.withColumn("dual", following).drop("s", "words", "slope"))
        if not x.filter(~F.col("full") & (F.abs("gap") > 1e-9 * F.col("target") + 1e-6)).limit(1).count():
            break
    y = counted.join(x.select(F.col("source").alias("s"), "scale", "dual", "full", "target"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("full"), most).otherwise(F.least(F.exp(F.least(F.col("dual") * F.col("size") / F.col("scale"), F.lit(math.log(most)))), F.lit(most)))
    y = y.select("source", "size", "n", rate.alias("rate"))
    earlier = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before, sum_before = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("rate")).cast("decimal(38,12)")).over(earlier).cast("double"), F.lit(0.0))
    return y.select("source", "size", "rate", before.alias("before"), sum_before.alias("sum_before"))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with place: where a row stands in its source by (size, doc_id), from 1. No source meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, source, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for now in batch.column("source").to_pylist():
                n = n + 1 if now == source else 1
                source = now
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    order = [F.col("source"), F.col("size"), F.col("doc_id")]
    rows = cut(sizes.repartitionByRange(shuffle_partitions(sizes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, source string, size long, part int, place long"))
    counts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", (F.col("place") + F.col("before")).alias("place"))


def evened(x: DataFrame, most: int) -> DataFrame:
    """x with extra changed in a few rows of each source, so that its words come nearer to its target.

    Each turn finds, by one aggregation over all rows, the row of each source whose size comes nearest to what the
    source still lacks or has too much, and gives it a copy more or less if that helps. What is kept of a turn is one
    row a source.
    """
    lacks = cut(x.groupBy("source").agg((F.first("target") - F.sum((F.col("least") + F.col("extra")) * F.col("size"))).alias("lack")))
    turned: DataFrame | None = None
    for _ in range(TURNS):
        known = lacks.select(F.col("source").alias("s"), "lack")
        y = x.join(known, F.col("source").eqNullSafe(F.col("s")))
        y = y.filter((F.col("size") > 0) & (F.col("size") < 2 * F.abs("lack")) & (F.col("extra") == F.when(F.col("lack") > 0, 0).otherwise(1)) & (F.col("least") + F.when(F.col("lack") > 0, 1).otherwise(0) <= most))
        if turned is not None:
            done = turned.select(F.col("source").alias("s2"), F.col("at").alias("place"))
            y = y.join(done, (F.col("source").eqNullSafe(F.col("s2"))) & (y["place"] == done["place"]), "left_anti")
        nearest = F.min_by(F.struct("place", "size", "lack"), F.struct(F.abs(F.abs("lack") - F.col("size")), "place"))
        found = cut(y.groupBy("source").agg(nearest.alias("row")).select("source", F.col("row.place").alias("at"), F.col("row.lack").alias("lack"), F.col("row.size").alias("size")))
        if not found.limit(1).count():
            break
        turned = found.select("source", "at") if turned is None else cut(turned.unionByName(found.select("source", "at")))
        lacks = cut(found.select("source", (F.col("lack") - F.signum("lack") * F.col("size")).alias("lack")))
    if turned is None:
        return x
    done = turned.select(F.col("source").alias("s"), "at")
    y = x.join(done, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("at")), "left")
    return y.withColumn("extra", F.when(F.col("at").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("s", "at")


def mix_sources(docs: DataFrame, weights: tuple[float, ...], budget: float = 1.0, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs.

    size: words of the text, 0 for null; such documents are never taken. A null source is a source of its own. Repeated
    rows and null ids are rows like others, and reruns agree. copies is never above most rounded up. An empty table
    gives no rows.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(sizes)
    some = cut(ranked(sizes.filter("size > 0")))
    sources = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most))
    rates = cut(balanced(sizes, sources, most)).withColumnsRenamed({"source": "s", "size": "z"})
    told = sources.select(F.col("source").alias("t"), "source_size", "target")
    x = some.join(rates, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    upto = lambda places: F.floor(F.col("sum_before") + places * F.col("rate") + 0.5)
    through = upto(F.col("place") - F.col("before")) - upto(F.col("place") - F.col("before") - 1)
    x = x.withColumn("least", F.floor("rate")).withColumn("extra", F.when(F.col("rate") > F.col("least"), F.least(F.lit(1), F.greatest(F.lit(0), through - F.col("least")))).otherwise(F.lit(0)).cast("int"))
    x = cut(x.join(told, F.col("source").eqNullSafe(F.col("t"))).drop("t", "before", "sum_before"))
    x = evened(x, int(most)).select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("least") + F.col("extra")).cast("long").alias("copies"))
    none = sizes.filter("size = 0").join(told, F.col("source").eqNullSafe(F.col("t")))
    x = x.unionByName(none.select("doc_id", "source", "size", "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies")))
    return x.withColumn("taken", F.col("copies") * F.col("size"))
