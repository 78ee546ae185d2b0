"""Queue validation and push numbering on micro-batches (STM-01, STM-02)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import queue


def validate_stream(rows: DataFrame, ok_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Writes valid and rejected rows, a folder for each batch number, so that a batch that runs again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        ok, rejected = queue.validate_queue(batch)
        ok.write.mode("overwrite").parquet(f"{ok_path}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def number_pushes(items: DataFrame, path: str, checkpoint: str, orders: str | None = None) -> StreamingQuery:
    """Appends each micro-batch as the push that follows the highest one so far, with repeats in it and in earlier pushes flagged (STM-01, WIN-13).

    What earlier pushes hold is kept as a table of orders, path with _pedidos at its end unless named: push, batch and each order once. A batch
    that runs again finds its own push there and replaces it; another checkpoint over the same history goes on after it.
    """
    seen_path = orders or f"{path.rstrip('/')}_pedidos"

    def one(batch: DataFrame, number: int) -> None:
        spark, tag = batch.sparkSession, f"{checkpoint}:{number}"
        try:
            seen = spark.read.schema("pedido string, lote string, push long").parquet(seen_path)
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            seen = spark.createDataFrame([], "pedido string, lote string, push long")
        own, last = seen.agg(F.max(F.when(F.col("lote") == tag, F.col("push"))), F.max("push")).first()
        push = own if own is not None else 0 if last is None else last + 1
        firsts = batch.groupBy("pedido").agg(F.min(F.struct("row_id", "arquivo")).alias("first"))
        known = seen.filter(F.col("push") < push).select("pedido").distinct().withColumn("no_historico", F.lit(True))
        x = batch.join(firsts, "pedido").withColumn("repetido", F.col("row_id") > F.col("first.row_id")).drop("first")
        x = x.join(known, "pedido", "left").withColumn("no_historico", F.coalesce("no_historico", F.lit(False)))
        x.write.mode("overwrite").parquet(f"{path}/push={push}")
        batch.select("pedido", F.lit(tag).alias("lote")).distinct().write.mode("overwrite").parquet(f"{seen_path}/push={push}")

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
