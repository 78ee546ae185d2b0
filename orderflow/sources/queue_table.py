"""The queue as a table on disk (SNK-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("matricula", "sku", "qtd", "pedido", "data_remessa")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", lote string"


class Queue:
    """Rows of the queue by batch, so that a batch that is written again replaces its own rows and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame, batch: str) -> None:
        x = rows.select(*COLUMNS, F.lit(batch).alias("lote"))
        x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(self.path)

    def replace(self, rows: DataFrame, batch: str) -> None:
        """All batches give way to this one."""
        rows.select(*COLUMNS, F.lit(batch).alias("lote")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lote").parquet(self.path)

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA), "")
