"""From the queue to interchange records (PIPE-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import interchange


def item_records(rows: DataFrame, gln: DataFrame, today: str) -> DataFrame:
    """matricula, pedido, seq, registro: one record for each consolidated item whose customer has a GLN (FXW-06)."""
    x, _ = interchange.order_lines(rows, gln, today)
    return x.select("matricula", "pedido", F.col("seq").cast("long").alias("seq"), S.item_record(F.col("seq"), F.col("sku_norm"), F.col("qtd"), F.col("gln"), F.col("matricula")).alias("registro"))


def operational_output(rows: DataFrame, gln: DataFrame, today: str, now: str) -> dict[str, DataFrame]:
    """Order tables, order files, and what is left out: rejected rows, and items of customers without GLN."""
    from ..operators import queue

    lines, without_gln = interchange.order_lines(rows, gln, today)
    return {"tabelas": interchange.order_table(lines), "arquivos": interchange.order_files(lines, now), "rejeitadas": queue.validate_queue(rows)[1], "sem_gln": without_gln}
