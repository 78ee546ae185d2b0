"""Order files: fixed-width records of 400 characters, and the table of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from ..operators import queue, resolve

#: Constants of the records and of an order's table.
KIND, SUPPLIER_EAN, SUPPLIER_CNPJ = "001", "7898905730084", "06589791000121"
RECORD_02, RECORD_03_TERMS = "0221530302026040100000000000012 00000000000000000021", "CIF"
REQUEST, PAYMENT = "ORDEM VENDA", "Boleto"


def header_record(order: Column, customer: Column, gln: Column, first_day: Column, now: Column) -> Column:
    """FXW-04: record 01. The last day of delivery is seven days after now."""
    minute = lambda t: F.date_format(t, "yyyyMMddHHmm")
    buyer = [S.numeric(gln, 13), S.numeric(customer, 15)]
    fields = [
        F.lit("01ORDERS"), S.alpha(order, 20), F.lit(" " * 8 + "9  "), minute(now), S.stamp(first_day), minute(now + F.expr("INTERVAL 7 DAYS")), F.lit("0" * 16 + KIND + "0" * 20),
        *buyer, F.lit(SUPPLIER_EAN), F.lit(SUPPLIER_CNPJ.rjust(15, "0")), *buyer, *buyer,
    ]
    return F.rpad(F.concat(*fields), 400, " ")


def fixed_record(number: str) -> Column:
    """FXW-05: records 02, 03 and 09."""
    said = {"02": RECORD_02, "03": "03" + " " * 17 + RECORD_03_TERMS, "09": "09" + "0" * 80}[number]
    return F.lit(said.ljust(400))


def order_lines(rows: DataFrame, gln: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Consolidated items with gln, pedido and seq, and those of customers without GLN, which are left out (D-06)."""
    ok, _ = queue.validate_queue(rows)
    x = queue.consolidate(ok).drop("pedido")
    x = x.withColumn("pedido", S.order_or_fallback(F.col("matricula"), F.col("pedido_norm"), F.lit(today).cast("date")))
    x = resolve.attach_gln(x, gln)
    return queue.with_sequence(x.filter("gln <> ''")), x.filter("gln = ''")


def order_files(lines: DataFrame, now: str) -> DataFrame:
    """matricula, pedido, ord, seq, registro: each order's records 01, 02, 03, its items and 09, in that order (FXW-07).

    The header takes the day of the order's first item. Items are not gathered: records are rows until they are written.
    """
    stamp = F.lit(now).cast("timestamp")
    heads = lines.groupBy("matricula", "pedido").agg(F.min_by(F.struct("gln", "data_norm"), "seq").alias("h"))
    day = X.stamp_day(F.col("h.data_norm"))
    records = F.array(
        F.struct(F.lit(1).alias("ord"), header_record(F.col("pedido"), F.col("matricula"), F.col("h.gln"), day, stamp).alias("registro")),
        *[F.struct(F.lit(i).alias("ord"), fixed_record(n).alias("registro")) for i, n in ((2, "02"), (3, "03"), (9, "09"))],
    )
    frame = heads.select("matricula", "pedido", F.inline(records)).withColumn("seq", F.lit(0).cast("long"))
    item = S.item_record(F.col("seq"), F.col("sku_norm"), F.col("qtd"), F.col("gln"), F.col("matricula"))
    items = lines.select("matricula", "pedido", F.lit(4).alias("ord"), item.alias("registro"), F.col("seq").cast("long").alias("seq"))
    return frame.unionByName(items).select("matricula", "pedido", "ord", "seq", "registro")


def order_table(lines: DataFrame) -> DataFrame:
    """One row an item as an order's table has it (SNK-02)."""
    return lines.select(
        "matricula", F.lit(".").alias("descricao_sku"), F.col("sku_norm").alias("sku"), F.col("qtd").cast("long").alias("qtd"), "pedido", F.col("data_norm").alias("data"),
        F.lit(REQUEST).alias("tipo_solicitacao"), F.lit(PAYMENT).alias("forma_pagamento"), X.padded(F.col("gln"), 14).alias("gln"), F.concat_ws("_", X.file_key(F.col("matricula")), X.file_key(F.col("pedido"))).alias("arquivo"),
    )


def write_files(files: DataFrame, path: str) -> None:
    """A folder for each order, with its records in one file, each ended by a line feed (SNK-03).

    Order numbers hold letters and digits only, so the bytes are those of Latin-1.
    """
    name = F.concat_ws("_", X.file_key(F.col("matricula")), X.file_key(F.col("pedido"))).alias("arquivo")
    x = files.select(name, "ord", "seq", F.col("registro").alias("value")).repartition("arquivo").sortWithinPartitions("arquivo", "ord", "seq")
    x.select("arquivo", "value").write.partitionBy("arquivo").text(path)
