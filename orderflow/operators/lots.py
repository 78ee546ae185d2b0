"""Lots and pushes: numbered batches of order files, and repeats within and across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import partition_sets


def flag_repeats(items: DataFrame) -> DataFrame:
    """row_id, repetido, primeiro_arquivo: whether the order came before in its push, and with which file (WIN-09)."""
    w = Window.partitionBy("push", "pedido").orderBy("row_id")
    return items.select("row_id", (F.row_number().over(w) > 1).alias("repetido"), F.first("arquivo").over(w).alias("primeiro_arquivo"))


def flag_history(items: DataFrame, history: DataFrame) -> DataFrame:
    """items whose order an earlier push had (J-14)."""
    earlier = history.groupBy(F.col("pedido").alias("p")).agg(F.min("push").alias("first_push"))
    return items.join(earlier, (F.col("pedido") == F.col("p")) & (F.col("first_push") < F.col("push")), "left_semi")


def push_summary(items: DataFrame) -> DataFrame:
    """Files, orders, items and orders that repeat, for each push (AGG-13)."""
    per = items.groupBy("push", "pedido").agg(F.count(F.lit(1)).alias("n"))
    orders = per.groupBy("push").agg(F.count(F.lit(1)).alias("pedidos"), F.sum((F.col("n") > 1).cast("long")).alias("repetidos"))
    return items.groupBy("push").agg(F.countDistinct("arquivo").alias("arquivos"), F.count(F.lit(1)).alias("itens")).join(orders, "push")


def order_status(items: DataFrame) -> DataFrame:
    """Whether each order is single (AGG-14)."""
    x = items.groupBy("pedido").agg(F.count(F.lit(1)).alias("n"))
    return x.select("pedido", "n", F.when(F.col("n") > 1, "DUPLICADO").otherwise("OK").alias("status"))


def lot_totals(items: DataFrame) -> DataFrame:
    """Rows and pushes of each lot (AGG-18)."""
    return items.groupBy("lote").agg(F.count(F.lit(1)).alias("itens"), F.countDistinct("push").alias("pushes"), F.max("push").alias("ultimo_push"))


def lot_success(files: DataFrame) -> DataFrame:
    """lote, arquivos, itens, sucesso: files with items, order, company number and customer are a success (AGG-18)."""
    ok = (F.col("itens") > 0) & (F.col("pedido") != "") & (F.col("cnpj") != "") & (F.col("matricula") != "")
    return files.groupBy("lote").agg(F.count(F.lit(1)).alias("arquivos"), F.sum("itens").alias("itens"), F.sum(ok.cast("long")).alias("sucesso"))


def next_push(history: DataFrame) -> DataFrame:
    """The number of the push to come (WIN-13)."""
    return history.agg((F.coalesce(F.max("push"), F.lit(0)) + 1).cast("long").alias("push"))


def lot_queue(items: DataFrame) -> DataFrame:
    """row_id, pedido, alerta: rows of a lot for the queue, and one alert for each order that is left out as it repeats in its push (FLT-16)."""
    x = items.groupBy("push", "pedido").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    many = x.filter("n > 1")
    kept = items.join(many.select("push", "pedido"), ["push", "pedido"], "left_anti").select("row_id", "pedido", F.lit("").alias("alerta"))
    return kept.unionByName(many.select(F.col("first").alias("row_id"), "pedido", F.concat(F.lit("PEDIDO_DUPLICADO | linhas="), F.col("n")).alias("alerta")))


def gated(items: DataFrame, issues: DataFrame, with_duplicates: bool = False, with_alerts: bool = False) -> DataFrame:
    """items with alerta, "" for those that enter the queue (FLT-16).

    Repeated orders, orders with any issue and incomplete rows are left out, for the first of these reasons. items: arquivo,
    pedido, matricula, sku, qtd; an order is repeated if it is in several files; issues: pedido.
    """
    many = items.groupBy("pedido").agg(F.countDistinct("arquivo").alias("n")).filter("n > 1").select("pedido", F.lit(True).alias("_many"))
    alerted = issues.select("pedido").distinct().withColumn("_alert", F.lit(True))
    x = items.join(many, "pedido", "left").join(alerted, "pedido", "left")
    incomplete = (F.col("matricula") == "") | (F.col("sku") == "") | (F.col("pedido") == "") | (F.coalesce("qtd", F.lit(0)) <= 0)
    why = F.when(F.lit(not with_duplicates) & F.col("_many"), "PEDIDO_DUPLICADO").when(F.lit(not with_alerts) & F.col("_alert"), "PEDIDO_COM_ALERTA").when(incomplete, "LINHA_INCOMPLETA").otherwise("")
    return x.withColumn("alerta", why).drop("_many", "_alert")


def gated_queue(items: DataFrame, issues: DataFrame, with_duplicates: bool = False, with_alerts: bool = False) -> DataFrame:
    """row_id, pedido, alerta of items (row_id, and what gated needs)."""
    return gated(items, issues, with_duplicates, with_alerts).select("row_id", "pedido", "alerta")


def without_alerted(items: DataFrame, issues: DataFrame) -> DataFrame:
    """items of orders without any issue (J-14, the anti side)."""
    return items.join(issues.select("pedido").distinct(), "pedido", "left_anti")


def issue_counts(issues: DataFrame) -> DataFrame:
    """tipo, n, posicao: issues by kind, the commonest first (AGG-16). One row a kind is ranked."""
    x = issues.groupBy("tipo").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("posicao", F.row_number().over(Window.orderBy(F.desc("n"), "tipo")).cast("long"))


def duplicate_mirror(items: DataFrame) -> DataFrame:
    """The rows of orders that are in several files, as they stand now (SET-09): writing them over the old mirror drops stale ones."""
    many = items.groupBy("pedido").agg(F.countDistinct("arquivo").alias("n")).filter("n > 1").select("pedido")
    return items.join(many, "pedido", "left_semi")


def mirror_duplicates(items: DataFrame, path: str, lot: str) -> DataFrame:
    """Keeps the repeated orders of a lot, one partition each, as they stand now, and returns pedido and n (SET-09). Orders that no longer repeat go, other lots stay."""
    return partition_sets.write_set(duplicate_mirror(items), path, {"lote": lot}, ("pedido",))


def consolidated(files: DataFrame) -> DataFrame:
    """layout_usado, arquivos, modo: LOTE for layouts of several files of which none is generic or doubtful, else ARQUIVO (SET-02)."""
    doubtful = F.max((F.upper("layout_usado").contains("GENERIC") | (F.col("layout_usado") != F.col("layout_referencia"))).cast("int"))
    x = files.groupBy("layout_usado").agg(F.countDistinct("arquivo").alias("arquivos"), doubtful.alias("d"))
    return x.select("layout_usado", "arquivos", F.when((F.col("arquivos") > 1) & (F.col("d") == 0), "LOTE").otherwise("ARQUIVO").alias("modo"))
