"""Queue rows: validation with every reason kept, gating, consolidation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _reasons(*when: Column) -> Column:
    """Reasons of different fields, so no two are alike."""
    return S.kept(F.array(*when))


def judged(df: DataFrame) -> DataFrame:
    """df with cleaned fields and status: all reasons of a row, or "" (FLT-05). A code above 14 digits counts only alone.

    Fields are parsed by a generator of one row, which filters on the status don't pass, so each is parsed once a row.
    """
    x = S.once(
        df, _matricula=S.rescued_digits(F.col("matricula")), sku_norm=S.sku(F.col("sku")), pedido_norm=S.order_number(F.col("pedido")),
        qtd_int=S.queue_quantity(F.col("qtd")), _dia=S.day(F.col("data_remessa")),
    )
    blank = lambda c: F.lower(S.text(F.col(c))).isin("", "nan")
    base = _reasons(
        F.when(F.col("_matricula") == "", "MATRICULA_VAZIA"), F.when(F.col("sku_norm") == "", "SKU_VAZIO"), F.when(F.col("pedido_norm") == "", "PEDIDO_VAZIO"),
        F.when(blank("qtd"), "QTD_VAZIA").when(F.col("qtd_int").isNull(), F.concat(F.lit("QTD_INVALIDA: "), S.text(F.col("qtd")))), F.when(blank("data_remessa"), "DATA_VAZIA").when(F.col("_dia").isNull(), "DATA_INVALIDA"),
    )
    x, base = S.once(x, _why=base), F.col("_why")
    status = F.when(F.size(base) > 0, F.concat_ws(" | ", base)).when(F.length("sku_norm") > 14, F.lit("SKU_MAIS_14")).otherwise(F.lit(""))
    return x.withColumns({"status": status, "matricula": F.col("_matricula"), "data_norm": F.date_format("_dia", "dd/MM/yyyy")}).drop("_matricula", "_dia", "_why")


def validate_queue(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = judged(df)
    return x.filter("status = ''"), x.filter("status <> ''")


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each customer, order, article and day, with the other fields of its first row, quantities added (AGG-01)."""
    keys = ["matricula", "pedido_norm", "sku_norm", "data_norm"]
    others = [c for c in df.columns if c not in (*keys, "row_id", "qtd", "qtd_int", "status")]
    first = F.min_by(F.struct("row_id", *others), "row_id") if others else F.struct(F.min("row_id").alias("row_id"))
    x = df.groupBy(*keys).agg(first.alias("_first"), F.sum("qtd_int").alias("qtd"), F.count(F.lit(1)).alias("linhas"))
    x = x.select(*keys, "_first.*", "qtd", "linhas")
    note = F.concat(F.lit("SKU_DUPLICADO_CONSOLIDADO | linhas="), F.col("linhas"), F.lit(" | qtd_total="), F.col("qtd"))
    return x.withColumn("observacao", F.when(F.col("linhas") > 1, note).otherwise(F.lit("")))


def reason_counts(df: DataFrame) -> DataFrame:
    """Rows for each single reason (AGG-09)."""
    reasons = judged(df).filter("status <> ''").select(F.explode(F.split("status", r" \| ")).alias("motivo"))
    return reasons.groupBy("motivo").agg(F.count(F.lit(1)).alias("linhas"))


def safe_rows(df: DataFrame) -> DataFrame:
    """row_id, motivos, segura: the gate before the queue (FLT-04). Quantities must be whole and positive as they are."""
    q = S.text(F.col("qtd"))
    plain = F.when(q.contains(","), F.regexp_replace(F.regexp_replace(q, r"\.", ""), ",", ".")).otherwise(q)
    number = F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(18,6)"))
    motives = _reasons(
        F.when(S.text(F.col("matricula")) == "", "MATRICULA"), F.when(S.text(F.col("sku")) == "", "SKU"),
        F.when(number.isNull() | (number <= 0) | (number % 1 != 0), "QTD"), F.when(S.text(F.col("pedido")) == "", "PEDIDO"), F.when(S.text(F.col("data_remessa")) == "", "DATA"),
    )
    return df.select("row_id", F.concat_ws(" | ", motives).alias("motivos"), (F.size(motives) == 0).alias("segura"))


def blocking(df: DataFrame, tolerated: tuple[str, ...]) -> DataFrame:
    """row_id, bloqueia: whether a rejected row has a reason outside the tolerated ones (FLT-10)."""
    x = judged(df).filter("status <> ''")
    return x.select("row_id", F.exists(F.split("status", r" \| "), lambda r: ~r.isin(*tolerated)).alias("bloqueia"))


def potential_duplicates(df: DataFrame) -> DataFrame:
    """Order, customer and article that occur more than once (AGG-05)."""
    x = judged(df).filter("matricula <> '' AND sku_norm <> '' AND pedido_norm NOT IN ('', '.')")
    return x.groupBy("pedido_norm", "matricula", "sku_norm").agg(F.count(F.lit(1)).alias("linhas"), F.sum("qtd_int").alias("qtd_total")).filter("linhas > 1")


def queue_stats(df: DataFrame) -> DataFrame:
    """Rows, and different customer and order pairs (AGG-20)."""
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.countDistinct(F.struct("matricula", "pedido")).alias("pedidos"))


def error_groups(df: DataFrame) -> DataFrame:
    """Reasons of each customer and order, different ones in order (AGG-21)."""
    x = judged(df).filter("status <> ''")
    return x.groupBy("matricula", "pedido_norm").agg(F.array_join(F.sort_array(F.collect_set("status")), " ; ").alias("motivos"), F.count(F.lit(1)).alias("linhas"))


def executive_panel(df: DataFrame) -> DataFrame:
    """Figures of the queue as rows (part of AGG-08)."""
    ok = F.col("status") == ""
    x = judged(df).agg(F.count(F.lit(1)).alias("lidas"), F.sum(ok.cast("long")).alias("validas"), F.sum((~ok).cast("long")).alias("rejeitadas"), F.countDistinct(F.when(ok, F.col("matricula"))).alias("clientes"), F.sum(F.when(ok, F.col("qtd_int"))).alias("unidades"))
    return x.selectExpr("stack(5, 'lidas', lidas, 'validas', validas, 'rejeitadas', rejeitadas, 'clientes', clientes, 'unidades', unidades) AS (indicador, valor)")


def with_sequence(df: DataFrame) -> DataFrame:
    """seq: item number in its customer's order, in queue order (WIN-12)."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("matricula", "pedido").orderBy("row_id")))


def first_reason(df: DataFrame) -> DataFrame:
    """row_id, motivo: the first thing a row lacks, in the order of the business rules, or "" (FLT-06)."""
    blank = lambda c: S.text(F.col(c)) == ""
    reason = F.when(blank("sku"), "SKU_VAZIO").when(blank("qtd"), "QTD_VAZIA").when(blank("matricula"), "MATRICULA_NAO_ENCONTRADA").when(blank("pedido"), "PEDIDO_VAZIO").when(blank("data_remessa"), "DATA_INVALIDA")
    return df.select("row_id", reason.otherwise("").alias("motivo"))


def pending_keys(df: DataFrame) -> DataFrame:
    """Customers of rejected rows with their orders, sorted and joined (AGG-06)."""
    x = judged(df).filter("status <> ''").groupBy("matricula").agg(F.array_join(F.sort_array(F.collect_set("pedido_norm")), ", ").alias("pedidos"))
    return x.select("matricula", S.key_type(F.col("matricula")).alias("tipo"), "pedidos")


def issue_samples(df: DataFrame, most: int = 10) -> DataFrame:
    """row_id, motivo, n: the first rows of each reason, as a report shows them (SRT-04)."""
    x = judged(df).filter("status <> ''").select("row_id", F.explode(F.split("status", r" \| ")).alias("motivo"))
    n = F.row_number().over(Window.partitionBy("motivo").orderBy("row_id"))
    return x.withColumn("n", n).filter(F.col("n") <= most)
