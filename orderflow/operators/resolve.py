"""Customers and products found through reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def load_xref(df: DataFrame) -> DataFrame:
    """Cross-reference entries that can be used: active, with key and customer; the key falls back to the company number (SRC-07)."""
    key = F.coalesce(F.nullif(S.digits(F.col("chave_lida")), F.lit("")), S.digits(F.col("cnpj_oficial")))
    x = df.filter(~F.upper(S.text(F.col("status"))).isin("INATIVO", "IGNORAR", "CANCELADO"))
    return x.select("row_id", F.upper(S.text(F.col("rede"))).alias("rede"), key.alias("chave"), S.digits(F.col("matricula")).alias("matricula")).filter("chave <> '' AND matricula <> ''")


def upsert_xref(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by network, key and customer; the last writer wins (SNK-07)."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("rede", "chave", "matricula").orderBy(F.desc("_turn"), F.desc("row_id")))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_turn")


def cnpj_index(base: DataFrame) -> DataFrame:
    """chave, matricula, ambigua: every form of a company number and the one customer it stands for."""
    keys = base.select(F.explode(S.key_forms(F.col("cnpj"))).alias("chave"), "matricula")
    x = keys.groupBy("chave").agg(F.min("matricula").alias("matricula"), F.countDistinct("matricula").alias("n"))
    return x.select("chave", F.when(F.col("n") == 1, F.col("matricula")).otherwise(F.lit("")).alias("matricula"), (F.col("n") > 1).alias("ambigua"))


def resolve_by_cnpj(df: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """df with matricula, ambigua: the forms of the number are tried in turn; an ambiguous form ends the search (J-01)."""
    asked = df.select("row_id", F.posexplode(S.key_forms(F.col(key))).alias("pos", "chave"))
    met = asked.join(cnpj_index(base), "chave").groupBy("row_id").agg(F.min_by(F.struct("matricula", "ambigua"), "pos").alias("hit"))
    return df.join(met, "row_id", "left").withColumns({"achada": F.coalesce("hit.matricula", F.lit("")), "ambigua": F.coalesce("hit.ambigua", F.lit(False))}).drop("hit")


def attach_gln(df: DataFrame, base: DataFrame) -> DataFrame:
    """df with gln of its customer, the last entry winning; "" where there is none (J-02)."""
    last = base.groupBy("matricula").agg(F.max_by("gln", "row_id").alias("gln"))
    return df.join(last, "matricula", "left").withColumn("gln", F.coalesce("gln", F.lit("")))


def resolve_ean(df: DataFrame, base: DataFrame) -> DataFrame:
    """df with sku of its bar code by the first entry (J-05)."""
    first = base.groupBy("ean").agg(F.min_by("sku", "row_id").alias("sku"))
    return df.join(first, "ean", "left").withColumn("sku", F.coalesce("sku", F.lit("")))


def map_diagnostics(base: DataFrame) -> DataFrame:
    """Figures of the product map as one row (AGG-22)."""
    per_ean = base.groupBy("ean").agg(F.countDistinct("apresentacao").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("ambiguas"))
    x = base.agg(F.count(F.lit(1)).alias("linhas"), F.countDistinct("centro").alias("centros"), F.countDistinct("sku").alias("skus"), F.countDistinct("ean").alias("eans"), F.countDistinct("dun").alias("duns"), F.sum((F.col("apresentacao") <= 0).cast("long")).alias("sem_fator"))
    return x.crossJoin(F.broadcast(per_ean))


def attach_ship_date(items: DataFrame, ships: DataFrame) -> DataFrame:
    """row_id, data, nivel: day by customer and order; else the customer's only shipment (J-09). Blank days don't count."""
    some = ships.filter("data_remessa <> ''")
    exact = some.groupBy("matricula", "pedido").agg(F.min_by("data_remessa", "row_id").alias("d1"))
    only = some.groupBy("matricula").agg(F.countDistinct("pedido").alias("n"), F.min_by("data_remessa", "row_id").alias("d2")).filter("n = 1").drop("n")
    x = items.join(exact, ["matricula", "pedido"], "left").join(only, "matricula", "left")
    return x.select("row_id", F.coalesce("d1", "d2", F.lit("")).alias("data"), F.when(F.col("d1").isNotNull(), 1).when(F.col("d2").isNotNull(), 2).otherwise(0).alias("nivel"))


def dedup_shipments(ships: DataFrame) -> DataFrame:
    """First row of each customer, order and day (SET-05)."""
    return ships.groupBy("matricula", "pedido", "data_remessa").agg(F.min("row_id").alias("row_id"))


def xref_lookup(items: DataFrame, xref: DataFrame) -> DataFrame:
    """row_id, achada, qualidade for items with lido (a key) and rede (a network) (J-03).

    Keys meet by any of their forms; equal keys are best, then long forms, then the first 12 digits. Entries of the item's network
    come first; those of other networks count only if all name one customer.
    """
    forms = lambda c: F.array_distinct(F.concat(S.key_forms(c), F.when(F.length(S.digits(c)) >= 13, F.array(F.substring(S.digits(c), 1, 12))).otherwise(F.array().cast("array<string>"))))
    asked = items.select("row_id", S.digits(F.col("lido")).alias("lido"), F.upper("rede").alias("na"), F.explode(forms(F.col("lido"))).alias("k"))
    entries = xref.select(F.col("row_id").alias("entry"), "rede", "chave", "matricula", F.explode(forms(F.col("chave"))).alias("k"))
    quality = F.when(F.col("lido") == F.col("chave"), 1000).when(F.length("k") >= 14, 800).when(F.length("k") == 13, 700).when(F.length("k") == 12, 300).otherwise(100)
    met = asked.join(entries, "k").select("row_id", "entry", "matricula", (F.col("na") == F.col("rede")).alias("own"), quality.alias("q"))
    x = met.groupBy("row_id").agg(
        F.max("own").alias("own"), F.countDistinct("matricula").alias("n"),
        F.max_by(F.struct("matricula", "q"), F.struct("own", "q", (-F.col("entry")).alias("e"))).alias("x"),
    )
    return x.filter("own OR n = 1").select("row_id", F.col("x.matricula").alias("achada"), F.col("x.q").cast("long").alias("qualidade"))


def resolve_conflicts(entries: DataFrame, scores: dict[str, int]) -> DataFrame:
    """cnpj, escolhida, descartadas: of several customers of a company number, the one whose network's name scores most, the last of equals (AGG-12)."""
    score = sum((F.when(F.upper("rede").contains(word), n).otherwise(0) for word, n in scores.items()), F.lit(0))
    x = entries.filter("matricula <> ''").groupBy("cnpj").agg(F.max_by("matricula", F.struct(score.alias("s"), "row_id")).alias("escolhida"), F.collect_set("matricula").alias("todas"))
    rest = F.sort_array(F.array_except("todas", F.array("escolhida")))
    return x.select("cnpj", "escolhida", F.array_join(rest, "|").alias("descartadas"))


def resolve_with_divergence(df: DataFrame, base: DataFrame, fallback: DataFrame) -> DataFrame:
    """df (chave, and what else is to be kept) with matricula and origem: the base's customer before the fallback's; DIVERGENTE where they differ (J-13)."""
    b, f = base.select("chave", F.col("matricula").alias("b")), fallback.select("chave", F.col("matricula").alias("f"))
    x = df.join(b, "chave", "left").join(f, "chave", "left")
    origin = F.when(F.col("b").isNotNull() & F.col("f").isNotNull() & (F.col("b") != F.col("f")), "DIVERGENTE").when(F.col("b").isNotNull(), "BASE").when(F.col("f").isNotNull(), "RESERVA").otherwise("NENHUMA")
    return x.select(*df.columns, F.coalesce("b", "f", F.lit("")).alias("matricula"), origin.alias("origem"))


def overlay_map(default: DataFrame, own: DataFrame) -> DataFrame:
    """chave, valor: the file's own entries over the default ones (J-22)."""
    x = default.select("chave", F.col("valor").alias("d")).join(own.select("chave", F.col("valor").alias("o")), "chave", "full")
    return x.select("chave", F.coalesce("o", "d").alias("valor"))
