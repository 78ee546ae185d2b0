"""Units to cases: conversion rules, the product map, and the division itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from . import detection


def _same_code(a: str, b: str) -> Column:
    strip = lambda c: F.regexp_replace(S.digits(F.col(c)), "^0+", "")
    return strip(a) == strip(b)


def rules_of_layouts(layouts: DataFrame, rules: DataFrame) -> DataFrame:
    """layout_id, nome_layout, regra_id: rules whose layout id is the layout's, whose network's name holds its name or is held by it, or is * (J-07).

    layouts: layout_id, nome_layout, each pair once. Names meet by postings of pieces, in keys without accents and signs; a blank name or id meets nothing.
    """
    known = layouts.withColumn("a", X.snake(F.col("nome_layout")))
    named = rules.select("regra_id", S.text(F.col("rede_layout")).alias("rede"), X.snake(F.col("rede_layout")).alias("b"))
    kind = F.lit("").alias("tipo")
    pairs = detection.held_pairs(known.filter("a <> ''").select(kind, "a").distinct(), named.filter("b <> ''").select(kind, "b").distinct())
    by_name = known.join(pairs, "a").join(named.select("regra_id", "b"), "b").select("layout_id", "nome_layout", "regra_id")
    by_id = known.filter(S.text(F.col("layout_id")) != "").join(rules.select("layout_id", "regra_id"), "layout_id").select("layout_id", "nome_layout", "regra_id")
    any_name = known.join(named.filter("rede = '*'").select("regra_id").withColumn("a_", F.lit(True)), F.col("a_") & (F.col("a") != "")).select("layout_id", "nome_layout", "regra_id")
    return by_name.unionByName(by_id).unionByName(any_name).distinct()


def match_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """row_id, regra_id, tipo_regra of the best rule of an item's layout (J-07); items that none fits don't appear.

    A blank or * field of a rule fits all. Lower priority numbers win, then more fields stated, then the first rule.
    Items meet the rules of their own layout only, so the join is on a key: the layout's id and, if items have nome_layout, its name as rules_of_layouts has it.
    """
    r = rules.select("regra_id", "layout_id", "tipo_regra", "prioridade", *[S.text(F.col(c)).alias(f"r_{c}") for c in ("centro", "sku", "ean", "descricao")])
    key = ["layout_id"]
    if "nome_layout" in items.columns:
        key = ["layout_id", "nome_layout"]
        r = rules_of_layouts(items.select(*key).distinct(), rules).join(r.drop("layout_id"), "regra_id")
    free = lambda c: F.col(c).isin("", "*")
    a, b = F.upper(S.text(F.col("descricao"))), F.upper(F.col("r_descricao"))
    fits = (
        (free("r_centro") | (S.text(F.col("centro")) == "") | (F.upper("r_centro") == F.upper("centro")))
        & (free("r_sku") | _same_code("sku", "r_sku"))
        & (free("r_ean") | _same_code("ean", "r_ean"))
        & (free("r_descricao") | a.contains(b) | ((a != "") & b.contains(a)))
    )
    stated = sum((F.when(free(f"r_{c}"), 0).otherwise(1) for c in ("centro", "sku", "ean", "descricao")), F.lit(0))
    order = F.struct("prioridade", (-stated).alias("stated"), "regra_id")
    best = items.join(r, key).filter(fits).groupBy("row_id").agg(F.min_by(F.struct("regra_id", "tipo_regra"), order).alias("x"))
    return best.select("row_id", "x.regra_id", "x.tipo_regra")


def _bare(c: Column) -> Column:
    """Digits of a code without leading zeros, "0" for zeros only, "" for none."""
    d = S.digits(c)
    return F.when((d != "") & (F.ltrim(d, F.lit("0")) == ""), "0").otherwise(F.ltrim(d, F.lit("0")))


def lookup_product(items: DataFrame, base: DataFrame) -> DataFrame:
    """row_id, sku_mapa, fator, situacao for items with sku, ean, centro and, if there, descricao (J-08).

    Codes meet by their digits, leading zeros aside; an article also by the entry's base article (sku_base), if there. Entries by
    bar code (of unit or case) come before those by article, and among the former those of the item's article, if any. Of these,
    entries of the item's centre count; a blank centre takes all. The best one has the unit's bar code, then the case's, then the
    article, then a description that holds the item's or is held by it, then the longest description, then comes first. AMBIGUO where they differ in article or factor.
    """
    described = F.col("descricao") if "descricao" in items.columns else F.lit("")
    own = items.select("row_id", _bare(F.col("sku")).alias("s"), _bare(F.col("ean")).alias("e"), F.col("centro").alias("c"), X.snake(described).alias("d"))
    asked = own.select("*", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("e").alias("code")), F.struct(F.lit(1).alias("kind"), F.col("s").alias("code")))).alias("k"))
    asked = asked.select("row_id", "s", "e", "c", "d", "k.kind", "k.code").filter("code <> ''")
    second = F.col("sku_base") if "sku_base" in base.columns else F.lit("")
    known = base.select(F.col("row_id").alias("entry"), "centro", "sku", "descricao", "apresentacao", _bare(F.col("ean")).alias("be"), _bare(F.col("dun")).alias("bd"), F.array(_bare(F.col("sku")), _bare(second)).alias("bs"), X.snake(F.col("descricao")).alias("dn"))
    keys = F.array_distinct(F.array(F.struct(F.lit(0).alias("kind"), F.col("be").alias("code")), F.struct(F.lit(0).alias("kind"), F.col("bd").alias("code")), *[F.struct(F.lit(1).alias("kind"), F.get("bs", i).alias("code")) for i in (0, 1)]))
    known = known.withColumn("k", F.explode(keys)).select("*", "k.kind", "k.code").drop("k").filter("code <> ''")
    hits = asked.join(known, ["kind", "code"])
    same_article = (F.col("s") != "") & F.array_contains("bs", F.col("s"))
    level = F.struct("kind", (~same_article).alias("other"))
    hits = hits.withColumn("level", level).withColumn("best", F.min("level").over(Window.partitionBy("row_id"))).filter("level = best")
    here = (F.col("c") == "") | (F.col("c") == F.col("centro"))
    told = (F.col("d") != "") & (F.col("dn") != "") & (F.contains("d", F.col("dn")) | F.contains("dn", F.col("d")))
    rank = F.struct(((F.col("e") != "") & (F.col("e") == F.col("be"))).alias("ean"), ((F.col("e") != "") & (F.col("e") == F.col("bd"))).alias("dun"), same_article.alias("article"), told.alias("told"), F.length("descricao").alias("n"), (-F.col("entry")).alias("e"))
    first = F.max_by(F.struct("sku", "apresentacao"), F.when(here, rank))
    x = hits.groupBy("row_id").agg(first.alias("x"), F.max(here).alias("some"), F.countDistinct(F.when(here, F.struct("sku", "apresentacao"))).alias("n"))
    status = F.when(F.col("n").isNull(), "NAO_ENCONTRADO").when(~F.col("some"), "OUTRO_CENTRO").when(F.col("n") > 1, "AMBIGUO").otherwise("OK")
    x = items.select("row_id").join(x, "row_id", "left").withColumn("situacao", status)
    found = F.col("some")
    return x.select("row_id", F.when(found, F.col("x.sku")).alias("sku_mapa"), F.when(found, F.col("x.apresentacao")).cast("long").alias("fator"), "situacao")


def convert_units(items: DataFrame, base: DataFrame) -> DataFrame:
    """row_id, caixas, resto, status: quantity qtd_int in cases by the product map (NUM-09, PIPE-02); what is left over blocks."""
    x = items.select("row_id", "qtd_int").join(lookup_product(items, base), "row_id")
    usable = (F.col("situacao") == "OK") & (F.col("fator") > 0) & F.col("qtd_int").isNotNull()
    rest = F.when(usable, F.col("qtd_int") % F.col("fator"))
    status = F.when(~usable, "CONVERSAO_PENDENTE").when(rest > 0, "FRACIONADO").otherwise("CONVERTIDO")
    return x.select("row_id", F.when(usable, F.floor(F.col("qtd_int") / F.col("fator"))).cast("long").alias("caixas"), rest.alias("resto"), status.alias("status"))
