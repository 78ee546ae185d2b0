"""Queries of conversion rules by layout names and of products by any form of their codes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import conversion
from .registry import over


def _named(m: DataFrame) -> DataFrame:
    """Entries of the map as items of layouts that are known by id, by a name that holds a network's or is held by one, or by neither."""
    k = F.floor(F.col("row_id") / 10) % 6
    name = F.when(k == 0, "Rede NÉT ONE pdf Sul").when(k == 1, "net two").when(k == 2, "NET-THREE PDF").when(k == 3, "").when(k == 4, "Outra Rede").otherwise("NET FOUR PDF 2")
    return m.withColumns({"layout_id": F.when(k == 3, "4").when(k == 4, "9").otherwise(""), "nome_layout": name})


def _rules(r: DataFrame) -> DataFrame:
    """The rules, and one for any network, of last priority, for one centre."""
    return r.unionByName(r.limit(1).selectExpr("7 AS regra_id", "'*' AS rede_layout", "'' AS layout_id", "'C2' AS centro", "'' AS ean", "'' AS sku", "'' AS descricao", "'' AS fator", "'GERAL' AS tipo_regra", "'NAO' AS usa_mapa", "999 AS prioridade"))


over("j_07_rules_by_name", lambda m, r: conversion.match_rules(_named(m), _rules(r)).select("row_id", F.col("regra_id").cast("long").alias("regra_id"), "tipo_regra"), "f4_map f5_rules", """WITH i AS (SELECT *, row_id // 10 % 6 AS k FROM f4_map),
n AS (SELECT *, CASE k WHEN 0 THEN 'Rede NÉT ONE pdf Sul' WHEN 1 THEN 'net two' WHEN 2 THEN 'NET-THREE PDF' WHEN 3 THEN '' WHEN 4 THEN 'Outra Rede' ELSE 'NET FOUR PDF 2' END AS nome, CASE k WHEN 3 THEN '4' WHEN 4 THEN '9' ELSE '' END AS lid FROM i),
v AS (SELECT *, trim(regexp_replace(lower(strip_accents(nome)), '[^a-z0-9]+', '_', 'g'), '_') AS a FROM n),
r AS (SELECT *, trim(regexp_replace(lower(strip_accents(rede_layout)), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM (SELECT * FROM f5_rules UNION ALL SELECT 7, '*', '', 'C2', '', '', '', '', 'GERAL', 'NAO', 999)),
x AS (SELECT v.row_id, r.regra_id, r.tipo_regra, row_number() OVER (PARTITION BY v.row_id ORDER BY r.prioridade, -((r.centro <> '')::INT + (r.ean <> '')::INT + (r.sku <> '')::INT + (r.descricao <> '')::INT), r.regra_id) AS o FROM v JOIN r
  ON ((lid <> '' AND r.layout_id = lid) OR (a <> '' AND (r.rede_layout = '*' OR (b <> '' AND (contains(a, b) OR contains(b, a))))))
  AND (r.centro = '' OR r.centro = v.centro) AND (r.ean = '' OR ltrim(r.ean, '0') = ltrim(v.ean, '0')) AND (r.sku = '' OR r.sku = v.sku) AND (r.descricao = '' OR contains(v.descricao, r.descricao) OR contains(r.descricao, v.descricao)))
SELECT row_id, CAST(regra_id AS BIGINT) AS regra_id, tipo_regra FROM x WHERE o = 1""")


def _coded(m: DataFrame) -> DataFrame:
    """Entries of the map as items: bar codes of units or cases, with zeros before or none, articles by their base, and parts of descriptions."""
    k = F.col("row_id") % 7
    return m.select(
        "row_id", F.when(k == 0, "").when(k == 1, F.concat(F.lit("000"), "ean")).when(k == 2, F.col("dun")).when(k == 3, "7890000000000").otherwise(F.when(k == 4, F.col("ean")).otherwise("")).alias("ean"),
        F.when(k.isin(0, 5), F.concat(F.lit("00"), F.col("sku"))).when(k == 6, F.concat(F.lit("77"), F.col("sku"))).when(k == 1, F.col("sku")).otherwise("").alias("sku"), F.when(k == 5, "").when(k == 3, "C9").otherwise(F.col("centro")).alias("centro"),
        F.when(F.col("row_id") % 2 == 0, F.lower(F.substring_index("descricao", " ", 2))).otherwise("").alias("descricao"),
    )


def _base(m: DataFrame) -> DataFrame:
    """The map with base articles, and a second entry of every fifth product of other factor and longer description."""
    x = m.withColumn("sku_base", F.concat(F.lit("77"), F.col("sku")))
    return x.unionByName(x.filter("row_id % 5 = 0").withColumns({"row_id": F.col("row_id") + 100000000, "descricao": F.concat(F.lit("EXTRA COMPRIDO NOME "), F.lit("DE OUTRO ARTIGO")), "apresentacao": F.col("apresentacao") + 1}))


over("j_08_products_by_any_code", lambda m: conversion.lookup_product(_coded(m), _base(m)), "f4_map", r"""WITH b AS (SELECT row_id AS entry, centro, ean, dun, sku, concat('77', sku) AS sku_base, descricao, apresentacao FROM f4_map UNION ALL SELECT row_id + 100000000, centro, ean, dun, sku, concat('77', sku), 'EXTRA COMPRIDO NOME DE OUTRO ARTIGO', apresentacao + 1 FROM f4_map WHERE row_id % 5 = 0),
i AS (SELECT row_id, CASE row_id % 7 WHEN 1 THEN ean WHEN 2 THEN dun WHEN 3 THEN '7890000000000' WHEN 4 THEN ean ELSE '' END AS e, CASE WHEN row_id % 7 IN (0, 1, 5) THEN sku WHEN row_id % 7 = 6 THEN concat('77', sku) ELSE '' END AS s, CASE row_id % 7 WHEN 5 THEN '' WHEN 3 THEN 'C9' ELSE centro END AS c, CASE WHEN row_id % 2 = 0 THEN array_to_string(string_split(descricao, ' ')[1:2], ' ') ELSE '' END AS d FROM f4_map),
h AS (SELECT i.*, b.entry, b.sku, b.apresentacao, b.centro, b.descricao, 0 AS kind, s <> '' AND s IN (b.sku, sku_base) AS art, b.ean, b.dun FROM i JOIN b ON i.e <> '' AND b.ean = i.e UNION ALL SELECT i.*, b.entry, b.sku, b.apresentacao, b.centro, b.descricao, 0, s <> '' AND s IN (b.sku, sku_base), b.ean, b.dun FROM i JOIN b ON i.e <> '' AND b.dun = i.e
  UNION ALL SELECT i.*, b.entry, b.sku, b.apresentacao, b.centro, b.descricao, 1, TRUE, b.ean, b.dun FROM i JOIN b ON i.s <> '' AND b.sku = i.s UNION ALL SELECT i.*, b.entry, b.sku, b.apresentacao, b.centro, b.descricao, 1, TRUE, b.ean, b.dun FROM i JOIN b ON i.s <> '' AND b.sku_base = i.s),
l AS (SELECT *, min((kind, NOT art)) OVER (PARTITION BY row_id) = (kind, NOT art) AS top, c = '' OR c = centro AS here FROM h),
g AS (SELECT row_id, bool_or(here) AS known, count(DISTINCT (sku, apresentacao)) FILTER (here) AS n, arg_max((sku, apresentacao), (e <> '' AND e = ean, e <> '' AND e = dun, art, d <> '' AND (contains(descricao, d) OR contains(d, descricao)), length(descricao), -entry)) FILTER (here) AS x FROM l WHERE top GROUP BY 1)
SELECT i.row_id, CASE WHEN known THEN x[1] END AS sku_mapa, CAST(CASE WHEN known THEN x[2] END AS BIGINT) AS fator, CASE WHEN n IS NULL THEN 'NAO_ENCONTRADO' WHEN NOT known THEN 'OUTRO_CENTRO' WHEN n > 1 THEN 'AMBIGUO' ELSE 'OK' END AS situacao FROM i LEFT JOIN g USING (row_id)""")
