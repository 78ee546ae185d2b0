"""The registered queries of the order library, each with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import conversion, dates, lines, lots, queue, resolve, sheets
from .plans import operational
from .registry import QUERIES as _QUERIES
from .registry import TODAY, over
from .sources import documents

#: The cleaned queue in the oracle's own words.
_JUDGED = """WITH c AS (SELECT row_id, qtd, CASE WHEN regexp_full_match(trim(matricula), '[0-9]+\\.0+') THEN split_part(trim(matricula), '.', 1) ELSE regexp_replace(matricula, '[^0-9]', '', 'g') END AS matricula,
  CASE WHEN regexp_full_match(trim(sku), '[0-9]+\\.0+') THEN split_part(trim(sku), '.', 1) ELSE regexp_replace(sku, '[^0-9]', '', 'g') END AS sku_norm,
  CASE WHEN trim(pedido) = '.' THEN '.' ELSE regexp_replace(pedido, '[^0-9A-Za-z]', '', 'g') END AS pedido_norm,
  TRY_CAST(CASE WHEN qtd LIKE '%,%' THEN replace(replace(qtd, '.', ''), ',', '.') ELSE qtd END AS DOUBLE) AS q,
  try_strptime(replace(data_remessa, '.', '/'), '%d/%m/%Y') AS d, data_remessa FROM f1_queue),
b AS (SELECT *, CAST(greatest(1, floor(q)) AS BIGINT) AS qtd_int, strftime(d, '%d/%m/%Y') AS data_norm,
  list_filter([CASE WHEN matricula = '' THEN 'MATRICULA_VAZIA' END, CASE WHEN sku_norm = '' THEN 'SKU_VAZIO' END, CASE WHEN pedido_norm = '' THEN 'PEDIDO_VAZIO' END,
   CASE WHEN trim(qtd) = '' THEN 'QTD_VAZIA' WHEN q IS NULL THEN concat('QTD_INVALIDA: ', qtd) END, CASE WHEN trim(data_remessa) = '' THEN 'DATA_VAZIA' WHEN d IS NULL THEN 'DATA_INVALIDA' END], lambda r: r IS NOT NULL) AS r FROM c),
j AS (SELECT *, CASE WHEN len(r) > 0 THEN array_to_string(r, ' | ') WHEN length(sku_norm) > 14 THEN 'SKU_MAIS_14' ELSE '' END AS status FROM b)"""
CONSOLIDATED = _CONSOLIDATED = _JUDGED + """, k AS (SELECT matricula, pedido_norm, sku_norm, data_norm, min(row_id) AS row_id, CAST(sum(qtd_int) AS BIGINT) AS qtd, count(*) AS linhas FROM j WHERE status = '' GROUP BY ALL)"""
_CONTEXT = """WITH x AS (SELECT *, coalesce(last_value(nullif(regexp_extract(line, '^PEDIDO DE COMPRAS ([0-9]+)/', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no), '') AS pedido FROM f6_lines)"""
_ITEM = "'^([0-9]{6}) ([0-9]+) (.+) CX ([0-9]+) ([0-9]+),00 [0-9]+,[0-9]{4}$'"


over("flt_05_validate_queue", lambda q: queue.judged(q).select("row_id", "matricula", "sku_norm", "pedido_norm", "qtd_int", "data_norm", "status"), "f1_queue", _JUDGED + " SELECT row_id, matricula, sku_norm, pedido_norm, CASE WHEN q IS NULL THEN NULL ELSE qtd_int END AS qtd_int, data_norm, status FROM j")
over("flt_04_safe_rows", queue.safe_rows, "f1_queue", """WITH c AS (SELECT *, CASE WHEN qtd LIKE '%,%' THEN replace(replace(qtd, '.', ''), ',', '.') ELSE qtd END AS p FROM f1_queue),
b AS (SELECT row_id, list_filter([CASE WHEN matricula = '' THEN 'MATRICULA' END, CASE WHEN sku = '' THEN 'SKU' END, CASE WHEN TRY_CAST(p AS DECIMAL(18,6)) IS NULL OR TRY_CAST(p AS DECIMAL(18,6)) <= 0 OR TRY_CAST(p AS DECIMAL(18,6)) % 1 <> 0 THEN 'QTD' END, CASE WHEN pedido = '' THEN 'PEDIDO' END, CASE WHEN data_remessa = '' THEN 'DATA' END], lambda r: r IS NOT NULL) AS r FROM c)
SELECT row_id, array_to_string(r, ' | ') AS motivos, len(r) = 0 AS segura FROM b""")
over("flt_10_blocking_errors", lambda q: queue.blocking(q, ("DATA_VAZIA", "DATA_INVALIDA")), "f1_queue", _JUDGED + " SELECT row_id, len(list_filter(string_split(status, ' | '), lambda s: s NOT IN ('DATA_VAZIA', 'DATA_INVALIDA'))) > 0 AS bloqueia FROM j WHERE status <> ''")
over("agg_01_consolidate_skus", lambda q: queue.consolidate(queue.validate_queue(q)[0]).drop("data_remessa"), "f1_queue", _CONSOLIDATED + " SELECT matricula, pedido_norm, sku_norm, data_norm, row_id, (SELECT f.sku FROM f1_queue f WHERE f.row_id = k.row_id) AS sku, (SELECT f.pedido FROM f1_queue f WHERE f.row_id = k.row_id) AS pedido, qtd, linhas, CASE WHEN linhas > 1 THEN concat('SKU_DUPLICADO_CONSOLIDADO | linhas=', linhas, ' | qtd_total=', qtd) ELSE '' END AS observacao FROM k")
over("agg_05_potential_duplicates", queue.potential_duplicates, "f1_queue", _JUDGED + " SELECT pedido_norm, matricula, sku_norm, count(*) AS linhas, CAST(sum(CASE WHEN q IS NULL THEN NULL ELSE qtd_int END) AS BIGINT) AS qtd_total FROM j WHERE matricula <> '' AND sku_norm <> '' AND pedido_norm NOT IN ('', '.') GROUP BY ALL HAVING count(*) > 1")
over("agg_08_executive_panel", queue.executive_panel, "f1_queue", _JUDGED + """, s AS (SELECT count(*) AS a, count(*) FILTER (status = '') AS b, count(*) FILTER (status <> '') AS c, count(DISTINCT matricula) FILTER (status = '') AS d, CAST(sum(qtd_int) FILTER (status = '') AS BIGINT) AS e FROM j)
SELECT unnest(['lidas', 'validas', 'rejeitadas', 'clientes', 'unidades']) AS indicador, unnest([a, b, c, d, e]) AS valor FROM s""")
over("agg_09_reason_counts", queue.reason_counts, "f1_queue", _JUDGED + " SELECT motivo, count(*) AS linhas FROM (SELECT unnest(string_split(status, ' | ')) AS motivo FROM j WHERE status <> '') GROUP BY 1")
over("agg_20_queue_stats", queue.queue_stats, "f1_queue", "SELECT count(*) AS linhas, (SELECT count(*) FROM (SELECT DISTINCT matricula, pedido FROM f1_queue)) AS pedidos FROM f1_queue")
over("agg_21_error_groups", queue.error_groups, "f1_queue", _JUDGED + " SELECT matricula, pedido_norm, string_agg(DISTINCT status, ' ; ' ORDER BY status) AS motivos, count(*) AS linhas FROM j WHERE status <> '' GROUP BY 1, 2")
over("win_12_item_sequence", lambda q: queue.with_sequence(q).select("row_id", F.col("seq").cast("long").alias("seq")), "f1_queue", "SELECT row_id, row_number() OVER (PARTITION BY matricula, pedido ORDER BY row_id) AS seq FROM f1_queue")
over("str_10_order_fallback", lambda q: q.select("row_id", S.order_or_fallback(F.col("matricula"), F.col("pedido"), F.lit(TODAY).cast("date")).alias("pedido")), "f1_queue", "SELECT row_id, CASE WHEN pedido IN ('', '.') THEN concat(matricula, '17032026') ELSE pedido END AS pedido FROM f1_queue")
over("pipe_03_item_records", lambda q, g: operational.item_records(q, g, TODAY), "f1_queue f3_gln", _CONSOLIDATED + """, g AS (SELECT matricula, arg_max(gln, row_id) AS gln FROM f3_gln GROUP BY 1),
o AS (SELECT k.*, gln, CASE WHEN pedido_norm = '.' THEN concat(k.matricula, '17032026') ELSE pedido_norm END AS pedido FROM k JOIN g USING (matricula)),
s AS (SELECT *, row_number() OVER (PARTITION BY matricula, pedido ORDER BY row_id) AS seq FROM o)
SELECT matricula, pedido, seq, rpad(concat('04', lpad(CAST(seq AS VARCHAR), 6, '0'), lpad(sku_norm, 14, '0'), repeat(' ', 38), rpad('.', 35, ' '), lpad(CAST(qtd * 10000 AS VARCHAR), 17, '0'), repeat('0', 17), lpad(gln, 13, '0'), lpad(matricula, 15, '0'), repeat(' ', 6), repeat('0', 130)), 400, ' ') AS registro FROM s""")
over("src_07_load_xref", resolve.load_xref, "f2_xref", "SELECT row_id, upper(rede) AS rede, chave_lida AS chave, matricula FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> '' AND chave_lida <> ''")
over("snk_07_upsert_xref", lambda x: resolve.upsert_xref(resolve.load_xref(x), resolve.load_xref(x).withColumn("row_id", -F.col("row_id")).filter("row_id % 2 = 0")), "f2_xref", "SELECT CASE WHEN row_id % 2 = 0 THEN -row_id ELSE row_id END AS row_id, upper(rede) AS rede, chave_lida AS chave, matricula FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> ''")
over("j_01_resolve_by_cnpj", lambda x, g: resolve.resolve_by_cnpj(x.select("row_id", "cnpj_oficial"), g, "cnpj_oficial"), "f2_xref f3_gln", """WITH i AS (SELECT cnpj, min(matricula) AS m, count(DISTINCT matricula) AS n FROM f3_gln GROUP BY 1)
SELECT x.row_id, cnpj_oficial, CASE WHEN n = 1 THEN m ELSE '' END AS achada, coalesce(n > 1, false) AS ambigua FROM f2_xref x LEFT JOIN i ON i.cnpj = x.cnpj_oficial""")
over("j_02_attach_gln", lambda q, g: resolve.attach_gln(q.select("row_id", "matricula"), g), "f1_queue f3_gln", "SELECT row_id, q.matricula, coalesce(gln, '') AS gln FROM f1_queue q LEFT JOIN (SELECT matricula, arg_max(gln, row_id) AS gln FROM f3_gln GROUP BY 1) g ON g.matricula = q.matricula")
over("j_05_resolve_ean", lambda m: resolve.resolve_ean(m.filter("centro = 'C1'").select("row_id", "ean"), m), "f4_map", "SELECT m.row_id, m.ean, s.sku FROM f4_map m JOIN (SELECT ean, arg_min(sku, row_id) AS sku FROM f4_map GROUP BY 1) s USING (ean) WHERE centro = 'C1'")
over("j_09_attach_ship_date", lambda q, s: resolve.attach_ship_date(q.select("row_id", "matricula", "pedido"), s), "f1_queue f10_ship", """WITH s AS (SELECT * FROM f10_ship WHERE data_remessa <> ''), e AS (SELECT matricula, pedido, arg_min(data_remessa, row_id) AS d1 FROM s GROUP BY ALL),
o AS (SELECT matricula, arg_min(data_remessa, row_id) AS d2 FROM s GROUP BY 1 HAVING count(DISTINCT pedido) = 1)
SELECT row_id, coalesce(d1, d2, '') AS data, CASE WHEN d1 IS NOT NULL THEN 1 WHEN d2 IS NOT NULL THEN 2 ELSE 0 END AS nivel FROM f1_queue q LEFT JOIN e ON e.matricula = q.matricula AND e.pedido = q.pedido LEFT JOIN o ON o.matricula = q.matricula""")
over("set_05_dedup_shipments", resolve.dedup_shipments, "f10_ship", "SELECT matricula, pedido, data_remessa, min(row_id) AS row_id FROM f10_ship GROUP BY ALL")
over("agg_22_map_diagnostics", resolve.map_diagnostics, "f4_map", "SELECT count(*) AS linhas, count(DISTINCT centro) AS centros, count(DISTINCT sku) AS skus, count(DISTINCT ean) AS eans, count(DISTINCT dun) AS duns, count(*) FILTER (apresentacao <= 0) AS sem_fator, (SELECT count(*) FROM (SELECT ean FROM f4_map GROUP BY 1 HAVING count(DISTINCT apresentacao) > 1)) AS ambiguas FROM f4_map")
over("str_12_cnpj_mask", lambda g: g.select("row_id", S.cnpj_mask(F.col("cnpj")).alias("cnpj")), "f3_gln", "SELECT row_id, concat(cnpj[1:2], '.', cnpj[3:5], '.', cnpj[6:8], '/', cnpj[9:12], '-', cnpj[13:14]) AS cnpj FROM f3_gln")
over("ex_01_extract_items", lines.extract_items, "f6_lines", _CONTEXT + f" SELECT file, line_no, pedido, regexp_extract(line, {_ITEM}, 1) AS sku, coalesce(TRY_CAST(regexp_extract(line, {_ITEM}, 5) AS BIGINT), 0) AS qtd, CASE WHEN regexp_matches(line, {_ITEM}) THEN '' ELSE 'LINHA_NAO_LIDA' END AS alerta FROM x WHERE regexp_matches(line, '^[0-9]{{6}} ')")
over("win_01_fill_down", lambda x: lines.with_context(x, {"pedido": lines.ORDER, "cnpj": lines.CNPJ}).select("file", "line_no", "pedido", "cnpj"), "f6_lines", _CONTEXT + " SELECT file, line_no, pedido, coalesce(last_value(nullif(regexp_extract(line, '([0-9]{2}\\.[0-9]{3}\\.[0-9]{3}/[0-9]{4}-[0-9]{2})', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no), '') AS cnpj FROM x")
over("win_05_broken_lines", lines.joined_broken, "f6_lines", f"WITH x AS (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY page, line_no) AS n FROM f6_lines) SELECT file, line_no, concat_ws(' ', line, n) AS inteira FROM x WHERE regexp_matches(line, '^[0-9]{{6}} ') AND NOT regexp_matches(line, {_ITEM})")
over("win_07_order_blocks", lines.order_blocks, "f6_lines", "WITH x AS (SELECT *, CAST(sum(CASE WHEN line LIKE 'PEDIDO DE COMPRAS %' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY page, line_no) AS BIGINT) AS bloco FROM f6_lines) SELECT file, bloco, count(*) AS linhas, min(line_no) AS primeira FROM x GROUP BY ALL")
over("agg_03_reconcile_totals", lines.reconcile_totals, "f6_lines", _CONTEXT + f""", s AS (SELECT file, pedido, CAST(coalesce(sum(TRY_CAST(regexp_extract(line, {_ITEM}, 5) AS BIGINT)), 0) AS BIGINT) AS soma, max(TRY_CAST(regexp_extract(line, '^TOTAIS ([0-9]+),00$', 1) AS BIGINT)) AS t, bool_or(regexp_matches(line, '^[0-9]{{6}} ') AND NOT regexp_matches(line, {_ITEM})) AS p FROM x GROUP BY 1, 2)
SELECT file, pedido, soma, coalesce(t, -1) AS total, CASE WHEN t IS NULL THEN 'SEM_TOTAL' WHEN t <> soma THEN 'DIVERGENTE' WHEN p THEN 'OK_PENDENTE' ELSE 'OK' END AS situacao FROM s""")
over("agg_17_page_audit", lines.page_audit, "f6_lines", f"SELECT file, count(*) AS linhas, count(*) FILTER (line LIKE 'PEDIDO DE COMPRAS %') AS pedidos, count(*) FILTER (regexp_matches(line, {_ITEM})) AS itens FROM f6_lines GROUP BY 1")
over("set_04_unique_lines", lines.unique_lines, "f6_lines", _CONTEXT + " SELECT file, page, pedido, line, min(line_no) AS line_no FROM x GROUP BY 1, 2, 3, 4")
over("win_09_flag_repeats", lots.flag_repeats, "f9_history", "SELECT row_id, row_number() OVER w > 1 AS repetido, first_value(arquivo) OVER w AS primeiro_arquivo FROM f9_history WINDOW w AS (PARTITION BY push, pedido ORDER BY row_id)")
over("j_14_flag_history", lambda h: lots.flag_history(h, h), "f9_history", "SELECT h.* FROM f9_history h WHERE EXISTS (SELECT 1 FROM f9_history e WHERE e.pedido = h.pedido AND e.push < h.push)")
over("agg_13_push_summary", lots.push_summary, "f9_history", "WITH p AS (SELECT push, pedido, count(*) AS n FROM f9_history GROUP BY 1, 2) SELECT h.push, count(DISTINCT arquivo) AS arquivos, count(*) AS itens, (SELECT count(*) FROM p WHERE p.push = h.push) AS pedidos, (SELECT count(*) FROM p WHERE p.push = h.push AND n > 1) AS repetidos FROM f9_history h GROUP BY h.push")
over("agg_14_order_status", lots.order_status, "f9_history", "SELECT pedido, count(*) AS n, CASE WHEN count(*) > 1 THEN 'DUPLICADO' ELSE 'OK' END AS status FROM f9_history GROUP BY 1")
over("agg_18_lot_totals", lots.lot_totals, "f9_history", "SELECT lote, count(*) AS itens, count(DISTINCT push) AS pushes, max(push) AS ultimo_push FROM f9_history GROUP BY 1")
over("win_13_next_push", lots.next_push, "f9_history", "SELECT max(push) + 1 AS push FROM f9_history")
_MAPPED = """WITH i AS (SELECT row_id, regexp_replace(regexp_replace(trim(sku), '\\.0+$', ''), '[^0-9]', '', 'g') AS sku, CASE WHEN row_id % 3 = 0 AND sku <> '' THEN concat('789', lpad(regexp_replace(sku, '[^0-9]', '', 'g')[-10:], 10, '0')) ELSE '' END AS ean, concat('C', row_id % 4) AS centro,
  CAST(greatest(1, floor(TRY_CAST(CASE WHEN qtd LIKE '%,%' THEN replace(replace(qtd, '.', ''), ',', '.') ELSE qtd END AS DOUBLE))) AS BIGINT) AS qi, TRY_CAST(CASE WHEN qtd LIKE '%,%' THEN replace(replace(qtd, '.', ''), ',', '.') ELSE qtd END AS DOUBLE) AS q FROM f1_queue),
h AS (SELECT i.row_id, 0 AS kind, i.sku AS s, i.centro AS c, m.* EXCLUDE (row_id), m.row_id AS entry FROM i JOIN f4_map m ON m.ean = i.ean UNION ALL
  SELECT i.row_id, 0, i.sku, i.centro, m.* EXCLUDE (row_id), m.row_id FROM i JOIN f4_map m ON m.dun = i.ean UNION ALL
  SELECT i.row_id, 1, i.sku, i.centro, m.* EXCLUDE (row_id), m.row_id FROM i JOIN f4_map m ON m.sku = i.sku),
l AS (SELECT *, CASE WHEN kind = 1 THEN 2 WHEN sku = s THEN 0 ELSE 1 END AS lv FROM h), b AS (SELECT *, min(lv) OVER (PARTITION BY row_id) AS bl FROM l),
n AS (SELECT row_id, bool_or(c = centro) AS algum, count(DISTINCT concat(sku, '/', apresentacao)) FILTER (c = centro) AS n, arg_max(sku, (length(descricao), -entry)) FILTER (c = centro) AS sku_mapa, arg_max(apresentacao, (length(descricao), -entry)) FILTER (c = centro) AS fator FROM b WHERE lv = bl GROUP BY 1),
p AS (SELECT i.row_id, q, qi, sku_mapa, CAST(fator AS BIGINT) AS fator, CASE WHEN n.row_id IS NULL THEN 'NAO_ENCONTRADO' WHEN NOT algum THEN 'OUTRO_CENTRO' WHEN n > 1 THEN 'AMBIGUO' ELSE 'OK' END AS situacao FROM i LEFT JOIN n USING (row_id))"""
_PAGE = """WITH a AS (SELECT *, CASE WHEN top - lag(top) OVER w > 3 OR lag(top) OVER w IS NULL THEN 1 ELSE 0 END AS novo FROM f8_words WINDOW w AS (PARTITION BY file, page ORDER BY top, x0)),
v AS (SELECT *, CAST(sum(novo) OVER (PARTITION BY file, page ORDER BY top, x0) AS BIGINT) AS linha FROM a)"""
BANDS, CENTRES = {"sku": (0.0, 100.0), "descricao": (100.0, 250.0), "qtd": (250.0, 1000.0)}, {"L1": 290.0, "L2": 300.0, "L3": 312.0}


def _mapped(q: DataFrame) -> DataFrame:
    """Queue rows as items of the product map: every third one by bar code, centres in turn."""
    code = S.sku(F.col("sku"))
    ean = F.when((F.col("row_id") % 3 == 0) & (code != ""), F.concat(F.lit("789"), F.lpad(F.expr("right(regexp_replace(sku, '[^0-9]', ''), 10)"), 10, "0"))).otherwise("")
    return q.select("row_id", code.alias("sku"), ean.alias("ean"), F.concat(F.lit("C"), F.col("row_id") % 4).alias("centro"), S.queue_quantity(F.col("qtd")).alias("qtd_int"))


def _asked(x: DataFrame) -> DataFrame:
    """Keys of the cross-reference as documents may hold them: zeros lost or only the first digits, some under another network."""
    read = F.when(F.col("row_id") % 3 == 0, F.regexp_replace("chave_lida", "^0+", "")).when(F.col("row_id") % 3 == 1, F.substring("chave_lida", 1, 12)).otherwise(F.col("chave_lida"))
    return x.select("row_id", read.alias("lido"), F.when(F.col("row_id") % 4 == 0, "OTHER").otherwise(F.col("rede")).alias("rede"))


def _ship_days(q: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("segunda", "TERÇA-FEIRA", "quarta", "QUINTA-FEIRA", "sexta", "SÁBADO", "domingo")])
    rule = F.when(F.col("row_id") % 3 == 0, "D+1").when(F.col("row_id") % 3 == 1, "coluna").otherwise("OUTRA")
    value = F.when(F.col("row_id") % 5 == 0, F.element_at(names, (F.col("row_id") % 7 + 1).cast("int"))).otherwise(F.col("data_remessa"))
    return q.select("row_id", F.date_format(dates.ship_day(rule, value, F.lit(TODAY).cast("date")), "dd.MM.yyyy").alias("data"))


over("j_07_match_rules", lambda m, r: conversion.match_rules(m.withColumn("layout_id", (F.floor(F.col("row_id") / 10) % 4 + 1).cast("string")), r).select("row_id", F.col("regra_id").cast("long").alias("regra_id"), "tipo_regra"), "f4_map f5_rules", """WITH x AS (SELECT i.row_id, r.regra_id, r.tipo_regra, row_number() OVER (PARTITION BY i.row_id ORDER BY r.prioridade, -((r.centro <> '')::INT + (r.ean <> '')::INT + (r.sku <> '')::INT + (r.descricao <> '')::INT), r.regra_id) AS n FROM f4_map i JOIN f5_rules r ON r.layout_id = CAST(i.row_id // 10 % 4 + 1 AS VARCHAR) AND (r.centro = '' OR r.centro = i.centro) AND (r.ean = '' OR ltrim(r.ean, '0') = ltrim(i.ean, '0')) AND (r.sku = '' OR r.sku = i.sku) AND (r.descricao = '' OR contains(i.descricao, r.descricao) OR contains(r.descricao, i.descricao)))
SELECT row_id, CAST(regra_id AS BIGINT) AS regra_id, tipo_regra FROM x WHERE n = 1""")
over("j_08_lookup_product", lambda q, m: conversion.lookup_product(_mapped(q), m), "f1_queue f4_map", _MAPPED + " SELECT row_id, sku_mapa, fator, situacao FROM p")
over("pipe_02_convert_units", lambda q, m: conversion.convert_units(_mapped(q), m), "f1_queue f4_map", _MAPPED + ", u AS (SELECT *, situacao = 'OK' AND fator > 0 AND q IS NOT NULL AS ok FROM p) SELECT row_id, CASE WHEN ok THEN qi // fator END AS caixas, CASE WHEN ok THEN qi % fator END AS resto, CASE WHEN coalesce(ok, false) = false THEN 'CONVERSAO_PENDENTE' WHEN qi % fator > 0 THEN 'FRACIONADO' ELSE 'CONVERTIDO' END AS status FROM u")
over("j_03_xref_lookup", lambda x: resolve.xref_lookup(_asked(x), resolve.load_xref(x)), "f2_xref", """WITH i AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN ltrim(chave_lida, '0') WHEN row_id % 3 = 1 THEN chave_lida[:12] ELSE chave_lida END AS lido, CASE WHEN row_id % 4 = 0 THEN 'OTHER' ELSE upper(rede) END AS rede FROM f2_xref),
e AS (SELECT row_id AS entry, upper(rede) AS rede, chave_lida AS chave, matricula FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> ''),
a AS (SELECT DISTINCT row_id, lido, rede, unnest([lido, lpad(lido, CAST(greatest(14, length(lido)) AS INTEGER), '0'), ltrim(lido, '0'), CASE WHEN length(lido) >= 13 THEN lido[:12] END]) AS k FROM i),
b AS (SELECT DISTINCT entry, rede, chave, matricula, unnest([chave, lpad(chave, 14, '0'), ltrim(chave, '0'), CASE WHEN length(chave) >= 13 THEN chave[:12] END]) AS k FROM e),
m AS (SELECT a.row_id, entry, matricula, a.rede = b.rede AS own, CASE WHEN lido = chave THEN 1000 WHEN length(k) >= 14 THEN 800 WHEN length(k) = 13 THEN 700 WHEN length(k) = 12 THEN 300 ELSE 100 END AS q FROM a JOIN b USING (k) WHERE k <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY own DESC, q DESC, entry) AS r, bool_or(own) OVER (PARTITION BY row_id) AS any_own FROM m), c AS (SELECT row_id, count(DISTINCT matricula) AS n FROM m GROUP BY 1)
SELECT row_id, matricula AS achada, CAST(q AS BIGINT) AS qualidade FROM o JOIN c USING (row_id) WHERE r = 1 AND (any_own OR n = 1)""")
over("agg_12_resolve_conflicts", lambda g, x: resolve.resolve_conflicts(g.join(x.select("row_id", "rede"), "row_id"), {"BUILD": 10, "MACH": 3, "AUTO": 1}), "f3_gln f2_xref", """WITH e AS (SELECT g.*, rede, CASE WHEN contains(upper(rede), 'BUILD') THEN 10 WHEN contains(upper(rede), 'MACH') THEN 3 WHEN contains(upper(rede), 'AUTO') THEN 1 ELSE 0 END AS s FROM f3_gln g JOIN f2_xref USING (row_id)),
c AS (SELECT cnpj, matricula AS escolhida FROM (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY s DESC, row_id DESC) AS n FROM e) WHERE n = 1)
SELECT c.cnpj, escolhida, coalesce(string_agg(DISTINCT matricula, '|' ORDER BY matricula) FILTER (matricula <> escolhida), '') AS descartadas FROM c JOIN e USING (cnpj) GROUP BY 1, 2""")
over("j_13_resolve_divergence", lambda x, g: resolve.resolve_with_divergence(x.select("row_id", F.col("cnpj_oficial").alias("chave")), resolve.cnpj_index(g).filter("matricula <> ''"), resolve.load_xref(x).select(F.col("chave"), "matricula")), "f2_xref f3_gln", """WITH b AS (SELECT cnpj AS chave, min(matricula) AS b FROM f3_gln GROUP BY 1 HAVING count(DISTINCT matricula) = 1), f AS (SELECT chave_lida AS chave, matricula AS f FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> '')
SELECT x.row_id, x.cnpj_oficial AS chave, coalesce(b, f, '') AS matricula, CASE WHEN b <> f THEN 'DIVERGENTE' WHEN b IS NOT NULL THEN 'BASE' WHEN f IS NOT NULL THEN 'RESERVA' ELSE 'NENHUMA' END AS origem FROM f2_xref x LEFT JOIN b ON b.chave = x.cnpj_oficial LEFT JOIN f ON f.chave = x.cnpj_oficial""")
over("j_22_overlay_map", lambda x, g: resolve.overlay_map(x.select(F.col("row_id").alias("chave"), F.col("matricula").alias("valor")), g.select(F.col("row_id").alias("chave"), F.col("gln").alias("valor"))), "f2_xref f3_gln", "SELECT x.row_id AS chave, coalesce(gln, x.matricula) AS valor FROM f2_xref x LEFT JOIN f3_gln g USING (row_id)")
over("flt_06_first_reason", queue.first_reason, "f1_queue", "SELECT row_id, CASE WHEN sku = '' THEN 'SKU_VAZIO' WHEN qtd = '' THEN 'QTD_VAZIA' WHEN matricula = '' THEN 'MATRICULA_NAO_ENCONTRADA' WHEN pedido = '' THEN 'PEDIDO_VAZIO' WHEN data_remessa = '' THEN 'DATA_INVALIDA' ELSE '' END AS motivo FROM f1_queue")
over("agg_06_pending_keys", queue.pending_keys, "f1_queue", _JUDGED + " SELECT matricula, CASE WHEN length(matricula) = 14 THEN 'CNPJ' WHEN length(matricula) = 13 THEN 'GLN' WHEN length(matricula) BETWEEN 7 AND 12 THEN 'COD_CLIENTE' WHEN length(matricula) BETWEEN 1 AND 6 THEN 'COD_LOJA' ELSE 'CHAVE' END AS tipo, string_agg(DISTINCT pedido_norm, ', ' ORDER BY pedido_norm) AS pedidos FROM j WHERE status <> '' GROUP BY 1, 2")
over("srt_04_issue_samples", lambda q: queue.issue_samples(q).withColumn("n", F.col("n").cast("long")), "f1_queue", _JUDGED + ", m AS (SELECT row_id, unnest(string_split(status, ' | ')) AS motivo FROM j WHERE status <> '') SELECT row_id, motivo, n FROM (SELECT *, row_number() OVER (PARTITION BY motivo ORDER BY row_id) AS n FROM m) WHERE n <= 10")
over("flt_16_lot_queue", lots.lot_queue, "f9_history", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY push, pedido) AS n, min(row_id) OVER (PARTITION BY push, pedido) AS f FROM f9_history) SELECT row_id, pedido, CASE WHEN n > 1 THEN concat('PEDIDO_DUPLICADO | linhas=', n) ELSE '' END AS alerta FROM n WHERE n = 1 OR row_id = f")
over("dat_01_ship_date", _ship_days, "f1_queue", """WITH x AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN CAST((row_id % 7 + 7 - 2) % 7 AS INT) + 1 END AS ahead, row_id % 3 AS k, try_strptime(replace(data_remessa, '.', '/'), '%d/%m/%Y')::DATE AS d FROM f1_queue),
y AS (SELECT row_id, CASE WHEN k = 0 THEN DATE '2026-03-18' WHEN k = 1 AND ahead IS NOT NULL THEN DATE '2026-03-17' + ahead WHEN k = 1 THEN d END AS d FROM x)
SELECT row_id, strftime(CASE WHEN isodow(d) = 7 THEN d + 1 ELSE d END, '%d.%m.%Y') AS data FROM y""")
over("dat_04_stamps", lambda q: q.select("row_id", S.stamp(S.day(F.col("data_remessa"))).alias("carimbo")), "f1_queue", "SELECT row_id, coalesce(strftime(try_strptime(replace(data_remessa, '.', '/'), '%d/%m/%Y'), '%Y%m%d0000'), '000000000000') AS carimbo FROM f1_queue")
over("str_03_folded_names", lambda m: m.select("row_id", S.folded(F.col("descricao")).alias("nome")), "f4_map", "SELECT row_id, trim(regexp_replace(upper(descricao), '[^A-Z0-9]+', ' ', 'g')) AS nome FROM f4_map")
over("arr_07_key_types", lambda x: x.select("row_id", S.key_type(F.col("chave_lida")).alias("tipo")), "f2_xref", "SELECT row_id, CASE length(chave_lida) WHEN 14 THEN 'CNPJ' WHEN 13 THEN 'GLN' ELSE 'CHAVE' END AS tipo FROM f2_xref")
over("win_06_item_section", lambda x: lines.item_section(x).select("file", "line_no", "line"), "f6_lines", "WITH x AS (SELECT *, last_value(CASE WHEN line LIKE 'PEDIDO DE COMPRAS %' THEN 1 WHEN line LIKE 'TOTAIS %' THEN 0 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no) AS a FROM f6_lines) SELECT file, line_no, line FROM x WHERE a = 1 AND line NOT LIKE 'PEDIDO DE COMPRAS %'")
over("win_04_following_total", lines.with_following_total, "f6_lines", "WITH x AS (SELECT *, first_value(CASE WHEN line LIKE 'PEDIDO DE COMPRAS %' OR line LIKE 'TOTAIS %' THEN line END IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS n FROM f6_lines) SELECT file, line_no, regexp_extract(coalesce(n, ''), '^TOTAIS ([0-9]+),00$', 1) AS total FROM x WHERE line LIKE 'PEDIDO DE COMPRAS %'")
over("ex_07_matrix_items", sheets.matrix_items, "f7_cells", "WITH x AS (SELECT file, r, c, v, max(CASE WHEN r = 1 THEN v END) OVER (PARTITION BY file, sheet, c) AS store, max(CASE WHEN c = 1 THEN v END) OVER (PARTITION BY file, sheet, r) AS code FROM f7_cells) SELECT file, store AS matricula, code AS sku, TRY_CAST(v AS BIGINT) AS qtd FROM x WHERE r >= 3 AND c > 1 AND store <> '' AND code <> '' AND TRY_CAST(v AS BIGINT) > 0")
over("win_08_visual_lines", sheets.line_texts, "f8_words", _PAGE + " SELECT file, page, linha, string_agg(text, ' ' ORDER BY x0) AS texto FROM v GROUP BY 1, 2, 3")
over("ex_14_items_by_position", lambda w: sheets.items_by_position(w, BANDS), "f8_words", _PAGE + " SELECT file, page, linha, string_agg(text, ' ' ORDER BY x0) FILTER (x0 < 100) AS sku, string_agg(text, ' ' ORDER BY x0) FILTER (x0 >= 100 AND x0 < 250) AS descricao, string_agg(text, ' ' ORDER BY x0) FILTER (x0 >= 250) AS qtd FROM v GROUP BY 1, 2, 3")
over("j_17_assign_nearest", lambda w: w.withColumn("alvo", sheets.nearest((F.col("x0") + F.col("x1")) / 2, CENTRES)).filter("alvo IS NOT NULL").select("file", "page", "top", "alvo"), "f8_words", "SELECT file, page, top, CASE WHEN (x0 + x1) / 2 <= 295 THEN 'L1' WHEN (x0 + x1) / 2 <= 306 THEN 'L2' ELSE 'L3' END AS alvo FROM f8_words WHERE (x0 + x1) / 2 BETWEEN 266 AND 336")
_QUERIES["src_01_document_lines"] = (
    lambda spark, sf_dir: documents.document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"),
    r"""WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(12))) AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(12))) + 1)) AS page FROM documents)
SELECT doc_id AS file, page, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no, unnest(string_split(t, chr(10))) AS line FROM p""",
)


for _more in ("catalog_scalars", "catalog_orders", "catalog_documents", "catalog_reports", "catalog_lots", "catalog_layouts", "catalog_conversion", "catalog_positions"):
    importlib.import_module(f".{_more}", __package__)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["pipe_03_item_records"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
