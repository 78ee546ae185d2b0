"""Queries of identity, customers, order files and standardisation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import texts as X
from .operators import customers, identity, queue, resolve
from .operators.identity import Layout
from .plans import interchange, standardize
from .registry import TODAY, over

LAYOUT = Layout("REDE TESTE DOIS", trusted=("REDE UM",))
NOW = "2026-03-17 09:05:00"

_NUM = r"CASE WHEN regexp_matches(quantidade_lida, '[A-Za-z$%]') THEN NULL WHEN regexp_full_match(quantidade_lida, '[0-9]{1,3}(\.[0-9]{3})+') THEN TRY_CAST(replace(quantidade_lida, '.', '') AS DECIMAL(30,8)) ELSE TRY_CAST(replace(quantidade_lida, ',', '.') AS DECIMAL(30,8)) END"
_IDENTITY = rf"""WITH a AS (SELECT *, sku_lido AS s, ean_lido AS e, numero_pedido_lido AS raw, regexp_replace(numero_pedido_lido, '[^0-9]', '', 'g') AS p, {_NUM} AS n, translate(upper(layout_usado), 'Ú', 'U') LIKE '%REDE UM%' AS own,
  alerta_extracao AS al, quantidade_lida AS q, codigo_loja_lido AS loja FROM f12_items),
b AS (SELECT *, own AND al LIKE 'RASTREABILIDADE_LAYOUT%' AS tracked, own AND (al = '' OR al LIKE 'RASTREABILIDADE_LAYOUT%') AS noted, e = '' AND length(s) IN (8, 12, 13, 14) AS moved FROM a),
r AS (SELECT *, list_filter([CASE WHEN moved AND length(s) >= 12 THEN 'SKU_LIDO_PARECE_EAN' END, CASE WHEN p IN ('', '0') THEN 'PEDIDO_VAZIO_OU_NAO_LOCALIZADO' END, CASE WHEN p NOT IN ('', '0') AND length(p) NOT BETWEEN 3 AND 20 THEN concat('PEDIDO_COM_TAMANHO_ATIPICO: ', p) END,
  CASE WHEN p <> '' AND p = cnpj_lido THEN 'PEDIDO_PARECE_CNPJ' END, CASE WHEN p <> '' AND p = e THEN 'PEDIDO_PARECE_EAN' END, CASE WHEN p <> '' AND p = s AND length(s) >= 5 THEN 'PEDIDO_PARECE_SKU' END,
  CASE WHEN cnpj_lido <> '' AND length(cnpj_lido) <> 14 THEN concat('CNPJ_COM_TAMANHO_INVALIDO: ', cnpj_lido) WHEN cnpj_lido = '' AND gln_lido = '' AND loja = '' AND matricula_lida = '' THEN 'CHAVE_CLIENTE_NAO_LOCALIZADA' END,
  CASE WHEN s = '' AND e = '' THEN 'SKU_EAN_NAO_LOCALIZADO' END, CASE WHEN NOT own AND length(s) IN (13, 14) AND e = '' THEN 'SKU_COM_TAMANHO_DE_EAN' END, CASE WHEN NOT own AND e <> '' AND length(e) NOT IN (8, 12, 13, 14) THEN concat('EAN_COM_TAMANHO_ATIPICO: ', e) END,
  CASE WHEN q = '' THEN 'QTD_VAZIA' WHEN n IS NULL THEN concat('QTD_NAO_NUMERICA: ', q) WHEN n <= 0 THEN concat('QTD_ZERO_OU_NEGATIVA: ', q) WHEN NOT own AND regexp_full_match(q, '[0-9]{{1,4}},[0-9]{{3,6}}') THEN concat('QTD_PARECE_PRECO_CUSTO: ', q) END,
  CASE WHEN status_extracao <> '' AND NOT noted THEN concat('STATUS_EXTRACAO_REQUER_VALIDACAO: ', status_extracao) END, CASE WHEN al <> '' AND NOT tracked AND NOT noted THEN al END, 'LAYOUT_EM_HOMOLOGACAO_OU_TESTE: REDE TESTE DOIS'], lambda v: v IS NOT NULL) AS why FROM b),
i AS (SELECT *, array_to_string(why, ' | ') AS alerta, own AND length(cnpj_lido) = 14 AND (s <> '' OR e <> '') AND length(p) >= 3 AND coalesce(n > 0, false)
  AND NOT regexp_matches(concat(al, ' ', array_to_string(why, ' | ')), 'SKU_EAN_NAO_LOCALIZADO|SKU_VAZIO|QTD_VAZIA|QTD_NAO_NUMERICA|QTD_ZERO_OU_NEGATIVA|PEDIDO_VAZIO|PEDIDO_AUSENTE|CNPJ_COM_TAMANHO_INVALIDO|CHAVE_CLIENTE_NAO_LOCALIZADA|ERRO|QTD_PARECE_PRECO_CUSTO') AS pronta,
  CASE WHEN n > 0 THEN replace(rtrim(rtrim(CAST(CAST(n AS DECIMAL(30,8)) AS VARCHAR), '0'), '.'), '.', ',') ELSE q END AS qtd, CASE WHEN moved THEN s ELSE e END AS ean FROM r),
j AS (SELECT *, CASE WHEN pronta THEN 'OK' ELSE 'VALIDAR' END AS status_identidade, CASE WHEN pronta THEN 'OK' ELSE string_split(why[1], ':')[1] END AS motivo_identidade, CASE WHEN pronta THEN '' ELSE alerta END AS alerta_identidade FROM i)"""
# The layout's own name holds TESTE, so every row is doubted and only complete rows of the trusted layout are released.
over("flt_21_check_identity", lambda x: identity.check_identity(x, LAYOUT).select("row_id", F.col("ean_lido").alias("ean"), F.col("quantidade_lida").alias("qtd"), "status_identidade", "motivo_identidade", "alerta_identidade"), "f12_items", _IDENTITY + " SELECT row_id, ean, qtd, status_identidade, motivo_identidade, alerta_identidade FROM j")
_PLAIN = Layout("REDE DOIS", trusted=("REDE UM",))
over("flt_21_identity_of_a_plain_layout", lambda x: identity.check_identity(x, _PLAIN).groupBy("motivo_identidade").agg(F.count(F.lit(1)).alias("linhas")), "f12_items", _IDENTITY.replace(", 'LAYOUT_EM_HOMOLOGACAO_OU_TESTE: REDE TESTE DOIS'], lambda", "], lambda") + " SELECT CASE WHEN pronta OR len(why) = 0 THEN 'OK' ELSE string_split(why[1], ':')[1] END AS motivo_identidade, count(*) AS linhas FROM j GROUP BY 1")
over("flt_07_conversion_blocks", lambda x: x.select("row_id", identity.conversion_blocks(F.col("status_conversao")).alias("bloqueia")), "f12_items", "SELECT row_id, status_conversao NOT IN ('', 'OK CONVERTIDO', 'OK SEM CONVERSÃO') AS bloqueia FROM f12_items")
over("flt_08_identity_blocks", lambda x: identity.check_identity(x, LAYOUT).select("row_id", identity.identity_blocks(identity.check_identity(x, LAYOUT), LAYOUT).alias("bloqueia")), "f12_items", _IDENTITY + """ SELECT row_id, status_identidade = 'VALIDAR' AND NOT (own AND concat(al, ' ', alerta) LIKE '%RASTREABILIDADE_LAYOUT%'
  AND NOT regexp_matches(concat(al, ' ', alerta), 'SKU_EAN_NAO_LOCALIZADO|SKU_VAZIO|QTD_VAZIA|QTD_NAO_NUMERICA|QTD_ZERO_OU_NEGATIVA|PEDIDO_VAZIO|PEDIDO_AUSENTE|CNPJ_COM_TAMANHO_INVALIDO|CHAVE_CLIENTE_NAO_LOCALIZADA|LAYOUT_EM_HOMOLOGACAO|STATUS_EXTRACAO_REQUER_VALIDACAO')) AS bloqueia FROM j""")
over("flt_09_releasable", lambda x: x.select("row_id", identity.releasable(x, _PLAIN, F.lit("")).alias("pronta")), "f12_items", f"SELECT row_id, translate(upper(layout_usado), 'Ú', 'U') LIKE '%REDE UM%' AND length(cnpj_lido) = 14 AND (sku_lido <> '' OR ean_lido <> '') AND length(regexp_replace(numero_pedido_lido, '[^0-9]', '', 'g')) >= 3 AND coalesce({_NUM} > 0, false) AND alerta_extracao NOT LIKE '%ERRO%' AS pronta FROM f12_items")
over("flt_19_unsafe_and_audit", lambda x: x.select("row_id", identity.unsafe_status(F.col("status_extracao")).alias("inseguro"), identity.audit_only(F.col("alerta_extracao")).alias("auditoria")), "f12_items", "SELECT row_id, status_extracao <> '' AS inseguro, alerta_extracao NOT LIKE 'ERRO%' AS auditoria FROM f12_items")
over("flt_22_conversion_status", lambda x: x.select("row_id", identity.conversion_status(F.col("status_conversao"), F.col("status_conversao"), F.col("alerta_extracao")).alias("status")), "f12_items", "SELECT row_id, CASE status_conversao WHEN 'VALIDAR CONVERSAO' THEN 'VALIDAR CONVERSÃO' WHEN 'OK CONVERTIDO' THEN 'OK CONVERTIDO' WHEN 'ALERTA - NÃO CONVERTIDO' THEN 'ALERTA - NÃO CONVERTIDO' WHEN 'outro NAO_CONVERTIDO' THEN 'ALERTA - NÃO CONVERTIDO' ELSE 'OK SEM CONVERSÃO' END AS status FROM f12_items")
over("flt_30_trusted_rows", lambda x: x.select("row_id", identity.is_trusted(("REDE UM", "REDE SEIS"), F.col("layout_usado"), F.col("alerta_extracao")).alias("confiavel")), "f12_items", "SELECT row_id, translate(upper(layout_usado), 'Ú', 'U') LIKE '%REDE UM%' AS confiavel FROM f12_items")
over("flt_12_not_supplier", lambda x: x.select("row_id", identity.not_supplier(F.col("cnpj_lido"), ("0000000100", "123")).alias("cliente")), "f12_items", "SELECT row_id, cnpj_lido NOT LIKE '0000000100%' AND cnpj_lido NOT LIKE '123%' AS cliente FROM f12_items")
over("flt_13_denied_skus", lambda x: identity.deny_skus(x, ("100001", "100002", "100007"))[1].select("row_id", "sku_lido"), "f12_items", "SELECT row_id, sku_lido FROM f12_items WHERE sku_lido IN ('100001', '100002', '100007')")
over("flt_01_drop_blank_rows", lambda x: identity.drop_blank_rows(x, ("gln_lido", "codigo_loja_lido", "matricula_lida", "ean_lido", "status_extracao")).select("row_id"), "f12_items", "SELECT row_id FROM f12_items WHERE concat(gln_lido, codigo_loja_lido, matricula_lida, ean_lido, status_extracao) <> ''")
over("flt_14_noise_and_candidates", lambda x: x.select("file", "line_no", identity.is_noise(F.col("line"), ("CNPJ", "TOTAIS"), ("QUEBRADA",)).alias("ruido"), identity.is_candidate(F.col("line")).alias("item")), "f6_lines", r"SELECT file, line_no, line LIKE 'CNPJ%' OR line LIKE 'TOTAIS%' OR line LIKE '%QUEBRADA%' AS ruido, regexp_matches(line, '\b[0-9]{5,14}\b.*\b[0-9]+') AS item FROM f6_lines")
over("flt_18_alert_rows", lambda x: identity.alerts_to_rows(x.select("row_id", F.col("phrase").alias("alerta"))).select("row_id", "pagina", "linha_bruta", "status_extracao"), "f11_values", "SELECT row_id, regexp_extract(phrase, 'P.gina ([0-9]+)', 1) AS pagina, CASE WHEN contains(phrase, '|') THEN trim(phrase[instr(phrase, '|') + 1:]) ELSE '' END AS linha_bruta, 'ALERTA_LEITURA' AS status_extracao FROM f11_values WHERE phrase LIKE 'Página%'")

_VARIANTS = "list_filter([{0}, CASE WHEN length({0}) > 6 AND length(ltrim({0}, '0')) >= 6 THEN ltrim({0}, '0') END, CASE WHEN length({0}) BETWEEN 8 AND 14 THEN lpad({0}, 14, '0') END, CASE WHEN length({0}) BETWEEN 8 AND 13 THEN lpad({0}, 13, '0') END, CASE WHEN length({0}) >= 13 THEN {0}[1:12] END], lambda v: v IS NOT NULL AND v <> '')"
_V = _VARIANTS.format
#: Keys are digits here, and networks of items are REDE DOIS, which no entry's is; MACHINERY entries get a blank network.
_XREF = f"""x AS (SELECT row_id, CASE WHEN rede = 'MACHINERY' THEN '' ELSE rede END AS rede, chave_lida, cnpj_oficial, matricula FROM f2_xref),
ka AS (SELECT DISTINCT row_id, exact, unnest(list_concat({_V('c')}, list_concat({_V('g')}, {_V('l')}))) AS k FROM (SELECT row_id, cnpj_lido AS c, gln_lido AS g, regexp_replace(codigo_loja_lido, '[^0-9]', '', 'g') AS l, list_filter([cnpj_lido, gln_lido, regexp_replace(codigo_loja_lido, '[^0-9]', '', 'g')], lambda v: v <> '') AS exact FROM f12_items)),
kb AS (SELECT DISTINCT row_id AS entry, rede, chave_lida, cnpj_oficial, matricula, [chave_lida, cnpj_oficial] AS own, unnest(list_concat({_V('chave_lida')}, list_concat({_V('cnpj_oficial')}, {_V('matricula')}))) AS k FROM x),
mt AS (SELECT ka.row_id, entry, chave_lida, cnpj_oficial, matricula, k, CASE WHEN rede = '' THEN 1 ELSE 0 END AS s, CASE WHEN len(list_intersect(exact, own)) > 0 THEN 1000 WHEN list_contains(exact, k) AND length(k) >= 8 THEN 900 WHEN list_contains(own, k) AND length(k) >= 8 THEN 850
  WHEN length(k) >= 14 THEN 800 WHEN length(k) = 13 THEN 700 WHEN length(k) = 12 THEN 300 ELSE 100 END AS q FROM ka JOIN kb USING (k)),
bx AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, q DESC, entry, k DESC) AS o, max(s) OVER (PARTITION BY row_id) AS near FROM mt),
dx AS (SELECT row_id, count(DISTINCT (chave_lida, cnpj_oficial, matricula)) AS n FROM mt GROUP BY 1), found AS (SELECT bx.* FROM bx JOIN dx USING (row_id) WHERE o = 1 AND (near > 0 OR n = 1))"""


def _entries(x: DataFrame) -> DataFrame:
    return x.withColumn("rede", F.when(F.col("rede") == "MACHINERY", "").otherwise(F.col("rede")))


over("j_03_xref_search", lambda i, x: customers.xref_search(i.select("row_id", F.lit("REDE DOIS").alias("rede"), customers.client_keys(i).alias("chaves")), _entries(x)), "f12_items f2_xref", f"WITH {_XREF} SELECT row_id, matricula, cnpj_oficial, k AS chave_match, CAST(q AS BIGINT) AS qualidade, CAST(s AS BIGINT) AS nivel FROM found")
_CASCADE = f"""WITH {_XREF}, g AS (SELECT cnpj, min(matricula) AS m FROM f3_gln GROUP BY 1 HAVING count(DISTINCT matricula) = 1), c AS (SELECT i.*, nullif(f.matricula, '') AS xm, f.cnpj_oficial AS xo, nullif(g.m, '') AS gm FROM f12_items i LEFT JOIN found f USING (row_id) LEFT JOIN g ON g.cnpj = i.cnpj_lido),
res AS (SELECT *, {{}} AS matricula_final, {{}} AS status_depara_cliente FROM c), fin AS (SELECT *, CASE WHEN status_depara_cliente = 'DEPARA_CLIENTES' AND xo <> '' THEN xo ELSE cnpj_lido END AS cnpj_oficial_final FROM res)"""
_BASE_FIRST = _CASCADE.format("coalesce(gm, xm, matricula_lida)", "CASE WHEN gm IS NOT NULL THEN 'BASE_GLNS_CNPJ' WHEN xm IS NOT NULL THEN 'DEPARA_CLIENTES' WHEN matricula_lida <> '' THEN 'MATRICULA_LIDA_LAYOUT' ELSE 'A_CADASTRAR' END")
_XREF_FIRST = _CASCADE.format("coalesce(xm, gm, matricula_lida)", "CASE WHEN xm IS NOT NULL THEN 'DEPARA_CLIENTES' WHEN gm IS NOT NULL THEN 'BASE_GLNS_CNPJ' WHEN matricula_lida <> '' THEN 'MATRICULA_LIDA_LAYOUT' ELSE 'A_CADASTRAR' END")
_THREE = ("row_id", "matricula_final", "cnpj_oficial_final", "status_depara_cliente")
over("j_04_resolve_customer", lambda i, g, x: customers.resolve_customer(i, _PLAIN, g, _entries(x)).select(*_THREE), "f12_items f3_gln f2_xref", _BASE_FIRST + f" SELECT {', '.join(_THREE)} FROM fin")
over("j_04_network_first", lambda i, g, x: customers.resolve_customer(i, Layout("REDE DOIS", network_first=True), g, _entries(x)).select(*_THREE), "f12_items f3_gln f2_xref", _XREF_FIRST + f" SELECT {', '.join(_THREE)} FROM fin")
over("j_04_direct_numbers", lambda i, g, x: customers.resolve_customer(i, Layout("REDE DOIS", client="MATRICULA"), g, x).select(*_THREE), "f12_items f3_gln f2_xref", "SELECT row_id, matricula_lida AS matricula_final, cnpj_lido AS cnpj_oficial_final, CASE WHEN matricula_lida <> '' THEN 'MATRICULA_DIRETA' ELSE 'MATRICULA_VAZIA' END AS status_depara_cliente FROM f12_items")
_FINAL = _BASE_FIRST.replace("WITH ", _IDENTITY + ", ", 1) + r""", z AS (SELECT fin.row_id, fin.matricula_final, fin.sku_lido, j.qtd, fin.numero_pedido_lido AS pedido, fin.status_conversao, j.status_identidade, j.motivo_identidade, j.own, DATE '2026-03-18' AS d, fin.cnpj_lido, concat(j.al, ' ', j.alerta_identidade) AS said FROM fin JOIN j USING (row_id)),
l AS (SELECT *, own AND matricula_final <> '' AND sku_lido <> '' AND qtd <> '' AND pedido <> '' AND length(cnpj_lido) = 14 AND NOT regexp_matches(concat(said, ' ', motivo_identidade, ' ', status_conversao), 'SKU_EAN_NAO_LOCALIZADO|QTD_VAZIA|QTD_NAO_NUMERICA|QTD_ZERO_OU_NEGATIVA|PEDIDO_VAZIO|CNPJ_COM_TAMANHO_INVALIDO|CHAVE_CLIENTE_NAO_LOCALIZADA|QTD_PARECE_PRECO_CUSTO|NAO CONVERTIDO|NÃO CONVERTIDO|VALIDAR CONVERS') AS solta FROM z),
w AS (SELECT *, CASE WHEN NOT solta AND status_identidade <> 'OK' THEN motivo_identidade WHEN sku_lido = '' THEN 'SKU_VAZIO' WHEN qtd = '' THEN 'QTD_VAZIA' WHEN matricula_final = '' THEN 'MATRICULA_NAO_ENCONTRADA' WHEN pedido = '' THEN 'PEDIDO_VAZIO' WHEN status_conversao NOT IN ('', 'OK CONVERTIDO', 'OK - SEM CONVERSÃO') THEN 'CONVERSAO_PENDENTE_VALIDACAO' ELSE '' END AS motivo FROM l)"""
_FINAL = _FINAL.replace(", 'LAYOUT_EM_HOMOLOGACAO_OU_TESTE: REDE TESTE DOIS'], lambda", "], lambda").replace("CASE WHEN pronta THEN 'OK'", "CASE WHEN pronta OR len(why) = 0 THEN 'OK'")


def _standardized(i: DataFrame, g: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame]:
    return standardize.standardize_orders(i, _PLAIN, g, _entries(x), TODAY)


over("pipe_01_standardize_orders", lambda i, g, x: standardize.queue_rows(_standardized(i, g, x)[0]), "f12_items f3_gln f2_xref", _FINAL + " SELECT row_id, matricula_final AS matricula, sku_lido AS sku, qtd, pedido, '18.03.2026' AS data_remessa FROM w WHERE motivo = ''")
over("flt_06_validate_business", lambda i, g, x: _standardized(i, g, x)[1].select("row_id", "motivo_descarte"), "f12_items f3_gln f2_xref", _FINAL + " SELECT row_id, motivo AS motivo_descarte FROM w WHERE motivo <> ''")
over("agg_09_discard_counts", lambda i, g, x: _standardized(i, g, x)[1].groupBy("motivo_descarte").agg(F.count(F.lit(1)).alias("linhas")), "f12_items f3_gln f2_xref", _FINAL + " SELECT motivo AS motivo_descarte, count(*) AS linhas FROM w WHERE motivo <> '' GROUP BY 1")

over("j_05_override_and_maps", lambda m: resolve_maps(m), "f4_map", """WITH o AS (SELECT ean, arg_min(concat('9', sku), row_id) AS s FROM f4_map WHERE apresentacao = 24 GROUP BY 1), a AS (SELECT ean, arg_min(sku, row_id) AS s FROM f4_map WHERE apresentacao = 6 GROUP BY 1), b AS (SELECT ean, arg_min(concat('B', sku), row_id) AS s FROM f4_map WHERE apresentacao > 0 GROUP BY 1)
SELECT m.row_id, coalesce(o.s, a.s, b.s, '') AS sku, CASE WHEN o.s IS NOT NULL THEN 0 WHEN a.s IS NOT NULL THEN 1 WHEN b.s IS NOT NULL THEN 2 ELSE -1 END AS origem FROM f4_map m LEFT JOIN o USING (ean) LEFT JOIN a USING (ean) LEFT JOIN b USING (ean)""")


def resolve_maps(m: DataFrame) -> DataFrame:
    own = m.filter("apresentacao = 24").select("row_id", "ean", F.concat(F.lit("9"), "sku").alias("sku"))
    second = m.filter("apresentacao > 0").select("row_id", "ean", F.concat(F.lit("B"), "sku").alias("sku"))
    return customers.resolve_ean_maps(m.select("row_id", "ean"), own, m.filter("apresentacao = 6"), second).select("row_id", "sku", "origem")


over("j_06_priority_base", lambda m: customers.priority_base(m.select("row_id", F.when(F.col("row_id") % 3 == 0, F.expr("right(ean, 8)")).when(F.col("row_id") % 3 == 1, F.concat(F.lit("00"), "ean")).otherwise(F.col("ean")).alias("ean")), m), "f4_map", "SELECT m.row_id, f.sku, CAST(f.apresentacao AS BIGINT) AS fator FROM f4_map m JOIN (SELECT ean, arg_min(sku, row_id) AS sku, arg_min(apresentacao, row_id) AS apresentacao FROM f4_map GROUP BY 1) f USING (ean)")
over("j_09_ship_date_tiers", lambda i, s: customers.attach_ship_date_tiers(i.select("row_id", F.expr("CAST(row_id % 700 AS STRING)").alias("matricula"), F.expr("CAST(row_id % 61 AS STRING)").alias("pedido"), "regional"), s), "f12_items f10_ship", """WITH i AS (SELECT row_id, CAST(row_id % 700 AS VARCHAR) AS matricula, CAST(row_id % 61 AS VARCHAR) AS pedido, regional FROM f12_items), s AS (SELECT * FROM f10_ship WHERE data_remessa <> ''),
a AS (SELECT matricula, pedido, arg_min(data_remessa, row_id) AS d1 FROM s GROUP BY ALL), b AS (SELECT matricula, arg_min(data_remessa, row_id) AS d2 FROM s GROUP BY 1 HAVING count(DISTINCT pedido) = 1), c AS (SELECT matricula, regional, arg_min(data_remessa, row_id) AS d3 FROM s GROUP BY ALL)
SELECT row_id, coalesce(d1, d2, d3, '') AS data, CASE WHEN d1 IS NOT NULL THEN '' WHEN d2 IS NOT NULL THEN 'DATA_POR_MATRICULA' WHEN d3 IS NOT NULL THEN 'DATA_POR_REGIONAL' ELSE 'SEM_DATA_REMESSA' END AS alerta FROM i LEFT JOIN a USING (matricula, pedido) LEFT JOIN b USING (matricula) LEFT JOIN c USING (matricula, regional)""")
over("j_10_date_map", lambda i, s: customers.attach_date_map(i.select("row_id", F.expr("CAST(row_id % 700 AS STRING)").alias("matricula")), s.select("row_id", F.expr("CAST(pedido AS INT) % 3").alias("ordem"), "matricula", F.col("data_remessa").alias("data"))).drop("matricula"), "f12_items f10_ship", "SELECT i.row_id, coalesce(d, '') AS data_remessa FROM f12_items i LEFT JOIN (SELECT matricula, arg_max(data_remessa, (CAST(pedido AS INT) % 3, row_id)) AS d FROM f10_ship WHERE data_remessa <> '' GROUP BY 1) s ON s.matricula = CAST(i.row_id % 700 AS VARCHAR)")
over("j_11_resolve_store", lambda g: customers.resolve_store(g.select("row_id", F.when(F.col("row_id") % 2 == 0, F.col("matricula")).when(F.col("row_id") % 5 == 0, F.lit("77777777777777")).otherwise(F.expr("substring(cnpj, 2, 13)")).alias("identificador")), g).drop("identificador"), "f3_gln", "WITH m AS (SELECT cnpj, arg_min(matricula, row_id) AS m FROM f3_gln GROUP BY 1) SELECT g.row_id, CASE WHEN row_id % 2 = 0 THEN g.cnpj WHEN row_id % 5 = 0 THEN '77777777777777' ELSE g.cnpj END AS cnpj, CASE WHEN row_id % 2 = 0 THEN g.matricula WHEN row_id % 5 = 0 THEN '' ELSE m.m END AS matricula FROM f3_gln g JOIN m USING (cnpj)")
over("j_12_attach_store", lambda i, g: customers.attach_store(i.select("row_id", F.expr("CAST(row_id % 97 AS STRING)").alias("loja")), g.select("row_id", F.expr("CAST(row_id % 60 AS STRING)").alias("loja"), "cnpj", F.col("gln").alias("nome"))).drop("loja"), "f12_items f3_gln", "SELECT i.row_id, coalesce(c, '') AS cnpj_loja, coalesce(n, '') AS nome_loja FROM f12_items i LEFT JOIN (SELECT CAST(row_id % 60 AS VARCHAR) AS loja, arg_min(cnpj, row_id) AS c, arg_min(gln, row_id) AS n FROM f3_gln GROUP BY 1) s ON s.loja = CAST(i.row_id % 97 AS VARCHAR)")
over("snk_07_upsert_counts", lambda x, g: customers.upsert_counts(resolve.load_xref(x), g.select(F.lit("BUILDING").alias("rede"), F.col("cnpj").alias("chave"), F.concat(F.lit("7120"), F.lpad("matricula", 6, "0")).alias("matricula"))), "f2_xref f3_gln", "WITH o AS (SELECT DISTINCT upper(rede) AS rede, chave_lida AS chave, matricula FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> ''), n AS (SELECT DISTINCT 'BUILDING' AS rede, cnpj AS chave, concat('7120', lpad(matricula, 6, '0')) AS matricula FROM f3_gln) SELECT count(*) FILTER (o.rede IS NULL) AS novas, count(o.rede) AS atualizadas FROM n LEFT JOIN o USING (rede, chave, matricula)")
over("snk_08_import_pendencies", lambda x, g: customers.import_pendencies(resolve.load_xref(x), g.select("row_id", F.lit("building").alias("rede"), F.col("cnpj").alias("chave"), F.when(F.col("row_id") % 7 == 0, "").otherwise(F.col("matricula")).alias("matricula"), F.when(F.col("row_id") % 3 == 0, "ok").otherwise("A CADASTRAR").alias("status"))), "f2_xref f3_gln", "WITH o AS (SELECT row_id, upper(rede) AS rede, chave_lida AS chave, matricula, 0 AS t FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> '' UNION ALL SELECT row_id, 'BUILDING', cnpj, matricula, 1 FROM f3_gln WHERE row_id % 7 <> 0 AND row_id % 3 <> 0) SELECT row_id, rede, chave, matricula FROM (SELECT *, row_number() OVER (PARTITION BY rede, chave, matricula ORDER BY t DESC, row_id DESC) AS n FROM o) WHERE n = 1")
over("srt_03_ordered_xref", lambda x: customers.ordered_xref(resolve.load_xref(x)).select("row_id", "tipo", "n"), "f2_xref", "SELECT row_id, CASE length(chave_lida) WHEN 14 THEN 'CNPJ' ELSE 'GLN' END AS tipo, row_number() OVER (PARTITION BY rede ORDER BY CASE length(chave_lida) WHEN 14 THEN 'CNPJ' ELSE 'GLN' END, chave_lida, matricula, row_id) AS n FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> ''")

_LINES = """, g AS (SELECT matricula, arg_max(gln, row_id) AS gln FROM f3_gln GROUP BY 1), o AS (SELECT k.*, gln, CASE WHEN pedido_norm = '.' THEN concat(k.matricula, '17032026') ELSE pedido_norm END AS pedido FROM k JOIN g USING (matricula)), s AS (SELECT *, row_number() OVER (PARTITION BY matricula, pedido ORDER BY row_id) AS seq FROM o)"""


def _with_judged(sql: str) -> str:
    from .catalog import CONSOLIDATED

    return CONSOLIDATED + _LINES + sql


over("snk_02_order_table", lambda q, g: interchange.order_table(interchange.order_lines(q, g, TODAY)[0]), "f1_queue f3_gln", _with_judged(" SELECT matricula, '.' AS descricao_sku, sku_norm AS sku, qtd, pedido, data_norm AS data, 'ORDEM VENDA' AS tipo_solicitacao, 'Boleto' AS forma_pagamento, lpad(gln, 14, '0') AS gln, concat(matricula, '_', pedido) AS arquivo FROM s"))
over("fxw_07_order_files", lambda q, g: interchange.order_files(interchange.order_lines(q, g, TODAY)[0], NOW), "f1_queue f3_gln", _with_judged("""
, h AS (SELECT matricula, pedido, arg_min(gln, seq) AS gln, arg_min(data_norm, seq) AS d FROM s GROUP BY 1, 2)
SELECT matricula, pedido, 1 AS ord, 0 AS seq, rpad(concat('01ORDERS', rpad(pedido, 20, ' '), repeat(' ', 8), '9  202603170905', strftime(strptime(d, '%d/%m/%Y'), '%Y%m%d0000'), '202603240905', repeat('0', 16), '001', repeat('0', 20), lpad(gln, 13, '0'), lpad(matricula, 15, '0'), '7898905730084', '006589791000121', repeat(concat(lpad(gln, 13, '0'), lpad(matricula, 15, '0')), 2)), 400, ' ') AS registro FROM h
UNION ALL SELECT matricula, pedido, 2, 0, rpad('0221530302026040100000000000012 00000000000000000021', 400, ' ') FROM h UNION ALL SELECT matricula, pedido, 3, 0, rpad(concat('03', repeat(' ', 17), 'CIF'), 400, ' ') FROM h UNION ALL SELECT matricula, pedido, 9, 0, rpad(concat('09', repeat('0', 80)), 400, ' ') FROM h
UNION ALL SELECT matricula, pedido, 4, seq, rpad(concat('04', lpad(CAST(seq AS VARCHAR), 6, '0'), lpad(sku_norm, 14, '0'), repeat(' ', 38), rpad('.', 35, ' '), lpad(CAST(qtd * 10000 AS VARCHAR), 17, '0'), repeat('0', 17), lpad(gln, 13, '0'), lpad(matricula, 15, '0'), repeat(' ', 6), repeat('0', 130)), 400, ' ') FROM s"""))
over("pipe_03_without_gln", lambda q, g: interchange.order_lines(q, g, TODAY)[1].select("row_id", "matricula", "pedido"), "f1_queue f3_gln", _with_judged(" SELECT row_id, matricula, CASE WHEN pedido_norm = '.' THEN concat(matricula, '17032026') ELSE pedido_norm END AS pedido FROM k WHERE matricula NOT IN (SELECT matricula FROM g)"))
