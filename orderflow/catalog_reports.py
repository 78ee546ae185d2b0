"""Queries of reports, approval and batches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog_orders import _V as _FORMS
from .operators import detection, queue, reports
from .operators.identity import Layout
from .plans import lot
from .registry import TODAY, over


def _rows(i: DataFrame) -> DataFrame:
    """Order lines as they are after standardisation: customers known for two thirds, reasons and notes for some."""
    n = F.col("row_id") % 11
    x = i.withColumns({
        "matricula_final": F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("712"), F.col("row_id") % 100)), "numero_pedido_final": F.col("numero_pedido_lido"), "motivo_descarte": F.when(n % 3 == 0, "MATRICULA_NAO_ENCONTRADA").when(n == 1, "QTD_VAZIA").otherwise(""),
        "status_depara_cliente": F.when(n % 3 == 0, "A_CADASTRAR").when(n == 2, "DEPARA_CLIENTES").otherwise("BASE_GLNS_CNPJ"), "observacao_conversao": F.when(n == 4, "fator 12").otherwise(""),
    })
    return reports.validation_rows(x)


_CONV = "CASE status_conversao WHEN 'VALIDAR CONVERSAO' THEN 'VALIDAR CONVERSÃO' WHEN 'OK CONVERTIDO' THEN 'OK CONVERTIDO' WHEN 'ALERTA - NÃO CONVERTIDO' THEN 'ALERTA - NÃO CONVERTIDO' WHEN 'outro NAO_CONVERTIDO' THEN 'ALERTA - NÃO CONVERTIDO' ELSE 'OK SEM CONVERSÃO' END"
_V = rf"""WITH a AS (SELECT row_id, row_id % 11 AS n, cnpj_lido AS cnpj, sku_lido AS sku, ean_lido AS ean, quantidade_lida AS qtd, numero_pedido_lido AS pedido, {_CONV} AS status_conversao FROM f12_items),
b AS (SELECT *, CASE WHEN n % 3 = 0 THEN '' ELSE concat('712', row_id % 100) END AS matricula, CASE WHEN n % 3 = 0 THEN 'MATRICULA_NAO_ENCONTRADA' WHEN n = 1 THEN 'QTD_VAZIA' ELSE '' END AS motivo_descarte, CASE WHEN n % 3 = 0 THEN 'A_CADASTRAR' WHEN n = 2 THEN 'DEPARA_CLIENTES' ELSE 'BASE_GLNS_CNPJ' END AS status_depara_cliente,
  CASE WHEN regexp_matches(qtd, '[A-Za-z]') THEN NULL WHEN regexp_full_match(qtd, '[0-9]{{1,3}}(\.[0-9]{{3}})+') THEN TRY_CAST(replace(qtd, '.', '') AS DECIMAL(30,8)) ELSE TRY_CAST(replace(qtd, ',', '.') AS DECIMAL(30,8)) END AS q, status_conversao NOT IN ('OK CONVERTIDO', 'OK SEM CONVERSÃO') AS cb FROM a),
c AS (SELECT *, coalesce(nullif(array_to_string(list_filter([CASE WHEN n = 4 THEN 'fator 12' END, CASE WHEN n % 3 = 0 AND cnpj <> '' THEN 'A CADASTRAR' END, CASE WHEN n % 3 = 0 THEN 'CADASTRAR CHAVE CLIENTE' WHEN n = 2 THEN 'DE/PARA CLIENTE OK' END, CASE WHEN n = 1 THEN 'QTD_VAZIA' END, CASE WHEN cb THEN status_conversao END], lambda x: x IS NOT NULL), ' | '), ''), 'OK') AS observacao FROM b),
v AS (SELECT *, array_to_string(list_filter([CASE WHEN cb THEN concat('Conversão pendente: ', status_conversao) END, CASE WHEN matricula = '' THEN 'Matrícula vazia/A cadastrar' END, CASE WHEN sku = '' THEN 'SKU vazio' END, CASE WHEN qtd = '' THEN 'Quantidade final vazia' WHEN q IS NULL THEN 'Quantidade final não numérica' WHEN q <= 0 THEN 'Quantidade zero/negativa' END, CASE WHEN pedido = '' THEN 'Pedido vazio' END,
  CASE WHEN n % 3 = 0 OR n = 1 OR cb THEN observacao END], lambda x: x IS NOT NULL), ' | ') AS motivo FROM c),
own AS (SELECT row_id, matricula, cnpj, sku, qtd, pedido, status_conversao FROM v WHERE motivo_descarte = ''), more AS (SELECT min(row_id) AS row_id, 'A CADASTRAR' AS matricula, cnpj, sku, qtd, pedido, arg_min(status_conversao, row_id) AS status_conversao FROM v WHERE n % 3 = 0 AND NOT cb AND cnpj <> '' AND sku <> '' AND pedido <> '' AND q > 0 AND NOT EXISTS (SELECT 1 FROM own o WHERE (o.cnpj, o.sku, o.qtd, o.pedido) = (v.cnpj, v.sku, v.qtd, v.pedido)) GROUP BY cnpj, sku, qtd, pedido),
model AS (SELECT * FROM own UNION ALL SELECT * FROM more), dup AS (SELECT pedido, matricula, sku, count(*) AS ocorrencias, sum(coalesce(q, 0)) AS t FROM v WHERE pedido <> '' AND matricula <> '' AND sku <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1),
f AS (SELECT count(*) AS validacao, count(*) FILTER (motivo <> '') AS bloqueadas, count(DISTINCT cnpj) FILTER (matricula = '') AS cadastrar, count(*) FILTER (observacao <> 'OK') AS alertas, count(*) FILTER (status_conversao = 'OK CONVERTIDO') AS cv, count(*) FILTER (status_conversao = 'ALERTA - NÃO CONVERTIDO') AS nc, count(*) FILTER (status_conversao = 'VALIDAR CONVERSÃO') AS va, (SELECT count(*) FROM model) AS modelo, (SELECT count(*) FROM dup) AS duplicidades FROM v)"""


def _model(i: DataFrame) -> DataFrame:
    x = _rows(i)
    return reports.model_table(x.filter("motivo_descarte = ''"), x.filter("motivo_descarte <> ''"))


over("flt_27_observations", lambda i: _rows(i).select("row_id", "observacao"), "f12_items", _V + " SELECT row_id, observacao FROM v")
over("flt_23_block_reasons", lambda i: _rows(i).select("row_id", reports.block_reason(_rows(i)).alias("motivo")), "f12_items", _V + " SELECT row_id, motivo FROM v")
over("agg_23_blocked_items", lambda i: reports.blocked_items(_rows(i)), "f12_items", _V + " SELECT row_id, 'BLOQUEADO - VALIDAR ANTES DA FILA/TXT' AS status, motivo, pedido, matricula, sku FROM v WHERE motivo <> ''")
over("agg_23_no_blocked_items", lambda i: reports.blocked_items(_rows(i).filter("observacao = 'nenhuma'")), "f12_items", "SELECT CAST(NULL AS BIGINT) AS row_id, 'OK' AS status, 'Nenhum item bloqueado para fila/TXT.' AS motivo, CAST(NULL AS VARCHAR) AS pedido, CAST(NULL AS VARCHAR) AS matricula, CAST(NULL AS VARCHAR) AS sku")
over("flt_20_displayable", lambda i: _rows(i).filter(reports.displayable(_rows(i))).select("row_id"), "f12_items", _V + " SELECT row_id FROM v WHERE n % 3 = 0 AND NOT cb AND cnpj <> '' AND sku <> '' AND pedido <> '' AND q > 0")
over("flt_28_model_rows", lambda i: reports.model_rows(_rows(i), "A CADASTRAR"), "f12_items", _V + " SELECT row_id, CASE WHEN matricula = '' THEN 'A CADASTRAR' ELSE matricula END AS matricula, cnpj, sku, qtd, pedido, status_conversao FROM v")
over("set_06_model_table", _model, "f12_items", _V + " SELECT * FROM model")
over("agg_05_duplicates_report", lambda i: reports.duplicates(_rows(i).withColumn("sku", F.substring("sku", 1, 3))), "f12_items", _V + ", d AS (SELECT pedido, matricula, sku[1:3] AS sku, count(*) AS ocorrencias, sum(coalesce(q, 0)) AS t FROM v WHERE pedido <> '' AND matricula <> '' AND sku <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT pedido, matricula, sku, ocorrencias, replace(rtrim(rtrim(CAST(CAST(t AS DECIMAL(30,8)) AS VARCHAR), '0'), '.'), '.', ',') AS qtd_total FROM d")
over("agg_06_keys_to_register", lambda i: reports.pending_keys(_rows(i).withColumns({"chave": F.col("cnpj"), "cnpj_oficial": F.when(F.col("row_id") % 2 == 0, F.col("cnpj")).otherwise("77")})), "f12_items", _V + ", w AS (SELECT *, CASE WHEN row_id % 2 = 0 THEN cnpj ELSE '77' END AS o FROM v) SELECT CASE length(cnpj) WHEN 14 THEN 'CNPJ' ELSE 'COD_LOJA' END AS tipo, cnpj AS chave, cnpj, CASE WHEN o <> cnpj THEN o ELSE '' END AS cnpj_oficial, coalesce(string_agg(DISTINCT nullif(pedido, ''), ' | ' ORDER BY nullif(pedido, '')), '') AS pedidos FROM w WHERE cnpj <> '' AND matricula = '' GROUP BY cnpj, o")
over("agg_07_manifest", lambda i: reports.manifest(_rows(i), _model(i), "a.pdf", "REDE", "2026-03-17 09:05:00"), "f12_items", _V + " SELECT unnest(['data_hora_geracao', 'arquivo', 'layout', 'linhas_validacao', 'linhas_modelo_fila', 'linhas_bloqueadas', 'total_alertas', 'go_no_go_fila']) AS campo, unnest(['2026-03-17 09:05:00', 'a.pdf', 'REDE', CAST(validacao AS VARCHAR), CAST(modelo AS VARCHAR), CAST(bloqueadas AS VARCHAR), CAST(alertas AS VARCHAR), CASE WHEN bloqueadas > 0 OR alertas > 0 THEN 'NÃO LIBERADO' ELSE 'LIBERADO APÓS CONFERÊNCIA MANUAL' END]) AS valor FROM f")
over("agg_08_thirteen_indicators", lambda i: reports.executive_panel(_rows(i), _model(i), "a.pdf", "REDE"), "f12_items", _V + """ SELECT unnest(['Status executivo', 'Layout', 'Arquivo/Lote', 'Itens na validação', 'Itens prontos no modelo/fila', 'Itens bloqueados', 'CNPJs/Chaves a cadastrar', 'Possíveis duplicidades', 'Itens convertidos', 'Itens não convertidos', 'Itens para validar conversão', 'Alertas registrados', 'Regra de segurança']) AS indicador,
  unnest([CASE WHEN bloqueadas > 0 OR cadastrar > 0 THEN 'BLOQUEADA - VALIDAR PENDÊNCIAS' ELSE 'PRONTA PARA CONFERÊNCIA MANUAL' END, 'REDE', 'a.pdf', CAST(validacao AS VARCHAR), CAST(modelo AS VARCHAR), CAST(bloqueadas AS VARCHAR), CAST(cadastrar AS VARCHAR), CAST(duplicidades AS VARCHAR), CAST(cv AS VARCHAR), CAST(nc AS VARCHAR), CAST(va AS VARCHAR), CAST(alertas AS VARCHAR), 'TXT/fila não é gerado automaticamente']) AS valor FROM f""")
over("agg_09_conversion_summary", lambda i: reports.conversion_summary(i), "f12_items", _V + " SELECT cv AS convertidos, nc AS nao_convertidos, va AS validar, validacao - cv - nc - va AS sem_conversao FROM f")
over("agg_10_audit_summary", reports.audit_summary, "f12_items", "SELECT count(*) AS itens, count(*) FILTER (alerta_extracao <> '') AS com_alerta, count(DISTINCT cnpj_lido) FILTER (cnpj_lido <> '' AND matricula_lida = '') AS cnpjs_sem_matricula FROM f12_items")
over("agg_11_unique_alerts", reports.unique_alerts, "f12_items", "SELECT DISTINCT alerta_extracao AS alerta FROM f12_items WHERE alerta_extracao <> ''")
over("agg_15_store_summary", lambda i: reports.store_summary(i.select("row_id", F.col("regional").alias("loja"), (F.col("row_id") % 9).alias("qtd"), F.when(F.col("regional") == "PR", "").otherwise(F.col("alerta_extracao")).alias("alerta"))), "f12_items", "WITH i AS (SELECT row_id, regional AS loja, row_id % 9 AS qtd, CASE WHEN regional = 'PR' THEN '' ELSE alerta_extracao END AS a FROM f12_items), f AS (SELECT loja, a, min(row_id) AS first_row FROM i WHERE a <> '' GROUP BY 1, 2), s AS (SELECT loja, string_agg(a, ' | ' ORDER BY first_row) AS alertas FROM f GROUP BY 1) SELECT i.loja, count(*) AS itens, CAST(sum(qtd) AS BIGINT) AS qtd, CASE WHEN bool_or(a <> '') THEN 'ALERTA' ELSE 'OK' END AS status, coalesce(any_value(alertas), '') AS alertas FROM i LEFT JOIN s USING (loja) GROUP BY 1")


def _filed(i: DataFrame) -> DataFrame:
    return _rows(i).withColumn("arquivo", F.concat(F.lit("a"), F.col("row_id") % 300))


_FILES = _V + ", r AS (SELECT concat('a', row_id % 300) AS arquivo, count(*) AS lidas, count(*) FILTER (motivo_descarte = '') AS validas, count(*) FILTER (motivo_descarte <> '') AS rejeitadas, count(*) FILTER (status_conversao = 'OK CONVERTIDO') AS convertidos, count(*) FILTER (motivo = '') AS inseridas FROM v GROUP BY 1), s AS (SELECT *, CASE WHEN validas = 0 THEN 'ERRO' WHEN rejeitadas > 0 THEN 'PARCIAL' ELSE 'SUCESSO' END AS status FROM r)"


def _results(i: DataFrame) -> DataFrame:
    x = _filed(i)
    return reports.file_results(x, x.filter(reports.block_reason(x) == ""))


over("agg_24_file_results", _results, "f12_items", _FILES + " SELECT * FROM s")
over("agg_19_batch_counters", lambda i: reports.batch_counters(_results(i)), "f12_items", _FILES + " SELECT count(*) AS arquivos, count(*) FILTER (status = 'SUCESSO') AS sucesso, count(*) FILTER (status = 'PARCIAL') AS parcial, count(*) FILTER (status = 'ERRO') AS erro, CAST(sum(lidas) AS BIGINT) AS lidas, CAST(sum(validas) AS BIGINT) AS validas, CAST(sum(inseridas) AS BIGINT) AS inseridas FROM s")
over("snk_09_pending_table", lambda i: reports.pending_table(_rows(i).filter("motivo_descarte <> ''")).select("row_id", "status_pendencia", "pedido"), "f12_items", _V + " SELECT row_id, CASE WHEN motivo_descarte = 'MATRICULA_NAO_ENCONTRADA' THEN 'PENDENTE_CADASTRO' ELSE 'PENDENTE_VALIDACAO' END AS status_pendencia, pedido FROM v WHERE motivo_descarte <> ''")
over("j_21_merge_final", lambda i: reports.merge_final(_rows(i).select("row_id", "sku", "qtd"), _rows(i).filter("row_id % 2 = 0").select("row_id", F.concat(F.lit("9"), "qtd").alias("qtd"), "pedido")), "f12_items", _V + " SELECT row_id, sku, concat('9', qtd) AS qtd, pedido FROM v WHERE row_id % 2 = 0")
over("srt_06_newest_first", lambda h: reports.newest_first(h.select("arquivo", F.col("push").alias("modificado"))), "f9_history", "SELECT arquivo, push AS modificado FROM f9_history ORDER BY push DESC, arquivo")
over("flt_11_release_gate", lambda q: _gates(q), "f1_queue", "SELECT unnest(['marca', 'oficial', 'outra', 'tolerante']) AS caso, unnest([false, false, false, true]) AS liberado, unnest(['FALTA_VALIDACAO_MANUAL', 'ERROS_BLOQUEANTES', 'FONTE_NAO_OFICIAL', '']) AS motivo FROM (SELECT count(*) AS n FROM f1_queue) WHERE n > 0")


def _gates(q: DataFrame) -> DataFrame:
    reasons = ("MATRICULA_VAZIA", "SKU_VAZIO", "PEDIDO_VAZIO", "QTD_VAZIA", "QTD_INVALIDA: abc", "DATA_VAZIA", "DATA_INVALIDA", "SKU_MAIS_14")
    rows = queue.judged(q).withColumn("marca", F.when(F.col("row_id") % 2 == 0, "sim").otherwise(""))
    cases = {"marca": ((), True, "marca"), "oficial": (("DATA_VAZIA",), True, None), "outra": ((), False, None), "tolerante": (reasons, True, None)}
    return reports.release_gates(rows, cases).select("caso", "liberado", "motivo")


def _report(i: DataFrame) -> DataFrame:
    conv = F.when(F.col("row_id") % 5 == 0, "OK CONVERTIDO").when(F.col("row_id") % 5 == 1, "VALIDAR CONVERSÃO").otherwise("")
    return i.select("row_id", F.when(F.col("row_id") % 13 == 0, "a cadastrar").otherwise(F.col("matricula_lida")).alias("Matrícula"), F.col("sku_lido").alias("SKU"), F.col("quantidade_lida").alias("Quantidade"), F.col("numero_pedido_lido").alias("Pedido"), F.col("data_entrega_lida").alias("Data Entrega"), F.when(F.col("row_id") % 3 == 0, "").otherwise("sim").alias("validado"), conv.alias("conv"))


_APPROVED = r"""WITH a AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN 'a cadastrar' ELSE matricula_lida END AS m, sku_lido AS s, quantidade_lida AS q, numero_pedido_lido AS p, data_entrega_lida AS d, CASE WHEN regexp_matches(quantidade_lida, '[A-Za-z]') THEN NULL WHEN regexp_full_match(quantidade_lida, '[0-9]{1,3}(\.[0-9]{3})+') THEN TRY_CAST(replace(quantidade_lida, '.', '') AS DECIMAL(30,8)) ELSE TRY_CAST(replace(quantidade_lida, ',', '.') AS DECIMAL(30,8)) END AS n FROM f12_items),
b AS (SELECT *, array_to_string(list_filter([CASE WHEN m IN ('', 'a cadastrar') THEN 'MATRICULA' END, CASE WHEN s = '' THEN 'SKU' END, CASE WHEN n IS NULL OR n <= 0 OR n % 1 <> 0 THEN 'QTD' END, CASE WHEN p = '' THEN 'PEDIDO' END, CASE WHEN d = '' THEN 'DATA' END, CASE WHEN row_id % 3 = 0 THEN 'MARCA' END, CASE WHEN row_id % 5 = 1 THEN 'CONVERSAO' END], lambda x: x IS NOT NULL), ' | ') AS motivos FROM a)"""
over("pipe_04_approve_to_queue", lambda i: lot.approve_to_queue(_report(i), "validado", "conv")[0], "f12_items", _APPROVED + " SELECT row_id, m AS matricula, s AS sku, CAST(CAST(n AS BIGINT) AS VARCHAR) AS qtd, p AS pedido, d AS data_remessa FROM b WHERE motivos = ''")
over("pipe_04_kept_out", lambda i: lot.approve_to_queue(_report(i), "validado", "conv")[1].select("row_id", "motivos"), "f12_items", _APPROVED + " SELECT row_id, motivos FROM b WHERE motivos <> ''")


def _imported(i: DataFrame, g: DataFrame, x: DataFrame) -> DataFrame:
    items = i.withColumn("arquivo", F.concat(F.lit("a"), F.col("row_id") % 4))
    results = i.sparkSession.createDataFrame([("a0", "UM", "ASSINATURA", 99), ("a1", "DOIS", "ASSINATURA", 99), ("a2", "TRES", "ASSINATURA", 90)], "arquivo string, layout string, modo string, confianca int")
    why = F.col("motivo_descarte")
    judged = lot.judge_batch(items, results, {"UM": Layout("UM", client="MATRICULA"), "DOIS": Layout("DOIS", client="MATRICULA", date_rule="COLUNA")}, g, x, TODAY)
    return judged.groupBy("arquivo").agg(F.count_if(why != "").alias("fora"), F.count_if(why == "LAYOUT_NAO_SUPORTADO").alias("sem_layout"), F.count_if(why == "").alias("dentro"))


over("pipe_06_imported_files", _imported, "f12_items f3_gln f2_xref", r"""WITH a AS (SELECT row_id, concat('a', row_id % 4) AS arquivo, row_id % 4 AS k, *, CASE WHEN regexp_matches(quantidade_lida, '[A-Za-z]') THEN NULL WHEN regexp_full_match(quantidade_lida, '[0-9]{1,3}(\.[0-9]{3})+') THEN TRY_CAST(replace(quantidade_lida, '.', '') AS DECIMAL(30,8)) ELSE TRY_CAST(replace(quantidade_lida, ',', '.') AS DECIMAL(30,8)) END AS n, regexp_replace(numero_pedido_lido, '[^0-9]', '', 'g') AS p FROM f12_items),
b AS (SELECT arquivo, k, length(p) BETWEEN 3 AND 20 AND p <> cnpj_lido AND p <> ean_lido AND NOT (p = sku_lido AND length(sku_lido) >= 5) AND length(matricula_lida) BETWEEN 6 AND 12 AND NOT (length(sku_lido) IN (12, 13, 14) AND ean_lido = '') AND (sku_lido <> '') AND (ean_lido = '' OR length(ean_lido) IN (8, 12, 13, 14)) AND coalesce(n > 0, false) AND NOT regexp_full_match(quantidade_lida, '[0-9]{1,4},[0-9]{3,6}')
  AND status_extracao = '' AND alerta_extracao = '' AND status_conversao NOT IN ('VALIDAR CONVERSAO', 'ALERTA - NÃO CONVERTIDO', 'outro NAO_CONVERTIDO') AND (k = 0 OR try_strptime(data_entrega_lida, '%d/%m/%Y') IS NOT NULL) AS ok FROM a)
SELECT arquivo, count(*) FILTER (NOT (ok AND k IN (0, 1))) AS fora, count(*) FILTER (k IN (2, 3)) AS sem_layout, count(*) FILTER (ok AND k IN (0, 1)) AS dentro FROM b GROUP BY 1""")


def _emailed(i: DataFrame) -> tuple[DataFrame, DataFrame]:
    row = F.concat_ws(" ", "regional", F.concat(F.lit("712"), F.lpad(F.col("row_id") % 200, 7, "0")), F.lpad(F.col("row_id") % 100, 6, "4"), F.lit("05/06/24"))
    mail = i.filter("row_id % 3 = 0").select("row_id", F.to_json(F.struct(F.concat(F.lit("<br>"), row).alias("body"))).alias("meta"))
    items = i.select("row_id", F.concat(F.lit("712"), F.lpad(F.col("row_id") % 250, 7, "0")).alias("matricula"), F.lpad(F.col("row_id") % 100, 6, "4").alias("pedido"), "regional", F.col("sku_lido").alias("sku"), F.lit(2).cast("long").alias("qtd"))
    return lot.email_batch(mail, items)


over("pipe_08_email_batch", lambda i: _emailed(i)[0].select("row_id", "data", "alerta"), "f12_items", """WITH s AS (SELECT DISTINCT regional, row_id % 200 AS m, row_id % 100 AS p FROM f12_items WHERE row_id % 3 = 0), u AS (SELECT m FROM s GROUP BY 1 HAVING count(DISTINCT p) = 1), i AS (SELECT row_id, regional, row_id % 250 AS m, row_id % 100 AS p FROM f12_items)
SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.m = i.m) AND (EXISTS (SELECT 1 FROM s WHERE s.m = i.m AND s.p = i.p) OR i.m IN (SELECT m FROM u) OR EXISTS (SELECT 1 FROM s WHERE s.m = i.m AND s.regional = i.regional)) THEN '05.06.2024' ELSE '' END AS data,
  CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.m = i.m AND s.p = i.p) THEN '' WHEN i.m IN (SELECT m FROM u) THEN 'DATA_POR_MATRICULA' WHEN EXISTS (SELECT 1 FROM s WHERE s.m = i.m AND s.regional = i.regional) THEN 'DATA_POR_REGIONAL' ELSE 'SEM_DATA_REMESSA' END AS alerta FROM i""")


def _files(x: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.when(F.col("row_id") % 9 == 0, "pedido de compra fornecedor produto sku qtd total").otherwise("texto"), F.lit("rede"), "rede", F.concat(F.lit("n"), F.col("row_id") % 11), F.when(F.col("row_id") % 6 == 0, F.col("chave_lida")).otherwise(""))
    return x.select("row_id", F.lit("PDF").alias("tipo"), text.alias("texto"), F.concat_ws("_", "rede", F.concat(F.lit("n"), F.col("row_id") % 11), F.lit("pedido")).alias("nome_arquivo"))


def _scored(x: DataFrame) -> DataFrame:
    from .catalog_documents import _layouts

    return detection.score_layouts(_files(x), detection.default_keyword_rules(_layouts(x)).filter("row_id < 60"))


#: Likeness of names has no SQL, so these two are only checked by their own tests.
over("j_15_score_layouts", _scored, "f2_xref", "")


def _detected(x: DataFrame) -> DataFrame:
    from .catalog_documents import _layouts
    from .operators import resolve

    entries = resolve.load_xref(x).select("row_id", "rede", F.col("chave").alias("chave_lida"), F.col("chave").alias("cnpj_oficial"), "matricula")
    return detection.detect_layout(_files(x), {"ASSINADO": (("MACHINERY",), ("FORNECEDOR",))}, entries, _layouts(x), detection.default_keyword_rules(_layouts(x)).filter("row_id < 60"), "GENERICO PDF")


over("ex_21_detect_layout", _detected, "f2_xref", "")
# A blank network takes a key only if all its forms lead to one entry, so forms that several entries share take none.
over("j_20_track_by_keys", lambda x: _tracked(x), "f2_xref", f"""WITH e AS (SELECT row_id, upper(rede) AS rede, chave_lida AS c, matricula FROM f2_xref WHERE status <> 'INATIVO' AND matricula <> '' AND chave_lida <> ''), d AS (SELECT row_id, chave_lida AS c FROM f2_xref WHERE row_id % 6 = 0),
dv AS (SELECT row_id, unnest({_FORMS('c')}) AS k FROM d), ev AS (SELECT row_id AS entry, rede, c, matricula, unnest(list_concat({_FORMS('c')}, {_FORMS('matricula')})) AS k FROM e), m AS (SELECT dv.row_id, any_value(rede) AS rede FROM dv JOIN ev USING (k) GROUP BY 1 HAVING count(DISTINCT (c, matricula)) = 1),
l AS (SELECT upper(rede) AS rede, min(row_id) AS layout FROM f2_xref WHERE row_id % 5 <> 0 AND row_id % 7 NOT IN (0, 2) AND row_id % 3 <> 0 GROUP BY 1) SELECT m.row_id, rede, l.layout FROM m JOIN l USING (rede)""")


def _tracked(x: DataFrame) -> DataFrame:
    from .catalog_documents import _layouts
    from .operators import resolve

    entries = resolve.load_xref(x).select("row_id", "rede", F.col("chave").alias("chave_lida"), F.col("chave").alias("cnpj_oficial"), "matricula")
    return detection.track_by_keys(_files(x), entries, _layouts(x)).select("row_id", "rede", "layout")


