"""Queries of sources, sheets, lines, lots and layout detection, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import detection, lines, lots, sheets
from .plans import lot
from .registry import over
from .sources import tables

_CTX = "coalesce(last_value(nullif(regexp_extract(line, '{}', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no), '')"
_ITEM = "^([0-9]{6}) ([0-9]+) (.+) CX ([0-9]+) ([0-9]+),00 [0-9]+,[0-9]{4}$"
_ORDER, _CNPJ = "^PEDIDO DE COMPRAS ([0-9]+)/", r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})"

# Sources
over("src_02_cells_from_wide", lambda q: tables.cells_from_wide(q, ["matricula", "sku", "qtd"]), "f1_queue", "SELECT 'S1' AS sheet, row_id AS r, unnest([1, 2, 3]) AS c, unnest([trim(matricula), trim(sku), trim(qtd)]) AS v FROM f1_queue")
over("src_03_union_sheets", lambda q, g: tables.union_sheets({"fila": q.select("row_id", "matricula", "sku"), "base": g.select("row_id", "matricula", "gln")}), "f1_queue f3_gln", "SELECT row_id, matricula, sku, 'fila' AS sheet, '' AS gln FROM f1_queue UNION ALL SELECT row_id, matricula, '', 'base', gln FROM f3_gln")
over("src_04_apply_mapping", lambda q: tables.apply_mapping(q, [("cliente", "COLUNA", "CNPJ|Matrícula"), ("artigo", "COLUNA", "Código|SKU|QTD"), ("origem", "FIXO", "LOJA"), ("vazio", "COLUNA", "NADA")]), "f1_queue", "SELECT row_id, trim(matricula) AS cliente, trim(sku) AS artigo, 'LOJA' AS origem, '' AS vazio FROM f1_queue")


def _mapping_lines(g: DataFrame) -> DataFrame:
    head = g.sparkSession.createDataFrame([(1, "Base de clientes"), (3, "Rede\tMatrícula\tCNPJ da loja")], "line_no long, line string")
    return head.unionByName(g.select((F.col("row_id") + 10).alias("line_no"), F.concat_ws("\t", F.lit("R1"), F.when(F.col("row_id") % 9 == 0, "").otherwise(F.col("matricula")), F.regexp_replace("cnpj", "^0+", "")).alias("line")))


over("src_08_load_mapping", lambda g: tables.load_mapping(_mapping_lines(g)), "f3_gln", "SELECT row_id + 10 AS line_no, cnpj, 'R1' AS rede, matricula FROM f3_gln WHERE row_id % 9 <> 0")
_ALIASES = {"sku_lido": ("Código", "SKU"), "quantidade_lida": ("Qtde", "Quantidade"), "numero_pedido_lido": ("Nº do Pedido",)}


def _headed(q: DataFrame) -> DataFrame:
    """Sheets by the row_id's last digit, with a title, a header in row 3 (but for sheet 7), and rows of the queue."""
    sheet = F.concat(F.lit("S"), F.col("row_id") % 10)
    body = q.select(sheet.alias("sheet"), (F.col("row_id") + 100).alias("r"), F.posexplode(F.array("sku", "matricula", "qtd", "pedido")).alias("p", "v")).select("sheet", "r", (F.col("p") + 1).cast("long").alias("c"), "v")
    heads = [(f"S{i}", r, c, v) for i in range(10) for r, row in ((1, ("Pedido de compra", "", "", "")), (3, ("Código", "Cliente", "Qtde. Caixas", "Nº do pedido") if i != 7 else ("zz", "zy", "zx", "zw"))) for c, v in enumerate(row, 1)]
    return body.unionByName(q.sparkSession.createDataFrame(heads, "sheet string, r long, c long, v string"))


# Words of a sheet's title also match, so its score is told apart from the header's.
over("src_09_find_header", lambda q: tables.find_header(_headed(q), _ALIASES).select("sheet", "r", "score"), "f1_queue", "SELECT concat('S', i) AS sheet, 3 AS r, 7 AS score FROM (SELECT DISTINCT row_id % 10 AS i FROM f1_queue) WHERE i <> 7")
over("src_10_find_header_exact", lambda q: tables.find_header_exact(_headed(q), {"Sku": ("SKU", "Código"), "Pedido": ("Pedido", "Nº do pedido")}), "f1_queue", "SELECT concat('S', i) AS sheet, 3 AS r, 2 AS hits FROM (SELECT DISTINCT row_id % 10 AS i FROM f1_queue) WHERE i <> 7")
over("src_13_value_beside", lambda q: tables.value_beside(_headed(q), "CODIGO", right=2).unionByName(tables.value_beside(_headed(q), "CLIENTE", right=0, below=1)), "f1_queue", "SELECT concat('S', i) AS sheet, unnest(['Qtde. Caixas', '']) AS v FROM (SELECT DISTINCT row_id % 10 AS i FROM f1_queue) WHERE i <> 7")
over("ex_07_generic_cells", lambda q: sheets.generic_cells(_headed(q), tables.find_header(_headed(q), _ALIASES), ("sku_lido", "quantidade_lida", "numero_pedido_lido")), "f1_queue", "SELECT concat('S', row_id % 10) AS sheet, row_id + 100 AS r, trim(sku) AS sku_lido, trim(qtd) AS quantidade_lida, trim(pedido) AS numero_pedido_lido FROM f1_queue WHERE row_id % 10 <> 7 AND concat(sku, qtd, pedido) <> ''")
over("src_12_normalize_intermediate", lambda i: tables.normalize_intermediate(i.select("row_id", "sku_lido", F.when(F.col("row_id") % 2 == 0, F.col("layout_usado")).otherwise(" ").alias("layout_usado")), "a.pdf", "REDE").select("row_id", "codigo_sku_lido", "layout_usado", "arquivo_origem", "loja_lida"), "f12_items", "SELECT row_id, sku_lido AS codigo_sku_lido, CASE WHEN row_id % 2 = 0 THEN layout_usado ELSE 'REDE' END AS layout_usado, 'a.pdf' AS arquivo_origem, '' AS loja_lida FROM f12_items")
over("src_14_load_rules", lambda m: tables.load_rules(m.select(F.col("row_id").alias("regra_id"), F.col("descricao").alias("nome_layout"), F.concat(F.lit("A-"), "sku").alias("sku_origem"), F.lower("centro").alias("centro"), F.when(F.col("row_id") % 4 == 0, "x").otherwise(F.concat("apresentacao", F.lit(",0"))).alias("prioridade"), F.when(F.col("row_id") % 3 == 0, "não").otherwise("1").alias("ativo"))).select("regra_id", "rede_layout", "centro", "sku", F.col("prioridade").cast("long").alias("prioridade")), "f4_map", "SELECT row_id AS regra_id, descricao AS rede_layout, centro, sku, CASE WHEN row_id % 4 = 0 THEN 999 ELSE CAST(apresentacao AS BIGINT) END AS prioridade FROM f4_map WHERE row_id % 3 <> 0")
over("src_15_load_product_map", lambda m: tables.load_product_map(m.select("row_id", F.lower("centro").alias("centro"), F.col("ean").alias("codigo_ean"), F.col("dun").alias("codigo_dun"), F.when(F.col("row_id") % 5 == 0, "").otherwise(F.col("sku")).alias("sku_ecc"), F.concat(F.lit("77"), "sku").alias("sku_base"), F.col("apresentacao").cast("string").alias("apresentacao"))).select("row_id", "centro", "ean", "sku", F.col("apresentacao").cast("long").alias("apresentacao")), "f4_map", "SELECT row_id, centro, ean, CASE WHEN row_id % 5 = 0 THEN concat('77', sku) ELSE sku END AS sku, CAST(apresentacao AS BIGINT) AS apresentacao FROM f4_map WHERE apresentacao <> 0")


def _layouts(x: DataFrame) -> DataFrame:
    """A catalogue of layouts made of the cross-reference: one row a customer."""
    n = F.col("row_id")
    notes = F.when(n % 7 == 0, "Unidade para caixa com fator").when(n % 7 == 1, "sem conversão, mapa").when(n % 7 == 2, "com conversão").otherwise("entrega matriz")
    kind = F.when(n % 3 == 0, "EXCEL").otherwise("PDF")
    return x.select("row_id", F.concat_ws(" ", F.lit("REDE"), "rede", F.concat(F.lit("N"), n % 11), kind).alias("nome_layout"), kind.alias("tipo_arquivo"), F.when(n % 5 == 0, "0").otherwise("1").alias("ativo"), notes.alias("observacoes"), F.lit("D+1").alias("regra_data_entrega"), n.alias("layout_id"))


_ALLOWED = "row_id % 5 <> 0 AND row_id % 7 NOT IN (0, 2)"
over("flt_02_active_layouts", lambda x: tables.active_layouts(_layouts(x), "pdf").select("row_id").withColumn("k", F.lit("ativo")).unionByName(tables.find_layout(_layouts(x), layout_id="7").select("row_id").withColumn("k", F.lit("achado"))), "f2_xref", "SELECT row_id, 'ativo' AS k FROM f2_xref WHERE row_id % 5 <> 0 AND row_id % 3 <> 0 UNION ALL SELECT row_id, 'achado' FROM f2_xref WHERE row_id = 7")
over("flt_17_tracking_allowed", lambda x: detection.tracking_allowed(_layouts(x)), "f2_xref", f"SELECT row_id, {_ALLOWED} AS permitido FROM f2_xref")
over("src_16_default_keyword_rules", lambda x: detection.default_keyword_rules(_layouts(x)).select("row_id", "ativa", F.array_join("fortes", "|").alias("fortes"), F.size("apoio").cast("long").alias("n_apoio")), "f2_xref", f"SELECT row_id, {_ALLOWED} AS ativa, concat('REDE|', upper(rede), CASE WHEN row_id % 11 = 10 THEN '|N10' ELSE '' END) AS fortes, CASE WHEN row_id % 3 = 0 THEN 13 ELSE 18 END + CASE row_id % 7 WHEN 0 THEN CASE WHEN row_id % 3 = 0 THEN 5 ELSE 4 END - CASE WHEN row_id % 3 = 0 THEN 0 ELSE 0 END WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE CASE WHEN row_id % 3 = 0 THEN 1 ELSE 1 END END AS n_apoio FROM f2_xref WHERE row_id % 5 <> 0")
over("j_19_layout_for_network", lambda x: detection.layout_for_network(x.select("row_id", F.when(F.col("row_id") % 4 == 0, F.concat(F.lit("REDE "), "rede")).when(F.col("row_id") % 4 == 1, F.concat("rede", F.lit(" SUL"))).otherwise("").alias("rede"), F.lit("PDF").alias("tipo")), _layouts(x)).select("row_id", "layout", "score"), "f2_xref", f"""WITH l AS (SELECT row_id, upper(rede) AS rede FROM f2_xref WHERE {_ALLOWED} AND row_id % 3 <> 0), b AS (SELECT rede, min(row_id) AS layout FROM l GROUP BY 1), o AS (SELECT min(row_id) AS any_layout FROM l)
SELECT x.row_id, b.layout, CASE WHEN x.row_id % 4 = 0 THEN 90 ELSE 55 END AS score FROM f2_xref x JOIN b ON b.rede = upper(x.rede) WHERE x.row_id % 4 IN (0, 1)""")
over("flt_29_route_layout", lambda x: detection.route_layout(_layouts(x), [("REDE BUILDING", "construcao"), ("AUTO", "carro"), ("HOUSE", "casa")]).select("row_id", "rota"), "f2_xref", "SELECT row_id, CASE WHEN upper(rede) LIKE '%BUILDING%' THEN 'construcao' WHEN upper(rede) LIKE '%AUTO%' THEN 'carro' WHEN upper(rede) LIKE '%HOUSE%' THEN 'casa' ELSE 'LAYOUT_NAO_SUPORTADO' END AS rota FROM f2_xref")
over("flt_26_stamp_tracking", lambda i, x: detection.stamp_tracking(i.select("row_id", F.expr("CAST(row_id % 50 AS STRING)").alias("arquivo"), "alerta_extracao"), x.filter("row_id < 40").select(F.col("row_id").cast("string").alias("arquivo"), F.lit("REDE").alias("layout"), F.when(F.col("row_id") % 2 == 0, "CHAVE").otherwise("ASSINATURA").alias("modo"))).select("row_id", "modo_rastreabilidade", "layout_referencia", "alerta_extracao"), "f12_items f2_xref", "WITH i AS (SELECT *, row_id % 50 AS a, EXISTS (SELECT 1 FROM f2_xref x WHERE x.row_id = i.row_id % 50 AND x.row_id < 40) AS k FROM f12_items i) SELECT row_id, CASE WHEN k AND a % 2 = 0 THEN 'SIM' ELSE 'NAO' END AS modo_rastreabilidade, CASE WHEN k THEN 'REDE' ELSE '' END AS layout_referencia, CASE WHEN k AND a % 2 = 0 THEN CASE WHEN alerta_extracao = '' THEN 'RASTREABILIDADE_LAYOUT: REDE' ELSE concat(alerta_extracao, ' | RASTREABILIDADE_LAYOUT: REDE') END ELSE alerta_extracao END AS alerta_extracao FROM i")
over("flt_25_manual_date", lambda i: detection.apply_manual_date(i, "20/03/2026").select("row_id", "data_entrega_lida", "regra_data_entrega"), "f12_items", "SELECT row_id, '20/03/2026' AS data_entrega_lida, 'COLUNA' AS regra_data_entrega FROM f12_items")
over("ex_23_best_extraction", lambda v: detection.pick_best_extraction(v.select(F.expr("CAST(row_id % 900 AS STRING)").alias("arquivo"), F.concat(F.lit("m"), F.col("row_id") % 3).alias("motor"), F.concat_ws(" ", "phrase", "code").alias("texto")).groupBy("arquivo", "motor").agg(F.max("texto").alias("texto")), ("loja", "rede", "pagina")), "f11_values", "WITH t AS (SELECT CAST(row_id % 900 AS VARCHAR) AS arquivo, concat('m', row_id % 3) AS motor, max(concat_ws(' ', phrase, code)) AS texto FROM f11_values GROUP BY 1, 2), s AS (SELECT *, 3 * (contains(lower(texto), 'loja')::INT + contains(lower(texto), 'rede')::INT + contains(lower(texto), 'página')::INT) AS score FROM t) SELECT arquivo, motor, score FROM (SELECT *, row_number() OVER (PARTITION BY arquivo ORDER BY score DESC, length(texto) DESC, motor DESC) AS n FROM s) WHERE n = 1")
over("ex_17_layout_confidence", lambda v: v.select("row_id", detection.layout_confidence(F.col("phrase"), {"sao jose": 3, "distribuicao": 2, "rede": 5, "nome": 1}).alias("pontos")), "f11_values", "SELECT row_id, CASE WHEN phrase LIKE 'São%' THEN 5 WHEN phrase LIKE '%Rede%' THEN 5 WHEN phrase LIKE 'Pedido\\_%' ESCAPE '\\' THEN 1 WHEN lower(phrase) LIKE '%name%' THEN 0 ELSE 0 END AS pontos FROM f11_values")


def _places(i: DataFrame) -> DataFrame:
    """Documents with a place of delivery in some of them, registration and supplier numbers, and numbers outside it."""
    mask = F.regexp_replace(F.lpad("cnpj_lido", 14, "0"), "^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")
    k = F.col("row_id") % 4
    head = F.lit("Fornecedor CNPJ: 99.999.999/0001-99 I.E. 11.111.111/1111-11 ")
    block = F.concat(F.lit("Local de Entrega : 139 - Matozinhos CNPJ: "), mask, F.lit(" outro 22.222.222/2222-22 Assinatura"))
    text = F.when(k == 0, F.concat(head, block)).when(k == 1, F.concat(head, F.lit(" Cliente "), mask, F.lit(" fim"))).when(k == 2, F.concat(head, F.lit("Local de Entrega: 7 - Sul - I.E.: "), mask, F.lit(" Página: 1"))).otherwise("nada")
    return i.select("row_id", text.alias("texto"), F.when(k == 3, "Pedido loja 88").otherwise("").alias("assunto"))


over("ex_16_delivery_cnpj", lambda i, g: detection.delivery_cnpj(_places(i), g, ("99999999",)), "f12_items f3_gln", "SELECT row_id, CASE WHEN row_id % 4 IN (0, 1) THEN lpad(cnpj_lido, 14, '0') ELSE '' END AS cnpj FROM f12_items")
over("ex_18_store_identity", lambda i: _places(i).select("row_id", *[c.alias(n) for c, n in zip(detection.store_identity(F.col("texto"), F.col("assunto")), ("numero", "nome"))]), "f12_items", "SELECT row_id, CASE row_id % 4 WHEN 0 THEN '139' WHEN 2 THEN '7' WHEN 3 THEN '88' ELSE '' END AS numero, CASE row_id % 4 WHEN 0 THEN 'Matozinhos' WHEN 2 THEN 'Sul' ELSE '' END AS nome FROM f12_items")
over("ex_19_signatures", lambda v: detection.detect_signature(v.select("row_id", F.col("phrase").alias("texto")), {"A": (("SAO JOSE", "REDE"), ("DISTRIBUICAO", "PDF")), "B": (("REDE",),), "C": (("PAGINA", "PEDIDO"),)}), "f11_values", "SELECT row_id, CASE WHEN phrase LIKE 'São José%' OR phrase LIKE '%Íris  PDF%' THEN 'A' WHEN phrase LIKE 'Página%' OR phrase LIKE 'Pedido%' THEN 'C' ELSE '' END AS assinatura FROM f11_values")
over("ex_24_order_numbers", lambda v: v.select("row_id", lines.order_number(F.col("corpo"), F.col("phrase"), (r"SKU\D+([0-9]+)", r"e ([0-9]{7,}) fim")).alias("pedido")), "f11_values", r"SELECT row_id, CASE WHEN corpo LIKE '%SKU%' THEN regexp_extract(corpo, 'SKU[^0-9]+([0-9]+)', 1) WHEN corpo LIKE '% fim' THEN regexp_extract(corpo, 'e ([0-9]{7,}) fim', 1) ELSE regexp_extract(phrase, '[0-9]{5,}', 0) END AS pedido FROM f11_values")

# Lines
over("win_04_value_after_label", lambda x: lines.with_following_value(x, lines.ORDER, r"CNPJ (.+)$"), "f6_lines", """WITH x AS (SELECT *, first_value(CASE WHEN line LIKE 'PEDIDO DE COMPRAS %' THEN '' WHEN line LIKE 'CNPJ %' THEN substring(line, 6) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS v FROM f6_lines) SELECT file, line_no, coalesce(v, '') AS valor FROM x WHERE line LIKE 'PEDIDO DE COMPRAS %'""")
over("j_18_attach_trailing", lambda x: lines.attach_trailing(x, lines.ITEM, r"^([0-9]{6}) LINHA QUEBRADA"), "f6_lines", f"""WITH n AS (SELECT *, row_number() OVER w AS n, regexp_full_match(line, '{_ITEM}') AS item FROM f6_lines WINDOW w AS (PARTITION BY file ORDER BY page, line_no)), o AS (SELECT *, last_value(CASE WHEN item THEN line_no END IGNORE NULLS) OVER w AS ol, last_value(CASE WHEN item THEN n END IGNORE NULLS) OVER w AS onn FROM n WINDOW w AS (PARTITION BY file ORDER BY page, line_no)),
t AS (SELECT file, ol, string_agg(line[1:6], ' ' ORDER BY n) AS e FROM o WHERE line LIKE '%LINHA QUEBRADA' AND ol IS NOT NULL AND n - onn <= 8 GROUP BY 1, 2) SELECT o.file, line_no, coalesce(e, '') AS extra FROM o LEFT JOIN t ON t.file = o.file AND t.ol = line_no WHERE item""")
over("win_03_back_filled", lambda x: lines.back_filled(x.filter(F.col("line").rlike(lines.ITEM)).select("file", "line_no", F.when(F.expr("substring(file, 4, 9) % 3 = 0"), "X").otherwise("").alias("cnpj")), x), "f6_lines", f"""WITH c AS (SELECT file, min(n) AS m FROM (SELECT file, nullif(regexp_extract(line, '{_CNPJ}', 1), '') AS n FROM f6_lines) GROUP BY 1 HAVING count(DISTINCT n) = 1)
SELECT l.file, line_no, CASE WHEN CAST(substring(l.file, 4) AS BIGINT) % 3 = 0 THEN 'X' ELSE coalesce(m, '') END AS cnpj FROM f6_lines l LEFT JOIN c USING (file) WHERE regexp_full_match(line, '{_ITEM}')""")
over("win_14_order_of_line", lambda x: lines.order_of_line(x.withColumn("cab", F.when(F.expr("substring(file, 4, 9) % 2 = 0"), "H1").otherwise("")), r"^TOTAIS ([0-9]+)", "cab").select("file", "line_no", "pedido"), "f6_lines", "SELECT file, line_no, coalesce(last_value(nullif(regexp_extract(line, '^TOTAIS ([0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY page, line_no), CASE WHEN CAST(substring(file, 4) AS BIGINT) % 2 = 0 THEN 'H1' ELSE '.' END) AS pedido FROM f6_lines")
over("set_08_flagged_repeats", lambda x: lines.flagged_repeats(lines.extract_items(x), ["file", "sku"]).select("file", "line_no", "repetido"), "f6_lines", "SELECT file, line_no, row_number() OVER (PARTITION BY file, line[1:6] ORDER BY line_no) > 1 AS repetido FROM (SELECT file, line_no, CASE WHEN line LIKE '%QUEBRADA' THEN '' ELSE line END AS line FROM f6_lines WHERE regexp_matches(line, '^[0-9]{6} '))")
over("agg_02_sum_by_order_sku", lambda x: lines.sum_by_order_sku(lines.extract_items(x).withColumn("ean", F.concat(F.lit("789"), F.col("line_no") % 10))), "f6_lines", f"""WITH x AS (SELECT *, {_CTX.format(_ORDER)} AS pedido FROM f6_lines), i AS (SELECT file, pedido, regexp_extract(line, '{_ITEM}', 1) AS sku, coalesce(TRY_CAST(regexp_extract(line, '{_ITEM}', 5) AS BIGINT), 0) AS q, line_no FROM x WHERE regexp_matches(line, '^[0-9]{{6}} ')),
g AS (SELECT file, pedido, sku, CAST(sum(q) AS BIGINT) AS qtd, concat('789', arg_min(line_no, line_no) % 10) AS ean FROM i GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY file, pedido ORDER BY TRY_CAST(sku AS BIGINT) NULLS LAST, sku) AS n FROM g""")


def _read_pages(x: DataFrame) -> DataFrame:
    return x.select("file", F.col("line_no").alias("page"), F.when(F.col("line").startswith("TOTAIS"), " ").otherwise(F.col("line")).alias("texto"), F.concat(F.lit("m"), F.col("line_no") % 3).alias("motor"))


_PAGES = "p AS (SELECT file, concat('m', line_no % 3) AS m, count(*) AS n, count(*) FILTER (line LIKE 'TOTAIS%') AS s FROM f6_lines GROUP BY 1, 2), a AS (SELECT file, CAST(sum(n) AS BIGINT) AS paginas, CAST(sum(s) AS BIGINT) AS sem_texto, string_agg(concat(m, '=', n), ', ' ORDER BY concat(m, '=', n)) AS motores FROM p GROUP BY 1)"
over("agg_17_page_engines", lambda x: lines.page_engines(_read_pages(x)), "f6_lines", f"WITH {_PAGES} SELECT * FROM a")
over("ex_26_finalize_read", lambda x: lines.finalize_read(lines.page_engines(_read_pages(x)), lines.extract_items(x)), "f6_lines", f"WITH {_PAGES}, i AS (SELECT file, count(*) AS itens, count(*) FILTER (NOT regexp_full_match(line, '{_ITEM}')) AS com_alerta FROM f6_lines WHERE regexp_matches(line, '^[0-9]{{6}} ') GROUP BY 1) SELECT a.file, coalesce(itens, 0) AS itens, coalesce(com_alerta, 0) AS com_alerta, CASE WHEN coalesce(itens, 0) = 0 AND sem_texto > 0 THEN 'FALHA_SEM_TEXTO' WHEN coalesce(itens, 0) = 0 THEN 'FALHA_SEM_ITENS' WHEN com_alerta > 0 OR sem_texto > 0 THEN 'OK_COM_ALERTA' ELSE 'OK' END AS status FROM a LEFT JOIN i USING (file)")
over("ex_22_page_header", lambda x: lines.page_header(x.withColumn("page", F.floor(F.col("line_no") / 700))), "f6_lines", f"WITH x AS (SELECT file, line_no // 700 AS page, line_no, line, coalesce(last_value(nullif(regexp_extract(line, '{_ORDER}', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no), '') AS pedido, nullif(regexp_extract(line, '{_CNPJ}', 1), '') AS c FROM f6_lines) SELECT file, page, arg_max(pedido, line_no) AS pedido, coalesce(arg_max(c, line_no) FILTER (c IS NOT NULL), '') AS cnpj FROM x GROUP BY 1, 2")


def _token_lines(x: DataFrame) -> DataFrame:
    return x.withColumn("line", F.when(F.col("line").rlike(lines.ITEM), F.concat(F.lit("A 7890000"), F.substring("line", 1, 6), F.lit(" X "), F.col("line"))).otherwise(F.col("line")))


over("ex_04_by_tokens", lambda x: lines.by_tokens(_token_lines(x)), "f6_lines", f"SELECT file, line_no, concat('7890000', line[1:6]) AS ean, line[1:6] AS sku, string_split(line, ' ')[-3] AS qtd FROM f6_lines WHERE regexp_full_match(line, '{_ITEM}')")
over("ex_06_generic_items", lambda x: lines.generic_items(x.filter(F.col("line").rlike("^[0-9]{6} "))), "f6_lines", f"SELECT file, line_no, line[1:6] AS codigo, CASE WHEN regexp_full_match(line, '{_ITEM}') THEN string_split(line, ' ')[-3] ELSE '' END AS qtd, 'BAIXA_CONFIANCA' AS alerta FROM f6_lines WHERE regexp_matches(line, '^[0-9]{{6}} ')")


def _records(i: DataFrame) -> DataFrame:
    return i.select(F.lit("m").alias("file"), F.col("row_id").alias("line_no"), F.concat_ws(" ", "regional", F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("712"), F.lpad(F.col("row_id") % 10000, 7, "0"))).otherwise("x"), F.lpad(F.col("row_id") % 1000000, 6, "4"), "data_entrega_lida").alias("line"))


over("ex_05_compact_records", lambda i: lines.compact_records(_records(i)), "f12_items", "SELECT 'm' AS file, row_id AS line_no, concat('712', lpad(CAST(row_id % 10000 AS VARCHAR), 7, '0')) AS matricula, lpad(CAST(row_id % 1000000 AS VARCHAR), 6, '4') AS pedido, data_entrega_lida AS dia FROM f12_items WHERE row_id % 3 = 0 AND data_entrega_lida <> ''")


def _vertical(i: DataFrame) -> DataFrame:
    """Records written downwards, one file a customer number's rest; the region only where it changes."""
    parts = F.array(F.col("regional"), F.concat(F.lit("712"), F.lpad(F.col("row_id") % 10000000, 7, "0")), F.lit("Entrega normal"), F.concat(F.lit("45"), F.lpad(F.col("row_id") % 10000, 6, "0")), F.lit("05/06/2024"))
    keep = F.when(F.col("row_id") % 2 == 0, parts).otherwise(F.slice(parts, 2, 4))
    return i.select(F.concat(F.lit("f"), F.col("row_id") % 40).alias("file"), F.col("row_id"), F.posexplode(keep).alias("p", "line")).select("file", (F.col("row_id") * 10 + F.col("p")).alias("line_no"), "line")


over("ex_03_vertical_records", lambda i: lines.assemble_vertical(_vertical(i)), "f12_items", """SELECT concat('f', row_id % 40) AS file, row_number() OVER w AS n, coalesce(last_value(CASE WHEN row_id % 2 = 0 THEN regional END IGNORE NULLS) OVER w, '') AS regional, concat('712', lpad(CAST(row_id % 10000000 AS VARCHAR), 7, '0')) AS matricula, 'Entrega normal' AS tipo, concat('45', lpad(CAST(row_id % 10000 AS VARCHAR), 6, '0')) AS pedido, '05/06/2024' AS dia FROM f12_items WINDOW w AS (PARTITION BY row_id % 40 ORDER BY row_id)""")
over("flt_31_roles", lambda i: _vertical(i).select("file", "line_no", *[c.alias(n) for n, c in lines.roles(F.col("line")).items()]), "f12_items", """WITH v AS (SELECT row_id, regional, CASE WHEN row_id % 2 = 0 THEN 0 ELSE 1 END AS d, unnest(range(0, 5)) AS j FROM f12_items)
SELECT concat('f', row_id % 40) AS file, row_id * 10 + j - d AS line_no, j = 0 AS regional, j IN (1, 3) AS matricula, j IN (1, 3) AS pedido, j = 4 AS data FROM v WHERE j >= d""")
over("ex_25_case_items", lambda x: lines.case_item(lines.extract_items(x), "REDE", "SEM_CONVERSAO").select("file", "line_no", "qtd_final", "status_conversao"), "f6_lines", f"SELECT file, line_no, CAST(coalesce(TRY_CAST(regexp_extract(line, '{_ITEM}', 5) AS BIGINT), 0) AS VARCHAR) AS qtd_final, 'OK SEM CONVERSÃO' AS status_conversao FROM f6_lines WHERE regexp_matches(line, '^[0-9]{{6}} ')")
over("src_11_email_shipments", lambda i: tables.email_shipments(i.select("row_id", F.to_json(F.struct(F.concat(F.lit("<p>Olá</p><p>"), F.concat_ws(" ", "regional", F.lit("7120000001"), F.lpad(F.col("row_id") % 1000000, 6, "4"), F.lit("05/06/24")), F.lit("</p>fim")).alias("corpo_email"))).alias("meta"))).withColumn("data", F.date_format("data", "yyyy-MM-dd")), "f12_items", "SELECT row_id, 2 AS line_no, regional, '7120000001' AS matricula, lpad(CAST(row_id % 1000000 AS VARCHAR), 6, '4') AS pedido, '2024-06-05' AS data FROM f12_items")

# Sheets
over("ex_08_sku_by_store", lambda x: sheets.unpivot_sku_store(_vip(x)).drop("sheet"), "f7_cells", "WITH x AS (SELECT r, c, v, max(CASE WHEN r = 1 AND length(v) >= 6 THEN v END) OVER (PARTITION BY c) AS store, max(CASE WHEN c = 1 THEN v END) OVER (PARTITION BY r) AS code FROM f7_cells) SELECT r, c, store AS matricula, code AS sku, v AS qtd FROM x WHERE r >= 3 AND c > 1 AND store IS NOT NULL AND code IS NOT NULL AND TRY_CAST(v AS BIGINT) > 0")


def _vip(x: DataFrame) -> DataFrame:
    return x.select("sheet", "r", "c", "v")


def _stores_down(x: DataFrame) -> DataFrame:
    """The matrix turned: customers down in column 2, articles of five digits across in row 1."""
    heads = x.filter("c = 1 AND r >= 3").select("sheet", F.lit(1).cast("long").alias("r"), (F.col("r") + 2).alias("c"), F.concat(F.lit("Cód. "), F.lpad("v", 6, "1")).alias("v"))
    stores = x.filter("r = 1").select("sheet", (F.col("c") + 1).alias("r"), F.lit(2).cast("long").alias("c"), F.concat(F.lit("Loja "), "v").alias("v"))
    body = x.filter("r >= 3 AND c > 1").select("sheet", (F.col("c") + 1).alias("r"), (F.col("r") + 2).alias("c"), "v")
    return heads.unionByName(stores).unionByName(body)


over("ex_09_store_by_sku", lambda x: sheets.unpivot_store_sku(_stores_down(x)).drop("sheet"), "f7_cells", "WITH x AS (SELECT r, c, v, max(CASE WHEN r = 1 THEN v END) OVER (PARTITION BY c) AS store, max(CASE WHEN c = 1 THEN lpad(v, 6, '1') END) OVER (PARTITION BY r) AS code FROM f7_cells) SELECT c + 1 AS r, r + 2 AS c, store AS matricula, code AS sku, v AS qtd FROM x WHERE r >= 3 AND c > 1 AND store IS NOT NULL AND code IS NOT NULL AND TRY_CAST(v AS BIGINT) > 0")


def _divided(x: DataFrame) -> DataFrame:
    """The matrix with names above store codes, a divisor before the first store, and a total among the last ones."""
    moved = x.filter("r >= 3").select("sheet", "r", F.when(F.col("c") > 1, F.col("c") + 10).otherwise(F.col("c")).alias("c"), "v")
    heads = x.filter("r = 1").select("sheet", F.lit(2).cast("long").alias("r"), (F.col("c") + 10).alias("c"), F.when(F.col("c") == 90, "Total geral").otherwise(F.col("v")).alias("v"))
    names = x.filter("r = 1 AND c % 2 = 0").select("sheet", F.lit(1).cast("long").alias("r"), (F.col("c") + 10).alias("c"), F.concat(F.lit("Loja "), "c").alias("v"))
    fixed = x.sparkSession.createDataFrame([("S1", 2, 1, "SKU"), ("S1", 2, 9, "Divisor"), ("S1", 2, 5, "Descrição")], "sheet string, r long, c long, v string")
    return moved.unionByName(heads).unionByName(names).unionByName(fixed)


_DIVIDED = "WITH x AS (SELECT r, c, v, max(CASE WHEN r = 1 AND c < 90 THEN v END) OVER (PARTITION BY c) AS store, max(CASE WHEN c = 1 THEN v END) OVER (PARTITION BY r) AS code FROM f7_cells), d AS (SELECT r, c + 10 AS c, c AS oc, store AS loja, CASE WHEN c % 2 = 0 THEN concat('Loja ', c) ELSE '' END AS nome, code AS sku, v AS qtd FROM x WHERE r >= 3 AND c > 1 AND store IS NOT NULL AND code IS NOT NULL AND TRY_CAST(v AS BIGINT) > 0)"
over("ex_10_divided_matrix", lambda x: sheets.unpivot_divisor(_divided(x), 2, 1).drop("sheet"), "f7_cells", _DIVIDED + " SELECT r, c, loja, nome, sku, qtd FROM d")
over("pipe_07_company_batch", lambda x, g, s: lot.company_batch(_divided(x), 2, 1, g.select("row_id", "cnpj", F.concat(F.lit("71400"), F.lpad("matricula", 5, "0")).alias("matricula")), s.select("row_id", F.expr("CAST(pedido AS INT)").alias("ordem"), F.concat(F.lit("71400"), F.lpad("matricula", 5, "0")).alias("matricula"), F.col("data_remessa").alias("data"))).drop("sheet"), "f7_cells f3_gln f10_ship", _DIVIDED + """, m AS (SELECT concat('71400', lpad(matricula, 5, '0')) AS matricula, arg_min(cnpj, row_id) AS cnpj FROM f3_gln GROUP BY 1), t AS (SELECT concat('71400', lpad(matricula, 5, '0')) AS matricula, arg_max(data_remessa, (CAST(pedido AS INT), row_id)) AS dt FROM f10_ship WHERE data_remessa <> '' GROUP BY 1)
SELECT r, c, coalesce(m.cnpj, '') AS cnpj, loja AS matricula, sku, qtd, coalesce(dt, '') AS data_remessa FROM d LEFT JOIN m ON m.matricula = loja LEFT JOIN t ON t.matricula = loja""")
over("ex_11_store_block", lambda x, g, m: sheets.unpivot_store_block(_coded(x), 1, g.select("row_id", F.concat(F.lit("71400"), F.lpad("matricula", 5, "0")).alias("loja"), "cnpj", F.col("gln").alias("nome")), m.filter("row_id % 4 <> 0")).drop("sheet"), "f7_cells f3_gln f4_map", """WITH x AS (SELECT r, c, v, max(CASE WHEN r = 1 THEN v END) OVER (PARTITION BY c) AS store, max(CASE WHEN c = 1 THEN concat('789', lpad(v, 10, '0')) END) OVER (PARTITION BY r) AS e FROM f7_cells), g AS (SELECT concat('71400', lpad(matricula, 5, '0')) AS loja, arg_min(cnpj, row_id) AS cnpj FROM f3_gln GROUP BY 1), k AS (SELECT ean, arg_min(sku, row_id) AS sku FROM f4_map WHERE row_id % 4 <> 0 GROUP BY 1)
SELECT x.r, x.c, store AS loja, coalesce(g.cnpj, '') AS cnpj_loja, coalesce(k.sku, e) AS sku, x.v AS qtd FROM x LEFT JOIN g ON g.loja = store LEFT JOIN k ON k.ean = e WHERE x.r >= 3 AND x.c > 1 AND store IS NOT NULL AND e IS NOT NULL AND TRY_CAST(x.v AS BIGINT) > 0""")


def _coded(x: DataFrame) -> DataFrame:
    return x.filter("r <> 2").withColumn("v", F.when((F.col("c") == 1) & (F.col("r") > 2), F.concat(F.lit("789"), F.lpad("v", 10, "0"))).otherwise(F.col("v")))


def _blocks(q: DataFrame) -> DataFrame:
    """Sheets by row_id % 50: store, article, quantity; the store blank on most rows, some rows headers or totals."""
    k = F.col("row_id") % 7
    row = F.array(F.when(k == 0, "Loja").when(k == 1, "").when(k == 2, "").when(k == 3, "Total").otherwise(F.concat(F.lit("L"), F.col("row_id") % 90 + 10)), F.when(k == 0, "Ref.").when(k == 3, "").otherwise(F.col("sku")), F.when(k == 0, "Qtde").otherwise(F.col("qtd")))
    return q.select(F.concat(F.lit("S"), F.col("row_id") % 50).alias("sheet"), F.col("row_id").alias("r"), F.posexplode(row).alias("p", "v")).select("sheet", "r", (F.col("p") + 1).cast("long").alias("c"), "v")


_QTY = r"CASE WHEN regexp_full_match(q, '[0-9]{1,3}(\.[0-9]{3})+') THEN replace(q, '.', '') WHEN q LIKE '%,%' THEN replace(replace(q, '.', ''), ',', '.') ELSE q END"
over("ex_12_repeated_headers", lambda q: sheets.extract_blocks(_blocks(q), 1, 2, 3, F.col("texto").startswith("LOJA REF."), F.col("texto").startswith("TOTAL")), "f1_queue", f"""WITH a AS (SELECT row_id % 50 AS s, row_id AS r, CASE WHEN row_id % 7 IN (1, 2) THEN '' ELSE CAST(row_id % 90 + 10 AS VARCHAR) END AS loja, regexp_replace(sku, '[^0-9]', '', 'g') AS sku, TRY_CAST({_QTY.replace('q', 'qtd')} AS DECIMAL(30,8)) AS n FROM f1_queue WHERE row_id % 7 NOT IN (0, 3)),
b AS (SELECT *, CASE WHEN n > 0 THEN replace(rtrim(rtrim(CAST(n AS VARCHAR), '0'), '.'), '.', ',') ELSE '' END AS qtd FROM a), c AS (SELECT *, CASE WHEN loja = '' AND concat(sku, qtd) <> '' THEN coalesce(last_value(nullif(loja, '') IGNORE NULLS) OVER (PARTITION BY s ORDER BY r), '') ELSE loja END AS l FROM b)
SELECT concat('S', s) AS sheet, r, l AS loja, sku, qtd FROM c WHERE l <> '' AND sku <> '' AND qtd <> ''""")
over("win_15_order_column", lambda q: sheets.order_column(_columns(q), q.select(F.concat(F.lit("S"), F.col("row_id") % 50).alias("sheet")).distinct().withColumns({"r": F.lit(0).cast("long"), "qtd_col": F.lit(1).cast("long")})), "f1_queue", "WITH n AS (SELECT row_id % 50 AS s, row_number() OVER (PARTITION BY row_id % 50 ORDER BY row_id) AS r, pedido FROM f1_queue) SELECT concat('S', s) AS sheet, CASE WHEN count(*) FILTER (r <= 19 AND length(regexp_replace(CASE WHEN s % 3 = 0 THEN '12' ELSE pedido END, '[^0-9]', '', 'g')) >= 4) >= 2 THEN 2 END AS pedido_col FROM n GROUP BY s")


def _columns(q: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.col("row_id") % 50).orderBy("row_id")).cast("long")
    x = q.select(F.concat(F.lit("S"), F.col("row_id") % 50).alias("sheet"), n.alias("r"), F.when(F.col("row_id") % 50 % 3 == 0, "12").otherwise(F.col("pedido")).alias("v"))
    return x.withColumn("c", F.lit(2).cast("long"))


def _form(q: DataFrame) -> DataFrame:
    k = F.col("row_id") % 3
    row = F.array(F.col("sku"), F.when(k == 0, "4").otherwise(""), F.when(k == 1, "48").otherwise(""), F.lit("12"))
    body = q.select(F.concat(F.lit("S"), F.col("row_id") % 50).alias("sheet"), (F.col("row_id") + 10).alias("r"), F.posexplode(row).alias("p", "v")).select("sheet", "r", (F.col("p") + 1).cast("long").alias("c"), "v")
    heads = [(f"S{i}", 2, c, v) for i in range(50) for c, v in ((1, "Matrícula:"), (2, f"71400{i}"), (3, "Data de entrega"), (4, "05/06/2024"))]
    return body.unionByName(q.sparkSession.createDataFrame(heads, "sheet string, r long, c long, v string"))


over("ex_13_order_forms", lambda q: sheets.extract_form(_form(q), {"matricula": "MATRICULA", "data": "DATA DE ENTREGA"}, {"sku": 1, "fardo": 2, "unidades": 3, "por_fardo": 4}, 10), "f1_queue", "SELECT concat('S', row_id % 50) AS sheet, row_id + 10 AS r, regexp_replace(sku, '[^0-9]', '', 'g') AS sku, CASE WHEN row_id % 3 = 2 THEN '' ELSE '4' END AS qtd, CASE row_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'QTD_CALCULADA_POR_UNIDADES' ELSE 'QTD_FARDO_AUSENTE' END AS alerta, concat('71400', row_id % 50) AS matricula, '05/06/2024' AS data FROM f1_queue WHERE sku <> ''")
_TOTAL = 2**62  # a column that no store has: stores stand at customer numbers
over("agg_04_reconcile_rows", lambda x: sheets.reconcile_row(_totalled(x), 1, _TOTAL).drop("sheet"), "f7_cells", "WITH x AS MATERIALIZED (SELECT r, TRY_CAST(v AS BIGINT) AS n FROM f7_cells WHERE r >= 3 AND c > 1), g AS (SELECT r, CAST(sum(n) AS BIGINT) AS s FROM x GROUP BY 1) SELECT r, s AS soma, s + (CASE WHEN r % 5 = 0 THEN 1 ELSE 0 END) AS total, r % 5 <> 0 AS confere FROM g")


def _totalled(x: DataFrame) -> DataFrame:
    sums = x.filter("r >= 3 AND c > 1").groupBy("sheet", "r").agg((F.sum(F.col("v").cast("long")) + F.when(F.col("r") % 5 == 0, 1).otherwise(0)).cast("string").alias("v")).withColumn("c", F.lit(_TOTAL))
    return x.filter("r >= 3").select("sheet", "r", "c", "v").unionByName(sums.select("sheet", "r", "c", "v"))


over("srt_05_store_major", lambda x: sheets.store_major(sheets.unpivot_sku_store(x)).select("r", "c", "n"), "f7_cells", "WITH x AS MATERIALIZED (SELECT r, c, v FROM f7_cells), h AS (SELECT c FROM x WHERE r = 1 AND length(v) >= 6), s AS (SELECT r FROM x WHERE c = 1 AND r >= 3) SELECT x.r, x.c, row_number() OVER (ORDER BY x.c, x.r) AS n FROM x JOIN h USING (c) JOIN s USING (r) WHERE x.r >= 3 AND x.c > 1 AND TRY_CAST(x.v AS BIGINT) > 0")

# Lots
over("src_18_load_history", lambda h: tables.load_history(h.select("row_id", F.when(F.col("push") == 1, "").when(F.col("push") == 2, "PUSH_009").otherwise("").alias("push_meta"), F.when(F.col("row_id") % 2 == 0, F.col("pedido")).otherwise("").alias("pedido_meta"), F.concat(F.lit("lote/"), F.when(F.col("push") == 3, "PUSH_003/").otherwise(""), F.lit("PEDIDO_"), "pedido", F.lit("/x.parquet")).alias("caminho"))).select("row_id", "push", "pedido"), "f9_history", "SELECT row_id, CASE push WHEN 1 THEN 'PUSH_LEGADO' WHEN 2 THEN 'PUSH_009' ELSE 'PUSH_003' END AS push, pedido FROM f9_history")
over("srt_02_push_order", lambda h: h.select("row_id", F.when(F.col("row_id") % 3 == 0, "PUSH_LEGADO").when(F.col("row_id") % 3 == 1, F.concat(F.lit("PUSH_"), F.lpad(F.col("row_id") % 1000, 3, "0"))).otherwise(F.concat(F.lit("X"), "pedido")).alias("p")).withColumn("o", tables.push_order(F.col("p"))).select("row_id", F.col("o.k").alias("k"), F.col("o.n").alias("n"), F.col("o.s").alias("s")), "f9_history", "SELECT row_id, CASE row_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS k, CASE WHEN row_id % 3 = 1 THEN row_id % 1000 ELSE 0 END AS n, CASE WHEN row_id % 3 = 2 THEN concat('X', pedido) ELSE '' END AS s FROM f9_history")


def _lot_items(h: DataFrame) -> DataFrame:
    n = F.col("row_id")
    return h.select("row_id", "lote", "push", "arquivo", F.concat(F.lit("P"), n % 800).alias("pedido"), F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("7"), n % 50)).alias("matricula"), F.when(n % 17 == 0, "").otherwise(n.cast("string")).alias("sku"), (n % 6).alias("qtd"), F.concat(F.lit("L"), n % 9).alias("loja"), F.when(n % 29 == 0, "FALTA").when(n % 31 == 0, "TOTAL").otherwise("").alias("alerta"))


def _issues(h: DataFrame) -> DataFrame:
    return h.filter("row_id % 37 = 0").select("arquivo", F.concat(F.lit("P"), F.col("row_id") % 800).alias("pedido"), F.concat(F.lit("T"), F.col("row_id") % 4).alias("tipo"))


_LOT = "i AS (SELECT row_id, lote, arquivo, concat('P', row_id % 800) AS pedido, CASE WHEN row_id % 13 = 0 THEN '' ELSE concat('7', row_id % 50) END AS matricula, CASE WHEN row_id % 17 = 0 THEN '' ELSE CAST(row_id AS VARCHAR) END AS sku, row_id % 6 AS qtd, concat('L', row_id % 9) AS loja, CASE WHEN row_id % 29 = 0 THEN 'FALTA' WHEN row_id % 31 = 0 THEN 'TOTAL' ELSE '' END AS alerta FROM f9_history), s AS (SELECT concat('P', row_id % 800) AS pedido, concat('T', row_id % 4) AS tipo FROM f9_history WHERE row_id % 37 = 0), m AS (SELECT pedido FROM i GROUP BY 1 HAVING count(DISTINCT arquivo) > 1)"
over("flt_16_gated_lot_queue", lambda h: lots.gated_queue(_lot_items(h), _issues(h)), "f9_history", f"WITH {_LOT} SELECT row_id, pedido, CASE WHEN pedido IN (SELECT pedido FROM m) THEN 'PEDIDO_DUPLICADO' WHEN pedido IN (SELECT pedido FROM s) THEN 'PEDIDO_COM_ALERTA' WHEN matricula = '' OR sku = '' OR qtd <= 0 THEN 'LINHA_INCOMPLETA' ELSE '' END AS alerta FROM i")
over("j_14_without_alerted", lambda h: lots.without_alerted(_lot_items(h), _issues(h)).select("row_id"), "f9_history", f"WITH {_LOT} SELECT row_id FROM i WHERE pedido NOT IN (SELECT pedido FROM s)")
over("agg_16_issue_counts", lambda h: lots.issue_counts(_issues(h)), "f9_history", f"WITH {_LOT}, g AS (SELECT tipo, count(*) AS n FROM s GROUP BY 1) SELECT tipo, n, row_number() OVER (ORDER BY n DESC, tipo) AS posicao FROM g")
over("set_09_duplicate_mirror", lambda h: lots.duplicate_mirror(_lot_items(h)).select("row_id", "pedido"), "f9_history", f"WITH {_LOT} SELECT row_id, pedido FROM i WHERE pedido IN (SELECT pedido FROM m)")
over("agg_18_lot_success", lambda h: lots.lot_success(_lot_items(h).select("lote", "arquivo", F.col("qtd").alias("itens"), "pedido", F.col("sku").alias("cnpj"), "matricula")), "f9_history", f"WITH {_LOT} SELECT lote, count(*) AS arquivos, CAST(sum(qtd) AS BIGINT) AS itens, count(*) FILTER (qtd > 0 AND sku <> '' AND matricula <> '') AS sucesso FROM i GROUP BY 1")
over("set_02_consolidated_lots", lambda h: lots.consolidated(h.select("arquivo", F.when(F.col("row_id") % 5 == 0, "Layout generico").otherwise(F.concat(F.lit("REDE "), "pedido")).alias("layout_usado")).withColumn("layout_referencia", F.when(F.length("arquivo") % 2 == 0, F.col("layout_usado")).otherwise(F.when(F.col("layout_usado") == "REDE 7", "outro").otherwise(F.col("layout_usado"))))), "f9_history", "WITH x AS (SELECT arquivo, CASE WHEN row_id % 5 = 0 THEN 'Layout generico' ELSE concat('REDE ', pedido) END AS l FROM f9_history) SELECT l AS layout_usado, count(DISTINCT arquivo) AS arquivos, CASE WHEN count(DISTINCT arquivo) > 1 AND l <> 'Layout generico' AND NOT bool_or(l = 'REDE 7' AND length(arquivo) % 2 = 1) THEN 'LOTE' ELSE 'ARQUIVO' END AS modo FROM x GROUP BY 1")
over("set_03_first_of_extractors", lambda h: tables.first_rows(_lot_items(h).select("row_id", "push", "loja", "qtd"), ["loja", "qtd"], ["push", "row_id"]), "f9_history", "SELECT row_id, push, loja, qtd FROM (SELECT row_id, push, concat('L', row_id % 9) AS loja, row_id % 6 AS qtd, row_number() OVER (PARTITION BY row_id % 9, row_id % 6 ORDER BY push, row_id) AS n FROM f9_history) WHERE n = 1")
over("set_07_stores", lambda h: _lot_items(h).select("loja").distinct(), "f9_history", "SELECT DISTINCT concat('L', row_id % 9) AS loja FROM f9_history")
over("pipe_05_process_lot", lambda x, g, h: lot.process_lot(x, g.select("row_id", F.concat(F.lit("12345"), F.lpad(F.col("row_id") % 1000, 3, "0"), F.lit("0001"), F.lpad(F.col("row_id") % 97, 2, "0")).alias("cnpj"), "matricula"), h.select(F.col("row_id").cast("string").alias("pedido"))), "f6_lines f3_gln f9_history", f"""WITH x AS (SELECT *, {_CTX.format(_ORDER)} AS pedido, regexp_replace({_CTX.format(_CNPJ)}, '[^0-9]', '', 'g') AS cnpj FROM f6_lines), i AS (SELECT file, line_no, pedido, line[1:6] AS sku, CAST(regexp_extract(line, '{_ITEM}', 5) AS BIGINT) AS qtd, cnpj FROM x WHERE regexp_full_match(line, '{_ITEM}')),
g AS (SELECT concat('12345', lpad(CAST(row_id % 1000 AS VARCHAR), 3, '0'), '0001', lpad(CAST(row_id % 97 AS VARCHAR), 2, '0')) AS cnpj, min(matricula) AS m FROM f3_gln GROUP BY 1 HAVING count(DISTINCT matricula) = 1), r AS (SELECT pedido FROM i GROUP BY 1 HAVING count(DISTINCT file) > 1)
SELECT i.*, coalesce(m, '') AS matricula, pedido IN (SELECT pedido FROM r) AS repetido, pedido IN (SELECT CAST(row_id AS VARCHAR) FROM f9_history) AS no_historico FROM i LEFT JOIN g USING (cnpj)""")
