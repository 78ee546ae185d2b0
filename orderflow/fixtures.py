"""Views over the test tables that stand for order inputs: one SQL text for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fixtures_layouts import layout_lines

_ROWS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey,l_suppkey,l_linenumber,l_extendedprice,l_quantity,l_shipdate) AS rn FROM lineitem) li JOIN orders ON l_orderkey=o_orderkey"
_DAY = "concat(lpad(CAST(day(o_orderdate) AS STRING),2,'0'),'/',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'/',CAST(year(o_orderdate) AS STRING))"

VIEWS = {
    "f1_queue": f"""SELECT row_id,
 CASE WHEN k=0 THEN '' WHEN k=11 THEN concat(cust,'.0') ELSE cust END AS matricula,
 CASE WHEN k=1 THEN '' WHEN k=10 THEN concat('900000000',lpad(part,6,'0')) ELSE part END AS sku,
 CASE WHEN k=2 THEN 'abc' WHEN k=3 THEN '' WHEN k=8 THEN '0,5' WHEN k=9 THEN '1.234,56' WHEN k=12 THEN '-3' ELSE qty END AS qtd,
 CASE WHEN k=6 THEN '' WHEN k=7 THEN '.' WHEN k=13 THEN concat('AB-',ord) ELSE ord END AS pedido,
 CASE WHEN k=4 THEN '31/02/1997' WHEN k=5 THEN '' WHEN k=14 THEN replace(dt,'/','.') ELSE dt END AS data_remessa
FROM (SELECT l_orderkey*1000+rn AS row_id, (l_orderkey*31+l_partkey*7+l_suppkey)%97 AS k,
  CAST(o_custkey AS STRING) AS cust, CAST(l_partkey AS STRING) AS part, CAST(l_orderkey AS STRING) AS ord,
  CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty, {_DAY} AS dt FROM {_ROWS}) x""",
    "f2_xref": """SELECT c_custkey AS row_id, c_mktsegment AS rede,
 CASE WHEN c_custkey%5=0 THEN lpad(CAST(c_custkey+100000 AS STRING),13,'7') ELSE lpad(CAST(c_custkey+1000000 AS STRING),14,'0') END AS chave_lida,
 lpad(CAST(c_custkey+1000000 AS STRING),14,'0') AS cnpj_oficial,
 CASE WHEN c_custkey%17=0 THEN '' ELSE CAST(7120000000+c_custkey AS STRING) END AS matricula,
 CASE WHEN c_custkey%23=0 THEN 'INATIVO' ELSE 'ATIVO' END AS status FROM customer""",
    "f3_gln": """SELECT c_custkey AS row_id, CAST(c_custkey AS STRING) AS matricula, lpad(CAST(c_custkey+789000000 AS STRING),13,'0') AS gln,
 lpad(CAST(CASE WHEN c_custkey%50=1 THEN c_custkey-1 ELSE c_custkey END +1000000 AS STRING),14,'0') AS cnpj FROM customer WHERE c_custkey%29<>0""",
    "f4_map": """SELECT p_partkey*10+c AS row_id, concat('C',CAST(c AS STRING)) AS centro, concat('789',lpad(CAST(p_partkey AS STRING),10,'0')) AS ean,
 concat('1789',lpad(CAST(p_partkey AS STRING),10,'0')) AS dun, CAST(p_partkey AS STRING) AS sku, upper(p_name) AS descricao,
 CASE WHEN p_partkey%40=c THEN 0 WHEN p_partkey%9=0 AND c=2 THEN 24 WHEN p_size<=25 THEN 6 ELSE 12 END AS apresentacao
FROM part CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) y""",
    "f6_lines": f"""SELECT file, CAST(1 AS BIGINT) AS page, line_no, line FROM (
 SELECT concat('doc',CAST(o_custkey AS STRING)) AS file, o_orderkey*1000 AS line_no, concat('PEDIDO DE COMPRAS ',CAST(o_orderkey+1000 AS STRING),'/L') AS line FROM orders
 UNION ALL SELECT concat('doc',CAST(o_custkey AS STRING)), o_orderkey*1000+1, concat('CNPJ 12.345.',lpad(CAST(o_custkey%1000 AS STRING),3,'0'),'/0001-',lpad(CAST(o_custkey%97 AS STRING),2,'0')) FROM orders WHERE o_orderkey%6<>0
 UNION ALL SELECT concat('doc',CAST(o_custkey AS STRING)), o_orderkey*1000+10+rn,
   CASE WHEN rn%11=0 THEN concat(lpad(CAST(l_partkey+10000 AS STRING),6,'0'),' LINHA QUEBRADA')
        ELSE concat(lpad(CAST(l_partkey+10000 AS STRING),6,'0'),' ',CAST(rn AS STRING),' ITEM CX 6 ',CAST(CAST(l_quantity AS BIGINT) AS STRING),',00 1,2345') END FROM {_ROWS}
 UNION ALL SELECT concat('doc',CAST(o_custkey AS STRING)), o_orderkey*1000+900, concat('TOTAIS ',CAST(t + CASE WHEN o_orderkey%8=0 THEN 1 ELSE 0 END AS STRING),',00')
  FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS t FROM lineitem GROUP BY l_orderkey) g JOIN orders ON l_orderkey=o_orderkey WHERE o_orderkey%10<>0) z""",
    "f5_rules": """SELECT * FROM (VALUES
 (1,'NET ONE PDF','1','','','','','','BASE_PRIORITARIA','NAO',1),
 (2,'NET ONE PDF','1','C0','','','','','MAPA_PRODUTOS_FALLBACK','SIM',2),
 (3,'NET TWO PDF','2','','','','','','SEM_CONVERSAO','NAO',100),
 (4,'NET THREE PDF','3','C1','','','','','MAPA_PRODUTOS','SIM',10),
 (5,'NET THREE PDF','3','C1','7890000000042','','','6','EAN_FATOR_FIXO','NAO',1),
 (6,'NET FOUR PDF','4','','','','GREEN','4','SKU_EAN_FATOR_FIXO','NAO',5)
) AS t(regra_id,rede_layout,layout_id,centro,ean,sku,descricao,fator,tipo_regra,usa_mapa,prioridade)""",
    "f7_cells": """SELECT 'matrix' AS file, 'S1' AS sheet, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, v FROM (
 SELECT 1 AS r, c_custkey+2 AS c, CAST(7140000000+c_custkey AS STRING) AS v FROM customer
 UNION ALL SELECT 2, 1, 'SKU'
 UNION ALL SELECT l_partkey+3, 1, CAST(l_partkey AS STRING) FROM (SELECT DISTINCT l_partkey FROM lineitem) p
 UNION ALL SELECT l_partkey+3, o_custkey+2, CASE WHEN min(l_quantity)<3 THEN '0' ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS STRING) END
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_partkey,o_custkey) z""",
    "f8_words": f"""SELECT concat('doc',CAST(o_custkey AS STRING)) AS file, o_orderkey AS page, CAST(rn*12 + tok*0.5 AS DOUBLE) AS top, x0, x0+20 AS x1, txt AS text FROM (
 SELECT o_custkey,o_orderkey,rn,0 AS tok,CAST(10.0 AS DOUBLE) AS x0,CAST(l_partkey+10000 AS STRING) AS txt FROM {_ROWS}
 UNION ALL SELECT o_custkey,o_orderkey,rn,1,CAST(120.0 AS DOUBLE),'ITEM' FROM {_ROWS}
 UNION ALL SELECT o_custkey,o_orderkey,rn,2,CAST(285.0 + l_partkey%30 AS DOUBLE),CAST(CAST(l_quantity AS BIGINT) AS STRING) FROM {_ROWS}) w""",
    "f9_history": """SELECT o_orderkey AS row_id, CAST(o_orderkey%400 AS STRING) AS pedido, concat('f',CAST(o_orderkey AS STRING),'.pdf') AS arquivo,
 CAST(1+o_orderkey%3 AS BIGINT) AS push, concat(CAST(year(o_orderdate) AS STRING),'-',lpad(CAST(month(o_orderdate) AS STRING),2,'0')) AS lote FROM orders""",
    "f10_ship": """SELECT event_id AS row_id, CAST(user_id AS STRING) AS matricula, CAST(event_id%60 AS STRING) AS pedido,
 CASE WHEN event_id%4=0 THEN 'PR' WHEN event_id%4=1 THEN 'SC' WHEN event_id%4=2 THEN 'SP' ELSE 'RS' END AS regional,
 CASE WHEN event_type='error' THEN '' ELSE concat(lpad(CAST(day(ts) AS STRING),2,'0'),'/01/2024') END AS data_remessa FROM events""",
    "f11_values": f"""SELECT row_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '*' WHEN 3 THEN 'abc' WHEN 4 THEN concat('R$ ',n,',50') WHEN 5 THEN concat('1.',p3) WHEN 6 THEN concat('1.',p3,',25')
  WHEN 7 THEN concat(n,',',p3) WHEN 8 THEN concat(n,'.5') WHEN 9 THEN concat('-',n) WHEN 10 THEN '0' WHEN 11 THEN concat(n,',00') WHEN 12 THEN concat(n,' CX') WHEN 13 THEN concat(n,',',p3,'7')
  WHEN 14 THEN concat('10',n,'.',p3) WHEN 15 THEN concat('12.345.',p3) WHEN 16 THEN concat(n,',5') WHEN 17 THEN concat(n,'.0') WHEN 18 THEN '1,7E+09' ELSE n END AS num,
 CASE k WHEN 0 THEN '' WHEN 1 THEN cust WHEN 2 THEN lpad(cust,13,'7') WHEN 3 THEN lpad(cust,14,'0') WHEN 4 THEN lpad(cust,12,'3') WHEN 5 THEN lpad(cust,15,'9') WHEN 6 THEN concat('Loja ',p3)
  WHEN 7 THEN concat('12.345.',p3,'/0001-77') WHEN 8 THEN lpad(cust,8,'5') WHEN 9 THEN concat('000',lpad(cust,7,'4')) WHEN 10 THEN 'Loja Centro-Sul' ELSE lpad(cust,10,'1') END AS code,
 CASE k WHEN 0 THEN '' WHEN 1 THEN concat('São José – Distribuição ',n) WHEN 2 THEN '  Rede   Íris  PDF ' WHEN 3 THEN concat('layout excel NORTE ',n) WHEN 4 THEN 'CTBA' WHEN 5 THEN 'sp - hortolândia'
  WHEN 6 THEN 'Porto Alegre' WHEN 7 THEN concat('pão|leite; de casa,,pão',n) WHEN 8 THEN 'Ação-Çedilha ÑANDÚ' WHEN 9 THEN concat('Página ',n,' sem texto | linha ',p3,' | x') WHEN 10 THEN concat('A very long name of a file that goes on and on ',cust)
  WHEN 11 THEN concat('Pedido_0',p3,'41_NOME ',n,'.xlsx') ELSE nm END AS phrase,
 CASE k WHEN 0 THEN '' WHEN 1 THEN concat(d,'.',m,'.',y) WHEN 2 THEN concat(d,'/',m,'/',y) WHEN 3 THEN concat(y,'-',m,'-',d) WHEN 4 THEN concat(d,'-',m,'-',y) WHEN 5 THEN concat(d,m,y) WHEN 6 THEN concat(d,'/',m,'/',substring(y,3,2))
  WHEN 7 THEN concat('Entrega ',d,'/',m,'/',substring(y,3,2),' cedo') WHEN 8 THEN concat('44',p3) WHEN 9 THEN '31/02/2024' WHEN 10 THEN 'segunda' ELSE concat(d,'/',m,'/',y) END AS dia,
 CASE k%4 WHEN 0 THEN concat('<p>Olá ',n,'</p><br>SKU&nbsp;',p3,' &amp; mais<style>x{{}}</style>') WHEN 1 THEN concat('CNPJ 12.345.',p3,'/0001-77 e 7',lpad(cust,9,'2'),' fim') WHEN 2 THEN concat('doc -77 12.345.',p3,'/0001 loja') ELSE concat('sem numero ',n) END AS corpo,
 concat('{{"arquivo":"',CASE WHEN k%3=0 THEN '' ELSE concat('a',n,'.pdf') END,'","nome_original":"o',p3,'.pdf","assunto":"Pedido ',cust,'"}}') AS meta
FROM (SELECT l_orderkey*1000+rn AS row_id, (l_orderkey*13+l_partkey*5+l_suppkey)%23 AS k, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS n, lpad(CAST(l_partkey%1000 AS STRING),3,'0') AS p3, CAST(o_custkey AS STRING) AS cust, o_orderpriority AS nm,
  lpad(CAST(day(o_orderdate) AS STRING),2,'0') AS d, lpad(CAST(month(o_orderdate) AS STRING),2,'0') AS m, CAST(year(o_orderdate) AS STRING) AS y FROM {_ROWS}) z""",
    "f12_items": f"""SELECT row_id, CASE WHEN k IN (0,1,30) THEN '' WHEN k=2 THEN '123' ELSE lpad(CAST(cust+1000000 AS STRING),14,'0') END AS cnpj_lido, CASE WHEN k=1 THEN lpad(CAST(cust AS STRING),13,'7') ELSE '' END AS gln_lido,
 CASE WHEN k=30 THEN concat('L',CAST(cust AS STRING)) ELSE '' END AS codigo_loja_lido, CASE WHEN k IN (0,1) THEN '' WHEN k=2 THEN '99' WHEN k%3=0 THEN CAST(7120000000+cust AS STRING) ELSE '' END AS matricula_lida,
 CASE WHEN k IN (3,6) THEN '' WHEN k=4 THEN concat('789',lpad(CAST(part AS STRING),10,'0')) WHEN k=5 THEN lpad(CAST(part AS STRING),8,'2') ELSE CAST(part+100000 AS STRING) END AS sku_lido,
 CASE WHEN k=6 THEN concat('789',lpad(CAST(part AS STRING),10,'0')) WHEN k=7 THEN '12345' ELSE '' END AS ean_lido,
 CASE k WHEN 8 THEN '' WHEN 9 THEN 'abc' WHEN 10 THEN '-3' WHEN 11 THEN '2,4733' WHEN 12 THEN '1.320' WHEN 13 THEN '12,50' ELSE qty END AS quantidade_lida,
 CASE k WHEN 14 THEN '' WHEN 15 THEN '.' WHEN 16 THEN '12' WHEN 17 THEN lpad(CAST(cust+1000000 AS STRING),14,'0') WHEN 18 THEN CAST(part+100000 AS STRING) ELSE CAST(ord+100000 AS STRING) END AS numero_pedido_lido,
 CASE k WHEN 25 THEN '' WHEN 26 THEN '31/02/2024' ELSE {_DAY} END AS data_entrega_lida, CASE k WHEN 19 THEN 'ALERTA_LEITURA' WHEN 20 THEN 'PENDENTE' WHEN 21 THEN 'ALERTA' ELSE '' END AS status_extracao,
 CASE k WHEN 19 THEN 'RASTREABILIDADE_LAYOUT | REF_DIFERENTE_DO_COD_FORN_MANTIDO_COMO_AUDITORIA' WHEN 20 THEN 'ERRO leitura' WHEN 21 THEN 'RASTREABILIDADE_LAYOUT conferir' ELSE '' END AS alerta_extracao,
 CASE ord%3 WHEN 0 THEN 'REDE ÚM PDF' WHEN 1 THEN 'REDE DOIS' ELSE 'RASTREABILIDADE -> REDE UM' END AS layout_usado,
 CASE k WHEN 22 THEN 'VALIDAR CONVERSAO' WHEN 23 THEN 'OK CONVERTIDO' WHEN 24 THEN 'ALERTA - NÃO CONVERTIDO' WHEN 27 THEN 'OK - SEM CONVERSÃO' WHEN 28 THEN 'outro NAO_CONVERTIDO' ELSE '' END AS status_conversao,
 CASE cust%4 WHEN 0 THEN 'PR' WHEN 1 THEN 'SC' WHEN 2 THEN 'SP' ELSE 'RS' END AS regional
FROM (SELECT l_orderkey*1000+rn AS row_id, (l_orderkey*17+l_partkey*3+l_suppkey)%37 AS k, o_custkey AS cust, l_partkey AS part, l_orderkey AS ord, o_orderdate, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty FROM {_ROWS}) z""",
    "f13_lot": f"""SELECT concat('lote',CAST(ord+100000 AS STRING),'.pdf') AS file, CAST(page AS BIGINT) AS page, CAST(line_no AS BIGINT) AS line_no, line FROM (
 SELECT o_orderkey AS ord, 1 AS page, h.k AS line_no, CASE h.k WHEN 1 THEN CASE o_orderkey%6 WHEN 0 THEN concat('P E D I D O   D E  C O M P R A: ',CAST(o_orderkey+100000 AS STRING)) WHEN 1 THEN concat('Número do Pedido: ',CAST(o_orderkey+100000 AS STRING)) WHEN 2 THEN concat('Nº Pedido : ',CAST(o_orderkey+100000 AS STRING))
   WHEN 3 THEN concat('Pedido - ',CAST(o_orderkey%9000+100000 AS STRING)) WHEN 4 THEN 'Pedido: 100007' ELSE 'sem numero' END
  WHEN 2 THEN CASE o_orderkey%5 WHEN 0 THEN 'Entrega na loja' ELSE concat('Local de Entrega: ',CAST(o_custkey%300 AS STRING),' - LOJA ',CAST(o_custkey AS STRING)) END
  WHEN 3 THEN CASE WHEN o_orderkey%7=0 THEN 'CNPJ em branco' ELSE concat('CNPJ: ',substring(c14,1,2),'.',substring(c14,3,3),'.',substring(c14,6,3),'/',substring(c14,9,4),'-',substring(c14,13,2)) END
  WHEN 4 THEN 'I.E.: 0621234567' WHEN 5 THEN 'Assinatura Fornecedor' WHEN 10 THEN 'Produto  Descrição Unidade Preço Normal Quantidade Valor Total' WHEN 500 THEN 'Total Pedido 99,00' ELSE '12345 FORA DA TABELA' END AS line
 FROM (SELECT *, lpad(CAST(o_custkey+1000000 AS STRING),14,'0') AS c14 FROM orders) o CROSS JOIN (VALUES (1),(2),(3),(4),(5),(10),(500),(501)) AS h(k)
 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey%2=1 THEN 2 ELSE 1 END, h.k, CASE WHEN h.k=900 THEN 'Totais 1' WHEN o_orderkey%2=1 THEN 'Folha 2' WHEN o_orderkey%4=0 THEN 'Código Cod Barras Cod Forn Descrição Qtde Emb Quant Emb' ELSE 'Código Cod Barras Descrição Marca Quant Pr Unit Vl Total Cod Forn' END
 FROM orders CROSS JOIN (VALUES (510),(900)) AS h(k)
 UNION ALL SELECT o_orderkey, CASE WHEN rn%2=0 AND o_orderkey%2=1 THEN 2 ELSE 1 END, CASE WHEN rn%2=0 THEN 510 ELSE 10 END + rn,
  CASE WHEN rn%2=1 THEN CASE (l_orderkey*31+l_partkey*7+rn)%9 WHEN 0 THEN concat(part,'  SUCO 2L  CX C/ 12 3,5000 ',qty,',000 84,00') WHEN 1 THEN concat(part,' SUCO 2L 3,5000 1.',p3,',000 CX C/12 84,00') WHEN 2 THEN concat(part,' SUCO CX/12 10 ',qty,' 99')
    WHEN 3 THEN concat(part,' SUCO 2 L 3,50 ',qty,',00 FD C/6') WHEN 4 THEN concat(part,' SUCO FD/6 3,5000 ',qty,',500 84,00') WHEN 5 THEN concat(part,' SUCO SEM UNIDADE') WHEN 6 THEN 'continua a descrição' WHEN 7 THEN concat(part,' SUCO fd 6 3,50 ',qty,',00 84,00') ELSE concat(part,' 5 ',qty,' CX6') END
  ELSE CASE (l_orderkey*17+l_partkey*3+rn)%8 WHEN 0 THEN concat('1784412 7894900087000 ',part,' REFRI LATA ',qty,' 80,000 FD/2 6,2300 149,52') WHEN 1 THEN concat('1784412 7894900087000 ',part,' REFRI ',qty,' FD/2 80,000 6,2300 149,52') WHEN 2 THEN concat('1784412 7894900087000 ',part,' REFRI ',qty,',000 6,2300 149,52')
    WHEN 3 THEN concat('1784412 7894900087000 REFRI LATA MARCA ',qty,',000 6,23 149,52 ',part) WHEN 4 THEN concat('1784412 7894900087000 A B C D ',CAST(rn AS STRING)) WHEN 5 THEN concat('1784412 7894900087000 X ',qty) WHEN 6 THEN concat('1784412 7894900087000 REFRI LATA MARCA ',qty,',250 6,23 149,52 9;',part,',12') ELSE concat('178441 7894900087000 ',part,' REFRI UN CX C/12 10,00 ',qty,',000 7,00') END END
 FROM (SELECT *, lpad(CAST(l_partkey%90000+10000 AS STRING),5,'0') AS part, lpad(CAST(l_partkey%1000 AS STRING),3,'0') AS p3, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty FROM {_ROWS}) w) z""",
}
VIEWS["f14_lines"] = layout_lines(_ROWS)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in ("lineitem", "orders", "customer", "part", "events"):
        if table in VIEWS[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def ctes(sql: str) -> str:
    """sql, with each view that it names as a table expression before it."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql]
    if not used:
        return sql
    return f"WITH {', '.join(used)}{', ' if sql.startswith('WITH ') else ' '}{sql.removeprefix('WITH ')}"
