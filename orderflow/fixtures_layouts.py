"""Lines of documents of many layouts, made of orders: a template for each kind of line, filled in by SQL that Spark and the oracle share.

{o} order, {c} and {s} company numbers of the customer and the supplier, {d} day, {p} article, {e} bar code, {q} quantity.
"""

from __future__ import annotations

from .sources.layout_rules import RULES

#: By layout: head lines, lines of items by turns, what follows some of them, and last lines.
LINES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "PADRAO": (("PEDIDO DE COMPRAS {o}/L", "CNPJ {c}"), ("0{p} 3 ITEM X CX 6 {q},00 1,2345", "0{p} LINHA QUEBRADA", "0{p} 7 ITEM   Y CX 12 {q},00 9,2345", "nota"), ("", "", "", ""), ("TOTAIS {q},00",)),
    "COASUL": (("ORDEM Nº: {o}", "DADOS PARA FATURAMENTO", "CNPJ {c}", "EMPRESA.: CNPJ {s}"), ("1 {e} AGUA COM GAS UN {q}.5 2.50 {q}.00", "2 {e} SUCO FARDO {q} 2,50 99,00", "3 {e} SEM NADA", "outra linha"), ("", "", "", ""), ("Total 1",)),
    "BOZZA": (("Numero Pedido: {o}", "CNPJ/CPF : {c}", "Dt Entrega: {d}"), ("10 {p} {e} REFRI LATA {q},00 1.234,50 2,50 99,00", "11 {p} {e} AGUA 0 1 2,50 99,00", "12 {p} {e} QUEBRADA", "Protocolo: 7"), ("", "", "", ""), ("fim",)),
    "MONACO": (("Numero do Pedido: {o}", "Empresa: CNPJ {s}", "CNPJ {c} loja"), ("{p} {e} 9{p};8{p} REFRI LATA {q} 80,000 FD/2 6,23", "{p} {e} 9{p} AGUA {q} 1.080,000 CX/12 6,23", "{p} {e} SEM FIM", "texto"), ("", "", "", ""), ("Totais",)),
    "DAHER": (("Pedido de Compras N° {o}", "CNPJ: {c}", "Destinatário: NOS CNPJ: {s}", "EAN Descrição PLU Ref. Emb. Qtd. Valor"), ("{e} REFRI 12345 {p} CX12 {q} R$ 9,00", "{e} SUCO UVA 123 {p} UN {q},5 R$ 9,00", "{e} LINHA RUIM", "{p} sem ean"), ("", "", "", ""), ("Total: 99,00", "{e} DEPOIS 123 {p} UN 4 R$ 9,00")),
    "PRIMATO": (("MERC - PEDIDO DE COMPRA Nº {o}", "CNPJ: {s} outro", "CNPJ : {c} IE : 123"), ("{p} {e} REFRI COLA {q},00 C/ 12 2,50 0,00 1.299,00", "{p} {e} AGUA 1.{q}0,00 C/6 2,50 0,00 99,00", "{p} {e} RUIM {q},00", "rodape"), ("", "", "", ""), ("Total",)),
    "SUPERLAR": (("NR PEDIDO: {o}", "CNPJ: {s}", "CNPJ: {c}"), ("{p} REFRI 473ML{e} CX/0006 0000000{p} {q} 2,4733 9,00", "{p} AGUA {e} FD/0012 {p} {q},5 6,0917", "{p} SUCO {e} CX/0006 {p} 2,4733 9,00 1", "TOTAIS {p} X {e} CX/0006 {p} 3 2,50"), ("", "", "", ""), ("PESO BRUTO 7",)),
    "INDIANA": (("Numero Pedido: {o}", "CNPJ {c}"), ("{p} REFRI 2L {q} 0,0000 9,00", "{p} AGUA 0 0,0000 1", "{p} SEM QUANTIDADE", "x"), ("", "", "", ""), ("Total",)),
    "KACULA": (("{o} / L", "CNPJ {s} CNPJ {c}"), ("{p} REFRI LATA", "{p} AGUA {q},00", "EAN {e} 7,00", "sobra 5,00"), ("preco {q},00 e 3,00", "", "", ""), ("Total 9,00",)),
    "GALASSI": (("Pedido : {o}-1", "CNPJ: {c}"), ("REFRI LATA CX/00012 {p} {q} 2,50 1", "REFRI 2L FD/00006 12345 {q} 2,50 1", "AGUA PT/00012 {p} 0 2,50", "linha"), ("", "", "", ""), ("Total",)),
    "FESTIVAL": (("PEDIDO DE COMPRAS {o} / L", "{s} fornecedor", "{c} cliente", "Previsão de entrega {d}"), ("{p} 12 REFRI CX 12 {q},50 9,00", "{p}7REFRI COLADO FD 6 1.{q}0,00 9", "12345 REPETIDA UN 1 7,00", "{p} SEM QUANTIDADE"), ("", "", "", ""), ("fim",)),
    "DROGA CLARA": (("Numero Pedido: {o}", "Filial: 12 {c}"), ("{p} REFRI LATA UN 1 x 12 {q} 2,5000 9", "12345 AGUA CX 1 x 6 {q} 2.5000", "{p} RUIM", "nada"), ("", "", "", ""), ("Total",)),
    "SUPERMAIS": (("ORDEM DE COMPRA Nº {o}", "{s}", "{c}"), ("1{p} {p} {e} CX 12 REFRI {q} 1.240,000 R$ 9", "1{p} {p} {e} FD 6,0 AGUA {q},5 240,000 $", "1{p} {p} {e} RUIM", "linha"), ("", "", "", ""), ("Total",)),
    "PANELAO": (("PEDIDO DE COMPRA : {o}", "{s} {c}", "ENTREGA / RETIRADA : dia {d}"), ("1 {p} REFRI LATA 1{p} {e} 22021000 CX / 12 {q} 240 9,00", "2 {p} AGUA 1{p} {e} 22021000 FD/6 {q},5 30 9", "3 {p} RUIM 1{p} {e} 22021000 X", "linha"), ("", "", "", ""), ("Total",)),
    "CAITA": (("NUMERO DO PEDIDO : {o}", "{s} {c}", "PREVISAO DE ENTREGA : {d}"), ("1{p} {e} {p} REFRI LATA {q} 12 240 2,50 9", "1{p} {e} {p} AGUA {q},5 6 30,0 1.002,5000", "1{p} {e} {p} RUIM", "linha"), ("", "", "", ""), ("Total",)),
    "SEMPRE VALE": (("PEDIDO DE COMPRAS {o} / A", "CNPJ {s}", "CNPJ {c}"), ("{p} 12 REFRI LATA {q},00 2,5000 9", "{p} AGUA SEM CODIGO {q},00 2,5000", "{p} RUIM", "EANs: {e}"), ("", "", "", ""), ("TOTAIS {q},00",)),
    "BARRACAO": (("Número do Pedido: {o}", "Empresa: CNPJ: {s}", "CNPJ: {c}", "Dt. Entrega: {d}"), ("10 {e} {p} REFRI LATA 240,000 {q} CX/12 9", "11 {e} AGUA MARCA 1.240,000 {q} FD/6 9", "12 {e} RUIM", "13 {e} {p} ZERO 0,000 0 CX/1 9"), ("", "", "", ""), ("Total",)),
    "BAKLIZI": (("PEDIDO DE COMPRAS {o} / B", "{s}", "{c}"), ("{p} 7 REFRI LATA CX 12 {q},00 2,5000", "123 AGUA UN 1 {q},00 2,5000", "{p} SUCO CX 12 7,00 2,5000", "123 CHA PC 6 {q},00 2,5000"), ("REF: 7777", "REF: 8888", "REF: {p}", "EANs: {e}"), ("TOTAIS {q},00",)),
    "TISCHLER": (("Número do pedido: {o}", "Previsão de entrega: {d}", "ENDERECO DE ENTREGA CNPJ: {c}"), ("1{p} {e} {p} AGUA 06 {q} 48,000 2,61 125,28 2,61", "1{p} {e} {p} SUCO QUEBRADO", "1{p} {e} CHA 8 48,000 2,61", "linha"), ("", "06 {q} 48,000 2,61 1.125,28 2,61", "", ""), ("TROCAS DO FORNECEDOR", "1{p} {e} {p} TROCA 06 {q} 48,000 2,61 125,28 2,61", "TOTAL DAS TROCAS", "1{p} {e} {p} DEPOIS 06 {q} 48,000 2,61 125,28 2,61")),
    "MABY": (("Pedido : {o}", "CNPJ da Empresa: {c}"), ("{p} {e} REFRI LATA {q} CX 12 2,50 30,00 0 1.360,00", "{p} AGUA MINERAL {q},0 FD 6 2,50 30,00 0 360,00", "{p} {e} RUIM", "linha"), ("", "", "", ""), ("Total",)),
    "MILLER": (("Número do pedido: {o}", "CNPJ: {s}", "ENDERECO DE ENTREGA CNPJ: {c}", "Previsão de entrega: {d}"), ("{p} REFRI {e} 1 - CX 12 {q} - CX 9", "{p} AGUA 78912345 {q} - CX", "{p} SEM EAN {q} - CX", "12345 REFRI 7890000000001 2 - CX"), ("", "", "", ""), ("Total",)),
}


def layout_lines(rows: str) -> str:
    """SQL of file, page, line_no, layout, line; rows: what joins numbered items with orders.

    An order's items stand on two pages, of which the second has the order's head again in every second file. Files without a customer's number are among them.
    """
    templates = []
    for n, rule in enumerate(RULES):
        head, items, after, last = LINES[rule.layout]
        templates += [(n, "H", k, t) for k, t in enumerate(head)] + [(n, "I", k, t) for k, t in enumerate(items)] + [(n, "J", k, t) for k, t in enumerate(after) if t] + [(n, "F", k, t) for k, t in enumerate(last)]
    values = ", ".join(f"({n}, '{part}', {k}, '{t}')" for n, part, k, t in templates)
    names = ", ".join(f"({n}, '{rule.layout}')" for n, rule in enumerate(RULES))
    count = len(RULES)
    filled = "replace(replace(replace(replace(replace(replace(replace(t,'{o}',ord),'{c}',cnpj),'{s}','61.186.888/0001-93'),'{d}',dia),'{p}',part),'{e}',ean),'{q}',qtd)"
    mask = "CASE WHEN o_orderkey%13=0 THEN 'sem numero' ELSE concat('12.345.',lpad(CAST(o_custkey%1000 AS STRING),3,'0'),'/0001-',lpad(CAST(o_custkey%97 AS STRING),2,'0')) END AS cnpj"
    day = "concat(lpad(CAST(day(o_orderdate) AS STRING),2,'0'),'/',lpad(CAST(month(o_orderdate) AS STRING),2,'0'),'/',CAST(year(o_orderdate) AS STRING)) AS dia"
    order = f"o_orderkey, o_orderkey%{count} AS l, concat('arq',CAST(o_orderkey AS STRING)) AS file, CAST(o_orderkey+100000 AS STRING) AS ord, {mask}, {day}"
    return f"""SELECT file, CAST(page AS BIGINT) AS page, CAST(line_no AS BIGINT) AS line_no, layout, {filled} AS line FROM (
 SELECT {order}, CAST(10000+o_custkey%80000 AS STRING) AS part, concat('789',lpad(CAST(o_custkey AS STRING),10,'0')) AS ean, CAST(1+o_orderkey%40 AS STRING) AS qtd, p.page, CASE WHEN t.part='H' THEN t.k ELSE 9000+t.k END AS line_no, t.t
  FROM orders CROSS JOIN (VALUES (1),(2)) AS p(page) JOIN (VALUES {values}) AS t(l,part,k,t) ON t.l=o_orderkey%{count} AND ((t.part='H' AND (p.page=1 OR o_orderkey%2=0)) OR (t.part='F' AND p.page=2))
 UNION ALL
 SELECT {order}, CAST(10000+l_partkey%80000 AS STRING), concat('789',lpad(CAST(l_partkey AS STRING),10,'0')), CAST(CAST(l_quantity AS BIGINT) AS STRING), CASE WHEN rn>3 THEN 2 ELSE 1 END, rn*10+CASE WHEN t.part='J' THEN 11 ELSE 10 END, t.t
  FROM {rows} JOIN (VALUES {values}) AS t(l,part,k,t) ON t.l=o_orderkey%{count} AND t.part IN ('I','J') AND t.k=(rn+l_partkey)%4
) y JOIN (VALUES {names}) AS m(n,layout) ON m.n=y.l"""
