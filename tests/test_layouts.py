"""Layout rules and lot documents on lines written by hand."""

import pytest

from orderflow.operators import lot_items, rules
from orderflow.sources.layout_rules import RULES, rules_frame

LINES = "file string, page long, line_no long, layout string, line string"


def read(spark, layout, *pages):
    rows = [("f", p, i, layout, line) for p, text in enumerate(pages, 1) for i, line in enumerate(text, 1)]
    return sorted(rules.read_lines(spark.createDataFrame(rows, LINES), rules_frame(spark)).collect(), key=lambda r: (r.page, r.line_no))


def test_context_reaches_as_its_rule_says(spark):
    got = read(spark, "BOZZA", ["1 12345 7890000000001 AGUA 2,00 24,00 1,00 2,00", "Numero Pedido: 77", "CNPJ/CPF: 61.186.888/0001-93", "CNPJ/CPF: 12.345.678/0001-95"], ["1 12345 7890000000001 AGUA 3,00 24,00 1,00 2,00"])
    assert [(r.pedido, r.cnpj, r.sku, r.qtd, r.alertas) for r in got] == [("77", "12345678000195", "12345", "2", []), ("77", "12345678000195", "12345", "3", [])]
    got = read(spark, "INDIANA", ["Numero Pedido: 12345", "CNPJ 12.345.678/0001-95", "4444 A 7 0,0000 1"], ["4444 A 8 0,0000 1"])
    assert [(r.pedido, r.qtd, r.alertas) for r in got] == [("12345", "7", []), ("", "8", ["PEDIDO_NAO_LOCALIZADO", "CNPJ_NAO_LOCALIZADO"])]


def test_days_change_inside_a_file(spark):
    page = lambda order, day: [f"PEDIDO DE COMPRAS {order} / L", "11.111.111/0001-11", "22.222.222/0001-22", *([f"Previsão de entrega {day}"] if day else []), "12345 1 SUCO CX 12 3,50 9"]
    got = read(spark, "FESTIVAL", page(1, ""), page(1, "01/02/2026"), page(2, "03/02/2026"), page(3, ""))
    assert [(r.pedido, r.cnpj, r.dia, r.qtd, r.alertas) for r in got] == [("1/L", "22222222000122", "01/02/2026", "4", []), ("1/L", "22222222000122", "01/02/2026", "4", []), ("2/L", "22222222000122", "03/02/2026", "4", []), ("3/L", "22222222000122", "", "4", ["DATA_NAO_LOCALIZADA"])]


def test_sections_broken_lines_and_codes_above(spark):
    full = "12345 7890000000001 92520 AGUA 06 8 48,000 2,61 125,28 2,61"
    got = read(spark, "TISCHLER", [full, "Número do pedido: 9", full, "22222 7890000000002 SUCO", "06 7 48,000 2,61 125,28 2,61", "33333 7890000000003 CHA", full, "TROCAS DO FORNECEDOR", full, "TOTAL DAS TROCAS", full])
    assert [(r.line_no, r.tipo, r.sku, r.qtd) for r in got] == [(3, "ITEM", "7890000000001", "8"), (4, "ITEM", "7890000000002", "7"), (6, "NAO_LIDA", "", ""), (7, "ITEM", "7890000000001", "8"), (11, "ITEM", "7890000000001", "8")]
    got = read(spark, "KACULA", ["55 / L", "44444 REFRI", "3,00", "4,00", "EAN 12345 9,00", "66666 X 5,00", "9,00"])
    assert [(r.line_no, r.sku, r.qtd, r.pedido) for r in got] == [(3, "44444", "3", "55/L"), (6, "66666", "5", "55/L")]


def test_references_repeats_and_totals(spark):
    rows = read(spark, "BAKLIZI", ["PEDIDO DE COMPRAS 123 / B", "11.111.111/0001-11", "12345 1 A CX 1 2,00 1,0000", "REF: 9999", "12345 1 A CX 1 2,00 1,0000", "123 B UN 1 3,00 1,0000", "REF: 8888", "TOTAIS 7,00"])
    assert [(r.tipo, r.sku, [a.split(":")[0] for a in r.alertas]) for r in rows] == [
        ("ITEM", "12345", ["REF_DIFERENTE_DO_COD_FORN_MANTIDO_COMO_AUDITORIA"]), ("ITEM", "12345", ["DUPLICIDADE_POTENCIAL_MANTIDA_PARA_VALIDACAO"]), ("ITEM", "8888", ["SKU_RECUPERADO_POR_REF_COD_FORN_AUSENTE"]), ("TOTAL", "", []),
    ]
    [total] = rules.rule_totals(spark.createDataFrame(rows)).collect()
    assert (total.soma, total.total, total.situacao) == ("7", "7", "OK")


def test_articles_add_up_and_equal_lines_count_once(spark):
    item = "7 SUCO 7890000000001 {} - CX"
    rows = read(spark, "MILLER", ["Número do pedido: 5", "CNPJ: 11.111.111/0001-11", item.format(2), item.format(2), item.format(3), "sem codigo 3 - CX"])
    got = rules.rule_items(spark.createDataFrame(rows)).orderBy("line_no").collect()
    assert [(r.sku, r.qtd, r.tipo) for r in got] == [("7890000000001", "5", "ITEM"), ("", "", "NAO_LIDA")]


def test_plan_is_the_same_for_any_number_of_layouts(spark):
    lines = spark.createDataFrame([], LINES)
    plans = [rules.read_lines(lines, rules_frame(spark, RULES[:n]))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (1, len(RULES))]
    assert plans[0] == plans[1]
    assert rules.read_lines(lines, rules_frame(spark)).collect() == []


def lot(spark, *lines):
    return lot_items.lot_lines(spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(lines, 1)], "file string, page long, line_no long, line string")).orderBy("line_no").collect()


HEAD_A, HEAD_B = "Produto Descrição Unidade Preço Quantidade Valor Total", "Código Cod Barras Cod Forn Descrição Qtde Emb"


@pytest.mark.parametrize(("line", "want"), [
    ("12345 SUCO  UVA CX C/ 12 3,5000 1.024,000 84,00", ("A", "012345", "SUCO UVA", 1024, "CX C/ 12", [])),
    ("12345 SUCO 3,5000 24,000 CX C/12 84,00", ("A", "012345", "SUCO", 24, "CX C/12", ["VALIDAR_ORDEM_COLUNAS_BH"])),
    ("12345 SUCO CX/12 10 24 99", ("A", "012345", "SUCO", 24, "CX/12", ["LEITURA_BH_FLEX"])),
    ("12345 SUCO 2 L 3,50 24,00 FD C/6", ("A", "012345", "SUCO 2 L", 24, "FD C/6", ["LEITURA_BH_FLEX"])),
    ("12345 SUCO FD/6 3,5000 24,500 84,00", ("", None, None, None, None, ["QTD_INVALIDA", "LINHA_ITEM_NAO_LIDA"])),
    ("1784412 7894900087000 92581 REFRI 40 80,000 FD/2 6,23", ("B", "092581", "REFRI", 40, "FD/2", [])),
    ("1784412 7894900087000 92581 40 FD/2 80,000 6,23", ("B", "092581", "CODIGO 1784412", 40, "FD/2", [])),
    ("1784412 7894900087000 REFRI MARCA 24,000 6,23 149,52 119143", ("B", "119143", "REFRI MARCA", 24, "UN", ["VALIDAR_QTD_RPONE_SEM_EMBALAGEM"])),
    ("1784412 7894900087000 A B C D 7", ("", None, None, None, None, ["SKU_NAO_IDENTIFICADO"])),
    ("1784412 7894900087000 X 2", ("", None, None, None, None, ["LINHA_ITEM_NAO_LIDA"])),
])
def test_lot_lines(spark, line, want):
    [r] = lot(spark, HEAD_A, line)
    assert (r.formato, r.sku, r.descricao, r.qtd, r.unidade, r.alertas) == want


def test_lot_tables_open_and_close(spark):
    a, b = "12345 SUCO SEM UNIDADE", "1784412 7894900087000 REFRI MARCA 24,000 6,23 149,52 119143"
    got = lot(spark, a, HEAD_A, a, "Total Pedido 9", a, HEAD_B, b, "Totais 3", "x")
    assert [(r.line_no, r.formato, len(r.alertas)) for r in got] == [(1, "", 1), (3, "", 2), (5, "", 1), (7, "B", 0)]


SF = "/root/testdata/sf0.001"


def test_layouts_as_a_dimension_judge_as_one_by_one(spark):
    from pyspark.sql import functions as F

    from orderflow.fixtures import view
    from orderflow.operators.identity import Layout
    from orderflow.plans import lot, standardize

    layouts = {
        "A": Layout("REDE DOIS", trusted=("REDE UM",)), "B": Layout("REDE TESTE", network_first=True, date_rule="COLUNA", dot_orders=True, long_number="99"), "C": Layout("REDE TRES", client="MATRICULA", file="EXCEL", notes="pedido opcional"), "D": Layout("REDE QUATRO", client="LOJA"),
    }
    items = view(spark, SF, "f12_items").filter("row_id % 7 = 0").withColumn("arquivo", F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("row_id") % 5 + 1).cast("int")))
    base, xref = view(spark, SF, "f3_gln"), view(spark, SF, "f2_xref")
    results = spark.createDataFrame([(x, x, "ASSINATURA", 99) for x in "ABCDE"], "arquivo string, layout string, modo string, confianca int")
    columns = ["row_id", "matricula_final", "cnpj_oficial_final", "status_depara_cliente", "numero_pedido_final", "data_remessa_final", "quantidade_lida", "status_identidade", "alerta_identidade", "motivo_descarte"]
    got = lot.judge_batch(items, results, layouts, base, xref, "2026-03-17").select("arquivo", *columns).collect()
    for name in "ABCD":
        want = standardize.judge_orders(items.filter(F.col("arquivo") == name), layouts[name], base, xref, "2026-03-17").select(*columns).collect()
        assert sorted(tuple(map(str, r)) for r in want) == sorted(tuple(map(str, r[1:])) for r in got if r.arquivo == name)
    assert {r.motivo_descarte for r in got if r.arquivo == "E"} == {"LAYOUT_NAO_SUPORTADO"}
    size = lambda n: lot.judge_batch(items, results, {f"{k}{i}": v for i in range(n) for k, v in layouts.items()}, base, xref, "2026-03-17")._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(1) == size(11)
