"""What must not grow with the square of a group, or pass through one place, and what wide tables must not change."""

import re

from pyspark.sql import functions as F

from orderflow.operators import customers, detection, reports


def most_rows(df) -> int:
    """Rows that the largest operator of df's plan puts out, once it has run."""
    df.write.format("noop").mode("overwrite").save()
    found = df._jdf.queryExecution()
    spark = df.sparkSession
    frame = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, found.analyzed())
    frame.collectToPython()
    plan = frame.queryExecution().executedPlan()

    def walk(p) -> int:
        most = p.metrics().get("numOutputRows").get().value() if p.metrics().contains("numOutputRows") else 0
        inner = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else []
        children = [p.children().apply(i) for i in range(p.children().size())]
        return max([most, *map(walk, inner + children)])

    return walk(plan)


def test_entries_of_one_root_are_not_crossed_with_items(spark):
    n = 600
    number = F.lpad((F.col("id") % 100).cast("string"), 14, "12345678000000")
    items = spark.range(n).select(F.col("id").alias("row_id"), F.lit("A").alias("rede"), F.array(F.concat(F.lit("123456780001"), F.lpad(F.col("id") % 100, 2, "0"))).alias("chaves"))
    xref = spark.range(n).select(F.col("id").alias("row_id"), F.lit("A").alias("rede"), F.concat(F.lit("123456780001"), F.lpad(F.col("id") % 100, 2, "0")).alias("chave_lida"), number.alias("cnpj_oficial"), F.col("id").cast("string").alias("matricula"))
    found = customers.xref_search(items, xref)
    got = {r.row_id: r for r in found.collect()}
    assert len(got) == n and all(got[i].matricula == str(i % 100) and got[i].qualidade == 1000 and got[i].nivel == 100 for i in range(n))
    assert most_rows(found) < 20 * n


def test_files_are_not_sent_to_all(spark):
    items = spark.range(4).select(F.col("id").cast("string").alias("arquivo"), F.lit("").alias("alerta_extracao"))
    results = spark.range(3).select(F.col("id").cast("string").alias("arquivo"), F.lit("UM").alias("layout"), F.lit("CHAVE").alias("modo"), F.lit(9).alias("confianca"))
    stamped = detection.stamp_tracking(items, results)
    assert {(r.arquivo, r.modo_rastreabilidade) for r in stamped.collect()} == {("0", "SIM"), ("1", "SIM"), ("2", "SIM"), ("3", "NAO")}
    assert "broadcast" not in stamped._jdf.queryExecution().analyzed().toString().lower()


def test_files_stay_one_row_while_they_are_scored(spark):
    files = spark.createDataFrame([(i, "PDF", f"pedido de compra rede {'um' if i % 2 else 'dois'} extra", f"um_{i}.pdf") for i in range(50)], "row_id long, tipo string, texto string, nome_arquivo string")
    rules = spark.createDataFrame([(k, f"N{k}", "PDF", True, 75, 55, [w], ["PEDIDO DE COMPRA", "REDE"]) for k, w in enumerate(["UM", "DOIS", *[f"X{j}" for j in range(20)]])], "row_id long, nome string, tipo string, ativa boolean, limiar_auto int, limiar_sugestao int, fortes array<string>, apoio array<string>")
    scored = detection.score_layouts(files, rules)
    got = {r.row_id: r for r in scored.collect()}
    assert len(got) == 50 and got[1].regra == 0 and got[1].score == 45 + 8 + 8 and got[2].regra == 0 and got[2].margem == 8
    assert most_rows(scored) <= 60


def test_a_note_is_made_once_a_row(spark):
    x = spark.createDataFrame([(1, "", "1", "2", "", "3", "4", "VALIDAR CONVERSAO", "QTD_VAZIA", "", "")], "row_id long, matricula_final string, cnpj_lido string, sku_lido string, ean_lido string, quantidade_lida string, numero_pedido_final string, status_conversao string, motivo_descarte string, status_depara_cliente string, observacao_conversao string")
    blocked = reports.blocked_items(reports.validation_rows(x))
    assert blocked.collect()[0].motivo == "Conversão pendente: VALIDAR CONVERSÃO | Matrícula vazia/A cadastrar | A CADASTRAR | QTD_VAZIA | VALIDAR CONVERSÃO"
    assert blocked._jdf.queryExecution().optimizedPlan().toString().count("CADASTRAR CHAVE CLIENTE") <= 4


def test_stores_may_stand_at_any_column(spark, same, tmp_path):
    import duckdb

    from orderflow import catalog

    for t, moved in (("customer", "c_custkey + 99990 AS c_custkey"), ("orders", "o_custkey + 99990 AS o_custkey"), ("lineitem", "l_orderkey AS l_orderkey"), ("part", "p_partkey AS p_partkey")):
        duckdb.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    same(catalog.queries()["agg_04_reconcile_rows"](spark, str(tmp_path)), catalog.oracle_sql()["agg_04_reconcile_rows"], str(tmp_path))


def test_a_lots_lines_are_read_once_for_its_issues(spark):
    from orderflow import catalog

    issues = catalog.queries()["pipe_05_lot_issues"](spark, "/root/testdata/sf0.001")
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("VALIDAR_QTD_RPONE_SEM_EMBALAGEM") == 1


def test_identity_is_checked_once_and_not_for_each_look_up(spark):
    from orderflow import catalog

    counts = catalog.queries()["agg_09_discard_counts"](spark, "/root/testdata/sf0.001")
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("SKU_LIDO_PARECE_EAN") == 1


def test_reasons_are_compiled(spark):
    from orderflow.functions import scalars as S

    x = spark.createDataFrame([("a", None, "a", ""), (None, "b", "", "c")], "p string, q string, r string, s string")
    made = S.once(x, k=S.kept(F.array(F.upper("p"), "q", F.upper("r"), "s"), ""), n=F.length("q"))
    assert [list(r.k) for r in made.collect()] == [["A"], ["b", "c"]]
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_the_queue_is_judged_once_for_all_gates(spark):
    from orderflow import catalog

    gates = catalog.queries()["flt_11_release_gate"](spark, "/root/testdata/sf0.001")
    assert gates._jdf.queryExecution().optimizedPlan().toString().count("QTD_INVALIDA: )") <= 1 and gates._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1


def test_plain_fields_of_the_queue_pass_through_one_pattern(spark):
    from orderflow.functions import scalars as S

    rows = [("7", "007", "1/2/2024"), ("7.0", "1.234,5", "31.12.1999"), ("1,7E+3", "0,2", "31/02/1997"), ("A-7", "-3", "01/01/0000"), ("", " 5 ", "1/1/24"), (None, "x", None), ("12.00", "9" * 16, "29/02/2024")]
    x = spark.createDataFrame(rows, "a string, b string, c string")
    got = [(r.a, r.b, str(r.c)) for r in x.select(S.sku(F.col("a")).alias("a"), S.queue_quantity(F.col("b")).alias("b"), S.day(F.col("c")).alias("c")).collect()]
    assert got == [("7", 7, "2024-02-01"), ("7", 1234, "1999-12-31"), ("1700", 1, "None"), ("7", 1, "None"), ("", 5, "None"), ("", None, "None"), ("12", 10**16, "2024-02-29")]
    assert "gettimestamp" not in x.select(S.day(F.col("c")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_patterns_of_layouts_do_not_go_along_windows(spark):
    from orderflow import catalog

    read = catalog.queries()["ex_01_lines_by_rules"](spark, "/root/testdata/sf0.001")

    def walk(p) -> int:
        wide = p.nodeName() == "Window" and any(f"{c}#" in p.output().mkString(" ") for c in ("item_sem_sku", "codigo_acima", "candidata", "referencia"))
        return wide + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    plan = read._jdf.queryExecution().optimizedPlan()
    assert walk(plan) == 0 and plan.toString().count("Sort [layout") == 2


def test_vertical_records_hold_narrow_rows(spark):
    from orderflow import catalog

    plan = catalog.queries()["ex_03_vertical_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()

    def walk(p) -> int:
        return (p.nodeName() == "Window" and "_dia#" in p.output().mkString(" ")) + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    assert walk(plan) == 0 and plan.toString().count("min_by(") == 4 and "lambda" not in plan.toString()


def test_a_sheets_quantities_are_read_once_a_cell(spark):
    from orderflow import catalog

    plan = catalog.queries()["ex_08_sku_by_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()

    def walk(p) -> int:
        return (p.nodeName() == "Filter" and "decimal(30,8)" in p.expressions().mkString(" ")) + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    assert walk(plan) == 0


def test_a_form_reads_its_sheets_once_for_all_labels_and_its_numbers_once_a_line(spark):
    from orderflow import catalog
    from orderflow.operators import sheets

    plan = catalog.queries()["ex_13_order_forms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 3 and plan.count("[0-9],[0-9]") <= 6
    rows = [("S", 1, 1, "Matrícula:"), ("S", 1, 2, "7"), ("S", 1, 4, "a matricula"), ("S", 1, 5, "8"), ("S", 12, 1, "x9"), ("S", 12, 3, "24"), ("S", 12, 4, "12"), ("T", 2, 3, "Data"), ("T", 12, 1, "5"), ("T", 12, 2, "1,5"), ("T", 12, 9, "z"), ("U", 12, 1, "6")]
    form = sheets.extract_form(spark.createDataFrame(rows, "sheet string, r long, c long, v string"), {"m": "MATRICULA", "d": "DATA"}, {"sku": 1, "fardo": 2, "unidades": 3, "por_fardo": 4}, 10)
    assert sorted(map(tuple, form.collect())) == [("S", 12, "9", "2", "QTD_CALCULADA_POR_UNIDADES", "7", ""), ("T", 12, "5", "1,5", "", "", ""), ("U", 12, "6", "", "QTD_FARDO_AUSENTE", "", "")]


def test_lines_are_dealt_by_file_once_and_sorted_by_place_once(spark):
    from orderflow.operators import rules
    from orderflow.sources.layout_rules import rules_frame

    lines = spark.createDataFrame([("a", 1, 1, "x", "PADRAO")], "file string, page long, line_no long, line string, layout string")
    plan = rules.read_lines(lines, rules_frame(spark))._jdf.queryExecution()
    physical = plan.executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(file") == 1 and physical.count("Exchange hash") == 1
    assert len(re.findall(r"Sort \[file#\d+ ASC NULLS FIRST, page#\d+L? ASC NULLS FIRST, line_no", physical)) == 1
    assert not re.search(r"RLIKE \w+#", plan.optimizedPlan().toString())  # it compiles a pattern that is a column for each row


def test_items_of_many_layouts_are_read_once_for_all_look_ups(spark):
    from orderflow import catalog

    for name in ("pipe_06_queue_of_many_layouts", "pipe_06_left_of_many_layouts", "pipe_06_files_of_many_layouts"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "LINHA_NAO_LIDA" not in plan and "regexp_extract(line" not in plan and "codigo_acima" not in plan


def test_a_lots_lines_are_written_once_for_its_queue(spark):
    from orderflow import catalog

    plan = catalog.queries()["pipe_05_lot_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "VALIDAR_QTD_RPONE_SEM_EMBALAGEM" not in plan and "Local de Entrega" not in plan


def test_a_text_is_read_once_for_where_it_delivers_to(spark):
    rows = [(1, "Local de Entrega: CNPJ: 12.345.678/0001-90", "x"), (2, "nada", "y"), (3, "CNPJ 99.999.999/0001-00 e 11.111.111/0001-11", "z"), (4, None, "w")]
    docs = spark.createDataFrame(rows, "row_id long, texto string, loja string")
    got = detection.delivery_cnpj(docs, spark.createDataFrame([("12345678000190",)], "cnpj string"), ("99999999",), "loja")
    assert sorted(map(tuple, got.collect())) == [(1, "x", "12345678000190"), (2, "y", ""), (3, "z", "11111111000111"), (4, "w", "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_parts_of_a_lots_line_are_made_once(spark):
    from orderflow.operators import lot_items

    lines = spark.createDataFrame([("a", 1, 1, "12345 SUCO 2 L 3,50 7,00 FD C/6")], "file string, page long, line_no long, line string")
    read = lot_items.lot_lines(lines)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(lot_items.UNIT_ANYWHERE) == 3 and plan.count(lot_items.UNIT_FIRST) == 4
    assert [(r.formato, r.sku, r.descricao, r.qtd, r.alertas) for r in read.collect()] == [("A", "012345", "SUCO 2 L", 7, ["LEITURA_BH_FLEX"])]
