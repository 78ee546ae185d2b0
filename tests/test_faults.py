"""Faults that were found once."""

from pyspark.sql import functions as F

from orderflow.functions import scalars as S
from orderflow.operators import detection, lines, lots, reports
from orderflow.plans import lot


def test_runs_of_a_day_add_up_and_reruns_replace(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([("EDI" if n < "m" else "TABELA", n) for n in names], "tipo string, arquivo string")
    held = lambda: sorted(r.arquivo for r in spark.read.parquet(f"{tmp_path}/h").collect())
    assert {(r.tipo, r.n) for r in reports.archive(rows("a", "b", "z"), f"{tmp_path}/h", "2026-03-17", "um").collect()} == {("EDI", 2), ("TABELA", 1)}
    reports.archive(rows("c"), f"{tmp_path}/h", "2026-03-17", "dois")
    assert held() == ["a", "b", "c", "z"]
    assert {(r.tipo, r.n) for r in reports.archive(rows("a"), f"{tmp_path}/h", "2026-03-17", "um").collect()} == {("EDI", 1)}
    assert held() == ["a", "c"]


def test_repeats_that_vanish_leave_their_mirror(spark, tmp_path):
    items = lambda *rows: spark.createDataFrame(rows, "pedido string, arquivo string, sku string")
    held = lambda: sorted((r.lote, r.pedido, r.arquivo) for r in spark.read.schema("lote string, pedido string, arquivo string").parquet(f"{tmp_path}/d").collect())
    lots.mirror_duplicates(items(("1", "a", "x"), ("1", "b", "x"), ("2", "a", "x"), ("2", "c", "x")), f"{tmp_path}/d", "L1")
    lots.mirror_duplicates(items(("9", "a", "x"), ("9", "b", "x")), f"{tmp_path}/d", "L2")
    told = lots.mirror_duplicates(items(("1", "a", "x"), ("2", "a", "x"), ("2", "c", "x")), f"{tmp_path}/d", "L1")
    assert [(r.pedido, r.n) for r in told.collect()] == [("2", 2)]
    assert held() == [("L1", "2", "a"), ("L1", "2", "c"), ("L2", "9", "a"), ("L2", "9", "b")]
    assert lots.mirror_duplicates(items(("1", "a", "x")), f"{tmp_path}/d", "L1").collect() == []
    assert held() == [("L2", "9", "a"), ("L2", "9", "b")]


def test_long_identifiers_keep_their_digits(spark):
    [r] = spark.createDataFrame([("12345678901234567.0", "1,7E+09")], "a string, b string").select(S.rescued_digits(F.col("a")).alias("a"), S.sku(F.col("b")).alias("b")).collect()
    assert (r.a, r.b) == ("12345678901234567", "1700000000")


def test_regions_by_name(spark):
    x = spark.createDataFrame([("Curitiba",), ("SUMARÉ",), ("porto alegre",), ("Recife",), ("SP-HORT",)], "line string")
    assert [r[0] for r in x.select(lines.roles(F.col("line"))["regional"]).collect()] == [True, True, True, False, True]


def test_messages_of_many_lines_keep_their_rows_apart(spark):
    row = "PR 7120000001 444444 05/06/24"
    mail = spark.createDataFrame([(1, '{"body": "' + "<br>" * 1001 + row + '"}'), (2, '{"body": "' + row.replace("444444", "555555") + '"}')], "row_id long, meta string")
    items = spark.createDataFrame([(1, "7120000001", "444444", "PR", "x", 1), (2, "7120000001", "555555", "PR", "x", 1)], "row_id long, matricula string, pedido string, regional string, sku string, qtd long")
    assert [(r.data, r.alerta) for r in lot.email_batch(mail, items)[0].collect()] == [("05.06.2024", "")] * 2


def test_supporting_words_are_whole(spark):
    x = spark.createDataFrame([(1, "REDE X", "PDF", "1", "", "D+1", 1)], "row_id long, nome_layout string, tipo_arquivo string, ativo string, observacoes string, regra_data_entrega string, layout_id long")
    assert {"COD FORN", "REFERENCIA", "PREVISAO"} <= set(detection.default_keyword_rules(x).collect()[0].apoio)
