"""What SQL doesn't check: sinks, streams, plan-time checks, and functions that have no SQL."""

import difflib
import os

import pytest
from pyspark.sql import functions as F

from orderflow import catalog
from orderflow.fixtures import view
from orderflow.operators import detection, lots, reports
from orderflow.plans import interchange, operational
from orderflow.sources import tables
from orderflow.sources.queue_table import Queue

SF = "/root/testdata/sf0.001"


def test_order_files_byte_for_byte(spark, tmp_path):
    queue, gln = view(spark, SF, "f1_queue").filter("row_id < 40000"), view(spark, SF, "f3_gln")
    out = operational.operational_output(queue, gln, "2026-03-17", "2026-03-17 09:05:00")
    interchange.write_files(out["arquivos"], f"{tmp_path}/edi")
    want = {}
    for r in out["arquivos"].orderBy("ord", "seq").collect():
        want.setdefault(f"{r.matricula}_{r.pedido}", []).append(r.registro)
    found = {}
    for folder in os.listdir(f"{tmp_path}/edi"):
        if folder.startswith("arquivo="):
            files = [f for f in os.listdir(f"{tmp_path}/edi/{folder}") if f.startswith("part-")]
            assert len(files) == 1
            found[folder.removeprefix("arquivo=")] = open(f"{tmp_path}/edi/{folder}/{files[0]}", "rb").read()
    assert found == {k: "".join(x + "\n" for x in v).encode("latin-1") for k, v in want.items()}
    one = next(iter(found.values())).split(b"\n")[:-1]
    assert {len(x) for x in one} == {400} and [x[:2] for x in one[:3]] == [b"01", b"02", b"03"] and one[-1][:2] == b"09"
    head = one[0].decode()
    assert head[2:8] == "ORDERS" and head[36:39] == "9  " and head[39:51] == "202603170905" and head[63:75] == "202603240905" and head[91:94] == "001"
    items = out["tabelas"].count() + out["sem_gln"].count()
    assert items == out["arquivos"].filter("ord = 4").count() + out["sem_gln"].count() and out["rejeitadas"].count() > 0


def test_queue_batches_replace_themselves(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(v, "1", "2", "3", "4") for v in x], "matricula string, sku string, qtd string, pedido string, data_remessa string")
    q = Queue(spark, f"{tmp_path}/q")
    held = lambda: sorted(r.matricula for r in q.load().collect())
    assert held() == []
    q.append(rows("a", "b"), "1")
    q.append(rows("c"), "2")
    q.append(rows("a", "d"), "1")
    assert held() == ["a", "c", "d"]
    q.replace(rows("z"), "9")
    assert held() == ["z"]
    q.clear()
    assert held() == []


def test_archive_counts_and_reruns(spark, tmp_path):
    x = spark.createDataFrame([("EDI", "a"), ("EDI", "b"), ("TABELA", "c")], "tipo string, arquivo string")
    for _ in range(2):
        assert {(r.tipo, r.n) for r in reports.archive(x, f"{tmp_path}/h", "2026-03-17").collect()} == {("EDI", 2), ("TABELA", 1)}
    reports.archive(x.limit(1), f"{tmp_path}/h", "2026-03-18")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4


def test_reports_have_all_tables(spark):
    from orderflow.catalog_reports import _rows
    from orderflow.catalog_documents import _issues, _lot_items

    rows = _rows(view(spark, SF, "f12_items").filter("row_id < 100000"))
    report = reports.validation_report(rows, rows.filter("motivo_descarte <> ''"), "a.pdf", "REDE", "2026-03-17")
    assert all(t.limit(1).count() for t in report.values()) and len(report) == 10
    clean = reports.validation_report(rows.limit(0), rows.limit(0), "a.pdf", "REDE", "2026-03-17")
    assert all(clean[n].count() == 1 for n in ("MODELO", "VALIDACAO", "ITENS_BLOQUEADOS", "DUPLICIDADES", "CADASTRAR", "PENDENCIAS", "REJEICOES"))
    more = reports.attach_diagnostics(report, CONVERSAO=clean["MODELO"], EXTRA=rows)
    assert len(more) == 11 and more["CONVERSAO"] is clean["MODELO"]
    assert reports.failure_report(spark, "a.pdf", "R", [])["RESUMO"].collect()[0].alertas == 1
    h = view(spark, SF, "f9_history")
    items = _lot_items(h)
    lot = reports.lot_report(items, _issues(h), items.select("lote", "arquivo", F.lit(1).alias("itens"), "pedido", F.lit("1").alias("cnpj"), "matricula"))
    assert len(lot) == 11 and all(t.limit(1).count() for t in lot.values())


def test_plan_time_checks(spark, tmp_path):
    df = spark.createDataFrame([("1", None)], "a string, b string")
    assert tables.require_columns(df, ("a",)) is df
    with pytest.raises(ValueError, match="c, d"):
        tables.require_columns(df, ("a", "d", "c"))
    assert tables.check_catalogue({"x": (df, ("a", "z")), "y": (None, ()), "w": (df, ("b",))}) == ["y: missing", "x: columns missing: z"]
    assert tables.queue_source(["p/~$f.xlsx", "p/b", "p/a"], "p/o") == ["p/a", "p/b"] and tables.queue_source(["p/a", "p/o"], "p/o") == ["p/o"]
    (tmp_path / "d.csv").write_bytes("cod;nome\n001;São\n002;\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_dimension(spark, f"{tmp_path}/d.csv", ";", "ISO-8859-1").collect()] == [("001", "São"), ("002", "")]


def test_likeness_of_names(spark):
    pairs = [("REDE SUL", "REDE NORTE"), ("", "X"), ("ABC", "ABC"), ("COCA 12", "PEDIDO COCA")]
    got = spark.createDataFrame(pairs, "a string, b string").select(detection.name_likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [int(difflib.SequenceMatcher(None, a, b).ratio() * 12) if a else 0 for a, b in pairs]


def test_scores_by_hand(spark):
    rules = spark.createDataFrame([(1, "REDE SUL PDF", "PDF", True, 75, 55, ["REDE", "SUL"], ["CNPJ", "TOTAL"]), (2, "LESTE PDF", "PDF", True, 1, 1, ["LESTE"], ["CNPJ"]), (3, "REDE SUL", "EXCEL", True, 1, 1, ["SUL"], [])], "row_id int, nome string, tipo string, ativa boolean, limiar_auto int, limiar_sugestao int, fortes array<string>, apoio array<string>")
    files = spark.createDataFrame([(7, "PDF", "Pedido da Rede Sul, CNPJ 1, total 2", "rede_sul"), (8, "PDF", "nada", "x")], "row_id int, tipo string, texto string, nome_arquivo string")
    got = {r.row_id: r for r in detection.score_layouts(files, rules).collect()}
    like = lambda a, b: int(difflib.SequenceMatcher(None, a, b).ratio() * 12)
    assert got[7].regra == 1 and got[7].score == 45 + 8 + 14 + like("REDE SUL", "REDE SUL PDF") and got[7].decisao == "AUTO"
    assert got[8].score == max(like("X", "REDE SUL PDF"), like("X", "LESTE PDF")) and got[8].decisao == "SEM_SUGESTAO"


def test_queries_without_sql_run(spark):
    rest = set(catalog.queries()) - set(catalog.oracle_sql())
    assert rest == {"j_15_score_layouts", "ex_21_detect_layout"}
    modes = {r.modo for r in catalog.queries()["ex_21_detect_layout"](spark, SF).collect()}
    assert "ASSINATURA" in modes and modes <= {"ASSINATURA", "CHAVE", "PONTOS", "SUGESTAO", "GENERICO"}
    assert catalog.queries()["j_15_score_layouts"](spark, SF).count() == view(spark, SF, "f2_xref").count()


def test_issue_counts_of_nothing(spark):
    assert lots.issue_counts(spark.createDataFrame([], "tipo string")).collect() == []


def test_a_new_checkpoint_goes_on_after_the_history(spark, tmp_path):
    from orderflow.streaming import push

    schema = "row_id long, pedido string, arquivo string"
    for turn, rows in enumerate(([(1, "a", "x"), (2, "a", "y")], [(3, "b", "z"), (4, "a", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{turn}")
        for _ in range(2):  # the second run finds nothing new
            push.number_pushes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in{turn}"), f"{tmp_path}/out", f"{tmp_path}/check{turn}").awaitTermination()
    got = sorted((r.push, r.row_id, r.repetido, r.no_historico) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1, False, False), (0, 2, True, False), (1, 3, False, False), (1, 4, False, True)]


def test_streamed_queue_is_judged_as_a_table_is(spark, tmp_path):
    from orderflow.operators import queue
    from orderflow.streaming import push

    rows = view(spark, SF, "f1_queue")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    push.validate_stream(stream, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/check").awaitTermination()
    for name, want in zip(("ok", "bad"), queue.validate_queue(rows)):
        got = spark.read.parquet(f"{tmp_path}/{name}").drop("batch")
        assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
