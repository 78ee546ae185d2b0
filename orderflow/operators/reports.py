"""Reports on validation and lots: named tables, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scalars as S
from ..functions import texts as X
from ..sources import partition_sets
from . import identity, lots

CRITICAL = ("ALERTA", "ERRO", "VALIDAR", "A CADASTRAR", "CADASTRAR CHAVE", "NAO CONVERTIDO", "CONVERSAO_PENDENTE_VALIDACAO", "MATRICULA_NAO_ENCONTRADA", "SKU_VAZIO", "QTD_VAZIA", "PEDIDO_VAZIO", "DATA_INVALIDA", "DUPLICADO")


def observation(df: DataFrame) -> Column:
    """FLT-27: notes on a row, different ones in order, OK if there are none.

    df: matricula_final, cnpj_lido, motivo_descarte, status_depara_cliente, observacao_conversao, status_conversao.
    """
    why, keyed, conv = S.text(F.col("motivo_descarte")), S.text(F.col("status_depara_cliente")), identity.conversion_status(F.col("status_conversao"), F.col("status_conversao"))
    unknown = (S.text(F.col("cnpj_lido")) != "") & ((S.text(F.col("matricula_final")) == "") | (why == "MATRICULA_NAO_ENCONTRADA") | (keyed == "A_CADASTRAR"))
    parts = F.array(
        F.nullif(S.text(F.col("observacao_conversao")), F.lit("")), F.when(unknown, "A CADASTRAR"), F.when(keyed == "DEPARA_CLIENTES", "DE/PARA CLIENTE OK").when(keyed == "A_CADASTRAR", "CADASTRAR CHAVE CLIENTE"),
        F.when((why != "") & ~why.isin("MATRICULA_NAO_ENCONTRADA", "PENDENTE_MATRICULA"), why), F.when(identity.conversion_blocks(conv), conv),
    )
    return X.first_nonblank(F.array_join(S.kept(parts), " | "), F.lit("OK"))


def validation_rows(df: DataFrame) -> DataFrame:
    """One row an order line as the validation table has it."""
    df = S.once(df, observacao=observation(df), _conv=identity.conversion_status(F.col("status_conversao"), F.col("status_conversao")))
    return df.select(
        "row_id", F.col("matricula_final").alias("matricula"), F.col("cnpj_lido").alias("cnpj"), F.col("sku_lido").alias("sku"), F.col("ean_lido").alias("ean"), F.col("quantidade_lida").alias("qtd"),
        F.col("numero_pedido_final").alias("pedido"), F.col("_conv").alias("status_conversao"), "observacao", "motivo_descarte", "status_depara_cliente",
    )


def block_reason(df: DataFrame) -> Column:
    """FLT-23: what keeps a validation row from the queue, different reasons in order, or ""."""
    blank = lambda c: S.text(F.col(c)) == ""
    n, critical = N.br_number(F.col("qtd")), identity.any_of(identity.plain_upper(F.col("observacao")), CRITICAL)
    parts = F.array(
        F.when(identity.conversion_blocks(F.col("status_conversao")), F.concat(F.lit("Conversão pendente: "), "status_conversao")), F.when(blank("matricula"), "Matrícula vazia/A cadastrar"), F.when(blank("sku"), "SKU vazio"),
        F.when(blank("qtd"), "Quantidade final vazia").when(n.isNull(), "Quantidade final não numérica").when(n <= 0, "Quantidade zero/negativa"), F.when(blank("pedido"), "Pedido vazio"), F.when(critical, F.col("observacao")),
    )
    return F.array_join(S.kept(parts), " | ")


def or_placeholder(df: DataFrame, **values: str) -> DataFrame:
    """df, or one row of these values if it has none."""
    one = df.sparkSession.range(1).select(*[(F.lit(values[c]) if c in values else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
    some = df.select(F.lit(0).alias("id")).limit(1)
    empty = df.sparkSession.range(1).join(F.broadcast(some), "id", "left_anti").select(F.lit(1).alias("_e"))
    return df.unionByName(one.join(F.broadcast(empty)).drop("_e"))


def blocked_items(rows: DataFrame) -> DataFrame:
    """Rows with a reason, or one row that says there are none (AGG-23)."""
    x = S.once(rows, motivo=block_reason(rows)).filter("motivo <> ''").select("row_id", F.lit("BLOQUEADO - VALIDAR ANTES DA FILA/TXT").alias("status"), "motivo", "pedido", "matricula", "sku")
    return or_placeholder(x, status="OK", motivo="Nenhum item bloqueado para fila/TXT.")


def displayable(df: DataFrame) -> Column:
    """FLT-20: rejected only as the customer is to be registered, converted, with company number, article, order and positive quantity."""
    pending = F.col("motivo_descarte").isin("MATRICULA_NAO_ENCONTRADA", "PENDENTE_MATRICULA") | (F.col("status_depara_cliente") == "A_CADASTRAR")
    full = [S.text(F.col(c)) != "" for c in ("cnpj", "sku", "pedido")]
    ok = pending & ~identity.conversion_blocks(F.col("status_conversao")) & F.coalesce(N.br_number(F.col("qtd")) > 0, F.lit(False))
    for column in full:
        ok = ok & column
    return ok


def model_rows(df: DataFrame, placeholder: str = "") -> DataFrame:
    """FLT-28: a validation row as the model has it; the placeholder stands for a missing customer."""
    return df.select("row_id", X.first_nonblank(F.col("matricula"), F.lit(placeholder)).alias("matricula"), "cnpj", "sku", "qtd", "pedido", "status_conversao")


def model_table(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """Model rows of the valid, and of displayable rejected rows that no valid row equals in company number, article, quantity and order (SET-06)."""
    key = ["cnpj", "sku", "qtd", "pedido"]
    own = model_rows(valid)
    more = model_rows(rejected.filter(displayable(rejected)), "A CADASTRAR").join(own.select(key).distinct(), key, "left_anti")
    once = more.groupBy(*key).agg(F.min_by(F.struct("row_id", "matricula", "status_conversao"), "row_id").alias("x")).select("x.row_id", "x.matricula", *key, "x.status_conversao")
    return own.unionByName(once)


def merge_final(valid: DataFrame, final: DataFrame) -> DataFrame:
    """valid with the columns of final in their place, met by row_id and never by position (J-21, D-15)."""
    shared = [c for c in final.columns if c in valid.columns and c != "row_id"]
    x = valid.join(final.select("row_id", *[F.col(c).alias(f"_{c}") for c in shared], *[c for c in final.columns if c not in valid.columns]), "row_id")
    return x.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in shared}).drop(*[f"_{c}" for c in shared])


def pending_keys(rows: DataFrame) -> DataFrame:
    """tipo, chave, cnpj, cnpj_oficial, pedidos of keys to register: distinct orders in order, joined (AGG-06). rows: chave, cnpj, cnpj_oficial, pedido, matricula."""
    x = rows.filter("chave <> '' AND matricula = ''").groupBy(S.key_type(F.col("chave")).alias("tipo"), "chave", "cnpj", "cnpj_oficial")
    x = x.agg(F.array_join(F.sort_array(F.collect_set(F.nullif(F.col("pedido"), F.lit("")))), " | ").alias("pedidos"))
    return x.withColumn("cnpj_oficial", F.when(F.col("cnpj_oficial") != F.col("cnpj"), F.col("cnpj_oficial")).otherwise(""))


def duplicates(rows: DataFrame) -> DataFrame:
    """pedido, matricula, sku, ocorrencias, qtd_total of complete keys that occur more than once; a comma stands for the point (D-13)."""
    x = rows.filter("pedido <> '' AND matricula <> '' AND sku <> ''").groupBy("pedido", "matricula", "sku")
    x = x.agg(F.count(F.lit(1)).alias("ocorrencias"), F.sum(F.coalesce(N.br_number(F.col("qtd")), F.lit(0))).alias("q")).filter("ocorrencias > 1")
    return x.select("pedido", "matricula", "sku", "ocorrencias", N.said(F.col("q")).alias("qtd_total"))


def _figures(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One row of the figures that manifest and panel show."""
    a = rows.withColumn("_b", block_reason(rows) != "").agg(
        F.count(F.lit(1)).alias("validacao"), F.sum(F.col("_b").cast("long")).alias("bloqueadas"), F.countDistinct(F.when(F.col("matricula") == "", F.col("cnpj"))).alias("cadastrar"), F.sum((F.col("observacao") != "OK").cast("long")).alias("alertas"),
        *[F.sum((F.col("status_conversao") == s).cast("long")).alias(n) for n, s in (("convertidos", "OK CONVERTIDO"), ("nao_convertidos", "ALERTA - NÃO CONVERTIDO"), ("validar", "VALIDAR CONVERSÃO"), ("sem_conversao", "OK SEM CONVERSÃO"))],
    )
    b, c = model.agg(F.count(F.lit(1)).alias("modelo")), duplicates(rows).agg(F.count(F.lit(1)).alias("duplicidades"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).fillna(0)


def manifest(rows: DataFrame, model: DataFrame, file: str, layout: str, now: str) -> DataFrame:
    """campo, valor: what was processed, and whether it may go on (AGG-07)."""
    go = F.when((F.col("bloqueadas") > 0) | (F.col("alertas") > 0), "NÃO LIBERADO").otherwise("LIBERADO APÓS CONFERÊNCIA MANUAL")
    fields = {"data_hora_geracao": F.lit(now), "arquivo": F.lit(file), "layout": F.lit(layout), "linhas_validacao": F.col("validacao"), "linhas_modelo_fila": F.col("modelo"), "linhas_bloqueadas": F.col("bloqueadas"), "total_alertas": F.col("alertas"), "go_no_go_fila": go}
    return _figures(rows, model).select(F.inline(F.array(*[F.struct(F.lit(k).alias("campo"), v.cast("string").alias("valor")) for k, v in fields.items()])))


def executive_panel(rows: DataFrame, model: DataFrame, file: str, layout: str) -> DataFrame:
    """indicador, valor: the 13 indicators (AGG-08)."""
    status = F.when((F.col("bloqueadas") > 0) | (F.col("cadastrar") > 0), "BLOQUEADA - VALIDAR PENDÊNCIAS").otherwise("PRONTA PARA CONFERÊNCIA MANUAL")
    fields = {
        "Status executivo": status, "Layout": F.lit(layout), "Arquivo/Lote": F.lit(file), "Itens na validação": F.col("validacao"), "Itens prontos no modelo/fila": F.col("modelo"), "Itens bloqueados": F.col("bloqueadas"), "CNPJs/Chaves a cadastrar": F.col("cadastrar"),
        "Possíveis duplicidades": F.col("duplicidades"), "Itens convertidos": F.col("convertidos"), "Itens não convertidos": F.col("nao_convertidos"), "Itens para validar conversão": F.col("validar"), "Alertas registrados": F.col("alertas"), "Regra de segurança": F.lit("TXT/fila não é gerado automaticamente"),
    }
    return _figures(rows, model).select(F.inline(F.array(*[F.struct(F.lit(k).alias("indicador"), v.cast("string").alias("valor")) for k, v in fields.items()])))


def conversion_summary(rows: DataFrame) -> DataFrame:
    """One row: rows by conversion status in four buckets (AGG-09)."""
    s = identity.conversion_status(F.col("status_conversao"), F.col("status_conversao"))
    n = lambda v: F.sum((s == v).cast("long"))
    return rows.agg(n("OK CONVERTIDO").alias("convertidos"), n("ALERTA - NÃO CONVERTIDO").alias("nao_convertidos"), n("VALIDAR CONVERSÃO").alias("validar"), n("OK SEM CONVERSÃO").alias("sem_conversao"))


def audit_summary(items: DataFrame) -> DataFrame:
    """One row: items, those with an alert, company numbers without customer (AGG-10)."""
    return items.agg(F.count(F.lit(1)).alias("itens"), F.sum((S.text(F.col("alerta_extracao")) != "").cast("long")).alias("com_alerta"), F.countDistinct(F.when((F.col("cnpj_lido") != "") & (F.col("matricula_lida") == ""), F.col("cnpj_lido"))).alias("cnpjs_sem_matricula"))


def unique_alerts(items: DataFrame) -> DataFrame:
    """Different alerts, in order (AGG-11)."""
    return items.select(S.text(F.col("alerta_extracao")).alias("alerta")).filter("alerta <> ''").distinct().orderBy("alerta")


def store_summary(items: DataFrame) -> DataFrame:
    """loja, itens, qtd, status, alertas: the worst status wins; alerts are different ones by first row (AGG-15). items: loja, qtd (long), alerta, row_id."""
    one = items.groupBy("loja", "alerta").agg(F.min("row_id").alias("at"), F.sum("qtd").alias("q"), F.count(F.lit(1)).alias("n"))
    said = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "alerta"))), lambda x: x["alerta"] != ""), lambda x: x["alerta"]), " | ")
    return one.groupBy("loja").agg(F.sum("n").alias("itens"), F.sum("q").alias("qtd"), F.when(F.max((F.col("alerta") != "").cast("int")) == 1, "ALERTA").otherwise("OK").alias("status"), said.alias("alertas"))


def file_results(rows: DataFrame, queued: DataFrame) -> DataFrame:
    """arquivo, lidas, validas, rejeitadas, inseridas, convertidos, status of each file (AGG-24). rows: arquivo, motivo_descarte, status_conversao; queued: arquivo."""
    n = lambda c: F.sum(c.cast("long"))
    ok = F.col("motivo_descarte") == ""
    x = rows.groupBy("arquivo").agg(F.count(F.lit(1)).alias("lidas"), n(ok).alias("validas"), n(~ok).alias("rejeitadas"), n(F.col("status_conversao") == "OK CONVERTIDO").alias("convertidos"))
    q = queued.groupBy("arquivo").agg(F.count(F.lit(1)).alias("inseridas"))
    status = F.when(F.col("validas") == 0, "ERRO").when(F.col("rejeitadas") > 0, "PARCIAL").otherwise("SUCESSO")
    return x.join(q, "arquivo", "left").withColumn("inseridas", F.coalesce("inseridas", F.lit(0).cast("long"))).withColumn("status", status)


def batch_counters(results: DataFrame) -> DataFrame:
    """One row: files by status and rows in all (AGG-19). results: as file_results gives them."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return results.agg(F.count(F.lit(1)).alias("arquivos"), n("SUCESSO").alias("sucesso"), n("PARCIAL").alias("parcial"), n("ERRO").alias("erro"), F.sum("lidas").alias("lidas"), F.sum("validas").alias("validas"), F.sum("inseridas").alias("inseridas"))


def pending_table(rejected: DataFrame) -> DataFrame:
    """Rejected rows with their status first, then the columns a reader looks at, then the rest (SNK-09)."""
    first = ("status_pendencia", "motivo_descarte", "pedido", "matricula", "cnpj", "sku", "ean", "qtd", "observacao")
    status = F.when(F.col("motivo_descarte").isin("MATRICULA_NAO_ENCONTRADA", "PENDENTE_MATRICULA"), "PENDENTE_CADASTRO").when(F.col("motivo_descarte").contains("CONVERSAO"), "PENDENTE_CONVERSAO").otherwise("PENDENTE_VALIDACAO")
    x = rejected.withColumn("status_pendencia", status)
    return x.select(*[c for c in first if c in x.columns], *[c for c in x.columns if c not in first])


def release_gates(rows: DataFrame, cases: dict[str, tuple[tuple[str, ...], bool, str | None]]) -> DataFrame:
    """caso, liberado, motivo, validas, bloqueantes: whether a batch may go on, for each case of tolerated reasons, official source and manual flag (FLT-11).

    rows: with status, "" for valid ones. A manual flag must be set on every valid row; without one only the official source passes, with valid rows and no blocking error.
    All cases are counted in one reading.
    """
    ok, said = F.col("status") == "", F.split("status", r" \| ")
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    counts = [count(ok).alias("validas")]
    for i, (tolerated, _, flag) in enumerate(cases.values()):
        counts.append(count(~ok & (F.size(S.kept(said, *tolerated)) > 0)).alias(f"b{i}"))
        counts.append((count(ok & ~F.upper(S.text(F.col(flag))).isin("SIM", "S", "OK", "1", "TRUE", "VALIDADO")) if flag else F.lit(0)).alias(f"s{i}"))
    judged = []
    for i, (name, (_, official, flag)) in enumerate(cases.items()):
        why = F.when(F.col("validas") == 0, "SEM_LINHAS_VALIDAS").when(F.col(f"s{i}") > 0, "FALTA_VALIDACAO_MANUAL").when(F.lit(flag is None and not official), "FONTE_NAO_OFICIAL").when(F.lit(flag is None) & (F.col(f"b{i}") > 0), "ERROS_BLOQUEANTES").otherwise("")
        judged.append(F.struct(F.lit(name).alias("caso"), (why == "").alias("liberado"), why.alias("motivo"), F.col("validas"), F.col(f"b{i}").alias("bloqueantes")))
    return rows.agg(*counts).select(F.inline(F.array(*judged)))


def release_gate(ok: DataFrame, rejected: DataFrame, tolerated: tuple[str, ...], official: bool, flag: str | None = None) -> DataFrame:
    """liberado, motivo, validas, bloqueantes of one case, from valid and rejected rows (FLT-11)."""
    valid = ok.select(F.lit("").alias("status"), *[F.col(c) for c in ([flag] if flag else [])])
    rows = valid.unionByName(rejected.select("status"), allowMissingColumns=True)
    return release_gates(rows, {"": (tolerated, official, flag)}).drop("caso")


def validation_report(rows: DataFrame, rejected: DataFrame, file: str, layout: str, now: str) -> dict[str, DataFrame]:
    """The tables of a validation report by name (SNK-04); those that would be empty have one row that says so."""
    valid = rows.join(rejected.select("row_id"), "row_id", "left_anti")
    bad = rows.join(rejected.select("row_id"), "row_id", "left_semi")
    model = model_table(valid, bad)
    return {
        "PAINEL_EXECUTIVO": executive_panel(rows, model, file, layout), "MODELO": or_placeholder(model, status_conversao="SEM LINHAS"), "VALIDACAO": or_placeholder(rows, observacao="SEM LINHAS"), "ITENS_BLOQUEADOS": blocked_items(rows),
        "DUPLICIDADES": or_placeholder(duplicates(rows), pedido="Nenhuma duplicidade"), "CADASTRAR": or_placeholder(rows.filter("matricula = '' AND cnpj <> ''").select("cnpj", "pedido").distinct(), cnpj="Nenhuma pendência"),
        "MANIFESTO": manifest(rows, model, file, layout, now), "PENDENCIAS": or_placeholder(pending_table(bad), motivo_descarte="Nenhuma"), "CONVERSAO": conversion_summary(rows),
        "REJEICOES": or_placeholder(bad.groupBy("motivo_descarte").agg(F.count(F.lit(1)).alias("linhas")), motivo_descarte="Nenhuma"),
    }


def attach_diagnostics(report: dict[str, DataFrame], **tables: DataFrame) -> dict[str, DataFrame]:
    """report with more tables; one of the same name is replaced (SNK-10)."""
    return report | tables


def failure_report(spark, file: str, layout: str, alerts: list[str]) -> dict[str, DataFrame]:
    """The report of a file that couldn't be read (SNK-11)."""
    x = spark.createDataFrame([(file, layout, a) for a in alerts or ["Falha de leitura"]], "arquivo string, layout string, alerta string")
    return {"ALERTAS_ERROS": x, "RESUMO": x.groupBy("arquivo", "layout").agg(F.count(F.lit(1)).alias("alertas"))}


def lot_report(items: DataFrame, issues: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a lot's report by name (SNK-05). items: row_id, arquivo, push, pedido, loja, matricula, sku, qtd, alerta, lote; issues: arquivo, pedido, tipo; files: lote, arquivo, itens, pedido, cnpj, matricula."""
    return {
        "ITENS": items, "PROBLEMAS": or_placeholder(issues, tipo="NENHUM"), "RESUMO_PUSH": lots.push_summary(items), "STATUS_PEDIDOS": lots.order_status(items), "LOJAS": items.select("loja").filter("loja <> ''").distinct(), "RESUMO_LOJAS": store_summary(items),
        "PROBLEMAS_POR_TIPO": lots.issue_counts(issues), "TOTAIS": lots.lot_success(files), "DUPLICADOS": or_placeholder(lots.duplicate_mirror(items), pedido="NENHUM"), "FILA": lots.gated_queue(items, issues), "METADADOS": files,
    }


def archive(outputs: DataFrame, path: str, run_date: str, run: str = "1") -> DataFrame:
    """Keeps outputs (tipo, arquivo, ...) under their date, run and kind; returns counts by kind (SNK-06). Runs of a day add up, a rerun of one replaces its own."""
    return partition_sets.write_set(outputs, path, {"run_date": run_date, "run": run}, ("tipo",))


def newest_first(outputs: DataFrame) -> DataFrame:
    """SRT-06."""
    return outputs.orderBy(F.desc("modificado"), "arquivo")
