"""Lots and batches: from documents and forms to reports and queue rows (PIPE-04 to PIPE-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scalars as S
from ..operators import customers, detection, identity, lines, lot_items, lots, reports, resolve, rules, sheets
from ..operators.identity import Layout
from ..sources import tables
from ..sources.shared import cut
from . import standardize

#: What a report's columns may be called.
ALIASES = {"matricula": "Matricula|Matrícula|Matrícula ou CNPJ", "sku": "Sku|SKU|Código SKU", "qtd": "Qtd|QTD|Quantidade", "pedido": "Nº Pedido|Numero Pedido|Pedido", "data_remessa": "Data remessa|Data Remessa|Data Entrega"}
ACCEPTED = ("SIM", "S", "OK", "1", "TRUE", "VALIDADO")


def approve_to_queue(report: DataFrame, flag: str | None = None, conversion: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of an approved report that may enter the queue, and the others with motivos (PIPE-04, FLT-04).

    Columns are found by their aliases. A customer that is pending, a quantity that isn't whole and positive, a blank
    field, a manual flag that isn't set or a conversion that isn't done keep a row out.
    """
    more = [(f"_{c}", "COLUNA", c) for c in (flag, conversion) if c]
    x = tables.apply_mapping(report, [(t, "COLUNA", a) for t, a in ALIASES.items()] + more)
    why = F.array(
        F.when(F.upper("matricula").isin("", "A CADASTRAR", "PENDENTE"), "MATRICULA"), F.when(F.col("sku") == "", "SKU"), F.when(N.gate_quantity(F.col("qtd")).isNull(), "QTD"), F.when(F.col("pedido") == "", "PEDIDO"), F.when(F.col("data_remessa") == "", "DATA"),
        F.when(~F.upper(F.col(f"_{flag}")).isin(*ACCEPTED), "MARCA") if flag else F.lit(None).cast("string"), F.when(identity.conversion_blocks(F.col(f"_{conversion}")), "CONVERSAO") if conversion else F.lit(None).cast("string"),
    )
    x = S.once(x, motivos=F.concat_ws(" | ", F.array_compact(why))).drop(*[t for t, _, _ in more])
    ok = x.filter("motivos = ''").withColumn("qtd", N.gate_quantity(F.col("qtd")).cast("string")).drop("motivos")
    return ok, x.filter("motivos <> ''")


def process_lot(text_lines: DataFrame, base: DataFrame, history: DataFrame) -> DataFrame:
    """file, line_no, pedido, sku, qtd, cnpj, matricula, repetido, no_historico of a lot's documents (PIPE-05).

    Items are read with their order and company number, customers found by the base, orders that an earlier push had
    or that another file of the lot has are flagged. base: row_id, cnpj, matricula; history: pedido.
    """
    x = lines.with_context(text_lines, {"pedido": lines.ORDER, "cnpj": lines.CNPJ}).filter(F.col("line").rlike(lines.ITEM))
    field = lambda g: F.regexp_extract("line", lines.ITEM, g)
    x = x.select("file", "line_no", "pedido", field(1).alias("sku"), field(5).cast("long").alias("qtd"), S.digits(F.col("cnpj")).alias("cnpj"))
    keys = x.select("cnpj").distinct().withColumn("row_id", F.xxhash64("cnpj"))
    found = resolve.resolve_by_cnpj(keys, base, "cnpj").select("cnpj", F.col("achada").alias("matricula"))
    many = x.groupBy("pedido").agg(F.countDistinct("file").alias("n")).filter("n > 1").select("pedido", F.lit(True).alias("repetido"))
    known = history.select("pedido").distinct().withColumn("no_historico", F.lit(True))
    x = x.join(found, "cnpj", "left").join(many, "pedido", "left").join(known, "pedido", "left")
    return x.withColumns({"matricula": F.coalesce("matricula", F.lit("")), "repetido": F.coalesce("repetido", F.lit(False)), "no_historico": F.coalesce("no_historico", F.lit(False))})


#: How documents of a lot write their order number, in order of trust.
ORDER_FORMS = (
    r"(?i)P\s*E\s*D\s*I\s*D\s*O\s*D\s*E\s*C\s*O\s*M\s*P\s*R\s*A\s*:\s*([0-9]+)", r"(?iu)N[uú]mero\s+do\s+Pedido\s*:\s*([0-9]+)", r"(?iu)N[uú]mero\s+Pedido\s*:\s*([0-9]+)",
    r"(?iu)N[ºo°]?\s*Pedido\s*:\s*([0-9]+)", r"(?i)Pedido\s*[:\-]\s*([0-9]{4,})",
)


def run_lot(text_lines: DataFrame, entries: DataFrame, fallback: DataFrame, history: DataFrame, scores: dict[str, int], supplier: tuple[str, ...], today: str, with_duplicates: bool = False, with_alerts: bool = False, written: bool = False) -> dict[str, DataFrame]:
    """A lot's documents to files, items, issues and queue (PIPE-05).

    Of each file the order number, delivery company number and store are read from its text, its items from tables of two formats
    (EX-15). Customers come from entries (row_id, rede, cnpj, matricula), of which several of a number are told apart by scores of
    their network's name, else from fallback (chave, matricula). A file without items is FORA_LAYOUT. Orders that an earlier file of the lot (by name) or
    history (pedido) has are issues. The queue leaves out repeated orders, those with any issue and incomplete rows, each with its reason.
    Lines are dealt by file once, and a file's items and notes stay beside its figures as one row, so that no text is read again for each result.
    written: files, with what was read of them, are written to the shared folder once, for whoever takes the queue, which needs them more than once, or several results.
    """
    text_lines = text_lines.select("file", "page", "line_no", "line").repartition("file")
    by_place = F.array_join(F.sort_array(F.collect_list(F.struct("page", "line_no", "line")))["line"], "\n")
    docs = text_lines.groupBy(F.col("file").alias("row_id")).agg(by_place.alias("texto"))
    number, name = detection.store_identity(F.col("texto"), F.lit(""))
    numbered = S.once(docs, pedido=lines.order_number(F.col("texto"), F.lit(""), ORDER_FORMS), loja_numero=number, loja_nome=name)
    base = resolve.resolve_conflicts(entries, scores).select(F.col("cnpj").alias("chave"), F.col("escolhida").alias("matricula"))
    places = detection.delivery_cnpj(numbered, base.select(F.col("chave").alias("cnpj")), supplier, "pedido", "loja_numero", "loja_nome")
    found = resolve.resolve_with_divergence(places.withColumnRenamed("cnpj", "chave"), base, fallback)
    heads = found.withColumnsRenamed({"chave": "cnpj", "row_id": "file"})

    first = numbered.filter("pedido <> ''").groupBy("pedido").agg(F.min("row_id").alias("primeiro"), F.count(F.lit(1)).alias("arquivos"))
    known = history.select("pedido").distinct().withColumn("no_historico", F.lit(True))
    files = heads.join(lot_items.items_by_file(text_lines), "file", "left").join(first, "pedido", "left").join(known, "pedido", "left").fillna(0, ["itens"])
    why = F.array_compact(F.array(
        F.when(F.col("pedido") == "", "PEDIDO_NAO_ENCONTRADO"), F.when(F.col("cnpj") == "", "CNPJ_NAO_ENCONTRADO"), F.when(F.col("origem") == "DIVERGENTE", "DIVERGENCIA_BH_GLN"), F.when(F.col("origem") == "RESERVA", "MATRICULA_VIA_GLN"),
        F.when((F.col("origem") == "NENHUMA") & (F.col("cnpj") != ""), "MATRICULA_NAO_ENCONTRADA"), F.when(F.col("itens") == 0, "SEM_ITENS"), F.when(F.col("itens") == 0, "PEDIDO_FORA_LAYOUT"),
        F.when((F.col("itens") > 0) & (F.col("file") > F.col("primeiro")), "PEDIDO_REPETIDO_PUSH"), F.when((F.col("itens") > 0) & F.col("no_historico"), "PEDIDO_REPETIDO_HISTORICO"),
    ))
    complete = (F.col("itens") > 0) & (F.col("pedido") != "") & (F.col("cnpj") != "") & (F.col("matricula") != "")
    files = files.withColumns({"alertas": why, "situacao": F.when(F.col("itens") == 0, "FORA_LAYOUT").otherwise("OK"), "sucesso": complete})
    files = cut(files) if written else files
    of_file = F.array(F.struct(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("linha"), "alertas"))
    of_lines = F.transform("lidas", lambda r: F.struct(r["page"].alias("page"), r["line_no"].alias("line_no"), r["texto"].alias("linha"), r["alertas"].alias("alertas")))
    issues = files.select("file", "pedido", F.inline(F.concat(of_file, F.coalesce(of_lines, F.array()))))
    issues = issues.select("file", "pedido", "page", "line_no", F.explode("alertas").alias("tipo"), "linha")
    rows = files.select("file", "pedido", "cnpj", "matricula", "loja_numero", "loja_nome", F.inline("lidas")).filter("formato <> ''").drop("texto", "alertas")
    gate = lots.gated(rows.withColumn("arquivo", F.col("file")), issues.filter("pedido <> ''"), with_duplicates, with_alerts)
    day = F.date_format(F.date_add(F.lit(today).cast("date"), 1), "dd/MM/yyyy")
    queue = gate.select("file", "page", "line_no", "matricula", "sku", "qtd", "pedido", day.alias("data_remessa"), "alerta")
    return {"files": files.drop("primeiro", "no_historico", "lidas"), "items": rows, "issues": issues, "queue": queue}


def judge_batch(items: DataFrame, results: DataFrame, layouts: dict[str, Layout], base: DataFrame, xref: DataFrame, today: str) -> DataFrame:
    """items of files of several layouts, standardised, with motivo_descarte.

    items: arquivo and what was read; results: arquivo, layout, modo, confianca, as detection gives them. Layouts are a
    dimension that rows are joined with, so all are one job, whose plan doesn't grow with their number; rows of no known layout stay as they were read.
    """
    known = identity.layouts_frame(items.sparkSession, layouts).withColumnRenamed("nome", "layout_referencia")
    x = detection.stamp_tracking(items, results).join(known, "layout_referencia", "left")
    judged = standardize.judge_orders(x.filter("_layout_name IS NOT NULL"), "_layout_", base, xref, today)
    return judged.unionByName(x.filter("_layout_name IS NULL").withColumn("motivo_descarte", F.lit("LAYOUT_NAO_SUPORTADO")), allowMissingColumns=True)


def import_batch(items: DataFrame, results: DataFrame, layouts: dict[str, Layout], base: DataFrame, xref: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Queue rows, and rows left out with motivo_descarte, of files of several layouts, as judge_batch has them (PIPE-06)."""
    x = judge_batch(items, results, layouts, base, xref, today)
    return standardize.queue_rows(x.filter("motivo_descarte = ''"), "arquivo"), x.filter("motivo_descarte <> ''").select("row_id", "arquivo", "motivo_descarte")


def import_lines(lines_: DataFrame, files: DataFrame, rules_: DataFrame, layouts: dict[str, Layout], base: DataFrame, xref: DataFrame, today: str) -> dict[str, DataFrame]:
    """Text lines of files of many layouts to queue rows in one job (PIPE-06).

    files: file, layout, modo, as detect_layout gives them; rules_: layout rules as rows. Lines are read by their file's rule, items
    standardised by their file's layout. queue: row_id, arquivo and the queue's columns; left: row_id, arquivo, motivo_descarte;
    files: arquivo, layout, modo, lidos, na_fila, fora, sem_leitura, status. A row is known by file, page and line.
    Layouts of files and items are written to the shared folder once, as customers are looked up by them more than once, and lines cost most.
    """
    known = cut(files.select("file", "layout", "modo"))
    read = rules.read_lines(lines_.drop("layout").join(known.drop("modo"), "file"), rules_)
    found = rules.rule_items(read)
    unread = F.col("tipo") == "NAO_LIDA"
    items = found.select(
        F.concat_ws(":", "file", "page", "line_no").alias("row_id"), F.col("file").alias("arquivo"), F.lit("").alias("matricula_lida"), F.col("cnpj").alias("cnpj_lido"), F.lit("").alias("gln_lido"), F.col("ean").alias("ean_lido"), F.col("sku").alias("sku_lido"),
        F.col("qtd").alias("quantidade_lida"), F.col("pedido").alias("numero_pedido_lido"), F.col("dia").alias("data_entrega_lida"), F.col("descricao").alias("descricao_lida"), F.col("codigo").alias("codigo_origem_lido"), F.col("layout").alias("layout_usado"),
        F.when(unread, "ALERTA_LEITURA").otherwise("OK").alias("status_extracao"), F.array_join("alertas", " | ").alias("alerta_extracao"), F.lit("").alias("status_conversao"),
    )
    results = known.select(F.col("file").alias("arquivo"), "layout", "modo", F.lit(100).alias("confianca"))
    x = judge_batch(cut(items), results, layouts, base, xref, today)
    out = F.col("motivo_descarte") != ""
    told = x.groupBy("arquivo").agg(F.count_if(~out).alias("na_fila"), F.count_if(out).alias("fora"), F.count_if(F.col("status_extracao") == "ALERTA_LEITURA").alias("sem_leitura"))
    told = results.drop("confianca").join(told, "arquivo", "left").fillna(0, ["na_fila", "fora", "sem_leitura"])
    status = F.when((F.col("na_fila") + F.col("fora")) == 0, "SEM_ITENS").when(F.col("fora") == 0, "OK").when(F.col("na_fila") == 0, "REJEITADO").otherwise("PARCIAL")
    return {"queue": standardize.queue_rows(x.filter(~out), "arquivo"), "left": x.filter(out).select("row_id", "arquivo", "motivo_descarte"), "files": told.withColumns({"lidos": F.col("na_fila") + F.col("fora"), "status": status})}


def company_batch(cells: DataFrame, header: int, sku_column: int, stores: DataFrame, dates: DataFrame) -> DataFrame:
    """sheet, r, c, cnpj, matricula, sku, qtd, data_remessa of order sheets by store, with days of companion files (PIPE-07)."""
    x = sheets.unpivot_divisor(cells, header, sku_column)
    x = customers.resolve_store(x, stores, "loja")
    return customers.attach_date_map(x, dates).select("sheet", "r", "c", "cnpj", "matricula", "sku", "qtd", "data_remessa")


def email_batch(messages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the day of their shipment by message, and a summary by region (PIPE-08). items: row_id, matricula, pedido, regional, sku, qtd (long)."""
    ships = tables.email_shipments(messages).select(F.struct("row_id", "line_no").alias("row_id"), "regional", "matricula", "pedido", F.date_format("data", "dd.MM.yyyy").alias("data_remessa"))
    first = resolve.dedup_shipments(ships).select("row_id")
    told = customers.attach_ship_date_tiers(items, ships.join(first, "row_id"))
    x = items.join(told, "row_id")
    return x, reports.store_summary(x.select("row_id", F.col("regional").alias("loja"), "qtd", "alerta"))


