"""Text lines of documents to order items, with context carried along the lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ORDER, CNPJ = r"^PEDIDO DE COMPRAS ([0-9]+)/", r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})"
ITEM, CANDIDATE, TOTAL = r"^([0-9]{6}) ([0-9]+) (.+) CX ([0-9]+) ([0-9]+),00 [0-9]+,[0-9]{4}$", r"^[0-9]{6} ", r"^TOTAIS ([0-9]+),00$"


def captured(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def with_context(lines: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """lines with the last value of each pattern so far in its file, "" before the first (EX-02, WIN-01)."""
    so_far = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    context = context or {"pedido": ORDER}
    return lines.withColumns({name: F.coalesce(F.last(captured(F.col("line"), p), ignorenulls=True).over(so_far), F.lit("")) for name, p in context.items()})


def extract_items(lines: DataFrame) -> DataFrame:
    """Item lines as fields; candidates that don't fit become rows with an alert (EX-01)."""
    x = with_context(lines).filter(F.col("line").rlike(CANDIDATE))
    field = lambda g: F.regexp_extract("line", ITEM, g)
    return x.select("file", "line_no", "pedido", field(1).alias("sku"), F.coalesce(field(5).try_cast("long"), F.lit(0)).alias("qtd"), F.when(F.col("line").rlike(ITEM), F.lit("")).otherwise(F.lit("LINHA_NAO_LIDA")).alias("alerta"))


def reconcile_totals(lines: DataFrame) -> DataFrame:
    """Each order's printed total against the sum of its items (AGG-03)."""
    x = with_context(lines).withColumns({"q": F.regexp_extract("line", ITEM, 5).try_cast("long"), "t": F.regexp_extract("line", TOTAL, 1).try_cast("long"), "broken": F.col("line").rlike(CANDIDATE) & ~F.col("line").rlike(ITEM)})
    x = x.groupBy("file", "pedido").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("soma"), F.max("t").alias("total"), F.max("broken").alias("pendente"))
    status = F.when(F.col("total").isNull(), "SEM_TOTAL").when(F.col("total") != F.col("soma"), "DIVERGENTE").when(F.col("pendente"), "OK_PENDENTE").otherwise("OK")
    return x.select("file", "pedido", "soma", F.coalesce("total", F.lit(-1)).alias("total"), status.alias("situacao"))


def order_blocks(lines: DataFrame) -> DataFrame:
    """Block number of each line, counted by order headers, and the block's lines (WIN-07)."""
    so_far = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("bloco", F.sum(F.col("line").rlike(ORDER).cast("long")).over(so_far))
    return x.groupBy("file", "bloco").agg(F.count(F.lit(1)).alias("linhas"), F.min("line_no").alias("primeira"))


def joined_broken(lines: DataFrame) -> DataFrame:
    """Broken item lines with the line that follows (WIN-05)."""
    following = F.lead("line").over(Window.partitionBy("file").orderBy("page", "line_no"))
    x = lines.withColumn("inteira", F.concat_ws(" ", "line", following))
    return x.filter(F.col("line").rlike(CANDIDATE) & ~F.col("line").rlike(ITEM)).select("file", "line_no", "inteira")


def page_audit(lines: DataFrame) -> DataFrame:
    """Lines, orders and item lines of each file (AGG-17)."""
    n = lambda p: F.sum(F.col("line").rlike(p).cast("long"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("linhas"), n(ORDER).alias("pedidos"), n(ITEM).alias("itens"))


def unique_lines(lines: DataFrame) -> DataFrame:
    """Each line once in its page and order (SET-04)."""
    return with_context(lines).groupBy("file", "page", "pedido", "line").agg(F.min("line_no").alias("line_no"))


def item_section(lines: DataFrame) -> DataFrame:
    """Lines between an order's header and its totals (WIN-06): a marker opens or closes all that follow it."""
    so_far = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(ORDER), True).when(F.col("line").rlike(TOTAL), False)
    x = lines.withColumn("_open", F.last(mark, ignorenulls=True).over(so_far))
    return x.filter(F.col("_open") & ~F.col("line").rlike(ORDER)).drop("_open")


def with_following_value(lines: DataFrame, label: str, value: str, ahead: int = 3) -> DataFrame:
    """file, line_no, valor: label lines with the first value on one of the next lines, "" if another label comes before it (WIN-04)."""
    w = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(1, ahead)
    is_label, found = F.col("line").rlike(label), captured(F.col("line"), value)
    following = F.first(F.when(is_label | found.isNotNull(), F.coalesce(found, F.lit(""))), ignorenulls=True).over(w)
    return lines.withColumn("valor", F.coalesce(following, F.lit(""))).filter(is_label).select("file", "line_no", "valor")


def with_following_total(lines: DataFrame) -> DataFrame:
    """file, line_no, total: order headers with the total printed within the next 20 lines, if no other order begins before it."""
    return with_following_value(lines, ORDER, TOTAL, 20).withColumnRenamed("valor", "total")


def attach_trailing(lines: DataFrame, item: str, trailing: str, ahead: int = 8) -> DataFrame:
    """file, line_no, extra: item lines with what trailing lines after them, before the next item, tell; several are joined (J-18)."""
    so_far = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(Window.partitionBy("file").orderBy("page", "line_no"))
    x = lines.withColumns({"_n": number, "_item": F.col("line").rlike(item), "_extra": captured(F.col("line"), trailing)})
    x = x.withColumn("_of", F.last(F.when(F.col("_item"), F.struct(F.col("line_no"), F.col("_n").alias("n"))), ignorenulls=True).over(so_far))
    told = x.filter("_extra IS NOT NULL AND NOT _item AND _of IS NOT NULL").filter(F.col("_n") - F.col("_of.n") <= ahead)
    told = told.groupBy("file", F.col("_of.line_no").alias("line_no")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_n", "_extra")))["_extra"], " ").alias("extra"))
    return x.filter("_item").select("file", "line_no").join(told, ["file", "line_no"], "left").withColumn("extra", F.coalesce("extra", F.lit("")))


def back_filled(items: DataFrame, lines: DataFrame) -> DataFrame:
    """items (file, cnpj) with the file's only company number where no row of it has one (WIN-03)."""
    numbers = lines.select("file", captured(F.col("line"), CNPJ).alias("n")).filter("n IS NOT NULL").groupBy("file").agg(F.min("n").alias("_only"), F.countDistinct("n").alias("_k")).filter("_k = 1")
    none = items.groupBy("file").agg(F.max("cnpj").alias("_m")).filter("_m = ''").select("file")
    fill = numbers.join(none, "file").select("file", "_only")
    return items.join(fill, "file", "left").withColumn("cnpj", F.coalesce("_only", "cnpj")).drop("_only")


def order_of_line(lines: DataFrame, pattern: str, header: str) -> DataFrame:
    """lines with pedido: the line's own number, else the last before it, else the file's header, else a dot (WIN-14)."""
    so_far = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = captured(F.col("line"), pattern)
    return lines.withColumn("pedido", F.coalesce(own, F.last(own, ignorenulls=True).over(so_far), F.nullif(F.col(header), F.lit("")), F.lit(".")))


def flagged_repeats(items: DataFrame, key: list[str]) -> DataFrame:
    """items with repetido: the second and later rows of a key, which stay (SET-08)."""
    return items.withColumn("repetido", F.row_number().over(Window.partitionBy(*key).orderBy("line_no")) > 1)


def sum_by_order_sku(items: DataFrame) -> DataFrame:
    """file, pedido, sku, qtd (sum), ean (of the first row), n: articles of each order, numbers in order, other codes last (AGG-02, SRT-01)."""
    x = items.groupBy("file", "pedido", "sku").agg(F.sum("qtd").alias("qtd"), F.min_by("ean", "line_no").alias("ean"))
    place = Window.partitionBy("file", "pedido").orderBy(F.expr("try_cast(sku AS BIGINT)").asc_nulls_last(), "sku")
    return x.withColumn("n", F.row_number().over(place).cast("long"))


def page_engines(pages: DataFrame) -> DataFrame:
    """file, paginas, sem_texto, motores (pages by engine): audit of reading (AGG-17). pages: file, page, texto, motor."""
    x = pages.groupBy("file", "motor").agg(F.count(F.lit(1)).alias("n"), F.sum((F.trim("texto") == "").cast("long")).alias("sem"))
    said = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "motor", F.col("n").cast("string")))), ", ")
    return x.groupBy("file").agg(F.sum("n").alias("paginas"), F.sum("sem").alias("sem_texto"), said.alias("motores"))


def finalize_read(audit: DataFrame, items: DataFrame) -> DataFrame:
    """file, itens, com_alerta, status: what reading a file came to; pages without text and no item are a failure (EX-26)."""
    n = items.groupBy("file").agg(F.count(F.lit(1)).alias("itens"), F.sum((F.col("alerta") != "").cast("long")).alias("com_alerta"))
    x = audit.join(n, "file", "left").fillna(0, ["itens", "com_alerta"])
    status = F.when((F.col("itens") == 0) & (F.col("sem_texto") > 0), "FALHA_SEM_TEXTO").when(F.col("itens") == 0, "FALHA_SEM_ITENS").when((F.col("com_alerta") > 0) | (F.col("sem_texto") > 0), "OK_COM_ALERTA").otherwise("OK")
    return x.select("file", "itens", "com_alerta", status.alias("status"))


def order_number(text: Column, file: Column, patterns: tuple[str, ...], name_pattern: str = "[0-9]{5,}") -> Column:
    """The first pattern that matches a text, else the file's name, else "" (EX-24)."""
    return F.coalesce(*[captured(text, p) for p in patterns], captured(file, name_pattern, 0), F.lit(""))


def page_header(lines: DataFrame) -> DataFrame:
    """file, page, pedido, cnpj: the order a page begins with (or goes on with) and the last company number on it (EX-22)."""
    x = with_context(lines).groupBy("file", "page").agg(F.max_by("pedido", "line_no").alias("pedido"), F.max_by(captured(F.col("line"), CNPJ), F.when(F.col("line").rlike(CNPJ), F.col("line_no"))).alias("cnpj"))
    return x.withColumn("cnpj", F.coalesce("cnpj", F.lit("")))


def by_tokens(lines: DataFrame) -> DataFrame:
    """file, line_no, ean, sku, qtd of lines with a bar code: an article within six tokens after it, then the number before the first price (EX-04)."""
    t = F.split(F.trim("line"), " +")
    at = F.array_position(F.transform(t, lambda x: x.rlike("^[0-9]{13}$")), True).cast("int")
    x = lines.withColumns({"_t": t, "_at": at}).filter("_at > 0")
    after = F.slice("_t", F.col("_at") + 1, 6)
    code = F.get(F.filter(after, lambda v: v.rlike("^[0-9]{5,8}$")), 0)
    price = F.array_position(F.transform("_t", lambda v: v.rlike("^[0-9.]+,[0-9]{2,4}$")), True).cast("int")
    number = F.when(price > F.col("_at") + 1, F.get("_t", price - 2))
    return x.select("file", "line_no", F.get("_t", F.col("_at") - 1).alias("ean"), F.coalesce(code, F.lit("")).alias("sku"), F.when(number.rlike("^[0-9]+$"), number).otherwise("").alias("qtd"))


def compact_records(lines: DataFrame) -> DataFrame:
    """file, line_no, matricula, pedido, dia of lines with two numbers of six digits or more and a day (EX-05)."""
    numbers = F.regexp_extract_all("line", F.lit(r"(?<![0-9./-])[0-9]{6,12}(?![0-9./-])"), F.lit(0))
    day = F.regexp_extract("line", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", 0)
    return lines.select("file", "line_no", F.get(numbers, 0).alias("matricula"), F.get(numbers, 1).alias("pedido"), day.alias("dia")).filter("pedido IS NOT NULL AND dia <> ''")


def roles(line: Column) -> dict[str, Column]:
    """FLT-31: what a line of a record written downwards may be."""
    s, d = F.translate(F.upper(F.trim(line)), S.ACCENTS, S.PLAIN), F.regexp_replace(line, "[^0-9]", "")
    day = line.rlike(r"^\s*[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\s*$")
    return {"regional": s.isin("PR", "SC", "SP", "MG", "RS", "POA", "CTBA", "CTL", "SP-HORT") | s.rlike("HORT|SUMARE|CURITIBA|PORTO ALEGRE"), "matricula": F.length(d).between(7, 12) & ~day, "pedido": F.length(d).between(6, 12) & ~day, "data": day}


def assemble_vertical(lines: DataFrame) -> DataFrame:
    """file, n, regional, matricula, tipo, pedido, dia: records of which each field is on a line of its own (EX-03).

    A record begins at a customer number after a region, delivery kind or day; the region is the last before it. Of the
    lines that follow, the first order number and the first day count. Sorts and windows hold a line's text and one number
    that says what it may be.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    r = roles(F.col("line"))
    x = S.once(lines.select("file", "line_no", "line"), _text=F.trim("line"), _reg=r["regional"], _mat=r["matricula"], _ped=r["pedido"], _dia=r["data"], _tipo=F.upper("line").contains("ENTREGA"))
    bits = {1: F.col("_reg"), 2: F.col("_mat"), 4: F.col("_ped"), 8: F.col("_dia"), 16: F.col("_tipo"), 32: F.coalesce(F.col("_reg") | F.col("_dia"), F.lit(True))}
    said = reduce(lambda a, b: a + b, [F.when(test, bit).otherwise(0) for bit, test in bits.items()])
    x = x.select("file", "line_no", said.alias("_said"), F.when(F.col("_reg") | F.col("_mat") | F.col("_ped") | F.col("_dia") | F.col("_tipo"), F.col("_text")).alias("_text"))
    is_ = lambda bit: F.col("_said").bitwiseAND(bit) != 0
    x = x.withColumn("_new", is_(2) & F.coalesce(F.lag(is_(32)).over(order), F.lit(True)))
    x = x.withColumns({"n": F.sum(F.col("_new").cast("long")).over(so_far), "_region": F.last(F.when(is_(1), F.col("_text")), ignorenulls=True).over(so_far)})
    x = x.filter((F.col("n") > 0) & (F.col("_new") | is_(4 | 8 | 16)))
    first = lambda test, what="_text": F.min_by(what, F.when(test, F.col("line_no")))
    x = x.withColumn("_region", F.when(F.col("_new"), F.col("_region")))
    x = x.groupBy("file", "n").agg(first(F.col("_new"), F.struct("_region", "_text")).alias("_head"), first(is_(16)).alias("tipo"), first(is_(4) & ~F.col("_new")).alias("pedido"), first(is_(8)).alias("dia"))
    or_blank = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return x.select("file", "n", or_blank(F.col("_head._region"), "regional"), or_blank(F.col("_head._text"), "matricula"), *[or_blank(F.col(c), c) for c in ("tipo", "pedido", "dia")])


def generic_items(lines: DataFrame) -> DataFrame:
    """file, line_no, codigo, qtd, alerta of any line that may be an item (EX-06).

    The code is the first number of five to eight digits, else a bar code, never one of 12 or 14 digits; the quantity is the last whole number before the first
    of two money values at the end, else the last one after the code. All are of low confidence.
    """
    t = F.filter(F.split(F.trim("line"), " +"), lambda v: v != "")
    money = lambda v: v.rlike("^[0-9.]+,[0-9]{2,4}$")
    x = lines.withColumn("_t", t)
    short, bar = F.filter("_t", lambda v: v.rlike("^[0-9]{5,8}$")), F.filter("_t", lambda v: v.rlike("^[0-9]{13}$"))
    x = x.withColumn("codigo", F.coalesce(F.get(short, 0), F.get(bar, 0)))
    cut = F.array_position(F.transform("_t", money), True).cast("int")
    before = F.when(cut > 0, F.slice("_t", 1, cut - 1)).otherwise(F.col("_t"))
    whole = F.filter(before, lambda v: v.rlike("^[0-9]{1,5}$") & (v != F.col("codigo")))
    number = F.regexp_extract(F.get(F.filter("_t", money), 0), "^([0-9.]+),00$", 1)
    quantity = F.coalesce(F.when(F.size(whole) > 0, F.element_at(whole, -1)), F.nullif(F.regexp_replace(number, "[.]", ""), F.lit("")), F.lit(""))
    return x.filter("codigo IS NOT NULL").select("file", "line_no", "codigo", quantity.alias("qtd"), F.lit("BAIXA_CONFIANCA").alias("alerta"))


def case_item(items: DataFrame, layout: str, rule: str) -> DataFrame:
    """items with what says that they are in cases already, and where they come from (EX-25)."""
    return items.withColumns({"layout_usado": F.lit(layout), "origem_extracao": F.lit("PARSER_DEDICADO"), "status_conversao": F.lit("OK SEM CONVERSÃO"), "regra_aplicada_conversao": F.lit(rule), "qtd_final": F.col("qtd").cast("string")})
