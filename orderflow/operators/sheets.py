"""Spreadsheet cells and positioned words to order items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scalars as S
from ..functions import texts as X


def matrix_items(cells: DataFrame, header: int = 1, article: int = 1, first: int = 3) -> DataFrame:
    """file, matricula, sku, qtd of a sheet with articles down and customers across (EX-07); only positive whole numbers count.

    cells: file, sheet, r, c, v. The two labels of a cell are found by joins on its column and on its row.
    """
    across = cells.filter(F.col("r") == header).select("file", "sheet", "c", F.col("v").alias("matricula")).filter("matricula <> ''")
    down = cells.filter((F.col("c") == article) & (F.col("r") >= first)).select("file", "sheet", "r", F.col("v").alias("sku")).filter("sku <> ''")
    body = cells.filter((F.col("r") >= first) & (F.col("c") > article) & F.col("v").rlike("^0*[1-9][0-9]{0,17}$"))
    x = body.join(across, ["file", "sheet", "c"]).join(down, ["file", "sheet", "r"])
    return x.select("file", "matricula", "sku", F.col("v").cast("long").alias("qtd"))


def visual_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """words with linha: a new line begins where a word lies more than gap below the one before it (WIN-08)."""
    page = Window.partitionBy("file", "page").orderBy("top", "x0")
    new = F.coalesce((F.col("top") - F.lag("top").over(page) > gap).cast("long"), F.lit(1))
    return words.withColumn("_new", new).withColumn("linha", F.sum("_new").over(page)).drop("_new")


def line_texts(words: DataFrame) -> DataFrame:
    """file, page, linha, texto: the words of each visual line from left to right."""
    x = visual_lines(words).groupBy("file", "page", "linha").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"))
    return x.select("file", "page", "linha", F.array_join("w.text", " ").alias("texto"))


def band(x: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """Name of the half-open band that holds x, null if none does (J-16)."""
    return F.coalesce(*[F.when((x >= lo) & (x < hi), F.lit(name)) for name, (lo, hi) in bands.items()])


def nearest(x: Column, centres: dict[str, float], within: float = 24.0) -> Column:
    """Name of the centre nearest to x, the first of equals; null beyond that distance (J-17)."""
    near = F.array_min(F.array(*[F.struct(F.abs(x - at).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, at) in enumerate(centres.items())]))
    return F.when(near["d"] <= within, near["name"])


def _upto(starts: Column, x: Column) -> Column:
    """How many of the ascending starts are at most x, by halving steps: of 8,191 at most."""
    fits = lambda at, step: (at + step <= F.size(starts)) & (F.get(starts, at + step - 1) <= x)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(12, -1, -1)]), F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def assign_bands(words: DataFrame, bands: DataFrame, into: str = "faixa") -> DataFrame:
    """words with the name of their file's band that holds x0, null if none does (J-16).

    bands: file, nome, lo, hi; half-open, those of a file don't overlap, so the band is the last that begins at or before a word. Each file's bands are one sorted
    row, met by an equality of files and searched by halving; files without bands keep their words.
    """
    own = bands.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "nome"))).alias("_b"))
    x = words.join(own, "file", "left").withColumn("_at", F.get("_b", _upto(F.col("_b.lo"), F.col("x0")) - 1))
    return x.withColumn(into, F.when(F.col("x0") < F.col("_at.hi"), F.col("_at.nome"))).drop("_b", "_at")


def assign_nearest(words: DataFrame, centres: DataFrame, within: float = 24.0, into: str = "alvo") -> DataFrame:
    """words with the name of their file's centre nearest to their middle, the smaller of equals; null beyond that distance (J-17).

    centres: file, nome, x, as header_centres finds them. Of a file's sorted centres only the last before a word and the next one can be nearest.
    """
    own = centres.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("x", "nome"))).alias("_c"))
    middle = (F.col("x0") + F.col("x1")) / 2
    x = words.join(own, "file", "left").withColumn("_at", _upto(F.col("_c.x"), middle))
    left, right = F.get("_c", F.col("_at") - 1), F.get("_c", F.col("_at"))
    x = x.withColumns({"_l": left, "_r": right, "_m": middle})
    nearer = F.when(F.col("_r").isNull() | (F.col("_m") - F.col("_l.x") <= F.col("_r.x") - F.col("_m")), F.col("_l")).otherwise(F.col("_r"))
    x = x.withColumn("_n", nearer)
    return x.withColumn(into, F.when(F.abs(F.col("_m") - F.col("_n.x")) <= within, F.col("_n.nome"))).drop("_c", "_at", "_l", "_r", "_m", "_n")


def header_centres(words: DataFrame, pattern: str) -> DataFrame:
    """file, nome, x: middles of the words that name columns, each name at its first place in the file, from the top."""
    x = words.filter(F.col("text").rlike(pattern)).select("file", F.col("text").alias("nome"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.struct("page", "top", "x0").alias("o"))
    return x.groupBy("file", "nome").agg(F.min_by("x", "o").alias("x"))


def items_by_position(words: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """file, page, linha and one text for each band: words of a visual line put into columns by where they begin (EX-14)."""
    x = visual_lines(words).withColumn("_band", band(F.col("x0"), bands))
    of = lambda name: F.array_join(F.sort_array(F.collect_list(F.when(F.col("_band") == name, F.struct("x0", "text"))))["text"], " ")
    return x.groupBy("file", "page", "linha").agg(*[of(name).alias(name) for name in bands])


def generic_cells(cells: DataFrame, headers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """sheet, r and one column a field: the rows below each sheet's discovered header (EX-07). headers: as find_header gives them."""
    roles = headers.select("sheet", F.col("r").alias("head"), F.explode("columns").alias("field", "c"))
    x = cells.join(F.broadcast(roles), ["sheet", "c"]).filter(F.col("r") > F.col("head"))
    of = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, S.text(F.col("v")))), F.lit("")).alias(f)
    return x.groupBy("sheet", "r").agg(*map(of, fields)).filter(F.concat(*fields) != "")


def unpivot_sku_store(cells: DataFrame, label: str = "SKU") -> DataFrame:
    """sheet, r, c, matricula, sku, qtd (text) of a sheet of articles by stores: customers are in the row above the first that names the label (EX-08).

    Only positive quantities of columns with a customer number of six digits count.
    """
    head = cells.filter(F.upper(S.text(F.col("v"))) == label).groupBy("sheet").agg(F.min(F.struct("r", "c")).alias("at")).select("sheet", F.col("at.r").alias("hr"), F.col("at.c").alias("hc"))
    x = cells.join(F.broadcast(head), "sheet")
    stores = S.once(x.filter((F.col("r") == F.col("hr") - 1) & (F.col("c") != F.col("hc"))), matricula=S.digits(F.col("v"))).select("sheet", "c", "matricula").filter("length(matricula) >= 6")
    articles = S.once(x.filter((F.col("c") == F.col("hc")) & (F.col("r") > F.col("hr"))), sku=S.sku(F.col("v"))).select("sheet", "r", "sku").filter("sku <> ''")
    body = S.once(x.filter((F.col("r") > F.col("hr")) & (F.col("c") != F.col("hc"))), qtd=N.positive_text(F.col("v"), "groups")).select("sheet", "r", "c", "qtd").filter("qtd <> ''")
    return body.join(stores, ["sheet", "c"]).join(articles, ["sheet", "r"]).select("sheet", "r", "c", "matricula", "sku", "qtd")


def unpivot_store_sku(cells: DataFrame, store_column: int = 2, least: int = 3) -> DataFrame:
    """sheet, r, c, matricula, sku, qtd of a sheet of stores by articles: the header is the first row with three codes of five digits (EX-09)."""
    coded = cells.withColumn("code", F.regexp_extract("v", "[0-9]{5,}", 0))
    head = coded.filter("code <> ''").groupBy("sheet", "r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).groupBy("sheet").agg(F.min("r").alias("hr"))
    x = coded.join(F.broadcast(head), "sheet")
    articles = x.filter((F.col("r") == F.col("hr")) & (F.col("code") != "")).select("sheet", "c", F.col("code").alias("sku"))
    stores = x.filter((F.col("c") == store_column) & (F.col("r") > F.col("hr"))).select("sheet", "r", S.digits(F.col("v")).alias("matricula")).filter("matricula <> ''")
    body = x.filter((F.col("r") > F.col("hr")) & (F.col("c") != store_column)).select("sheet", "r", "c", N.positive_text(F.col("v"), "groups").alias("qtd")).filter("qtd <> ''")
    return body.join(articles, ["sheet", "c"]).join(stores, ["sheet", "r"]).select("sheet", "r", "c", "matricula", "sku", "qtd")


def unpivot_divisor(cells: DataFrame, header: int, sku_column: int, divisor: str = "DIVISOR", stops: tuple[str, ...] = ("TOTAL",)) -> DataFrame:
    """sheet, r, c, loja, nome, sku, qtd: stores are the columns after the divisor and before the first stop header; names are above the header (EX-10)."""
    folded = cells.filter(F.col("r") == header).withColumn("t", S.folded(F.col("v")))
    stop = F.lit(False)
    for word in stops:
        stop = stop | F.col("t").contains(word)
    first = F.max(F.when(F.col("t") == divisor, F.col("c")))
    bounds = folded.groupBy("sheet").agg(first.alias("first"), F.min(F.when(stop, F.col("c"))).alias("stop"))
    heads = folded.join(F.broadcast(bounds), "sheet").filter((F.col("c") > F.col("first")) & (F.col("stop").isNull() | (F.col("c") < F.col("stop"))) & (F.col("t") != ""))
    names = cells.filter(F.col("r") == header - 1).select("sheet", "c", S.text(F.col("v")).alias("nome"))
    stores = heads.select("sheet", "c", S.text(F.col("v")).alias("loja")).join(names, ["sheet", "c"], "left").withColumn("nome", F.coalesce("nome", F.lit("")))
    articles = cells.filter((F.col("c") == sku_column) & (F.col("r") > header)).select("sheet", "r", S.digits(F.col("v")).alias("sku")).filter("sku <> ''")
    body = cells.filter(F.col("r") > header).select("sheet", "r", "c", N.positive_text(F.col("v"), "either").alias("qtd")).filter("qtd <> ''")
    return body.join(F.broadcast(stores), ["sheet", "c"]).join(articles, ["sheet", "r"]).select("sheet", "r", "c", "loja", "nome", "sku", "qtd")


def unpivot_store_block(cells: DataFrame, header: int, stores: DataFrame, maps: DataFrame) -> DataFrame:
    """sheet, r, c, loja, cnpj_loja, sku, qtd: store codes head the columns, their block gives company numbers, bar codes in column 1 become articles (EX-11)."""
    from . import customers

    heads = cells.filter((F.col("r") == header) & (F.col("c") > 1)).select("sheet", "c", S.text(F.col("v")).alias("loja")).filter("loja <> ''")
    codes = cells.filter((F.col("c") == 1) & (F.col("r") > header)).select("sheet", "r", S.digits(F.col("v")).alias("ean")).filter("ean <> ''")
    body = cells.filter((F.col("r") > header) & (F.col("c") > 1)).select("sheet", "r", "c", N.positive_text(F.col("v"), "comma").alias("qtd")).filter("qtd <> ''")
    x = body.join(heads, ["sheet", "c"]).join(codes, ["sheet", "r"])
    x = customers.attach_store(x, stores)
    one = maps.groupBy("ean").agg(F.min_by("sku", "row_id").alias("sku"))
    return x.join(one, "ean", "left").select("sheet", "r", "c", "loja", "cnpj_loja", F.coalesce("sku", "ean").alias("sku"), "qtd")


def extract_blocks(cells: DataFrame, store: int, sku: int, qty: int, header: Column, total: Column) -> DataFrame:
    """sheet, r, loja, sku, qtd of a sheet whose header repeats (EX-12): headers and totals are skipped, a blank store is that of the line above (WIN-02)."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, S.text(F.col("v")))), F.lit(""))
    said = F.upper(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("c", "v")))["v"]))
    rows = cells.groupBy("sheet", "r").agg(of(store).alias("loja"), of(sku).alias("sku"), of(qty).alias("qtd"), said.alias("texto"))
    x = rows.filter(~header & ~total).withColumns({"loja": S.digits(F.col("loja")), "sku": S.digits(F.col("sku")), "qtd": N.positive_text(F.col("qtd"), "groups")})
    return inherited_store(x).filter("loja <> '' AND sku <> '' AND qtd <> ''").select("sheet", "r", "loja", "sku", "qtd")


def inherited_store(rows: DataFrame) -> DataFrame:
    """rows with loja of the last line that has one, where it is blank and the line has an article or a quantity (WIN-02)."""
    above = Window.partitionBy("sheet").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.nullif(F.col("loja"), F.lit("")), ignorenulls=True).over(above)
    return rows.withColumn("loja", F.when((F.col("loja") == "") & (F.concat("sku", "qtd") != ""), F.coalesce(last, F.lit(""))).otherwise(F.col("loja")))


def order_column(cells: DataFrame, header: DataFrame, ahead: int = 19, least: int = 2) -> DataFrame:
    """sheet, pedido_col: the column after the quantity, if two of the next 19 rows have a number of four digits there, else null (WIN-15). header: sheet, r, qtd_col."""
    h = header.select("sheet", F.col("r").alias("head"), (F.col("qtd_col") + 1).alias("c"))
    hits = cells.join(F.broadcast(h), ["sheet", "c"]).filter(F.col("r").between(F.col("head") + 1, F.col("head") + ahead) & (F.length(S.digits(F.col("v"))) >= 4))
    n = hits.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))
    return h.join(n, "sheet", "left").select("sheet", F.when(F.col("n") >= least, F.col("c")).alias("pedido_col"))


def extract_form(cells: DataFrame, labels: dict[str, str], grid: dict[str, int], first: int) -> DataFrame:
    """sheet, the labelled values, and each line of an order form's grid, with packs and status (EX-13).

    labels: name of a value and the label to its left; grid: columns of sku, fardo, unidades and por_fardo. Packs that
    are missing are units by units per pack, with an alert (NUM-10).
    """
    from ..sources import tables

    of = lambda name: F.coalesce(F.max(F.when(F.col("c") == grid[name], S.text(F.col("v")))), F.lit("")).alias(name)
    x = cells.filter((F.col("r") >= first) & F.col("c").isin(*grid.values())).groupBy("sheet", "r").agg(*map(of, grid)).filter("sku <> ''")
    x = S.once(x, _fardo=N.loose_number(F.col("fardo")), _unidades=N.loose_number(F.col("unidades")), _por_fardo=N.loose_number(F.col("por_fardo")))
    x = S.once(x, _packs=N.packs(F.col("_fardo"), F.col("_unidades"), F.col("_por_fardo")))
    alert = F.when(F.col("_fardo").isNotNull(), "").when(F.col("_packs").isNotNull(), "QTD_CALCULADA_POR_UNIDADES").otherwise("QTD_FARDO_AUSENTE")
    x = x.select("sheet", "r", S.digits(F.col("sku")).alias("sku"), N.said(F.col("_packs")).alias("qtd"), alert.alias("alerta"))
    if not labels:
        return x
    return x.join(F.broadcast(tables.values_beside(cells, labels)), "sheet", "left").withColumns({name: F.coalesce(name, F.lit("")) for name in labels})


def reconcile_row(cells: DataFrame, header: int, total: int) -> DataFrame:
    """sheet, r, soma, total, confere: quantities of a row's stores against its total column (AGG-04)."""
    x = cells.filter((F.col("r") > header) & (F.col("c") > 1)).withColumn("n", N.read(F.col("v"), "groups"))
    x = x.groupBy("sheet", "r").agg(F.coalesce(F.sum(F.when(F.col("c") != total, F.col("n"))), F.lit(0)).alias("soma"), F.max(F.when(F.col("c") == total, F.col("n"))).alias("total"))
    return x.select("sheet", "r", F.col("soma").cast("long").alias("soma"), F.col("total").cast("long").alias("total"), F.coalesce(F.col("soma") == F.col("total"), F.lit(False)).alias("confere"))


def store_major(items: DataFrame) -> DataFrame:
    """items with n: their place store by store, then down the sheet (SRT-05)."""
    return items.withColumn("n", F.row_number().over(Window.partitionBy("sheet").orderBy("c", "r")).cast("long"))
