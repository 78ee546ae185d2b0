"""Tables of cells, catalogues and reference data in the form the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scalars as S
from ..functions import texts as X

#: The columns of an order line as it is read, before those for audit.
BASE_COLUMNS = ("matricula_lida", "cnpj_lido", "sku_lido", "quantidade_lida", "numero_pedido_lido", "data_entrega_lida", "gln_lido", "cnpj_base_lido", "codigo_loja_lido", "codigo_cliente_lido", "cod_cliente_lido", "loja_lida", "texto_loja_lido", "arquivo_origem", "layout_usado")
FALSE_WORDS = ("0", "FALSE", "FALSO", "N", "NAO", "INATIVO")


def cells_from_wide(df: DataFrame, columns: list[str], row: str = "row_id", sheet: str = "S1") -> DataFrame:
    """sheet, r, c, v: one row a cell of a table whose rows are numbered (SRC-02)."""
    return df.select(F.lit(sheet).alias("sheet"), F.col(row).alias("r"), F.posexplode(F.array(*[S.text(F.col(c)) for c in columns])).alias("p", "v")).select("sheet", "r", (F.col("p") + 1).cast("long").alias("c"), "v")


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets by column names, with sheet; what one lacks is "" (SRC-03, SET-01)."""
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()])
    return x.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in x.dtypes])


def _header(name: str) -> str:
    return name.strip().upper().translate(str.maketrans(S.ACCENTS, S.PLAIN))


def apply_mapping(df: DataFrame, mapping: list[tuple[str, str, str]], keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """keep and each target column: the first of its aliases that df has (kind COLUNA, aliases between bars), or a fixed value (FIXO), else "" (SRC-04)."""
    have = {_header(c): c for c in reversed(df.columns)}
    out: dict[str, Column] = {}
    for target, kind, value in mapping:
        if kind.upper() == "FIXO":
            out[target] = F.lit(value)
        else:
            found = next((have[a] for a in map(_header, value.split("|")) if a in have), None)
            out[target] = S.text(F.col(found)) if found else F.lit("")
    return df.select(*keep, *[c.alias(name) for name, c in out.items()])


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df, if it has all of the columns; the error names those it lacks (SRC-05)."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def read_dimension(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, every column as text, blanks as "" (SRC-06)."""
    x = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, mode="PERMISSIVE")
    return x.fillna("")


def load_mapping(lines: DataFrame, sep: str = "\t", within: int = 10) -> DataFrame:
    """line_no, cnpj, rede, matricula of a delimited text whose header, among its first lines, names CNPJ and Matricula (SRC-08).

    lines: line_no, line. Columns are found by their names; rows without both numbers are dropped.
    """
    parts = F.split(F.col("line"), sep)
    heads = F.transform(parts, lambda x: S.folded(x))
    is_head = F.exists(heads, lambda h: h.contains("CNPJ")) & F.exists(heads, lambda h: h.startswith("MATR"))
    header = lines.filter((F.col("line_no") <= within) & is_head).agg(F.min_by(F.struct("line_no", heads.alias("heads")), "line_no").alias("h"))
    at = lambda test: F.array_position(F.transform("h.heads", test), True).cast("int")
    x = lines.join(F.broadcast(header), F.col("line_no") > F.col("h.line_no"))
    cell = lambda i: F.when(i > 0, F.coalesce(F.get(parts, i - 1), F.lit(""))).otherwise("")
    x = x.select("line_no", X.cnpj14(cell(at(lambda h: h.contains("CNPJ")))).alias("cnpj"), S.text(cell(at(lambda h: h.contains("REDE")))).alias("rede"), S.digits(cell(at(lambda h: h.startswith("MATR")))).alias("matricula"))
    return x.filter("cnpj <> '' AND matricula <> ''")


def find_header(cells: DataFrame, aliases: dict[str, tuple[str, ...]], within: int = 60, least: int = 4) -> DataFrame:
    """sheet, r, score, columns (map of field to column) of each sheet's header row (SRC-09).

    A row scores one for each field of which some cell holds an alias or is held by one, and four more if it has a quantity and a
    product code. The best of the first rows wins, the earlier of equals; below least there is none.
    """
    spark = cells.sparkSession
    known = spark.createDataFrame([(f, i, S_alias) for f, words in aliases.items() for i, S_alias in enumerate(words)], "field string, i int, alias string").withColumn("alias", S.folded(F.col("alias")))
    x = cells.filter(F.col("r") <= within).withColumn("t", S.folded(F.col("v"))).filter("t <> ''")
    hits = x.join(F.broadcast(known), F.contains("t", F.col("alias")) | F.contains(F.col("alias"), F.col("t"))).groupBy("sheet", "r", "field").agg(F.min("c").alias("c"))
    has = lambda *fields: F.max(F.col("field").isin(*fields).cast("int"))
    rows = hits.groupBy("sheet", "r").agg((F.count(F.lit(1)) + 4 * has("quantidade_lida") * has("sku_lido", "codigo_sku_lido", "ean_lido")).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "c")))).alias("columns"))
    best = rows.groupBy("sheet").agg(F.max_by(F.struct("r", "score", "columns"), F.struct("score", (-F.col("r")).alias("n"))).alias("x"))
    return best.filter(F.col("x.score") >= least).select("sheet", "x.r", F.col("x.score").cast("long").alias("score"), "x.columns")


def find_header_exact(cells: DataFrame, names: dict[str, tuple[str, ...]], within: int = 80) -> DataFrame:
    """sheet, r, hits: the row with the most fields named exactly, the earlier of equals (SRC-10)."""
    known = cells.sparkSession.createDataFrame([(f, n) for f, words in names.items() for n in words], "field string, v string")
    x = cells.filter(F.col("r") <= within).withColumn("v", F.trim("v")).join(F.broadcast(known), "v")
    rows = x.groupBy("sheet", "r").agg(F.countDistinct("field").alias("hits"))
    best = rows.groupBy("sheet").agg(F.max_by(F.struct("r", "hits"), F.struct("hits", (-F.col("r")).alias("n"))).alias("x"))
    return best.select("sheet", "x.r", "x.hits")


def value_beside(cells: DataFrame, label: str, right: int = 1, below: int = 0) -> DataFrame:
    """sheet, v: the cell beside (or below) each sheet's first cell that holds a label (SRC-13)."""
    first = cells.filter(F.contains(S.folded(F.col("v")), F.lit(label))).groupBy("sheet").agg(F.min(F.struct("r", "c")).alias("at"))
    places = first.select("sheet", (F.col("at.r") + below).alias("r"), (F.col("at.c") + right).alias("c"))
    return places.join(cells.select("sheet", "r", "c", "v"), ["sheet", "r", "c"], "left").select("sheet", F.coalesce("v", F.lit("")).alias("v"))


def values_beside(cells: DataFrame, labels: dict[str, str], right: int = 1, below: int = 0) -> DataFrame:
    """sheet and a column for each name of labels: what value_beside finds for its label. All labels are found in one reading, all values in another; sheets with none don't appear."""
    plain = "^[0-9.,-]*$"  # what folds to digits and spaces holds no label with a letter
    some = cells.filter(~F.col("v").rlike(plain)) if all(any("A" <= x <= "Z" for x in label) for label in labels.values()) else cells
    said = S.once(some.select("sheet", "r", "c", "v"), _f=S.folded(F.col("v")))
    names = F.array_compact(F.array(*[F.when(F.contains("_f", F.lit(label)), name) for name, label in labels.items()]))
    first = said.select("sheet", "r", "c", F.explode(names).alias("_name")).groupBy("sheet", "_name").agg(F.min(F.struct("r", "c")).alias("at"))
    places = first.select("sheet", "_name", (F.col("at.r") + below).alias("r"), (F.col("at.c") + right).alias("c"))
    found = cells.select("sheet", "r", "c", "v").join(F.broadcast(places), ["sheet", "r", "c"])
    return found.groupBy("sheet").agg(*[F.coalesce(F.max(F.when(F.col("_name") == name, F.col("v"))), F.lit("")).alias(name) for name in labels])


def normalize_intermediate(df: DataFrame, file: str, layout: str) -> DataFrame:
    """df with all columns of an order line, the missing ones ""; file and layout where blank; the article's code defaults to the article (SRC-12)."""
    x = df.withColumns({c: F.lit("") for c in (*BASE_COLUMNS, "codigo_sku_lido") if c not in df.columns})
    default = lambda c, v: F.when(S.text(F.col(c)) == "", v).otherwise(F.col(c))
    return x.withColumns({"arquivo_origem": default("arquivo_origem", F.lit(file)), "layout_usado": default("layout_usado", F.lit(layout)), "codigo_sku_lido": default("codigo_sku_lido", F.col("sku_lido"))})


def is_active(c: Column) -> Column:
    return ~F.translate(F.upper(S.text(c)), S.ACCENTS, S.PLAIN).isin(*FALSE_WORDS)


def load_rules(df: DataFrame) -> DataFrame:
    """Active conversion rules: aliased headers, digits of codes, priority 999 where unreadable (SRC-14)."""
    named = lambda *names: X.first_nonblank(*[F.col(n) for n in names if n in df.columns], F.lit(""))
    x = df.filter(is_active(named("ativo")))
    return x.select(
        "regra_id", named("rede_layout", "nome_layout").alias("rede_layout"), named("layout_id").alias("layout_id"), F.upper(named("centro")).alias("centro"), S.digits(named("sku", "sku_origem")).alias("sku"), S.digits(named("ean")).alias("ean"),
        named("descricao").alias("descricao"), named("tipo_regra").alias("tipo_regra"), F.coalesce(N.decimal_number(named("prioridade")).cast("int"), F.lit(999)).alias("prioridade"),
    )


def load_product_map(df: DataFrame) -> DataFrame:
    """row_id, centro, ean, dun, sku, sku_base, apresentacao of entries with a factor and some code; the base article stands in for a blank one (SRC-15)."""
    sku, base, ean, dun = (S.digits(F.col(c)) for c in ("sku_ecc", "sku_base", "codigo_ean", "codigo_dun"))
    x = df.select("row_id", F.upper(S.text(F.col("centro"))).alias("centro"), ean.alias("ean"), dun.alias("dun"), X.first_nonblank(sku, base).alias("sku"), base.alias("sku_base"), N.decimal_number(F.col("apresentacao")).alias("apresentacao"))
    return x.filter("apresentacao IS NOT NULL AND apresentacao <> 0 AND concat(sku, ean, dun) <> ''")


def active_layouts(layouts: DataFrame, kind: str = "") -> DataFrame:
    """FLT-02."""
    x = layouts.filter(S.text(F.col("ativo")) == "1")
    return x.filter(F.upper("tipo_arquivo") == kind.upper()) if kind else x


def find_layout(layouts: DataFrame, layout_id: str | None = None, name: str | None = None) -> DataFrame:
    """FLT-02: the first layout of that id, else of that name; no row if neither is given or found."""
    test = F.col("layout_id").cast("string") == layout_id if layout_id is not None else F.col("nome_layout") == name if name else F.lit(False)
    return layouts.filter(test).orderBy("row_id").limit(1)


def check_catalogue(tables: dict[str, tuple[DataFrame | None, tuple[str, ...]]]) -> list[str]:
    """FLT-03: what is wrong with the catalogue's tables: those that are missing, and the columns others lack."""
    wrong = [f"{name}: missing" for name, (df, _) in tables.items() if df is None]
    return wrong + [f"{name}: columns missing: {', '.join(lack)}" for name, (df, need) in tables.items() if df is not None and (lack := [c for c in need if c not in df.columns])]


def queue_source(paths: list[str], official: str) -> list[str]:
    """SRC-17: the official source if it is there, else all others but temporary files."""
    plain = [p for p in paths if not p.rsplit("/", 1)[-1].startswith(("~$", ".", "_"))]
    return [official] if official in plain else sorted(plain)


def load_history(df: DataFrame) -> DataFrame:
    """df (caminho, push_meta, pedido_meta) with push and pedido: from metadata, else from the path; PUSH_LEGADO where no push is told (SRC-18)."""
    push = X.first_nonblank(F.col("push_meta"), F.regexp_extract("caminho", r"(PUSH_[0-9]{3})", 1), F.lit("PUSH_LEGADO"))
    order = X.first_nonblank(F.col("pedido_meta"), F.regexp_extract("caminho", r"(?i)PEDIDO_([^/]+)", 1), F.regexp_extract("caminho", r"_([0-9]+)_[^/]*$", 1))
    return df.withColumns({"push": push, "pedido": order})


def push_order(label: Column) -> Column:
    """SRT-02: legacy pushes first, then numbered ones by number, then others by name."""
    number = F.regexp_extract(label, "^PUSH_([0-9]{3})$", 1).try_cast("int")
    return F.struct(F.when(label == "PUSH_LEGADO", 0).when(number.isNotNull(), 1).otherwise(2).alias("k"), F.coalesce(number, F.lit(0)).alias("n"), F.when(number.isNull() & (label != "PUSH_LEGADO"), label).otherwise("").alias("s"))


def email_shipments(messages: DataFrame) -> DataFrame:
    """row_id, line_no, regional, matricula, pedido, data: shipments in the lines of message bodies (SRC-11).

    messages: row_id, meta (JSON with body or corpo_email). A line with a region, two numbers and a day is a whole record (EX-05).
    """
    body = X.plain_body(X.json_field(F.col("meta"), "corpo_email", "body"))
    x = messages.select("row_id", F.posexplode(F.split(body, "\n")).alias("p", "line"))
    numbers = F.regexp_extract_all("line", F.lit(r"(?<![0-9./-])[0-9]{6,12}(?![0-9./-])"), F.lit(0))
    day = X.sheet_day(F.regexp_extract("line", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", 0))
    x = x.select("row_id", (F.col("p") + 1).cast("long").alias("line_no"), X.region(F.regexp_extract("line", r"^\s*([A-Za-zÀ-ú][A-Za-zÀ-ú -]*)", 1)).alias("regional"), F.get(numbers, 0).alias("matricula"), F.get(numbers, 1).alias("pedido"), day.alias("data"))
    return x.filter("matricula IS NOT NULL AND pedido IS NOT NULL AND data IS NOT NULL")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order (SET-03, SET-07)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
