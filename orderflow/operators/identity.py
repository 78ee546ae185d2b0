"""Identity of order lines: whether customer, product, quantity and order number are what they seem."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scalars as S
from ..functions import texts as X


@dataclass(frozen=True)
class Layout:
    """What is known of a file's layout. trusted: names of layouts whose notes on tracking don't block, folded."""

    name: str
    client: str = "CNPJ"
    file: str = "PDF"
    notes: str = ""
    date_rule: str = "D+1"
    network_first: bool = False
    dot_orders: bool = False
    trusted: tuple[str, ...] = ()
    long_number: str = ""  # company numbers of 15 digits that begin so count as whole


@dataclass(frozen=True)
class Parameters:
    """A layout as columns: those of one Layout, the same for all rows, or those of each row's own layout, as layouts_frame names them."""

    name: Column
    client: Column
    file: Column
    notes: Column
    date_rule: Column
    network_first: Column
    dot_orders: Column
    trusted: Column
    long_number: Column
    one: Layout | None = None  # where it is the same for all rows

    def trusts(self, folded: Column) -> Column:
        """Whether the text, folded, names a layout that is trusted."""
        return any_of(folded, self.one.trusted) if self.one else F.exists(self.trusted, lambda w: F.contains(folded, w))


def parameters(layout: Layout | str | Parameters) -> Parameters:
    """Of one layout, or of the columns whose names begin so."""
    if isinstance(layout, Parameters):
        return layout
    if isinstance(layout, str):
        return Parameters(*[F.col(f"{layout}{f.name}") for f in fields(Layout)])
    values = [getattr(layout, f.name) for f in fields(Layout)]
    return Parameters(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v) for v in values], one=layout)


def layouts_frame(spark: SparkSession, layouts: dict[str, Layout], prefix: str = "_layout_") -> DataFrame:
    """nome and a column for each field: layouts as rows, by the name that files have them under."""
    kinds = {str: "string", bool: "boolean", tuple: "array<string>"}
    names = ", ".join(f"{prefix}{f.name} {kinds[type(getattr(Layout(''), f.name))]}" for f in fields(Layout))
    rows = [(name, *(list(v) if isinstance(v, tuple) else v for v in (getattr(x, f.name) for f in fields(Layout)))) for name, x in layouts.items()]
    return spark.createDataFrame(rows, f"nome string, {names}")


#: Words in a status that make it unsafe, and in an alert that tell audit notes from errors.
UNSAFE = ("ALERTA", "ERRO", "PENDENTE", "VALIDAR", "HOMOLOG")
AUDIT = ("RASTREABILIDADE_LAYOUT", "REF_DIFERENTE_DO_COD_FORN_MANTIDO_COMO_AUDITORIA", "SKU_RECUPERADO_POR_REF_COD_FORN_AUSENTE")
BLOCKING = ("PENDENTE_SKU", "SKU_COD_FORN_AUSENTE_VALIDAR_MANUALMENTE", "SKU_EAN_NAO_LOCALIZADO", "SKU_VAZIO", "QTD_VAZIA", "QTD_NAO_NUMERICA", "ERRO", "INVALID", "CONVERSAO_PENDENTE", "VALIDAR_CONVERSAO")
STOPPERS = (
    "SKU_EAN_NAO_LOCALIZADO", "SKU_VAZIO", "QTD_VAZIA", "QTD_NAO_NUMERICA", "QTD_ZERO_OU_NEGATIVA", "PEDIDO_VAZIO", "PEDIDO_AUSENTE", "CNPJ_COM_TAMANHO_INVALIDO",
    "CHAVE_CLIENTE_NAO_LOCALIZADA", "LAYOUT_INVALIDO", "LAYOUT INVALIDO", "QTD_PARECE_PRECO_CUSTO", "TOTAL_DIVERGENTE",
)
CONVERTED = ("OK CONVERTIDO", "OK SEM CONVERSAO")
TRIAL = ("HOMOLOG", "RASTREABILIDADE", "TESTE ", "TESTE_")
EAN_SIZES = (8, 12, 13, 14)


def plain_upper(c: Column) -> Column:
    return F.translate(F.upper(S.text(c)), S.ACCENTS, S.PLAIN)


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words: one pattern, so that the text is made once and not once a word."""
    return c.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def is_trusted(names: tuple[str, ...], *columns: Column) -> Column:
    """FLT-30: whether one of the names occurs in these texts together."""
    return any_of(plain_upper(F.concat_ws(" ", *map(S.text, columns))), names)


def unsafe_status(c: Column) -> Column:
    """FLT-19."""
    return any_of(F.upper(S.text(c)), UNSAFE)


def audit_only(c: Column) -> Column:
    """FLT-19: every part of an alert is a note for audit, and none blocks; so is a blank alert."""
    return S.bound(plain_upper(c), lambda s: (s == "") | (~any_of(s, BLOCKING) & F.forall(X.reasons(s), lambda p: any_of(p, AUDIT))))


def whole_company_number(d: Column, layout: Layout | str | Parameters) -> Column:
    p = parameters(layout)
    return (F.length(d) == 14) | ((F.length(d) == 15) & (p.long_number != "") & F.startswith(d, p.long_number))


def _first(df: DataFrame, *names: str) -> Column:
    return X.first_nonblank(*[F.col(n) for n in names if n in df.columns], F.lit(""))


def check_identity(df: DataFrame, layout: Layout | str) -> DataFrame:
    """df with status_identidade, motivo_identidade (the first reason), alerta_identidade (all of them) (FLT-21).

    A bar code in the place of an article is copied to ean_lido, a readable quantity is put in canonical form, and
    a missing order number becomes a dot where the layout allows it. Rows of trusted layouts that are complete pass.
    layout: one for all rows, or how the columns begin that have each row's.
    """
    layout = parameters(layout)
    names = ("_m", "_c", "_g", "_e", "_s", "_raw", "_shop", "_p", "_n", "_origin", "_alert", "_own", "_tracked", "_noted")
    df = S.once(
        df, _m=S.digits(F.col("matricula_lida")), _c=S.digits(F.col("cnpj_lido")), _g=S.digits(F.col("gln_lido")), _e=S.digits(F.col("ean_lido")), _s=S.digits(_first(df, "sku_lido", "codigo_sku_lido")),
        _raw=S.text(F.col("numero_pedido_lido")), _shop=_first(df, "codigo_cliente_lido", "codigo_loja_lido", "cod_cliente_lido"), _p=S.digits(F.col("numero_pedido_lido")),
        _n=N.br_number(F.col("quantidade_lida")), _origin=S.digits(_first(df, "codigo_origem_lido")), _alert=S.text(F.col("alerta_extracao")), _own=layout.trusts(plain_upper(F.concat_ws(" ", S.text(layout.name), S.text(F.col("layout_usado"))))),
    )
    m, c, g, e, s, raw, shop, p, n, origin, alert, own, tracked, noted = map(F.col, names)
    errors = ("ERRO", "INVALID", "NAO HOMOLOG", "HOMOLOGACAO CONTROLADA")
    df = S.once(df, _tracked=own & S.bound(plain_upper(alert), lambda a: a.contains("RASTREABILIDADE_LAYOUT") & ~any_of(a, errors)), _noted=own & audit_only(alert))
    q = F.col("quantidade_lida")
    excel = layout.file == "EXCEL"
    optional = any_of(F.upper(layout.notes), ("PEDIDO_OPCIONAL", "SEM PEDIDO POR LINHA", "PEDIDO OPCIONAL"))
    dot = (excel & optional & (raw == ".")) | (layout.dot_orders & raw.isin("", "."))
    moved = (e == "") & F.length(s).isin(*EAN_SIZES)
    no_order = p.isin("", "0")
    why = lambda code, v: F.concat(F.lit(f"{code}: "), v)
    by_number = F.when(m == "", "MATRICULA_NAO_LOCALIZADA_NO_LAYOUT").when(~F.length(m).between(6, 12), why("MATRICULA_COM_TAMANHO_ATIPICO", m))
    by_company = F.when((c != "") & ~whole_company_number(c, layout), why("CNPJ_COM_TAMANHO_INVALIDO", c)).when((c == "") & (g == "") & (shop == "") & (m == ""), "CHAVE_CLIENTE_NAO_LOCALIZADA")
    trial = any_of(F.upper(layout.name), TRIAL) & ~layout.trusts(F.upper(layout.name))
    reasons = F.array(
        F.when(moved & (F.length(s) >= 12), "SKU_LIDO_PARECE_EAN"),
        F.when(no_order & ~dot, F.when(excel & (raw == "."), "PEDIDO_AUSENTE_EM_EXCEL").otherwise("PEDIDO_VAZIO_OU_NAO_LOCALIZADO")),
        F.when(~no_order & ~F.length(p).between(3, 20), why("PEDIDO_COM_TAMANHO_ATIPICO", p)), F.when(~no_order & (p == c), "PEDIDO_PARECE_CNPJ"),
        F.when(~no_order & (p == e), "PEDIDO_PARECE_EAN"), F.when(~no_order & (p == s) & (F.length(s) >= 5), "PEDIDO_PARECE_SKU"), F.when(layout.client == "MATRICULA", by_number).otherwise(by_company),
        F.when((s == "") & (e == "") & (origin == ""), "SKU_EAN_NAO_LOCALIZADO"), F.when(~own & F.length(s).isin(13, 14) & (e == ""), "SKU_COM_TAMANHO_DE_EAN"),
        F.when(~own & (e != "") & ~F.length(e).isin(*EAN_SIZES), why("EAN_COM_TAMANHO_ATIPICO", e)),
        F.when(S.text(q) == "", "QTD_VAZIA").when(n.isNull(), why("QTD_NAO_NUMERICA", S.text(q))).when(n <= 0, why("QTD_ZERO_OU_NEGATIVA", S.text(q))).when(~own & N.looks_like_price(q), why("QTD_PARECE_PRECO_CUSTO", S.text(q))),
        F.when(unsafe_status(F.col("status_extracao")) & ~noted, why("STATUS_EXTRACAO_REQUER_VALIDACAO", S.text(F.col("status_extracao")))),
        F.when((alert != "") & ~tracked & ~noted, alert), F.when(trial, why("LAYOUT_EM_HOMOLOGACAO_OU_TESTE", layout.name)),
    )
    x = S.once(df, _why=S.kept(reasons))
    x = x.withColumns({"ean_lido": F.when(moved, s).otherwise(F.col("ean_lido")), "numero_pedido_lido": F.when(no_order & dot, ".").otherwise(F.col("numero_pedido_lido")), "quantidade_lida": F.when(n > 0, N.said(n)).otherwise(q)})
    x = S.once(x, _ok=(F.size("_why") == 0) | releasable(x, layout, F.array_join("_why", " | "), n))
    ok = F.col("_ok")
    return x.withColumns({
        "status_identidade": F.when(ok, "OK").otherwise("VALIDAR"), "motivo_identidade": F.when(ok, "OK").otherwise(F.substring_index(F.get("_why", 0), ":", 1)),
        "alerta_identidade": F.when(ok, "").otherwise(F.array_join("_why", " | ")),
    }).drop("_why", "_ok", *names)


def releasable(df: DataFrame, layout: Layout | str | Parameters, found: Column, number: Column | None = None) -> Column:
    """FLT-09: a row of a trusted layout with company number, product, order and quantity, whose notes name no real error. number: the quantity, if it is read already."""
    layout = parameters(layout)
    said = plain_upper(F.concat_ws(" ", layout.name, S.text(F.col("layout_usado")), S.text(F.col("alerta_extracao")), found))
    c, s, e = S.digits(F.col("cnpj_lido")), S.digits(_first(df, "sku_lido", "codigo_sku_lido")), S.digits(F.col("ean_lido"))
    p, n = S.digits(F.col("numero_pedido_lido")), N.br_number(F.col("quantidade_lida")) if number is None else number
    order = (F.length(p) >= 3) | (layout.dot_orders & (S.text(F.col("numero_pedido_lido")) == "."))
    return S.bound(said, lambda t: layout.trusts(t) & ~any_of(t, (*STOPPERS, "ERRO"))) & whole_company_number(c, layout) & ((s != "") | (e != "")) & order & F.coalesce(n > 0, F.lit(False))


def release_trusted(df: DataFrame, layout: Layout | str) -> DataFrame:
    """FLT-09 before the queue: complete rows of trusted layouts are OK, whatever tracking noted.

    Needs matricula_final, numero_pedido_final and data_remessa_final beside what was read.
    """
    layout = parameters(layout)
    said = plain_upper(F.concat_ws(" ", *[S.text(F.col(c)) for c in ("layout_usado", "alerta_extracao", "alerta_identidade", "motivo_identidade", "status_conversao")]))
    full = [S.text(F.col(c)) != "" for c in ("matricula_final", "sku_lido", "quantidade_lida", "numero_pedido_final")]
    ready = S.bound(said, lambda t: layout.trusts(t) & ~any_of(t, (*STOPPERS, "CONVERSAO_PENDENTE", "ALERTA - NAO CONVERTIDO", "VALIDAR CONVERSAO"))) & whole_company_number(S.digits(F.col("cnpj_lido")), layout) & F.col("data_remessa_final").isNotNull()
    for column in full:
        ready = ready & column
    name = F.regexp_replace("layout_usado", "(?i)^RASTREABILIDADE -> *", "")
    df, ready = S.once(df, _ready=ready), F.col("_ready")
    return df.withColumns({"status_identidade": F.when(ready, "OK").otherwise(F.col("status_identidade")), "motivo_identidade": F.when(ready, "OK").otherwise(F.col("motivo_identidade")), "alerta_identidade": F.when(ready, "").otherwise(F.col("alerta_identidade")), "layout_usado": F.when(ready, name).otherwise(F.col("layout_usado"))}).drop("_ready")


def conversion_blocks(c: Column) -> Column:
    """FLT-07: all but a blank status and the two good ones, with or without accents."""
    return ~plain_upper(c).isin("", *CONVERTED)


def identity_blocks(df: DataFrame, layout: Layout | str) -> Column:
    """FLT-08: a status other than OK, unless a trusted layout's only note is tracking."""
    said = plain_upper(F.concat_ws(" ", *[S.text(F.col(c)) for c in ("layout_usado", "alerta_extracao", "alerta_identidade", "motivo_identidade")]))
    stop = ("SKU_EAN_NAO_LOCALIZADO", "SKU_VAZIO", "QTD_VAZIA", "QTD_NAO_NUMERICA", "QTD_ZERO_OU_NEGATIVA", "MATRICULA_NAO_LOCALIZADA", "MATRICULA_NAO_ENCONTRADA", "PEDIDO_VAZIO", "PEDIDO_AUSENTE", "CNPJ_COM_TAMANHO_INVALIDO", "CHAVE_CLIENTE_NAO_LOCALIZADA", "LAYOUT_EM_HOMOLOGACAO", "STATUS_EXTRACAO_REQUER_VALIDACAO")
    noted = S.bound(said, lambda t: parameters(layout).trusts(t) & t.contains("RASTREABILIDADE_LAYOUT") & ~any_of(t, stop))
    return ~F.upper(S.text(F.col("status_identidade"))).isin("", "OK", "IDENTIDADE OK") & ~noted


def validate_business(df: DataFrame, layout: Layout | str) -> DataFrame:
    """df with motivo_descarte: the first thing that keeps a row from the queue, or "" (FLT-06)."""
    blank = lambda c: S.text(F.col(c)) == ""
    why = (
        F.when(identity_blocks(df, layout), X.first_nonblank(F.col("motivo_identidade"), F.lit("IDENTIDADE_PENDENTE_VALIDACAO"))).when(blank("sku_lido"), "SKU_VAZIO").when(blank("quantidade_lida"), "QTD_VAZIA")
        .when(blank("matricula_final"), "MATRICULA_NAO_ENCONTRADA").when(blank("numero_pedido_final"), "PEDIDO_VAZIO").when(F.col("data_remessa_final").isNull(), "DATA_INVALIDA")
        .when(conversion_blocks(F.col("status_conversao")), "CONVERSAO_PENDENTE_VALIDACAO").otherwise("")
    )
    return S.once(df, motivo_descarte=why)


def conversion_status(status: Column, *others: Column) -> Column:
    """FLT-22: the status itself if it is one, else what the row's texts say of conversion."""
    names = {"OK CONVERTIDO": "OK CONVERTIDO", "OK SEM CONVERSAO": "OK SEM CONVERSÃO", "ALERTA - NAO CONVERTIDO": "ALERTA - NÃO CONVERTIDO", "VALIDAR CONVERSAO": "VALIDAR CONVERSÃO"}
    direct = S.bound(F.replace(plain_upper(status), F.lit("OK - SEM"), F.lit("OK SEM")), lambda s: F.coalesce(*[F.when(s == k, v) for k, v in names.items()]))
    told = lambda said: F.when(said.contains("ALERTA - NAO CONVERTIDO") | said.contains("NAO_CONVERTIDO"), "ALERTA - NÃO CONVERTIDO").when(said.rlike("VALIDAR[_ ]CONVERSAO"), "VALIDAR CONVERSÃO").when(said.contains("OK CONVERTIDO"), "OK CONVERTIDO")
    return F.coalesce(direct, S.bound(plain_upper(F.concat_ws(" ", *map(S.text, others))), told), F.lit("OK SEM CONVERSÃO"))


def not_supplier(c: Column, prefixes: tuple[str, ...]) -> Column:
    """FLT-12: whether a company number is not one of the supplier's."""
    d = S.digits(c)
    found = F.lit(True)
    for p in prefixes:
        found = found & ~d.startswith(p)
    return found


def deny_skus(df: DataFrame, denied: tuple[str, ...], column: str = "sku_lido") -> tuple[DataFrame, DataFrame]:
    """FLT-13: rows of other articles, and those that are kept out, to be logged."""
    out = S.digits(F.col(column)).isin(*denied)
    return df.filter(~out), df.filter(out)


def drop_blank_rows(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """FLT-01."""
    return df.filter(F.concat_ws("", *[S.text(F.col(c)) for c in columns]) != "")


#: What makes a line of text one of the noise, or an alert one of extraction.
EXTRACTION = ("LINHA DE ITEM", "ITEM DESCARTADO", "PAGINA", "SEM TEXTO", "NENHUM ITEM", "SEM CNPJ", "SEM NUMERO", "SEM DATA", "NAO RECONHECIDA")


def is_noise(c: Column, begins: tuple[str, ...], holds: tuple[str, ...]) -> Column:
    """FLT-14: a line that begins with or holds one of these, once folded."""
    s = S.folded(c)
    starts = F.lit(False)
    for word in begins:
        starts = starts | s.startswith(word)
    return starts | any_of(s, holds)


def is_candidate(c: Column) -> Column:
    """FLT-14: a line that looks like an item: a code of five digits or more, and another number after it."""
    return S.text(c).rlike(r"\b[0-9]{5,14}\b.*\b[0-9]+")


def alerts_to_rows(alerts: DataFrame, column: str = "alerta") -> DataFrame:
    """FLT-18: alerts of extraction with their page and line, ready to be rows of a report."""
    x = alerts.filter(any_of(plain_upper(F.col(column)), EXTRACTION))
    return x.withColumns({"pagina": X.alert_page(F.col(column)), "linha_bruta": X.alert_line(F.col(column)), "status_extracao": F.lit("ALERTA_LEITURA"), "motivo_descarte": F.lit("ALERTA_LEITURA_PARSER")})
