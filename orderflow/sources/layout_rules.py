"""Line layouts as rows of a table: what the operators of operators/rules.py read a file by.

Patterns are for lines with single spaces. A group number of 0 means that the layout has no such field.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class LayoutRule(NamedTuple):
    """One layout. Context (order, company number, day) holds for: PAGINA, its page; PAGINAS, its page and those after it without their own; LINHA,
    the lines after it; ARQUIVO, as LINHA, but the file's first."""

    layout: str
    item: str
    g_sku: int = 0
    g_qtd: int = 0
    g_ean: int = 0
    g_codigo: int = 0
    g_descricao: int = 0
    g_emb: int = 0
    pedido: str = ""
    cnpj: str = ""
    dia: str = ""
    contexto: str = "PAGINAS"
    contexto_cnpj: str = "PAGINAS"
    cnpj_ultimo: bool = False  # of a page's numbers the last, not the first
    fornecedor: str = "61186888"  # company numbers that begin so are the supplier's
    dia_do_pedido: bool = False  # a day holds for all pages of its order and company number
    exige_dia: bool = False
    candidata: str = ""
    alerta: str = "LINHA_NAO_LIDA"
    item_sem_sku: str = ""  # a second form, without an article
    g2_codigo: int = 0
    g2_qtd: int = 0
    g2_descricao: int = 0
    alerta_sem_sku: str = ""
    abre: str = ""
    fecha: str = ""
    ignora: str = ""
    separa: str = ""  # two groups that stand together, and a third of what follows
    sku_de: str = ""  # the article is the first of these in its field
    sem_zeros: bool = False
    sku_minimo: int = 0  # shorter articles are recovered from a reference
    referencia: str = ""
    codigo_acima: str = ""  # the article stands on a line before
    quebrada: bool = False  # a candidate may go on in the next line
    unica: bool = False  # equal lines of a page count once
    soma: bool = False  # quantities of an article are added
    repete: bool = False  # repeated items stay, with a note
    modo_qtd: str = "GRUPO"
    total: str = ""


_Q = r"[0-9]{1,9}(?:\.[0-9]{3})*,[0-9]{2}"
_D = r"[0-9]+(?:[,.][0-9]+)?"
_B = r"(?:[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2,3}|[0-9]+,[0-9]{2,3}|[0-9]+)"
_DAY = r"([0-9]{2}/[0-9]{2}/[0-9]{4})"
_MASK = r"([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2})"
_MONEY = r"-?[0-9.]+,[0-9]{2,4}"
_FOUR = r"[0-9]+(?:\.[0-9]+)*,[0-9]+"

#: The layouts' patterns, as their documents are written.
RULES = (
    LayoutRule("PADRAO", r"^([0-9]{6}) ([0-9]+) (.+) CX ([0-9]+) ([0-9]+),00 [0-9]+,[0-9]{4}$", g_sku=1, g_qtd=5, g_descricao=3, pedido=r"^PEDIDO DE COMPRAS ([0-9]+)/", cnpj=_MASK, contexto="LINHA", contexto_cnpj="LINHA", candidata=r"^[0-9]{6} ", total=r"^TOTAIS ([0-9]+),00$"),
    LayoutRule("COASUL", r"(?i)^([0-9]{1,4})\s+([0-9]{8,14})\s+(.+?)\s+(UNID|UN|CX|FD|FARDO|LTA|LT|PET|PC|KG|GRF|GFA|VD|TP)\s+([0-9]{1,9}(?:[.,][0-9]+)?)\s+([0-9]{1,9}(?:[.,][0-9]{2,6})?)\s+([0-9]{1,12}(?:[.,][0-9]{2,6})?)$", g_sku=2, g_ean=2, g_descricao=3, g_emb=4, g_qtd=5, pedido=r"(?i)ORDEM\s*N[º°O]?\s*[:.]?\s*([0-9]{3,12})", cnpj=r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}|[0-9]{14})", candidata=r"^[0-9]{1,4}\s+[0-9]{8,14}\s+", modo_qtd="PONTO"),
    LayoutRule("BOZZA", rf"(?i)^([0-9]+)\s+([0-9]{{4,8}})\s+([0-9]{{8,14}})\s+(.+?)\s+({_B})\s+({_B})\s+({_B})\s+([0-9]{{1,3}}(?:\.[0-9]{{3}})*,[0-9]{{2}}|[0-9]+,[0-9]{{2}})$", g_codigo=1, g_sku=2, g_ean=3, g_descricao=4, g_qtd=5, pedido=r"(?i)N\S*mero\s+Pedido\s*:\s*([0-9]+)", cnpj=r"(?i)CNPJ/CPF\s*:\s*([0-9./-]+)", dia=rf"(?i)Dt\s+Entrega\s*:\s*{_DAY}", candidata=r"^[0-9]+\s+[0-9]{4,8}\s+[0-9]{8,14}\s+", alerta="BOZZA_ITEM_NAO_INTERPRETADO"),
    LayoutRule("MONACO", r"(?i)^([0-9]{5,6})\s+([0-9]{8,14})\s+([0-9,;/\-\s]+?)\s+(.+?)\s+([0-9]+)\s+([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{3}|[0-9]+,[0-9]{3})\s+([A-Z]{1,4}/[0-9]+)\s+", g_codigo=1, g_ean=2, g_sku=3, g_descricao=4, g_qtd=5, g_emb=7, pedido=r"(?i)N\S*mero\s+do\s+Pedido\s*:\s*([0-9]+)", cnpj=_MASK, sku_de="[0-9]{4,8}"),
    LayoutRule("DAHER", r"(?i)^([0-9]{8,14})\s+(.+?)\s+([0-9]{3,8})\s+([0-9]{3,8})\s+([A-Z]{1,4}[0-9]{0,3})\s+([0-9]+(?:[.,][0-9]+)?)\s+R\$", g_ean=1, g_descricao=2, g_codigo=3, g_sku=4, g_emb=5, g_qtd=6, pedido=r"(?i)Pedido\s+de\s+Compras\s+N[^0-9]*([0-9]+)", cnpj=r"(?i)CNPJ:\s*([0-9.\-/]+)", candidata=r"^[0-9]{8,14}\s+", alerta="DAHER_LINHA_DE_ITEM_NAO_RECONHECIDA", abre=r"(?i)EAN\s+Descri\S+\s+PLU\s+Ref\.\s+Emb\.\s+Qtd\.", fecha=r"(?i)^Total:"),
    LayoutRule("PRIMATO", rf"(?i)^([0-9]{{5,6}})\s+([0-9]{{6,14}})\s+(.+?)\s+({_Q})\s+C/\s*([0-9]+)\s+({_Q})\s+({_Q})\s+([0-9]{{1,12}}(?:\.[0-9]{{3}})*,[0-9]{{2}})$", g_sku=1, g_codigo=1, g_ean=2, g_descricao=3, g_qtd=4, g_emb=5, pedido=r"(?i)MERC\s*-\s*PEDIDO\s+DE\s+COMPRA\s+N\S*\s*([0-9]+)", cnpj=r"(?i)CNPJ\s*:\s*([0-9.\-/]{13,18})\s+IE\s*:"),
    LayoutRule("SUPERLAR", r"(?i)^([0-9]{5,6})\s+(.+?)\s*([0-9]{8,14})\s+([A-Z]{1,4}/[0-9]{3,4})\s+(0*[0-9]{5,6})\s+([0-9]{1,6}(?:[,.][0-9]{1,2})?)\s+([0-9]{1,6}[,.][0-9]{2,4})\b", g_codigo=1, g_descricao=2, g_ean=3, g_emb=4, g_sku=5, g_qtd=6, pedido=r"(?i)N\S{0,3}\s*PEDIDO\s*:\s*([0-9]+)", cnpj=r"(?i)CNPJ:\s*([0-9./-]{14,20})", ignora=r"(?i)TOTAIS|TOTAL LIQUIDO|PESO BRUTO|VALOR FRETE", separa=r"(?i)([A-Za-z.,;:%ºª()/+-])([0-9]{8,14})(\s+[A-Z]{1,4}/[0-9]{3,4}\s+0*[0-9]{5,6}\s+[0-9])", sem_zeros=True),
    LayoutRule("INDIANA", r"^([0-9]{4,9})\b.*?\b([0-9]{1,5})\s+0,0000\b", g_sku=1, g_qtd=2, pedido=r"(?i)Numero\s*Pedido:\s*([0-9]{5,12})", cnpj=_MASK, contexto="PAGINA", contexto_cnpj="PAGINA"),
    LayoutRule("KACULA", r"\b([0-9]+,[0-9]{2})\b", g_qtd=1, pedido=r"([0-9]+\s*/\s*L)", cnpj=r"CNPJ.*?([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}\s*-?\s*[0-9]{2})", contexto="ARQUIVO", contexto_cnpj="LINHA", ignora="(?i)EAN", codigo_acima=r"^([0-9]{5,6})\b"),
    LayoutRule("GALASSI", r"(?i)^(.+?)\s+((?:CX|FD|PT|PC|UN)/[0-9]{5})\s+([0-9]{5,6})\s+([0-9]+)\s+", g_descricao=1, g_emb=2, g_sku=3, g_qtd=4, pedido=r"(?i)^Pedido\s*:\s*([0-9-]+)\b", cnpj=r"(?i)CNPJ\s*:\s*([0-9./-]+)", contexto="PAGINA", contexto_cnpj="PAGINA", soma=True),
    LayoutRule("FESTIVAL", r"(?i)^([0-9]{5,6})(?:\s+([0-9]{1,7})|([0-9]))?\s*(.+?)\s+(CX|FD|UN|PC|PT)\s+[0-9]+\s+([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})\b", g_sku=1, g_descricao=4, g_emb=5, g_qtd=6, pedido=r"(?i)PEDIDO\s+DE\s+COMPRAS\s+([0-9]+\s*/\s*[A-Z])", cnpj=r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})", dia=rf"(?i)Previs\So\s+de\s+entrega\s+{_DAY}", contexto="PAGINA", contexto_cnpj="PAGINA", cnpj_ultimo=True, dia_do_pedido=True, exige_dia=True, unica=True, modo_qtd="INTEIRA"),
    LayoutRule("DROGA CLARA", r"(?i)^([0-9]{5,6})\s+.+?\s+(UN|FD|CX|SDF)\s+[0-9]+\s*x\s*[0-9]+\s+([0-9]{1,8})\s+[0-9]+[,.][0-9]{4}\b", g_sku=1, g_emb=2, g_qtd=3, pedido=r"(?i)Numero\s+Pedido:\s*([0-9]+)", cnpj=r"(?i)Filial:\s*[0-9]+\s+([0-9./-]+)", contexto="PAGINA", contexto_cnpj="PAGINA", candidata=r"^[0-9]{5,6}\s+", unica=True),
    LayoutRule("SUPERMAIS", rf"(?i)^([0-9]{{3,9}})\s+([0-9]{{3,9}})\s+([0-9]{{8,14}})\s+([A-Z]{{1,5}})\s+({_D})\s+(.+?)\s+({_D})\s+([0-9]{{1,9}}(?:\.[0-9]{{3}})*,[0-9]{{3}}|[0-9]+,[0-9]{{3}})\s+R?\$", g_codigo=1, g_sku=2, g_ean=3, g_emb=4, g_descricao=6, g_qtd=7, pedido=r"(?i)ORDEM\s+DE\s+COMPRA\s+N[^0-9]*([0-9]{3,12})", cnpj=_MASK, candidata=r"^[0-9]{3,9}\s+[0-9]{3,9}\s+[0-9]{8,14}\s+", alerta="SUPERMAIS_ITEM_NAO_INTERPRETADO"),
    LayoutRule("PANELAO", rf"(?i)^([0-9]+)\s+([0-9]{{3,8}})\s+(.+?)\s+([0-9]{{4,8}})\s+([0-9]{{8,14}})\s+([0-9]{{6,10}})\s+([A-Z]{{1,4}}\s*/\s*[0-9]+)\s+({_D})\s+({_D})\s+", g_codigo=2, g_descricao=3, g_sku=4, g_ean=5, g_emb=7, g_qtd=8, pedido=r"(?i)PEDIDO\s+DE\s+COMPRA\s*:\s*([0-9]{3,12})", cnpj=_MASK, dia=rf"(?i)ENTREGA\s*/\s*RETIRADA\s*:\s*.*?{_DAY}", candidata=r"(?i)^[0-9]+\s+[0-9]{3,8}\s+.+?\s+[0-9]{4,8}\s+[0-9]{8,14}\s+[0-9]{6,10}\s+", alerta="PANELAO_ITEM_NAO_INTERPRETADO"),
    LayoutRule("CAITA", rf"(?i)^([0-9]{{3,9}})\s+([0-9]{{8,14}})\s+([0-9]{{3,8}})\s+(.+?)\s+({_D})\s+([0-9]{{1,4}})\s+({_D})\s+([0-9]{{1,9}}(?:\.[0-9]{{3}})*,[0-9]{{2,4}})(?:\s+|$)", g_codigo=1, g_ean=2, g_sku=3, g_descricao=4, g_qtd=5, pedido=r"(?i)N\S*MERO\s+DO\s+PEDIDO\s*:\s*([0-9]{3,12})", cnpj=_MASK, dia=rf"(?i)PREVIS\SO\s+DE\s+ENTREGA\s*:\s*{_DAY}", candidata=r"^[0-9]{3,9}\s+[0-9]{8,14}\s+[0-9]{3,8}\s+", alerta="CAITA_ITEM_NAO_INTERPRETADO"),
    LayoutRule("SEMPRE VALE", rf"(?i)^([0-9]{{4,6}})\s+([0-9]{{1,6}})\s+(.+?)\s+({_Q})\s+([0-9]{{1,9}}(?:\.[0-9]{{3}})*,[0-9]{{4}})\b", g_sku=1, g_codigo=2, g_descricao=3, g_qtd=4, pedido=r"(?i)PEDIDO\s+DE\s+COMPRAS\s+([0-9]+\s*/\s*[A-Z])", cnpj=r"(?i)CNPJ\s+([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})", candidata=r"^[0-9]{4,6}\s+", item_sem_sku=rf"(?i)^([0-9]{{4,6}})\s+(.+?)\s+({_Q})\s+([0-9]{{1,9}}(?:\.[0-9]{{3}})*,[0-9]{{4}})\b", g2_codigo=1, g2_descricao=2, g2_qtd=3, alerta_sem_sku="SEMPRE_VALE_SEM_SKU_COD_FORN", modo_qtd="INTEIRA", total=rf"(?i)^TOTAIS\s+({_Q})\b"),
    LayoutRule("BARRACAO", r"(?i)^([0-9]+)\s+([0-9]{8,14})(?:\s+([0-9]{4,6}))?\s+(.+?)\s+([0-9]{1,6}(?:\.[0-9]{3})*,[0-9]{3})\s+([0-9]+)\s+([A-Z]{1,5}/[0-9]+)\s+", g_codigo=1, g_ean=2, g_sku=3, g_descricao=4, g_qtd=6, g_emb=7, pedido=r"(?i)N\S*mero\s+do\s+Pedido:\s*([0-9]+)", cnpj=r"(?i)CNPJ:\s*([0-9./-]+)", dia=r"(?i)Dt\.\s*Entrega:\s*([0-9]{2}/[0-9]{2}/[0-9]{2,4})", candidata=r"^[0-9]+\s+[0-9]{8,14}\b"),
    LayoutRule("BAKLIZI", rf"(?i)^([0-9]{{3,6}})\s+(?:([0-9]{{1,6}})\s+)?(.+?)\s+(CX|FD|UN|UND|PC|PT)\s+([0-9]{{1,3}})\s+({_Q})\s+([0-9]{{1,9}}(?:\.[0-9]{{3}})*,[0-9]{{4}})\b", g_sku=1, g_codigo=2, g_descricao=3, g_emb=4, g_qtd=6, pedido=r"(?i)PEDIDO\s+DE\s+COMPRAS\s+([0-9]{3,8}\s*/\s*[A-Z])", cnpj=r"([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}\s*-?\s*[0-9]{2})", ignora=r"(?i)^TOTAIS", sku_minimo=4, referencia=r"(?i)REF:\s*([0-9]{3,6})", repete=True, modo_qtd="INTEIRA", total=rf"(?i)^TOTAIS\s+({_Q})\b"),
    LayoutRule("TISCHLER", rf"^([0-9]{{3,10}})\s+([0-9]{{6,14}})\s+(.+)\s+([0-9]+)\s+{_FOUR}\s+{_FOUR}\s+{_FOUR}\s+{_FOUR}$", g_codigo=1, g_ean=2, g_sku=2, g_descricao=3, g_qtd=4, pedido=r"(?i)N\S*mero do pedido:\s*(\S+)", cnpj=r"(?i)CNPJ:\s*([0-9.\-/]+)", dia=rf"(?i)Previs\So de entrega:\s*{_DAY}", contexto="LINHA", contexto_cnpj="LINHA", candidata=r"^[0-9]{3,10}\s+[0-9]{6,14}\s+.+$", abre=r"(?i)TOTAL DAS TROCAS|N\S*mero do pedido:", fecha=r"(?i)TROCAS DO FORNECEDOR", quebrada=True),
    LayoutRule("MABY", rf"(?i)^([0-9]{{4,8}})\s+([0-9]{{8,14}})\s+(.+?)\s+({_D})\s+([A-Z]{{1,5}})\s+({_D})\s+({_MONEY})\s+({_MONEY})\s+({_D})\s+(-?[0-9.]+,[0-9]{{2}})$", g_codigo=1, g_ean=2, g_sku=2, g_descricao=3, g_qtd=4, g_emb=5, pedido=r"(?i)^Pedido\s*:\s*([0-9]{6,20})\b", cnpj=r"(?i)CNPJ\s+da\s+Empresa\s*:\s*([0-9./\-]+)", candidata=r"^[0-9]{4,8}\s+[0-9]{8,14}\s+", alerta="MABY_ITEM_NAO_INTERPRETADO", item_sem_sku=rf"(?i)^([0-9]{{4,8}})\s+([A-Za-z].+?)\s+({_D})\s+([A-Z]{{1,5}})\s+({_D})\s+({_MONEY})\s+({_MONEY})\s+({_D})\s+(-?[0-9.]+,[0-9]{{2}})$", g2_codigo=1, g2_descricao=2, g2_qtd=3, alerta_sem_sku="MABY_ITEM_SEM_EAN_BLOQUEADO"),
    LayoutRule("MILLER", r"(?i)^(.*?)\b([0-9]{13,14}|789[0-9]{5})\b.*\b([0-9]{1,6})\s*-\s*CX\b", g_descricao=1, g_ean=2, g_sku=2, g_qtd=3, pedido=r"(?i)N\S*mero\s+do\s+pedido:\s*([0-9]+)", cnpj=r"(?i)CNPJ:\s*([0-9./-]+)", dia=rf"(?i)Previs\So\s+de\s+entrega:\s*{_DAY}", cnpj_ultimo=True, candidata=r"(?i)- CX", unica=True, soma=True),
)


def rules_frame(spark: SparkSession, rules: tuple[LayoutRule, ...] = RULES) -> DataFrame:
    """The rules as a table, one row a layout."""
    kinds = ", ".join(f"{name} {({str: 'string', int: 'int', bool: 'boolean'})[type(value)]}" for name, value in zip(LayoutRule._fields, RULES[0]))
    return spark.createDataFrame([tuple(r) for r in rules], kinds)


def rules_sql(rules: tuple[LayoutRule, ...] = RULES) -> str:
    """The same table in SQL."""
    said = lambda v: f"{v}" if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rules)}) AS rules({', '.join(LayoutRule._fields)})"
