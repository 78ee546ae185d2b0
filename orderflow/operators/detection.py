"""Which layout a file has: by signature, by its customers' keys, by key words, else the generic one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from . import customers, identity

AUTO, SUGGEST, MARGIN = 75, 55, 8
#: Phrases that say there is no conversion, and those that say that there is.
WITHOUT = ("SEM CONVERSAO", "SEM DIVISAO", "SEM DIVIDIR", "SEM CONVERTER")
WITH = ("QUANT CONVERTIDA", "MAPA DE PRODUTOS", "UNIDADE PARA CAIXA", "UNIDADE CAIXA COM CONVERSAO", "COM CONVERSAO", "DEPENDE DE CONVERSAO", "CONVERSAO POR SKU", "CONVERSAO POR EAN", "DIVISAO POR", "DIVIDIR QUANTIDADE", "FATOR")
#: Words that support any layout of a kind.
COMMON = {
    "PDF": ("CNPJ", "PEDIDO", "PEDIDO DE COMPRA", "FORNECEDOR", "PRODUTO", "DESCRICAO", "SKU", "COD", "COD FORN", "REFERENCIA", "QTDE", "QTD", "QUANTIDADE", "PREVISAO", "ENTREGA", "UNIDADE", "EMBALAGEM", "TOTAL"),
    "EXCEL": ("MATRICULA", "SKU", "QTD", "QTDE", "QUANTIDADE", "PEDIDO", "ENTREGA", "DATA", "CNPJ", "EAN", "CODIGO", "PRODUTO", "DESCRICAO"),
}
STOP = ("PDF", "EXCEL", "PADRAO", "LAYOUT", "MATRICIAL", "PEDIDO", "PEDIDOS", "CLIENTE", "CLIENTES", "IMPORTACAO")


def tracking_allowed(layouts: DataFrame) -> DataFrame:
    """row_id, permitido: active layouts that don't depend on conversion; phrases of none are left aside first (FLT-17)."""
    said = S.folded(F.concat_ws(" ", "nome_layout", "observacoes", "regra_data_entrega"))
    for phrase in WITHOUT:
        said = F.replace(said, F.lit(phrase), F.lit(""))
    return layouts.select("row_id", ((S.text(F.col("ativo")) == "1") & ~identity.any_of(said, WITH)).alias("permitido"))


def default_keyword_rules(layouts: DataFrame) -> DataFrame:
    """Rules made of the catalogue of layouts where there are none (SRC-16): words of the name are strong, common words and those of the notes support."""
    x = layouts.join(tracking_allowed(layouts), "row_id").filter(S.text(F.col("ativo")) == "1").filter(F.upper("tipo_arquivo").isin("PDF", "EXCEL"))
    common = F.when(F.upper("tipo_arquivo") == "PDF", F.array(*map(F.lit, COMMON["PDF"]))).otherwise(F.array(*map(F.lit, COMMON["EXCEL"])))
    support = F.slice(F.array_distinct(F.concat(common, X.tokens(F.col("observacoes"), STOP))), 1, 80)
    return x.select("row_id", F.col("nome_layout").alias("nome"), F.upper("tipo_arquivo").alias("tipo"), F.col("permitido").alias("ativa"), F.lit(AUTO).alias("limiar_auto"), F.lit(SUGGEST).alias("limiar_sugestao"), X.tokens(F.col("nome_layout"), STOP).alias("fortes"), support.alias("apoio"))


def name_likeness(a: Column, b: Column, most: int = 12) -> Column:
    """UDF-01: how alike two names are by Ratcliff and Obershelp, times most, cut to a whole number. Names only, in batches."""
    return F.get(name_likenesses(a, F.array(b), most), 0)


def name_likenesses(a: Column, names: Column, most: int = 12) -> Column:
    """name_likeness of a name to each of some names."""

    @F.pandas_udf("array<int>")
    def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        matchers: dict[str, SequenceMatcher] = {}  # what a matcher knows of its second name serves a whole batch

        def one(x: str, y: str) -> int:
            if not x:
                return 0
            m = matchers.setdefault(y, SequenceMatcher(None, "", y))
            m.set_seq1(x)
            return int(m.ratio() * most)

        return pd.Series([[one(x, y) for y in ys] for x, ys in zip(left, right)])

    return likeness(a, names)


def _held(folded: Column, words: Column, phrases: Column) -> Column:
    """Those of the words and phrases that a text holds, as X.holds says: words are met by the text's own words."""
    return F.concat(F.array_intersect(words, F.split(folded, " ")), F.filter(phrases, lambda w: F.contains(folded, w)))


def score_layouts(files: DataFrame, rules: DataFrame) -> DataFrame:
    """row_id, regra, nome, score, margem, decisao: each file's best rule of its kind (J-15, EX-20, WIN-11).

    Strong words give up to 45, supporting ones 4 each up to 38, strong words in the file's name 8 each up to 14, its likeness to the layout's name up to 12.
    A rule at its threshold, 8 ahead of the second, is taken; at the lower one it is suggested. files: row_id, tipo, texto, nome_arquivo;
    rules: a catalogue of some dozens, which is sent to all. A text is searched once for the words of all rules; a name is compared once; a file stays one row.
    """
    r = rules.filter("ativa").select("tipo", F.struct(F.col("row_id").alias("regra"), "nome", "limiar_auto", "limiar_sugestao", "fortes", "apoio", S.folded(F.col("nome")).alias("n")).alias("r"))
    kinds = r.groupBy("tipo").agg(F.collect_list("r").alias("regras"))
    kinds = S.once(kinds, palavras=F.filter(F.array_distinct(F.flatten(F.transform("regras", lambda r: F.concat(r["fortes"], r["apoio"])))), lambda w: w != ""), nomes=F.transform("regras", lambda r: r["n"]))
    kinds = kinds.select("tipo", "regras", "nomes", F.filter("palavras", lambda w: ~w.contains(" ")).alias("palavras"), F.filter("palavras", lambda w: w.contains(" ")).alias("frases"))
    # Files come as they were written, often in one part; their work is dealt out evenly, and as it is more than their bytes tell, into a given number of parts.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = S.once(files.select("row_id", "tipo", "texto", "nome_arquivo").repartition(parts, "row_id"), t=S.folded(F.col("texto")), n=S.folded(F.col("nome_arquivo"))).drop("texto", "nome_arquivo")
    names = x.select("tipo", "n").distinct().join(F.broadcast(kinds.select("tipo", "nomes")), "tipo").select("tipo", "n", name_likenesses(F.col("n"), F.col("nomes")).alias("semelhanca"))
    x = x.join(F.broadcast(kinds.drop("nomes")), "tipo").join(names, ["tipo", "n"])
    x = S.once(x, _n=_held(F.col("n"), F.col("palavras"), F.col("frases")), _t=_held(F.col("t"), F.col("palavras"), F.col("frases")))
    x = S.once(x.drop("t", "n", "palavras", "frases"), _both=F.array_union("_t", "_n"))
    count = lambda words, held: F.size(F.filter(words, lambda w: F.array_contains(held, w)))

    def scored(r: Column, i: Column) -> Column:
        size, support, in_name = F.size(r["fortes"]), count(r["apoio"], F.col("_t")), count(r["fortes"], F.col("_n"))
        points = F.when(size > 0, F.least(F.lit(45), F.bround(45 * count(r["fortes"], F.col("_both")) / size, 0).cast("int"))).otherwise(0) + F.least(F.lit(38), support * 4) + F.least(F.lit(14), in_name * 8)
        return F.struct((-F.least(F.lit(100), points + F.get("semelhanca", i))).alias("s"), r["regra"].alias("regra"), i.alias("i"))

    x = S.once(x, _best=F.sort_array(F.transform("regras", scored)))
    first = F.get("_best", 0)
    x = S.once(x, score=-first["s"], margem=-first["s"] + F.coalesce(F.get("_best", 1)["s"], F.lit(0)), r=F.get("regras", first["i"]))
    whole = lambda c: F.when(F.col(f"r.{c}") <= 1, F.col(f"r.{c}") * 100).otherwise(F.col(f"r.{c}"))  # noqa: E731  shares count as percent (D-11)
    decision = F.when((F.col("score") >= whole("limiar_auto")) & (F.col("margem") >= MARGIN), "AUTO").when(F.col("score") >= whole("limiar_sugestao"), "SUGESTAO").otherwise("SEM_SUGESTAO")
    return x.select("row_id", "r.regra", "r.nome", "score", "margem", decision.alias("decisao"))


def _grams(c: Column) -> Column:
    """All different pieces of one to three characters of a text."""
    one = lambda n: F.transform(F.sequence(F.lit(0), F.length(c) - n), lambda i: F.substring(c, i + 1, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(c) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))


def held_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """tipo, a, b: names of a kind (left: tipo, a; right: tipo, b; each once, not blank) of which one holds the other.

    Found by postings of pieces of characters, not by crossing: a name that holds another holds each of its pieces, so the other is
    posted under one piece only, its rarest among the names that may hold it.
    """

    def held(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        postings = outer.select("tipo", o, F.explode(_grams(F.col(o))).alias("k"))
        longest = F.filter(_grams(F.col(i)), lambda g: F.length(g) == F.least(F.lit(3), F.length(i)))
        n = postings.groupBy("tipo", "k").agg(F.count(F.lit(1)).alias("n"))
        asked = inner.select("tipo", i, F.explode(longest).alias("k")).join(n, ["tipo", "k"], "left")
        rarest = asked.groupBy("tipo", i).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("x")).filter("x.n > 0").select("tipo", i, F.col("x.k").alias("k"))
        return rarest.join(postings, ["tipo", "k"]).filter(F.contains(F.col(o), F.col(i))).select("tipo", "a", "b")

    return held(left, "a", right, "b").unionByName(held(right, "b", left, "a")).distinct()


def name_pairs(left: DataFrame, right: DataFrame, ignored: tuple[str, ...] = ("PDF", "EXCEL", "LAYOUT")) -> DataFrame:
    """held_pairs, and those that share a word."""
    words = lambda x, c: x.select("tipo", c, F.explode(F.array_except(F.split(c, " "), F.array(*map(F.lit, ("", *ignored))))).alias("k"))
    shared = words(left, "a").join(words(right, "b"), ["tipo", "k"]).select("tipo", "a", "b")
    return shared.unionByName(held_pairs(left, right)).distinct()


def layout_for_network(networks: DataFrame, layouts: DataFrame) -> DataFrame:
    """row_id, layout, nome, score: the active layout of a network's kind of file by name: 100 the same, 90 one in the other, 50 and 5 a common word (J-19).

    Names are taken once each, and meet through name_pairs; of layouts with equal names the first counts.
    """
    ok = layouts.join(tracking_allowed(layouts).filter("permitido"), "row_id").select("row_id", "nome_layout", F.upper("tipo_arquivo").alias("tipo"), S.folded(F.col("nome_layout")).alias("b"))
    known = ok.groupBy("tipo", "b").agg(F.min_by(F.struct(F.col("row_id").alias("layout"), "nome_layout"), "row_id").alias("l"))
    asked = networks.select("row_id", F.upper("tipo").alias("tipo"), S.folded(F.col("rede")).alias("a")).filter("a <> ''")
    x = name_pairs(asked.select("tipo", "a").distinct(), known.filter("b <> ''").select("tipo", "b")).join(known, ["tipo", "b"])
    common = F.size(F.array_intersect(F.split("a", " "), F.array_except(F.split("b", " "), F.array(F.lit("PDF"), F.lit("EXCEL"), F.lit("LAYOUT")))))
    score = F.when(F.col("a") == F.col("b"), 100).when(F.contains("b", F.col("a")) | F.contains("a", F.col("b")), 90).otherwise(50 + 5 * common)
    best = x.withColumn("score", score).groupBy("tipo", "a").agg(F.max_by(F.struct("l.layout", "l.nome_layout", "score"), F.struct("score", (-F.col("l.layout")).alias("e"))).alias("x"))
    return asked.join(best, ["tipo", "a"]).select("row_id", "x.layout", F.col("x.nome_layout").alias("nome"), F.col("x.score").cast("long").alias("score"))


def track_by_keys(docs: DataFrame, xref: DataFrame, layouts: DataFrame) -> DataFrame:
    """row_id, rede, layout, nome: documents whose identifiers name one entry of the cross-reference, and that network's layout (J-20). docs: row_id, tipo, texto."""
    asked = docs.select("row_id", F.lit("").alias("rede"), X.identifiers(F.col("texto")).alias("chaves"))
    hit = customers.xref_search(asked, xref.withColumn("rede", F.when(F.col("rede") == "", "-").otherwise(F.col("rede"))))
    known = xref.groupBy("matricula").agg(F.min_by("rede", "row_id").alias("rede"))
    found = hit.join(known, "matricula").join(docs.select("row_id", "tipo"), "row_id").select("row_id", "rede", "tipo")
    return found.join(layout_for_network(found, layouts), "row_id").select("row_id", "rede", "layout", "nome")


def detect_signature(docs: DataFrame, signatures: dict[str, tuple[tuple[str, ...], ...]], text: str = "texto") -> DataFrame:
    """row_id, assinatura: the first layout of whose groups each has a word in the text (EX-19). A signature is a conjunction of alternatives, folded."""
    t = F.col("_t")
    tests = []
    for name, groups in signatures.items():
        whole = F.lit(True)
        for words in groups:
            whole = whole & identity.any_of(t, words)
        tests.append(F.when(whole, name))
    return docs.withColumn("_t", S.folded(F.col(text))).select("row_id", F.coalesce(*tests, F.lit("")).alias("assinatura"))


def has_matrix_signature(text: Column, number: str, stores: tuple[str, ...], least_numbers: int = 3, least_stores: int = 2) -> Column:
    """EX-19: a sheet of articles by stores: a product header, several different customer numbers and store names."""
    t = S.folded(text)
    names = F.size(F.filter(F.array(*map(F.lit, stores)), lambda s: F.contains(t, s)))
    return t.contains("SKU") & t.contains("DESCRICAO") & identity.any_of(t, ("CUSTO", "EMBALAGEM", "QUANTIDADE")) & (F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(number), F.lit(0)))) >= least_numbers) & (names >= least_stores)


def detect_layout(docs: DataFrame, signatures: dict[str, tuple[tuple[str, ...], ...]], xref: DataFrame, layouts: DataFrame, rules: DataFrame, generic: str) -> DataFrame:
    """row_id, layout, modo: signature before keys before scores; what none suggests has the generic layout (EX-21)."""
    by_sign = detect_signature(docs, signatures).filter("assinatura <> ''").select("row_id", F.col("assinatura").alias("s"))
    by_key = track_by_keys(docs, xref, layouts).select("row_id", F.col("nome").alias("k"))
    by_score = score_layouts(docs, rules).select("row_id", F.col("nome").alias("p"), "decisao")
    x = docs.select("row_id").join(by_sign, "row_id", "left").join(by_key, "row_id", "left").join(by_score, "row_id", "left")
    taken, suggested = F.col("decisao") == "AUTO", F.col("decisao") == "SUGESTAO"
    mode = F.when(F.col("s").isNotNull(), "ASSINATURA").when(F.col("k").isNotNull(), "CHAVE").when(taken, "PONTOS").when(suggested, "SUGESTAO").otherwise("GENERICO")
    return x.select("row_id", F.coalesce("s", "k", F.when(taken | suggested, F.col("p")), F.lit(generic)).alias("layout"), mode.alias("modo"))


def route_layout(files: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """files with rota: the first route whose part of a name the layout's name holds; LAYOUT_NAO_SUPORTADO if none (FLT-29)."""
    name = S.folded(F.col("nome_layout"))
    return files.withColumn("rota", F.coalesce(*[F.when(name.contains(part), route) for part, route in routes], F.lit("LAYOUT_NAO_SUPORTADO")))


def stamp_tracking(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with how their file's layout was found, and a note in alerta_extracao where it was tracked (FLT-26). results: arquivo, layout, modo, confianca."""
    x = items.join(results.withColumnRenamed("layout", "layout_referencia"), "arquivo", "left")  # files of a lot grow with it, so they aren't sent to all
    tracked = F.coalesce(F.col("modo").isin("CHAVE", "PONTOS", "GENERICO", "SUGESTAO"), F.lit(False))
    note = F.concat(F.lit("RASTREABILIDADE_LAYOUT: "), F.coalesce("layout_referencia", F.lit("")))
    return x.withColumns({"modo_rastreabilidade": F.when(tracked, "SIM").otherwise("NAO"), "layout_referencia": F.coalesce("layout_referencia", F.lit("")), "alerta_extracao": F.when(tracked, X.merged_reasons(F.col("alerta_extracao"), note)).otherwise(F.col("alerta_extracao"))}).drop("modo")


def apply_manual_date(items: DataFrame, day: str) -> DataFrame:
    """items with the day that was given, taken from its column (FLT-25); unchanged if none was."""
    return items.withColumns({"data_entrega_lida": F.lit(day), "regra_data_entrega": F.lit("COLUNA")}) if day else items


def pick_best_extraction(texts: DataFrame, words: tuple[str, ...], points: int = 3) -> DataFrame:
    """arquivo, motor, score: of several readings of a file the one with most marks, then the longest (EX-23). texts: arquivo, motor, texto."""
    t = X.lower_folded(F.col("texto"))
    marks = sum((F.when(t.contains(w), points).otherwise(0) for w in words), F.lit(0))
    x = texts.select("arquivo", "motor", marks.alias("score"), F.length("texto").alias("n"))
    best = x.groupBy("arquivo").agg(F.max_by(F.struct("motor", "score"), F.struct("score", "n", "motor")).alias("x"))
    return best.select("arquivo", "x.motor", F.col("x.score").cast("long").alias("score"))


def layout_confidence(text: Column, marks: dict[str, int]) -> Column:
    """EX-17: points of the marks that a text holds."""
    t = X.lower_folded(text)
    return sum((F.when(t.contains(word), n).otherwise(0) for word, n in marks.items()), F.lit(0)).cast("long")


def text_quality(text: Column, words: tuple[str, ...], number: Column, spaced: str = "pedidodecompra") -> Column:
    """EX-17: how well a reading of a file went: 3 for each word it holds, 8 for a title even if its letters stand apart, 10 for an order
    number, 1 for each company number up to 5 and for each line that begins with a code up to 10."""
    t = X.lower_folded(text)
    held = sum((F.when(t.contains(w), 3).otherwise(0) for w in words), F.lit(0))
    title = F.when(F.regexp_replace(t, r"\s+", "").contains(spaced), 8).otherwise(0)
    count = lambda p, most: F.least(F.lit(most), F.regexp_count(text, F.lit(p)))
    return (held + title + F.when(number != "", 10).otherwise(0) + count(r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}|[0-9]{13,14}", 5) + count(r"(?m)^\s*[0-9]{4,8}\s+", 10)).cast("long")


def store_identity(text: Column, subject: Column) -> tuple[Column, Column]:
    """EX-18: number and name of the store a text delivers to, else the number in the subject."""
    place = r"(?i)Local\s+de\s+Entrega\s*:?\s*([0-9]{1,5})\s*[-–]\s*([^\r\n]+)"
    number, name = F.regexp_extract(text, place, 1), F.regexp_extract(text, place, 2)
    name = F.regexp_replace(name, r"(?i)\b(CNPJ|I\.?E\.?|CEP|Telefone|Fax)\b.*$", "")
    return X.first_nonblank(number, F.regexp_extract(subject, r"(?i)\bloj(?:a)?\s*([0-9]{1,5})\b", 1)), F.regexp_replace(F.trim(name), r"^[-:\s]+|[-:\s]+$", "")


def delivery_cnpj(docs: DataFrame, base: DataFrame, supplier: tuple[str, ...], *keep: str) -> DataFrame:
    """row_id, columns to keep, cnpj: the company number a document delivers to (EX-16). docs: row_id (each once), texto and the columns to keep.

    Numbers labelled CNPJ in the block of the place of delivery come first, then others in it, then others of the text; in each
    class those known to the base come first, and the last one wins. The supplier's own and registration numbers (I.E.) don't count.
    A text is read once: its row goes along with its numbers, one row for a text without any.
    """
    block = F.regexp_extract("texto", r"(?is)(Local de Entrega.*?)(?:Assinatura|P[aá]gina:|\z)", 1)
    mask = r"[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}"
    all_of = lambda t, p, g: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(g)), S.digits)
    ignored = all_of(F.col("texto"), r"(?i)I\.?E\.?\s*:?\s*([0-9./-]{8,20})", 1)
    kinds = [(3, all_of(block, rf"(?i)CNPJ\s*:?\s*({mask})", 1)), (2, all_of(block, rf"({mask})", 1)), (1, all_of(F.col("texto"), rf"({mask})", 1))]

    def ranked(k: int, numbers: Column) -> Column:
        return F.transform(F.array_except(numbers, ignored), lambda c, i: F.struct(F.lit(k).alias("k"), i.alias("i"), c.alias("c")))

    found = F.flatten(F.array(*[ranked(k, x) for k, x in kinds]))
    kept = ["row_id", *keep]
    x = docs.select(*kept, F.inline_outer(found))
    x = x.withColumn("c", F.when((F.length("c") == 14) & identity.not_supplier(F.col("c"), supplier), F.col("c")))
    known = base.select(F.col("cnpj").alias("c")).distinct().withColumn("known", F.lit(1))
    place = F.when(F.col("c").isNotNull(), F.struct((F.col("k") > 1).cast("int").alias("block"), F.coalesce("known", F.lit(0)).alias("known"), "k", "i"))
    return x.join(known, "c", "left").groupBy(*kept).agg(F.coalesce(F.max_by("c", place), F.lit("")).alias("cnpj"))
