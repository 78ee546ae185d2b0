"""Customers of order lines: the cascade from what was read to the customer number, and joins with stores and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from . import resolve
from .identity import Layout, parameters

KEYS = ("cnpj_lido", "cnpj_oficial_lido", "cnpj_base_lido", "cnpj_raiz_lido", "cnpj_sem_dv_lido", "gln_lido", "texto_loja_lido", "codigo_loja_lido", "codigo_cliente_lido", "codigo_origem_lido", "cod_cliente_lido", "cliente_lido", "loja_lida")


def client_keys(df: DataFrame) -> Column:
    """ARR-04: different keys of a row's customer, in order of trust."""
    return X.distinct_keys(*[F.col(c) for c in KEYS if c in df.columns])


def network_score(layout: Column, entry: Column) -> Column:
    """100 for the same network, 80 if one name holds the other, 30 and the number of common words, 1 for an entry of no network, else 0. Names as X.network gives them."""
    a, b = layout, entry
    common = F.size(F.array_intersect(F.filter(F.split(a, " "), lambda t: t != ""), F.filter(F.split(b, " "), lambda t: t != "")))
    return F.when(b == "", 1).when(a == b, 100).when((a != "") & (F.contains(a, b) | F.contains(b, a)), 80).when(common > 0, 30 + common).otherwise(0)


def _key_forms(keys: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(keys, X.key_variants)))


def xref_search(items: DataFrame, xref: DataFrame) -> DataFrame:
    """row_id, matricula, cnpj_oficial, chave_match, qualidade, nivel: the best entry for each item's keys (J-03).

    items: row_id, rede, chaves (array, in order of trust); xref: row_id, rede, chave_lida, cnpj_oficial, matricula and, if there,
    nome_loja. Any form of a key meets any form of an entry's key, company number, shop name or customer. Better keys
    come first, then nearer networks, then earlier entries. Entries of other networks count only if all are one target.

    Different keys are looked up once, and a form that many entries share (a common root of company numbers) is one row for each
    network: its first entry, the first that owns it, and its first and last target, which is all that the choice needs.
    """
    entry_keys = [F.col(c) for c in ("chave_lida", "cnpj_oficial", "nome_loja", "matricula") if c in xref.columns]
    target = ("chave_lida", "cnpj_oficial", "matricula")
    known = xref.select(F.col("row_id").alias("entry"), X.network(F.col("rede")).alias("em"), *target, F.array(X.key(F.col("chave_lida")), X.key(F.col("cnpj_oficial"))).alias("own"), _key_forms(F.array(*entry_keys)).alias("forms"))
    entry = F.struct("entry", "matricula", "cnpj_oficial", "forms")
    whole = F.when(F.greatest(*[F.col(c).isNull() for c in target]), None).otherwise(F.struct(*target))
    known = known.select("em", "own", entry.alias("e"), whole.alias("t"), F.explode("forms").alias("k"))
    known = known.groupBy("k", "em").agg(F.min("e").alias("e"), F.min(F.when(F.array_contains("own", F.col("k")), F.col("e"))).alias("own"), F.min("t").alias("t"), F.max("t").alias("u"))

    keys = S.once(items.select("rede", "chaves").filter(F.size("chaves") > 0).distinct(), na=X.network(F.col("rede")), exact=F.transform("chaves", X.key), asked=_key_forms(F.col("chaves")))
    met = keys.select("rede", "chaves", "na", "exact", F.explode("asked").alias("k")).join(known, "k")
    long_enough, number = F.length("k") >= 8, F.col("k").rlike("^[0-9]+$")
    same, owned = F.array_contains("exact", F.col("k")), F.col("own").isNotNull()
    quality = (
        F.when(same & owned, 1000).when(same & long_enough, 900).when(owned & long_enough, 850)
        .when(number & (F.length("k") >= 14), 800).when(number & (F.length("k") == 13), 700).when(number & (F.length("k") == 12), 300).otherwise(100)
    )
    met = met.select("rede", "chaves", "k", "t", "u", quality.alias("q"), network_score(F.col("na"), F.col("em")).alias("s"), F.when(quality.isin(1000, 850), F.col("own")).otherwise(F.col("e")).alias("e"))
    best = F.max_by(F.struct("e", "k", "q", "s"), F.struct((F.col("s") > 0).alias("own_network"), "q", "s", (-F.col("e.entry")).alias("e"), "k"))
    x = met.groupBy("rede", "chaves").agg(best.alias("x"), F.max("s").alias("near"), F.min("t").alias("t"), F.max("u").alias("u"))
    x = x.filter("near > 0 OR t = u")
    # Of an entry that owns one of the keys any form counts, so the greatest that both have is named.
    match = F.when(F.col("x.q") == 1000, F.array_max(F.array_intersect(_key_forms(F.col("chaves")), "x.e.forms"))).otherwise(F.col("x.k"))
    found = x.select("rede", "chaves", "x.e.matricula", "x.e.cnpj_oficial", match.alias("chave_match"), F.col("x.q").cast("long").alias("qualidade"), F.col("x.s").cast("long").alias("nivel"))
    met = items.select("row_id", F.col("rede").alias("_rede"), F.col("chaves").alias("_chaves")).join(found, F.col("rede").eqNullSafe(F.col("_rede")) & (F.col("chaves") == F.col("_chaves")))
    return met.select("row_id", "matricula", "cnpj_oficial", "chave_match", "qualidade", "nivel")


def resolve_customer(df: DataFrame, layout: Layout | str, base: DataFrame, xref: DataFrame) -> DataFrame:
    """df with matricula_final, cnpj_oficial_final, status_depara_cliente (J-04).

    A layout that brings customer numbers is taken at its word. Else the base of company numbers comes first, or the
    cross-reference where the network's own entries go first; then the other one, then the number that was read, and
    what is left is to be registered. df: row_id and what was read; base: row_id, cnpj, matricula. layout: one for all
    rows, or how the columns begin that have each row's; only rows of layouts with company numbers are looked up.
    """
    p = parameters(layout)
    read, own = S.digits(F.col("matricula_lida")), S.digits(F.col("cnpj_lido"))
    direct, status_of_direct = F.when(p.client == "MATRICULA", read).otherwise(""), F.when(p.client != "MATRICULA", "TIPO_CLIENTE_NAO_SUPORTADO").when(read != "", "MATRICULA_DIRETA").otherwise("MATRICULA_VAZIA")
    if p.one and p.one.client != "CNPJ":
        return df.withColumns({"matricula_final": direct, "cnpj_oficial_final": own, "status_depara_cliente": status_of_direct})
    looked = df.filter(p.client == "CNPJ")
    keys = looked.select("row_id", p.name.alias("rede"), client_keys(df).alias("chaves"))
    by_base = resolve.resolve_by_cnpj(looked.select("row_id", "cnpj_lido"), base, "cnpj_lido").select("row_id", F.nullif(F.col("achada"), F.lit("")).alias("_base"))
    by_xref = xref_search(keys, xref).select("row_id", F.nullif(F.col("matricula"), F.lit("")).alias("_xref"), F.col("cnpj_oficial").alias("_official"))
    x = df.join(by_base, "row_id", "left").join(by_xref, "row_id", "left")
    by_order = lambda a, b: F.when(p.network_first, F.coalesce(a, b)).otherwise(F.coalesce(b, a))
    told = by_order(F.when(F.col("_xref").isNotNull(), "DEPARA_CLIENTES"), F.when(F.col("_base").isNotNull(), "BASE_GLNS_CNPJ"))
    status = F.coalesce(told, F.when(read != "", "MATRICULA_LIDA_LAYOUT"), F.lit("A_CADASTRAR"))
    official = F.when(status == "DEPARA_CLIENTES", X.first_nonblank(F.col("_official"), own)).otherwise(own)
    by_company = {"matricula_final": F.coalesce(by_order(F.col("_xref"), F.col("_base")), read), "cnpj_oficial_final": official, "status_depara_cliente": status}
    others = {"matricula_final": direct, "cnpj_oficial_final": own, "status_depara_cliente": status_of_direct}
    return x.withColumns({c: F.when(p.client == "CNPJ", v).otherwise(others[c]) for c, v in by_company.items()}).drop("_base", "_xref", "_official")


def resolve_store(df: DataFrame, known: DataFrame, key: str = "identificador") -> DataFrame:
    """df with cnpj and matricula of an identifier that is either of them (J-11). known: row_id, cnpj, matricula; first entries win."""
    d = S.digits(F.col(key))
    is_cnpj = F.length(d).isin(13, 14)
    asked = df.withColumn("_cnpj", F.when(is_cnpj, F.lpad(d, 14, "0"))).withColumn("_mat", F.when(~is_cnpj & (d != ""), d))
    by_cnpj = known.groupBy(F.col("cnpj").alias("_cnpj")).agg(F.min_by("matricula", "row_id").alias("_m"))
    by_mat = known.groupBy(F.col("matricula").alias("_mat")).agg(F.min_by("cnpj", "row_id").alias("_c"))
    x = asked.join(by_cnpj, "_cnpj", "left").join(by_mat, "_mat", "left")
    return x.withColumns({"cnpj": F.coalesce("_cnpj", "_c", F.lit("")), "matricula": F.coalesce("_mat", "_m", F.lit(""))}).drop("_cnpj", "_mat", "_m", "_c")


def attach_store(items: DataFrame, stores: DataFrame) -> DataFrame:
    """items with their store's cnpj and name, by store code; blank where the block of stores has none (J-12)."""
    s = stores.groupBy("loja").agg(F.min_by(F.struct("cnpj", "nome"), "row_id").alias("_s"))
    x = items.join(s, "loja", "left")
    return x.withColumns({"cnpj_loja": F.coalesce("_s.cnpj", F.lit("")), "nome_loja": F.coalesce("_s.nome", F.lit(""))}).drop("_s")


def attach_date_map(items: DataFrame, dates: DataFrame) -> DataFrame:
    """items with data_remessa of their customer, the last companion file winning; "" where none names it (J-10). dates: ordem, matricula, data."""
    last = dates.filter("data <> ''").groupBy("matricula").agg(F.max_by("data", F.struct("ordem", "row_id")).alias("data_remessa"))
    return items.join(last, "matricula", "left").withColumn("data_remessa", F.coalesce("data_remessa", F.lit("")))


def resolve_ean_maps(df: DataFrame, overrides: DataFrame, *maps: DataFrame) -> DataFrame:
    """df with sku of its ean and origem: the override list before the maps in order; in each the first row wins (J-05)."""
    x, found = df, []
    for i, m in enumerate((overrides, *maps)):
        one = m.groupBy("ean").agg(F.min_by("sku", "row_id").alias(f"_sku{i}"))
        x = x.join(one, "ean", "left")
        found.append(F.nullif(F.col(f"_sku{i}"), F.lit("")))
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(found)], F.lit(-1))
    return x.withColumns({"sku": F.coalesce(*found, F.lit("")), "origem": origin}).drop(*[f"_sku{i}" for i in range(len(found))])


def priority_base(df: DataFrame, base: DataFrame) -> DataFrame:
    """row_id, sku, fator: a bar code looked up in each of its forms in turn; the first form that is known wins, then the first entry (J-06)."""
    known = base.select(F.col("row_id").alias("entry"), "sku", F.col("apresentacao").alias("fator"), F.explode(X.ean_forms(F.col("ean"))).alias("k"))
    asked = df.select("row_id", F.posexplode(X.ean_forms(F.col("ean"))).alias("pos", "k"))
    best = asked.join(known, "k").groupBy("row_id").agg(F.min_by(F.struct("sku", "fator"), F.struct("pos", "entry")).alias("x"))
    return best.select("row_id", "x.sku", F.col("x.fator").cast("long").alias("fator"))


def attach_ship_date_tiers(items: DataFrame, ships: DataFrame) -> DataFrame:
    """row_id, data, alerta: by customer and order; else the customer's only order; else the customer's first in the item's region (J-09)."""
    some = ships.filter("data_remessa <> ''")
    exact = some.groupBy("matricula", "pedido").agg(F.min_by("data_remessa", "row_id").alias("d1"))
    only = some.groupBy("matricula").agg(F.countDistinct("pedido").alias("n"), F.min_by("data_remessa", "row_id").alias("d2")).filter("n = 1").drop("n")
    near = some.groupBy("matricula", "regional").agg(F.min_by("data_remessa", "row_id").alias("d3"))
    x = items.join(exact, ["matricula", "pedido"], "left").join(only, "matricula", "left").join(near, ["matricula", "regional"], "left")
    alert = F.when(F.col("d1").isNotNull(), "").when(F.col("d2").isNotNull(), "DATA_POR_MATRICULA").when(F.col("d3").isNotNull(), "DATA_POR_REGIONAL").otherwise("SEM_DATA_REMESSA")
    return x.select("row_id", F.coalesce("d1", "d2", "d3", F.lit("")).alias("data"), alert.alias("alerta"))


def upsert_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how many entries an upsert adds, and how many it changes (SNK-07)."""
    keys = ["rede", "chave", "matricula"]
    b, a = new.select(keys).distinct(), old.select(keys).distinct()
    return b.join(a.withColumn("_old", F.lit(1)), keys, "left").agg(F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)).cast("long").alias("novas"), F.sum(F.coalesce("_old", F.lit(0))).cast("long").alias("atualizadas"))


def import_pendencies(old: DataFrame, filled: DataFrame) -> DataFrame:
    """Entries after filled-in pendencies are taken in: those settled already or without customer are skipped (SNK-08)."""
    new = filled.filter(~F.upper(S.text(F.col("status"))).isin("OK", "SEM_PENDENCIA") & (S.digits(F.col("matricula")) != "") & (X.key(F.col("chave")) != ""))
    new = new.select("row_id", F.upper(S.text(F.col("rede"))).alias("rede"), X.key(F.col("chave")).alias("chave"), S.digits(F.col("matricula")).alias("matricula"))
    return resolve.upsert_xref(old, new)


def ordered_xref(xref: DataFrame) -> DataFrame:
    """xref with n: its place by network, kind of key, key and customer (SRT-03). Networks are ranked apart, so that no task holds all."""
    x = xref.withColumn("tipo", S.key_type(F.col("chave")))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("rede").orderBy("tipo", "chave", "matricula", "row_id")).cast("long"))
