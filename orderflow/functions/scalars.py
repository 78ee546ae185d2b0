"""Column expressions for identifiers, numbers, dates and fixed-width fields. Missing text is "", never null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once a row, in a projection of their own: a generator stands above it, past which filters and later columns don't carry their expressions.

    The generator itself only unfolds what is made: within it, expressions with lambdas would be interpreted and not compiled.
    """
    made = df.withColumn("_once", F.struct(*[c.alias(name) for name, c in columns.items()]))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array("_once")))


def kept(parts: Column, *out: str) -> Column:
    """Different texts of an array that are neither null nor one of out, in order. No lambda, as what stands within a call that has one is interpreted."""
    return F.array_except(parts, F.array(*map(F.lit, (None, *out))).cast("array<string>"))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c made once a row however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def rescued_digits(c: Column) -> Column:
    """Digits of an identifier that a sheet may have made a number: 1700273623.0, 1,7E+09."""
    s = text(c)
    plain = F.replace(s, F.lit(","), F.lit("."))
    number = plain.rlike(r"^[0-9]+\.0+$") | plain.rlike(r"^[0-9]+(\.[0-9]+)?[eE]\+?[0-9]+$")
    whole = F.round(plain.try_cast("decimal(38,6)"), 0).cast("decimal(38,0)").cast("string")
    return F.when(s.rlike("^[0-9]+$"), s).when(number, F.coalesce(whole, digits(c))).otherwise(digits(c))


def sku(c: Column) -> Column:
    """Digits of an article code; a trailing .0 is dropped and scientific notation expanded."""
    return rescued_digits(c)


def order_number(c: Column) -> Column:
    """Letters and digits; a lone dot stays."""
    return F.when(text(c) == ".", F.lit(".")).otherwise(F.regexp_replace(text(c), "[^0-9A-Za-z]", ""))


def queue_quantity(c: Column) -> Column:
    """Whole quantity of at least 1, null if it is none: with a comma, dots part thousands; what is below 1 counts as 1."""
    s = F.replace(text(c), F.lit(" "), F.lit(""))
    point = F.when(s.contains(","), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).otherwise(s)
    number = F.when(point.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), point.try_cast("double"))
    written = F.when(number.isNotNull(), F.greatest(F.lit(1), F.floor(number))).cast("long")
    return F.when(s.rlike("^[0-9]{1,15}$"), F.greatest(F.lit(1), s.try_cast("long"))).otherwise(written)


def quantity_error(c: Column) -> Column:
    s = text(c)
    return F.when((s == "") | (F.lower(s) == "nan"), F.lit("QTD_VAZIA")).when(queue_quantity(c).isNull(), F.concat(F.lit("QTD_INVALIDA: "), s))


def day(c: Column) -> Column:
    """Date of d/m/yyyy, dots as strokes; null if there is no such day."""
    s = F.replace(text(c), F.lit("."), F.lit("/"))
    part = lambda n: F.split_part(s, F.lit("/"), F.lit(n))
    return F.when(s.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$") & ~s.endswith("/0000"), F.concat_ws("-", part(3), part(2), part(1)).try_cast("date"))


def day_text(c: Column) -> Column:
    return F.date_format(day(c), "dd/MM/yyyy")


def day_error(c: Column) -> Column:
    s = text(c)
    return F.when((s == "") | (F.lower(s) == "nan"), F.lit("DATA_VAZIA")).when(day(c).isNull(), F.lit("DATA_INVALIDA"))


def order_or_fallback(matricula: Column, order: Column, today: Column) -> Column:
    """A blank or dotted order number becomes the customer's number and the day."""
    return F.when(text(order).isin("", "."), F.concat(text(matricula), F.date_format(today, "ddMMyyyy"))).otherwise(text(order))


def cnpj_mask(c: Column) -> Column:
    return F.regexp_replace(F.lpad(digits(c), 14, "0"), r"^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")


def key_forms(c: Column) -> Column:
    """Forms under which a company number may be kept: as read, padded to 14, without leading zeros."""
    d = digits(c)
    padded = F.when((d != "") & (F.length(d) < 14), F.lpad(d, 14, "0"))
    return kept(F.array(d, padded, F.regexp_replace(d, "^0+", "")), "")


def alpha(c: Column, n: int) -> Column:
    return F.rpad(F.coalesce(c.cast("string"), F.lit("")), n, " ")


def numeric(c: Column, n: int) -> Column:
    return F.lpad(digits(c), n, "0")


def implied(c: Column, n: int, places: int) -> Column:
    return F.lpad(F.bround(c.cast("decimal(18,6)") * 10**places).cast("decimal(24,0)").cast("string"), n, "0")


def item_record(seq: Column, article: Column, quantity: Column, gln: Column, customer: Column) -> Column:
    """Interchange record 04 of 400 characters."""
    return F.rpad(
        F.concat(
            F.lit("04"), F.lpad(seq.cast("string"), 6, "0"), F.lpad(article, 14, "0"), F.lit(" " * 38), alpha(F.lit("."), 35), implied(quantity, 17, 4), F.lit("0" * 17),
            numeric(gln, 13), numeric(customer, 15), F.lit(" " * 6), F.lit("0" * (17 + 17 + 16 + 16 + 8 + 13 + 15 + 13 + 15)),
        ),
        400,
        " ",
    )


#: Accented capitals and what they are folded to.
ACCENTS, PLAIN = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN"


def folded(c: Column) -> Column:
    """Upper case without accents, other marks as single spaces (STR-03)."""
    return F.trim(F.regexp_replace(F.translate(F.upper(text(c)), ACCENTS, PLAIN), "[^A-Z0-9]+", " "))


def key_type(c: Column) -> Column:
    """Kind of a key by its digits (ARR-07)."""
    n = F.length(digits(c))
    return F.when(n == 14, "CNPJ").when(n == 13, "GLN").when(n.between(7, 12), "COD_CLIENTE").when(n.between(1, 6), "COD_LOJA").otherwise("CHAVE")


def decimal_text(c: Column) -> Column:
    """A decimal as text with a comma: at most four places, half up, without zeros at the end (NUM-08)."""
    s = F.round(c.cast("decimal(30,8)"), 4).cast("decimal(30,4)").cast("string")
    return F.translate(F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", ""), ".", ",")


def stamp(day_: Column) -> Column:
    """Interchange time stamp of a date, zeros for none (DAT-04)."""
    return F.coalesce(F.concat(F.date_format(day_, "yyyyMMdd"), F.lit("0000")), F.lit("0" * 12))
