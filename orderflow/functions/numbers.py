"""Numbers as documents and sheets write them, as decimals; what is no number is null unless said otherwise.

Where a comma stands for the decimal point, dots part thousands. Without a comma, `dots` says what they are: "thousands"
(always), "point" (the decimal point), "groups" (thousands if every group after the first has three digits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import text

KIND = "decimal(30,8)"
_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _whole_dots(s: Column, dots: str, first: str = "{1,3}") -> Column:
    if dots == "thousands":
        return F.replace(s, F.lit("."), F.lit(""))
    if dots == "point":
        return s
    return F.when(s.rlike(rf"^[0-9]{first}(\.[0-9]{{3}})+$"), F.replace(s, F.lit("."), F.lit(""))).otherwise(s)


def read(c: Column, dots: str, first: str = "{1,3}") -> Column:
    """Decimal of a text: currency sign and spaces are left aside."""
    s = F.regexp_replace(text(c), r"R\$|[  ]", "")
    s = F.when(s.contains(","), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).otherwise(_whole_dots(s, dots, first))
    return F.when(s.rlike(_PLAIN), s.try_cast(KIND))


def said(number: Column) -> Column:
    """A decimal as text: no zeros at the end, a comma for the point, "" for null."""
    s = F.regexp_replace(F.regexp_replace(number.cast(KIND).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.translate(s, ".", ","), F.lit(""))


def br_number(c: Column) -> Column:
    """NUM-02: letters and signs of money or percent make it no number."""
    return F.when(~text(c).rlike("[A-Za-z$%]"), read(c, "groups"))


def decimal_number(c: Column) -> Column:
    """NUM-03."""
    return read(c, "point")


def gate_quantity(c: Column) -> Column:
    """NUM-04, as decided in D-03: a dot is a decimal point unless it parts thousands; null unless whole and positive."""
    n = br_number(c)
    return F.when((n > 0) & (n % 1 == 0), n.cast("long"))


def whole_number(c: Column) -> Column:
    """NUM-05: dots part thousands; null if there is none or a fraction is left."""
    n = read(c, "thousands")
    return F.when(n % 1 == 0, n.cast("long"))


def whole_error(c: Column) -> Column:
    n = read(c, "thousands")
    return F.when(text(c) == "", "QTD_VAZIA").when(n.isNull(), "QTD_INVALIDA").when(n % 1 != 0, "QTD_FRACIONADA").otherwise("")


def positive_text(c: Column, mode: str) -> Column:
    """NUM-06: a positive quantity as text, else "".

    mode "groups": the whole text is the number. The others take the first number in a text: "either" reads a last group of three digits after a dot or
    comma as thousands, "comma" a comma as the point and a dot as one too.
    """
    if mode == "groups":
        n = read(c, "groups")
    else:
        s = F.regexp_extract(text(c), r"[-+]?[0-9][0-9.,]*", 0)
        both = s.contains(".") & s.contains(",")
        plain = F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")
        if mode == "either":
            s = F.when(both, plain).when(s.rlike(r"^[0-9]+([.][0-9]+)*[.][0-9]{3}$|^[0-9]+(,[0-9]+)*,[0-9]{3}$"), F.translate(s, ".,", "")).otherwise(F.translate(s, ",", "."))
        else:
            s = F.when(both, plain).otherwise(F.translate(s, ",", "."))
        n = F.when(s.rlike(_PLAIN), s.try_cast(KIND))
    return F.when(n > 0, said(n)).otherwise("")


def half_up(c: Column) -> Column:
    """NUM-07: nearest whole quantity, halves up; "" unless positive."""
    n = F.round(read(c, "thousands"), 0)
    return F.when(n > 0, said(n)).otherwise("")


def packs(of_packs: Column, units: Column, units_per_pack: Column) -> Column:
    """NUM-10: packs as read, else units by units per pack; null if neither."""
    return F.coalesce(of_packs, F.when(units_per_pack != 0, units / units_per_pack)).cast(KIND)


def loose_number(c: Column) -> Column:
    """NUM-11: whatever digits, points and signs are left of a text once the rest is gone."""
    s = text(c)
    s = F.when(s.rlike("[0-9],[0-9]"), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")).otherwise(s)
    s = F.regexp_replace(s, r"[^0-9.\-]", "")
    return F.when(s.rlike(_PLAIN), s.try_cast(KIND))


def document_quantity(c: Column) -> Column:
    """NUM-12: as text, "" if unreadable; dots part thousands."""
    return said(read(c, "thousands"))


def grouped_quantity(c: Column) -> Column:
    """NUM-13: as text, "0" if unreadable; dots part thousands only before groups of three."""
    return said(F.coalesce(read(c, "groups", "+"), F.lit(0)))


def truncated(c: Column, default: int | None = None) -> Column:
    """NUM-14: whole part of a number, dots parting thousands; the default if unreadable."""
    return F.coalesce(read(c, "thousands").cast("long"), F.lit(default).cast("long"))


def whole_or_zero(c: Column) -> Column:
    """NUM-14, strict: digits, or digits with zeros after a comma; all else is 0."""
    s = F.replace(text(c), F.lit("."), F.lit(""))
    return F.when(s.rlike("^[0-9]+(,0+)?$"), F.regexp_extract(s, "^[0-9]+", 0).try_cast("long")).otherwise(F.lit(0).cast("long"))


def quantity_or_digits(c: Column) -> Column:
    """NUM-14, last resort: a number as text with the dot as point, else the digits that are there."""
    n = read(c, "point")
    return F.when(n.isNotNull(), said(n)).otherwise(F.regexp_replace(text(c), "[^0-9]", ""))


def looks_like_price(c: Column) -> Column:
    """FLT-15: three to six decimals after a comma and at most four digits before, above zero."""
    s = F.regexp_replace(text(c), " ", "")
    return s.rlike("^[0-9]{1,4},[0-9]{3,6}$") & (F.coalesce(read(c, "groups"), F.lit(0)) > 0)


def has_decimals(c: Column, least: int, most: int) -> Column:
    """FLT-15, variants: so many digits after the last comma."""
    return text(c).rlike(rf",[0-9]{{{least},{most}}}$")
