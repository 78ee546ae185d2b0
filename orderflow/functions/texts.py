"""Names, keys, dates and identifiers in free text. Missing text is "", never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ACCENTS, PLAIN, digits, folded, kept, text



def lower_folded(c: Column) -> Column:
    """STR-04: lower case without accents, white space as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text(c)), ACCENTS.lower(), PLAIN.lower()), r"\s+", " "))


def snake(c: Column) -> Column:
    """STR-05."""
    return F.regexp_replace(F.regexp_replace(lower_folded(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def network(c: Column) -> Column:
    """STR-06: upper case, marks and accented letters as spaces, words about the kind of file left out."""
    s = F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(PDF|EXCEL|LAYOUT|RASTREABILIDADE)\b", " "), " +", " "))


def key(c: Column) -> Column:
    """STR-07: the digits if there are any, else letters in upper case."""
    d = digits(c)
    return F.when(d != "", d).otherwise(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", ""))


def cnpj14(c: Column) -> Column:
    """STR-11: padded to 14 digits, or the last 14."""
    d = digits(c)
    return F.when(d == "", "").when(F.length(d) > 14, F.right(d, F.lit(14))).otherwise(F.lpad(d, 14, "0"))


def padded(c: Column, n: int) -> Column:
    """STR-13, STR-16: digits padded to n, longer ones as they are."""
    d = digits(c)
    return F.when(F.length(d) < n, F.lpad(d, n, "0")).otherwise(d)


def chosen_order(c: Column) -> Column:
    """STR-14: of the digit groups without leading zeros, of 3 to 12 digits, the first of 5 to 8, else the first."""
    s = text(c)
    bare = F.regexp_extract(s, r"^0*([0-9]{3,12})([.,]0+)?$", 1)
    bare = F.when(bare.rlike("^0*$") & (bare != ""), "0").otherwise(F.regexp_replace(bare, "^0+", ""))
    groups = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda g: F.regexp_replace(g, "^0+", ""))
    groups = F.filter(groups, lambda g: F.length(g).between(3, 12))
    best = F.filter(groups, lambda g: F.length(g).between(5, 8))
    return F.when(bare != "", bare).otherwise(F.coalesce(F.get(best, 0), F.get(groups, 0), F.lit("")))


def file_key(c: Column, most: int = 42, keep: str = "A-Za-z0-9") -> Column:
    """STR-15: a name for files: other characters as one underscore; longer names are cut and end in eight digits of their SHA-1."""
    s = F.regexp_replace(F.regexp_replace(text(c), f"[^{keep}]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", "arquivo").otherwise(s)
    short = F.regexp_replace(F.substring(s, 1, max(8, most - 9)), "_+$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat_ws("_", short, F.substring(F.sha1(s.cast("binary")), 1, 8)))


def safe_name(value: str) -> str:
    """A plain value as part of a folder's name."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in value)


def region(c: Column) -> Column:
    """STR-17: canonical name of a region."""
    s = folded(c)
    return F.when(s.contains("HORT") | (s == "CTL"), "SP-HORT").when(s.isin("POA", "PORTO ALEGRE"), "RS").when(s.isin("CTBA", "CURITIBA"), "PR").otherwise(F.replace(s, F.lit(" "), F.lit("-")))


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """STR-18: different words of three letters or more, without stop words, in order."""
    return F.array_distinct(F.filter(F.split(folded(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stop, "")))


def listed(c: Column) -> Column:
    """STR-18: different parts between bars, commas, semicolons or line feeds, folded."""
    return F.array_distinct(F.filter(F.transform(F.split(text(c), r"[|,;\n]+"), folded), lambda t: t != ""))


def holds(folded_text: Column, token: Column) -> Column:
    """STR-19: a phrase anywhere, a single word as a whole word; both folded already."""
    inside = F.contains(F.concat(F.lit(" "), folded_text, F.lit(" ")), F.concat(F.lit(" "), token, F.lit(" ")))
    return (token != "") & F.when(token.contains(" "), F.contains(folded_text, token)).otherwise(inside)


#: The entities that are turned into characters.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain_body(c: Column) -> Column:
    """STR-20: HTML of a message as lines of text: block tags are line feeds, others spaces; scripts and styles go."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00\xa0]", " ")
    s = F.regexp_replace(s, r"(?is)<(style|script)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)</?\s*(br|p|div|tr|td|th|li)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for entity, mark in ENTITIES.items():
        s = F.replace(s, F.lit(entity), F.lit(mark))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t;]+", " "), r" *\n+ *", "\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def rejoined_cnpj(c: Column) -> Column:
    """STR-21: a company number whole, or with its check digits before or after its first twelve; "" if none."""
    s = F.regexp_replace(text(c), r"\s+", " ")
    base = r"([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4})"
    whole = digits(F.regexp_extract(s, base + r"-?([0-9]{2})(?![0-9])", 0))
    after = digits(F.regexp_extract(s, base + r" ?- ?([0-9]{2})(?![0-9])", 0))
    first = digits(F.concat(F.regexp_extract(s, r"(?<![0-9])-?([0-9]{2}) " + base + r"(?![-0-9])", 2), F.regexp_extract(s, r"(?<![0-9])-?([0-9]{2}) " + base + r"(?![-0-9])", 1)))
    return F.coalesce(*[F.when(F.length(x) == 14, x) for x in (whole, after, first)], F.lit(""))


def alert_page(c: Column) -> Column:
    """STR-22: the page an alert names, or ""."""
    return F.regexp_extract(text(c), r"(?i)P[áa]gina\s+([0-9]+)", 1)


def alert_line(c: Column) -> Column:
    """STR-22: what follows an alert's first bar, or ""."""
    return F.trim(F.when(text(c).contains("|"), F.regexp_replace(text(c), r"(?s)^[^|]*\|", "")).otherwise(""))


def first_nonblank(*columns: Column) -> Column:
    """FLT-24: the first text that is not blank, or ""."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def reference_centre(rule_reference: Column, rule_centre: Column, row_centre: Column, default: str) -> Column:
    """STR-23: the rule's reference, else its own centre unless it is *, else the row's, else the default."""
    own = F.when(text(rule_centre) != "*", text(rule_centre)).otherwise("")
    return F.upper(first_nonblank(rule_reference, own, row_centre, F.lit(default)))


def centre_label(reference: Column, other_name: Column) -> Column:
    return F.when(text(other_name) != "", F.concat_ws(" - ", F.upper(text(reference)), text(other_name))).otherwise(F.upper(text(reference)))


def cell(c: Column) -> Column:
    """STR-24: a cell's text: no hard spaces, no .0 of whole numbers, scientific notation as whole digits."""
    s = F.trim(F.replace(text(c), F.lit("\u00a0"), F.lit(" ")))
    expanded = F.round(F.translate(s, ",", ".").try_cast("decimal(38,6)"), 0).cast("decimal(38,0)").cast("string")
    return F.when(s.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?[eE][+-]?[0-9]+$"), F.coalesce(expanded, s)).otherwise(F.regexp_replace(s, r"^([0-9]+)\.0+$", "$1"))


def _first_day(s: Column, *patterns: tuple[str, str]) -> Column:
    return F.coalesce(*[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f))) for p, f in patterns]).cast("date")


def lot_day(c: Column) -> Column:
    """DAT-05: a date in one of five forms; null if there is no such day."""
    return _first_day(
        text(c), (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
        (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"), (r"^[0-9]{8}$", "ddMMyyyy"),
    )


def stamp_day(c: Column) -> Column:
    """DAT-04: a date in one of three forms; null if there is no such day."""
    return _first_day(text(c), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"))


def sheet_day(c: Column) -> Column:
    """DAT-06: a sheet's day number counted from 1899-12-30, or the first day/month/year in a text, years of two digits being of this century."""
    s = text(c)
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.regexp_extract(s, r"^([0-9]{1,6})([.][0-9]+)?$", 1).try_cast("int"))
    part = lambda i: F.regexp_extract(s, r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{2,4})", i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    named = F.try_to_timestamp(F.concat_ws("-", year, part(2), part(1)), F.lit("y-M-d")).cast("date")
    return F.when(s.rlike(r"^[0-9]{1,6}([.][0-9]+)?$"), serial).otherwise(named)


def dotted_day(c: Column) -> Column:
    """DAT-08: dd/mm/yy as dd.mm.20yy; strokes of other texts become dots."""
    s = text(c)
    found = F.translate(F.regexp_extract(s, "[0-9]{2}/[0-9]{2}/([0-9]{4}|[0-9]{2})", 0), "/", ".")
    return F.when(found == "", F.translate(s, "/", ".")).otherwise(F.regexp_replace(found, r"\.([0-9]{2})$", ".20$1"))


def key_variants(c: Column) -> Column:
    """ARR-01: forms of a key, itself first: without leading zeros, padded to 14 and 13, its first twelve digits. Keys of up to six digits have no others."""
    k = key(c)
    n, bare = F.length(k), F.regexp_replace(k, "^0+", "")
    number = k.rlike("^[0-9]{7,}$")
    forms = F.array(
        F.nullif(k, F.lit("")), F.when(number & (F.length(bare) >= 6), bare), F.when(number & n.between(8, 14), F.lpad(k, 14, "0")),
        F.when(number & n.between(8, 13), F.lpad(k, 13, "0")), F.when(number & (n >= 13), F.substring(k, 1, 12)),
    )
    return kept(forms)


def ean_forms(c: Column) -> Column:
    """ARR-02: a bar code as read, without leading zeros, padded to 13, and its last eight digits."""
    d = digits(c)
    bare = F.when(d.rlike("^0+$"), "0").otherwise(F.regexp_replace(d, "^0+", ""))
    forms = F.array(F.nullif(d, F.lit("")), F.nullif(bare, F.lit("")), F.when((bare != "") & (F.length(bare) <= 13), F.lpad(bare, 13, "0")), F.when(F.length(bare) > 8, F.right(bare, F.lit(8))))
    return kept(forms)


def distinct_keys(*columns: Column) -> Column:
    """ARR-04: different texts of the columns that aren't blank, in order."""
    return kept(F.array(*map(text, columns)), "")


def identifiers(c: Column, most: int = 120) -> Column:
    """ARR-05: company numbers in a text, whole and by their first twelve digits, those with check digits first, and runs of 7 to 18 digits; different ones, at most so many."""
    s = text(c)
    masked = F.transform(F.regexp_extract_all(s, F.lit(r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"), F.lit(0)), digits)
    turned = F.transform(F.regexp_extract_all(s, F.lit(r"-[0-9]{2} +[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}"), F.lit(0)), lambda x: F.concat(F.substring(digits(x), 3, 12), F.substring(digits(x), 1, 2)))
    whole = F.flatten(F.transform(F.concat(masked, turned), lambda x: F.array(x, F.substring(x, 1, 12))))
    runs = F.transform(F.regexp_extract_all(s, F.lit(r"(?<![0-9])[0-9]{7,18}(?![0-9])"), F.lit(0)), digits)
    return F.slice(F.array_distinct(F.concat(whole, runs)), 1, most)


def reasons(c: Column) -> Column:
    """ARR-06: the parts of a status between bars, blank ones left out."""
    return F.filter(F.transform(F.split(text(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def merged_reasons(*columns: Column) -> Column:
    """ARR-06: different reasons of several statuses, in order, as one status."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*map(reasons, columns)))), " | ")


def json_field(c: Column, *paths: str) -> Column:
    """JSN-01: the first of these fields of a JSON text that is not blank."""
    return first_nonblank(*[F.get_json_object(c, f"$.{p}") for p in paths])
