"""Queries of the scalar functions over the view of odd values, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import scalars as S
from .functions import texts as X
from .registry import over


def scalar(name: str, columns: Callable[..., dict[str, Column]], sql: dict[str, str], first: str = "") -> None:
    """Registers columns, made of the view's, over f11_values; first: expressions that the SQL's columns use."""
    said = ", ".join(f"{expression} AS {name}" for name, expression in sql.items())
    source = f"(SELECT *, {first} FROM f11_values)" if first else "f11_values"
    read = ("num", "code", "phrase", "dia", "corpo")
    over(name, lambda x: x.select("row_id", *[c.alias(n) for n, c in columns(*map(F.col, read)).items()]), "f11_values", f"SELECT row_id, {said} FROM {source} v")


def _said(decimal: str) -> str:
    return f"coalesce(replace(rtrim(rtrim(CAST(CAST({decimal} AS DECIMAL(30,8)) AS VARCHAR), '0'), '.'), '.', ','), '')"


_CLEAN = "replace(replace(trim(num), 'R$', ''), ' ', '')"
_COMMA = f"replace(replace({_CLEAN}, '.', ''), ',', '.')"
_NUMBER = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)'"


def _number(unparted: str) -> str:
    s = f"CASE WHEN {_CLEAN} LIKE '%,%' THEN {_COMMA} ELSE {unparted} END"
    return f"CASE WHEN regexp_full_match({s}, {_NUMBER}) THEN CAST({s} AS DECIMAL(30,8)) END"


_GROUPS = _number(rf"CASE WHEN regexp_full_match({_CLEAN}, '[0-9]{{1,3}}(\.[0-9]{{3}})+') THEN replace({_CLEAN}, '.', '') ELSE {_CLEAN} END")
_BR = rf"CASE WHEN NOT regexp_matches(num, '[A-Za-z$%]') THEN {_GROUPS} END"
_POINT, _THOUSANDS = _number(_CLEAN), _number(f"replace({_CLEAN}, '.', '')")

scalar("num_02_br_number", lambda num, code, phrase, dia, corpo: {"n": N.said(N.br_number(num))}, {"n": _said(_BR)})
scalar("num_03_decimal_number", lambda num, code, phrase, dia, corpo: {"n": N.said(N.decimal_number(num))}, {"n": _said(_POINT)})
scalar("num_04_gate_quantity", lambda num, code, phrase, dia, corpo: {"n": N.gate_quantity(num)}, {"n": "CASE WHEN b > 0 AND b % 1 = 0 THEN CAST(b AS BIGINT) END"}, f"{_BR} AS b")
scalar("num_05_whole_number", lambda num, code, phrase, dia, corpo: {"n": N.whole_number(num), "erro": N.whole_error(num)}, {"n": "CASE WHEN t % 1 = 0 THEN CAST(t AS BIGINT) END", "erro": "CASE WHEN trim(num) = '' THEN 'QTD_VAZIA' WHEN t IS NULL THEN 'QTD_INVALIDA' WHEN t % 1 <> 0 THEN 'QTD_FRACIONADA' ELSE '' END"}, f"{_THOUSANDS} AS t")
scalar(
    "num_06_positive_text", lambda num, code, phrase, dia, corpo: {m: N.positive_text(num, m) for m in ("groups", "either", "comma")},
    {"groups": f"CASE WHEN g > 0 THEN {_said('g')} ELSE '' END", "either": f"CASE WHEN e > 0 THEN {_said('e')} ELSE '' END", "comma": f"CASE WHEN c > 0 THEN {_said('c')} ELSE '' END"},
    rf"""{_GROUPS} AS g, regexp_extract(num, '[-+]?[0-9][0-9.,]*', 0) AS f, contains(f, '.') AND contains(f, ',') AS b, replace(replace(f, '.', ''), ',', '.') AS u,
    TRY_CAST(CASE WHEN b THEN u WHEN length(string_split(replace(f, ',', '.'), '.')[-1]) = 3 AND (contains(f, '.') OR contains(f, ',')) AND regexp_full_match(f, '[0-9.,]+') THEN replace(replace(f, '.', ''), ',', '') ELSE replace(f, ',', '.') END AS DECIMAL(30,8)) AS e,
    TRY_CAST(CASE WHEN b THEN u ELSE replace(f, ',', '.') END AS DECIMAL(30,8)) AS c""",
)
scalar("num_07_half_up", lambda num, code, phrase, dia, corpo: {"n": N.half_up(num)}, {"n": f"CASE WHEN floor(t + 0.5) > 0 THEN {_said('floor(t + 0.5)')} ELSE '' END"}, f"{_THOUSANDS} AS t")
scalar("num_08_decimal_text", lambda num, code, phrase, dia, corpo: {"n": S.decimal_text(N.decimal_number(num) / 7)}, {"n": "replace(rtrim(rtrim(CAST(CAST(round(CAST(CAST(t AS DOUBLE) / 7 AS DECIMAL(30,8)), 4) AS DECIMAL(30,4)) AS VARCHAR), '0'), '.'), '.', ',')"}, f"{_POINT} AS t")
scalar("num_10_packs", lambda num, code, phrase, dia, corpo: {"n": N.said(N.packs(F.when(F.col("row_id") % 2 == 0, N.br_number(num)), N.br_number(num), F.lit(4).cast(N.KIND)))}, {"n": _said("CASE WHEN row_id % 2 = 0 AND b IS NOT NULL THEN b ELSE CAST(CAST(b AS DOUBLE) / 4 AS DECIMAL(30,8)) END")}, f"{_BR} AS b")
scalar("num_11_loose_number", lambda num, code, phrase, dia, corpo: {"n": N.said(N.loose_number(num))}, {"n": _said(f"CASE WHEN regexp_full_match(s, {_NUMBER}) THEN CAST(s AS DECIMAL(30,8)) END")}, r"regexp_replace(CASE WHEN regexp_matches(num, '[0-9],[0-9]') THEN replace(replace(num, '.', ''), ',', '.') ELSE num END, '[^0-9.\-]', '', 'g') AS s")
scalar("num_12_document_quantity", lambda num, code, phrase, dia, corpo: {"n": N.document_quantity(num)}, {"n": _said(_THOUSANDS)})
scalar("num_13_grouped_quantity", lambda num, code, phrase, dia, corpo: {"n": N.grouped_quantity(num)}, {"n": _said("coalesce(g, 0)")}, _number(rf"CASE WHEN regexp_full_match({_CLEAN}, '[0-9]+(\.[0-9]{{3}})+') THEN replace({_CLEAN}, '.', '') ELSE {_CLEAN} END") + " AS g")
scalar(
    "num_14_truncated", lambda num, code, phrase, dia, corpo: {"n": N.truncated(num, -1), "z": N.whole_or_zero(num), "d": N.quantity_or_digits(num)},
    {"n": "coalesce(CAST(trunc(t) AS BIGINT), -1)", "z": "CASE WHEN regexp_full_match(replace(num, '.', ''), '[0-9]+(,0+)?') THEN CAST(string_split(replace(num, '.', ''), ',')[1] AS BIGINT) ELSE 0 END", "d": f"CASE WHEN p IS NOT NULL THEN {_said('p')} ELSE regexp_replace(num, '[^0-9]', '', 'g') END"},
    f"{_THOUSANDS} AS t, {_POINT} AS p",
)
scalar("flt_15_price_like", lambda num, code, phrase, dia, corpo: {"preco": N.looks_like_price(num), "quatro": N.has_decimals(num, 4, 4), "tres": N.has_decimals(num, 3, 4)}, {"preco": f"regexp_full_match(replace(num, ' ', ''), '[0-9]{{1,4}},[0-9]{{3,6}}') AND coalesce({_GROUPS}, 0) > 0", "quatro": "regexp_matches(num, ',[0-9]{4}$')", "tres": "regexp_matches(num, ',[0-9]{3,4}$')"})
_LOW = "trim(regexp_replace(translate(lower(phrase), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '\\s+', ' ', 'g'))"
_UP = "trim(regexp_replace(translate(upper(phrase), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'AAAAAEEEEIIIIOOOOOUUUUCN'), '[^A-Z0-9]+', ' ', 'g'))"
_NET = "trim(regexp_replace(regexp_replace(regexp_replace(upper(phrase), '[^A-Z0-9]+', ' ', 'g'), '\\b(PDF|EXCEL|LAYOUT|RASTREABILIDADE)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_DIGITS = "regexp_replace(code, '[^0-9]', '', 'g')"
scalar("str_04_lower_folded", lambda num, code, phrase, dia, corpo: {"s": X.lower_folded(phrase)}, {"s": _LOW})
scalar("str_05_snake_keys", lambda num, code, phrase, dia, corpo: {"s": X.snake(phrase)}, {"s": f"trim(regexp_replace({_LOW}, '[^a-z0-9]+', '_', 'g'), '_')"})
scalar("str_06_network_names", lambda num, code, phrase, dia, corpo: {"s": X.network(phrase)}, {"s": _NET})
scalar("str_07_keys", lambda num, code, phrase, dia, corpo: {"s": X.key(code)}, {"s": f"CASE WHEN {_DIGITS} <> '' THEN {_DIGITS} ELSE regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') END"})
scalar("str_11_cnpj_forms", lambda num, code, phrase, dia, corpo: {"s": X.cnpj14(code), "formas": F.array_join(S.key_forms(code), "|")}, {"s": "CASE WHEN d = '' THEN '' WHEN length(d) > 14 THEN d[-14:] ELSE lpad(d, 14, '0') END", "formas": "array_to_string(list_filter([d, CASE WHEN d <> '' AND length(d) < 14 THEN lpad(d, 14, '0') END, CASE WHEN d LIKE '0%' THEN nullif(ltrim(d, '0'), '') END], lambda x: x IS NOT NULL AND x <> ''), '|')"}, f"{_DIGITS} AS d")
scalar("str_13_padded_gln", lambda num, code, phrase, dia, corpo: {"s": X.padded(code, 14), "sku": X.padded(num, 6)}, {"s": "CASE WHEN length(d) < 14 THEN lpad(d, 14, '0') ELSE d END", "sku": "CASE WHEN length(e) < 6 THEN lpad(e, 6, '0') ELSE e END"}, f"{_DIGITS} AS d, regexp_replace(num, '[^0-9]', '', 'g') AS e")
scalar("str_14_chosen_order", lambda num, code, phrase, dia, corpo: {"s": X.chosen_order(phrase), "c": X.chosen_order(code)}, {c: f"CASE WHEN regexp_full_match(trim({v}), '0*[0-9]{{3,12}}([.,]0+)?') THEN coalesce(nullif(ltrim(regexp_extract(trim({v}), '^([0-9]+)', 1), '0'), ''), '0') ELSE coalesce(list_filter(list_filter(list_transform(regexp_extract_all({v}, '[0-9]+'), lambda g: ltrim(g, '0')), lambda g: length(g) BETWEEN 3 AND 12), lambda g: length(g) BETWEEN 5 AND 8)[1], list_filter(list_transform(regexp_extract_all({v}, '[0-9]+'), lambda g: ltrim(g, '0')), lambda g: length(g) BETWEEN 3 AND 12)[1], '') END" for c, v in (("s", "phrase"), ("c", "CASE WHEN length(ltrim(code, '0')) > 12 THEN concat('x', code) ELSE code END"))})
scalar("str_15_file_keys", lambda num, code, phrase, dia, corpo: {"s": X.file_key(phrase)}, {"s": "CASE WHEN k = '' THEN 'arquivo' WHEN length(k) <= 42 THEN k ELSE concat(rtrim(k[1:33], '_'), '_', sha1(k)[1:8]) END"}, "trim(regexp_replace(phrase, '[^A-Za-z0-9]+', '_', 'g'), '_') AS k")
scalar("str_17_regions", lambda num, code, phrase, dia, corpo: {"s": X.region(phrase)}, {"s": f"CASE WHEN {_UP} LIKE '%HORT%' THEN 'SP-HORT' WHEN {_UP} IN ('POA', 'PORTO ALEGRE') THEN 'RS' WHEN {_UP} IN ('CTBA', 'CURITIBA') THEN 'PR' ELSE replace({_UP}, ' ', '-') END"})
scalar("str_18_tokens", lambda num, code, phrase, dia, corpo: {"t": F.array_join(X.tokens(phrase, ("SEM", "THE")), "|"), "l": F.array_join(X.listed(phrase), "|")}, {"t": f"coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(string_split({_UP}, ' ')) AS t, unnest(range(1, len(string_split({_UP}, ' ')) + 1)) AS i) WHERE length(t) >= 3 AND t NOT IN ('SEM', 'THE') GROUP BY t)), '')", "l": "coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT trim(regexp_replace(translate(upper(p), 'ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'AAAAAEEEEIIIIOOOOOUUUUCN'), '[^A-Z0-9]+', ' ', 'g')) AS t, i FROM (SELECT unnest(string_split_regex(phrase, '[|,;\\n]+')) AS p, unnest(range(1, len(string_split_regex(phrase, '[|,;\\n]+')) + 1)) AS i)) WHERE t <> '' GROUP BY t)), '')"})
scalar("str_19_containment", lambda num, code, phrase, dia, corpo: {"a": X.holds(S.folded(phrase), F.lit("PORTO ALEGRE")), "b": X.holds(S.folded(phrase), F.lit("REDE")), "c": X.holds(S.folded(phrase), F.lit("ORTO"))}, {"a": f"contains({_UP}, 'PORTO ALEGRE')", "b": f"list_contains(string_split({_UP}, ' '), 'REDE')", "c": f"list_contains(string_split({_UP}, ' '), 'ORTO')"})
scalar("str_20_plain_bodies", lambda num, code, phrase, dia, corpo: {"s": X.plain_body(corpo)}, {"s": r"""CASE row_id % 1 WHEN 0 THEN trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(corpo, '<style>.*</style>', ' ', 'g'), '</?(p|br)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t;]+', ' ', 'g'), ' *\n+ *', chr(10), 'g'), concat(' ', chr(10))) END"""})
scalar("str_21_rejoined_cnpj", lambda num, code, phrase, dia, corpo: {"s": X.rejoined_cnpj(corpo)}, {"s": r"CASE WHEN corpo LIKE 'CNPJ %' THEN regexp_replace(regexp_extract(corpo, '[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}', 0), '[^0-9]', '', 'g') WHEN corpo LIKE 'doc %' THEN concat(regexp_replace(regexp_extract(corpo, '[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}', 0), '[^0-9]', '', 'g'), '77') ELSE '' END"})
scalar("str_22_alert_parts", lambda num, code, phrase, dia, corpo: {"pagina": X.alert_page(phrase), "linha": X.alert_line(phrase)}, {"pagina": "CASE WHEN phrase LIKE 'Página %' THEN regexp_extract(phrase, '([0-9]+)', 1) ELSE '' END", "linha": "CASE WHEN contains(phrase, '|') THEN trim(phrase[instr(phrase, '|') + 1:]) ELSE '' END"})
scalar("str_23_reference_centre", lambda num, code, phrase, dia, corpo: {"s": X.reference_centre(F.when(F.col("row_id") % 5 == 0, "bfx").otherwise(""), F.when(F.col("row_id") % 3 == 0, "*").when(F.col("row_id") % 3 == 1, "c1").otherwise(""), F.when(F.col("row_id") % 2 == 0, "c9").otherwise(""), "D0"), "r": X.centre_label(F.lit("bfx"), F.when(F.col("row_id") % 2 == 0, "Norte").otherwise(""))}, {"s": "CASE WHEN row_id % 5 = 0 THEN 'BFX' WHEN row_id % 3 = 1 THEN 'C1' WHEN row_id % 2 = 0 THEN 'C9' ELSE 'D0' END", "r": "CASE WHEN row_id % 2 = 0 THEN 'BFX - Norte' ELSE 'BFX' END"})
scalar("str_24_cells", lambda num, code, phrase, dia, corpo: {"s": X.cell(num)}, {"s": r"CASE WHEN num LIKE '%E+%' THEN CAST(CAST(CAST(replace(num, ',', '.') AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN regexp_full_match(num, '[0-9]+\.0+') THEN string_split(num, '.')[1] ELSE num END"})
_DAY = lambda forms, c="dia": "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({c}, '{p}') THEN CAST(try_strptime({c}, '{f}') AS DATE) END" for p, f in forms) + ")"
_D, _S, _I, _H = (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "%d.%m.%Y"), ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"), ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"), ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y")
scalar("dat_05_lot_days", lambda num, code, phrase, dia, corpo: {"d": F.date_format(X.lot_day(dia), "dd.MM.yyyy")}, {"d": f"strftime({_DAY([_D, _S, _I, _H, ('[0-9]{8}', '%d%m%Y')])}, '%d.%m.%Y')"})
scalar("dat_04_stamps_of_three_forms", lambda num, code, phrase, dia, corpo: {"s": S.stamp(X.stamp_day(dia))}, {"s": f"coalesce(strftime({_DAY([_S, _I, _H])}, '%Y%m%d0000'), '000000000000')"})
scalar("dat_06_sheet_days", lambda num, code, phrase, dia, corpo: {"d": F.date_format(X.sheet_day(dia), "dd/MM/yyyy")}, {"d": r"strftime(CASE WHEN regexp_full_match(dia, '[0-9]{1,6}') THEN DATE '1899-12-30' + CAST(dia AS INTEGER) WHEN t <> '' THEN CAST(try_strptime(CASE WHEN length(t) = 8 THEN concat(t[1:6], '20', t[7:8]) ELSE t END, '%d/%m/%Y') AS DATE) END, '%d/%m/%Y')"}, r"translate(regexp_extract(dia, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}', 0), '.-', '//') AS t")
scalar("dat_07_next_days", lambda num, code, phrase, dia, corpo: {"d": F.date_format(F.date_add(X.lot_day(dia), 1), "dd.MM.yyyy")}, {"d": f"strftime({_DAY([_D, _S, _I, _H, ('[0-9]{8}', '%d%m%Y')])} + 1, '%d.%m.%Y')"})
scalar("dat_08_dotted_days", lambda num, code, phrase, dia, corpo: {"d": X.dotted_day(dia)}, {"d": "CASE WHEN regexp_matches(dia, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN replace(regexp_extract(dia, '[0-9]{2}/[0-9]{2}/[0-9]{4}', 0), '/', '.') WHEN regexp_matches(dia, '[0-9]{2}/[0-9]{2}/[0-9]{2}') THEN concat(replace(regexp_extract(dia, '([0-9]{2}/[0-9]{2}/)', 1), '/', '.'), '20', regexp_extract(dia, '[0-9]{2}/[0-9]{2}/([0-9]{2})', 1)) ELSE replace(dia, '/', '.') END"})
scalar("arr_01_key_variants", lambda num, code, phrase, dia, corpo: {"k": F.array_join(X.key_variants(code), "|")}, {"k": """array_to_string(list_filter([nullif(k, ''), CASE WHEN isnum AND k LIKE '0%' AND length(ltrim(k, '0')) >= 6 THEN ltrim(k, '0') END, CASE WHEN isnum AND length(k) BETWEEN 8 AND 13 THEN lpad(k, 14, '0') END,
 CASE WHEN isnum AND length(k) BETWEEN 8 AND 12 THEN lpad(k, 13, '0') END, CASE WHEN isnum AND length(k) >= 13 THEN k[1:12] END], lambda x: x IS NOT NULL), '|')"""}, f"CASE WHEN {_DIGITS} <> '' THEN {_DIGITS} ELSE regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') END AS k, regexp_full_match(k, '[0-9]{{7,}}') AS isnum")
scalar("arr_02_ean_forms", lambda num, code, phrase, dia, corpo: {"k": F.array_join(X.ean_forms(code), "|")}, {"k": """array_to_string(list_filter([nullif(d, ''), CASE WHEN b <> d THEN b END, CASE WHEN d <> '' AND length(b) <= 13 AND lpad(b, 13, '0') <> d AND lpad(b, 13, '0') <> b THEN lpad(b, 13, '0') END, CASE WHEN length(b) > 8 THEN b[-8:] END], lambda x: x IS NOT NULL), '|')"""}, f"{_DIGITS} AS d, CASE WHEN d = '' THEN '' ELSE coalesce(nullif(ltrim(d, '0'), ''), '0') END AS b")
scalar("arr_04_distinct_keys", lambda num, code, phrase, dia, corpo: {"k": F.array_join(X.distinct_keys(code, num, F.trim(F.concat(F.lit(" "), code)), phrase), "|")}, {"k": "array_to_string(list_filter([nullif(c, ''), CASE WHEN n <> c THEN nullif(n, '') END, CASE WHEN p <> c AND p <> n THEN nullif(p, '') END], lambda x: x IS NOT NULL), '|')"}, "trim(code) AS c, trim(num) AS n, trim(phrase) AS p")
scalar("arr_05_identifiers", lambda num, code, phrase, dia, corpo: {"k": F.array_join(X.identifiers(corpo), "|")}, {"k": r"CASE WHEN corpo LIKE 'CNPJ %' THEN concat('12345', m, '000177|12345', m, '0001|', regexp_extract(corpo, 'e ([0-9]{7,18}) ', 1)) WHEN corpo LIKE 'doc %' THEN concat('12345', m, '000177|12345', m, '0001') ELSE '' END"}, r"regexp_extract(corpo, '12\.345\.([0-9]{3})', 1) AS m")
scalar("arr_06_reasons", lambda num, code, phrase, dia, corpo: {"k": F.array_join(X.reasons(phrase), "/"), "m": X.merged_reasons(phrase, F.lit("x | X")), "n": F.size(X.reasons(phrase)).cast("long")}, {"k": "array_to_string(r, '/')", "m": "array_to_string(list_concat(r, CASE WHEN list_contains(r, 'x') THEN ['X'] ELSE ['x', 'X'] END), ' | ')", "n": "len(r)"}, "list_filter(list_transform(string_split(phrase, '|'), lambda x: trim(x)), lambda x: x <> '') AS r")
scalar("jsn_01_sidecars", lambda num, code, phrase, dia, corpo: {"nome": X.json_field(F.col("meta"), "arquivo", "nome_original"), "pedido": F.regexp_extract(X.json_field(F.col("meta"), "assunto"), "([0-9]+)", 1)}, {"nome": "coalesce(nullif(json_extract_string(meta, '$.arquivo'), ''), json_extract_string(meta, '$.nome_original'))", "pedido": "regexp_extract(json_extract_string(meta, '$.assunto'), '([0-9]+)', 1)"})
scalar("flt_24_first_nonblank", lambda num, code, phrase, dia, corpo: {"s": X.first_nonblank(F.lit(" "), dia, num, code)}, {"s": "CASE WHEN trim(dia) <> '' THEN trim(dia) WHEN trim(num) <> '' THEN trim(num) ELSE trim(code) END"})
