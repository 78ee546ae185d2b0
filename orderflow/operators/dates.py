"""Ship dates by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Names of weekdays, Monday first, without accents.
WEEKDAYS = ("SEGUNDA", "TERCA", "QUARTA", "QUINTA", "SEXTA", "SABADO", "DOMINGO")


def not_sunday(day: Column) -> Column:
    return F.when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def read_day(c: Column) -> Column:
    """Date of d.m.yyyy, d/m/yyyy, d-m-yyyy or yyyy-m-d; null if there is no such day."""
    s = S.text(c)
    dmy = F.when(s.rlike(r"^[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}$"), F.try_to_timestamp(F.regexp_replace(s, "[.-]", "/"), F.lit("d/M/yyyy")))
    ymd = F.when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(s, F.lit("yyyy-M-d")))
    return F.coalesce(dmy, ymd).cast("date")


def weekday_number(c: Column) -> Column:
    s = F.regexp_replace(F.translate(F.upper(S.text(c)), "ÇÁ", "CA"), "^(SEGUNDA|TERCA|QUARTA|QUINTA|SEXTA)-FEIRA$", "$1")
    return F.coalesce(*[F.when(s == name, F.lit(i)) for i, name in enumerate(WEEKDAYS)])


def ship_day(rule: Column, value: Column, today: Column) -> Column:
    """Date by rule D+1 or COLUNA, never a Sunday; a weekday means its next occurrence after today; null otherwise (DAT-01)."""
    ahead = F.pmod(weekday_number(value) - F.weekday(today), F.lit(7))
    named = F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))
    rule = F.upper(S.text(rule))
    return not_sunday(F.when(rule == "D+1", F.date_add(today, 1)).when(rule == "COLUNA", F.coalesce(read_day(value), named)))
