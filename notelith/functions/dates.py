"""Dates of documents. In storage they are texts dd/mm/yyyy; a DATE comes beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelith.functions.text import col

_DMY = r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})"
_DOTTED = r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})"
_YMD = r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"


def _format(d: Column, m: Column, y: Column) -> Column:
    return F.format_string("%02d/%02d/%04d", d.cast("int"), m.cast("int"), y.cast("int"))


def parse_date_es(c: Column | str, dots: bool = False) -> Column:
    """The first d/m/y, else the first y/m/d, as dd/mm/yyyy, else ''. Years of two digits up to 69 are 20xx."""
    text, dmy = F.coalesce(col(c), F.lit("")), _DOTTED if dots else _DMY
    d, m, y = (F.regexp_extract(text, dmy, i) for i in (1, 2, 3))
    century = F.when(F.length(y) != 2, F.lit("")).when(y.try_cast("int") <= 69, F.lit("20")).otherwise(F.lit("19"))
    y2, m2, d2 = (F.regexp_extract(text, _YMD, i) for i in (1, 2, 3))
    first = F.when(d != "", _format(d, m, F.concat(century, y)))
    return F.coalesce(first, F.when(y2 != "", _format(d2, m2, y2)), F.lit(""))


def as_date(c: Column | str) -> Column:
    """A DATE, null where the text names no day of the calendar."""
    return F.try_to_date(col(c), "dd/MM/yyyy")


def date_of_code(c: Column | str) -> Column:
    """'A110226...' -> '11/02/2026', else ''."""
    p = r"^[AH]([0-9]{2})([0-9]{2})([0-9]{2})"
    d, m, y = (F.regexp_extract(col(c), p, i) for i in (1, 2, 3))
    return F.when(d != "", F.concat(d, F.lit("/"), m, F.lit("/20"), y)).otherwise(F.lit(""))


def year_from_path(path: Column | str, year: Column | str, reach: int = 3) -> Column:
    """The year in a file's path if it lies near the one that was read, else the one read."""
    named = F.regexp_extract(col(path), r"(20[0-9]{2})", 1).try_cast("int")
    return F.when(F.abs(named - col(year)) <= reach, named).otherwise(col(year))


# Months as they start, by number.
MONTHS = {"ENE": 1, "FEB": 2, "MAR": 3, "ABR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AGO": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DIC": 12, "JAN": 1, "APR": 4, "AUG": 8, "DEC": 12}
_WORDS = r"(?i)([0-9]{1,2})\s*(?:de\s+)?(" + "|".join(MONTHS) + r")[a-z]*\.?\s*(?:del?\s+)?([0-9]{4})"


def parse_date_words(c: Column | str) -> Column:
    """'3 de febrero de 2025' -> '03/02/2025'; without one what ``parse_date_es`` finds."""
    text = F.coalesce(col(c), F.lit(""))
    d, m, y = (F.regexp_extract(text, _WORDS, i) for i in (1, 2, 3))
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.when(d != "", _format(d, F.try_element_at(table, F.upper(m)), y)).otherwise(parse_date_es(c))


def default_date(c: Column | str, other: Column | str) -> Column:
    """A date, or the one to take where there is none."""
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), col(other))
