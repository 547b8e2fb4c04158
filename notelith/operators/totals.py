"""Totals of notes against their footers, and figures of suppliers.

Sums of money are decimals: no order of addition changes them. All groupings are combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelith.functions import dates

KEYS = ["Proveedor", "AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"]


def money(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(x), None).otherwise(x).cast("decimal(18,4)")


def last_known(c: str, order: list[str]) -> Column:
    """The last value that isn't missing, in an explicit order; of equal places the greatest."""
    there = F.col(c).isNotNull() & ~F.isnan(c)
    return F.max_by(F.when(there, F.col(c)), F.when(there, F.struct(*order, c)))


def note_totals(meta: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Per note: the sum of its pages' line sums, the last footer amounts, and how far they are apart. Null keys are a group."""
    grouped = meta.groupBy(*keys).agg(
        F.sum(money("SumaImportesLineas")).alias("lines_sum"),
        last_known("NetoComercialPie", order).alias("NetoComercialPie"),
        last_known("TotalAlbaranPie", order).alias("TotalAlbaranPie"),
    )
    return grouped.select(
        *keys,
        F.coalesce("lines_sum", F.lit(0)).cast("double").alias("SumaImportesLineas"),
        "NetoComercialPie",
        "TotalAlbaranPie",
        F.round(F.coalesce("lines_sum", F.lit(0)) - money("NetoComercialPie"), 2).cast("double").alias("Dif_Suma_vs_Neto"),
        F.round(F.coalesce("lines_sum", F.lit(0)) - money("TotalAlbaranPie"), 2).cast("double").alias("Dif_Suma_vs_Total"),
    )


def line_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum(money("Importe")).cast("double").alias("line_sum"), F.count("*").alias("lines"))


def supplier_figures(lines: DataFrame, by: list[str]) -> DataFrame:
    """The run's figures; the least of equally frequent parsers. Dates are days of the calendar, not texts."""
    day = dates.as_date(dates.parse_date_es("FechaAlbaran", dots=True))
    warned = F.coalesce(F.trim("ParseWarn") != "", F.lit(False))
    return lines.groupBy(*by).agg(
        F.mode("Parser", True).alias("Parser"),
        F.count_distinct("Pdf").alias("pdfs"),
        F.count_distinct("Pdf", "Pagina").alias("pages"),
        F.count_distinct(F.struct("Proveedor", "AlbaranNumero")).alias("notes"),
        F.count("*").alias("lines"),
        F.coalesce(F.sum(money("Importe")), F.lit(0)).cast("double").alias("amount"),
        F.count_if(warned).alias("warned"),
        F.date_format(F.min(day), "dd/MM/yyyy").alias("first_day"),
        F.date_format(F.max(day), "dd/MM/yyyy").alias("last_day"),
    )


def reconcile_last_line(lines: DataFrame, meta: DataFrame, key: list[str], order: list[str], least: float = 20.0, share: float = 0.25) -> DataFrame:
    """A small difference between footer and line sum goes onto the note's last line (``adjusted``); a larger one stays.

    The last line is found by an aggregate, not by a window, so a note of any length is no single task.
    """
    place = F.struct(*order)
    footers = meta.groupBy(*key).agg(F.max("NetoComercialPie").alias("_footer"))
    sums = lines.groupBy(*key).agg(F.sum(money("Importe")).alias("_sum"), F.max(place).alias("_last"))
    gap = F.round(money("_footer") - F.col("_sum"), 2)
    small = (gap != 0) & (F.abs(gap) <= F.greatest(F.lit(least), F.abs("_footer") * share))
    moved = sums.join(footers, key).where(small).select(*key, "_last", gap.alias("_gap"))
    joined = lines.withColumn("_p", place).join(moved, key, "left")
    hit = F.col("_p").eqNullSafe(F.col("_last")) & F.col("_gap").isNotNull()
    adjusted = F.when(hit, F.round(money("Importe") + F.col("_gap"), 2).cast("double")).otherwise(F.col("Importe"))
    return joined.withColumn("adjusted", adjusted).drop("_p", "_last", "_gap")


def sole_line_amount(lines: DataFrame, meta: DataFrame, key: list[str]) -> DataFrame:
    """Where a note has one line without an amount, the footer's. Lines of no note (a null key) keep their own; every line comes out."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    noted = lines.where(whole)
    # The footer is wanted for notes of one line only: a hot note meets nothing.
    sole = noted.groupBy(*key).agg(F.count("*").alias("_n"), F.count("Importe").alias("_known")).where((F.col("_n") == 1) & (F.col("_known") == 0))
    footers = meta.where(whole).groupBy(*key).agg(F.max("NetoComercialPie").alias("_f"))
    joined = noted.join(sole.join(footers, key).select(*key, "_f"), key, "left")
    filled = joined.withColumn("amount", F.coalesce("Importe", "_f")).drop("_f")
    return filled.unionByName(lines.where(~whole).withColumn("amount", F.col("Importe")))
