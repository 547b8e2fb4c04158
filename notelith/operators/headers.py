"""Repair of note numbers and order codes from rows that agree, across pages.

Everything is counted once, before any repair, and the counts are joined back: nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelith.functions import text as tx
from notelith.runtime import durable

MIN_NOTE_DIGITS = 7
MIN_DOMINANT = 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def phone_like(c: Column, prefixes: str) -> Column:
    return (F.length(_digits(c)) == 9) & _digits(c).rlike(f"^(?:{prefixes})")


def prefix_of(c: Column) -> Column:
    d = _digits(c)
    return F.when(F.length(d) >= 2, F.substring(d, 1, 2))


def keyed(df: DataFrame) -> DataFrame:
    note = F.nullif(F.upper(tx.normalize_spaces(F.coalesce("AlbaranNumero", F.lit("")))), F.lit(""))
    return df.withColumns(
        {"_prov": F.nullif(tx.key_token("Proveedor"), F.lit("")), "_sup": F.nullif(tx.key_token("SuPedidoCodigo"), F.lit("")), "_alb": note}
    )


def prefix_counts(rows: DataFrame) -> DataFrame:
    """(prov, prefix, hits): the first two digits of a supplier's note numbers."""
    return rows.where("_prov is not null").withColumn("prefix", prefix_of(F.col("_alb"))).where("prefix is not null").groupBy("_prov", "prefix").agg(F.count("*").alias("hits"))


def dominant_prefix(rows: DataFrame) -> DataFrame:
    """(prov, dominant, dominant_hits): the most frequent prefix, of equal ones the least."""
    top = F.min(F.struct((-F.col("hits")).alias("h"), "prefix")).alias("t")
    return prefix_counts(rows).groupBy("_prov").agg(top).select("_prov", F.col("t.prefix").alias("dominant"), (-F.col("t.h")).alias("dominant_hits"))


def majority(counted: DataFrame, key: list[str], value: str, order: list[Column], tie: Column | None = None) -> DataFrame:
    """(key..., best): the first value if it is the only one or counts more than the second, or wins the tie."""
    w = Window.partitionBy(*key).orderBy(*order)
    ranked = counted.withColumns({"_r": F.row_number().over(w), "_next": F.lead("n").over(w)})
    if tie is not None:
        ranked = ranked.withColumn("_tie", F.lead(tie).over(w))
    first = ranked.where("_r = 1")
    accept = F.col("_next").isNull() | (F.col("n") > F.col("_next"))
    if tie is not None:
        accept = accept | ((F.col("n") == F.col("_next")) & ~tie & F.col("_tie"))
    return first.where(accept).select(*key, F.col(value).alias("best"), F.col("n").alias("best_n"))


def best_notes(rows: DataFrame, prefixes: str) -> DataFrame:
    """(prov, sup, best): the note number on which the rows of an order agree."""
    counted = rows.where("_prov is not null and _sup is not null and _alb is not null").groupBy("_prov", "_sup", "_alb").agg(F.count("*").alias("n"))
    hits = prefix_counts(rows)
    counted = counted.withColumn("prefix", prefix_of(F.col("_alb"))).join(hits, ["_prov", "prefix"], "left")
    phone = phone_like(F.col("_alb"), prefixes)
    order = [phone.asc(), F.col("n").desc(), F.coalesce("hits", F.lit(0)).desc(), F.length(_digits(F.col("_alb"))).desc(), F.col("_alb").asc()]
    return majority(counted, ["_prov", "_sup"], "_alb", order, phone)


def best_orders(rows: DataFrame) -> DataFrame:
    """(prov, alb, best): the order code on which the rows of a note agree."""
    counted = rows.where("_prov is not null and _sup is not null and _alb is not null").groupBy("_prov", "_alb", "_sup").agg(F.count("*").alias("n"))
    return majority(counted, ["_prov", "_alb"], "_sup", [F.col("n").desc(), F.length("_sup").desc(), F.col("_sup").asc()])


def repair(df: DataFrame, id_col: str, phone_prefixes: str = "94[3-9]") -> DataFrame:
    """(id, AlbaranNumero, SuPedidoCodigo, repaired note?, imputed order?): weak headers from rows that agree."""
    rows = durable(keyed(df.select(id_col, "Proveedor", "AlbaranNumero", "SuPedidoCodigo", "ParseWarn")))
    hits = prefix_counts(rows)
    own_counts = rows.groupBy("_prov", "_sup", "_alb").agg(F.count("*").alias("own_n"))
    notes = best_notes(rows, phone_prefixes).select("_prov", "_sup", F.col("best").alias("target"), F.col("best_n").alias("target_n"))
    j = rows.join(notes, ["_prov", "_sup"], "left").join(own_counts, ["_prov", "_sup", "_alb"], "left").join(dominant_prefix(rows), ["_prov"], "left")
    j = j.withColumns({"_own": prefix_of(F.col("_alb")), "_tgt": prefix_of(F.col("target"))})
    j = j.join(hits.select("_prov", F.col("prefix").alias("_own"), F.col("hits").alias("own_hits")), ["_prov", "_own"], "left")
    j = j.join(hits.select("_prov", F.col("prefix").alias("_tgt"), F.col("hits").alias("target_hits")), ["_prov", "_tgt"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    own_n, own_hits, target_hits = zero("own_n"), zero("own_hits"), zero("target_hits")
    own_n = F.when(F.col("_alb").isNull(), 0).otherwise(own_n)
    outlier = (zero("dominant_hits") >= MIN_DOMINANT) & F.col("_own").isNotNull() & (F.col("_own") != F.col("dominant")) & (own_hits <= 1)
    own_phone, target_phone = phone_like(F.col("_alb"), phone_prefixes), phone_like(F.col("target"), phone_prefixes)
    weak = F.coalesce("ParseWarn", F.lit("")).contains("compact_rescue") | (F.length(_digits(F.col("_alb"))) < MIN_NOTE_DIGITS) | own_phone | F.coalesce(outlier, F.lit(False))
    stronger = (F.col("target_n") > own_n) | ((F.col("target_n") == own_n) & own_phone & ~target_phone)
    recovers = (F.col("target_n") >= own_n) & (target_hits > own_hits) & (F.col("dominant").isNull() | (F.col("_tgt") == F.col("dominant")))
    take = F.coalesce(F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("_alb")) & weak & (stronger | recovers), F.lit(False))
    j = j.withColumns({"note_repaired": take, "_new": F.when(take, F.col("target")).otherwise(F.col("_alb"))})
    orders = best_orders(rows).select("_prov", F.col("_alb").alias("_new"), F.col("best").alias("order_best"))
    j = j.join(orders, ["_prov", "_new"], "left")
    imputes = F.col("_sup").isNull() & F.col("order_best").isNotNull()
    return j.select(
        id_col,
        F.when(F.col("note_repaired"), F.col("target")).otherwise(F.col("AlbaranNumero")).alias("AlbaranNumero"),
        F.when(imputes, F.col("order_best")).otherwise(F.col("SuPedidoCodigo")).alias("SuPedidoCodigo"),
        "note_repaired",
        imputes.alias("order_imputed"),
    )
