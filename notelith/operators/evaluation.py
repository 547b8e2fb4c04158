"""A run against the corrected master: joins, one-to-one matching, dedup, accuracy, audit of missing lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelith.functions import numeric
from notelith.functions import text as tx
from notelith.operators.rows import place_in_group
from notelith.runtime import durable


def amount_key(c: Column | str, digits: int = 2) -> Column:
    """Amounts as texts of fixed decimals; '' for a missing one."""
    x = tx.col(c)
    exact = F.round(F.when(F.isnan(x), None).otherwise(x).cast("decimal(24,8)"), digits)
    return F.coalesce(exact.cast(f"decimal(24,{digits})").cast("string"), F.lit(""))


def composite_key(parts: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.upper(F.trim(F.col(p).cast("string"))), F.lit("")) for p in parts))


def left_with_truth(pred: DataFrame, truth: DataFrame, key: list[str], fields: list[str], tolerance: float = 0.02) -> DataFrame:
    """Every predicted row with each truth row of its key (duplicates fan out) and whether each field agrees."""
    kinds = dict(pred.dtypes)
    a = pred.select(composite_key(key).alias("_k"), "*")
    b = truth.select(composite_key(key).alias("_k"), *(F.col(f).alias(f"gt_{f}") for f in fields), F.lit(True).alias("matched"))
    joined = a.join(b, "_k", "left")

    def agrees(f: str) -> Column:
        if kinds[f] == "double":
            return numeric.within(f, f"gt_{f}", tolerance)
        return F.coalesce(F.upper(tx.trim_ws(f)), F.lit("")) == F.coalesce(F.upper(tx.trim_ws(f"gt_{f}")), F.lit(""))

    flags = {f"ok_{f}": F.coalesce(F.col("matched"), F.lit(False)) & agrees(f) for f in fields}
    flagged = joined.withColumns(flags)
    return flagged.withColumn("ok", reduce(lambda x, y: x & y, (F.col(f) for f in flags))).drop("_k")


def accuracy(compared: DataFrame, by: str) -> DataFrame:
    share = F.round((F.count_if("ok").cast("decimal(18,0)") * 100 / F.count("*")).cast("decimal(24,8)"), 2).cast("double")
    return compared.groupBy(by).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), share.alias("pct"))


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows of a key counted from 0."""
    return place_in_group(df, key, order, name).withColumn(name, F.col(name) - 1)


def missing_and_extra(pred: DataFrame, truth: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each place of a key on either side: left_only, right_only or both."""
    a = numbered(pred, key, order).select(*key, "place", F.lit(True).alias("_p"))
    b = numbered(truth, key, order).select(*key, "place", F.lit(True).alias("_t"))
    side = F.when(F.col("_t").isNull(), "left_only").when(F.col("_p").isNull(), "right_only").otherwise("both")
    return a.join(b, [*key, "place"], "full_outer").select(*key, "place", side.alias("side"))


def keep_latest(df: DataFrame, key: list[str], order: list[str], when: Column | None = None) -> DataFrame:
    """The last row of each key; rows for which ``when`` is false aren't touched."""
    gated = df if when is None else df.where(F.coalesce(when, F.lit(False)))
    latest = gated.groupBy(*key).agg(F.max(F.struct(*order, *(c for c in df.columns if c not in order))).alias("_r"))
    out = latest.select(*(F.col(f"_r.{c}").alias(c) for c in df.columns))
    return out if when is None else out.unionByName(df.where(~F.coalesce(when, F.lit(False))))


def keep_longest(df: DataFrame, key: list[str], text: str, order: list[str]) -> DataFrame:
    """Of each key the row with the longest text, the first of equal ones."""
    rank = F.struct((-F.length(F.coalesce(text, F.lit("")))).alias("l"), *order)
    return df.groupBy(*key).agg(F.min_by(F.struct(*(c for c in df.columns if c not in key)), rank).alias("_r")).select(*key, "_r.*")


def greedy_match(pred: DataFrame, truth: DataFrame, pred_id: str, truth_id: str, tiers: list[list[str]], order: str) -> DataFrame:
    """(tier, pred id, truth id): one-to-one matches, tier after tier; within a key first with first.

    For one key, taking the first truth row that is left for each predicted row in order is the pairing of equal places,
    so each tier is a join on key and place over what the tiers before left. Keys with an empty part match nothing.
    """
    left_p, left_t, found = pred, truth, []
    for n, key in enumerate(tiers):
        usable = reduce(lambda x, y: x & y, (F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in key))
        a = numbered(left_p.where(usable), key, [order, pred_id]).select(*key, "place", pred_id)
        b = numbered(left_t.where(usable), key, [order, truth_id]).select(*key, "place", truth_id)
        met = durable(a.join(b, [*key, "place"]).select(F.lit(n).alias("tier"), pred_id, truth_id))
        found.append(met)
        left_p = left_p.join(met.select(pred_id), pred_id, "left_anti")
        left_t = left_t.join(met.select(truth_id), truth_id, "left_anti")
    return reduce(DataFrame.unionByName, found)


def line_score(code: Column, words: Column, amount: Column, folded: Column, tight: Column) -> Column:
    """How well a page's line fits a missing row: its code counts 3, two words of its text 2, its amount 1.

    ``folded`` is the line in plain capitals, ``tight`` the same without anything but letters and digits.
    """
    hits = F.size(F.filter(words, lambda w: folded.contains(w)))
    return (
        F.when((F.length(code) > 0) & tight.contains(code), 3).otherwise(0)
        + F.when(hits >= 2, 2).otherwise(0)
        + F.when((amount != "") & folded.contains(amount), 1).otherwise(0)
    )


def audit_missing(rows: DataFrame, lines: DataFrame, id_col: str, page: list[str], least: int = 2) -> DataFrame:
    """(id, status, score): is a missing row on its page, on another page of its document, or nowhere?

    Rows meet the lines of their document only (an equi-join), each line once; the best score per row is an aggregate.
    """
    pdf, pagina = page
    marked = rows.select(id_col, pdf, F.col(pagina).alias("_page"), tx.key_token("Codigo").alias("_c"), tx.keywords("Descripcion", []).alias("_w"), F.replace(amount_key("Importe"), F.lit("."), F.lit(",")).alias("_a"))
    seen = lines.select(pdf, F.col(pagina).alias("_on"), tx.fold_upper("line").alias("_l"), tx.key_token(tx.fold_upper("line")).alias("_t"))
    score = line_score(F.col("_c"), F.col("_w"), F.col("_a"), F.col("_l"), F.col("_t"))
    met = marked.join(seen, pdf).select(id_col, (F.col("_on") == F.col("_page")).alias("same"), score.alias("score"))
    best = met.groupBy(id_col).agg(F.max(F.when(F.col("same"), F.col("score"))).alias("here"), F.max("score").alias("anywhere"))
    status = (
        F.when(F.col("here") >= least, "FOUND_SAME_PAGE")
        .when(F.col("anywhere") >= least, "FOUND_OTHER_PAGE")
        .when(F.col("anywhere").isNull(), "NO_PDF_DUMP")
        .when(F.col("here").isNull(), "NO_PAGE_DUMP")
        .otherwise("NOT_FOUND_OCR")
    )
    return rows.select(id_col).join(best, id_col, "left").select(id_col, status.alias("status"), F.coalesce("anywhere", F.lit(0)).alias("score"))
