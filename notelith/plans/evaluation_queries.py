"""The run's lines against the corrected master."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelith.functions import numeric
from notelith.operators import evaluation as ev
from notelith.operators import pages, rows
from notelith.plans.scalar_queries import LINES_SQL, sql_fold, sql_key, sql_round
from notelith.runtime import missing_as_null, table

KEY = ["Proveedor", "Pdf", "Pagina", "Linea"]
FIELDS = ["AlbaranNumero", "SuPedidoCodigo", "Codigo", "Importe"]
PLACE = ["Proveedor", "Pdf", "Pagina"]
ORDER = ["Linea", "updated_at", "Codigo", "Importe", "CantidadServida", "AlbaranNumero"]


def _store(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return missing_as_null(table(spark, sf_dir, name), ["AlbaranNumero", "SuPedidoCodigo", "Codigo", "CantidadServida", "PrecioUnitario", "Importe"])


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "lines_run")


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "lines_master")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.left_with_truth(_run(spark, sf_dir), _master(spark, sf_dir), KEY, FIELDS)


def pred_truth_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select(*KEY, "updated_at", *(f"ok_{f}" for f in FIELDS), "ok")


def accuracy_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(_compared(spark, sf_dir), "Proveedor")


def top3_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = _compared(spark, sf_dir).where("not ok").select(*KEY, "updated_at").distinct()
    w = Window.partitionBy("Proveedor").orderBy("Pdf", "Pagina", "Linea", "updated_at")
    return wrong.withColumn("r", F.row_number().over(w)).where("r <= 3")


def cumcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.numbered(_run(spark, sf_dir), PLACE, ORDER).select(*PLACE, "Linea", "updated_at", "place")


def legacy_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = ev.missing_and_extra(_run(spark, sf_dir), _master(spark, sf_dir), PLACE, ORDER)
    return sides.groupBy("Proveedor", "side").agg(F.count("*").alias("rows"))


def missing_lines_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir).select(*KEY)
    return _master(spark, sf_dir).select(*KEY).distinct().join(run, KEY, "left_anti")


def extra_lines_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = _master(spark, sf_dir).select(*KEY)
    return _run(spark, sf_dir).select(*KEY).distinct().join(master, KEY, "left_anti")


def by_supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of truth and run, missing and extra ones, of every supplier that either side names."""
    parts = {"truth": _master(spark, sf_dir), "run": _run(spark, sf_dir), "missing": missing_lines_anti(spark, sf_dir), "extra": extra_lines_anti(spark, sf_dir)}
    all_ = None
    for name, df in parts.items():
        side = df.select("Proveedor", F.lit(name).alias("side"))
        all_ = side if all_ is None else all_.unionByName(side)
    return all_.groupBy("Proveedor").agg(*(F.count_if(F.col("side") == n).alias(n) for n in parts))


def sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts by supplier with their place in the report: most missing lines first, then the name."""
    counts = by_supplier_counts(spark, sf_dir).withColumn("least", -F.col("missing"))
    return rows.global_index(counts, ["least", "Proveedor"]).select("Proveedor", "missing", "extra", F.col("idx").alias("place"))


def week_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and amounts of each batch on both sides, and their differences."""
    week = F.regexp_extract("Pdf", "^([A-Z]+_[0-9]+)", 1)
    side = lambda df, n: df.select(week.alias("week"), F.lit(n).alias("side"), F.col("Importe").cast("decimal(18,4)").alias("amount"))
    both = side(_run(spark, sf_dir), "run").unionByName(side(_master(spark, sf_dir), "truth"))
    of = lambda n: F.col("side") == n
    total = lambda n: F.coalesce(F.sum(F.when(of(n), F.col("amount"))), F.lit(0))
    found = both.groupBy("week").agg(F.count_if(of("run")).alias("run"), F.count_if(of("truth")).alias("truth"), total("run").alias("a"), total("truth").alias("b"))
    return found.select("week", "run", "truth", (F.col("run") - F.col("truth")).alias("delta"), F.round(F.col("a") - F.col("b"), 2).cast("double").alias("amount_delta"))


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the master's rows with one signature; rows without an amount are left alone."""
    signed = _master(spark, sf_dir).withColumn("sig", F.concat_ws("|", ev.composite_key(["Proveedor", "Pdf", "Pagina", "AlbaranNumero", "Codigo"]), ev.amount_key("Importe")))
    kept = ev.keep_latest(signed, ["sig"], ["updated_at", "Linea"], F.col("Importe").isNotNull())
    return kept.select(*PLACE, "Linea", "updated_at", "Codigo", F.round("Importe", 2).alias("Importe"))


def dedup_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines with one note, code and amount the one with the longest text; lines without a note or an amount are left alone."""
    lines = table(spark, sf_dir, "detail_lines")
    keyed = lines.select("AlbaranNumero", "Codigo", ev.amount_key("Importe").alias("amount"), "line_id", "Descripcion", (F.col("AlbaranNumero").isNotNull() & F.col("Importe").isNotNull()).alias("known"))
    names = ["AlbaranNumero", "Codigo", "amount", "line_id"]
    kept = ev.keep_longest(keyed.where("known"), names[:3], "Descripcion", ["line_id"])
    return kept.select(*names).unionByName(keyed.where("not known").select(*names))


def amount_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select(*KEY, "updated_at", ev.amount_key("Importe").alias("amount"), ev.amount_key("CantidadServida", 3).alias("quantity"))


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of run and master: by page and code and amount, by note and code, by supplier and text."""
    amount = ev.amount_key("Importe")
    a = rows.global_index(_run(spark, sf_dir).withColumn("amount", amount), ["Pdf", "Pagina", "Linea", *ORDER[1:], "SuPedidoCodigo"]).withColumnRenamed("idx", "pred_id")
    b = rows.global_index(_master(spark, sf_dir).withColumn("amount", amount), ["Pdf", "Pagina", "Linea", *ORDER[1:], "SuPedidoCodigo"]).withColumnRenamed("idx", "truth_id")
    tiers = [["Pdf", "Pagina", "Codigo", "amount"], ["AlbaranNumero", "Codigo"], ["Proveedor", "Descripcion"]]
    found = ev.greedy_match(a, b, "pred_id", "truth_id", tiers, "Linea")
    return found.groupBy("tier").agg(F.count("*").alias("matches"))


ROW = r"^([^;]+);([^;]+);([0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+)$"


def _missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand on the documents' pages, looked for on their own page and, as if the page had been misread, on the next."""
    lines = pages.explode_lines(table(spark, sf_dir, "documents"), ["doc_id", "Pdf", "Pagina"], "text").where(F.col("line").rlike(ROW))
    part = lambda i: F.regexp_extract("line", ROW, i)
    read = lines.select("doc_id", "ln", "Pdf", "Pagina", part(1).alias("Codigo"), part(2).alias("Descripcion"), numeric.to_float_es(part(6)).alias("Importe"))
    shifted = read.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    return shifted.select(F.concat_ws(":", "doc_id", "ln", "shift").alias("row_id"), "Pdf", (F.col("Pagina") + F.col("shift")).alias("Pagina"), "Codigo", "Descripcion", "Importe")


def audit_line_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.explode_lines(table(spark, sf_dir, "documents"), ["Pdf", "Pagina"], "text")
    return ev.audit_missing(_missing_rows(spark, sf_dir), lines, "row_id", ["Pdf", "Pagina"])


def audit_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_line_score(spark, sf_dir).groupBy("status").agg(F.count("*").alias("rows"))


def ffill_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = rows.fill_forward(_master(spark, sf_dir), ["Pdf"], ["Pagina", *ORDER], ["AlbaranNumero", "SuPedidoCodigo"])
    return filled.select("Pdf", "Pagina", "Linea", "updated_at", "AlbaranNumero", "SuPedidoCodigo", "weak_location")


QUERIES = {f.__name__: f for f in (
    pred_truth_left_join, accuracy_by_supplier, top3_mismatches, cumcount, legacy_missing_extra, missing_lines_anti, extra_lines_anti, by_supplier_counts, sorted_report,
    week_summary, dedup_keep_last, dedup_longest, amount_keys, greedy_match, audit_line_score, audit_status_counts, ffill_location,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _clean(store: str) -> str:
    texts = ", ".join(f"nullif({c}, '') AS {c}" for c in ("AlbaranNumero", "SuPedidoCodigo", "Codigo"))
    numbers = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("CantidadServida", "PrecioUnitario", "Importe"))
    return f"(SELECT * REPLACE ({texts}, {numbers}) FROM {store})"


_R, _M = _clean("lines_run"), _clean("lines_master")
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
_TEXT_OK = "coalesce(upper(trim(r.{f})), '') = coalesce(upper(trim(m.{f})), '')"
_COMPARED = f"""WITH r AS {_R}, m AS {_M},
c AS (SELECT r.Proveedor, r.Pdf, r.Pagina, r.Linea, r.updated_at, {", ".join(f"m.Pdf IS NOT NULL AND {_TEXT_OK.format(f=f)} AS ok_{f}" for f in FIELDS[:3])},
  m.Pdf IS NOT NULL AND coalesce(abs(r.Importe - m.Importe) <= 0.02, r.Importe IS NULL AND m.Importe IS NULL) AS ok_Importe
  FROM r LEFT JOIN m ON upper(trim(m.Proveedor)) = upper(trim(r.Proveedor)) AND upper(trim(m.Pdf)) = upper(trim(r.Pdf)) AND m.Pagina = r.Pagina AND m.Linea = r.Linea),
d AS (SELECT *, ok_AlbaranNumero AND ok_SuPedidoCodigo AND ok_Codigo AND ok_Importe AS ok FROM c)"""
_KEYS = ", ".join(KEY)
_MISSING = "SELECT DISTINCT Proveedor, Pdf, Pagina, Linea FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE y.Proveedor = x.Proveedor AND y.Pdf = x.Pdf AND y.Pagina = x.Pagina AND y.Linea = x.Linea)"
_AMOUNT = "coalesce(printf('%.2f', CAST(round(CAST(Importe AS DECIMAL(24, 8)), 2) AS DOUBLE)), '')"
_AUDIT = f"""WITH {LINES_SQL},
parts AS (SELECT doc_id, ln, Pdf, Pagina, regexp_extract(line, '{ROW}', ['c', 't', 'q', 'p', 'd', 'a']) g FROM lines WHERE regexp_matches(line, '{ROW}')),
rows_ AS (SELECT doc_id || ':' || ln || ':' || s AS row_id, Pdf, Pagina + s AS Pagina, {sql_key("g.c")} c, replace(printf('%.2f', CAST(replace(replace(g.a, '.', ''), ',', '.') AS DOUBLE)), '.', ',') amount,
  list_slice(list_filter(string_split(regexp_replace({sql_fold("g.t")}, '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$')), 1, 5) w
  FROM parts, (VALUES (0), (1)) v(s)),
met AS (SELECT r.row_id, l.Pagina = r.Pagina same, CASE WHEN length(c) > 0 AND contains(regexp_replace({sql_fold("line")}, '[^A-Z0-9]', '', 'g'), c) THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(w, lambda x: contains({sql_fold("line")}, x))) >= 2 THEN 2 ELSE 0 END + CASE WHEN amount <> '' AND contains({sql_fold("line")}, amount) THEN 1 ELSE 0 END score
  FROM rows_ r JOIN lines l ON l.Pdf = r.Pdf),
best AS (SELECT row_id, max(score) FILTER (same) here, max(score) anywhere FROM met GROUP BY row_id),
audit AS (SELECT r.row_id, CASE WHEN here >= 2 THEN 'FOUND_SAME_PAGE' WHEN anywhere >= 2 THEN 'FOUND_OTHER_PAGE' WHEN anywhere IS NULL THEN 'NO_PDF_DUMP' WHEN here IS NULL THEN 'NO_PAGE_DUMP' ELSE 'NOT_FOUND_OCR' END AS status,
  coalesce(anywhere, 0) AS score FROM rows_ r LEFT JOIN best b ON b.row_id = r.row_id)"""

_TIERS = [["Pdf", "Pagina", "Codigo", "amount"], ["AlbaranNumero", "Codigo"], ["Proveedor", "Descripcion"]]


def _greedy() -> str:
    order = "Pdf, Pagina, " + _ORDER + ", SuPedidoCodigo NULLS FIRST"
    ctes = [f"{n}0 AS (SELECT *, row_number() OVER (ORDER BY {order}) id, {_AMOUNT} amount FROM {store})" for n, store in (("r", _R), ("m", _M))]
    for i, key in enumerate(_TIERS):
        usable = " AND ".join(f"coalesce(CAST({k} AS VARCHAR), '') <> ''" for k in key)
        placed = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY Linea, id) p FROM {n}{i} WHERE {u})"
        a, b = (placed.format(k=", ".join(key), n=n, i=i, u=usable) for n in "rm")
        ctes.append(f"t{i} AS (SELECT a.id rid, b.id mid FROM {a} a JOIN {b} b ON a.p = b.p AND {' AND '.join(f'a.{k} = b.{k}' for k in key)})")
        ctes += [f"{n}{i + 1} AS (SELECT * FROM {n}{i} WHERE id NOT IN (SELECT {n}id FROM t{i}))" for n in "rm"]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT {i} AS tier, count(*) AS matches FROM t{i}" for i in range(len(_TIERS)))


_COUNTS = f"""WITH u AS (SELECT Proveedor, 'truth' side FROM lines_master UNION ALL SELECT Proveedor, 'run' FROM lines_run
  UNION ALL SELECT Proveedor, 'missing' FROM ({_MISSING.format(a="lines_master", b="lines_run")}) UNION ALL SELECT Proveedor, 'extra' FROM ({_MISSING.format(a="lines_run", b="lines_master")}))
SELECT Proveedor, count(*) FILTER (side = 'truth') AS truth, count(*) FILTER (side = 'run') AS run, count(*) FILTER (side = 'missing') AS missing, count(*) FILTER (side = 'extra') AS extra FROM u GROUP BY Proveedor"""

SQL = {
    "greedy_match": _greedy(),
    "pred_truth_left_join": _COMPARED + f" SELECT {_KEYS}, updated_at, {', '.join(f'ok_{f}' for f in FIELDS)}, ok FROM d",
    "accuracy_by_supplier": _COMPARED + f" SELECT Proveedor, count(*) AS total, count(*) FILTER (ok) AS ok, {sql_round('count(*) FILTER (ok) * 100 / count(*)', 2)} AS pct FROM d GROUP BY Proveedor",
    "top3_mismatches": _COMPARED
    + f", w AS (SELECT DISTINCT {_KEYS}, updated_at FROM d WHERE NOT ok), n AS (SELECT *, row_number() OVER (PARTITION BY Proveedor ORDER BY Pdf, Pagina, Linea, updated_at) r FROM w) SELECT * FROM n WHERE r <= 3",
    "cumcount": f"WITH r AS {_R} SELECT Proveedor, Pdf, Pagina, Linea, updated_at, row_number() OVER (PARTITION BY Proveedor, Pdf, Pagina ORDER BY {_ORDER}) - 1 AS place FROM r",
    "legacy_missing_extra": f"""WITH r AS (SELECT Proveedor, Pdf, Pagina, row_number() OVER (PARTITION BY Proveedor, Pdf, Pagina ORDER BY {_ORDER}) p FROM {_R}),
m AS (SELECT Proveedor, Pdf, Pagina, row_number() OVER (PARTITION BY Proveedor, Pdf, Pagina ORDER BY {_ORDER}) p FROM {_M}),
j AS (SELECT coalesce(r.Proveedor, m.Proveedor) Proveedor, CASE WHEN m.p IS NULL THEN 'left_only' WHEN r.p IS NULL THEN 'right_only' ELSE 'both' END side
  FROM r FULL JOIN m ON m.Proveedor = r.Proveedor AND m.Pdf = r.Pdf AND m.Pagina = r.Pagina AND m.p = r.p)
SELECT Proveedor, side, count(*) AS rows FROM j GROUP BY Proveedor, side""",
    "missing_lines_anti": _MISSING.format(a="lines_master", b="lines_run"),
    "extra_lines_anti": _MISSING.format(a="lines_run", b="lines_master"),
    "by_supplier_counts": _COUNTS,
    "sorted_report": f"SELECT Proveedor, missing, extra, row_number() OVER (ORDER BY missing DESC, Proveedor) AS place FROM ({_COUNTS})",
    "week_summary": f"""WITH u AS (SELECT regexp_extract(Pdf, '^([A-Z]+_[0-9]+)', 1) w, 'run' side, CAST(Importe AS DECIMAL(18, 4)) a FROM {_R} UNION ALL SELECT regexp_extract(Pdf, '^([A-Z]+_[0-9]+)', 1), 'truth', CAST(Importe AS DECIMAL(18, 4)) FROM {_M}),
g AS (SELECT w, count(*) FILTER (side = 'run') r, count(*) FILTER (side = 'truth') t, coalesce(sum(a) FILTER (side = 'run'), 0) x, coalesce(sum(a) FILTER (side = 'truth'), 0) y FROM u GROUP BY w)
SELECT w AS week, r AS run, t AS truth, r - t AS delta, CAST(round(x - y, 2) AS DOUBLE) AS amount_delta FROM g""",
    "dedup_keep_last": f"""WITH m AS {_M}, s AS (SELECT *, concat_ws('|', {", ".join(f"coalesce(upper(trim(CAST({c} AS VARCHAR))), '')" for c in ("Proveedor", "Pdf", "Pagina", "AlbaranNumero", "Codigo"))}, {_AMOUNT}) sig FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY updated_at DESC, Linea DESC) r FROM s WHERE Importe IS NOT NULL)
SELECT Proveedor, Pdf, Pagina, Linea, updated_at, Codigo, round(Importe, 2) AS Importe FROM k WHERE r = 1
UNION ALL SELECT Proveedor, Pdf, Pagina, Linea, updated_at, Codigo, NULL FROM s WHERE Importe IS NULL""",
    "dedup_longest": f"""SELECT AlbaranNumero, Codigo, {_AMOUNT} AS amount, line_id FROM detail_lines WHERE AlbaranNumero IS NOT NULL AND Importe IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY AlbaranNumero, Codigo, {_AMOUNT} ORDER BY length(coalesce(Descripcion, '')) DESC, line_id) = 1
UNION ALL SELECT AlbaranNumero, Codigo, {_AMOUNT}, line_id FROM detail_lines WHERE AlbaranNumero IS NULL OR Importe IS NULL""",
    "amount_keys": f"WITH r AS {_R} SELECT {_KEYS}, updated_at, {_AMOUNT} AS amount, coalesce(printf('%.3f', CAST(round(CAST(CantidadServida AS DECIMAL(24, 8)), 3) AS DOUBLE)), '') AS quantity FROM r",
    "audit_line_score": _AUDIT + " SELECT row_id, status, score FROM audit",
    "audit_status_counts": _AUDIT + " SELECT status, count(*) AS rows FROM audit GROUP BY status",
    "ffill_location": f"""WITH m AS {_M} SELECT Pdf, Pagina, Linea, updated_at, last_value(AlbaranNumero IGNORE NULLS) OVER w AS AlbaranNumero, last_value(SuPedidoCodigo IGNORE NULLS) OVER w AS SuPedidoCodigo,
  AlbaranNumero IS NULL OR SuPedidoCodigo IS NULL AS weak_location FROM m WINDOW w AS (PARTITION BY Pdf ORDER BY Pagina, {_ORDER} ROWS UNBOUNDED PRECEDING)""",
}
