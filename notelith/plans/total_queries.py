"""Totals, suppliers' figures, header repair, numeric repair and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelith.functions import numeric
from notelith.operators import headers, numeric_audit, rows, totals
from notelith.plans.scalar_queries import sql_date, sql_key, sql_round, sql_spaces
from notelith.runtime import table

PHONES = "10[0-9]"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "detail_lines")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "note_meta")


def totals_by_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.note_totals(_meta(spark, sf_dir), ["Pdf", "Pagina"])


def totals_by_note_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.note_totals(_meta(spark, sf_dir), ["Pdf", "Pagina"], ["Proveedor", "Parser", "AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"])


def lines_against_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line sums of each note against the footer of its pages; notes without lines or without a footer too, and those of no number."""
    key = ["Proveedor", "AlbaranNumero"]
    sums = totals.line_totals(_lines(spark, sf_dir), key).withColumn("net", F.lit(None).cast("double"))
    notes = _meta(spark, sf_dir).groupBy(*key).agg(F.max("NetoComercialPie").alias("net")).withColumns({"line_sum": F.lit(None).cast("double"), "lines": F.lit(0).cast("long")})
    # Grouped, not joined: null keys meet too, and both sides are combined before the shuffle.
    both = sums.unionByName(notes).groupBy(*key).agg(F.max("line_sum").alias("line_sum"), F.sum("lines").alias("lines"), F.max("net").alias("net"))
    gap = F.round(totals.money("line_sum") - totals.money("net"), 2).cast("double")
    return both.select(*key, F.round("line_sum", 4).alias("line_sum"), "lines", "net", gap.alias("gap"))


def supplier_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.supplier_figures(_lines(spark, sf_dir), ["Proveedor"])


def run_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.supplier_figures(_lines(spark, sf_dir).withColumn("run", F.lit("all")), ["run"])


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the notes with and without lines."""
    pages = _meta(spark, sf_dir).select("Pdf", "Pagina").distinct()
    with_lines = _lines(spark, sf_dir).groupBy("Pdf", "Pagina").agg(F.count("*").alias("items"))
    joined = pages.join(with_lines, ["Pdf", "Pagina"], "left")
    return joined.agg(F.count("*").alias("pages"), F.count_if(F.col("items") > 0).alias("processed"), F.count_if(F.col("items").isNull()).alias("failed"))


def distinct_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).agg(F.count_distinct(F.struct("Proveedor", "AlbaranNumero")).alias("notes"), F.count_distinct("Codigo").alias("codes"))


def dominant_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headers.dominant_prefix(headers.keyed(_lines(spark, sf_dir)))
    return found.select(F.col("_prov").alias("supplier"), "dominant", F.col("dominant_hits").alias("hits"))


def majority_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = headers.best_notes(headers.keyed(_lines(spark, sf_dir)), PHONES)
    return found.select(F.col("_prov").alias("supplier"), F.col("_sup").alias("order_code"), F.col("best").alias("note"))


def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.repair(_lines(spark, sf_dir), "line_id", PHONES)


def numeric_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = numeric_audit.repaired(*(F.col(c) for c in ("CantidadServida", "PrecioUnitario", "DescuentoPct", "Importe", "UnidadesPor")))
    fixed = _lines(spark, sf_dir).select("line_id", r.alias("r"))
    shown = lambda c: F.round(F.col(c).cast("decimal(24,8)"), 3).cast("double")
    return fixed.select("line_id", *(shown(f"r.{c}").alias(n) for c, n in (("q", "quantity"), ("p", "price"), ("d", "discount"), ("a", "amount"))))


def numeric_repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each supplier the repair touched."""
    r = numeric_audit.repaired(*(F.col(c) for c in ("CantidadServida", "PrecioUnitario", "DescuentoPct", "Importe", "UnidadesPor")))
    changed = ~(F.col("r.q").eqNullSafe(F.col("CantidadServida")) & F.col("r.p").eqNullSafe(F.col("PrecioUnitario")))
    fixed = _lines(spark, sf_dir).withColumn("r", r)
    return fixed.groupBy("Proveedor").agg(F.count_if(changed).alias("changed"), F.count("*").alias("lines"))


def numeric_audit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = numeric.effective_quantity("CantidadServida", "CantidadPedida", "CantidadPendiente")
    return numeric_audit.with_audit(_lines(spark, sf_dir), quantity).select("line_id", "audit")


def trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back out of the stored JSON."""
    quantity = numeric.effective_quantity("CantidadServida", "CantidadPedida", "CantidadPendiente")
    tokens = numeric_audit.audit_tokens(quantity, F.col("PrecioUnitario"), F.col("DescuentoPct"), F.col("Importe"))
    traced = numeric_audit.trace(quantity, F.col("PrecioUnitario"), F.col("DescuentoPct"), F.col("Importe"), F.col("OcrStage"), tokens)
    stored = _lines(spark, sf_dir).select("line_id", F.to_json(traced, {"ignoreNullFields": "false"}).alias("j"))
    return stored.select("line_id", F.get_json_object("j", "$.importe.status").alias("amount_status"), F.get_json_object("j", "$.precio.source").alias("source"), F.get_json_object("j", "$.descuento.status").alias("discount_status"))


def footer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["Proveedor", "AlbaranNumero"]
    found = totals.reconcile_last_line(_lines(spark, sf_dir), _meta(spark, sf_dir), key, ["Pagina", "line_id"])
    return found.select("line_id", F.round("adjusted", 2).alias("adjusted"))


def sole_line_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.sole_line_amount(_lines(spark, sf_dir), _meta(spark, sf_dir), ["Proveedor", "AlbaranNumero"]).select("line_id", "amount")


def stamp_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"]
    stamped = rows.stamp(_lines(spark, sf_dir), _meta(spark, sf_dir), ["Pdf", "Pagina"], fields)
    return stamped.select("line_id", *fields, rows.source_label("OcrStage").alias("source"))


def code_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.placeholder_codes(_lines(spark, sf_dir), ["Pdf", "Pagina", "line_id"]).select("line_id", "idx", "Codigo", "ParseWarn")


def code_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that stand before the description: put there, then found again."""
    there = F.when(F.col("Codigo").rlike("^[A-Z0-9]{6,}$"), F.concat("Codigo", F.lit(" - "), "Descripcion")).otherwise(F.col("Descripcion"))
    lines = _lines(spark, sf_dir).withColumns({"Descripcion": there, "Codigo": F.lit("")})
    return lines.withColumns(rows.recover_code("Codigo", "Descripcion")).select("line_id", "Codigo", F.md5(F.col("Descripcion").cast("binary")).alias("rest"))


def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _lines(spark, sf_dir).drop("CantidadPendiente", "OcrPipeline")
    return rows.canonical(raw, ["line_id"]).select("line_id", "AlbaranNumero", "Codigo", "OcrPipeline", "CantidadPendiente", "Importe", "Pagina")


def embedded_row_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.explode_embedded(_lines(spark, sf_dir).select("line_id", "Descripcion"), "Descripcion", r"\(([0-9]+) (uds)\)", ["pack", "unit"])
    return found.select("line_id", "embedded", "pack", "unit")


def known_value_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "articles").select("Codigo", "PrecioUnitario")
    lines = _lines(spark, sf_dir).select("line_id", "Codigo", "PrecioUnitario")
    return rows.fill_known(lines, known, ["Codigo"], ["PrecioUnitario"]).select("line_id", "PrecioUnitario")


def stage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one page read by two stages, merged place by place."""
    cols = ["Pdf", "Pagina", "Parser", "line_id", "OcrStage", "AlbaranNumero", "Codigo", "Importe", "ParseWarn"]
    lines = _lines(spark, sf_dir).select(*cols)
    merged = rows.merge_stages(lines, ["Pdf", "Pagina", "Parser"], ["line_id"], "OcrStage", ["AlbaranNumero"])
    return merged.select("Pdf", "Pagina", "line_id", "AlbaranNumero", "Codigo", "Importe", "ParseWarn")


def top_lines_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest amounts of each supplier: a top-k report. Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("Proveedor").orderBy(F.col("Importe").desc(), F.col("line_id"))
    best = _lines(spark, sf_dir).where("Importe is not null").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return best.select("Proveedor", "line_id", "Importe", "r")


QUERIES = {f.__name__: f for f in (
    totals_by_note, totals_by_note_parser, lines_against_footer, supplier_kpis, run_kpis, page_counts, distinct_tuples, dominant_prefix, majority_note,
    header_repair, numeric_repair, numeric_repair_counts, numeric_audit_tokens, trace_json, footer_reconcile, sole_line_amount, stamp_sources,
    code_placeholder, code_recovery, canonical_projection, embedded_row_expansion, known_value_fill, stage_merge, top_lines_by_supplier,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _totals(keys: str) -> str:
    d = "DECIMAL(18, 4)"
    return f"""WITH t AS (SELECT {keys}, sum(CAST(SumaImportesLineas AS {d})) s, arg_max(NetoComercialPie, (Pdf, Pagina, NetoComercialPie)) FILTER (NetoComercialPie IS NOT NULL) n,
  arg_max(TotalAlbaranPie, (Pdf, Pagina, TotalAlbaranPie)) FILTER (TotalAlbaranPie IS NOT NULL) t FROM note_meta GROUP BY {keys})
SELECT {keys}, CAST(s AS DOUBLE) AS SumaImportesLineas, n AS NetoComercialPie, t AS TotalAlbaranPie, CAST(round(s - CAST(n AS {d}), 2) AS DOUBLE) AS Dif_Suma_vs_Neto,
  CAST(round(s - CAST(t AS {d}), 2) AS DOUBLE) AS Dif_Suma_vs_Total FROM t"""


def _kpis(by: str, source: str) -> str:
    return f"""WITH l AS (SELECT *, CAST(try_strptime({sql_date("FechaAlbaran", "-/.")}, '%d/%m/%Y') AS DATE) AS tag_day FROM {source}),
c AS (SELECT {by}, Parser, count(*) n FROM l WHERE Parser IS NOT NULL GROUP BY ALL),
p AS (SELECT {by} AS p_by, Parser AS p_parser FROM c QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, Parser) = 1)
SELECT l.{by}, any_value(p_parser) AS Parser, count(DISTINCT Pdf) AS pdfs, count(DISTINCT (Pdf, Pagina)) AS pages, count(DISTINCT (Proveedor, AlbaranNumero)) AS notes, count(*) AS lines,
  CAST(coalesce(sum(CAST(Importe AS DECIMAL(18, 4))), 0) AS DOUBLE) AS amount, count(*) FILTER (trim(ParseWarn) <> '') AS warned,
  strftime(min(tag_day), '%d/%m/%Y') AS first_day, strftime(max(tag_day), '%d/%m/%Y') AS last_day FROM l LEFT JOIN p ON p_by = l.{by} GROUP BY l.{by}"""


_KEYED = f"""keyed AS (SELECT *, nullif({sql_key("Proveedor")}, '') prov, nullif({sql_key("SuPedidoCodigo")}, '') sup,
  nullif(upper({sql_spaces("coalesce(AlbaranNumero, '')")}), '') alb FROM detail_lines),
digits AS (SELECT *, regexp_replace(coalesce(alb, ''), '[^0-9]', '', 'g') dig FROM keyed),
marked AS (SELECT *, CASE WHEN length(dig) >= 2 THEN substr(dig, 1, 2) END prefix, length(dig) = 9 AND regexp_matches(dig, '^{PHONES}') phone FROM digits),
hits AS (SELECT prov, prefix, count(*) hits FROM marked WHERE prov IS NOT NULL AND prefix IS NOT NULL GROUP BY ALL),
dominant AS (SELECT prov, prefix dominant, hits dominant_hits FROM hits QUALIFY row_number() OVER (PARTITION BY prov ORDER BY hits DESC, prefix) = 1),
counted AS (SELECT m.prov, sup, alb, any_value(m.prefix) prefix, any_value(phone) phone, any_value(dig) dig, count(*) n FROM marked m
  WHERE m.prov IS NOT NULL AND sup IS NOT NULL AND alb IS NOT NULL GROUP BY m.prov, sup, alb),
ranked AS (SELECT c.*, row_number() OVER w r, lead(n) OVER w next_n, lead(phone) OVER w next_phone FROM counted c LEFT JOIN hits h ON h.prov = c.prov AND h.prefix = c.prefix
  WINDOW w AS (PARTITION BY c.prov, sup ORDER BY phone, n DESC, coalesce(hits, 0) DESC, length(dig) DESC, alb)),
notes AS (SELECT prov, sup, alb target, n target_n, prefix target_prefix, phone target_phone FROM ranked
  WHERE r = 1 AND (next_n IS NULL OR n > next_n OR (n = next_n AND NOT phone AND next_phone)))"""

_REPAIR = f"""WITH {_KEYED},
o AS (SELECT prov, alb, sup, row_number() OVER w r, n, lead(n) OVER w next_n FROM counted WINDOW w AS (PARTITION BY prov, alb ORDER BY n DESC, length(sup) DESC, sup)),
orders AS (SELECT prov, alb, sup best FROM o WHERE r = 1 AND (next_n IS NULL OR n > next_n)),
j AS (SELECT m.*, t.target, t.target_n, t.target_prefix, t.target_phone, coalesce(c.n, 0) own_n, d.dominant, coalesce(d.dominant_hits, 0) dominant_hits, coalesce(h.hits, 0) own_hits, coalesce(g.hits, 0) target_hits
  FROM marked m LEFT JOIN notes t ON t.prov = m.prov AND t.sup = m.sup LEFT JOIN counted c ON c.prov = m.prov AND c.sup = m.sup AND c.alb = m.alb
  LEFT JOIN dominant d ON d.prov = m.prov LEFT JOIN hits h ON h.prov = m.prov AND h.prefix = m.prefix LEFT JOIN hits g ON g.prov = m.prov AND g.prefix = t.target_prefix),
k AS (SELECT *, coalesce(target IS NOT NULL AND target IS DISTINCT FROM alb
  AND (contains(coalesce(ParseWarn, ''), 'compact_rescue') OR length(dig) < 7 OR phone OR coalesce(dominant_hits >= 3 AND prefix IS NOT NULL AND prefix <> dominant AND own_hits <= 1, FALSE))
  AND (target_n > own_n OR (target_n = own_n AND phone AND NOT target_phone) OR (target_n >= own_n AND target_hits > own_hits AND (dominant IS NULL OR target_prefix = dominant))), FALSE) take FROM j),
n AS (SELECT *, CASE WHEN take THEN target ELSE alb END new_alb FROM k)
SELECT line_id, CASE WHEN take THEN target ELSE AlbaranNumero END AS AlbaranNumero, CASE WHEN n.sup IS NULL AND best IS NOT NULL THEN best ELSE SuPedidoCodigo END AS SuPedidoCodigo,
  take AS note_repaired, n.sup IS NULL AND best IS NOT NULL AS order_imputed FROM n LEFT JOIN orders o ON o.prov = n.prov AND o.alb = n.new_alb"""


def _some(*xs: str) -> str:
    return " AND ".join(f"{x} IS NOT NULL AND {x} <> 0" for x in xs)


def _dec(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {n}) AS DOUBLE)"


def _div(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


_F = "((100 - coalesce(d, 0)) / 100)"
_STEPS = [
    {"p": f"CASE WHEN NOT coalesce({_some('p')}, FALSE) AND {_some('q', 'a')} THEN a / q ELSE p END"},
    {"q": f"CASE WHEN NOT coalesce({_some('q')}, FALSE) AND {_some('p', 'a')} THEN a / p ELSE q END"},
    {"q": f"CASE WHEN {_some('q', 'p', 'a')} AND q > 10 AND coalesce(d < 5, TRUE) AND abs(a - p) <= 0.1 * greatest(1, a) THEN {_dec('a / p', 2)} ELSE q END"},
    {
        "q": f"CASE WHEN {_some('q', 'p', 'a')} AND q > 1 AND p * {_F} > 0 AND abs(a - p * {_F}) <= 0.1 * greatest(a, 1) THEN 1.0 ELSE q END",
        "a": f"CASE WHEN {_some('q', 'p', 'a')} AND q > 1 AND p * {_F} > 0 AND abs(a - p * {_F}) <= 0.1 * greatest(a, 1) THEN {_dec(f'1.0 / u * p * {_F}', 2)} ELSE a END",
    },
    {"q": f"CASE WHEN {_some('q', 'p', 'a')} AND q / u * p * {_F} > 0 AND a > 0 AND q > 50 AND p > 1 AND a < q / u * p * {_F} * 0.2 THEN {_dec(_div('a', f'(p * {_F})') + ' * u', 2)} ELSE q END"},
    {
        "q": f"CASE WHEN {_some('q', 'p', 'a')} AND p * {_F} > 0 AND q / u * (p * {_F}) > a * 5 AND {_div('a', f'(p * {_F})')} * u > 0 THEN {_dec(_div('a', f'(p * {_F})') + ' * u', 2)} ELSE q END",
        "a": f"CASE WHEN {_some('q', 'p', 'a')} AND p * {_F} > 0 AND q / u * (p * {_F}) > a * 5 AND {_div('a', f'(p * {_F})')} * u > 0 THEN {_dec(_dec(_div('a', f'(p * {_F})') + ' * u', 2) + f' / u * p * {_F}', 2)} ELSE a END",
    },
    {
        "p": f"CASE WHEN {_some('q', 'a', 'p')} AND d IS NOT NULL AND (100 - d) / 100 > 0 AND {_div('a * u', '(q * ((100 - d) / 100))')} > 0 AND abs({_div('a * u', '(q * ((100 - d) / 100))')} - p) / greatest({_div('a * u', '(q * ((100 - d) / 100))')}, p, 1e-6) > 0.05 THEN {_dec(_div('a * u', '(q * ((100 - d) / 100))'), 4)} ELSE p END"
    },
    {"d": f"CASE WHEN {_some('q', 'p', 'a')} AND coalesce(d < 0 OR d > 80, TRUE) AND q * p > 0 AND 100 * (1 - {_div('a', '(q * p)')}) BETWEEN 0 AND 80 THEN {_dec('100 * (1 - ' + _div('a', '(q * p)') + ')', 2)} ELSE d END"},
    {
        "p": f"CASE WHEN {_some('q', 'a', 'p')} AND p > 0 AND {_div('a', f'(q * {_F})')} > 0 AND p < {_div('a', f'(q * {_F})')} * 0.5 AND abs(a - q * p * {_F}) > 0.05 * greatest(1, a) AND coalesce(d <= 60, TRUE) THEN {_div('a', f'(q * {_F})')} ELSE p END"
    },
    {"a": f"CASE WHEN {_some('q', 'p')} AND a IS NULL THEN {_dec(f'q / u * p * {_F}', 2)} ELSE a END"},
]


def _repair_sql() -> str:
    start = "s0 AS (SELECT line_id, Proveedor, CantidadServida q, PrecioUnitario p, Importe a, DescuentoPct d, CASE WHEN coalesce(UnidadesPor, 0) = 0 THEN 1.0 ELSE UnidadesPor END u, CantidadServida q0, PrecioUnitario p0, Importe a0, DescuentoPct d0 FROM detail_lines)"
    ctes = [start]
    for i, step in enumerate(_STEPS):
        ctes.append(f"s{i + 1} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in step.items())}) FROM s{i})")
    expected = "(q0 / u * p0 * ((100 - coalesce(d0, 0)) / 100))"
    fits = f"coalesce(u > 1 AND {_some('q0', 'p0', 'a0')} AND {expected} <> 0 AND abs({expected} - a0) <= greatest(0.05, 0.05 * abs({expected})), FALSE)"
    ctes.append(f"fixed AS (SELECT line_id, Proveedor, q0, p0, CASE WHEN {fits} THEN q0 ELSE q END q, CASE WHEN {fits} THEN p0 ELSE p END p, CASE WHEN {fits} THEN d0 ELSE d END d, CASE WHEN {fits} THEN a0 ELSE coalesce(a0, a) END a FROM s{len(_STEPS)})")
    return "WITH " + ",\n".join(ctes)


_Q = "CASE WHEN CantidadServida > 0 THEN CantidadServida WHEN CantidadPedida > 0 THEN CantidadPedida WHEN CantidadPendiente > 0 THEN CantidadPendiente ELSE 1 END"
_AUDIT = f"""WITH q AS (SELECT *, {_Q} q, PrecioUnitario p, DescuentoPct d, Importe a FROM detail_lines),
e AS (SELECT *, {_dec("p * q * (100 - least(greatest(d, 0), 100)) / 100", 2)} expected, {_dec("least(greatest(100 - a / nullif(p * q, 0) * 100, 0), 100)", 2)} implied, coalesce({_some("p", "q")}, FALSE) usable FROM q),
t AS (SELECT *, list_filter([CASE WHEN a < 0 THEN 'importe_negativo' END, CASE WHEN d < 0 THEN 'discount_negative' END, CASE WHEN d >= 100 THEN 'discount_overflow' END, CASE WHEN d >= 100 THEN 'discount_recheck' END,
  CASE WHEN usable AND d IS NOT NULL AND a IS NULL THEN 'importe_hint=' || printf('%.2f', expected) END, CASE WHEN usable AND d BETWEEN 0 AND 99.999999999 AND abs(expected - a) > 0.05 THEN 'importe_formula' END,
  CASE WHEN usable AND d IS NULL AND a IS NOT NULL THEN 'discount_hint=' || printf('%.2f', implied) END], lambda x: x IS NOT NULL) tokens FROM e)"""

SQL = {
    "totals_by_note": _totals("Proveedor, AlbaranNumero, FechaAlbaran, SuPedidoCodigo"),
    "totals_by_note_parser": _totals("Proveedor, Parser, AlbaranNumero, FechaAlbaran, SuPedidoCodigo"),
    "lines_against_footer": """WITH l AS (SELECT Proveedor, AlbaranNumero, sum(CAST(Importe AS DECIMAL(18, 4))) s, count(*) n FROM detail_lines GROUP BY ALL),
m AS (SELECT Proveedor, AlbaranNumero, max(NetoComercialPie) net FROM note_meta GROUP BY ALL)
SELECT coalesce(l.Proveedor, m.Proveedor) AS Proveedor, coalesce(l.AlbaranNumero, m.AlbaranNumero) AS AlbaranNumero, round(CAST(s AS DOUBLE), 4) AS line_sum, coalesce(n, 0) AS lines, net,
  CAST(round(s - CAST(net AS DECIMAL(18, 4)), 2) AS DOUBLE) AS gap
FROM l FULL JOIN m ON m.Proveedor IS NOT DISTINCT FROM l.Proveedor AND m.AlbaranNumero IS NOT DISTINCT FROM l.AlbaranNumero""",
    "supplier_kpis": _kpis("Proveedor", "detail_lines"),
    "run_kpis": _kpis("run", "(SELECT *, 'all' AS run FROM detail_lines)"),
    "page_counts": """WITH p AS (SELECT DISTINCT Pdf, Pagina FROM note_meta), i AS (SELECT Pdf, Pagina, count(*) n FROM detail_lines GROUP BY ALL)
SELECT count(*) AS pages, count(*) FILTER (n > 0) AS processed, count(*) FILTER (n IS NULL) AS failed FROM p LEFT JOIN i ON i.Pdf = p.Pdf AND i.Pagina = p.Pagina""",
    "distinct_tuples": "SELECT count(DISTINCT (Proveedor, AlbaranNumero)) AS notes, count(DISTINCT Codigo) AS codes FROM detail_lines",
    "dominant_prefix": f"WITH {_KEYED} SELECT prov AS supplier, dominant, dominant_hits AS hits FROM dominant",
    "majority_note": f"WITH {_KEYED} SELECT prov AS supplier, sup AS order_code, target AS note FROM notes",
    "header_repair": _REPAIR,
    "numeric_repair": _repair_sql() + " SELECT line_id, " + ", ".join(f"{sql_round(x, 3)} AS {n}" for x, n in (("q", "quantity"), ("p", "price"), ("d", "discount"), ("a", "amount"))) + " FROM fixed",
    "numeric_repair_counts": _repair_sql() + " SELECT Proveedor, count(*) FILTER (NOT (q IS NOT DISTINCT FROM q0 AND p IS NOT DISTINCT FROM p0)) AS changed, count(*) AS lines FROM fixed GROUP BY Proveedor",
    "numeric_audit_tokens": _AUDIT
    + """, c AS (SELECT line_id, list_concat(list_filter(regexp_split_to_array(coalesce(ParseWarn, ''), '[;|]'), lambda x: x <> ''), tokens) l FROM t)
SELECT line_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';'), '') AS audit FROM c""",
    "trace_json": _AUDIT
    + """ SELECT line_id, CASE WHEN a < 0 THEN 'negative' WHEN list_contains(tokens, 'importe_formula') THEN 'mismatch' WHEN a IS NULL THEN 'missing' ELSE 'ok' END AS amount_status,
  CASE WHEN contains(lower(coalesce(OcrStage, '')), 'ocr') THEN 'ocr' ELSE 'base' END AS source,
  CASE WHEN d < 0 THEN 'negative' WHEN d >= 100 THEN 'overflow' WHEN d IS NULL THEN 'missing' ELSE 'ok' END AS discount_status FROM t""",
    "footer_reconcile": """WITH m AS (SELECT Proveedor, AlbaranNumero, max(NetoComercialPie) f FROM note_meta GROUP BY ALL),
s AS (SELECT Proveedor, AlbaranNumero, sum(CAST(Importe AS DECIMAL(18, 4))) s, max((Pagina, line_id)) last FROM detail_lines GROUP BY ALL),
g AS (SELECT s.*, round(CAST(f AS DECIMAL(18, 4)) - s, 2) gap, f FROM s JOIN m ON m.Proveedor = s.Proveedor AND m.AlbaranNumero = s.AlbaranNumero)
SELECT line_id, CASE WHEN g.gap <> 0 AND abs(g.gap) <= greatest(20, abs(f) * 0.25) AND (l.Pagina, line_id) = last THEN CAST(round(CAST(Importe AS DECIMAL(18, 4)) + g.gap, 2) AS DOUBLE)
  ELSE CAST(round(CAST(Importe AS DECIMAL(18, 4)), 2) AS DOUBLE) END AS adjusted
FROM detail_lines l LEFT JOIN g ON g.Proveedor = l.Proveedor AND g.AlbaranNumero = l.AlbaranNumero""",
    "sole_line_amount": """WITH m AS (SELECT Proveedor, AlbaranNumero, max(NetoComercialPie) f FROM note_meta GROUP BY ALL),
n AS (SELECT Proveedor, AlbaranNumero, count(*) n FROM detail_lines GROUP BY ALL)
SELECT line_id, CASE WHEN n = 1 AND Importe IS NULL THEN f ELSE Importe END AS amount FROM detail_lines l LEFT JOIN n ON n.Proveedor = l.Proveedor AND n.AlbaranNumero = l.AlbaranNumero
LEFT JOIN m ON m.Proveedor = l.Proveedor AND m.AlbaranNumero = l.AlbaranNumero""",
    "stamp_sources": "WITH m AS (SELECT Pdf, Pagina, "
    + ", ".join(f"min({f}) FILTER (upper(trim({f})) NOT IN ('', 'NAN', 'NONE', 'NULL', 'NAT')) m_{f}" for f in ("AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"))
    + " FROM note_meta GROUP BY ALL) SELECT line_id, "
    + ", ".join(f"CASE WHEN coalesce(upper(trim({f})) IN ('', 'NAN', 'NONE', 'NULL', 'NAT'), TRUE) THEN m_{f} ELSE {f} END AS {f}" for f in ("AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"))
    + ", CASE WHEN contains(lower(coalesce(OcrStage, '')), 'ocr') THEN 'ocr' ELSE 'base' END AS source FROM detail_lines l LEFT JOIN m ON m.Pdf = l.Pdf AND m.Pagina = l.Pagina",
    "code_placeholder": f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY Pdf, Pagina, line_id) idx, coalesce(upper(trim(Codigo)) IN ('', 'NAN', 'NONE', 'NULL', 'NAT'), TRUE) AND CantidadServida IS NOT NULL AND Importe IS NOT NULL lacks FROM detail_lines)
SELECT line_id, idx, CASE WHEN lacks THEN 'UNK_' || {sql_key("translate(Proveedor, 'ÁÉÍÓÚÜÑáéíóúüñ', 'AEIOUUNaeiouun')")} || '_' || CASE WHEN idx > 9999 THEN CAST(idx AS VARCHAR) ELSE lpad(CAST(idx AS VARCHAR), 4, '0') END ELSE Codigo END AS Codigo,
  CASE WHEN lacks THEN CASE WHEN coalesce(ParseWarn, '') = '' THEN 'missing_code_placeholder' ELSE ParseWarn || '|missing_code_placeholder' END ELSE ParseWarn END AS ParseWarn FROM i""",
    "code_recovery": """WITH d AS (SELECT line_id, CASE WHEN regexp_matches(Codigo, '^[A-Z0-9]{6,}$') THEN Codigo || ' - ' || Descripcion ELSE Descripcion END t FROM detail_lines),
x AS (SELECT line_id, t, regexp_extract(coalesce(t, ''), '^\\s*([A-Z0-9]{6,})([^A-Za-z0-9_\\p{L}\\p{M}\\p{N}]|$)', 1) c FROM d)
SELECT line_id, c AS Codigo, md5(CASE WHEN c <> '' THEN regexp_replace(regexp_replace(t, '^\\s*[A-Z0-9]{6,}', ''), '^[ -]+', '') ELSE t END) AS rest FROM x""",
    "canonical_projection": "SELECT line_id, "
    + ", ".join(f"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+$', '') AS {c}".replace("{{", "{").replace("}}", "}") for c in ("AlbaranNumero", "Codigo"))
    + ", '' AS OcrPipeline, CAST(NULL AS DOUBLE) AS CantidadPendiente, Importe, Pagina FROM detail_lines",
    "embedded_row_expansion": """SELECT line_id, FALSE AS embedded, CAST(NULL AS VARCHAR) AS pack, CAST(NULL AS VARCHAR) AS unit FROM detail_lines
UNION ALL SELECT line_id, TRUE, regexp_extract(Descripcion, '\\(([0-9]+) (uds)\\)', 1), 'uds' FROM detail_lines WHERE regexp_matches(Descripcion, '\\(([0-9]+) (uds)\\)')""",
    "known_value_fill": """WITH k AS (SELECT Codigo, min(PrecioUnitario) p FROM articles GROUP BY Codigo)
SELECT line_id, coalesce(PrecioUnitario, p) AS PrecioUnitario FROM detail_lines l LEFT JOIN k ON k.Codigo = l.Codigo""",
    "stage_merge": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY Pdf, Pagina, Parser, OcrStage ORDER BY line_id) place FROM detail_lines)
SELECT Pdf, Pagina, arg_min(line_id, OcrStage = 'base') AS line_id,
  arg_min(AlbaranNumero, OcrStage <> 'base') FILTER (trim(AlbaranNumero) <> '') AS AlbaranNumero, arg_min(Codigo, OcrStage = 'base') FILTER (trim(Codigo) <> '') AS Codigo,
  arg_min(Importe, OcrStage = 'base') FILTER (Importe IS NOT NULL) AS Importe, arg_min(ParseWarn, OcrStage = 'base') FILTER (ParseWarn IS NOT NULL) AS ParseWarn FROM p GROUP BY Pdf, Pagina, Parser, place""",
    "top_lines_by_supplier": """SELECT Proveedor, line_id, Importe, row_number() OVER (PARTITION BY Proveedor ORDER BY Importe DESC, line_id) AS r FROM detail_lines WHERE Importe IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY Proveedor ORDER BY Importe DESC, line_id) <= 3""",
}
