"""Queries over the stores of evaluation lines and the quantity records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.operators import units
from notelith.operators.copydiff import diff_copies
from notelith.runtime import durable, table

COMPARED = ["AlbaranNumero", "Codigo", "Importe", "CantidadServida"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(
        table(spark, sf_dir, "lines_run"),
        table(spark, sf_dir, "lines_master"),
        keys=["Pdf", "Pagina", "Linea"],
        fields=COMPARED,
        version="updated_at",
        missing_left="missing_in_run",
        missing_right="missing_in_master",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.equal_pairs(durable(units.common_units(table(spark, sf_dir, "qty_records"), of_line=False)))


def p2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.common_units(table(spark, sf_dir, "qty_records"), of_line=False)
    return found.select("rec_id", F.round("quantity", 6).alias("quantity"), F.round("price", 8).alias("price"))


QUERIES = {"p2_found": p2_found, "p2_units": p2_units, "p4_found": p4_found}

_STATE = """
SELECT Pdf, Pagina, Linea, nullif(AlbaranNumero, '') AlbaranNumero, nullif(Codigo, '') Codigo,
       CASE WHEN isnan(Importe) THEN NULL ELSE Importe END Importe,
       CASE WHEN isnan(CantidadServida) THEN NULL ELSE CantidadServida END CantidadServida, TRUE AS there
FROM {store} QUALIFY row_number() OVER (PARTITION BY Pdf, Pagina, Linea ORDER BY updated_at DESC NULLS LAST) = 1
"""

_JOINED = f"""
WITH r AS ({_STATE.format(store="lines_run")}), m AS ({_STATE.format(store="lines_master")}),
j AS (SELECT coalesce(r.Pdf, m.Pdf) Pdf, coalesce(r.Pagina, m.Pagina) Pagina, coalesce(r.Linea, m.Linea) Linea,
             r.there r_there, m.there m_there, r.AlbaranNumero ra, m.AlbaranNumero ma, r.Codigo rc, m.Codigo mc,
             r.Importe ri, m.Importe mi, r.CantidadServida rq, m.CantidadServida mq
      FROM r FULL JOIN m ON r.Pdf = m.Pdf AND r.Pagina = m.Pagina AND r.Linea = m.Linea),
both_there AS (SELECT * FROM j WHERE r_there AND m_there)
"""

_UNITS = ", ".join(f"('{n}', {f!r})" for _, f, names in units.UNITS for n in names.split())
_PER = ", ".join(f"('{k}', {v!r})" for k, v in units.PER_LETTERS.items())

def _number_sql(x: str) -> str:
    return (
        f"try_cast(CASE WHEN regexp_matches({x}, '[.,]') THEN regexp_replace(regexp_extract({x}, '^(.*)[.,]', 1), '[.,]', '', 'g')"
        f" || '.' || regexp_extract({x}, '[.,]([0-9]*)$', 1) ELSE {x} END AS DOUBLE)"
    )


_PRICE_SQL = units._PRICE.replace("(?i:", "(?:").replace("euros?|eur", "euros?|eur|EUR")
_P2 = rf"""
WITH u(name, factor) AS (VALUES {_UNITS}), per(letter, n) AS (VALUES {_PER}),
s AS (SELECT rec_id, AlbaranNumero note, Codigo code, regexp_extract(CantidadServida, '{units._NUMBER}', 1) q, regexp_extract(CantidadServida, '{units._NUMBER}', 2) uq,
  UnidadMedida um, regexp_extract(Descripcion, '{units._SUFFIX}', 1) ud, regexp_extract(PrecioUnitario, '{_PRICE_SQL}', 1) p,
  lower(regexp_extract(PrecioUnitario, '{_PRICE_SQL}', 2)) cur, regexp_extract(PrecioUnitario, '{_PRICE_SQL}', 3) pn,
  regexp_extract(PrecioUnitario, '{_PRICE_SQL}', 4) upr, upper(regexp_replace(UnidadesPor, '[\s/]', '', 'g')) pf FROM qty_records),
m AS (SELECT rec_id, where_, regexp_replace(strip_accents(lower(trim(said))), '\.+$', '') t FROM (
  SELECT rec_id, 1 where_, uq said FROM s UNION ALL SELECT rec_id, 2, um FROM s UNION ALL SELECT rec_id, 3, ud FROM s UNION ALL SELECT rec_id, 4, upr FROM s)
  WHERE trim(said) <> ''),
k AS (SELECT rec_id, where_, t, regexp_extract(t, '{units._PACKAGE}', 1) content, regexp_replace(regexp_extract(t, '{units._PACKAGE}', 2), '\.+$', '') of_ FROM m),
f AS (SELECT k.rec_id, where_, coalesce(u.factor, {_number_sql("content")} * w.factor) factor FROM k LEFT JOIN u ON u.name = k.t
  LEFT JOIN u w ON content <> '' AND w.name = CASE WHEN of_ = '' THEN 'ud' ELSE of_ END),
g AS (SELECT rec_id, arg_min(factor, where_) fq, arg_min(factor, CASE where_ WHEN 4 THEN 0 WHEN 1 THEN 9 ELSE where_ END) fp FROM f WHERE factor IS NOT NULL GROUP BY rec_id),
c AS (SELECT s.rec_id, note, code, {_number_sql("q")} * coalesce(fq, 1) quantity,
  {_number_sql("p")} / CASE WHEN cur LIKE 'c%' THEN 100 ELSE 1 END / coalesce(per.n, {_number_sql("pf")}, {_number_sql("pn")}, 1) / coalesce(fp, 1) price
  FROM s LEFT JOIN g ON g.rec_id = s.rec_id LEFT JOIN per ON per.letter = s.pf)
"""

SQL = {
    "p2_units": _P2 + "SELECT rec_id, round(quantity, 6) AS quantity, round(price, 8) AS price FROM c",
    "p2_found": _P2
    + """SELECT a.rec_id AS rec_a, b.rec_id AS rec_b FROM c a JOIN c b ON a.note = b.note AND a.code = b.code AND a.rec_id < b.rec_id
WHERE abs(a.quantity - b.quantity) <= 0.005 * greatest(abs(a.quantity), abs(b.quantity))
  AND abs(a.price - b.price) <= 0.005 * greatest(abs(a.price), abs(b.price))""",
    "p4_found": _JOINED
    + """
SELECT Pdf, Pagina, Linea, 'missing_in_run' AS finding FROM j WHERE r_there IS NULL
UNION ALL SELECT Pdf, Pagina, Linea, 'missing_in_master' FROM j WHERE m_there IS NULL
UNION ALL SELECT Pdf, Pagina, Linea, 'AlbaranNumero' FROM both_there WHERE ra IS DISTINCT FROM ma
UNION ALL SELECT Pdf, Pagina, Linea, 'Codigo' FROM both_there WHERE rc IS DISTINCT FROM mc
UNION ALL SELECT Pdf, Pagina, Linea, 'Importe' FROM both_there
  WHERE (ri IS NULL) <> (mi IS NULL) OR abs(ri - mi) > 0.005
UNION ALL SELECT Pdf, Pagina, Linea, 'CantidadServida' FROM both_there
  WHERE (rq IS NULL) <> (mq IS NULL) OR abs(rq - mq) > 0.005
""",
}
