"""Each supplier's extractor over pages printed from the stored lines: detection, choice of the extractor, rows and header fields.

``detail_lines`` holds no page texts. Its notes are therefore printed, each supplier's in the form of one of the extractors
(in the order of names), and read back as any page is: the supplier is found in the text, the name resolved to an
extractor, the page extracted. What must come out is what the table holds; the forms here are written down on their own
and share nothing with the layouts that read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.operators import detection, extraction
from notelith.plans.layouts import LAYOUTS
from notelith.plans.scalar_queries import sql_round
from notelith.runtime import durable, table

PAGE = ["Pdf", "Pagina"]
#: Forms by supplier: the head of the table, how codes are written, the numbers of a row; no numbers: one row a page.
FORMS: dict[str, tuple[str, str, str]] = {
    "A2ZWORLD": ("", "plain", ""),
    "ADARRA": ("", "plain", "quantity price discount amount"),
    "AELVASA": ("Referencia Marca Concepto Cantidad Precio Tasa Dto Importe", "plain", "quantity price fee discount amount"),
    "ALKAIN": ("Art. Descripción Cant. Precio Dto Importe", "plain", "quantity price discount amount"),
    "ARAIZ": ("Código Concepto Cantidad Precio Importe", "plain", "quantity price amount"),
    "ARTESOLAR": ("Referencia Conceptos Cantidad Precio Importe", "plain", "quantity price amount"),
    "AUTOMATION24": ("", "plain", "quantity price amount"),
    "AXOR": ("Art Concepto Can Importe", "plain", "quantity amount"),
    "BACOLSA": ("Referencia Descripción Cantidad", "plain", "quantity"),
    "BALANTXA": ("Fecha Concepto Importe", "plain", ""),
    "BASMODEC": ("Artículo Descripción Unidades Precio Importe", "plain", "quantity price amount"),
    "BERDIN": ("Código Descripción Pedida Servida UdsP Precio Dto Importe", "plain", "asked quantity per price discount amount"),
    "CARANDINI": ("", "digits", "quantity"),
    "CLC": ("Denominación Cantidad Precio Importe", "plain", "quantity price amount"),
    "DATAERASER": ("", "plain", ""),
    "Efecto Led": ("Referencia Descripción Cantidad", "plain", "quantity"),
    "ELEKTRA": ("Artículo Concepto Cantidad Precio Dto Importe", "digits", "quantity price discount amount"),
    "ELICETXE": ("Marca Referencia Denominación Cantidad", "plain", "quantity amount"),
    "ELT": ("Código Descripción Cantidad", "digits", "quantity"),
    "ESMERALDA": ("", "plain", "quantity price amount"),
    "GABYL": ("Código Descripción Cantidad Precio Por Dto Importe", "plain", "quantity price per discount amount"),
    "HILTI": ("Material Descripción Cantidad", "plain", "quantity"),
    "ITEVELESA": ("", "plain", ""),
    "JUPER": ("", "jp", "asked pending"),
    "KALON": ("", "plain", "quantity price discount amount"),
    "LEYCOLAN": ("Artículo Descripción Cantidad Precio", "plain", "quantity price amount"),
    "LOYOLA NORTE": ("", "plain", ""),
    "LUX MAY": ("Referencia Descripción Cantidad", "plain", "quantity amount"),
    "MONTTE": ("", "plain", "quantity price discount amount"),
    "MURRPLASTIK": ("", "plain", "quantity"),
    "NICRON": ("", "plain", ""),
    "PLATAFORMAS DONOSTI": ("", "plain", ""),
    "SALTOKI": ("", "plain", "asked quantity pending per price discount amount"),
    "SALVI": ("", "plain", "quantity"),
    "SEMEGA": ("Ref. Concepto Cantidad Precio Importe", "plain", "quantity price amount"),
    "SIGNIFY": ("", "plain", "quantity"),
    "SIMON": ("", "dashed", "quantity"),
    "TC MEDIDA": ("", "plain", "quantity amount"),
    "TXOFRE": ("Código Concepto Cantidad Precio Dto Importe", "plain", "quantity price discount amount"),
    "URKUNDE": ("", "plain", "quantity price discount amount"),
    "VASCOPLAST": ("Descripción Cantidad Precio Total", "plain", "quantity price amount"),
    "VIZCAINA": ("", "plain", ""),
}
SOURCES = {
    "asked": "CantidadPedida", "quantity": "CantidadServida", "pending": "CantidadPendiente", "per": "UnidadesPor", "price": "PrecioUnitario",
    "discount": "DescuentoPct", "amount": "Importe",
}
GIVEN = ["quantity", "price", "discount", "amount"]
MAX_SUPPLIERS = 10_000


def _suppliers(spark: SparkSession, sf_dir: str) -> list[str]:
    """The names in order: configuration, so more than a bound is an error."""
    names = table(spark, sf_dir, "detail_lines").select("Proveedor").where("Proveedor is not null").distinct().limit(MAX_SUPPLIERS + 1).collect()
    if len(names) > MAX_SUPPLIERS:
        raise ValueError(f"more than {MAX_SUPPLIERS} suppliers")
    return sorted(r[0] for r in names)


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), F.round(c.cast("decimal(24,8)"), 2))


def _printed(spark: SparkSession, sf_dir: str, only: str | None) -> DataFrame:
    """(Pdf, Pagina, text): pages of all suppliers, or of those that use one form."""
    forms, names = list(FORMS), _suppliers(spark, sf_dir)
    form_of = {n: forms[i % len(forms)] for i, n in enumerate(names)}
    lines = table(spark, sf_dir, "detail_lines")
    if only:
        lines = lines.where(F.col("Proveedor").isin([n for n, f in form_of.items() if f == only]))
    digits = F.lpad((F.col("line_id") % 1_000_000).cast("string"), 6, "0")
    plain = F.concat(F.lit("K"), F.upper(F.regexp_replace(F.coalesce("Codigo", F.lit("")), "[^A-Za-z0-9]", "")), F.lit("X9"))
    codes = {"plain": plain, "digits": digits, "jp": F.concat(F.lit("JP"), plain), "dashed": F.concat(F.lit("121-"), digits)}
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("Descripcion", F.lit("")), "[^A-Za-z ]", ""), " +", " "))
    text = F.trim(F.concat(F.lit("Art "), text))
    number = lambda n: F.lit("0,00") if n == "fee" else F.replace(_known(F.col(SOURCES[n])).cast("string"), F.lit("."), F.lit(","))
    by_form: dict[tuple[str, str], list[str]] = {}
    for form, (_, style, numbers) in FORMS.items():
        by_form.setdefault((style, numbers), []).append(form)
    form = F.create_map(*(F.lit(x) for pair in form_of.items() for x in pair))[F.col("Proveedor")] if form_of else F.lit(None).cast("string")
    lines = lines.withColumn("_form", form)
    # A row needs all its numbers; concat gives null where one is missing.
    row = F.coalesce(*(
        F.when(F.col("_form").isin(same), F.concat(codes[style], F.lit(" "), text, *(x for n in numbers.split() for x in (F.lit(" "), number(n)))))
        for (style, numbers), same in by_form.items() if numbers
    ))
    heads = F.create_map(*(F.lit(x) for f, (head, _, _) in FORMS.items() for x in (f, head)))
    pages = lines.groupBy(*PAGE, "_form").agg(
        F.transform(F.array_sort(F.collect_list(F.when(row.isNotNull(), F.struct("line_id", row.alias("row"))))), lambda x: x["row"]).alias("rows"),
        F.abs(F.coalesce(F.sum(_known(F.col("Importe"))), F.lit(0))).cast("decimal(24,2)").alias("total"),
    )
    number_of = F.regexp_extract("Pdf", r"([0-9]{4,})\.pdf$", 1)
    n = number_of.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    top = F.array(
        F.concat("_form", F.lit(" S.A. suministros")),
        F.concat(F.lit("Albarán N. "), number_of, F.lit(" de fecha "), two(n % 28 + 1), F.lit("/"), two(n % 12 + 1), F.lit("/2024")),
        F.concat(F.lit("Su pedido: 25."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("/H recibido")),
        heads[F.col("_form")],
    )
    bottom = F.array(F.concat(F.lit("TOTAL IVA "), F.replace(F.col("total").cast("string"), F.lit("."), F.lit(","))))
    return pages.select(*PAGE, F.array_join(F.concat(top, "rows", bottom), "\n").alias("text"))


def _read(spark: SparkSession, sf_dir: str, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The printed pages with the extractor that their text leads to, and the layouts."""
    names = spark.createDataFrame([(x.supplier, x.supplier) for x in LAYOUTS if x.kind != "generic"], "supplier string, alias string")
    pages = durable(_printed(spark, sf_dir, only))
    aliases = detection.alias_table([names])
    scored = detection.scores(detection.alias_hits(pages, PAGE, "text", aliases), None, PAGE)
    found = detection.best(pages, scored, PAGE)
    parsers = detection.resolve_extractor(found.select(F.col("detected").alias("name")), names.select("supplier", F.col("supplier").alias("parser")))
    chosen = found.join(parsers, found["detected"] == parsers["name"]).select(*PAGE, F.col("parser").alias("supplier"))
    return pages.join(chosen, PAGE), extraction.layout_table(spark, LAYOUTS)


def _rows_of(form: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extraction.extract_rows(*_read(spark, sf_dir, form), PAGE)
        return found.select(*PAGE, "supplier", "code", "description", *(F.round(n, 2).alias(n) for n in GIVEN))

    return query


def _page_of(form: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extraction.extract_pages(*_read(spark, sf_dir, form), PAGE)
        return found.select(*PAGE, "supplier", "note", "order_code", "date", "total")

    return query


def notes_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From page texts to checked notes, all suppliers together: supplier, header fields, rows, their sum and the gap to the printed total."""
    pages, layouts = _read(spark, sf_dir)
    pages = durable(pages)
    heads = extraction.extract_pages(pages, layouts, PAGE).select(*PAGE, "supplier", "note", "total")
    rows = extraction.extract_rows(pages, layouts, PAGE)
    money = F.col("amount").cast("decimal(18,4)")
    sums = rows.groupBy(*PAGE).agg(F.count("*").alias("rows"), F.sum(money).alias("_sum"))
    gap = F.round(F.col("total").cast("decimal(18,4)") - F.coalesce("_sum", F.lit(0)), 2).cast("double")
    return heads.join(sums, PAGE, "left").select(*PAGE, "supplier", "note", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("_sum").cast("double").alias("amount"), "total", gap.alias("gap"))


def _slug(form: str) -> str:
    return "extract_" + form.lower().replace(" ", "_")


QUERIES = {_slug(f): (_rows_of if numbers else _page_of)(f) for f, (_, _, numbers) in FORMS.items()} | {
    "supplier_headers": _page_of(None),
    "supplier_rows": _rows_of(None),
    "notes_end_to_end": notes_end_to_end,
}

# --- SQL: what the table holds, by the forms alone ---------------------------------------------------------------------

_SLOTS = "slots AS (SELECT Proveedor, (dense_rank() OVER (ORDER BY Proveedor) - 1) % {n} slot FROM (SELECT DISTINCT Proveedor FROM detail_lines WHERE Proveedor IS NOT NULL))".format(n=len(FORMS))
_CODE_SQL = {"plain": "'K' || upper(regexp_replace(coalesce(Codigo, ''), '[^A-Za-z0-9]', '', 'g')) || 'X9'", "digits": "lpad(CAST(line_id % 1000000 AS VARCHAR), 6, '0')"}
_CODE_SQL |= {"jp": "'JP' || " + _CODE_SQL["plain"], "dashed": "'121-' || " + _CODE_SQL["digits"]}
_TEXT_SQL = "trim('Art ' || trim(regexp_replace(regexp_replace(coalesce(Descripcion, ''), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')))"


def _number_sql(n: str) -> str:
    return f"CASE WHEN NOT isnan({SOURCES[n]}) THEN {sql_round(SOURCES[n], 2)} END"


def _rows_sql(i: int, form: str) -> str:
    _, style, numbers = FORMS[form]
    printed = [n for n in numbers.split() if n != "fee"]
    given = {n: _number_sql(n) if n in printed else "CAST(NULL AS DOUBLE)" for n in GIVEN}
    if printed == ["asked", "pending"]:
        given["quantity"] = f"round(greatest({_number_sql('asked')} - {_number_sql('pending')}, 0), 2)"
    whole = " AND ".join(f"({_number_sql(n)}) IS NOT NULL" for n in printed)
    return f"""WITH {_SLOTS} SELECT Pdf, Pagina, '{form}' AS supplier, {_CODE_SQL[style]} AS code, {_TEXT_SQL} AS description, {", ".join(f"{x} AS {n}" for n, x in given.items())}
FROM detail_lines JOIN slots USING (Proveedor) WHERE slot = {i} AND {whole}"""


_FORM_NAMES = "[" + ", ".join(f"'{f}'" for f in FORMS) + "]"
_PAGES_SQL = f"""WITH {_SLOTS}, p AS (SELECT Pdf, Pagina, slot, CAST(abs(coalesce(sum(CAST({_number_sql("amount")} AS DECIMAL(18, 2))), 0)) AS DOUBLE) total FROM detail_lines JOIN slots USING (Proveedor) GROUP BY ALL),
n AS (SELECT *, regexp_extract(Pdf, '([0-9]{{4,}})\\.pdf$', 1) note FROM p),
h AS (SELECT Pdf, Pagina, slot, {_FORM_NAMES}[slot + 1] AS supplier, note, '25.' || lpad(CAST(CAST(note AS BIGINT) % 1000 AS VARCHAR), 3, '0') || '/H' AS order_code,
  lpad(CAST(CAST(note AS BIGINT) % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(CAST(note AS BIGINT) % 12 + 1 AS VARCHAR), 2, '0') || '/2024' AS date, total FROM n)
"""
_WHOLE = "CASE slot " + " ".join(
    f"WHEN {i} THEN " + " AND ".join(f"({_number_sql(n)}) IS NOT NULL" for n in numbers.split() if n != "fee") for i, (_, _, numbers) in enumerate(FORMS.values()) if numbers
) + " ELSE FALSE END"
_HAS_AMOUNT = "slot IN (" + ", ".join(str(i) for i, (_, _, numbers) in enumerate(FORMS.values()) if "amount" in numbers) + ")"

SQL = {
    _slug(f): _rows_sql(i, f) if numbers else _PAGES_SQL + f"SELECT Pdf, Pagina, supplier, note, order_code, date, total FROM h WHERE slot = {i}"
    for i, (f, (_, _, numbers)) in enumerate(FORMS.items())
} | {
    "supplier_rows": " UNION ALL ".join(f"(SELECT * FROM ({_rows_sql(i, f)}))" for i, (f, (_, _, numbers)) in enumerate(FORMS.items()) if numbers),
    "supplier_headers": _PAGES_SQL + "SELECT Pdf, Pagina, supplier, note, order_code, date, total FROM h",
    "notes_end_to_end": _PAGES_SQL
    + f""", r AS (SELECT Pdf, Pagina, count(*) n, sum(CASE WHEN {_HAS_AMOUNT} THEN CAST({_number_sql("amount")} AS DECIMAL(18, 4)) END) s FROM detail_lines JOIN slots USING (Proveedor) WHERE {_WHOLE} GROUP BY ALL)
SELECT h.Pdf, h.Pagina, supplier, note, coalesce(n, 0) AS rows, CAST(s AS DOUBLE) AS amount, total, CAST(round(CAST(total AS DECIMAL(18, 4)) - coalesce(s, 0), 2) AS DOUBLE) AS gap
FROM h LEFT JOIN r ON r.Pdf = h.Pdf AND r.Pagina = h.Pagina""",
}
