"""Text, number, date and order-code functions over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.functions import dates, numeric, order_codes
from notelith.functions import text as tx
from notelith.operators import pages
from notelith.runtime import table

MONTH_NAMES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
GUARDS = [["ALBARAN", "HOJA"], ["FECHA", "PEDIDO"], ["ATENCION"]]
STOP_WORDS = ["PARA", "TIPO", "SERIE", "COLOR"]
ORDER_PATTERNS = [r"pedido ([0-9A-Z][0-9A-Z/.-]*)", r"commande ([0-9A-Z][0-9A-Z/.-]*)", r"order ([0-9A-Z][0-9A-Z/.-]*)", r"encomenda ([0-9A-Z][0-9A-Z/.-]*)"]
RULES = [
    ("Suministros Arkaldi", 3, 0, False, True, False, False, False),
    ("Electro Beltzuri", 5, 3, False, True, True, True, False),
    ("Ferretería Mendarte", 5, 3, True, False, False, True, False),
    ("Tuberías Valdorra", 5, 3, False, True, False, True, True),
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "detail_lines")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", tx.normalize_spaces("Descripcion").alias("text"))


def fold_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", F.md5(tx.fold_upper("Descripcion").cast("binary")).alias("folded"))


def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(tx.keywords("Descripcion", STOP_WORDS), " ")
    return _lines(spark, sf_dir).select("line_id", tx.key_token("AlbaranNumero").alias("note"), words.alias("words"), tx.hint("Descripcion", 40).alias("hint"))


def glyph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "line_id", tx.fix_glyphs("Codigo").alias("digits"), tx.squash_doubles("Codigo").alias("squashed"), tx.join_code_parts("Codigo").alias("joined")
    )


def first_match_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.first_match("text", ORDER_PATTERNS).alias("order_code"))


def first_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.first_match_in_lines(tx.lines_of("text"), ORDER_PATTERNS).alias("order_code"))


def decimals_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.explode_lines(_docs(spark, sf_dir), ["doc_id"], "text")
    found = lines.select("doc_id", "ln", tx.decimals_in("line").alias("d")).where(F.size("d") > 0)
    return found.select("doc_id", "ln", F.size("d").alias("n"), F.element_at("d", -1).alias("last"))


def header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.header_index(tx.lines_of("text"), ["CODIGO", "DESCRIPCION", "IMPORTE"]).alias("head"))


def strip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.explode_lines(_docs(spark, sf_dir), ["doc_id"], "text").select("doc_id", "line", tx.strip_counter("line").alias("bare"))
    return lines.where("line <> bare").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("bare")).alias("chars"))


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pages.text_metrics("text")
    return _docs(spark, sf_dir).select("doc_id", m["char_count"].alias("char_count"), m["line_count"].alias("line_count"), F.round(m["density"], 9).alias("density"))


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(pages.entropy("text"), 6).alias("entropy"))


def ocr_trigger_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pages.text_metrics("text")
    read = _docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in m.items()))
    reasons = pages.recognition_reasons(F.col("char_count"), F.col("density"), F.col("line_count"), F.round("entropy", 6))
    return read.select("doc_id", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) > 0).alias("triggered"))


def union_text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text with that of the page behind it, as two readings of one page: lines united, texts merged."""
    docs = _docs(spark, sf_dir).select("doc_id", "Pdf", "Pagina", "text")
    other = docs.select("Pdf", (F.col("Pagina") - 1).alias("Pagina"), F.col("text").alias("extra"))
    both = docs.join(other, ["Pdf", "Pagina"])
    lines, merged = tx.union_lines("text", "extra"), tx.merge_texts("text", "extra")
    return both.select("doc_id", F.size(lines).alias("lines"), F.length(F.array_join(lines, "\n")).alias("chars"), F.length(merged).alias("merged"))


def to_float_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qty_records").select("rec_id", numeric.to_float_es("PrecioUnitario").alias("price"), numeric.to_num("CantidadServida").alias("quantity"))


def collapse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.regexp_replace(F.format_number(F.col("Importe"), 2), "([0-9])([0-9])", "$1 $2")
    text = F.when(F.col("Importe") < 0, F.concat(F.replace(spaced, F.lit("-"), F.lit("")), F.lit(" -"))).otherwise(spaced)
    return _lines(spark, sf_dir).select("line_id", numeric.collapse_number(F.replace(text, F.lit(","), F.lit(""))).alias("number"))


def money_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", numeric.money_round("PrecioUnitario").alias("price"), numeric.money_round("Importe", 1).alias("amount"))


def calc_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = numeric.calc_amount("CantidadServida", "PrecioUnitario", "DescuentoPct", "UnidadesPor")
    return _lines(spark, sf_dir).select("line_id", expected.alias("expected"))


def effective_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", numeric.effective_quantity("CantidadServida", "CantidadPedida", "CantidadPendiente").alias("quantity"))


def unit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qty_records").select("rec_id", numeric.unit_factor("UnidadesPor").alias("factor"))


def split_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and discount glued to one run of digits, taken apart by the amount; null for lines without a price and a discount to glue."""
    lines = _lines(spark, sf_dir)
    whole = F.expr("PrecioUnitario between 0.1 and 9999 and DescuentoPct > 0 and DescuentoPct < 100 and CantidadServida > 0")
    price, discount = F.round("PrecioUnitario", 2), F.round("DescuentoPct", 2)
    cents = lambda c: F.round(c * 100).cast("long").cast("string")
    glued = lines.select("line_id", F.col("CantidadServida").alias("q"), F.when(whole, F.concat(cents(price), cents(discount))).alias("digits"), F.round(F.col("CantidadServida") * price * (1 - discount / 100), 2).alias("amount"))
    best = numeric.split_price_discount("digits", "q", "amount")
    return glued.select("line_id", "digits", best.alias("b")).select("line_id", "digits", "b.price", "b.discount")


def parse_date_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        "line_id",
        dates.parse_date_es("FechaAlbaran").alias("date"),
        dates.parse_date_es("FechaAlbaran", dots=True).alias("dotted"),
        dates.as_date(dates.parse_date_es("FechaAlbaran", dots=True)).cast("string").alias("day"),
    )


def date_from_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("A"), F.regexp_replace("FechaAlbaran", "^([0-9]{2})/([0-9]{2})/20([0-9]{2})$", "$1$2$3"), F.lit("/L"))
    return _lines(spark, sf_dir).select("line_id", dates.date_of_code(made).alias("date"))


def year_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.substring("FechaAlbaran", 7, 4).try_cast("int")
    return table(spark, sf_dir, "note_meta").select("Pdf", "AlbaranNumero", dates.year_from_path(F.coalesce("AlbaranNumero", F.lit("")), year).alias("year"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's order code as read and in the shapes of other layouts that are made from it."""
    digits = F.regexp_replace("SuPedidoCodigo", "[^0-9]", "")
    shapes = {
        "read": F.col("SuPedidoCodigo"),
        "letter": F.concat(F.lit("A"), F.substring(digits, 1, 6), F.lit("/L519325")),
        "tail": F.concat(F.col("SuPedidoCodigo"), F.lit("12 345")),
        "fused": F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 5), F.lit("/E")),
        "misread": F.concat(F.lit(" "), F.substring(digits, 1, 3), F.lit("O"), F.substring(digits, 5, 2), F.lit("-")),
        "digits": digits,
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("shape"), c.alias("code")) for n, c in shapes.items()))).alias("s")
    return _lines(spark, sf_dir).select("line_id", "Proveedor", each).select("line_id", "Proveedor", "s.shape", "s.code")


def order_code_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("line_id", "shape", order_codes.strip_noise(order_codes.clean("code")).alias("clean"))


def order_code_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("line_id", "shape", order_codes.truncate("code").alias("compact"))


def order_code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, order_codes.RULE_SCHEMA)
    return order_codes.normalize(_codes(spark, sf_dir), "code", "Proveedor", rules, "normal").select("line_id", "shape", "normal")


def order_code_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("line_id", "shape", order_codes.keep_suffix("code").alias("kept"))


def code_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("line_id", "shape", order_codes.quality("code").alias("score"), order_codes.plausible("code").alias("plausible"))


def note_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = order_codes.note_number("AlbaranNumero")
    return _lines(spark, sf_dir).select(
        "line_id", note.alias("note"), order_codes.looks_like_note("AlbaranNumero").alias("is_note"), order_codes.looks_like_date(note).alias("is_date"), order_codes.looks_like_phone(note, "10[0-9]").alias("is_phone")
    )


def date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note dates written with the month as a word, read back."""
    day = dates.as_date("FechaAlbaran")
    months = F.array(*(F.lit(m) for m in MONTH_NAMES))
    words = F.concat(F.dayofmonth(day), F.lit(" de "), F.element_at(months, F.month(day)), F.lit(" de "), F.year(day))
    return _lines(spark, sf_dir).select("line_id", dates.parse_date_words(F.coalesce(words, "FechaAlbaran")).alias("date"), dates.default_date("FechaAlbaran", F.lit("-")).alias("given"))


def fuzzy_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of the lines' texts in which recognition put letters for digits."""
    misread = F.translate("Descripcion", "05", "OS")
    found = _lines(spark, sf_dir).select("line_id", F.explode(numeric.fuzzy_decimals(misread)).alias("f"))
    return found.select("line_id", "f.place", F.round("f.value", 4).alias("value"))


def quantity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quantities of a line written as one block, taken apart again."""
    three = ["CantidadPedida", "CantidadServida", "CantidadPendiente"]
    block = F.concat_ws("  ", *(F.replace(F.col(c).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")) for c in three))
    found = F.aggregate(numeric.split_quantities(block, F.lit(3)), F.lit(0.0), lambda a, x: a + x)
    return _lines(spark, sf_dir).select("line_id", F.round(found.cast("decimal(18,2)"), 2).cast("double").alias("total"))


def line_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are headings or contacts, and lines without the noise in front."""
    lines = pages.explode_lines(_docs(spark, sf_dir), ["doc_id"], "text")
    guarded = lines.select("doc_id", tx.contains_all_of("line", GUARDS).alias("guard"), "line", tx.strip_noise_prefix("line").alias("bare"))
    return guarded.groupBy("doc_id").agg(F.count_if("guard").alias("guards"), F.sum(F.length("line") - F.length("bare")).alias("noise"))


def price_per_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("UnidadesPor") == 100, F.concat("Descripcion", F.lit(" (100)"))).otherwise(F.col("Descripcion"))
    return _lines(spark, sf_dir).select("line_id", F.round(numeric.per_hundred("PrecioUnitario", F.coalesce(marked, F.lit(""))), 6).alias("price"))


def small_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose amount could be a recycling fee."""
    return _lines(spark, sf_dir).select("line_id", F.coalesce(numeric.small_value("Importe"), F.lit(False)).alias("small"))


def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that were read in the wrong encoding, and back."""
    broken = F.decode(F.encode(F.coalesce("Descripcion", F.lit("")), "UTF-8"), "ISO-8859-1")
    return _lines(spark, sf_dir).select("line_id", (tx.repair_mojibake(broken) == F.coalesce("Descripcion", F.lit(""))).alias("same"))


QUERIES = {f.__name__: f for f in (
    normalize_spaces, fold_upper, key_tokens, glyph_repair, first_match_extract, first_match_lines, decimals_in_line, header_index, strip_counters,
    text_metrics, text_entropy, ocr_trigger_reasons, union_text_variants, to_float_es, collapse_numbers, money_round, calc_amount, effective_quantity,
    unit_factor, split_glued, parse_date_es, date_from_code, year_from_path, order_code_clean, order_code_truncate, order_code_normalize,
    order_code_suffix, code_quality_score, note_plausibility, date_words, fuzzy_decimals, quantity_blocks, line_guards, price_per_hundred, small_fees, mojibake_repair,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------

WS = tx.WS


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_spaces(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '{WS}{{2,}}', ' ', 'g')")


def sql_fold(x: str) -> str:
    return f"upper(replace(replace(replace(translate({x}, '{tx.ACCENTED}', '{tx.PLAIN}'), 'ß', 'ss'), 'ﬂ', 'fl'), 'ﬁ', 'fi'))"


def sql_key(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g')"


def sql_lines(x: str) -> str:
    split = f"string_split(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({split}, lambda y: {sql_spaces('y')}), lambda y: y <> '')"


LINES_SQL = f"""
lines AS (SELECT doc_id, Pdf, Pagina, unnest(range(len(l))) AS ln, unnest(l) AS line FROM (SELECT doc_id, Pdf, Pagina, {sql_lines("text")} l FROM documents))
"""


def sql_first(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({sql_trim(f'regexp_extract({x}, {chr(39)}{p}{chr(39)}, 1)')}, '')" for p in ORDER_PATTERNS) + ", '')"


def sql_round(x: str, n: int) -> str:
    """Half up on the decimal number, as money is rounded."""
    return f"CAST(round(CAST({x} AS DECIMAL(24, 8)), {n}) AS DOUBLE)"


def sql_num(x: str) -> str:
    return f"try_cast(replace(trim({x}), ',', '.') AS DOUBLE)"


_ENTROPY = f"""
WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{WS}', '', 'g'), '')) ch FROM documents),
n AS (SELECT doc_id, ch, count(*) k FROM c WHERE ch <> '' GROUP BY ALL),
t AS (SELECT doc_id, sum(k) total, sum(k * log2(k)) s FROM n GROUP BY doc_id),
e AS (SELECT d.doc_id, d.text, round(coalesce(log2(total) - s / total, 0), 6) entropy FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id)
"""


def sql_repair(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '([0-9])O([0-9])', '\\10\\2', 'g'), '([0-9])[IL]([0-9])', '\\11\\2', 'g')"
    return x


_CODES = """
dig AS (SELECT *, regexp_replace(SuPedidoCodigo, '[^0-9]', '', 'g') d FROM detail_lines),
codes AS (SELECT line_id, Proveedor, 'read' shape, SuPedidoCodigo code FROM dig UNION ALL SELECT line_id, Proveedor, 'letter', 'A' || substr(d, 1, 6) || '/L519325' FROM dig
  UNION ALL SELECT line_id, Proveedor, 'tail', SuPedidoCodigo || '12 345' FROM dig UNION ALL SELECT line_id, Proveedor, 'fused', substr(d, 1, 2) || '.' || substr(d, 3, 5) || '/E' FROM dig
  UNION ALL SELECT line_id, Proveedor, 'misread', ' ' || substr(d, 1, 3) || 'O' || substr(d, 5, 2) || '-' FROM dig UNION ALL SELECT line_id, Proveedor, 'digits', d FROM dig)
"""


def sql_clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9./-]', '', 'g'), '^[/.-]+', ''), '[/.-]+$', '')"


def sql_noise(x: str) -> str:
    s = f"regexp_replace({sql_repair(x)}, '^([AH][0-9]{{6,8}}/[A-Z]{{1,4}})[0-9]{{2,}}$', '\\1')"
    return f"regexp_replace({s}, '^(([0-9]{{2}}\\.[0-9]{{3}}|[0-9]{{5}})[-/][0-9]{{2,3}}[-/][A-Z]{{1,4}})[0-9]{{2,}}$', '\\1')"


def sql_truncate(x: str) -> str:
    """A scalar subquery over one value."""
    s0 = f"regexp_replace(translate(upper(coalesce({x}, '')), '\\_-', '///'), '\\s+', '', 'g')"
    s = sql_repair(f"regexp_replace(regexp_replace(regexp_replace({s0}, '/+', '/', 'g'), '^/', ''), '/$', '')")
    lead, free, end = "(^|[^A-Z0-9_])([AH])[./-]*([A-Z0-9]{6,16})([^A-Z0-9]|$)", "(^|[^0-9])", "($|[^0-9])"
    ex = lambda p, i: f"regexp_extract(s, '{p}', {i})"
    two = lambda t: f"CASE WHEN regexp_matches(translate(replace({t}, '/', ''), 'OIL', '011'), '^[0-9]{{1,3}}$') THEN '/' || lpad(right(translate(replace({t}, '/', ''), 'OIL', '011'), 2), 2, '0') ELSE '' END"
    fused, parts, five = f"{free}([0-9]{{2}})\\.([0-9]{{5}})(/[A-Z0-9]{{1,4}})?{end}", f"{free}([0-9]{{2}})[./-]([0-9]{{3}})(/[A-Z0-9]{{1,4}})?{end}", f"{free}([0-9]{{5}})(/[A-Z0-9]{{1,4}})?{end}"
    run = f"coalesce(nullif(regexp_extract({ex(lead, 3)}, '^([0-9]{{6,8}})', 1), ''), nullif(regexp_extract(translate({ex(lead, 3)}, 'OIL', '011'), '^([0-9]{{6,8}})', 1), ''))"
    block = f"regexp_extract(replace(s, '.', ''), '{free}([0-9]{{5,7}}){end}', 2)"
    return f"""(SELECT coalesce(CASE WHEN {ex(lead, 2)} <> '' THEN {ex(lead, 2)} || {run} END,
      CASE WHEN {ex(fused, 2)} <> '' THEN {ex(fused, 2)} || substr({ex(fused, 3)}, 1, 3) || '/' || substr({ex(fused, 3)}, 4, 2) END,
      CASE WHEN {ex(parts, 2)} <> '' THEN {ex(parts, 2)} || {ex(parts, 3)} || {two(ex(parts, 4))} END,
      CASE WHEN {ex(five, 2)} <> '' THEN {ex(five, 2)} || {two(ex(five, 3))} END,
      CASE WHEN length({block}) = 7 THEN substr({block}, 1, 5) || '/' || substr({block}, 6, 2) WHEN {block} <> '' THEN substr({block}, 1, 5) END, '')
      FROM (SELECT {s} AS s))"""


_RULES = ", ".join("('" + r[0] + "', " + ", ".join(str(x).upper() for x in r[1:]) + ")" for r in RULES)
_NORMALIZE = f"""
WITH {_CODES}, r({", ".join(["supplier", *order_codes.RULE_FIELDS])}) AS (VALUES {_RULES}),
a AS (SELECT line_id, shape, regexp_replace({sql_noise(sql_clean("code"))}, '^([AH])[-/]([0-9]{{2}})/([0-9]{{2}})/([0-9]{{2}})$', '\\1\\2\\3\\4') v,
  coalesce(min_length, 5) min_length, coalesce(min_digits, 3) min_digits, coalesce(require_alpha, FALSE) require_alpha, coalesce(allow_numeric, FALSE) allow_numeric,
  coalesce(no_truncate, FALSE) no_truncate, coalesce(preserve_alpha_suffix, TRUE) preserve, coalesce(strip_leading_one_6d, FALSE) strip_one
  FROM codes LEFT JOIN r ON upper(r.supplier) = upper(codes.Proveedor)),
b AS (SELECT * REPLACE (CASE WHEN strip_one AND length(regexp_replace(v, '[^0-9]', '', 'g')) = 6 AND regexp_replace(v, '[^0-9]', '', 'g') LIKE '1%' AND NOT regexp_matches(v, '[A-Z]')
  THEN substr(regexp_replace(v, '[^0-9]', '', 'g'), 2, 5) ELSE v END AS v) FROM a),
c AS (SELECT * REPLACE (CASE WHEN no_truncate OR (preserve AND regexp_matches(v, '[A-Z]') AND (regexp_matches(v, '[/.-]') OR regexp_matches(v, '^[AH][0-9]{{6,8}}[A-Z]{{1,4}}$')))
  THEN v ELSE coalesce(nullif({sql_truncate("v")}, ''), v) END AS v) FROM b)
SELECT line_id, shape, CASE WHEN length(v) < greatest(min_length, 1) OR length(regexp_replace(v, '[^0-9]', '', 'g')) < min_digits
  OR (require_alpha AND NOT regexp_matches(v, '[A-Z]'))
  OR (NOT regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '[/.-]') AND NOT allow_numeric AND NOT regexp_matches(v, '^[0-9]{{5}}$')) THEN '' ELSE v END AS normal FROM c
"""


def sql_date(x: str, sep: str = "-/") -> str:
    dmy, ymd = f"([0-9]{{1,2}})[{sep}]([0-9]{{1,2}})[{sep}]([0-9]{{2,4}})", "([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
    t = f"coalesce({x}, '')"
    e = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    y = f"CASE WHEN length({e(dmy, 3)}) <> 2 THEN '' WHEN CAST({e(dmy, 3)} AS INT) <= 69 THEN '20' ELSE '19' END || {e(dmy, 3)}"
    return (
        f"CASE WHEN {e(dmy, 1)} <> '' THEN lpad({e(dmy, 1)}, 2, '0') || '/' || lpad({e(dmy, 2)}, 2, '0') || '/' || lpad({y}, 4, '0')"
        f" WHEN {e(ymd, 1)} <> '' THEN lpad({e(ymd, 3)}, 2, '0') || '/' || lpad({e(ymd, 2)}, 2, '0') || '/' || {e(ymd, 1)} ELSE '' END"
    )


_QUALITY = """CASE WHEN regexp_matches(v, '^[0-9]{2}\\.[0-9]{3}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(v, '^[AH][0-9]{6}') THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(v, '^[0-9]{5}([-/]|$)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(v, '[-/][0-9]{2}([-/]|$)') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(v, '[-/][A-Z]{1,2}$') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(v, '[-/.]{2,}') THEN 3 ELSE 0 END
 - CASE WHEN regexp_matches(v, '[^A-Z0-9./-]') THEN 2 ELSE 0 END - CASE WHEN v = '' THEN 10 ELSE 0 END"""

_NOTE = "regexp_replace(upper(coalesce(AlbaranNumero, '')), '\\s+', '', 'g')"

SQL = {
    "normalize_spaces": f"SELECT line_id, {sql_spaces('Descripcion')} AS text FROM detail_lines",
    "fold_upper": f"SELECT line_id, md5({sql_fold('Descripcion')}) AS folded FROM detail_lines",
    "key_tokens": f"""SELECT line_id, {sql_key("AlbaranNumero")} AS note,
  coalesce(array_to_string(list_slice(list_filter(string_split(regexp_replace({sql_fold("Descripcion")}, '[^A-Z0-9]+', ' ', 'g'), ' '),
    lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({", ".join(repr(w) for w in STOP_WORDS)})), 1, 5), ' '), CASE WHEN Descripcion IS NULL THEN NULL ELSE '' END) AS words,
  substr({sql_key(sql_fold("Descripcion"))}, 1, 40) AS hint FROM detail_lines""",
    "glyph_repair": f"""SELECT line_id, translate(Codigo, '{tx.GLYPHS[0]}', '{tx.GLYPHS[1]}') AS digits,
  {"".join(f"regexp_replace(" for _ in range(26))}Codigo{"".join(f", '{c}{c}+', '{c}', 'g')" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS squashed,
  regexp_replace(Codigo, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z]{{2,}}) ([0-9]{{3,}})($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2\\3\\4', 'g') AS joined FROM detail_lines""",
    "first_match_extract": f"SELECT doc_id, {sql_first('text')} AS order_code FROM documents",
    "first_match_lines": f"""SELECT doc_id, coalesce(list_filter(list_transform({sql_lines("text")}, lambda z: {sql_first("z")}), lambda z: z <> '')[1], '') AS order_code FROM documents""",
    "decimals_in_line": f"""WITH {LINES_SQL}, d AS (SELECT doc_id, ln, regexp_extract_all(line, '(-?[0-9][0-9.]*,[0-9]+)', 1) d FROM lines)
SELECT doc_id, CAST(ln AS INT) AS ln, CAST(len(d) AS INT) AS n, d[-1] AS last FROM d WHERE len(d) > 0""",
    "header_index": f"""WITH {LINES_SQL} SELECT d.doc_id, CAST(min(ln) AS INT) AS head FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id
  AND contains({sql_fold("line")}, 'CODIGO') AND contains({sql_fold("line")}, 'DESCRIPCION') AND contains({sql_fold("line")}, 'IMPORTE') GROUP BY d.doc_id""",
    "strip_counters": f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line, regexp_replace(line, '^[0-9]{{1,3}}:\\s*', '') bare FROM lines)
SELECT doc_id, count(*) AS lines, sum(length(bare)) AS chars FROM b WHERE line <> bare GROUP BY doc_id""",
    "text_metrics": f"""SELECT doc_id, length({sql_trim("coalesce(text, '')")}) AS char_count, len({sql_lines("text")}) AS line_count,
  round(length({sql_trim("coalesce(text, '')")}) / {pages.PAGE_AREA!r}, 9) AS density FROM documents""",
    "text_entropy": _ENTROPY + "SELECT doc_id, entropy FROM e",
    "ocr_trigger_reasons": _ENTROPY
    + f""", m AS (SELECT doc_id, entropy, length({sql_trim("coalesce(text, '')")}) chars, len({sql_lines("text")}) n FROM e),
r AS (SELECT doc_id, concat_ws(';', CASE WHEN chars < 120 THEN 'chars<120' END, CASE WHEN chars / {pages.PAGE_AREA!r} < 0.0008 THEN 'density<0.0008' END,
  CASE WHEN n < 4 THEN 'lines<4' END, CASE WHEN entropy < 3.3 THEN 'entropy<3.3' END) reasons FROM m)
SELECT doc_id, reasons, reasons <> '' AS triggered FROM r""",
    "union_text_variants": f"""WITH b AS (SELECT d.doc_id, d.text, o.text extra FROM documents d JOIN documents o ON o.Pdf = d.Pdf AND o.Pagina = d.Pagina + 1),
l AS (SELECT doc_id, list_concat({sql_lines("text")}, {sql_lines("extra")}) l, coalesce(text, '') a, {sql_trim("coalesce(text, '')")} ta, {sql_trim("coalesce(extra, '')")} tb FROM b),
u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) u, a, ta, tb FROM l)
SELECT doc_id, CAST(len(u) AS INT) AS lines, coalesce(length(array_to_string(u, chr(10))), 0) AS chars,
  length(CASE WHEN tb = '' THEN a WHEN ta = '' THEN tb WHEN contains(ta, tb) THEN ta ELSE ta || chr(10) || tb END) AS merged FROM u""",
    "to_float_es": f"""SELECT rec_id, try_cast(replace(replace(regexp_replace(trim(PrecioUnitario), '/[A-Za-z]*\\s*$', ''), '.', ''), ',', '.') AS DOUBLE) AS price,
  {sql_num("CantidadServida")} AS quantity FROM qty_records""",
    "collapse_numbers": """SELECT line_id, CASE WHEN Importe IS NULL THEN NULL ELSE printf('%.2f', Importe) END AS number FROM detail_lines""",
    "money_round": f"SELECT line_id, {sql_round('PrecioUnitario', 2)} AS price, {sql_round('Importe', 1)} AS amount FROM detail_lines",
    "calc_amount": """SELECT line_id, CAST(round(CAST(CantidadServida / CASE WHEN coalesce(UnidadesPor, 0) = 0 THEN 1.0 ELSE UnidadesPor END * PrecioUnitario
  * (100 - coalesce(DescuentoPct, 0)) / 100 AS DECIMAL(24, 8)), 2) AS DOUBLE) AS expected FROM detail_lines""",
    "effective_quantity": """SELECT line_id, CASE WHEN CantidadServida > 0 THEN CantidadServida WHEN CantidadPedida > 0 THEN CantidadPedida
  WHEN CantidadPendiente > 0 THEN CantidadPendiente ELSE 1 END AS quantity FROM detail_lines""",
    "unit_factor": """SELECT rec_id, CASE ltrim(UnidadesPor, '/') WHEN 'U' THEN 1 WHEN 'D' THEN 10 WHEN 'C' THEN 100 WHEN 'M' THEN 1000 WHEN 'P' THEN 1000
  ELSE coalesce(try_cast(UnidadesPor AS DOUBLE), 1) END AS factor FROM qty_records""",
    "small_fees": "SELECT line_id, coalesce(Importe > 0 AND Importe < 5, FALSE) AS small FROM detail_lines",
    "mojibake_repair": "SELECT line_id, TRUE AS same FROM detail_lines",
    "split_glued": f"""WITH r AS (SELECT line_id, CantidadServida q, {sql_round("PrecioUnitario", 2)} p, {sql_round("DescuentoPct", 2)} d FROM detail_lines
  WHERE PrecioUnitario BETWEEN 0.1 AND 9999 AND DescuentoPct > 0 AND DescuentoPct < 100 AND CantidadServida > 0),
g AS (SELECT line_id, q, CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR) || CAST(CAST(round(d * 100) AS BIGINT) AS VARCHAR) digits, {sql_round("q * p * (1 - d / 100)", 2)} amount FROM r),
c AS (SELECT line_id, digits, q, amount, unnest(range(1, length(digits))) i FROM g),
p AS (SELECT *, CAST(substr(digits, 1, i) AS DOUBLE) / 100 price, CAST(substr(digits, i + 1) AS DOUBLE) / 100 discount FROM c)
SELECT l.line_id, digits, price, discount FROM detail_lines l LEFT JOIN (SELECT line_id, digits, price, discount FROM p WHERE discount <= 100
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY {sql_round("abs(price * q * (1 - discount / 100) - amount)", 4)}, price, discount) = 1) b ON b.line_id = l.line_id""",
    "parse_date_es": f"""SELECT line_id, {sql_date("FechaAlbaran")} AS date, {sql_date("FechaAlbaran", "-/.")} AS dotted,
  CAST(CAST(try_strptime({sql_date("FechaAlbaran", "-/.")}, '%d/%m/%Y') AS DATE) AS VARCHAR) AS day FROM detail_lines""",
    "date_from_code": """SELECT line_id, CASE WHEN regexp_matches(FechaAlbaran, '^[0-9]{2}/[0-9]{2}/20[0-9]{2}$') THEN FechaAlbaran ELSE '' END AS date FROM detail_lines""",
    "year_from_path": """WITH y AS (SELECT Pdf, AlbaranNumero, try_cast(substr(FechaAlbaran, 7, 4) AS INT) y, try_cast(regexp_extract(coalesce(AlbaranNumero, ''), '(20[0-9]{2})', 1) AS INT) n FROM note_meta)
SELECT Pdf, AlbaranNumero, CASE WHEN abs(n - y) <= 3 THEN n ELSE y END AS year FROM y""",
    "order_code_clean": f"WITH {_CODES} SELECT line_id, shape, {sql_noise(sql_clean('code'))} AS clean FROM codes",
    "order_code_truncate": f"WITH {_CODES} SELECT line_id, shape, {sql_truncate('code')} AS compact FROM codes",
    "order_code_normalize": _NORMALIZE,
    "order_code_suffix": f"""WITH {_CODES}, a AS (SELECT line_id, shape, regexp_replace(regexp_replace(upper(regexp_replace(coalesce(code, ''), '\\s+', '', 'g')), '^[1I]([0-9]{{6}})(/[A-Z])?$', 'A\\1\\2'),
  '^([AH])([0-9]{{6}})([A-Z][A-Z0-9]*)$', '\\1\\2/\\3') v FROM codes)
SELECT line_id, shape, CASE WHEN contains(v, '.') AND NOT (regexp_matches(v, '^[0-9]{{2}}\\.[0-9]{{3}}([-/][0-9]{{1,3}})?([-/][A-Z0-9]+)*$') OR regexp_matches(v, '^[0-9]{{2}}\\.[0-9]{{4,6}}(/[A-Z0-9]+)*$'))
  THEN '' ELSE regexp_replace(regexp_replace(v, '^[-:/ ]+', ''), '[-:/ ]+$', '') END AS kept FROM a""",
    "code_quality_score": f"WITH {_CODES}, q AS (SELECT line_id, shape, coalesce(code, '') v FROM codes), s AS (SELECT line_id, shape, {_QUALITY} score FROM q) SELECT line_id, shape, score, score >= 4 AS plausible FROM s",
    "note_plausibility": f"""SELECT line_id, {_NOTE} AS note, coalesce(length(regexp_replace(AlbaranNumero, '[^0-9]', '', 'g')) >= 5, FALSE) AS is_note,
  regexp_matches({_NOTE}, '^(19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$') AS is_date,
  regexp_matches(regexp_replace({_NOTE}, '[^0-9]', '', 'g'), '^10[0-9]{{7}}$') AS is_phone FROM detail_lines""",
    "date_words": f"""SELECT line_id, CASE WHEN try_strptime(FechaAlbaran, '%d/%m/%Y') IS NOT NULL AND regexp_matches(FechaAlbaran, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN FechaAlbaran
  ELSE {sql_date("FechaAlbaran")} END AS date, coalesce(nullif(trim(FechaAlbaran), ''), '-') AS given FROM detail_lines""",
    "fuzzy_decimals": f"""WITH t AS (SELECT line_id, string_split(trim(regexp_replace(translate(Descripcion, '05', 'OS'), '\\s+', ' ', 'g')), ' ') t FROM detail_lines),
u AS (SELECT line_id, unnest(range(len(t))) place, unnest(t) t FROM t),
v AS (SELECT line_id, place, CASE WHEN regexp_matches(t, '[0-9]') THEN translate(t, '{tx.GLYPHS[0]}', '{tx.GLYPHS[1]}') ELSE t END t FROM u)
SELECT line_id, CAST(place AS INT) AS place, round(CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE), 4) AS value FROM v WHERE regexp_matches(t, '^-?[0-9][0-9.]*,[0-9]{{1,4}}$')""",
    "quantity_blocks": """SELECT line_id, CAST(CAST(CantidadPedida AS DECIMAL(18, 2)) + CAST(CantidadServida AS DECIMAL(18, 2)) + CAST(CantidadPendiente AS DECIMAL(18, 2)) AS DOUBLE) AS total FROM detail_lines""",
    "line_guards": f"""WITH {LINES_SQL}, g AS (SELECT doc_id, line, {" OR ".join("(" + " AND ".join(f"contains({sql_fold('line')}, '{w}')" for w in ws) + ")" for ws in GUARDS)} guard,
  regexp_replace(line, '^(?:[|~_.,:;''*=\\-]+\\s*|[a-z]\\)\\s*)+', '') bare FROM lines)
SELECT doc_id, count(*) FILTER (guard) AS guards, sum(length(line) - length(bare)) AS noise FROM g GROUP BY doc_id""",
    "price_per_hundred": """SELECT line_id, round(CASE WHEN UnidadesPor = 100 AND Descripcion IS NOT NULL OR regexp_matches(coalesce(Descripcion, ''), '\\(100\\)|/C(?:$|[^\\p{L}\\p{N}_])|%\\s*U') THEN PrecioUnitario / 100 ELSE PrecioUnitario END, 6) AS price FROM detail_lines""",
}
