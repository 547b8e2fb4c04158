"""Pages of text: whose they are, what is missing on them, ranges, windows over lines, extraction, state between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelith.functions import numeric
from notelith.functions import text as tx
from notelith.operators import detection, extraction, pages, rows, stateful
from notelith.plans.layouts import LAYOUTS
from notelith.plans.scalar_queries import LINES_SQL, sql_date, sql_fold, sql_lines, sql_spaces
from notelith.runtime import durable, table

HEADS = [("_table", r"CODIGO.*IMPORTE", 1), ("_table", r"ART.*CANTIDAD.*PRECIO", 1), ("_note", r"ALBARAN.*HOJA", 1)]
FOOTER_WORDS = ["TOTAL", "IMPORTE", "QUEDAMOS", "ATENTAMENTE"]
TABLE_HINTS = ["CODIGO", "DESCRIPCION"]
REQUIRED = ["AlbaranNumero", "SuPedidoCodigo", "CantidadServida", "Importe"]
REFERENCE = ["AlbaranNumero", "FechaAlbaran", "SuPedidoCodigo"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.explode_lines(_docs(spark, sf_dir), ["doc_id"], "text")


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under their names and under the last word of them."""
    names = table(spark, sf_dir, "note_meta").select(F.col("Proveedor").alias("supplier")).distinct()
    short = names.select("supplier", F.element_at(F.split("supplier", " "), -1).alias("alias"))
    return detection.alias_table([names.select("supplier", F.col("supplier").alias("alias")), short])


def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = detection.alias_hits(_docs(spark, sf_dir), ["doc_id"], "text", durable(_aliases(spark, sf_dir)))
    structural = detection.window_hits(_all_lines(spark, sf_dir), ["doc_id"], HEADS)
    return detection.scores(hits, structural, ["doc_id"], {"Suministros Arkaldi": 1})


def detect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def detect_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).where("hits > 0")
    return detection.best(_docs(spark, sf_dir), scored, ["doc_id"])


GATES = {"Suministros Arkaldi": "ALBARAN|PEDIDO"}
HINTS = [("Electro Beltzuri", "IMPORTE|TOTAL", 2), ("Bombas Artzubiaga", "FIRMA", 1)]
NOBODY = "ABONO"


def detect_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection with a gate for one supplier's hits, hints of further words, and a phrase that makes a document nobody's."""
    docs = _docs(spark, sf_dir)
    hits = detection.alias_hits(docs, ["doc_id"], "text", durable(_aliases(spark, sf_dir)))
    hits = detection.gated(hits, docs, ["doc_id"], "text", GATES)
    scored = detection.scores(hits, detection.text_hits(docs, ["doc_id"], "text", HINTS), ["doc_id"], {"Suministros Arkaldi": 1})
    return detection.best(docs, scored, ["doc_id"], "text", NOBODY)


def extractor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they stand in catalogues, resolved to the extractors of note suppliers."""
    registry = table(spark, sf_dir, "note_meta").select(F.col("Proveedor").alias("supplier"), "Parser").distinct().withColumnRenamed("Parser", "parser")
    registry = registry.groupBy("supplier").agg(F.min("parser").alias("parser"))
    names = table(spark, sf_dir, "catalog_listings").select(F.col("Proveedor").alias("name"))
    shorter = names.unionByName(names.select(F.concat("name", F.lit(" S.L.")).alias("name"))).unionByName(names.select(F.concat(F.lit("X"), "name").alias("name")))
    return detection.resolve_extractor(shorter, registry)


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.window_hits(_all_lines(spark, sf_dir), ["doc_id"], HEADS)


def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on the pages that a run is asked for."""
    return pages.target_pages(table(spark, sf_dir, "note_meta"), "Pagina", "1, 3-4").select("Pdf", "Pagina", "Proveedor")


def registry_without_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' extractors without helpers."""
    known = table(spark, sf_dir, "note_meta").select(F.col("Proveedor").alias("supplier"), F.col("Parser").alias("parser")).distinct()
    helpers = known.select("supplier", F.concat(F.lit("_"), "parser").alias("parser"))
    return detection.registered(known.unionByName(helpers), ["SUR", "norte"])


def footer_page_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", pages.footer_only("text", TABLE_HINTS, FOOTER_WORDS).alias("footer"))


def sheet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pages.sheet_of("text")
    return _docs(spark, sf_dir).select("doc_id", s["sheet"].alias("sheet"), s["sheets"].alias("sheets"))


def required_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which neither the header nor any row has a required field; order codes count from six characters."""
    lines = table(spark, sf_dir, "detail_lines")
    ok = {
        "AlbaranNumero": ~rows.missing("AlbaranNumero"),
        "SuPedidoCodigo": ~rows.missing("SuPedidoCodigo") & (F.length(F.regexp_replace("SuPedidoCodigo", r"\s", "")) >= 6),
        "CantidadServida": F.col("CantidadServida").isNotNull(),
        "Importe": F.col("Importe").isNotNull(),
    }
    there = lines.groupBy("Pdf", "Pagina").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in ok.items()))
    lacks = F.array_join(F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in ok))), ",")
    return there.select("Pdf", "Pagina", lacks.alias("missing"))


def reference_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable value of each reference field, the page's header before its rows in order; what is missing."""
    meta = table(spark, sf_dir, "note_meta").select("Pdf", "Pagina", *REFERENCE, F.lit(0).cast("long").alias("o"))
    lines = table(spark, sf_dir, "detail_lines").select("Pdf", "Pagina", *REFERENCE, F.col("line_id").alias("o"))
    first = lambda f: F.min_by(F.when(~rows.missing(f), F.col(f)), F.when(~rows.missing(f), F.struct("o", f)))
    found = meta.unionByName(lines).groupBy("Pdf", "Pagina").agg(*(first(f).alias(f) for f in REFERENCE))
    lacks = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in REFERENCE))), ",")
    return found.select("Pdf", "Pagina", *REFERENCE, lacks.alias("missing"))


def noise_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pages.drop_noise(tx.lines_of("text"), r"^[^A-Za-z0-9]*$|^(?:Hoja|Fecha)", r"[0-9]{8}")
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).alias("kept"))


def stop_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between a table's head and the first line that ends it, with the sum of their last numbers."""
    folded = tx.fold_upper("line")
    head = folded.contains("CODIGO") & folded.contains("IMPORTE")
    end = folded.rlike("^(?:TOTAL|QUEDAMOS|ATENTAMENTE)")
    inside = pages.rows_between(_all_lines(spark, sf_dir), ["doc_id"], head, end)
    amount = F.element_at(tx.decimals_in("line"), -1)
    value = numeric.to_float_es(F.when(F.size(tx.decimals_in("line")) > 0, amount)).cast("decimal(18,4)")
    return inside.groupBy("doc_id").agg(F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("amount"))


def head_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three lines together hold a table's head: the place with least punctuation, then the first."""
    w = Window.partitionBy("doc_id").orderBy("ln")
    three = tx.fold_upper(F.concat_ws(" ", "line", F.lead("line", 1).over(w), F.lead("line", 2).over(w)))
    at = _all_lines(spark, sf_dir).select("doc_id", "ln", three.alias("w")).where(F.col("w").contains("CONCEPTO") | F.col("w").contains("DESCRIPCION"))
    marks = F.length(F.regexp_replace("w", r"[^.,;:|]", ""))
    return at.groupBy("doc_id").agg(F.min(F.struct(marks.alias("m"), "ln")).alias("b")).select("doc_id", F.col("b.ln").alias("ln"), F.col("b.m").alias("marks"))


def continuation_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that start with a code of eight digits, and the lines behind each."""
    found = rows.islands(_all_lines(spark, sf_dir), ["doc_id"], "ln", F.col("line").rlike("^[0-9]{8}"))
    return found.where("island > 0").groupBy("doc_id", "island").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at line starts: the first that isn't 1, and those that don't rise."""
    pos = F.regexp_extract("line", r"^([0-9]{1,3})[.):]", 1).try_cast("int")
    counted = _all_lines(spark, sf_dir).select("doc_id", "ln", pos.alias("pos")).where("pos is not null")
    w = Window.partitionBy("doc_id").orderBy("ln")
    marked = counted.withColumns({"before": F.lag("pos").over(w), "first": F.row_number().over(w) == 1})
    return marked.groupBy("doc_id").agg(F.max(F.col("first") & (F.col("pos") != 1)).alias("first_not_one"), F.count_if(F.col("pos") <= F.col("before")).alias("out_of_order"))


def lookahead_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines that end in a colon, the first number of eight digits within the three lines that follow."""
    code = F.nullif(F.regexp_extract("line", r"([0-9]{8})", 1), F.lit(""))
    found = _all_lines(spark, sf_dir).withColumn("value", rows.next_value(["doc_id"], "ln", code, 3))
    return found.where(F.col("line").endswith(":")).select("doc_id", "ln", "value")


def lookback_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines with an amount, the nearest line before that names a date."""
    day = F.nullif(F.regexp_extract("line", r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), F.lit(""))
    found = _all_lines(spark, sf_dir).withColumn("day", rows.last_value(["doc_id"], "ln", day, 80))
    return found.where(F.col("line").rlike("[0-9],[0-9]{2}$")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("day").alias("dated"), F.max("day").alias("latest"))


def trailing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last amount within a page's last three lines; the last match wins."""
    last = F.slice(tx.lines_of("text"), -3, 3)
    tail = F.when(F.size(tx.lines_of("text")) >= 3, F.array_join(last, "\n")).otherwise(F.array_join(tx.lines_of("text"), "\n"))
    found = _docs(spark, sf_dir).select("doc_id", tx.decimals_in(tail).alias("d"))
    return found.select("doc_id", F.when(F.size("d") > 0, F.element_at("d", -1)).alias("last"))


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page's numbers of seven to nine digits the best: longest first, then most frequent, then the least."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([0-9]{7,9})"), 1)
    one = _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    best = one.groupBy("doc_id").agg(F.min(F.struct((-F.length("c")).alias("l"), (-F.col("n")).alias("k"), "c")).alias("b"))
    return best.select("doc_id", F.col("b.c").alias("best"), (-F.col("b.k")).alias("times"))


def block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page's blocks of the rows behind each date, the one with most amounts; ties go to the first."""
    day = F.col("line").rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}")
    blocks = rows.islands(_all_lines(spark, sf_dir), ["doc_id"], "ln", day).where("island > 0")
    scored = blocks.groupBy("doc_id", "island").agg(F.count_if(F.col("line").rlike("[0-9],[0-9]{2}")).alias("score"), F.min("ln").alias("ln"))
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ln")).alias("b"))
    return best.select("doc_id", F.col("b.ln").alias("ln"), (-F.col("b.s")).alias("score"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's lines without numbers beside its lines with amounts, first with first."""
    lines = _all_lines(spark, sf_dir)
    texts = lines.where(~F.col("line").rlike("[0-9]")).select("doc_id", F.col("ln").alias("text_ln"))
    amounts = lines.where(F.col("line").rlike("[0-9],[0-9]{2}$")).select("doc_id", F.col("ln").alias("amount_ln"))
    return rows.zip_by_place(texts, amounts, ["doc_id"], ["text_ln"], ["amount_ln"])


def fifo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's clicks with their purchases, oldest with oldest."""
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), "ts")
    b = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("ts2"))
    return rows.zip_by_place(a, b, ["user_id"], ["ts", "click"], ["ts2", "purchase"]).select("user_id", "click", "purchase")


def class_a_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one shape: code;text;quantity;price;discount;amount."""
    p = r"^([^;]+);([^;]+);([0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+)$"
    g = lambda i: F.regexp_extract("line", p, i)
    hit = _all_lines(spark, sf_dir).where(F.col("line").rlike(p))
    return hit.select("doc_id", "ln", g(1).alias("code"), g(2).alias("text"), *(numeric.to_float_es(g(i)).alias(n) for i, n in ((3, "quantity"), (4, "price"), (5, "discount"), (6, "amount"))))


def class_b_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: note number, date, order code."""
    t = F.coalesce("text", F.lit(""))
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return _docs(spark, sf_dir).select(
        "doc_id", F.coalesce(first(r"Albar[áa]n ([0-9]{6,})"), first(r"albar[áa]n ([0-9]{6,})")).alias("note"),
        first(r"Fecha ([0-9]{2}/[0-9]{2}/[0-9]{4})").alias("date"), first(r"Su pedido ([0-9.]+)").alias("order_code"),
    )


def generic_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.generic_page(_docs(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.md5(F.col("description").cast("binary")).alias("description"), "amount", "warning")


def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.fallback_row(_docs(spark, sf_dir).withColumn("note", F.lit(None).cast("string")), ["doc_id"], "note")


def _with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first layout whose table head stands on them, else the one that needs no head."""
    folded = tx.fold_upper(F.coalesce("text", F.lit("")))
    pick = None
    for layout in LAYOUTS:
        if layout.kind == "rows" and len(layout.head) >= 3:
            hit = F.lit(True)
            for word in layout.head:
                hit = hit & F.col("_f").contains(word)
            pick = F.when(hit, layout.supplier) if pick is None else pick.when(hit, layout.supplier)
    return _docs(spark, sf_dir).withColumn("_f", folded).withColumn("supplier", pick.otherwise("ESMERALDA")).drop("_f")


def class_c_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine of all layouts over the whole corpus."""
    layouts = extraction.layout_table(spark, LAYOUTS)
    return extraction.extract_rows(_with_layout(spark, sf_dir), layouts, ["doc_id"])


def layout_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = extraction.layout_table(spark, LAYOUTS)
    return extraction.extract_pages(_with_layout(spark, sf_dir), layouts, ["doc_id"])


def _with_layout_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first layout whose head stands on one of their lines, else the one that needs no head."""
    with_head = [x for x in LAYOUTS if x.kind == "rows" and len(x.head) >= 3]
    return _docs(spark, sf_dir).withColumn("supplier", extraction.choose_layout("text", with_head, "ESMERALDA"))


def class_c_rows_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``class_c_rows``, whose SQL asks for a head's words anywhere in the document: here no document loses its rows for want of a head line."""
    layouts = extraction.layout_table(spark, LAYOUTS)
    return extraction.extract_rows(_with_layout_by_line(spark, sf_dir), layouts, ["doc_id"])


def layout_headers_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = extraction.layout_table(spark, LAYOUTS)
    return extraction.extract_pages(_with_layout_by_line(spark, sf_dir), layouts, ["doc_id"])


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.coalesce("text", F.lit("")), pages.sheet_of("text")
    return _docs(spark, sf_dir).select(
        "Pdf", "Pagina", F.nullif(F.regexp_extract(t, r"Albar[áa]n ([0-9]{6,})", 1), F.lit("")).alias("note"),
        F.size(F.regexp_extract_all(t, F.lit(r"([0-9],[0-9]{2})"), 1)).alias("items"), s["sheet"].alias("sheet"), s["sheets"].alias("sheets"),
        pages.footer_only("text", TABLE_HINTS, FOOTER_WORDS).alias("footer"),
    )


def carry_forward_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.carry_forward(_decided(spark, sf_dir), "Pdf", "Pagina", "note").select("Pdf", "Pagina", "carried")


def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, skipped or fallback, where each decision depends on those before."""
    return stateful.decide_pages(_decided(spark, sf_dir), "Pdf", "Pagina")


def pages_with_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts with the longest of several engines' texts merged in: two engines read each page's neighbour."""
    docs = _docs(spark, sf_dir).select("Pdf", "Pagina", "text")
    engine = lambda stage, shift: docs.select("Pdf", (F.col("Pagina") - shift).alias("Pagina"), "text", F.lit(stage).alias("stage"))
    best = pages.longest_by_engine(engine(1, 1).unionByName(engine(2, 2)).where("text is not null"), ["Pdf", "Pagina"])
    merged = pages.attach_recognised(docs, best, ["Pdf", "Pagina"])
    return merged.select("Pdf", "Pagina", F.length("text").alias("chars"), "ocr_applied")


QUERIES = {f.__name__: f for f in (
    alias_rules, target_pages, registry_without_helpers, detect_scores, detect_best, detect_guarded, extractor_resolution, line_pairs, footer_page_flag, sheet_numbers, required_fields_missing, reference_fields_missing,
    noise_line_filter, stop_range_rows, head_window, continuation_islands, position_checks, lookahead_value, lookback_value, trailing_lines, candidate_ranking,
    block_choice, positional_zip, fifo_pairing, class_a_rows, class_b_row, generic_extract, fallback_rows, class_c_rows, layout_headers, class_c_rows_by_line,
    layout_headers_by_line, carry_forward_note,
    page_decisions, pages_with_recognition,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------

_ALIASES = f"""names AS (SELECT DISTINCT Proveedor supplier FROM note_meta),
alias_all AS (SELECT supplier, upper({sql_fold(sql_spaces("supplier"))}) AS alias, 0 AS rk FROM names UNION ALL SELECT supplier, {sql_fold("string_split(supplier, ' ')[-1]")}, 1 FROM names),
aliases AS (SELECT alias, arg_min(supplier, (rk, supplier)) supplier FROM alias_all GROUP BY alias)"""

_PAIRS = f"""pairs AS (SELECT doc_id, {sql_fold("concat_ws(' ', line, lead(line) OVER (PARTITION BY doc_id ORDER BY ln))")} w FROM lines),
structural AS (SELECT doc_id, '_table' supplier, sum(CASE WHEN regexp_matches(w, 'CODIGO.*IMPORTE') OR regexp_matches(w, 'ART.*CANTIDAD.*PRECIO') THEN 1 ELSE 0 END) points FROM pairs GROUP BY doc_id
  UNION ALL SELECT doc_id, '_note', sum(CASE WHEN regexp_matches(w, 'ALBARAN.*HOJA') THEN 1 ELSE 0 END) FROM pairs GROUP BY doc_id)"""

#: The longest alias at a place wins there, as in the alternation: names hide their last word.
_SCORES = f"""WITH {_ALIASES}, {LINES_SQL}, {_PAIRS},
folded AS (SELECT doc_id, regexp_replace({sql_fold("coalesce(text, '')")}, '\\s+', ' ', 'g') t FROM documents),
longs AS (SELECT DISTINCT alias FROM aliases WHERE contains(alias, ' ')),
hits_long AS (SELECT doc_id, a.alias FROM folded f JOIN longs a ON contains(t, a.alias) AND regexp_matches(' ' || t || ' ', '[^A-Z0-9]' || a.alias || '[^A-Z0-9]')),
bare AS (SELECT f.doc_id, list_reduce(list_prepend(f.t, list_sort(list(h.alias) FILTER (h.alias IS NOT NULL), 'DESC')), lambda t, x: replace(t, x, '~')) t FROM folded f LEFT JOIN hits_long h ON h.doc_id = f.doc_id GROUP BY f.doc_id, f.t),
hits_short AS (SELECT doc_id, a.alias FROM bare f JOIN (SELECT alias FROM aliases WHERE NOT contains(alias, ' ')) a ON contains(t, a.alias) AND regexp_matches(' ' || t || ' ', '[^A-Z0-9]' || a.alias || '[^A-Z0-9]')),
hits AS (SELECT doc_id, supplier, count(*) hits FROM (SELECT * FROM hits_long UNION ALL SELECT * FROM hits_short) h JOIN aliases a ON a.alias = h.alias GROUP BY ALL),
both_ AS (SELECT doc_id, supplier, hits, 0 points FROM hits UNION ALL SELECT doc_id, supplier, 0, points FROM structural WHERE points > 0),
scored AS (SELECT doc_id, supplier, CAST(sum(hits) AS BIGINT) hits, CAST(sum(hits) * 6 + sum(points) - CASE WHEN supplier = 'Suministros Arkaldi' THEN 1 ELSE 0 END AS BIGINT) score FROM both_ GROUP BY doc_id, supplier)"""

_DECIDED = f"""decided AS (SELECT Pdf, Pagina, nullif(regexp_extract(coalesce(text, ''), 'Albar[áa]n ([0-9]{{6,}})', 1), '') note FROM documents)"""
_MISS = "coalesce(upper(trim({f})) IN ('', 'NAN', 'NONE', 'NULL', 'NAT'), TRUE)"


def _ok(f: str) -> str:
    return "NOT " + _MISS.format(f=f)




def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _layout_values() -> str:
    """The layouts as rows of (supplier, kind, head, stop, row, warning, note, order_code, total, orders)."""
    rows_ = []
    for layout in LAYOUTS:
        supplier, kind, head, stop, row, _, warning, note, code, total, orders = layout.row()
        words = "[" + ", ".join(map(_sql_text, head)) + "]::VARCHAR[]"
        maps = "MAP {" + ", ".join(f"{n}: [{', '.join(map(_sql_text, names))}]" for n, names in orders.items()) + "}"
        rows_.append(f"({_sql_text(supplier)}, {_sql_text(kind)}, {words}, {', '.join(map(_sql_text, (stop, row, warning, note, code, total)))}, {maps})")
    return "layouts(supplier, kind, head, stop, row_, warning, note_, code_, total_, orders) AS (VALUES " + ",\n".join(rows_) + ")"


_PICK = "CASE " + " ".join(
    "WHEN " + " AND ".join(f"contains(f, '{w}')" for w in x.head) + f" THEN {_sql_text(x.supplier)}" for x in LAYOUTS if x.kind == "rows" and len(x.head) >= 3
) + " ELSE 'ESMERALDA' END"
_FLAT = r"""regexp_replace(regexp_replace(regexp_replace({x}, '","|",|,"', ' ', 'g'), '[|;\t"]', ' ', 'g'), '\s+', ' ', 'g')"""
_LAYOUT_ROWS = f"""
WITH {_layout_values()},
picked AS (SELECT doc_id, text, {_PICK} supplier FROM (SELECT *, {sql_fold("coalesce(text, '')")} f FROM documents)),
l0 AS (SELECT doc_id, supplier, unnest(range(len(l))) ln, unnest(l) line FROM (SELECT doc_id, supplier, {sql_lines("replace(text, chr(9), ' ; ')")} l FROM picked)),
l1 AS (SELECT l0.* EXCLUDE (line), y.* EXCLUDE (supplier), trim({_FLAT.format(x="line")}) line FROM l0 JOIN layouts y ON y.supplier = l0.supplier AND y.kind = 'rows'),
l2 AS (SELECT *, {sql_fold("line")} f FROM l1),
l3 AS (SELECT *, CASE WHEN len(head) = 0 THEN -1 ELSE min(ln) FILTER (len(head) > 0 AND len(list_filter(head, lambda w: NOT contains(f, w))) = 0) OVER (PARTITION BY doc_id) END a FROM l2),
l4 AS (SELECT *, min(ln) FILTER (ln > a AND regexp_matches(f, stop)) OVER (PARTITION BY doc_id) b FROM l3),
l5 AS (SELECT *, regexp_extract(line, row_, 1) <> '' is_row FROM l4 WHERE ln > a AND (b IS NULL OR ln < b)),
l6 AS (SELECT *, sum(CASE WHEN is_row THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) item FROM l5),
g AS (SELECT doc_id, supplier, item, max(line) FILTER (is_row) line, any_value(row_) row_, any_value(warning) warning, any_value(orders) orders,
  array_to_string(list(line ORDER BY ln) FILTER (NOT is_row), ' ') more FROM l6 WHERE item > 0 GROUP BY doc_id, supplier, item),
n AS (SELECT *, string_split(trim(regexp_extract(line, row_, 3)), ' ') n FROM g),
o AS (SELECT *, orders[len(n)] names FROM n),
v AS (SELECT *, {", ".join(f"try_cast(replace(replace(n[list_position(names, '{x}')], '.', ''), ',', '.') AS DOUBLE) v_{x}" for x in extraction.FIELDS)} FROM o)
SELECT doc_id, supplier, item, regexp_extract(line, row_, 1) AS code, concat_ws(' ', regexp_extract(line, row_, 2), nullif(more, '')) AS description,
  {", ".join((f"v_{x}" if x != "quantity" else "coalesce(v_quantity, greatest(v_asked - v_pending, CASE WHEN v_asked - v_pending IS NULL THEN NULL ELSE 0 END))") + f" AS {x}" for x in extraction.FIELDS)}, warning FROM v
"""
_LAYOUT_PAGES = f"""
WITH {_layout_values()},
picked AS (SELECT doc_id, f, {_PICK} supplier FROM (SELECT *, {sql_fold("coalesce(text, '')")} f FROM documents))
SELECT doc_id, p.supplier, kind, nullif(regexp_extract(f, note_, 1), '') AS note, nullif(regexp_extract(f, code_, 1), '') AS order_code, nullif({sql_date("f")}, '') AS date,
  try_cast(replace(replace(nullif(regexp_extract(f, total_, 1), ''), '.', ''), ',', '.') AS DOUBLE) AS total, warning FROM picked p JOIN layouts y ON y.supplier = p.supplier
"""
_LINES_FOLDED = f"""list_transform({sql_lines("replace(text, chr(9), ' ; ')")}, lambda z: {sql_fold(f'trim({_FLAT.format(x="z")})')})"""
_PICK_BY_LINE = "CASE " + " ".join(
    "WHEN len(list_filter(fl, lambda z: " + " AND ".join(f"contains(z, '{w}')" for w in x.head) + f")) > 0 THEN {_sql_text(x.supplier)}" for x in LAYOUTS if x.kind == "rows" and len(x.head) >= 3
) + " ELSE 'ESMERALDA' END"
_BY_LINE = f"""picked AS (SELECT doc_id, text, f, {_PICK_BY_LINE} supplier FROM (SELECT *, {sql_fold("coalesce(text, '')")} f, {_LINES_FOLDED} fl FROM documents))"""


def _by_line(sql: str) -> str:
    """The SQL with documents picked by single lines."""
    return "\n".join(_BY_LINE + ("," if x.endswith(",") else "") if x.startswith("picked AS ") else x for x in sql.split("\n"))


_DECISIONS = f"""
WITH RECURSIVE f AS (SELECT *, {sql_fold("coalesce(text, '')")} t FROM documents),
p AS (SELECT Pdf, Pagina, nullif(regexp_extract(coalesce(text, ''), 'Albar[áa]n ([0-9]{{6,}})', 1), '') note, len(regexp_extract_all(coalesce(text, ''), '([0-9],[0-9]{{2}})', 1)) items,
  try_cast(regexp_extract(coalesce(text, ''), '(?i)hoja\\s+([0-9]+)\\s*(?:/|de)\\s*([0-9]+)', 1) AS INT) sheet, try_cast(regexp_extract(coalesce(text, ''), '(?i)hoja\\s+([0-9]+)\\s*(?:/|de)\\s*([0-9]+)', 2) AS INT) sheets,
  NOT ({" OR ".join(f"contains(t, '{h}')" for h in TABLE_HINTS)}) AND ({" + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in FOOTER_WORDS)}) >= 2 footer, row_number() OVER (PARTITION BY Pdf ORDER BY Pagina) n FROM f),
r AS (SELECT Pdf, CAST(0 AS BIGINT) n, CAST(NULL AS INT) Pagina, CAST(NULL AS VARCHAR) decision, CAST(NULL AS VARCHAR) note, CAST(NULL AS VARCHAR) last FROM (SELECT DISTINCT Pdf FROM p)
  UNION ALL SELECT q.Pdf, q.n, q.Pagina, d, coalesce(q.note, q.last), CASE WHEN d = 'skipped' THEN q.last ELSE coalesce(q.note, q.last) END FROM (
    SELECT p.*, r.last, CASE WHEN p.items > 0 THEN 'rows' WHEN coalesce(p.sheet = p.sheets AND p.note = r.last, FALSE) THEN 'skipped'
      WHEN coalesce(p.footer AND r.last IS NOT NULL AND p.sheet = p.sheets AND p.sheets >= 2, FALSE) THEN 'skipped' ELSE 'fallback' END d FROM r JOIN p ON p.Pdf = r.Pdf AND p.n = r.n + 1) q)
SELECT Pdf, Pagina, decision, note FROM r WHERE n > 0
"""

SQL = {
    "page_decisions": _DECISIONS,
    "class_c_rows": _LAYOUT_ROWS,
    "layout_headers": _LAYOUT_PAGES,
    "class_c_rows_by_line": _by_line(_LAYOUT_ROWS),
    "layout_headers_by_line": _by_line(_LAYOUT_PAGES),
    "alias_rules": f"WITH {_ALIASES} SELECT supplier, alias FROM aliases",
    "detect_scores": _SCORES + " SELECT doc_id, supplier, hits, score FROM scored",
    "target_pages": "SELECT Pdf, Pagina, Proveedor FROM note_meta WHERE Pagina = 1 OR Pagina BETWEEN 3 AND 4",
    "registry_without_helpers": "SELECT DISTINCT Proveedor AS supplier, Parser AS parser FROM note_meta WHERE lower(Parser) NOT IN ('sur', 'norte') AND NOT starts_with(Parser, '_')",
    "detect_guarded": _SCORES + f""", gates(supplier, pattern) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GATES.items())}),
hints(supplier, pattern, points) AS (VALUES {", ".join(f"('{a}', '{b}', {n})" for a, b, n in HINTS)}),
open_hits AS (SELECT h.* FROM hits h JOIN folded f ON f.doc_id = h.doc_id LEFT JOIN gates g ON g.supplier = h.supplier WHERE g.pattern IS NULL OR regexp_matches(t, g.pattern)),
all_points AS (SELECT doc_id, supplier, hits, 0 points FROM open_hits UNION ALL SELECT doc_id, supplier, 0, points FROM folded JOIN hints ON regexp_matches(t, pattern)),
ranked AS (SELECT doc_id, supplier, sum(hits) h, sum(hits) * 6 + sum(points) - CASE WHEN supplier = 'Suministros Arkaldi' THEN 1 ELSE 0 END s FROM all_points GROUP BY doc_id, supplier),
top AS (SELECT doc_id, supplier FROM ranked WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, s DESC, supplier) = 1)
SELECT f.doc_id, CASE WHEN regexp_matches(t, '{NOBODY}') THEN 'DESCONOCIDO' ELSE coalesce(supplier, 'DESCONOCIDO') END AS detected FROM folded f LEFT JOIN top ON top.doc_id = f.doc_id""",
    "detect_best": _SCORES
    + """, top AS (SELECT doc_id, supplier FROM scored WHERE hits > 0 AND score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, score DESC, supplier) = 1)
SELECT d.doc_id, coalesce(supplier, 'DESCONOCIDO') AS detected FROM documents d LEFT JOIN top t ON t.doc_id = d.doc_id""",
    "extractor_resolution": """WITH reg AS (SELECT upper(Proveedor) s, min(Parser) p FROM note_meta GROUP BY 1),
n0 AS (SELECT DISTINCT Proveedor n FROM catalog_listings), names AS (SELECT n FROM n0 UNION SELECT n || ' S.L.' FROM n0 UNION SELECT 'X' || n FROM n0),
e AS (SELECT n, p FROM names LEFT JOIN reg ON s = upper(n)),
near AS (SELECT n, arg_min(reg.p, (-length(s), s)) q FROM e JOIN reg ON e.p IS NULL AND (contains(upper(n), s) OR contains(s, upper(n)))
  AND len(list_intersect(string_split(upper(n), ' '), string_split(s, ' '))) > 0 GROUP BY n)
SELECT e.n AS name, coalesce(p, q, 'generic') AS parser FROM e LEFT JOIN near ON near.n = e.n""",
    "line_pairs": f"WITH {LINES_SQL}, {_PAIRS} SELECT doc_id, supplier, CAST(points AS BIGINT) AS points FROM structural WHERE points > 0",
    "footer_page_flag": f"""WITH f AS (SELECT doc_id, {sql_fold("coalesce(text, '')")} t FROM documents) SELECT doc_id, NOT ({" OR ".join(f"contains(t, '{h}')" for h in TABLE_HINTS)})
  AND ({" + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in FOOTER_WORDS)}) >= 2 AS footer FROM f""",
    "sheet_numbers": "SELECT doc_id, "
    + ", ".join(f"try_cast(regexp_extract(coalesce(text, ''), '(?i)hoja\\s+([0-9]+)\\s*(?:/|de)\\s*([0-9]+)', {i}) AS INT) AS {n}" for i, n in ((1, "sheet"), (2, "sheets")))
    + " FROM documents",
    "required_fields_missing": f"""WITH p AS (SELECT Pdf, Pagina, bool_or({_ok("AlbaranNumero")}) a, bool_or({_ok("SuPedidoCodigo")} AND length(regexp_replace(SuPedidoCodigo, '\\s', '', 'g')) >= 6) s,
  bool_or(CantidadServida IS NOT NULL) q, bool_or(Importe IS NOT NULL) i FROM detail_lines GROUP BY ALL)
SELECT Pdf, Pagina, concat_ws(',', CASE WHEN NOT coalesce(a, FALSE) THEN 'AlbaranNumero' END, CASE WHEN NOT coalesce(s, FALSE) THEN 'SuPedidoCodigo' END, CASE WHEN NOT q THEN 'CantidadServida' END, CASE WHEN NOT i THEN 'Importe' END) AS missing FROM p""",
    "reference_fields_missing": f"""WITH u AS (SELECT Pdf, Pagina, {", ".join(REFERENCE)}, 0 o FROM note_meta UNION ALL SELECT Pdf, Pagina, {", ".join(REFERENCE)}, line_id FROM detail_lines),
f AS (SELECT Pdf, Pagina, {", ".join(f"arg_min({f}, (o, {f})) FILTER ({_ok(f)}) AS {f}" for f in REFERENCE)} FROM u GROUP BY ALL)
SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in REFERENCE)}) AS missing FROM f""",
    "noise_line_filter": f"""SELECT doc_id, CAST(len(list_filter({sql_lines("text")}, lambda z: NOT (regexp_matches(z, '^[^A-Za-z0-9]*$|^(?:Hoja|Fecha)') AND NOT regexp_matches(z, '[0-9]{{8}}')))) AS INT) AS kept FROM documents""",
    "stop_range_rows": f"""WITH {LINES_SQL}, m AS (SELECT *, min(ln) FILTER (contains({sql_fold("line")}, 'CODIGO') AND contains({sql_fold("line")}, 'IMPORTE')) OVER (PARTITION BY doc_id) f FROM lines),
n AS (SELECT *, min(ln) FILTER (regexp_matches({sql_fold("line")}, '^(?:TOTAL|QUEDAMOS|ATENTAMENTE)') AND ln > f) OVER (PARTITION BY doc_id) t FROM m)
SELECT doc_id, count(*) AS rows, CAST(coalesce(sum(CAST(replace(replace(regexp_extract_all(line, '(-?[0-9][0-9.]*,[0-9]+)', 1)[-1], '.', ''), ',', '.') AS DECIMAL(18, 4))), 0) AS DOUBLE) AS amount
FROM n WHERE ln > f AND (t IS NULL OR ln < t) GROUP BY doc_id""",
    "head_window": f"""WITH {LINES_SQL}, w AS (SELECT doc_id, ln, {sql_fold("concat_ws(' ', line, lead(line, 1) OVER v, lead(line, 2) OVER v)")} w FROM lines WINDOW v AS (PARTITION BY doc_id ORDER BY ln)),
h AS (SELECT doc_id, ln, length(regexp_replace(w, '[^.,;:|]', '', 'g')) m FROM w WHERE contains(w, 'CONCEPTO') OR contains(w, 'DESCRIPCION'))
SELECT doc_id, CAST(ln AS INT) AS ln, m AS marks FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m, ln) = 1""",
    "continuation_islands": f"""WITH {LINES_SQL}, i AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]{{8}}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) island FROM lines)
SELECT doc_id, island, count(*) AS lines, sum(length(line)) AS chars FROM i WHERE island > 0 GROUP BY doc_id, island""",
    "position_checks": f"""WITH {LINES_SQL}, p AS (SELECT doc_id, ln, try_cast(regexp_extract(line, '^([0-9]{{1,3}})[.):]', 1) AS INT) pos FROM lines),
q AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY ln) b, row_number() OVER (PARTITION BY doc_id ORDER BY ln) r FROM p WHERE pos IS NOT NULL)
SELECT doc_id, bool_or(r = 1 AND pos <> 1) AS first_not_one, count(*) FILTER (pos <= b) AS out_of_order FROM q GROUP BY doc_id""",
    "lookahead_value": f"""WITH {LINES_SQL}, v AS (SELECT doc_id, ln, line, nullif(regexp_extract(line, '([0-9]{{8}})', 1), '') c FROM lines),
w AS (SELECT *, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS value FROM v)
SELECT doc_id, CAST(ln AS INT) AS ln, value FROM w WHERE line LIKE '%:'""",
    "lookback_value": f"""WITH {LINES_SQL}, v AS (SELECT doc_id, ln, line, nullif(regexp_extract(line, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})', 1), '') d FROM lines),
w AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT doc_id, count(*) AS lines, count(p) AS dated, max(p) AS latest FROM w WHERE regexp_matches(line, '[0-9],[0-9]{{2}}$') GROUP BY doc_id""",
    "trailing_lines": f"""WITH l AS (SELECT doc_id, {sql_lines("text")} l FROM documents)
SELECT doc_id, regexp_extract_all(array_to_string(l[-3:], chr(10)), '(-?[0-9][0-9.]*,[0-9]+)', 1)[-1] AS last FROM l""",
    "candidate_ranking": """WITH c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '([0-9]{7,9})', 1)) c FROM documents), n AS (SELECT doc_id, c, count(*) n FROM c GROUP BY ALL)
SELECT doc_id, c AS best, n AS times FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(c) DESC, n DESC, c) = 1""",
    "block_choice": f"""WITH {LINES_SQL}, i AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) island FROM lines),
s AS (SELECT doc_id, island, count(*) FILTER (regexp_matches(line, '[0-9],[0-9]{{2}}')) score, min(ln) ln FROM i WHERE island > 0 GROUP BY doc_id, island)
SELECT doc_id, CAST(ln AS INT) AS ln, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ln) = 1""",
    "positional_zip": f"""WITH {LINES_SQL}, a AS (SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) place FROM lines WHERE NOT regexp_matches(line, '[0-9]')),
b AS (SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) place FROM lines WHERE regexp_matches(line, '[0-9],[0-9]{{2}}$'))
SELECT a.doc_id, CAST(a.place AS INT) AS place, CAST(a.ln AS INT) AS text_ln, CAST(b.ln AS INT) AS amount_ln FROM a JOIN b ON b.doc_id = a.doc_id AND b.place = a.place""",
    "fifo_pairing": """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events WHERE event_type = 'purchase')
SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM a JOIN b ON b.user_id = a.user_id AND b.p = a.p""",
    "class_a_rows": f"""WITH {LINES_SQL}, r AS (SELECT doc_id, ln, regexp_extract(line, '^([^;]+);([^;]+);([0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+)$', ['c', 't', 'q', 'p', 'd', 'a']) g FROM lines
  WHERE regexp_matches(line, '^([^;]+);([^;]+);([0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+);([0-9.]+,[0-9]+)$'))
SELECT doc_id, CAST(ln AS INT) AS ln, g.c AS code, g.t AS text, {", ".join(f"CAST(replace(replace(g.{x}, '.', ''), ',', '.') AS DOUBLE) AS {n}" for x, n in (("q", "quantity"), ("p", "price"), ("d", "discount"), ("a", "amount")))} FROM r""",
    "class_b_row": """SELECT doc_id, coalesce(nullif(regexp_extract(coalesce(text, ''), 'Albar[áa]n ([0-9]{6,})', 1), ''), nullif(regexp_extract(coalesce(text, ''), 'albar[áa]n ([0-9]{6,})', 1), '')) AS note,
  nullif(regexp_extract(coalesce(text, ''), 'Fecha ([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '') AS date, nullif(regexp_extract(coalesce(text, ''), 'Su pedido ([0-9.]+)', 1), '') AS order_code FROM documents""",
    "generic_extract": f"""WITH d AS (SELECT doc_id, coalesce(text, '') t, {sql_lines("text")} l FROM documents),
a AS (SELECT doc_id, l, coalesce(nullif(regexp_extract(t, '(?i)total[^0-9]{{0,30}}([0-9][0-9.]*,[0-9]{{2}})', 1), ''), regexp_extract_all(t, '(-?[0-9][0-9.]*,[0-9]+)', 1)[-1]) x FROM d)
SELECT doc_id, md5(coalesce(array_to_string(l[1:10], ' '), '')) AS description, try_cast(replace(replace(x, '.', ''), ',', '.') AS DOUBLE) AS amount, 'GENERIC_PARSER_USED' AS warning FROM a""",
    "fallback_rows": f"""WITH d AS (SELECT doc_id, text, {sql_fold("coalesce(text, '')")} t FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(t, 'ALBARAN\\s*(?:N\\S*)?\\s*[:#-]?\\s*([A-Z0-9/-]*[0-9]{{5,}}[A-Z0-9/-]*)', 1), ''), nullif(regexp_extract(t, '(?:^|[^0-9])([0-9]{{6,}})(?:$|[^0-9])', 1), ''), '') AS AlbaranNumero,
  {sql_date("text")} AS FechaAlbaran, coalesce(try_cast(replace(replace(regexp_extract(t, 'SUBTOTAL[^0-9]{{0,30}}([0-9]{{1,3}}(?:\\.[0-9]{{3}})*,[0-9]{{2}})', 1), '.', ''), ',', '.') AS DOUBLE), 0) AS Importe, 'fallback_no_parse' AS ParseWarn FROM d""",
    "carry_forward_note": f"WITH {_DECIDED} SELECT Pdf, Pagina, last_value(note IGNORE NULLS) OVER (PARTITION BY Pdf ORDER BY Pagina ROWS UNBOUNDED PRECEDING) AS carried FROM decided",
    "pages_with_recognition": f"""WITH e AS (SELECT Pdf, Pagina - 1 AS Pagina, text, 1 s FROM documents UNION ALL SELECT Pdf, Pagina - 2, text, 2 FROM documents),
b AS (SELECT Pdf, Pagina, arg_max(text, (length(text), -s)) o FROM e WHERE text IS NOT NULL GROUP BY Pdf, Pagina),
j AS (SELECT d.Pdf, d.Pagina, coalesce(d.text, '') a, coalesce(b.o, '') x, b.o IS NOT NULL ocr FROM documents d LEFT JOIN b ON b.Pdf = d.Pdf AND b.Pagina = d.Pagina),
t AS (SELECT *, regexp_replace(regexp_replace(a, '^{tx.WS}+', ''), '{tx.WS}+$', '') ta, regexp_replace(regexp_replace(x, '^{tx.WS}+', ''), '{tx.WS}+$', '') tb FROM j)
SELECT Pdf, Pagina, length(CASE WHEN tb = '' THEN a WHEN ta = '' THEN tb WHEN contains(ta, tb) THEN ta ELSE ta || chr(10) || tb END) AS chars, ocr AS ocr_applied FROM t""",
}
