"""From a page's lines to rows: layouts are data, one engine applies them.

A layout says where a supplier's table starts and stops, what a row looks like, in which order its numbers stand for each
count of them, and which header fields a page carries. Layouts are a small table that is joined to the pages by supplier;
the patterns are then columns, so all suppliers are extracted in one pass.

Classes of layout: ``rows`` (one line a row, further lines continue its text), ``page`` (one row a page), ``generic`` (any
page: the text of its first lines and the last amount on it).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelith.functions import dates, numeric
from notelith.functions import text as tx
from notelith.operators.pages import explode_lines

CODE = r"(?:[A-Z]{2,3} [0-9]{2} [0-9]{3,5}|[A-Z0-9][A-Z0-9./-]{2,})"
NUMBER = r"-?[0-9][0-9.]*(?:,[0-9]+)?"
#: Orders of the numbers at the end of a row, by how many there are.
NUMBER_ORDERS = {
    1: ["quantity"],
    2: ["quantity", "amount"],
    3: ["quantity", "price", "amount"],
    4: ["quantity", "price", "discount", "amount"],
    5: ["quantity", "per", "price", "discount", "amount"],
    6: ["asked", "quantity", "per", "price", "discount", "amount"],
    7: ["asked", "quantity", "pending", "per", "price", "discount", "amount"],
}
FIELDS = ["asked", "quantity", "pending", "per", "price", "fee", "discount", "amount"]
LAYOUT_SCHEMA = "supplier string, kind string, head array<string>, stop string, row string, min_numbers int, warning string, note string, order_code string, total string, orders map<int,array<string>>"


@dataclass(frozen=True)
class Layout:
    supplier: str
    kind: str = "rows"
    #: Words of the table's head, all on one folded line; none: the table starts with the page.
    head: tuple[str, ...] = ()
    stop: tuple[str, ...] = ("TOTAL", "BASE IMPONIBLE", "SUMA Y SIGUE")
    code: str = CODE
    min_numbers: int = 1
    warning: str = ""
    note: str = r"ALBARAN\s*(?:N\S*)?\s*[:#-]?\s*([A-Z0-9/-]*[0-9]{3,}[A-Z0-9/-]*)"
    order_code: str = r"PEDIDO\s*[:#-]?\s*([0-9A-Z][0-9A-Z./-]{3,})"
    total: str = r"\b(?:TOTAL|BASE IMPONIBLE|NETO)\b\D{0,30}([0-9][0-9.]*,[0-9]{2})"
    #: Orders of numbers that differ from the usual ones.
    orders: dict[int, list[str]] = field(default_factory=dict)

    def row(self) -> tuple:
        pattern = rf"^(?:[0-9]{{1,3}} )?({self.code}) (.+?)((?: {NUMBER}){{{self.min_numbers},7}})(?: ?(?:€|EUR))?$"
        return (self.supplier, self.kind, list(self.head), "|".join(self.stop), pattern, self.min_numbers, self.warning, self.note, self.order_code, self.total, NUMBER_ORDERS | self.orders)


def layout_table(spark: SparkSession, layouts: list[Layout]) -> DataFrame:
    return spark.createDataFrame([x.row() for x in layouts], LAYOUT_SCHEMA)


def flatten_separators(c: Column | str) -> Column:
    """Rows with bars, semicolons, tabs or quoted commas become rows with blanks."""
    out = F.regexp_replace(tx.col(c), r'","|",|,"', " ")
    out = F.regexp_replace(out, r'[|;\t"]', " ")
    return tx.trim_ws(F.regexp_replace(out, r"\s+", " "))


def choose_layout(text: Column | str, layouts: list[Layout], default: str) -> Column:
    """The first of the layouts whose head stands on one line, read as ``extract_rows`` reads it; else the default, which needs no head."""
    folded = F.transform(tx.lines_of(F.regexp_replace(tx.col(text), "\t", " ; ")), lambda x: tx.fold_upper(flatten_separators(x)))

    def on_one_line(lines: Column, head: tuple[str, ...]) -> Column:
        return F.exists(lines, lambda line: reduce(lambda a, b: a & b, (line.contains(word) for word in head)))

    return tx.let(folded, lambda lines: F.coalesce(*(F.when(on_one_line(lines, x.head), F.lit(x.supplier)) for x in layouts if x.head), F.lit(default)))


def _group(text: Column, pattern: Column, i: int) -> Column:
    """A group of a pattern that is itself a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(i))


def _number_at(numbers: Column, orders: Column, name: str) -> Column:
    """The number of a name by the layout's order for their count."""
    at = F.array_position(F.try_element_at(orders, F.size(numbers)), name)
    return F.when(at > 0, numeric.to_float_es(F.get(numbers, (at - 1).cast("int"))))


def extract_rows(pages: DataFrame, layouts: DataFrame, key: list[str], supplier: str = "supplier", text: str = "text") -> DataFrame:
    """(key..., item, code, description, numbers..., warning) of all pages whose supplier has a layout of rows.

    The lines of a page come together by its key; numbers at the end of a line are read by their count, lines without a
    row's shape go to the description of the row before.
    """
    flat = pages.select(*key, F.col(supplier).alias("supplier"), F.regexp_replace(F.col(text), "\t", " ; ").alias("text"))
    lines = explode_lines(flat, [*key, "supplier"], "text")
    table = lines.join(layouts.where("kind = 'rows'"), "supplier").withColumns({"line": flatten_separators("line")})
    folded = tx.fold_upper("line")
    w = Window.partitionBy(*key)
    starts = (F.size("head") > 0) & F.forall("head", lambda word: folded.contains(word))
    from_ = F.when(F.size("head") == 0, F.lit(-1)).otherwise(F.min(F.when(starts, F.col("ln"))).over(w))
    table = table.withColumn("_from", from_)
    stops = (F.col("ln") > F.col("_from")) & F.call_function("rlike", folded, F.col("stop"))
    table = table.withColumn("_to", F.min(F.when(stops, F.col("ln"))).over(w))
    inside = table.where((F.col("ln") > F.col("_from")) & (F.col("_to").isNull() | (F.col("ln") < F.col("_to"))))
    is_row = _group(F.col("line"), F.col("row"), 1) != ""
    order = w.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    counted = inside.withColumns({"is_row": is_row, "item": F.sum(F.when(is_row, 1).otherwise(0)).over(order)}).where("item > 0")
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_row"), F.struct("ln", "line")))), lambda x: x["line"]), " ")
    merged = counted.groupBy(*key, "supplier", "item").agg(F.max(F.when(F.col("is_row"), F.struct("line", "row", "warning"))).alias("r"), F.any_value("orders").alias("orders"), more.alias("more"))
    part = lambda i: _group(F.col("r.line"), F.col("r.row"), i)
    read = merged.select(*key, "supplier", "item", part(1).alias("code"), part(2).alias("d"), F.split(F.trim(part(3)), " ").alias("n"), "more", "orders", F.col("r.warning").alias("warning"))
    values = {f: _number_at(F.col("n"), F.col("orders"), f) for f in FIELDS}
    # Forms that give what was asked for and what is still to come.
    values["quantity"] = F.coalesce(values["quantity"], F.greatest(values["asked"] - values["pending"], F.lit(0.0)))
    return read.select(
        *key, "supplier", "item", "code", F.concat_ws(" ", "d", F.nullif("more", F.lit(""))).alias("description"),
        *(c.alias(f) for f, c in values.items()), "warning",
    )


def extract_pages(pages: DataFrame, layouts: DataFrame, key: list[str], supplier: str = "supplier", text: str = "text") -> DataFrame:
    """(key..., supplier, note, order_code, date, total) of every page: the header fields, or the one row of a page layout."""
    folded = tx.fold_upper(F.coalesce(F.col(text), F.lit("")))
    joined = pages.select(*key, F.col(supplier).alias("supplier"), folded.alias("_t")).join(layouts, "supplier")
    first = lambda p: F.nullif(_group(F.col("_t"), F.col(p), 1), F.lit(""))
    return joined.select(
        *key, "supplier", "kind", first("note").alias("note"), first("order_code").alias("order_code"),
        F.nullif(dates.parse_date_es("_t"), F.lit("")).alias("date"), numeric.to_float_es(first("total")).alias("total"), "warning",
    )


def generic_page(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Any page: its first ten lines as description, the total beside the word, else the last amount on the page."""
    t = F.coalesce(F.col(text), F.lit(""))
    total = F.nullif(F.regexp_extract(t, r"(?i)total[^0-9]{0,30}([0-9][0-9.]*,[0-9]{2})", 1), F.lit(""))
    last = F.element_at(tx.decimals_in(t), -1)
    last = F.when(F.size(tx.decimals_in(t)) > 0, last)
    return pages.select(
        *key, F.array_join(F.slice(tx.lines_of(text), 1, 10), " ").alias("description"),
        numeric.to_float_es(F.coalesce(total, last)).alias("amount"), F.lit("GENERIC_PARSER_USED").alias("warning"),
    )


def fallback_row(pages: DataFrame, key: list[str], note: str, text: str = "text") -> DataFrame:
    """A page that gave no rows: one row with what its text says, marked for review."""
    folded = tx.fold_upper(F.coalesce(F.col(text), F.lit("")))
    found = tx.first_match(folded, [r"ALBARAN\s*(?:N\S*)?\s*[:#-]?\s*([A-Z0-9/-]*[0-9]{5,}[A-Z0-9/-]*)", r"(?:^|[^0-9])([0-9]{6,})(?:$|[^0-9])"])
    good = F.length(F.regexp_replace(F.coalesce(F.col(note), F.lit("")), "[^0-9]", "")) >= 5
    subtotal = numeric.to_float_es(F.nullif(F.regexp_extract(folded, r"SUBTOTAL[^0-9]{0,30}([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})", 1), F.lit("")))
    return pages.select(
        *key, F.when(good, F.col(note)).otherwise(found).alias("AlbaranNumero"), dates.parse_date_es(text).alias("FechaAlbaran"),
        F.coalesce(subtotal, F.lit(0.0)).alias("Importe"), F.lit("fallback_no_parse").alias("ParseWarn"),
    )


def describe(layouts: list[Layout]) -> list[dict]:
    return [asdict(x) for x in layouts]
