"""Pages of text: ordered lines, metrics, the decision for recognition, footers, sheets, ranges between markers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.functions import text as tx

#: Limits under which a page's own text is too poor.
MIN_CHARS, MIN_DENSITY, MIN_LINES, MIN_ENTROPY = 120, 0.0008, 4, 3.3
#: Points of an A4 page; used where a source gives no size.
PAGE_AREA = 595.0 * 842.0


def explode_lines(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., ln from 0, line) of every line that isn't blank."""
    return pages.select(*key, F.posexplode(tx.lines_of(text)).alias("ln", "line"))


@F.arrow_udf(T.DoubleType())
def _bits(texts: pa.Array) -> pa.Array:
    """Bits per character. Counting a text's characters with array functions costs a sort of boxed values per row."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts.to_pylist()):
        if text:
            counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1]
            share = counts / counts.sum()
            out[i] = -(share * np.log2(share)).sum()
    return pa.array(out)


def entropy(c: Column | str) -> Column:
    """Bits per character, white space left out; 0 for a text without characters. Within the row, no shuffle."""
    return _bits(F.regexp_replace(F.coalesce(tx.col(c), F.lit("")), tx.WS, ""))


def text_metrics(text: str, area: Column | float = PAGE_AREA) -> dict[str, Column]:
    chars = F.length(tx.trim_ws(F.coalesce(F.col(text), F.lit(""))))
    size = F.lit(area) if isinstance(area, float) else area
    return {
        "char_count": chars,
        "line_count": F.size(tx.lines_of(text)),
        "density": F.coalesce(F.try_divide(chars.cast("double"), size), F.lit(0.0)),
        "entropy": entropy(text),
    }


def recognition_reasons(chars: Column, density: Column, lines: Column, bits: Column) -> Column:
    """Why a page should be recognised again; an empty array if it needn't."""
    return F.array_compact(
        F.array(
            F.when(chars < MIN_CHARS, F.lit(f"chars<{MIN_CHARS}")),
            F.when(density < MIN_DENSITY, F.lit(f"density<{MIN_DENSITY}")),
            F.when(lines < MIN_LINES, F.lit(f"lines<{MIN_LINES}")),
            F.when(bits < MIN_ENTROPY, F.lit(f"entropy<{MIN_ENTROPY}")),
        )
    )


def footer_only(text: str, table_hints: list[str], footer_words: list[str], least: int = 2) -> Column:
    """A page without a table head on which several footer words stand."""
    folded = tx.fold_upper(F.coalesce(F.col(text), F.lit("")))
    hints = F.lit(False)
    for h in table_hints:
        hints = hints | folded.contains(h)
    hits = F.lit(0)
    for w in footer_words:
        hits = hits + folded.contains(w).cast("int")
    return ~hints & (hits >= least)


def sheet_of(text: str) -> dict[str, Column]:
    """The first 'Hoja n/m' or 'Hoja n de m'."""
    p = r"(?i)hoja\s+([0-9]+)\s*(?:/|de)\s*([0-9]+)"
    return {f"sheet{s}": F.regexp_extract(F.coalesce(F.col(text), F.lit("")), p, i).try_cast("int") for s, i in (("", 1), ("s", 2))}


def rows_between(lines: DataFrame, page: list[str], start: Column, stop: Column) -> DataFrame:
    """Lines behind a page's first start line and before the first stop line that follows it."""
    w = Window.partitionBy(*page)
    marked = lines.withColumn("_from", F.min(F.when(start, F.col("ln"))).over(w))
    marked = marked.withColumn("_to", F.min(F.when(stop & (F.col("ln") > F.col("_from")), F.col("ln"))).over(w))
    inside = (F.col("ln") > F.col("_from")) & (F.col("_to").isNull() | (F.col("ln") < F.col("_to")))
    return marked.where(inside).drop("_from", "_to")


def target_pages(pages: DataFrame, page: str, wanted: str | None) -> DataFrame:
    """The pages of a list such as ``1-3,5``; all of them if nothing is wanted. Reaches the scan as a filter."""
    keep = None
    for part in (wanted or "").split(","):
        low, _, high = part.strip().partition("-")
        if low:
            hit = F.col(page).between(int(low), int(high or low))
            keep = hit if keep is None else keep | hit
    return pages if keep is None else pages.where(keep)


def drop_noise(lines: Column, noise: str, required: str) -> Column:
    """Lines without those that are noise, unless they hold what is required."""
    return F.filter(lines, lambda x: ~(x.rlike(noise) & ~x.rlike(required)))


def attach_recognised(pages: DataFrame, recognised: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Pages with the recognised text of their page merged in (``recognised`` has key..., text)."""
    other = recognised.select(*key, F.col(text).alias("_ocr"))
    joined = pages.join(other, key, "left")
    return joined.withColumn(text, tx.merge_texts(text, "_ocr")).withColumn("ocr_applied", F.col("_ocr").isNotNull()).drop("_ocr")


def longest_by_engine(variants: DataFrame, key: list[str], order: str = "stage", text: str = "text") -> DataFrame:
    """Of several engines' texts of a page the longest; of equal ones the earliest stage."""
    best = F.max_by(F.struct(text, order), F.struct(F.length(text), -F.col(order))).alias("_b")
    return variants.groupBy(*key).agg(best).select(*key, f"_b.{text}", f"_b.{order}")
