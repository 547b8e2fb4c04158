"""What one page hands on to the next of its document.

Pages of a document are read in order, one at a time, with a state of one value: partitions are sorted and streamed, so
memory doesn't grow with a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelith.operators.rows import last_value
from notelith.runtime import ship


def carry_forward(pages: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """``carried``: the page's own value, else that of the nearest page before; no page is skipped or made up."""
    known = F.when(F.length(F.trim(F.col(value))) > 0, F.col(value))
    return pages.withColumn("carried", F.coalesce(known, last_value([doc], order, known, 1 << 30)))


class PageState:
    """The rule by which pages are dropped or fall back, and what is carried on."""

    def __init__(self) -> None:
        self.last: str | None = None

    def step(self, note: str | None, items: int, sheet: int | None, sheets: int | None, footer: bool) -> tuple[str, str | None]:
        """(decision, note): only pages with rows, own or made up, change what is carried."""
        known = note or self.last
        last_sheet = sheet is not None and sheet == sheets
        if items > 0:
            self.last = note or self.last
            return "rows", known
        if last_sheet and note is not None and note == self.last:
            return "skipped", known
        if footer and self.last is not None and last_sheet and (sheets or 0) >= 2:
            return "skipped", known
        self.last = known
        return "fallback", known


def decide_pages(pages: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, order, decision, note) from pages with columns note, items, sheet, sheets, footer."""
    schema = T.StructType([pages.schema[doc], pages.schema[order], T.StructField("decision", T.StringType()), T.StructField("note", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), PageState()
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
            out = []
            for d, _, note, items, sheet, sheets, footer in rows:
                if d != current:
                    current, state = d, PageState()
                out.append(state.step(note or None, items or 0, sheet, sheets, bool(footer)))
            names = [doc, order, "decision", "note"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=names)

    ship(pages.sparkSession)
    slim = pages.select(doc, order, "note", "items", "sheet", "sheets", "footer")
    return slim.repartition(doc).sortWithinPartitions(doc, order).mapInArrow(run, schema)
