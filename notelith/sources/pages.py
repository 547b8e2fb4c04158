"""Where pages come from: folders of PDFs, page dumps, text tables, delimited files, settings.

PDF text and recognition need libraries that may be missing; they are imported where they are used, in the workers.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.sources import pdf_text

PAGE_SCHEMA = "path string, pdf string, page int, width double, height double, text string"
WORDS = "array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>"


def document_set(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, modified, length): the PDFs of a folder, or one file; contents aren't read here."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not path.lower().endswith(".pdf"):
        reader = reader.option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def _pdf_pages(content: bytes, words: bool) -> list[tuple]:
    """(width, height, text, words) of each page: by pdfplumber where a worker has it, else by the reader of simple files."""
    boxes = lambda found: [{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")} for w in found] if words else None
    try:
        import pdfplumber
    except ImportError:
        return [(p.width, p.height, p.text, boxes(p.words)) for p in pdf_text.Document(content).pages]
    with pdfplumber.open(io.BytesIO(content)) as doc:
        return [(float(p.width), float(p.height), p.extract_text() or "", boxes(p.extract_words())) for p in doc.pages]


def read_pdf_pages(spark: SparkSession, path: str, recursive: bool = False, words: bool = False) -> DataFrame:
    """Pages with their embedded text (and words with their boxes); an unreadable file gives one page 0 without text."""
    schema = PAGE_SCHEMA + (f", words {WORDS}" if words else "")

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                name = os.path.basename(row.path)
                try:
                    for n, (width, height, text, boxes) in enumerate(_pdf_pages(row.content, words), 1):
                        out.append((row.path, name, n, width, height, text, boxes))
                except Exception:  # a broken file must not end the run
                    out.append((row.path, name, 0, None, None, None, None))
            columns = ["path", "pdf", "page", "width", "height", "text", "words"]
            yield pd.DataFrame(out, columns=columns)[columns[: 7 if words else 6]]

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not path.lower().endswith(".pdf"):
        reader = reader.option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.load(path).select("path", "content").mapInPandas(pages, schema)


def page_counts(pages: DataFrame) -> DataFrame:
    """(path, pages): 0 for a file that couldn't be read."""
    return pages.groupBy("path").agg(F.max("page").alias("pages"))


def read_page_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(pdf, page, text) of dumps <pdf>/p<nn>_lines.txt below a folder."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "p*_lines.txt").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    found = read.select(F.regexp_extract(at, r"([^/]+)/p[0-9]+_lines\.txt$", 1).alias("pdf"), F.regexp_extract(at, r"/p([0-9]+)_lines\.txt$", 1).try_cast("int").alias("page"), F.col("value").alias("text"))
    return found.withColumn("pdf", F.call_function("url_decode", "pdf"))


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of text files whose pages are parted by form feeds."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return read.select("path", F.posexplode(F.split("value", "\f")).alias("n", "text")).select("path", (F.col("n") + 1).alias("page"), "text")


def read_lines_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Evaluation lines from delimited files; the schema is given, never inferred."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, mode="PERMISSIVE")


def load_settings(base: str | None = None) -> dict:
    """The user's settings: the file beside a base folder, else the one in the home folder; a broken file is no settings."""
    for place in ([Path(base) / "settings.json"] if base else []) + [Path.home() / ".notelith" / "settings.json"]:
        try:
            found = json.loads(place.read_text(encoding="utf-8"))
            return found if isinstance(found, dict) else {}
        except (OSError, ValueError):
            continue
    return {}


def save_settings(settings: dict, base: str) -> None:
    place = Path(base) / "settings.json"
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps(settings, ensure_ascii=False, indent=2), encoding="utf-8")
