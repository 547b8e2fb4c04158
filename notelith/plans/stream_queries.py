"""Streams over the documents, run until their input ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.runtime import table
from notelith.streaming import pages


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # A glob: a table may be one file or a folder of them.
    return pages.read_stream(spark, f"{sf_dir}/documents.parquet*", schema)


def stream_week_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = _stream(spark, sf_dir).withColumn("received_at", F.col("received_at").cast("timestamp"))
    counted = pages.windowed_counts(arrived, "received_at", ["source"], "7 days", "3650 days")
    found = pages.run_available(counted, mode="complete")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("week"), "source", "pages")


def stream_carried_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"Albar[áa]n ([0-9]{6,})", 1), F.lit(""))
    return pages.run_available(pages.carried_notes(_stream(spark, sf_dir).select("Pdf", "Pagina", note.alias("note"))))


QUERIES = {f.__name__: f for f in (stream_week_counts, stream_carried_notes)}

SQL = {
    "stream_week_counts": """SELECT time_bucket(INTERVAL 7 DAYS, received_at, TIMESTAMP '1970-01-01') AS week, source, count(*) AS pages FROM documents GROUP BY ALL""",
    "stream_carried_notes": """WITH d AS (SELECT Pdf, Pagina, nullif(regexp_extract(coalesce(text, ''), 'Albar[áa]n ([0-9]{6,})', 1), '') note FROM documents)
SELECT Pdf, Pagina, last_value(note IGNORE NULLS) OVER (PARTITION BY Pdf ORDER BY Pagina ROWS UNBOUNDED PRECEDING) AS carried FROM d""",
}
