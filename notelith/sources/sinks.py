"""Where results go: the run's tables, logs, errors and summaries, each a folder of files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelith.operators import rows, totals

TRACE_COLUMNS = [
    "Pdf", "Pagina", "ProveedorDetectado", "Parser", "OcrStage", "OcrPipeline", "Items", "NeedsRequired", "Fallback", "OcrApplied", "OcrForceAll",
    "CharCount", "LineCount", "Density", "Entropy", "CharCountPre", "LineCountPre", "DensityPre", "EntropyPre", "OcrTriggered", "TriggerReason",
    "WarningCode", "WarningMessage", "MissingReferenceFields", "DiagnosticAction",
]


def write(df: DataFrame, path: str, form: str = "parquet", order: list[str] | None = None) -> None:
    """``order``: the files in the order of their names hold the rows in this order; ranges are sorted, not all rows in one task."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path))


def write_new(df: DataFrame, path: str, form: str = "parquet") -> str:
    """Never overwrites: a path that is taken gets a time behind it. Returns where the rows went."""
    try:
        df.write.format(form).mode("errorifexists").save(path)
        return path
    except AnalysisException:
        other = f"{path}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
        df.write.format(form).mode("errorifexists").save(other)
        return other


def write_run(lines: DataFrame, meta: DataFrame, path: str, form: str = "parquet", summary: bool = True) -> None:
    """Lineas, Totales_por_Albaran and, on demand, Resumen_Proveedor."""
    write(rows.canonical(lines), f"{path}/Lineas", form)
    write(totals.note_totals(meta, ["Pdf", "Pagina"]), f"{path}/Totales_por_Albaran", form)
    if summary:
        write(totals.supplier_figures(lines, ["Proveedor"]), f"{path}/Resumen_Proveedor", form)


def ordered_trace(trace: DataFrame) -> DataFrame:
    """Known columns in their order, then the rest."""
    known = [c for c in TRACE_COLUMNS if c in trace.columns]
    return trace.select(*known, *(c for c in trace.columns if c not in known))


def write_trace(trace: DataFrame, path: str) -> None:
    ordered_trace(trace).write.mode("overwrite").json(f"{path}/detalle_paginas")


def write_errors(errors: DataFrame, lines: DataFrame, path: str) -> None:
    """Errores, Fallbacks_en_Detalle and the errors as text, one a line."""
    write(errors, f"{path}/Errores")
    write(lines.where(F.col("ParseWarn").rlike(r"\bfallback_no_parse\b")), f"{path}/Fallbacks_en_Detalle")
    text = F.format_string("%s p.%s [%s] %s", F.col("pdf"), F.col("page").cast("string"), F.col("severity"), F.col("msg"))
    errors.select(text.alias("value")).write.mode("overwrite").text(f"{path}/errores_txt")


def write_skipped(skipped: DataFrame, path: str) -> bool:
    """Only if there are any."""
    if skipped.isEmpty():
        return False
    write(skipped, f"{path}/paginas_omitidas", "csv")
    return True


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/resumen")


def write_checks(checks: DataFrame, path: str, run: str) -> dict:
    """Results of checks (name, passed, message) of a run as JSON, CSV and text, and what the latest run is; returns its counts."""
    spark = checks.sparkSession
    counts = checks.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed")).first().asDict()
    checks.write.mode("overwrite").json(f"{path}/{run}/json")
    write(checks, f"{path}/{run}/csv", "csv", ["name"])
    line = F.format_string("%s %s %s", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("name"), F.coalesce("message", F.lit("")))
    checks.select(F.trim(line).alias("value")).write.mode("overwrite").text(f"{path}/{run}/txt")
    latest = {"run": run, "path": f"{path}/{run}", **counts}
    spark.createDataFrame([(json.dumps(latest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/latest")
    return counts


def write_debug(steps: DataFrame, path: str, level: int, least: int = 1) -> bool:
    """What each step of a page found, as JSON by document; only from a level of detail on."""
    if level < least:
        return False
    steps.write.mode("overwrite").partitionBy("Pdf").json(f"{path}/debug")
    return True
