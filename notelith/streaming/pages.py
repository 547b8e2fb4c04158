"""Pages as a stream: counts over event time, the state of each document, incremental output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notelith.runtime import shared_folder

CARRIED = "Pdf string, Pagina int, carried string"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(pages: DataFrame, time: str, by: list[str], length: str = "7 days", late: str = "30 days") -> DataFrame:
    """Pages of each window of event time; what comes later than ``late`` is left out, as a watermark does."""
    return pages.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count("*").alias("pages"))


def sliding_counts(pages: DataFrame, time: str, length: str, slide: str, late: str) -> DataFrame:
    return pages.withWatermark(time, late).groupBy(F.window(time, length, slide)).agg(F.count("*").alias("pages"))


def session_counts(pages: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    return pages.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("pages"))


def carried_notes(pages: DataFrame) -> DataFrame:
    """The last note number of each document as its pages arrive; one text of state per document."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(frames)).sort_values("Pagina")
        carried = []
        for note in batch["note"]:
            last = note if isinstance(note, str) and note else last
            carried.append(last)
        state.update((last,))
        yield pd.DataFrame({"Pdf": key[0], "Pagina": batch["Pagina"].astype("int32"), "carried": carried})

    return pages.groupBy("Pdf").applyInPandasWithState(step, CARRIED, "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, shared: str | None = None, mode: str = "append") -> DataFrame:
    """Everything there is now, written to the shared folder and read back. A stream that stops after its input."""
    spark = stream.sparkSession
    at = f"{(shared or shared_folder(spark)).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")
