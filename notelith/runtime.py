"""Session-level helpers: tables, durable intermediate results, sizes."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "notelith", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    # The folder all executors share, through Hadoop's file systems; a temporary one only where none is named.
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/notelith-{sc.applicationId}.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(at.toString())
    _SHIPPED.add(sc.applicationId)


_TEMPORARY: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and not _TEMPORARY:
        _TEMPORARY.append(tempfile.mkdtemp(prefix="notelith-"))
    return (named or _TEMPORARY[0]).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a checkpoint in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
    temporary folder is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def missing_as_null(df: DataFrame, names: list[str]) -> DataFrame:
    """Null, NaN and '' (texts that are empty) all become null."""
    kinds = dict(df.dtypes)
    fix = {}
    for name in names:
        col = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            fix[name] = F.when(F.isnan(col), None).otherwise(col)
        elif kinds[name] == "string":
            fix[name] = F.nullif(col, F.lit(""))
    return df.withColumns(fix)


def blocks_for(n_rows: int, rows_per_block: int, least: int = 1) -> int:
    """How many hash blocks keep the rows of one block within a bound."""
    return max(least, -(-n_rows // rows_per_block))
